"""Operator 12: the trie of all conversations' prefixes, built level by level and rolled up the same way."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.order import numbered
from ..operators.relational import join_groups
from .common import SPACE, passing, saved, small_batches

#: Characters of role and text that order turns of one number before their digest does.
SHOWN = 64
#: Bits of neighbouring conversation ids whose digest input is put together by one task, and depths that one row is unrolled to.
ID_BITS, UNROLLED = 12, 10_000


def turns_in_order(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> tuple[DataFrame, DataFrame, int, int]:
    """(turns, conversations, rows, rows of the largest conversation): turns are conv, place in the order of all, key and words, conversations conv, first place and n.

    The key is the SHA-256 of role and text, so that later steps move no text.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    words = F.regexp_count(text, F.lit(f"[^{SPACE}]+")).cast("long")
    key = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), F.substring(role, 1, SHOWN).alias("role"), F.substring(text, 1, SHOWN).alias("text"), key.alias("key"), words.alias("words")
    )
    ordered = numbered(rows, ["conv", F.col("turn").asc_nulls_first(), "role", "text", "key"], "place").select("conv", "place", "key", "words")
    convs = saved(ordered.groupBy("conv").agg(F.min("place").alias("first"), F.count("*").alias("n")), "convs")
    size = convs.agg(F.sum("n").alias("all"), F.max("n").alias("most")).first()
    return ordered, convs, size["all"] or 0, size["most"] or 0


def with_shared_heads(turns: DataFrame, convs: DataFrame, total: int, largest: int, every: int, heads: Column, longest: int) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are replaced by those of the first one of their ``every`` neighbours: (turns, conversations).

    ``heads``, a column over conv, says how many turns of its own a conversation gives up, ``longest`` at
    most; it gets as many of the other, or all that has. Turns are conv, pos from 1, key, words; conversations conv and size.
    """
    own = convs.select("conv", "first", "n", heads.alias("h"), (F.col("conv") - F.col("conv") % every).alias("base"))
    found = own.join(convs.select(F.col("conv").alias("base"), F.col("n").alias("there")), "base", "left")
    found = saved(found.withColumn("given", F.least("h", F.coalesce("there", F.lit(0)))), "heads")
    placed = join_groups(turns, found.select("conv", "first", "n", "h", "given"), ["conv"], "n", total, largest)
    placed = saved(placed.withColumn("pos", F.col("place") - F.col("first") + 1).select("conv", "pos", "key", "words", "h", "given"), "placed")
    rest = placed.filter(F.col("pos") > F.col("h")).select("conv", (F.col("pos") - F.col("h") + F.col("given")).alias("pos"), "key", "words")
    lent = placed.filter(F.col("pos") <= longest).select(F.col("conv").alias("base"), "pos", "key", "words")
    lent = lent.join(found.select("conv", "base", "given"), "base").filter(F.col("pos") <= F.col("given")).select("conv", "pos", "key", "words")
    size = F.col("given") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    return rest.unionByName(lent), saved(found.select("conv", size.alias("size")), "convs")


def _digests(ends: DataFrame) -> DataFrame:
    """(depth, conv_id, ends_sha256) of (depth, node, conv): SHA-256 of the ids in order, joined by commas.

    Neighbouring ids, 4096 at most, are joined first; then a node's pieces stream through one task, which holds just the digest.
    """
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    pieces = ends.groupBy("depth", "node", F.shiftright("conv", ID_BITS).alias("block")).agg(ids.alias("ids"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, digest, rows = None, hashlib.sha256(), []
        for b in batches:
            for *node, text in zip(b["depth"], b["node"], b["ids"]):
                if node == at:
                    digest.update(b"," + text.encode())
                else:
                    if at:
                        rows.append((*at, digest.hexdigest()))
                    at, digest = node, hashlib.sha256(text.encode())
            if rows:
                yield pd.DataFrame(rows, columns=["depth", "conv_id", "ends_sha256"])
                rows = []
        if at:
            yield pd.DataFrame([(*at, digest.hexdigest())], columns=["depth", "conv_id", "ends_sha256"])

    small_batches(ends.sparkSession)
    return pieces.repartition("depth", "node").sortWithinPartitions("depth", "node", "block").select("depth", "node", "ids").mapInPandas(run, "depth long, conv_id long, ends_sha256 string")


def _levels(turns: DataFrame, convs: DataFrame, root: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(nodes, live) of each depth: nodes are depth, conv_id, parent, n, words; live are depth, conv, node, size of the conversations in nodes of two or more.

    Conversations that share the node of a depth meet by their next turn; a node's id is the least conversation in it.
    One that is alone in its node isn't followed any further, so there are as many levels as the longest shared prefix has turns.
    """
    live = [saved(convs.select(F.lit(0).cast("long").alias("depth"), "conv", F.lit(root).cast("long").alias("node"), "size"), "live")]
    nodes = [live[0].groupBy("depth", F.col("node").alias("conv_id")).agg(F.count("*").alias("n")).select("depth", "conv_id", F.lit(None).cast("long").alias("parent"), "n", F.lit(0).cast("long").alias("words"))]
    while True:
        depth = F.lit(len(nodes)).cast("long")
        met = live[-1].select("conv", "node", "size").join(turns.filter(F.col("pos") == depth).select("conv", "key", "words"), "conv")
        groups = saved(met.groupBy("node", "key").agg(F.min("conv").alias("least"), F.count("*").alias("n"), F.max("words").alias("words")), "groups")
        size = groups.agg(F.sum("n").alias("all"), F.max("n").alias("most")).first()
        if not size["all"]:
            return nodes, live
        nodes.append(groups.select(depth.alias("depth"), F.col("least").alias("conv_id"), F.col("node").alias("parent"), "n", "words"))
        if size["most"] == 1:
            return nodes, live
        shared = groups.filter("n > 1").select("node", "key", "least", "n")
        live.append(saved(join_groups(met, shared, ["node", "key"], "n", size["all"], size["most"]).select(depth.alias("depth"), "conv", F.col("least").alias("node"), "size"), "live"))


def _rolled_up(nodes: list[DataFrame]) -> list[DataFrame]:
    """Each depth's nodes with n_children, n_leaves and saved_tokens of their subtrees, from the deepest one up."""
    done: list[DataFrame] = []
    for own in reversed(nodes):
        out = own.withColumn("saved", (F.col("n") - 1) * F.col("words"))
        if done:
            below = done[-1].groupBy(F.col("parent").alias("conv_id")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("below"))
            out = out.join(below, "conv_id", "left")
        else:
            out = out.select("*", *(F.lit(None).cast("long").alias(c) for c in ("n_children", "leaves", "below")))
        sums = [F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("leaves", F.lit(1)).alias("n_leaves"), (F.col("saved") + F.coalesce("below", F.lit(0))).alias("saved_tokens")]
        done.append(saved(out.select("depth", "conv_id", "parent", "n", *sums), "rolled"))
    return done[::-1]


def _all(tables: list[DataFrame]) -> DataFrame:
    """The rows of tables that were saved with one schema, as one scan."""
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*(t.saved_at for t in tables))


def _trie(turns: DataFrame, convs: DataFrame, keep: Callable[..., None]) -> DataFrame:
    """The nodes of (conv, pos, key, words) and (conv, size), see ``prefix_trie``; ``keep`` gets the tables that it reads."""
    spark, names = turns.sparkSession, ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    ends_of = convs.agg(F.min("conv").alias("root"), F.max("size").alias("longest")).first()
    if ends_of.root is None:
        return spark.createDataFrame([], ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in names))
    ranged = saved(turns.repartitionByRange("pos", "conv").sortWithinPartitions("pos", "conv"), "turns")  # a level reads its own files
    nodes, live = _levels(ranged, convs, ends_of.root)
    rolled = _rolled_up(nodes)
    digests = saved(_digests(_all(live).filter(F.col("size") == F.col("depth")).select("depth", "node", "conv")), "ends")
    tops = saved(_all(rolled).filter("n = 1 AND depth > 0").select(F.col("conv_id").alias("conv"), "depth", "parent").join(convs, "conv"), "tops")
    keep(digests, tops, *rolled)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    shared = _all(rolled).filter("n > 1 OR depth = 0").join(digests, ["depth", "conv_id"], "left")
    shared = shared.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", digest(F.lit(""))).alias("ends_sha256"))
    # From where a conversation is alone on, there is one node for each of its turns.
    from_here, last = F.col("from"), F.least(F.col("from") + (UNROLLED - 1), F.col("size"))
    pieces = tops.select("*", F.explode(F.sequence("depth", "size", F.lit(UNROLLED).cast("long"))).alias("from"))
    if ends_of.longest > UNROLLED:
        pieces = pieces.repartition("conv", "from")
    alone = pieces.select("conv", "parent", "size", F.col("depth").alias("top"), F.explode(F.sequence(from_here, last)).alias("depth"))
    one, at_end = F.lit(1).cast("long"), F.col("depth") == F.col("size")
    alone = alone.select(
        F.col("conv").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("top"), F.col("parent")).otherwise(F.col("conv")).alias("parent_conv_id"), one.alias("n_convs"), F.when(at_end, 0).otherwise(1).cast("long").alias("n_children"),
        one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(at_end, digest(F.col("conv").cast("string"))).otherwise(digest(F.lit(""))).alias("ends_sha256"),
    )
    return shared.unionByName(alone).select(*names)


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", every: int | None = None, heads: Column | None = None, longest: int = 0) -> DataFrame:
    """A row for each distinct beginning of a conversation, from the empty one on: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node is the first ``depth`` turns (role and text) of its members; it is known by its depth and its
    smallest member. ``saved_tokens`` adds up, over its subtree, the words of a node's last text times its
    members but one: what a cache of prefixes need not read again. ``ends_sha256`` is the digest of the
    members that have no further turn. With ``every`` and ``heads`` see ``with_shared_heads``.

    Conversation ids are integers; rows without one belong to no conversation and are left out. Turns go by
    number, null first, then by the beginnings of role and text, then by their digest; repeated rows are
    turns of their own. Null roles and texts are empty. Other columns are ignored, whatever their names; an
    empty table has no nodes. Texts are equal if their SHA-256 are. No text is moved but in the first sort,
    and there only its beginning. A heavy conversation, turn or node is shared out to many tasks.
    """
    with passing() as keep:
        turns, convs, total, largest = turns_in_order(conversations, conv_col, turn_col, role_col, text_col)
        if every and total:
            turns, convs = with_shared_heads(turns, convs, total, largest, every, heads, longest)
        else:
            turns = join_groups(turns, convs, ["conv"], "n", total, largest).select("conv", (F.col("place") - F.col("first") + 1).alias("pos"), "key", "words")
            convs = convs.select("conv", F.col("n").alias("size"))
        return _trie(turns, convs, keep)
