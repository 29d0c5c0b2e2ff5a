"""Operator 3: benchmark decontamination as a prefix-filtered set join, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import ascii_lower, narrowed, passing, saved

#: What separates words. A word holds ASCII digits and letters and everything outside ASCII.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Item windows up to which the prefix table (about 200 bytes a window) is broadcast; beyond, it is shuffled.
BROADCAST_WINDOWS = 200_000


def _words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), GAP, -1), "")


def _shingles(words: Column, k: int) -> Column:
    """Hashes of every ``k`` consecutive words, in order; none if there are fewer words."""
    parts = lambda i: [F.get(words, i + j) for j in range(k)]
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(*parts(i)))
    return F.when(F.size(words) >= k, hashes).otherwise(F.array().cast("array<bigint>"))


def item_windows(items: DataFrame, item_id: str, text_col: str, window: int) -> DataFrame:
    """(item_id, wkey, words): each item's windows of ``window`` words, or its whole text when shorter."""
    words = narrowed(items, item_id, text_col).select(F.col("doc_id").alias("item_id"), _words(F.col("text")).alias("all")).filter(F.size("all") > 0)
    starts = words.select("item_id", "all", F.explode(F.sequence(F.lit(0), F.greatest(F.size("all") - window, F.lit(0)))).alias("at"))
    return starts.select("item_id", F.slice("all", F.col("at") + 1, F.lit(window)).alias("words")).select("item_id", F.array_join("words", " ").alias("wkey"), "words").distinct()


def _found(tokens: DataFrame, items: DataFrame, item_id: str, item_text: str, window: int, shingle: int, broadcast_windows: int) -> DataFrame:
    """(hit_id, hit_key, n_hit, items) of the documents that hold a window."""
    windows = saved(item_windows(items, item_id, item_text, window), "windows")
    distinct = windows.select("wkey", "words").distinct()
    few = distinct.count() <= broadcast_windows
    sized = F.broadcast if few else lambda x: x
    lengths = [k for k in range(1, shingle + 1) if k == shingle or not windows.filter(F.size("words") == k).isEmpty()]

    # The shingles of a window: of the full length, or the window itself when it is shorter.
    of_window = F.lit(None)
    for k in lengths:
        of_window = F.when((F.size("words") == k) if k < shingle else (F.size("words") >= k), _shingles(F.col("words"), k)).otherwise(of_window)
    placed = distinct.select("wkey", "words", F.posexplode(of_window).alias("at", "sh"))

    carried = ["dw"] if few else []  # within a stage the words cost nothing; shuffled, each position would take them along
    exploded = None
    for k in lengths:
        part = tokens.select("doc_id", "tkey", F.size("dw").alias("dn"), *carried, F.posexplode(_shingles(F.col("dw"), k)).alias("pos", "sh"))
        exploded = part if exploded is None else exploded.unionAll(part)

    rarity = exploded.select("sh").join(sized(placed.select("sh").distinct()), "sh").groupBy("sh").count()
    rarest = Window.partitionBy("wkey").orderBy(F.coalesce("count", F.lit(0)), "sh", "at")
    prefix = placed.join(rarity, "sh", "left").withColumn("order", F.row_number().over(rarest)).filter("order = 1 AND count > 0")
    prefix = saved(prefix.select("sh", "at", "wkey", "words"), "prefix")

    start, m = F.col("pos") - F.col("at"), F.size("words")
    inside = (start >= 0) & (start + m <= F.col("dn"))
    same = F.slice("dw", F.greatest(F.col("start"), F.lit(0)) + 1, m) == F.col("words")
    met = exploded.join(sized(prefix), "sh").filter(inside).withColumn("start", start)
    if not few:
        found = met.select(F.col("doc_id").alias("in_id"), F.col("tkey").alias("in_key"), "start", "wkey", "words").distinct()
        met = tokens.join(found, F.col("doc_id").eqNullSafe(F.col("in_id")) & (F.col("tkey") == F.col("in_key")))
    hits = saved(met.filter(same).select("doc_id", "tkey", "wkey", "start", (F.col("start") + m).alias("end")).distinct(), "hits")

    def grow(acc: Column, x: Column) -> Column:
        return F.struct((acc["n"] + F.greatest(x["end"] - F.greatest(x["start"], acc["to"]), F.lit(0))).cast("long").alias("n"), F.greatest(acc["to"], x["end"]).alias("to"))

    spans = F.sort_array(F.collect_set(F.struct("start", "end")))
    covered = hits.groupBy("doc_id", "tkey").agg(spans.alias("spans")).select("doc_id", "tkey", F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")), grow, lambda a: a["n"]).alias("n_hit"))
    found = hits.select("doc_id", "tkey", "wkey").distinct().join(windows.select("wkey", F.col("item_id").cast("string").alias("item")), "wkey").groupBy("doc_id", "tkey").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return saved(covered.join(found, covered["doc_id"].eqNullSafe(found["doc_id"]) & (covered["tkey"] == found["tkey"])).select(covered["doc_id"].alias("hit_id"), covered["tkey"].alias("hit_key"), "n_hit", "items"), "found")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, shingle: int = 2, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Find the benchmark windows that occur in each document, exactly.

    Item windows are taken as ordered sets of ``shingle``-word shingles. Shingles are ordered by
    their frequency over all documents; containment needs every shingle of a window, so the rarest
    one alone is the necessary prefix. Documents meet windows on it, candidates outside the document
    (position and length bounds) go, and the rest is verified word by word. Up to
    ``broadcast_windows`` windows are sent to the documents; more of them meet the documents'
    shingles in a shuffle of numbers, and only candidates are joined to the texts again.

    Returns a row for each input row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.
    Null or empty texts have no words; items without words have no windows; null item ids hit words
    but are not listed. Repeated rows give repeated results, repeated items count once by id. Empty
    tables and clashing columns are fine: only ids and texts are read.
    """
    tokens = narrowed(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("tkey"), _words(F.col("text")).alias("dw"))
    with passing() as keep:
        both = _found(tokens, items, item_id, item_text, window, shingle, broadcast_windows)
        keep(both)
    base = tokens.select("doc_id", "tkey", F.size("dw").cast("long").alias("n_words"))
    joined = base.join(both, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("tkey") == F.col("hit_key")), "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
