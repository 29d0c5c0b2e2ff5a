"""Text as rows: tokens with their neighbours, and TF-IDF weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import words
from ..sources.scratch import saved
from .relational import BROADCAST_ROWS

#: Starts and lengths of runs in a text: twice ``least`` times its words stays below.
_PLACES = 10**13


def tokens(df: DataFrame, ids: list[str], text: str) -> DataFrame:
    """(ids, i, tok, prev, next, place) of white-space tokens; neighbours come from the row's own array, without a shuffle."""
    toks = df.select(*ids, F.filter(F.split(text, r"\s+"), lambda x: x != "").alias("toks"))
    out = toks.select(*ids, "toks", F.posexplode("toks").alias("i", "tok"))
    return out.select(*ids, "i", "tok", F.when(F.col("i") > 0, F.get("toks", F.col("i") - 1)).alias("prev"), F.get("toks", F.col("i") + 1).alias("next"), (F.col("i") / F.size("toks")).alias("place"))


def ngrams(words, n: int):
    """Runs of n words, joined by spaces."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def tfidf(df: DataFrame, key: str, text: str, min_df: int = 1, max_df: float = 1.0, sublinear: bool = False, longest: int = 1) -> DataFrame:
    """(key, term, weight): smoothed idf ln((1 + n) / (1 + df)) + 1, each document's weights of length 1.

    Terms are lower-case words of two letters or digits or more, and runs of up to ``longest``.
    """
    found = df.select(key, F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]{2,})"), F.lit(1)).alias("w"))
    terms = F.flatten(F.array(*(ngrams(F.col("w"), n) for n in range(1, longest + 1)))) if longest > 1 else F.col("w")
    tf = found.select(key, F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    n = tf.select(key).distinct().count()
    kept = tf.groupBy("term").agg(F.count("*").alias("df")).filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n))
    weight = (1 + F.log("tf") if sublinear else F.col("tf")) * (F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1)
    out = tf.join(kept, "term").select(key, "term", weight.alias("v"))
    return out.select(key, "term", (F.col("v") / F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(key)))).alias("weight"))


def word_importance(df: DataFrame, text: str, chosen: str, label: str, least: int = 3) -> DataFrame:
    """(label, word, importance): how often a word stands in the chosen span, over how often it stands in the text. Lower case; rarer words are left out."""
    count = lambda c, n: df.select(label, F.explode(words(F.lower(F.coalesce(F.col(c), F.lit(""))))).alias("word")).groupBy(label, "word").agg(F.count("*").alias(n))
    met = count(text, "n").filter(F.col("n") >= least).join(count(chosen, "k"), [label, "word"], "left")
    return met.select(label, "word", (F.coalesce("k", F.lit(0)) / F.col("n")).alias("importance"))


def best_span(df: DataFrame, ids: list[str], text: str, label: str, importance: DataFrame, neutral: str, short: int, unknown: float = 0.5, least: int = 1) -> DataFrame:
    """(ids, span): the run of ``least`` words or more with the best mean importance, less a little for its length; the first of equal ones.

    The mean counts times 1 - 0.03 of the run's share in the text. Importances aren't negative, and unknown words have
    that of ``unknown``. Texts of the neutral label, of at most ``short`` or fewer than ``least`` words, or of a label without importances stay
    whole. Of a run of twice ``least`` words or more one half is at least as good, so only shorter
    ones are tried, and a text of any length is passed over once. Importances are found once, and written.
    """
    importance = saved(importance.select(label, "word", "importance"), "importance")
    rows = df.select(*ids, F.col(label).alias("__label"), F.trim(F.coalesce(F.col(text), F.lit(""))).alias("__text")).withColumn("__words", words(F.col("__text")))
    table = importance.select(F.col(label).alias("__l"), F.col("word").alias("__w"), "importance")
    known = importance.select(F.col(label).alias("__label")).distinct()
    few = known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = rows.join((F.broadcast(known) if few else known).withColumn("__known", F.lit(True)), "__label", "left")
    n = F.size("__words")
    whole = F.coalesce(F.col("__label") == F.lit(neutral), F.lit(True)) | (n <= short) | (n < least) | F.col("__known").isNull()
    opened = rows.filter(~whole).select(*ids, "__label", n.alias("__n"), F.posexplode("__words").alias("__i", "__word"))
    small = table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    met = opened.join(F.broadcast(table) if small else table, (F.col("__label") == F.col("__l")) & (F.lower("__word") == F.col("__w")), "left").withColumn("__v", F.coalesce("importance", F.lit(unknown)))
    runs, names = Window.partitionBy(*ids).orderBy("__i"), [f"__s{size}" for size in range(least, 2 * least)]
    # Score, start and length of a run as one number, the better the larger, so that the best one is found by hash, without a sort.
    for size, name in zip(range(least, 2 * least), names):
        total = F.col("__v") if size == 1 else F.sum("__v").over(runs.rowsBetween(0, size - 1))
        value = total / size * (F.lit(0.7) + F.lit(0.3) * (1 - F.lit(0.1) * (F.lit(size) / F.col("__n"))))
        place = F.lit(_PLACES - 1) - (F.col("__i").cast("long") * (2 * least) + size)
        met = met.withColumn(name, F.when(F.col("__i") + size <= F.col("__n"), (F.round(value * 1e12).cast("decimal(23,0)") * F.lit(_PLACES).cast("decimal(14,0)") + place.cast("decimal(14,0)")).cast("decimal(38,0)")))
    best = met.groupBy(*ids).agg(F.max(F.greatest(*names) if least > 1 else F.col(names[0])).alias("__best"))
    place = F.lit(_PLACES - 1) - (F.col("__best") % F.lit(_PLACES).cast("decimal(14,0)")).cast("long")
    run = F.array_join(F.slice("__words", (F.floor(place / (2 * least)) + 1).cast("int"), (place % (2 * least)).cast("int")), " ")
    # Texts that stay whole meet nothing more, and the others take no array of words through the join.
    short_cut = rows.filter(whole).select(*ids, F.col("__text").alias("span"))
    cut = rows.filter(~whole).select(*ids, "__text").join(best, ids, "left").withColumn("__words", words(F.col("__text")))
    return short_cut.unionByName(cut.select(*ids, run.alias("span")))
