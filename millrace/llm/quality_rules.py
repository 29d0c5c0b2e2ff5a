"""Operator 9: quality rules as a threshold table compiled into one Spark projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, narrowed

#: Frequent function words of English, German, French and Spanish, matched case-sensitively.
STOP_WORDS = (
    "the of and to in is was that with for on it as by at be this are from or an not a "
    "der die das und ist in zu den mit von für auf nicht ein eine im dem des sich auch als "
    "le la les de des et en un une est que qui dans pour pas sur au avec ce il du "
    "el los las y del que se una por con no para como su lo más"
).split()

_WORD_SPLIT = r"[\x20\x09-\x0D]+"
_SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """Keep a text when ``low <= 100 * numerator / denominator <= high`` (compared without division)."""

    name: str
    numerator: str
    denominator: str
    low: float | None
    high: float | None

    def passes(self) -> Column:
        top, base = F.col(self.numerator) * F.lit(100), F.col(self.denominator)
        checks = [top >= base * F.lit(self.low)] if self.low is not None else []
        checks += [top <= base * F.lit(self.high)] if self.high is not None else []
        out = F.lit(True)
        for c in checks:
            out = out & c
        return out


#: The production table: ratios in per cent of the denominator.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 250, 1200),
    Rule("symbol_ratio", "n_symbols", "n_words", None, 20),
    Rule("stop_word_ratio", "n_stop_words", "n_words", 4, None),
    Rule("duplicate_line_ratio", "n_dup_lines", "n_lines", None, 40),
)


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a bound variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column, n: Column) -> Column:
    """Words inside three-word windows that occur at least twice. Windows are compared by a 64-bit hash."""

    def covered(s: Column) -> Column:
        size = F.size(s)
        same = lambda i, j: (F.get(s, i)["h"] == F.get(s, j)["h"])
        hit = lambda i: F.coalesce(same(i, i - F.lit(1)), F.lit(False)) | F.coalesce(same(i, i + F.lit(1)), F.lit(False))
        starts = F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), size - 1), hit), lambda i: F.get(s, i)["p"]))
        step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).cast("long").alias("n"), p.alias("last"))
        return F.aggregate(starts, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")), step, lambda acc: acc["n"])

    def from_hashes(h: Column) -> Column:
        pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), _let(F.sort_array(pairs), covered)).otherwise(F.lit(0).cast("long"))

    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(n < 3, F.lit(0).cast("long")).otherwise(_let(hashes, from_hashes))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES, stop_words=STOP_WORDS, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """Measure every text and judge it by ``rules``, in one projection of built-in functions.

    Returns a row for each input row: doc_id, the counts, base_failed, kept, failed_rules. A null or
    empty text has no words and fails. Repeated rows and ids give repeated results; other columns
    are ignored, whatever their names. An empty table gives an empty result.
    """
    trimmed = F.btrim("text", F.lit(SPACE))
    words = narrowed(docs, id_col, text_col).select(
        "doc_id", "text", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _WORD_SPLIT, -1)).alias("words"),
        F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != "").alias("lines"),
    )
    long = lambda c: c.cast("long")
    n = F.size("words")
    counted = words.select(
        "doc_id",
        long(n).alias("n_words"),
        long(F.length(F.array_join("words", ""))).alias("word_chars"),
        long(F.size(F.split("text", _SYMBOLS, -1)) - 1).alias("n_symbols"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        long(F.size("lines")).alias("n_lines"),
        _repeat_words(F.col("words"), n).alias("n_repeat_words"),
        long(n - F.size(F.filter("words", lambda w: ~w.isin(*sorted(set(stop_words)))))).alias("n_stop_words"),
    )
    base = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)
    failed = F.array_compact(F.array(*(F.when(~r.passes(), F.lit(r.name)) for r in rules)))
    return counted.select("*", base.alias("base_failed"), failed.alias("failed_rules")).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
