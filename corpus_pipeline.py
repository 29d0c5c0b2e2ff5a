"""A corpus pipeline of the training-data operators: each stage works on all that the one before kept.

``STAGES`` lists (name, function); every function takes (spark, docs, sf_dir). Stages but the last
return the columns of ``documents``; the last returns packed pieces. Null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import toxicity as toxic
from millrace.llm.common import discard, read, row_keys, saved
from millrace.llm.decontaminate import decontaminate
from millrace.llm.jaccard_join import jaccard_join
from millrace.llm.packing import pack
from millrace.llm.suffix_dedup import suffix_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Score from which a document is rejected as toxic.
REJECT = 0.7
#: Words of the shortest repeated passage that is removed.
REPEATED = 50


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: rejects toxic documents. Its model learns from the labelled rows that the operator's query does not hold out."""
    model = toxic.fit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1)
    return docs.withColumn("_score", toxic.score_column(spark, model)(F.coalesce("text", F.lit("")))).filter(F.col("_score") < REJECT).select(*COLUMNS)


def _row(docs: DataFrame) -> Column:
    """A row by its id and text, never null: ids may be missing, and one id may have several texts."""
    return row_keys(docs, "doc_id", "text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4, with five words and a similarity of 0.8: one row of each group stays, that of the smallest id.

    Rows without an id come last in a group; of rows equal in id and text one stays. Rows without words stay.
    """
    row = _row(docs)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), row.alias("row"))
    found = jaccard_join(docs.select(place.alias("place"), "text"), id_col="place", words=5, per_cent=80).filter("n_shingles > 0")
    # What a group's least row is not goes; what it is may still be there several times.
    marked = found.groupBy(F.col("doc_id.row").alias("_row")).agg(F.max(F.col("component_id.row") != F.col("doc_id.row")).alias("lost"), F.count("*").alias("n"))
    marked = saved(marked.filter("lost OR n > 1").select("_row", "lost"), "marked")
    keyed = docs.select(*COLUMNS, row.alias("_row"))
    single = keyed.join(marked.select("_row"), "_row", "left_anti").select(*COLUMNS)
    repeated = keyed.join(marked.filter("NOT lost").select("_row"), "_row", "left_semi").groupBy("_row").agg(F.min(F.struct(*COLUMNS)).alias("one"))
    return single.unionAll(repeated.select("one.*"))


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: passages of ``REPEATED`` words or more that start anywhere else as well go from the texts, every copy of them.

    Passages are judged by words: fifty take from 100 to over 500 bytes, depending on the language. A
    document that is emptied stays as one without text, so that no row gets lost here.
    """
    return suffix_dedup(docs, length=REPEATED, unit="words", carry=["lang", "source"]).select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: rows that hold a window of a benchmark item go, with or without an id."""
    keyed = docs.select(*COLUMNS, _row(docs).alias("_row"))
    hit = decontaminate(keyed, read(spark, sf_dir, "benchmark"), id_col="_row").filter("contaminated").select(F.col("doc_id").alias("_row")).distinct()
    return keyed.join(hit, "_row", "left_anti").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: windows of token ids. Documents without text left give their end id alone."""
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_spans", repeated_spans),
    ("benchmark_passages", benchmark_passages),
    ("packing", packing),
]

#: The first stage is a trained model, so no SQL gives its rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what each returns is written to the shared folder and read again."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
