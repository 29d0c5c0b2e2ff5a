"""Reading and writing by format, a registry for further formats, and small scans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Reader = Callable[[SparkSession, str, dict], DataFrame]
Writer = Callable[[DataFrame, str, dict], None]


def _read(kind: str, **fixed) -> Reader:
    return lambda spark, path, options: spark.read.format(kind).options(**(fixed | options)).load(path)


def _write(kind: str, **fixed) -> Writer:
    return lambda df, path, options: df.write.format(kind).mode("overwrite").options(**(fixed | options)).save(path)


_FORMATS: dict[str, tuple[Reader, Writer | None]] = {
    "parquet": (_read("parquet"), _write("parquet")),
    "orc": (_read("orc"), _write("orc")),
    "csv": (_read("csv", header="true"), _write("csv", header="true")),
    "tsv": (_read("csv", header="true", sep="\t"), _write("csv", header="true", sep="\t")),
    "json": (_read("json", multiLine="true"), _write("json")),
    "jsonl": (_read("json"), _write("json")),
    "text": (_read("text", wholetext="true"), _write("text")),
    "lines": (_read("text"), _write("text")),
    "binary": (_read("binaryFile", recursiveFileLookup="true"), None),
    "image": (_read("binaryFile", recursiveFileLookup="true", pathGlobFilter="*.{png,jpg,jpeg,gif,bmp,tif,tiff}"), None),
}


#: Formats that were registered: their readers need not read files.
_OWN: set[str] = set()


def register(name: str, reader: Reader, writer: Writer | None = None) -> None:
    """Add a format, or replace one."""
    _OWN.add(name)
    _FORMATS[name] = (reader, writer)


def formats() -> list[str]:
    return sorted(_FORMATS)


def load(spark: SparkSession, path: str | list[str], fmt: str = "parquet", schema: StructType | str | None = None, columns: list[str] | None = None, limit: int | None = None, **options) -> DataFrame:
    """Scan ``path``. With a schema nothing is inferred; ``columns`` reach the scan, and ``limit`` is of the first rows of the first files."""
    if fmt not in _FORMATS:
        raise ValueError(f"unknown format {fmt!r}; known: {', '.join(formats())}")
    if schema is not None:
        df = spark.read.format({"tsv": "csv", "jsonl": "json"}.get(fmt, fmt)).schema(schema).options(**({"header": "true"} if fmt in ("csv", "tsv") else {}) | ({"sep": "\t"} if fmt == "tsv" else {}) | ({"multiLine": "true"} if fmt == "json" else {}) | options).load(path)
    else:
        df = _FORMATS[fmt][0](spark, path, options)
    if limit is not None:
        part = lambda files: load(spark, files, fmt, schema if schema is not None else df.schema, **({"basePath": path} | options))
        df = df.limit(limit) if fmt in _OWN else _first(df, limit, None if any(c in path for c in "*?[{") else part)
    return df.select(*columns) if columns else df


def _first(df: DataFrame, n: int, read: Callable[[list[str]], DataFrame] | None) -> DataFrame:
    """The first ``n`` rows in the order of the files' names and of the rows in them, wherever tasks find them first.

    Only as many of the first files are read as have so many rows. Sources without files have no order to go by.
    """
    files = sorted(df.inputFiles())
    if not files or n < 1:
        return df.limit(n)
    many, few = 1, df
    while read and many < len(files):
        few = read(files[:many])
        if few.limit(n).count() >= n:
            break
        many *= 2
    else:
        few = df
    place = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__row")]
    return few.select("*", *place).orderBy("__file", "__block", "__row").limit(n).select(*df.columns)


def save(df: DataFrame, path: str, fmt: str = "parquet", **options) -> None:
    writer = _FORMATS.get(fmt, (None, None))[1]
    if writer is None:
        raise ValueError(f"format {fmt!r} can't be written")
    writer(df, path, options)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return load(spark, f"{sf_dir}/{name}.parquet")


def with_file_name(df: DataFrame, name: str = "file") -> DataFrame:
    """The file each row comes from, for folders of one file an entity."""
    return df.withColumn(name, F.element_at(F.split(F.input_file_name(), "/"), -1))


def inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, name, suffix, length, modified) of the files below a folder; contents are not read."""
    files = load(spark, path, "binary", pathGlobFilter=pattern).select("path", "length", F.col("modificationTime").alias("modified"))
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), F.regexp_extract(name, r"\.([^.]+)$", 1).alias("suffix"), "length", "modified")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes null in every floating-point column."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, k in kinds.items() if k in ("double", "float")})
