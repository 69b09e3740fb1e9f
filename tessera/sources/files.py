"""Reading and writing JSON lines, Parquet, text files; quarantine of bad rows; checkpointed appends."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, skip_bad: bool = False) -> DataFrame:
    """Rows of JSON lines, plain or gzip, of a file, folder or glob. Bad rows raise unless they are to be skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if skip_bad else "FAILFAST").json(path)


def read_quarantined(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad ones as (file, line_no, raw). Lines are numbered within each split of a file, and splits by the lines before
    them, so that no file is in one task."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")).where(F.trim("value") != "")
    blocks = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lines = lines.join(blocks.select("file", "block", before.alias("before")), ["file", "block"])
    line_no = (F.col("before") + F.row_number().over(Window.partitionBy("file", "block").orderBy("at"))).cast("int")
    parsed = lines.select("*", line_no.alias("line_no"), F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("row"))
    good = parsed.where("row._bad is null").select("row.*").drop("_bad")
    return good, parsed.where("row._bad is not null").select("file", "line_no", F.col("value").alias("raw"))


def read_nested(spark: SparkSession, path: str, element: str, names: tuple[str, ...] = ("data", "questions", "items", "samples", "records", "rows", "payload")) -> DataFrame:
    """Rows of a JSON document that is a list, or holds one under the first of these names."""
    whole = spark.read.option("wholetext", True).text(path)
    lists = [F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<{element}>")), *(F.from_json(F.get_json_object("value", f"$.{n}"), f"array<{element}>") for n in names)]
    return whole.select(F.explode(F.coalesce(*(F.when(F.size(x) > 0, x) for x in lists))).alias("r")).select("r.*")


def detect_fields(columns: list[str], candidates: dict[str, tuple[str, ...]]) -> dict[str, str]:
    """Logical names to columns: the first candidate that exists, whatever its case."""
    lower = {c.lower(): c for c in reversed(columns)}
    return {k: lower[c.lower()] for k, names in candidates.items() for c in [next((n for n in names if n.lower() in lower), None)] if c}


def read_text_files(spark: SparkSession, folder: str, pattern: str = "*.{txt,md,html}") -> DataFrame:
    """(path, text) of files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def append_new(df: DataFrame, path: str, key: str) -> int:
    """Appends rows whose key the Parquet table lacks; how many these were. A missing table is empty."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    exists = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    new = df.join(spark.read.parquet(path).select(key), key, "left_anti") if exists else df
    new = new.dropDuplicates([key]).persist()
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    new.unpersist()
    return n


def fingerprint(df: DataFrame, *columns: str) -> str:
    """A number of the rows' content, whatever their order; an index is valid for the corpus of its fingerprint."""
    row = df.select(F.xxhash64(*columns).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s")).first()
    return f"{row['n']}-{row['x']}-{row['s']}"


def version_of(spark: SparkSession, path: str) -> str:
    """A number of the files below a path, by name, size and time of change; no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.xxhash64("path", "length", "modificationTime").alias("h"))
    row = files.agg(F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s")).first()
    return f"{row['n']}-{row['x']}-{row['s']}"


def placed(spark: SparkSession, path: str, write: Callable[[str], None]) -> bool:
    """Whether it wrote a folder that was missing: beside its place, and renamed into it when whole."""
    place, beside = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.{uuid.uuid4().hex}.part"))
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(place):
        return False
    write(beside.toString())
    # a rename onto a folder that has come meanwhile would move into it
    if fs.exists(place) or not fs.rename(beside, place):
        fs.delete(beside, True)
        return False
    return True


def persist_index(spark: SparkSession, folder: str, name: str, tables: dict[str, Callable[[dict[str, DataFrame]], DataFrame]]) -> dict[str, DataFrame]:
    """The tables of an index below folder/name, which is to name the corpus and all settings. A missing one is made of those before it,
    written beside and renamed into place, so that readers see it whole or not at all; of two that write it at once, the first stays."""
    found: dict[str, DataFrame] = {}
    for table, make in tables.items():
        place = f"{folder}/{name}/{table}"
        placed(spark, place, lambda beside, make=make: make(found).write.parquet(beside))
        found[table] = spark.read.parquet(place)
    return found


def drop_indexes(spark: SparkSession, folder: str, keep: set[str]) -> list[str]:
    """Deletes the indexes below a folder whose names are not to be kept; their names."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = [s.getPath() for s in fs.listStatus(hadoop(folder)) if s.getPath().getName() not in keep] if fs.exists(hadoop(folder)) else []
    for path in gone:
        fs.delete(path, True)
    return sorted(path.getName() for path in gone)
