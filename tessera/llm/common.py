"""What the operators of this subpackage share: words, shared tables, Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.session import shared_dir

#: Fixed values. Lower-case A-Z; digits, a-z and every byte from 0x80 are word bytes, the rest part words.
WORD_TABLE = bytes((b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

def words(text: str | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased, as UTF-8; null has none."""
    return encoded(text).translate(WORD_TABLE).split() if text else []


def encoded(text: str | None) -> bytes:
    """UTF-8 of a text; null is empty."""
    return text.encode("utf-8", "surrogatepass") if text else b""


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def delete_dir(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: cuts lineage and survives the loss of executors."""
    return df.sparkSession.read.schema(df.schema).parquet(write_to(df, name))


def write_to(df: DataFrame, name: str) -> str:
    path = fresh_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return path


@contextmanager
def arrow_bytes(spark: SparkSession, size: str) -> Iterator[None]:
    """Arrow batches of at most so many bytes (or one row) for what is written meanwhile; the session's setting is then as before."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key) if key in spark.conf.getAll else None
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows, for what is made of each row is larger than the row. Spark bounds the batches
    themselves in bytes (spark.sql.execution.arrow.maxBytesPerBatch), so very long texts come few at a time."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def lowest(df: DataFrame, most: int, by: str, order: list, spread: Column) -> DataFrame:
    """The first ``most`` rows of each value of a column, with their rank. As one value may have most rows, the first of each
    part of it are taken before: of 1,024 parts by a hash of ``spread``, then of 32, so that no window has more than 32 times ``most`` rows but those of the parts."""
    part = F.pmod(F.xxhash64(spread), F.lit(1024))
    for parts in (1024, 32):
        df = df.withColumn("_part", F.pmod(part, F.lit(parts)))
        df = df.withColumn("rank", F.row_number().over(W.partitionBy(by, "_part").orderBy(*order))).where(F.col("rank") <= most)
    return df.drop("_part").withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order)).cast("long")).where(F.col("rank") <= most)


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def groups(batches, keys: int):
    """Runs of rows that agree in the first ``keys`` columns (integers, sorted), as record batches."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(b.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        if held and any(held[-1].column(i)[held[-1].num_rows - 1].as_py() != columns[i][0] for i in range(keys)):
            yield _joined(held)
            held = []
        starts = [0, *np.flatnonzero(change).tolist()]
        for k, s in enumerate(starts):
            e = starts[k + 1] if k + 1 < len(starts) else b.num_rows
            part = b.slice(s, e - s)
            if e < b.num_rows:
                if held:
                    held.append(part)
                    part, held = _joined(held), []
                yield part
            else:
                held.append(part)
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


class Union:
    """Union-find over 0..n-1; the root of a set is its smallest member."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, a: int) -> int:
        parent = self.parent
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        return a

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True

    def roots(self) -> np.ndarray:
        return np.array([self.find(a) for a in range(len(self.parent))], np.int64)
