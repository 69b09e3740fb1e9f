"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader.

A text becomes tokens: words, runs of other characters, a mark where a token repeats the one
before, and a mark before words in capitals. Single tokens and adjacent pairs are hashed to 2**bits
features; a feature's value is its count over the square root of the number of features, and the
score is the logistic function of the sparse dot product with the weights plus a bias.

Training takes a bounded sample: the ``max_rows`` labelled rows whose ids hash lowest. One executor
task fits it (whole texts, a few passes) and gives the non-zero weights, at most 2**bits numbers.

Defined results: null and empty texts score the logistic function of the bias; conflicting labels
of one document count as the larger; null labels and labels other than 0 and 1 are not learnt from;
without labels every score is 0.5; repeated rows each get their row; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import batch, encoded, sliced

TOKEN = regex.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\s]+")
MODEL = pa.schema([("feature", pa.list_(pa.int32())), ("weight", pa.list_(pa.float64())), ("bias", pa.float64())])
MODEL_DDL = "feature array<int>, weight array<double>, bias double"
AGAIN, CAPITALS = 0x9E3779B1, 0x85EBCA6B


def features(text: str | None, bits: int) -> np.ndarray:
    """Feature numbers of single tokens and of adjacent pairs, repeats included."""
    tokens = TOKEN.findall(encoded(text))
    n = len(tokens)
    if not n:
        return np.zeros(0, np.int64)
    one = np.fromiter(map(zlib.crc32, tokens), np.uint64, n)
    again = np.flatnonzero(one[1:] == one[:-1]) + 1
    one[again] = AGAIN
    capital = np.fromiter(map(bytes.isupper, tokens), bool, n) & (np.fromiter(map(len, tokens), np.int64, n) > 2)
    if capital.any():
        # words in capitals are hashed in lower case, with a mark before each
        at = np.flatnonzero(capital & (one != AGAIN))
        one[at] = [zlib.crc32(tokens[i].lower()) for i in at.tolist()]
        one = np.insert(one, at, CAPITALS)
    two = one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    every = np.concatenate((one * np.uint64(0xD6E8FEB86659FD93), two))
    return ((every ^ (every >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits)).astype(np.int64)


class Ftrl:
    """Follow the regularised leader, proximal, with per-coordinate rates; feature 2**bits is the bias."""

    def __init__(self, bits: int, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> float:
        w = self.weights(at)
        p = logistic(w @ x)
        g = (p - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g
        return p


def logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def held_out(id_col: str, folds: int) -> Column:
    """True where crc32 of the id as text leaves 0 when divided by folds; null ids are held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, folds: int, bits: int, max_rows: int, passes: int, alpha: float, beta: float, l1: float, l2: float) -> dict:
    """The non-zero weights, by feature, and the bias."""
    known = labels.where(F.col(label_col).isin(0, 1) & ~held_out(id_col, folds))
    known = known.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    # at most max_rows ids and labels: a bound that does not grow with the data
    sample = known.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "id")
    rows = rows.groupBy("id", "label").agg(F.min("text").alias("text")).select("id", "text", "label")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = []
        for b in sliced(batches):
            for number, text, label in zip(*(c.to_pylist() for c in b.columns)):
                at, count = np.unique(features(text, bits), return_counts=True)
                x = count / np.sqrt(max(1, count.sum()))
                seen.append((zlib.crc32(str(number).encode()), number, np.append(at, 1 << bits).astype(np.int32), np.append(x, 1.0).astype(np.float32), label))
        seen.sort(key=lambda r: r[:2])
        model = Ftrl(bits, alpha, beta, l1, l2)
        for _ in range(passes):
            for _, _, at, x, label in seen:
                model.learn(at, x, label)
        w = model.weights(slice(None))
        there = np.flatnonzero(w[:-1])
        yield batch(MODEL, feature=[there.astype(np.int32)], weight=[w[there]], bias=[w[-1]])

    fitted = rows.repartition(1).mapInArrow(fit, MODEL_DDL).collect()
    return fitted[0].asDict() if fitted else {"feature": [], "weight": [], "bias": 0.0}


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3, folds: int = 5, bits: int = 20, max_rows: int = 12_000, passes: int = 3, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.05, l2: float = 1.0) -> DataFrame:
    """row (all columns of docs as a struct), held_out, score (that label 1 holds) and predicted (1 if score >= threshold, else 0)."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col, folds, bits, max_rows, passes, alpha, beta, l1, l2))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"), held_out(id_col, folds).alias("held_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros(1 << bits)
        w[model.value["feature"]] = model.value["weight"]
        for b in sliced(batches):
            sums = []
            for t in b.column(1).to_pylist():
                f = features(t, bits)
                sums.append(w[f].sum() / np.sqrt(max(1, len(f))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(logistic(np.array(sums, float) + model.value["bias"]), pa.float64())], names=["row", "held_out", "score"])

    schema = T.StructType([rows.schema["row"], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **options) -> DataFrame:
    """All columns of docs that do not clash, and held_out, score and predicted; options as of scored()."""
    out = scored(docs, labels, id_col, text_col, label_col, **options)
    new = ("held_out", "score", "predicted")
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in new), *new)


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **options) -> DataFrame:
    """Rows of docs, all columns as they are, whose score is at or above the threshold."""
    out = scored(docs, labels, id_col, text_col, label_col, **options).where("predicted = 1")
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
