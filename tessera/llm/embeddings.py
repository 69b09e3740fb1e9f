"""Embedding near-duplicates: random-hyperplane sign hashing, exact cosine, connected components.

Equal vectors of a label are one class, so copies never make pairs. Each class gets a sign code
in each of several tables; classes that share a code in a table are compared by exact cosine in
double precision. A pair counts in the first table that brings it together, so counts need no
de-duplication of pairs. Buckets beyond ``block`` members are compared in pairs of blocks. With 32
tables of 16 bits a pair at cosine 0.98 is missed with probability 1e-6.

Defined results: a null label, and a vector that is null, empty, zero or holds null or non-finite
components, links with nothing and is its own component; vectors of different length never link;
repeated rows are copies; rows that share an id but not a vector share a component; an empty table gives an
empty table; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Union, batch, groups, sliced, written
from tessera.llm.components import components

FOUND = pa.schema([("class", pa.int64()), ("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def planes(dim: int, tables: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((tables * bits, dim))


def sign_codes(vectors: np.ndarray, tables: int, bits: int, seed: int) -> np.ndarray:
    signs = vectors @ planes(vectors.shape[1], tables, bits, seed).T > 0
    return (signs.reshape(len(vectors), tables, bits) @ (1 << np.arange(bits))).astype(np.int32)


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, tables: int = 32, bits: int = 16, block: int = 2048, seed: int = 7) -> DataFrame:
    """One row per vector: id, n_links (vectors linked directly), component_id, kept."""
    spark = rows.sparkSession
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    valid = F.coalesce(F.col("label").isNotNull() & F.col("id").isNotNull() & F.forall("v", finite) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("valid", valid)
    good = rows.where("valid").select("id", "label", "v")
    classes = good.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = written(classes.withColumn("class", F.xxhash64("label", "v")), "classes")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 4096):
            lengths = b.column(4).value_lengths().to_numpy()
            for dim in np.unique(lengths):
                some = b.filter(pa.array(lengths == dim))
                codes = pa.array(list(sign_codes(matrix(some.column(4)), tables, bits, seed)), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*some.columns, codes], names=[*some.schema.names, "codes"])

    members = classes.select("class", "rep", F.xxhash64("label").alias("kind"), "copies", "v")
    members = written(members.mapInArrow(hashed, "class long, rep long, kind long, copies long, v array<double>, codes array<int>"), "coded")
    keys = members.select("class", F.posexplode("codes").alias("table", "code"), F.xxhash64("kind", F.size("v"), "table", "code").alias("bucket"))
    sizes = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = keys.select("class", "table", "bucket").join(sizes, "bucket")
    blocks = F.ceil(F.col("n") / block).cast("int")
    shared = shared.select("class", "bucket", "table", F.pmod(F.xxhash64("class"), blocks).cast("int").alias("own"), blocks.alias("blocks"))
    # each pair of blocks meets once: a member goes wherever its block is one of the two
    dealt = shared.select("class", "bucket", "table", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "table", "own", "class")
    full = dealt.join(members, "class").select("bucket", "low", "high", "table", "own", "class", "rep", "copies", "v", "codes", "kind")
    full = full.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "class")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = [], 0
        for g in groups(batches, 3):
            if g.num_rows < 2:
                continue
            low, high, table = g.column(1)[0].as_py(), g.column(2)[0].as_py(), g.column(3)[0].as_py()
            own, number, rep, copies, label = (g.column(i).to_numpy() for i in (4, 5, 6, 7, 10))
            widths = g.column(8).value_lengths().to_numpy()
            if (widths != widths[0]).any():
                continue  # two buckets of one hash: vectors of unequal length never link
            v, codes = matrix(g.column(8)), matrix(g.column(9))
            norm = np.sqrt((v * v).sum(1))
            union, count = Union(len(rep)), np.zeros(len(rep), np.int64)
            for i in range(len(rep)):
                j = np.arange(i + 1, len(rep))
                if low != high:
                    j = j[own[j] != own[i]]
                j = j[(v[j] @ v[i]) / (norm[j] * norm[i]) >= threshold]
                j = j[(label[j] == label[i]) & (codes[j, table] == codes[i, table])]
                if table:
                    j = j[~(codes[j, :table] == codes[i, :table]).any(1)]
                count[i] += copies[j].sum()
                count[j] += copies[i]
                for k in j.tolist():
                    union.join(i, k)
            linked = count > 0
            out.append((number[linked], rep[linked], count[linked], rep[union.roots()][linked]))
            n += int(linked.sum())
            if n > 50_000:
                yield batch(FOUND, **{f.name: np.concatenate(x) for f, x in zip(FOUND, zip(*out))})
                out, n = [], 0
        if n:
            yield batch(FOUND, **{f.name: np.concatenate(x) for f, x in zip(FOUND, zip(*out))})

    found = written(full.mapInArrow(compare, "class long, rep long, links long, root long"), "links")
    linked = found.groupBy("class").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("rep").alias("src"), F.col("root").alias("dst"))).withColumnRenamed("node", "rep")
    classes = classes.join(linked, "class", "left").join(joined, "rep", "left")
    classes = classes.select("label", "v", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("component"))
    out = good.join(classes, ["label", "v"]).select("id", (F.col("copies") - 1 + F.col("links")).alias("n_links"), F.col("component").alias("component_id"))
    alone = rows.where("not valid").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
