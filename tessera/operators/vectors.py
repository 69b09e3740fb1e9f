"""Vector search and embeddings without a model.

Queries are a stated set; they go in blocks of bounded size against all rows, each task compares
its rows with a block by matrix product and keeps the best k of each query and piece of rows, and a window merges.
Vectors are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.session import scratch

PAIRS = "query_id long, vec_id long, score double"


def unit(m: np.ndarray) -> np.ndarray:
    """Rows of length one; zero rows stay."""
    n = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def blocks_of(queries: DataFrame, query_id: str, vector: str, block: int) -> Iterator[list]:
    """Queries with an id and a vector, in lists of at most ``block`` pairs on the driver."""
    some: list = []
    for r in queries.select(F.col(query_id).cast("long").alias("q"), F.col(vector).cast("array<double>").alias("v")).where("q is not null and v is not null").toLocalIterator():
        some.append((r["q"], list(r["v"])))
        if len(some) == block:
            yield some
            some = []
    if some:
        yield some


def gathered(spark, found: DataFrame) -> DataFrame:
    """What a block of queries found, as a table of the shared folder: the plan of the next block does not grow by it."""
    return scratch(found, "found")


def compare(rows: DataFrame, queries: DataFrame, row_id: str, query_id: str, vector: str, k: int | None, threshold: float | None, block: int = 4096, exclude_self: bool = True) -> DataFrame:
    """(query_id, vec_id, score): per query the best k rows by cosine, or all whose score, rounded to six places, is at or above a threshold; 0 for zero vectors. Queries of
    another length than a row are not compared with it. Queries go to the driver and out again in blocks of at most ``block`` vectors, a pass over the rows for each
    block, so that what a task holds does not grow with the queries; where there are several blocks, what each finds is written and its
    queries are given up before the next. Rows are compared where they are read, by matrix product."""
    pairs = rows.select(F.col(row_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null")
    context = rows.sparkSession.sparkContext

    def passed(shared) -> DataFrame:
        def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            asked = {}
            for width in {len(v) for _, v in shared.value}:
                mine = [(i, v) for i, v in shared.value if len(v) == width]
                asked[width] = np.array([i for i, _ in mine]), unit(np.array([v for _, v in mine], float))
            for f in frames:
                widths = f["v"].map(len)
                for width in [w for w in widths.unique() if w in asked]:
                    names, matrix = asked[width]
                    part = f[widths == width]
                    for at in range(0, len(part), 1024):
                        ids = part["id"].to_numpy()[at : at + 1024]
                        s = matrix @ unit(np.array(part["v"].iloc[at : at + 1024].tolist(), float)).T
                        if exclude_self:
                            s[names[:, None] == ids[None, :]] = -np.inf
                        keep = np.isfinite(s) if threshold is None else np.round(s, 6) >= threshold
                        if k is not None and s.shape[1] > k:
                            rank = np.argsort(np.lexsort((np.broadcast_to(ids, s.shape), -np.round(s, 6)), axis=1), axis=1)
                            keep &= rank < k
                        a, b = np.nonzero(keep)
                        yield pd.DataFrame({"query_id": names[a], "vec_id": ids[b], "score": np.round(s[a, b], 6)})

        return pairs.mapInPandas(best, PAIRS)

    parts, last = [], None
    for some in blocks_of(queries, query_id, vector, block):
        if last is not None:
            parts.append(gathered(rows.sparkSession, passed(last)))
            last.destroy()
        last = context.broadcast(some)
    found = passed(last if last is not None else context.broadcast([]))
    for p in parts:
        found = found.unionByName(p)
    if k is None:
        return found
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hash_embedding(df: DataFrame, key: str, text: str, dim: int = 64, whole_text: str | None = None) -> DataFrame:
    """(key, vector): signed hashing trick over tokens, unit length; texts without tokens are zero. Equal tokens meet in equal
    places, whatever the text. With whole_text (a prefix), each token is hashed with prefix and text, so that only equal texts are alike."""
    seen = F.col("t") if whole_text is None else F.concat(F.lit(whole_text), F.col("c"), F.col("t"))
    h = df.select(F.col(key), F.col(text).alias("c"), F.explode_outer(T.tokens(F.col(text), ())).alias("t")).select(key, F.conv(F.substring(F.md5(seen), 1, 8), 16, 10).cast("long").alias("h"))
    sums = h.groupBy(key, (F.col("h") % dim).cast("int").alias("i")).agg(F.sum(F.when(F.shiftright("h", 20) % 2 == 0, 1.0).otherwise(-1.0)).alias("s"))
    rows = sums.groupBy(key).agg(F.map_from_entries(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", "s")))).alias("m"), F.sqrt(F.sum(F.when(F.col("i").isNotNull(), F.col("s") * F.col("s")))).alias("norm"))
    unit = lambda i: F.when(F.coalesce("norm", F.lit(0.0)) == 0, 0.0).otherwise(F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.col("norm"))
    return rows.select(key, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), unit).alias("vector"))


def upsert(table: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """The latest version of each point."""
    w = Window.partitionBy(key).orderBy(F.col(version).desc())
    return table.unionByName(new).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def points(rows: DataFrame, collection: str, id_col: str, vector_col: str, model: Column | None = None) -> DataFrame:
    """Rows as points of a collection: id of collection and row id, vector (the given one, else that of a model's column), and the rest as
    payload. Rows without id or vector go; of rows of one id, the last by content stays."""
    key = F.trim(F.col(id_col).cast("string"))
    vector = F.when(F.size(vector_col) > 0, F.col(vector_col))
    vector = vector if model is None else F.coalesce(vector, F.when(F.size(model) > 0, model))
    rest = [F.col(c) for c in rows.columns if c != vector_col]
    made = rows.select(T.stable_id(F.concat(F.lit(f"{collection}:"), key)).alias("point_id"), vector.alias("vector"), F.struct(*rest).alias("payload")).where((key != "") & vector.isNotNull())
    w = Window.partitionBy("point_id").orderBy(F.xxhash64("payload", "vector"))
    return made.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def edge_points(edges: DataFrame, size: int) -> DataFrame:
    """Edges (source_id, target_id, relation_type, confidence) as points with vectors of no meaning, to be found by their payload; a
    confidence that is missing is 1. Edges without an end or a relation go; of equal ones one stays."""
    made = edges.where("source_id is not null and target_id is not null and relation_type is not null")
    name = F.concat_ws("__", "source_id", "relation_type", "target_id")
    payload = F.struct(*(F.col(c).cast("string").alias(c) for c in ("source_id", "target_id", "relation_type")), F.coalesce("confidence", F.lit(1.0)).alias("confidence"))
    return made.select(T.stable_id(name).alias("point_id"), F.array_repeat(F.lit(1e-6), size).alias("vector"), payload.alias("payload")).groupBy("point_id").agg(F.first("vector").alias("vector"), F.max("payload").alias("payload"))


#: Fields of a text to embed, by level; a chunk's own embedding text goes first.
LEVEL_FIELDS = {
    "document": ("doc_title", "doc_number", "doc_type", "issuer", "domain", "cleaned_text"),
    "article": ("title", "doc_id", "article", "article_title", "clause", "point", "content", "domain"),
    "chunk": ("doc_title", "article", "clause", "citation", "content", "domain"),
}


def level_text(df: DataFrame, level: str) -> Column:
    """The text of a row of this level that is embedded: its fields that are given, by line."""
    text = T.joined_text(*(F.trim(F.col(c).cast("string")) for c in LEVEL_FIELDS[level] if c in df.columns))
    return F.coalesce(F.nullif(F.trim("embedding_text"), F.lit("")), text) if level == "chunk" and "embedding_text" in df.columns else text
