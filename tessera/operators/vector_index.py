"""An inverted-file index of vectors: every row belongs to the list of its nearest centroid, and a search reads the lists it probes.

Centroids are fitted by spherical k-means on a bounded sample, the ``max_sample`` vectors of lowest hash; every row is assigned where it
is read and written into the folder of its list (large lists in several files), so that a search prunes folders before it opens a file. A list's
header has its size and the smallest cosine of a member with the centroid. Searches probe the nearest lists of each query; the exact way goes
on to every list whose header leaves room for a row above the k-th score found so far: within an angle of a - r from a query, where
a is the angle of query and centroid and r that of centroid and the farthest member, there is none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.vectors import PAIRS, blocks_of, gathered, unit

#: Names the tables' form and default settings; changes with them, so that an index of another form is not read.
FORMAT = "lists2-20000-97"
#: The list of vectors that no centroid fits: of another length, zero, or with a component that is no finite number.
ODD = -1


def sample(rows: DataFrame, row_id: str, vector: str, max_sample: int) -> np.ndarray:
    """Unit vectors of the rows of lowest hash, of the most frequent length among them; at most max_sample of them."""
    some = rows.where(F.col(row_id).isNotNull() & F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"), F.xxhash64(row_id).alias("h"), row_id)
    found = [np.array(r["v"], float) for r in some.orderBy("h", row_id).limit(max_sample).select("v").collect() if None not in r["v"]]
    found = [v for v in found if len(v) and np.isfinite(v).all() and v.any()]
    if not found:
        return np.zeros((0, 0))
    widths, counts = np.unique([len(v) for v in found], return_counts=True)
    return unit(np.array([v for v in found if len(v) == widths[counts.argmax()]]))


def fit(points: np.ndarray, lists: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Unit centroids by spherical k-means; the first ones are drawn far from those before them."""
    rng = np.random.default_rng(seed)
    lists = min(lists, len(points))
    chosen = [int(rng.integers(len(points)))]
    far = 1 - points @ points[chosen[0]]
    for _ in range(lists - 1):
        weight = np.maximum(far, 0)
        chosen.append(int(rng.choice(len(points), p=weight / weight.sum())) if weight.sum() > 0 else int(rng.integers(len(points))))
        far = np.minimum(far, 1 - points @ points[chosen[-1]])
    centroids = points[chosen]
    for _ in range(rounds):
        own = np.concatenate([(points[i : i + 4096] @ centroids.T).argmax(1) for i in range(0, len(points), 4096)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, points)
        norm = np.sqrt((sums * sums).sum(1, keepdims=True))
        moved = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centroids)
        if np.allclose(moved, centroids):
            break
        centroids = moved
    return centroids


def probes_for(points: np.ndarray, centroids: np.ndarray, recall: float, k: int = 10, asked: int = 256) -> int:
    """How many of a vector's nearest lists hold that share of its k nearest neighbours, by some vectors of the sample. Neighbours within a
    sample are farther than those among all rows, so that a search finds rather more."""
    if len(points) < 2:
        return 1
    own = (points @ centroids.T).argmax(1)
    some = points[:asked]
    s = some @ points.T
    s[np.arange(len(some)), np.arange(len(some))] = -np.inf
    near = np.argsort(-s, axis=1)[:, : min(k, len(points) - 1)]
    place = np.argsort(np.argsort(-(some @ centroids.T), axis=1), axis=1)
    return int(np.ceil(np.quantile(np.take_along_axis(place, own[near], 1) + 1, recall)))


def write(rows: DataFrame, row_id: str, vector: str, path: str, lists: int | None = None, max_sample: int = 20_000, recall: float = 0.97) -> None:
    """Writes the index: path/vectors (id, v, near; a folder for each list) and path/lists (list, n, nearest, centroid, probes). ``lists`` is
    the square root of the number of rows by default, 4,096 at most; probes is what a search needs for the recall, measured on the sample. Rows
    without id or vector are left out."""
    spark = rows.sparkSession
    given = rows.where(F.col(row_id).isNotNull() & F.col(vector).isNotNull())
    lists = lists or int(min(4096, max(1, round(given.count() ** 0.5))))
    points = sample(rows, row_id, vector, max_sample)
    centroids = fit(points, lists) if len(points) else points
    shared = spark.sparkContext.broadcast(centroids)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        for f in frames:
            own, near = np.full(len(f), ODD), np.zeros(len(f))
            fits = np.array([len(c) > 0 and len(v) == c.shape[1] and bool(np.isfinite(v).all()) and bool(np.any(v)) for v in (np.array(v, float) for v in f["v"])], bool)
            if fits.any():
                cos = unit(np.array(f["v"][fits].tolist(), float)) @ c.T
                own[fits], near[fits] = cos.argmax(1), cos.max(1)
            yield pd.DataFrame({"id": f["id"], "v": f["v"], "near": near, "list": own})

    placed = given.select(F.col(row_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).mapInPandas(assign, "id long, v array<double>, near double, list int")
    placed.hint("rebalance", "list").write.partitionBy("list").mode("overwrite").parquet(f"{path}/vectors")
    heads = read_vectors(spark, path).groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.min("near").alias("nearest"))
    middles = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centroids)], "list int, centroid array<double>")
    heads = heads.withColumn("probes", F.lit(probes_for(points, centroids, recall) if len(points) else 1))
    heads.join(middles, "list", "left").coalesce(1).write.mode("overwrite").parquet(f"{path}/lists")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id long, v array<double>, near double, list int").parquet(f"{path}/vectors")


def search(spark: SparkSession, path: str, queries: DataFrame, query_id: str, vector: str, k: int = 10, probes: int | None = None, exact: bool = False, block: int = 4096, exclude_self: bool = True) -> DataFrame:
    """(query_id, vec_id, score, rank): the best k rows by cosine among the ``probes`` nearest lists of each query (as many as the index says, by default), ties by smallest id; with
    ``exact``, among all rows. Queries of another length than the centroids meet the list of odd vectors alone."""
    heads = spark.read.parquet(f"{path}/lists").orderBy("list").collect()  # 4,096 lists and the odd one at most
    known = [h for h in heads if h["list"] != ODD]
    probes = probes or (heads[0]["probes"] if heads else 1)
    numbers = np.array([h["list"] for h in known], int)
    centroids = np.array([h["centroid"] for h in known]) if known else np.zeros((0, 0))
    angle = np.arccos(np.clip(np.array([h["nearest"] for h in known], float), -1, 1))
    odd = any(h["list"] == ODD for h in heads)
    parts = []
    for some in blocks_of(queries, query_id, vector, block):
        names = np.array([i for i, _ in some])
        width = centroids.shape[1] if len(centroids) else -1
        cos = np.array([unit(np.array(v, float)[None, :])[0] @ centroids.T if len(v) == width else np.full(len(numbers), -np.inf) for _, v in some]).reshape(len(some), len(numbers))
        order = np.argsort(-cos, axis=1, kind="stable")[:, :probes]
        first = {int(numbers[j]): np.flatnonzero((order == j).any(1) & (cos[:, j] > -np.inf)) for j in np.unique(order).tolist()}
        if odd:
            first[ODD] = np.arange(len(some))
        found = _probe(spark, path, some, names, first, k, exclude_self)
        if exact and len(numbers):
            kth = found.groupBy("query_id").agg(F.array_sort(F.collect_list(-F.col("score"))).alias("s")).where(F.size("s") >= k).select("query_id", (-F.get("s", F.lit(k - 1))).alias("kth"))
            least = {r["query_id"]: r["kth"] for r in kth.collect()}  # one number for each query of the block
            bound = np.array([least.get(i, -np.inf) for i in names.tolist()])
            room = np.cos(np.maximum(0, np.arccos(np.clip(cos, -1, 1)) - angle[None, :])) + 1e-6 >= bound[:, None]
            room &= cos > -np.inf
            np.put_along_axis(room, order, False, 1)
            more = {int(numbers[j]): np.flatnonzero(room[:, j]) for j in np.flatnonzero(room.any(0)).tolist()}
            if more:
                found = found.unionByName(_probe(spark, path, some, names, more, k, exclude_self))
        parts.append(found)
    if not parts:
        return spark.createDataFrame([], f"{PAIRS}, rank int")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _probe(spark: SparkSession, path: str, some: list, names: np.ndarray, wanted: dict[int, np.ndarray], k: int, exclude_self: bool) -> DataFrame:
    """Each query's best k rows of each piece of the lists that it probes."""
    shared = spark.sparkContext.broadcast((names, [np.array(v, float) for _, v in some], wanted))

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, vectors, wanted = shared.value
        for f in frames:
            for number, rows in f.groupby("list"):
                for width, part in rows.groupby(rows["v"].map(len)):
                    asked = np.array([q for q in wanted[int(number)].tolist() if len(vectors[q]) == width], int)
                    if not len(asked):
                        continue
                    matrix = unit(np.array([vectors[q] for q in asked.tolist()]).reshape(len(asked), width))
                    for at in range(0, len(part), 1024):
                        ids = part["id"].to_numpy()[at : at + 1024]
                        s = np.round(matrix @ unit(np.array(part["v"].iloc[at : at + 1024].tolist(), float).reshape(len(ids), width)).T, 6)
                        if exclude_self:
                            s[names[asked][:, None] == ids[None, :]] = -np.inf
                        keep = np.isfinite(s)
                        if s.shape[1] > k:
                            rank = np.argsort(np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1), axis=1)
                            keep &= rank < k
                        a, b = np.nonzero(keep)
                        yield pd.DataFrame({"query_id": names[asked][a], "vec_id": ids[b], "score": s[a, b]})

    lists = sorted(wanted)
    rows = read_vectors(spark, path).where(F.col("list").isin(lists)) if lists else read_vectors(spark, path).where("false")
    found = gathered(spark, rows.select("id", "v", "list").mapInPandas(best, PAIRS))
    shared.destroy()
    return found
