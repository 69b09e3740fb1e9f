"""Document graphs: edges from tables and texts, neighbours within k hops, parents and children."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import scratch

from tessera.functions.text import slug

EDGE = ["src", "dst", "relation"]


def edge_id(df: DataFrame) -> Column:
    return slug(F.concat_ws(" ", *(F.col(c) for c in EDGE)))


def edges(*parts: DataFrame) -> DataFrame:
    """Union of edges, each once."""
    every = None
    for p in parts:
        p = p.select(*EDGE)
        every = p if every is None else every.unionByName(p)
    return every.distinct()


def both_ways(df: DataFrame, back: str) -> DataFrame:
    """Edges and their inverses under another name."""
    return edges(df, df.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(back).alias("relation")))


def k_hop(df: DataFrame, seeds: DataFrame, k: int, relations: tuple[str, ...] | None = None) -> DataFrame:
    """(seed, node, hops, via_src, via_dst, via_relation): nodes within k edges in either direction, without the seed, by the fewest hops, and the
    edge that found each: of those from nodes a hop nearer, the first by outgoing before incoming, relation, and the nearer node. What a hop finds is
    written before the next, so that none is computed twice and the plan does not grow; it ends where a hop finds nothing. Edges of a node that
    many nodes reach are summed up to one for each node behind it before they are dealt."""
    if relations:
        df = df.where(F.col("relation").isin(*relations))
    edge = [F.col(c).alias(f"via_{c}") for c in ("src", "dst", "relation")]
    both = df.select(F.col("src").alias("at"), F.col("dst").alias("to"), F.lit(0).alias("way"), *edge).unionByName(df.select(F.col("dst").alias("at"), F.col("src").alias("to"), F.lit(1).alias("way"), *edge))
    both = scratch(both.where("at is not null and to is not null").distinct(), "edges")
    reached = [scratch(seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hops"), *(F.lit(None).cast("string").alias(f"via_{c}") for c in ("src", "dst", "relation"))).distinct(), "front")]
    for hop in range(1, k + 1):
        found = reached[0]
        for r in reached[1:]:
            found = found.unionByName(r)
        front = reached[-1].select("seed", F.col("node").alias("at"))
        step = front.join(both, "at").groupBy("seed", F.col("to").alias("node")).agg(F.min(F.struct("way", "via_relation", "at", "via_src", "via_dst")).alias("v"))
        new = step.join(found.select("seed", "node"), ["seed", "node"], "left_anti").select("seed", "node", F.lit(hop).alias("hops"), "v.via_src", "v.via_dst", "v.via_relation")
        reached.append(scratch(new, "front"))
        if not reached[-1].take(1):
            break
    found = reached[0]
    for r in reached[1:]:
        found = found.unionByName(r)
    return found.where("hops > 0")


def parents(df: DataFrame, relation: str = "HAS_PARENT") -> DataFrame:
    """(node, parent): the first parent by id."""
    return df.where(F.col("relation") == relation).groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("parent"))


def children(df: DataFrame, up: str = "HAS_PARENT", down: str = "HAS_CHILD") -> DataFrame:
    """(node, child) from both kinds of edges."""
    return df.where(F.col("relation") == up).select(F.col("dst").alias("node"), F.col("src").alias("child")).union(df.where(F.col("relation") == down).select(F.col("src").alias("node"), F.col("dst").alias("child"))).distinct()


def references(df: DataFrame, key: str, text: str, pattern: str, target: DataFrame, target_key: str, name: str) -> DataFrame:
    """(src, ref, dst, confidence): what a pattern finds in texts, resolved by name; unresolved ones stay, at .4. Own references go."""
    found = df.select(F.col(key).alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))).alias("ref"))
    known = target.groupBy(F.col(name).alias("ref")).agg(F.max(target_key).alias("dst"))
    out = found.join(known, "ref", "left").where("dst is null or dst <> src")
    return out.select("src", "ref", "dst", F.when(F.col("dst").isNull(), 0.4).otherwise(1.0).alias("confidence"))


def expand(seeds: DataFrame, graph: DataFrame, limits: dict[str, int], priority: dict[str, int]) -> DataFrame:
    """(query_id, node, via, prio): seeds and their neighbours by relation, at most so many of each, each node under its best priority."""
    s = seeds.select("query_id", "node", F.lit("seed").alias("via"), F.lit(0).alias("prio"))
    w = Window.partitionBy("query_id", "node", "relation").orderBy("dst")
    limit = F.coalesce(*(F.when(F.col("relation") == r, n) for r, n in limits.items()), F.lit(0))
    prio = F.coalesce(*(F.when(F.col("relation") == r, n) for r, n in priority.items()), F.lit(9))
    near = seeds.select("query_id", "node").join(graph, F.col("node") == F.col("src")).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit)
    every = s.unionByName(near.select("query_id", F.col("dst").alias("node"), F.col("relation").alias("via"), prio.alias("prio")))
    return every.groupBy("query_id", "node").agg(F.min_by("via", F.struct("prio", "via")).alias("via"), F.min("prio").alias("prio"))
