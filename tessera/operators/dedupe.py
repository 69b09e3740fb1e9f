"""De-duplication and changes between versions: which row of a key stays is always explicit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_by(df: DataFrame, keys: list[str | Column], order: list[Column]) -> DataFrame:
    """The first row of each key in an order, which must not leave ties."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def first_wins(df: DataFrame, keys: list[str], position: list[str], drop_null: bool = False) -> DataFrame:
    """The first row of each key by position; rows of null keys all stay, or go."""
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    kept = keep_by(df.where(~null), keys, [F.col(p).asc() for p in position])
    return kept if drop_null else kept.unionByName(df.where(null))


def last_wins(df: DataFrame, keys: list[str], position: list[str]) -> DataFrame:
    return keep_by(df, keys, [F.col(p).desc() for p in position])


def best_wins(df: DataFrame, keys: list[str], score: str, ties: list[str]) -> DataFrame:
    return keep_by(df, keys, [F.col(score).desc_nulls_last(), *(F.col(t).asc() for t in ties)])


def union_first(frames: list[DataFrame], keys: list[str], position: list[str]) -> DataFrame:
    """Rows of several sources; of a key the first row of the first source that has it."""
    every = None
    for k, f in enumerate(frames):
        f = f.withColumn("_source", F.lit(k))
        every = f if every is None else every.unionByName(f, allowMissingColumns=True)
    return first_wins(every, keys, ["_source", *position]).drop("_source")


def merge_sources(df: DataFrame, keys: list[str], score: str, source: str, ties: list[str]) -> DataFrame:
    """The best row of each key, with the sources of all its rows sorted."""
    sources = df.groupBy(*keys).agg(F.array_sort(F.collect_set(source)).alias("sources"))
    return best_wins(df, keys, score, ties).join(sources, keys)


def not_in(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key has not been processed yet."""
    return df.join(done.select(*keys).distinct(), keys, "left_anti")


def difference(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """(key, change): added, changed, removed or same, by content."""
    o, n = old.select(F.col(key), F.col(content).alias("_old"), F.lit(1).alias("_o")), new.select(F.col(key), F.col(content).alias("_new"), F.lit(1).alias("_n"))
    kind = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_old").eqNullSafe(F.col("_new")), "same").otherwise("changed")
    return o.join(n, key, "full_outer").select(key, kind.alias("change"))


def upsert(old: DataFrame, new: DataFrame, removed: DataFrame | None, key: str) -> DataFrame:
    """Old rows without removed and updated ones, and the new rows."""
    kept = old.join(new.select(key), key, "left_anti")
    if removed is not None:
        kept = kept.join(removed.select(key), key, "left_anti")
    return kept.unionByName(new)


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int | Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)
