"""Reports: counts, violations, distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts(df: DataFrame, by: list[str], share: bool = True) -> DataFrame:
    """How many rows each group has, and its share of all."""
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    # one row of totals meets each group where it is; no window over all groups
    return out.crossJoin(df.agg(F.count(F.lit(1)).alias("_all"))).select(*by, "n", F.round(F.col("n") / F.col("_all"), 6).alias("share")) if share else out


def flags(df: DataFrame, by: list[str], conditions: dict[str, Column]) -> DataFrame:
    """How many rows of each group meet each condition."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(c).alias(name) for name, c in conditions.items()))


def samples(df: DataFrame, by: list[str], order: list[Column], k: int = 3) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def top_values(df: DataFrame, value: Column, k: int) -> DataFrame:
    """The k most frequent values, ties by value."""
    return df.select(value.alias("value")).where("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "value").limit(k)


def distribution(df: DataFrame, by: list[str], measure: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(measure), 6).alias("mean"), F.round(F.stddev_pop(measure), 6).alias("sd"), F.round(F.min(measure), 6).alias("least"), F.round(F.max(measure), 6).alias("most"))


def dangling(df: DataFrame, refs: list[str], key: str) -> DataFrame:
    """(kind, key, missing): references to rows that do not exist."""
    known = df.select(F.col(key).alias("missing")).distinct()
    every = None
    for r in refs:
        part = df.where(F.col(r).isNotNull()).select(F.lit(r).alias("kind"), F.col(key), F.col(r).alias("missing")).join(known, "missing", "left_anti").select("kind", key, "missing")
        every = part if every is None else every.unionByName(part)
    return every


def expired(df: DataFrame, time: str, as_of: Column, seconds: int) -> DataFrame:
    return df.withColumn("expired", (as_of.cast("timestamp").cast("double") - F.col(time).cast("timestamp").cast("double")) > seconds)
