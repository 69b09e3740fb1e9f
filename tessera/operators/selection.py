"""Choosing contexts from ranked candidates: thresholds, budgets, greedy folds.

Folds run over the ordered candidates of one query inside the row (a short list by then), because what is
taken depends on what was taken before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dynamic_threshold(df: DataFrame, least: float = 0.55) -> DataFrame:
    """Rows at or above their query's threshold: .75 or top - sd/2 if the top is at least .9; .65 or mean + .3 sd if at least .8; else the mean or least."""
    w = Window.partitionBy("query_id")
    top, mean, sd = F.max("score").over(w), F.avg("score").over(w), F.stddev_pop("score").over(w)
    limit = F.when(top >= 0.9, F.greatest(F.lit(0.75), top - 0.5 * sd)).when(top >= 0.8, F.greatest(F.lit(0.65), mean + 0.3 * sd)).otherwise(F.greatest(F.lit(least), mean))
    return df.withColumn("threshold", F.round(limit, 6)).where(F.col("score") >= F.col("threshold"))


def token_budget(df: DataFrame, budget: int, cost: str = "cost") -> DataFrame:
    """Candidates in rank order while they fit: one that would exceed the budget is skipped and the next one tried."""
    row = F.struct("rank", "doc_id", F.col(cost).cast("long").alias("cost"))
    lists = df.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    empty = F.struct(F.lit(0).cast("long").alias("used"), F.expr("cast(array() as array<struct<rank: int, doc_id: bigint, cost: bigint>>)").alias("taken"))
    step = lambda s, r: F.when(s["used"] + r["cost"] <= budget, F.struct((s["used"] + r["cost"]).alias("used"), F.concat(s["taken"], F.array(r)).alias("taken"))).otherwise(s)
    typed = F.transform("rows", lambda r: F.struct(r["rank"].cast("int").alias("rank"), r["doc_id"].cast("long").alias("doc_id"), r["cost"].alias("cost")))
    return lists.select("query_id", F.explode(F.aggregate(typed, empty, step)["taken"]).alias("r")).select("query_id", "r.doc_id", "r.rank", "r.cost")


def relative(df: DataFrame, share: float, least: int, most: int) -> DataFrame:
    """Rows of at least a share of their query's best score, but at least ``least`` and at most ``most``."""
    w = Window.partitionBy("query_id")
    return df.withColumn("_top", F.max("score").over(w)).where(((F.col("score") >= share * F.col("_top")) | (F.col("rank") <= least)) & (F.col("rank") <= most)).drop("_top")


def dynamic_contexts(df: DataFrame, absolute: float = 0.45, share: float = 0.75, max_docs: int = 2, max_articles: int = 3, max_contexts: int = 8) -> DataFrame:
    """Greedy choice over (rank, level, doc, article, score): at or above either threshold; a document once and within the
    document budget; an article once and within the article budget; chunks only of documents within the budget."""
    w = Window.partitionBy("query_id")
    ok = df.withColumn("_top", F.max("score").over(w)).where((F.col("score") >= absolute) | (F.col("score") >= share * F.col("_top")))
    kind = "array<struct<rank: int, level: string, doc: string, article: string>>"
    lists = ok.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.col("rank").cast("int").alias("rank"), F.col("level").cast("string").alias("level"), F.col("doc").cast("string").alias("doc"), F.coalesce(F.col("article").cast("string"), F.lit("")).alias("article")))).alias("rows"))

    def step(taken: Column, r: Column) -> Column:
        docs = F.array_distinct(F.transform(F.filter(taken, lambda t: t["level"] != "chunk"), lambda t: t["doc"]))
        articles = F.filter(taken, lambda t: t["level"] == "article")
        known = F.array_contains(docs, r["doc"])
        room = known | (F.size(docs) < max_docs)
        once_doc = ~F.exists(taken, lambda t: (t["level"] == "document") & (t["doc"] == r["doc"]))
        once_article = ~F.exists(articles, lambda t: (t["doc"] == r["doc"]) & (t["article"] == r["article"]))
        good = F.when(r["level"] == "document", room & once_doc).when(r["level"] == "article", room & once_article & (F.size(articles) < max_articles)).otherwise(room)
        return F.when((F.size(taken) < max_contexts) & good, F.concat(taken, F.array(r))).otherwise(taken)

    chosen = lists.select("query_id", F.explode(F.aggregate("rows", F.expr(f"cast(array() as {kind})"), step)).alias("r"))
    return chosen.select("query_id", "r.rank", "r.level", "r.doc", F.nullif(F.col("r.article"), F.lit("")).alias("article"))


def citations(df: DataFrame, strict: float = 0.5) -> DataFrame:
    """Rows at the strict threshold; of queries without any, those at a relaxed one that carry a signal."""
    w = Window.partitionBy("query_id")
    best, any_strict = F.max("score").over(w), F.bool_or(F.col("score") >= strict).over(w)
    relaxed = F.least(F.lit(strict), F.greatest(F.lit(0.08), 0.7 * best))
    return df.withColumn("_keep", F.when(any_strict, F.col("score") >= strict).otherwise((F.col("score") >= relaxed) & F.col("signal"))).where("_keep").drop("_keep")


def evidence_boost(df: DataFrame, by: list[str], least: int = 3, factor: float = 1.2) -> DataFrame:
    """Scores of groups with several candidates grow, up to 1."""
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id", *by))
    return df.withColumn("boosted", F.round(F.when(n >= least, F.least(F.lit(1.0), F.col("score") * factor)).otherwise(F.col("score")), 6))
