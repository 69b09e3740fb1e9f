"""Fusing and re-ranking candidate lists keyed by (query_id, doc_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scores import minmax

KEY = ["query_id", "doc_id"]
RRF_K = 60
#: Weights of the linear fusion.
LINEAR = {"dense": 0.35, "bm25": 0.25, "exact": 0.20, "title": 0.08, "lexical": 0.08, "domain": 0.06, "citation": 0.03}


def ranked(df: DataFrame, score: str = "score", name: str = "rank", start: int = 1) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col(score).desc(), F.col("doc_id"))
    return df.withColumn(name, F.row_number().over(w) + (start - 1))


def rrf(lists: list[DataFrame], k: int = RRF_K, start: int = 1) -> DataFrame:
    """(query_id, doc_id, score): sum over lists of 1 / (k + rank)."""
    every = None
    for f in lists:
        part = ranked(f.select(*KEY, "score"), start=start).select(*KEY, (1 / (k + F.col("rank"))).alias("part"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy(*KEY).agg(F.round(F.sum("part"), 6).alias("score"))


def weighted(dense: DataFrame, sparse: DataFrame, alpha: float) -> DataFrame:
    """alpha * dense + (1 - alpha) * sparse, each scaled to 0..1 by query; a missing score is 0."""
    scaled = lambda f, name: f.select(*KEY, minmax(F.col("score"), ["query_id"]).alias(name))
    both = scaled(dense, "d").join(scaled(sparse, "s"), KEY, "full_outer")
    return both.select(*KEY, F.round(alpha * F.coalesce("d", F.lit(0.0)) + (1 - alpha) * F.coalesce("s", F.lit(0.0)), 6).alias("score"))


def adaptive(dense: DataFrame, sparse: DataFrame, policy: DataFrame, k: int = RRF_K) -> DataFrame:
    """(query_id, doc_id, score, rank) by each query's own policy (query_id, alpha, top_k, candidate_k, fusion_type): of both lists the first
    candidate_k count; they are fused by their scores (weighted: alpha and 1 - alpha, a missing score is 0) or else by reciprocal ranks; the first
    top_k stay. Scores are taken as they come; queries without a policy have no rows."""
    first = lambda f, name: ranked(f.select(*KEY, "score")).join(policy, "query_id").where(F.col("rank") <= F.col("candidate_k")).select(*KEY, "alpha", "top_k", "fusion_type", F.lit(name).alias("side"), "score", "rank")
    every = first(dense, "dense").unionByName(first(sparse, "sparse"))
    value = F.when(F.col("fusion_type") == "weighted", F.when(F.col("side") == "dense", F.col("alpha")).otherwise(1 - F.col("alpha")) * F.col("score")).otherwise(1 / (k + F.col("rank")))
    fused = every.groupBy(*KEY, "top_k").agg(F.round(F.sum(value), 6).alias("score"))
    return ranked(fused).where(F.col("rank") <= F.col("top_k")).drop("top_k")


def linear(signals: DataFrame, weights: dict[str, float] = LINEAR, sources: Column | None = None, wrong_domain: Column | None = None, k: int | None = None, trusted: Column | None = None) -> DataFrame:
    """Weighted sum of the signal columns, a bonus of .05 for a trusted source, one for several sources where wanted, .2 less for a wrong domain, not below 0,
    scaled over each query's candidates; without candidates without rows."""
    total = sum((w * F.coalesce(F.col(c), F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))
    if sources is not None:
        total = total + F.when(sources > 1, 0.05).otherwise(0.0)
    if trusted is not None:
        total = total + F.when(trusted, 0.05).otherwise(0.0)
    if wrong_domain is not None:
        total = total - F.when(wrong_domain, 0.2).otherwise(0.0)
    out = signals.withColumn("raw", F.greatest(total, F.lit(0.0)))
    out = out.withColumn("score", F.round(minmax(F.col("raw"), ["query_id"]), 6)).drop("raw")
    return out if k is None else ranked(out).where(F.col("rank") <= k)


def merge(lists: dict[str, DataFrame]) -> DataFrame:
    """Full outer merge of the lists: the largest score of each source, how many sources, and the method."""
    every = None
    for name, f in lists.items():
        part = f.select(*KEY, F.lit(name).alias("source"), "score")
        every = part if every is None else every.unionByName(part)
    scores = [F.max(F.when(F.col("source") == n, F.col("score"))).alias(n) for n in lists]
    out = every.groupBy(*KEY).agg(*scores, F.countDistinct("source").cast("int").alias("n_sources"), F.min("source").alias("_one"))
    return out.withColumn("method", F.when(F.col("n_sources") > 1, "hybrid").otherwise(F.col("_one"))).drop("_one")


def consensus(df: DataFrame, k: int, sources: int = 3) -> DataFrame:
    """The best k of each query by .6 * score + .4 * share of sources."""
    scored = df.withColumn("consensus", F.round(0.6 * F.col("score") + 0.4 * F.col("n_sources") / sources, 6))
    return ranked(scored, "consensus").where(F.col("rank") <= k)


def rerank(df: DataFrame, model_score: str, alpha: float, normalise: str = "minmax") -> DataFrame:
    """Blends a supplied model score with the retrieval score and says how ranks move. A billionth is added before rounding, so that halves go up."""
    m = F.col(model_score)
    scaled = minmax(m, ["query_id"], equal=0.5) if normalise == "minmax" else 1 / (1 + F.exp(-m)) if normalise == "sigmoid" else m
    out = ranked(df, "score", "retrieval_rank").withColumn("final", F.round(alpha * F.col("score") + (1 - alpha) * scaled + 1e-9, 6))
    return ranked(out, "final", "rerank_rank").withColumn("rank_delta", F.col("retrieval_rank") - F.col("rerank_rank"))


def heuristic(df: DataFrame, weights: dict[str, float], minima: dict[str, float], penalty: Column | None = None) -> DataFrame:
    """Weighted signals; a row goes only if it is below all minima, and each query keeps its best row."""
    total = sum((w * F.coalesce(F.col(c), F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))
    if penalty is not None:
        total = total + penalty
    out = ranked(df.withColumn("final", F.round(F.greatest(total, F.lit(0.0)), 6)), "final")
    low = F.lit(True)
    for c, least in minima.items():
        low = low & (F.coalesce(F.col(c), F.lit(0.0)) < least)
    return out.where(~low | (F.col("rank") == 1))


def confidence(df: DataFrame, text: str = "text") -> DataFrame:
    """Per query: count, share of distinct documents and of texts, duplicates, best score and the gap to the next, and a
    value of .25 count .25 distinct .15 not empty .10 ids .10 no duplicates .075 top .075 gap."""
    r = ranked(df)
    agg = r.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_distinct"), F.count_if(F.coalesce(F.length(text), F.lit(0)) > 0).alias("n_text"),
        F.countDistinct(text).alias("n_texts"), F.max("score").alias("top"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"),
    )
    gap = F.coalesce(F.col("top") - F.col("second"), F.col("top"))
    value = 0.25 * F.least(F.col("n") / 5, F.lit(1.0)) + 0.25 * F.col("n_distinct") / F.col("n") + 0.15 * F.col("n_text") / F.col("n") + 0.10 * F.col("n_distinct") / F.col("n") + 0.10 * F.col("n_texts") / F.col("n") + 0.075 * F.least(F.col("top"), F.lit(1.0)) + 0.075 * F.least(gap, F.lit(1.0))
    return agg.select("query_id", "n", "n_distinct", "n_texts", F.round("top", 6).alias("top"), F.round(gap, 6).alias("gap"), F.round(value, 6).alias("confidence"))


def confident(df: DataFrame, least: float = 0.55, least_gap: float = 0.03, least_n: int = 2) -> DataFrame:
    """Reasons against a result, and confident where the value suffices and there is none."""
    reasons = F.filter(F.array(F.when(F.col("n") < least_n, "few_results"), F.when(F.col("gap") < least_gap, "small_gap"), F.when(F.col("top") < least, "low_top_score"), F.when(F.col("n_texts") < F.col("n"), "duplicate_texts")), lambda r: r.isNotNull())
    return df.withColumn("reasons", F.array_join(reasons, ",")).withColumn("confident", (F.col("confidence") >= least) & (F.size(reasons) == 0))


def temporal(doc_year: Column, asked_years: Column, this_year: Column) -> Column:
    """A document's bonus for its year: near a year that the question names, else for being recent; 0 without a year."""
    near = F.array_min(F.transform(asked_years, lambda y: F.abs(doc_year - y)))
    age = this_year - doc_year
    named = F.when(near == 0, 0.10).when(near == 1, 0.05).when(near <= 3, 0.02).otherwise(0.0)
    recent = F.when(age <= 2, 0.08).when(age <= 5, 0.04).when(age <= 10, 0.02).otherwise(0.0)
    return F.coalesce(F.when(F.size(asked_years) > 0, named).otherwise(recent), F.lit(0.0))


#: What each signal adds to a scaled reciprocal rank sum.
RRF_BONUS = {"lexical": 0.08, "domain": 0.04, "citation": 0.05, "trusted": 0.05, "temporal": 1.2, "wrong_domain": -0.3}


def rrf_with_bonuses(lists: dict[str, DataFrame], signals: DataFrame, k: int = RRF_K, most: int | None = None, bonus: dict[str, float] = RRF_BONUS) -> DataFrame:
    """(query_id, doc_id, rrf_sum, n_sources, final): reciprocal ranks from 0 summed over the lists and scaled over each query's candidates, plus
    weighted signals (columns of the bonus table, missing ones 0), not below 0."""
    every = None
    for name, f in lists.items():
        part = ranked(f.select(*KEY, "score"), start=0).select(*KEY, F.lit(name).alias("source"), (1 / (k + F.col("rank"))).alias("part"))
        every = part if every is None else every.unionByName(part)
    sums = every.groupBy(*KEY).agg(F.round(F.sum("part"), 6).alias("rrf_sum"), F.countDistinct("source").cast("int").alias("n_sources"))
    w = Window.partitionBy("query_id")
    low, high = F.min("rrf_sum").over(w), F.max("rrf_sum").over(w)
    scaled = (F.col("rrf_sum") - low) / F.greatest(F.lit(1e-8), high - low)
    both = sums.join(signals, KEY, "left")
    add = sum((x * F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c, x in bonus.items() if c in signals.columns), F.lit(0.0))
    out = both.withColumn("final", F.round(F.greatest(F.lit(0.0), scaled + add) + 1e-9, 6)).select(*KEY, "rrf_sum", "n_sources", "final")
    return out if most is None else ranked(out, "final").where(F.col("rank") <= most)


#: How many candidates the heuristic stage passes on, by difficulty.
CASCADE = {"easy": 10, "mid": 25, "hard": 60, "very_hard": 120}


def cascade(df: DataFrame, heuristic_score: Column, model_score: str | None, difficulty: Column, most: int, passed: dict[str, int] = CASCADE, sources: int = 3) -> DataFrame:
    """Two stages: the score of consensus takes part in the heuristic one (column consensus of heuristic_score), whose best candidates, as many as the
    difficulty says, are put in the order of a supplied model score; without one the heuristic order stays."""
    c = df.withColumn("consensus", F.round(0.6 * F.col("score") + 0.4 * F.col("n_sources") / sources + 1e-9, 6))
    limit = F.coalesce(*(F.when(difficulty == d, F.lit(n)) for d, n in passed.items()), F.lit(passed["mid"]))
    first = ranked(c.withColumn("heuristic", F.round(heuristic_score + 1e-9, 6)), "heuristic", "heuristic_rank").where(F.col("heuristic_rank") <= limit)
    out = ranked(first, model_score or "heuristic", "final_rank")
    return out.where(F.col("final_rank") <= most)


#: Factors by a candidate's domain group for questions of the protected domain, and for titles that speak of another one.
DOMAIN_FACTORS = {
    "conservative": ({"same": 1.15, "wrong": 0.50, "trade": 0.90, "customs": 0.90}, 0.50),
    "aggressive": ({"same": 1.35, "wrong": 0.25, "trade": 0.90, "customs": 0.80, "enterprise": 1.15}, 0.10),
}


def domain_adjusted(score: Column, group: Column, foreign_title: Column, applies: Column, mode: str = "conservative") -> Column:
    """A score times its domain group's factor, times one more for wrong domains whose title is foreign; unchanged where it does not apply."""
    factors, title = DOMAIN_FACTORS[mode]
    factor = F.coalesce(*(F.when(group == g, F.lit(x)) for g, x in factors.items()), F.lit(1.0)) * F.when((group == "wrong") & foreign_title, title).otherwise(1.0)
    return F.when(applies, F.round(score * factor + 1e-9, 6)).otherwise(score)


def effective_score(*columns: Column) -> Column:
    """The first score that is given, else 0."""
    return F.coalesce(*columns, F.lit(0.0))


def best_score(*columns: Column) -> Column:
    """The largest score that is given, else 0."""
    return F.coalesce(F.greatest(*columns), F.lit(0.0))
