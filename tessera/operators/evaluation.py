"""Evaluation: retrieval metrics, precision and recall, answer checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.scores import f_beta

EMPTY = "cast(array() as array<{}>)"


def precision_recall(predicted: Column, gold: Column, beta: float = 2.0) -> list[Column]:
    """precision, recall, f and counts of two sets."""
    p, g = F.array_distinct(predicted), F.array_distinct(gold)
    hit = F.size(F.array_intersect(p, g))
    precision = F.when(F.size(p) == 0, 0.0).otherwise(hit / F.size(p))
    recall = F.when(F.size(g) == 0, 0.0).otherwise(hit / F.size(g))
    return [F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(f_beta(precision, recall, beta), 6).alias("f"), hit.alias("tp"), (F.size(p) - hit).alias("fp"), (F.size(g) - hit).alias("fn")]


def evaluate(gold: DataFrame, predicted: DataFrame, key: str, items: str) -> DataFrame:
    """Per gold row precision, recall and F2; a missing prediction is the empty set."""
    g, p = gold.select(key, F.col(items).alias("gold")), predicted.select(key, F.col(items).alias("predicted"))
    kind = predicted.schema[items].dataType.elementType.simpleString()
    return g.join(p, key, "left").select(key, *precision_recall(F.coalesce("predicted", F.expr(EMPTY.format(kind))), F.coalesce("gold", F.expr(EMPTY.format(kind)))))


def ranking(df: DataFrame, ranked: str = "ranked", gold: str = "gold") -> list[Column]:
    """hit, recall and reciprocal rank of an ordered list against a set; all 0 where the set is empty."""
    place = F.array_min(F.transform(F.array_distinct(gold), lambda g: F.nullif(F.array_position(F.col(ranked), g), F.lit(0))))
    found = F.size(F.array_intersect(ranked, gold))
    return [F.when(F.arrays_overlap(ranked, gold), 1).otherwise(0).alias("hit"), F.round(F.when(F.size(gold) == 0, 0.0).otherwise(found / F.size(F.array_distinct(gold))), 6).alias("recall"), F.round(F.coalesce(1 / place, F.lit(0.0)), 6).alias("mrr")]


def faithfulness(df: DataFrame, key: str, answer: str, context: str, share: float = 0.3, least_letters: int = 4) -> DataFrame:
    """Share of an answer's sentences that their context supports: as many of its words of so many letters as max(1, share of them)."""
    ctx = F.array_distinct(T.tokens(F.col(context), (), least_letters))
    s = df.select(key, ctx.alias("ctx"), F.explode(T.sentences(F.col(answer))).alias("s")).withColumn("w", T.tokens(F.col("s"), (), least_letters))
    good = (F.size("w") > 0) & (F.size(F.filter("w", lambda x: F.array_contains("ctx", x))) >= F.greatest(F.lit(1.0), share * F.size("w")))
    return s.groupBy(key).agg(F.count(F.lit(1)).alias("sentences"), F.count_if(good).alias("supported")).withColumn("faithfulness", F.round(F.col("supported") / F.col("sentences"), 6))


def completeness(question: Column, answer: Column, least_words: int = 30) -> Column:
    """.4 for the question's words that the answer has, .3 for length, .3 for more than one sentence."""
    covered = T.overlap(T.tokens(question), T.tokens(answer))
    return F.round(0.4 * covered + 0.3 * F.least(F.lit(1.0), T.word_count(answer) / least_words) + 0.3 * F.when(F.size(T.sentences(answer)) > 1, 1.0).otherwise(0.0), 6)


def clarity(answer: Column, long: int = 25) -> Column:
    """.4 for short sentences, .3 for line structure, .3 for few repeated words."""
    s = T.sentences(answer)
    mean = F.when(F.size(s) == 0, 0.0).otherwise(T.word_count(answer) / F.size(s))
    return F.round(0.4 * F.when(mean <= long, 1.0).otherwise(long / mean) + 0.3 * F.when(F.contains(answer, F.lit("\n")), 1.0).otherwise(0.0) + 0.3 * T.density(T.tokens(answer, (), 1)), 6)


def grounding(mentioned: Column, allowed: Column) -> list[Column]:
    """What an answer mentions that its contexts lack, and whether it is grounded."""
    stray = F.array_sort(F.array_except(mentioned, allowed))
    return [F.array_join(stray, ",").alias("unsupported"), (F.size(stray) == 0).alias("grounded")]


def macro(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*(F.round(F.avg(c), 6).alias(c) for c in columns), F.count(F.lit(1)).alias("n"))


def submission_errors(df: DataFrame, key: str, pattern: str, text: str) -> DataFrame:
    """(key, error) for ids that repeat, ids of another form, and empty texts."""
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(F.length(F.trim(F.coalesce(text, F.lit(""))))).alias("short"))
    problems = F.filter(F.array(F.when(F.col("n") > 1, "duplicate_id"), F.when(~F.regexp_like(F.col(key).cast("string"), F.lit(pattern)), "bad_id"), F.when(F.col("short") == 0, "empty_text")), lambda x: x.isNotNull())
    return n.select(key, F.explode(problems).alias("error"))
