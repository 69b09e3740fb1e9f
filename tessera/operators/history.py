"""Conversation history: which turns matter, the latest ones, and blends of likeness and recency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T


def meaningful(text: Column, noise: tuple[str, ...] = ("ok", "okay", "thanks", "thank you", "hi", "hello", "yes", "no"), least_words: int = 3) -> Column:
    """Not small talk, and with a question mark, a digit, or a few words."""
    plain = F.lower(F.trim(F.regexp_replace(text, r"[.!]+$", "")))
    return ~plain.isin(*noise) & (F.contains(text, F.lit("?")) | F.regexp_like(text, F.lit(r"\d")) | (T.word_count(text) >= least_words))


def latest(df: DataFrame, conv: str, turn: str, k: int) -> DataFrame:
    w = Window.partitionBy(conv).orderBy(F.col(turn).desc())
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def hybrid(df: DataFrame, conv: str, turn: str, likeness: str, k: int = 3, alpha: float = 0.8, beta: float = 0.2, window: int = 20) -> DataFrame:
    """Of the latest turns the k with the best blend of likeness and recency ((i + 1) / n); their order is by turn."""
    recent = latest(df, conv, turn, window)
    w = Window.partitionBy(conv)
    recency = F.row_number().over(w.orderBy(turn)) / F.count(F.lit(1)).over(w)
    scored = recent.withColumn("blend", F.round((alpha * F.col(likeness) + beta * recency) / (alpha + beta), 6))
    return scored.withColumn("_r", F.row_number().over(w.orderBy(F.col("blend").desc(), F.col(turn)))).where(F.col("_r") <= k).drop("_r")


def transcript(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Role-labelled lines of a conversation, in order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.concat_ws(": ", role, text).alias("line"))))
    return df.groupBy(conv).agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("transcript"))


def needs_rewrite(text: Column, pronouns: str = r"(?i)\b(it|that|this|they|he|she|those)\b", short: int = 6) -> Column:
    """A question that leans on what was said before: it is short, or has a pronoun."""
    return (T.word_count(text) <= short) | F.regexp_like(text, F.lit(pronouns))


def rewrite_valid(original: Column, rewritten: Column, factor: int = 2, least: int = 20) -> Column:
    """A rewrite keeps all numbers and does not grow beyond max(least, factor * words)."""
    numbers = lambda c: F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0))
    return (F.size(F.array_except(numbers(original), numbers(rewritten))) == 0) & (T.word_count(rewritten) <= F.greatest(F.lit(least), factor * T.word_count(original)))
