"""Smaller operators over documents, references and candidates: fixes, boosts, scores, limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T


def replaced(c: Column, rules: list[tuple[str, str]], delete: str | None = None) -> Column:
    """Ordered regex replacements; null where the result matches ``delete``."""
    for pattern, to in rules:
        c = F.regexp_replace(c, pattern, to)
    c = F.trim(c)
    return c if delete is None else F.when(~F.regexp_like(c, F.lit(delete)), c)


def allowed(domain: Column, names: list[str]) -> Column:
    """An allowed name holds the domain or the other way round; without names or domain all pass."""
    if not names:
        return F.lit(True)
    hit = F.exists(F.array(*map(F.lit, names)), lambda n: F.contains(domain, n) | F.contains(n, domain))
    return F.coalesce(domain, F.lit("")).eqNullSafe("") | hit


def clean_refs(refs: Column, pattern: str) -> Column:
    """References of the right form, in order, each once."""
    return F.array_distinct(F.filter(refs, lambda r: F.regexp_like(r, F.lit(pattern))))


def join_first(left: DataFrame, right: DataFrame, keys: list[Column], right_key: str, value: str, name: str) -> DataFrame:
    """value of the first of several keys that the right side has."""
    out = left
    for k, key in enumerate(keys):
        side = right.select(F.col(right_key).alias(f"_k{k}"), F.col(value).alias(f"_v{k}")).dropDuplicates([f"_k{k}"])
        out = out.withColumn(f"_w{k}", key).join(side, F.col(f"_w{k}") == F.col(f"_k{k}"), "left")
    return out.select(*left.columns, F.coalesce(*(F.col(f"_v{k}") for k in range(len(keys)))).alias(name))


def first_contained(c: Column, aliases: list[tuple[str, str]], default: str | None = None) -> Column:
    """The name of the first alias that a text holds."""
    return F.coalesce(*(F.when(F.contains(c, F.lit(alias)), name) for alias, name in aliases), F.lit(default))


def group_evidence(df: DataFrame, by: list[str], id_col: str = "doc_id", score: str = "score", k: int = 2) -> DataFrame:
    """Per query and group the best score, how many candidates, and the k best ids."""
    rows = F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(id_col).alias("i"))))
    return df.groupBy("query_id", *by).agg(F.max(score).alias("score"), F.count(F.lit(1)).alias("n"), F.array_join(F.slice(F.transform(rows, lambda r: r["i"].cast("string")), 1, k), ",").alias("evidence"))


def boost(score: Column, rules: list[tuple[Column, float]]) -> Column:
    """The first rule that holds adds its amount; the sum stays within 0..1."""
    add = F.coalesce(*(F.when(c, F.lit(x)) for c, x in rules), F.lit(0.0))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score + add)), 6)


def limits(route: Column, base: dict[str, int], bumps: list[Column], table: list[dict[str, int]]) -> Column:
    """Difficulty from the route, one more for each bump, as the row of a table of limits."""
    level = F.coalesce(*(F.when(route == r, n) for r, n in base.items()), F.lit(0))
    for b in bumps:
        level = level + F.when(b, 1).otherwise(0)
    level = F.least(level, F.lit(len(table) - 1))
    rows = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in row.items())) for row in table))
    return F.struct(level.alias("difficulty"), *(F.get(rows, level)[k].alias(k) for k in table[0]))


def trim(df: DataFrame, least: float = 0.35, share: float = 0.75, most: int = 5) -> DataFrame:
    """Rows at or above both limits, at least one and at most so many of each query; df has ranks."""
    w = Window.partitionBy("query_id")
    return df.withColumn("_t", F.max("score").over(w)).where(((F.col("score") >= least) & (F.col("score") >= share * F.col("_t")) | (F.col("rank") == 1)) & (F.col("rank") <= most)).drop("_t")


def scenario(text: Column, rules: list[tuple[str, float, str]]) -> list[Column]:
    """Sum of the weights of phrases that occur, and their labels."""
    hit = F.filter(F.array(*(F.struct(F.lit(p).alias("p"), F.lit(w).alias("w"), F.lit(label).alias("l")) for p, w, label in rules)), lambda r: F.contains(text, r["p"]))
    return [F.round(F.aggregate(hit, F.lit(0.0), lambda s, r: s + r["w"]), 6).alias("scenario_score"), F.array_join(F.array_distinct(F.transform(hit, lambda r: r["l"])), ",").alias("labels")]


def summary(c: Column, keywords: str, least: int = 30, most: int = 300) -> Column:
    """The first sentence of more than ``least`` characters with a keyword, else the first one, else the first sentence."""
    s = T.sentences(c)
    long = F.filter(s, lambda x: F.length(x) > least)
    return F.substring(F.coalesce(F.get(F.filter(long, lambda x: F.regexp_like(x, F.lit(keywords))), F.lit(0)), F.get(long, F.lit(0)), F.get(s, F.lit(0))), 1, most)


def practicality(answer: Column, steps: str = r"\d", duties: str = r"(?i)\b(must|shall|should)\b") -> Column:
    """.4 for steps or numbers, .4 for duties, .2 for length."""
    flag = lambda p: F.when(F.regexp_like(answer, F.lit(p)), 1.0).otherwise(0.0)
    return F.round(0.4 * flag(steps) + 0.4 * flag(duties) + 0.2 * F.least(F.lit(1.0), T.word_count(answer) / 50), 6)


def chunk_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """Paragraph chunks with index, content hash, and active."""
    parts = F.filter(F.transform(F.split(text, "\n"), T.trim), lambda x: x != "")
    return df.select(F.col(key), F.posexplode(parts).alias("chunk_index", "content")).select(key, "chunk_index", F.sha2("content", 256).alias("content_hash"), F.lit(True).alias("is_active"))


def soft_delete(df: DataFrame, gone: Column) -> DataFrame:
    return df.withColumn("is_active", F.coalesce(F.col("is_active"), F.lit(True)) & ~gone)


def char_budget(df: DataFrame, by: str, order: str, text: str, most: int) -> DataFrame:
    """The latest rows whose texts together stay within a number of characters."""
    w = Window.partitionBy(by).orderBy(F.col(order).desc(), F.col(text)).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(F.length(text)).over(w)).where(F.col("used") <= most)


def sample(df: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """n rows, the same ones for the same seed."""
    return df.orderBy(F.md5(F.concat_ws("-", F.lit(str(seed)), key)), key).limit(n)


def articles(df: DataFrame, key: str, text: str, heading: str = r"(?iu)^\**\s*Điều\s+\d+[a-z]?\.") -> DataFrame:
    """(key, article_no, content): blocks from each heading to before the next one."""
    marked = F.regexp_replace(text, f"(?m)({heading})", "\u0001$1")
    return df.select(F.col(key), F.posexplode(F.filter(F.split(marked, "\u0001"), lambda b: F.regexp_like(b, F.lit(heading)))).alias("article_no", "content")).select(key, "article_no", T.strip(F.col("content")).alias("content"))
