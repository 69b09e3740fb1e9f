"""Building and updating a corpus: records from several sources, projections, incremental updates, question sets, caches, answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import web
from tessera.functions.scores import minmax
from tessera.operators.dedupe import difference


def first_given(*columns: Column) -> Column:
    """The first value that is neither null nor blank."""
    return F.coalesce(*(F.when(F.trim(c.cast("string")) != "", c) for c in columns))


def record(sources: list[DataFrame], key: str, fields: list[str]) -> DataFrame:
    """One row per key, each field from the first source that gives it; sources have a row per key at most."""
    out = None
    for k, s in enumerate(sources):
        s = s.select(key, *(F.col(f).alias(f"{f}_{k}") if f in s.columns else F.lit(None).cast("string").alias(f"{f}_{k}") for f in fields))
        out = s if out is None else out.join(s, key, "full_outer")
    return out.select(key, *(first_given(*(F.col(f"{f}_{k}") for k in range(len(sources)))).alias(f) for f in fields))


def provider_value(c: Column, blocked: tuple[str, ...]) -> Column:
    """A cell's text, null where it is a label that only stands for a missing value."""
    plain = T.squash(F.regexp_replace(c, r"<[^>]*>", " "))
    return F.when(~F.lower(plain).isin(*blocked) & (plain != ""), plain)


def html_metadata(df: DataFrame, key: str, html: str, labels: dict[str, str]) -> DataFrame:
    """Title, first date and labelled values of pages, from table pairs first and from the text else."""
    pairs, text = web.table_pairs(F.col(html)), web.visible_text(F.regexp_replace(html, r"(?i)<br\s*/?>|</(p|tr|div|h\d)>", "\n"))
    heading = F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1)
    found = [F.coalesce(F.nullif(F.try_element_at(pairs, F.lit(label)), F.lit("")), web.labelled(text, label)).alias(name) for name, label in labels.items()]
    return df.select(key, first_given(T.squash(F.regexp_replace(heading, r"<[^>]*>", " ")), web.title(F.col(html))).alias("title"), web.date_of(text).alias("first_date"), *found)


def document_id(number: Column, title: Column, url: Column) -> Column:
    """A slug of title and number, of the title, or of the url's path with a hash of the url."""
    path = F.concat_ws("_", T.slug(F.regexp_extract(url, r"^[a-z]+://[^/]*/([^?#]*)", 1)), F.substring(F.sha2(url, 256), 1, 8))
    both = F.when((F.coalesce(F.trim(title), F.lit("")) != "") & (F.coalesce(F.trim(number), F.lit("")) != ""), T.slug(F.concat_ws(" ", title, number)))
    return first_given(both, T.slug(title), path)


def for_embedding(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, text, metadata): texts that are not blank, everything else in one struct."""
    rest = [c for c in df.columns if c not in (key, text)]
    return df.where(F.trim(text) != "").select(F.col(key).alias("id"), F.col(text).alias("text"), F.struct(*rest).alias("metadata") if rest else F.lit(None).alias("metadata"))


def projected(df: DataFrame, fields: dict[str, Column], text: str, length: int) -> DataFrame:
    """A copy of a collection with other fields and the head of its text."""
    return df.select(*(c.alias(n) for n, c in fields.items()), F.substring(text, 1, length).alias(text))


def incremental(index: DataFrame, files: DataFrame, key: str, digest: str) -> DataFrame:
    """The index after an update: rows of changed and missing files stay but are inactive, new and changed files come in."""
    active = index.where("is_active")
    change = difference(active.select(key, digest).distinct(), files.select(key, digest), key, digest)
    marked = index.join(change.where("change in ('changed', 'removed')").select(key, F.lit(True).alias("_old")), key, "left")
    old = marked.withColumn("is_active", F.col("is_active") & F.col("_old").isNull()).drop("_old")
    fresh = files.join(change.where("change in ('added', 'changed')").select(key), key).withColumn("is_active", F.lit(True))
    return old.unionByName(fresh.select(*index.columns))


def questions(df: DataFrame, text: list[str], key: list[str]) -> DataFrame:
    """(question_id, question): the first given of several fields; blank ones go; ids that are missing come from the text."""
    q = df.select(T.int_like(first_given(*(F.col(c).cast("string") for c in key))).alias("i"), T.squash(first_given(*(F.col(c) for c in text))).alias("question"))
    return q.where("question is not null").select(F.coalesce("i", T.stable_id(F.col("question"))).alias("question_id"), "question")


def cached(asked: DataFrame, cache: DataFrame, ttl_seconds: int) -> DataFrame:
    """Answers of equal questions (by digest of the folded text) that are not older than the time to live; the newest one."""
    c = cache.select(F.md5(T.match_text(F.col("question"))).alias("h"), "answer", F.col("at").alias("answered_at"))
    q = asked.withColumn("h", F.md5(T.match_text(F.col("question"))))
    hit = q.join(c, "h").where(F.col("at").cast("double") - F.col("answered_at").cast("double") <= ttl_seconds).where("answered_at <= at")
    w = Window.partitionBy("question_id").orderBy(F.col("answered_at").desc(), "answer")
    return hit.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("question_id", "answer")


def answer_flags(answer: Column, sections: list[str], forbidden: list[str]) -> list[Column]:
    """Which sections an answer lacks, whether it holds forbidden phrases, and whether it is valid."""
    missing = F.filter(F.array(*map(F.lit, sections)), lambda s: ~F.contains(answer, s))
    bad = F.exists(F.array(*map(F.lit, forbidden)), lambda s: F.contains(F.lower(answer), s)) if forbidden else F.lit(False)
    return [F.array_join(missing, ",").alias("missing"), bad.alias("forbidden"), ((F.size(missing) == 0) & ~bad).alias("valid")]


def template_answer(df: DataFrame, query: str, title: str, text: str, rank: str, most: int = 3) -> DataFrame:
    """One answer per query: its best contexts, numbered, each with its title and first sentences."""
    line = F.concat(F.lit("["), F.col(rank).cast("string"), F.lit("] "), F.col(title), F.lit(": "), F.substring(T.squash(F.col(text)), 1, 200))
    rows = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), line.alias("line"))))
    return df.where(F.col(rank) <= most).groupBy(query).agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("answer"))


def adaptive_contexts(df: DataFrame, model: str, cost: str, alpha: float = 0.15, least: float = 0.55, share: float = 0.8, budget: int = 1200, at_least: int = 1, most: int = 8) -> DataFrame:
    """Best row of each document by a blend of retrieval and model scores (of equal ones that of the higher score, then of the lower cost); of those at or above the query's threshold and a share of its best
    one, in order, every row that still fits the budget (one that does not is skipped), most rows at most; where fewer than at_least are
    taken, the first at_least instead. used: what is spent up to and including a row."""
    w = Window.partitionBy("query_id")
    blend = alpha * F.col("score") + (1 - alpha) * minmax(F.col(model), ["query_id"], 0.5)
    b = df.withColumn("blend", F.round(blend, 6)).withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy(F.desc("blend"), F.desc("score"), F.asc(cost)))).where("_r = 1").drop("_r")
    b = b.withColumn("rank", F.row_number().over(w.orderBy(F.desc("blend"), "doc_id"))).withColumn("_top", F.max("blend").over(w))
    mean, sd = F.avg("blend").over(w), F.stddev_pop("blend").over(w)
    limit = F.when(F.col("_top") >= 0.9, F.greatest(F.lit(0.75), F.col("_top") - 0.5 * sd)).when(F.col("_top") >= 0.8, F.greatest(F.lit(0.65), mean + 0.3 * sd)).otherwise(F.greatest(F.lit(least), mean))
    b = b.withColumn("_ok", (F.col("blend") >= F.round(limit, 6)) & (F.col("blend") >= share * F.col("_top"))).where(F.col("_ok") | (F.col("rank") <= at_least))
    row = F.struct("rank", F.col("doc_id").cast("long").alias("doc_id"), "blend", F.col(cost).cast("long").alias("cost"), F.col("_ok").alias("ok"), F.lit(0).cast("long").alias("used"))
    lists = b.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    # what is taken depends on what was taken before: a fold within the row, over one query's short list
    spent = lambda s: F.coalesce(F.get(s, F.size(s) - 1)["used"], F.lit(0).cast("long"))
    put = lambda s, r: F.concat(s, F.array(F.struct(r["rank"].alias("rank"), r["doc_id"].alias("doc_id"), r["blend"].alias("blend"), r["cost"].alias("cost"), r["ok"].alias("ok"), (spent(s) + r["cost"]).alias("used"))))
    fits = lambda s, r: r["ok"] & (spent(s) + r["cost"] <= budget) & (F.size(s) < most)
    none = F.expr("cast(array() as array<struct<rank: int, doc_id: bigint, blend: double, cost: bigint, ok: boolean, used: bigint>>)")
    taken = F.aggregate("rows", none, lambda s, r: F.when(fits(s, r), put(s, r)).otherwise(s))
    first = F.aggregate(F.filter("rows", lambda r: r["rank"] <= at_least), none, put)
    return lists.select("query_id", F.explode(F.when(F.size(taken) < at_least, first).otherwise(taken)).alias("r")).select("query_id", "r.doc_id", "r.blend", "r.rank", "r.used")
