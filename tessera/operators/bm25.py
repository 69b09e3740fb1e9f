"""Keyword search: index tables, BM25, exact search, title and body scores; keyword_index holds the stored index, best-k and phrase search.

Queries run together as one plan. Only tokens that some query has leave the documents' scan, so
what is shuffled follows the matches and not the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

K1, B = 1.5, 0.75


def term_counts(docs: DataFrame, doc_id: str, tokens: Column) -> DataFrame:
    """(doc_id, token, tf, dl): how often a token occurs, and how many tokens the document has. Counted within the row."""
    counted = docs.select(F.col(doc_id).alias("doc_id"), tokens.alias("t"))
    return counted.select("doc_id", F.size("t").alias("dl"), F.explode("t").alias("token")).groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("tf"), F.max("dl").alias("dl"))


def index(docs: DataFrame, doc_id: str, tokens: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables of an inverted index: tf(doc_id, token, tf, dl), df(token, df), stats(n_docs, avgdl)."""
    tf = term_counts(docs, doc_id, tokens)
    df = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    stats = docs.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size(tokens)).alias("avgdl"))
    return tf, df, stats


def score(docs: DataFrame, queries: DataFrame, doc_id: str, query_id: str, doc_tokens: Column, query_tokens: Column, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, doc_id, score) for all pairs that share a token; repeated query tokens count each time."""
    wanted = queries.select(F.col(query_id).alias("query_id"), F.explode(query_tokens).alias("token")).groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("times"))
    stats = docs.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size(doc_tokens)).alias("avgdl"))
    words = docs.select(F.col(doc_id).alias("doc_id"), doc_tokens.alias("t")).select("doc_id", F.size("t").alias("dl"), F.explode("t").alias("token"))
    tf = words.join(wanted.select("token").distinct(), "token", "left_semi").groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("tf"), F.max("dl").alias("dl"))
    df = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    weight = wanted.join(df, "token").crossJoin(stats)  # one row of statistics
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("times") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return tf.join(weight, "token").groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score"))


def top(scored: DataFrame, k: int) -> DataFrame:
    """The best k documents of each query, ties by smallest id."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(docs: DataFrame, queries: DataFrame, doc_id: str, query_id: str, doc_text: str, query_text: str, k: int = 10, stopwords: tuple[str, ...] = T.STOPWORDS) -> DataFrame:
    """(query_id, doc_id, score, rank)."""
    return top(score(docs, queries, doc_id, query_id, T.tokens(F.col(doc_text), stopwords), T.tokens(F.col(query_text), stopwords)), k)


def normalised(scored: DataFrame, k: int) -> DataFrame:
    """The best 2k of each query scaled to 0..1 among themselves, of which the first k stay."""
    wide = top(scored, 2 * k)
    w = Window.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    scaled = F.when(high == low, 1.0).otherwise((F.col("score") - low) / (high - low))
    return wide.withColumn("normalised", F.round(scaled, 6)).where(F.col("rank") <= k)


def token_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_tokens: Column, right_tokens: Column) -> DataFrame:
    """(left_id, right_id, shared, n_left, n_right) of rows that share a distinct token, by joining on tokens."""
    l = left.select(F.col(left_id).alias("left_id"), F.array_distinct(left_tokens).alias("t")).select("left_id", F.size("t").alias("n_left"), F.explode("t").alias("token"))
    r = right.select(F.col(right_id).alias("right_id"), F.array_distinct(right_tokens).alias("t")).select("right_id", F.size("t").alias("n_right"), F.explode("t").alias("token"))
    return l.join(r, "token").groupBy("left_id", "right_id").agg(F.count(F.lit(1)).alias("shared"), F.max("n_left").alias("n_left"), F.max("n_right").alias("n_right"))


def field_score(docs: DataFrame, queries: DataFrame, doc_id: str, query_id: str, title: Column, body: Column, query: Column, title_text: Column | None = None, query_text: Column | None = None, numbered: Column | None = None) -> DataFrame:
    """(query_id, doc_id, score): 2.5 for the share of query tokens in the title, 0.75 for those in the body, per pair that shares any;
    2 more where the query's text holds the title's, 0.5 more for documents whose article number stands in their text (numbered)."""
    pair = lambda c: token_pairs(queries, docs, query_id, doc_id, query, c).select(F.col("left_id").alias("query_id"), F.col("right_id").alias("doc_id"), (F.col("shared") / F.col("n_left")).alias("share"))
    both = pair(title).withColumnRenamed("share", "in_title").join(pair(body).withColumnRenamed("share", "in_body"), ["query_id", "doc_id"], "full_outer")
    value = 2.5 * F.coalesce("in_title", F.lit(0.0)) + 0.75 * F.coalesce("in_body", F.lit(0.0))
    if title_text is not None and query_text is not None:
        both = both.join(docs.select(F.col(doc_id).alias("doc_id"), F.lower(title_text).alias("_t")), "doc_id").join(queries.select(F.col(query_id).alias("query_id"), F.lower(query_text).alias("_q")), "query_id")
        value = value + F.when((F.coalesce("_t", F.lit("")) != "") & F.contains("_q", F.col("_t")), 2.0).otherwise(0.0)
    if numbered is not None:
        both = both.join(docs.select(F.col(doc_id).alias("doc_id"), numbered.alias("_n")), "doc_id")
        value = value + F.when(F.col("_n"), 0.5).otherwise(0.0)
    return both.select("query_id", "doc_id", F.round(value, 6).alias("score"))


#: Numbers of documents and articles that a question names.
NAMED_NUMBER = r"(?iU)\b\d+(?:/\d+)*(?:-[A-Z]+)*/[A-Z0-9À-ỴĂÂĐÊÔƠƯ\-]+\b"
NAMED_ARTICLE = r"(?iU)(?:điều|dieu)\s+\d+[A-Za-zÀ-ỴăâêôơưĐđ]*"


def exact_search(rows: DataFrame, queries: DataFrame, k: int | None = None) -> DataFrame:
    """(query_id, row_id, level, score, rank): rows whose number or article a question names, by .6 for a number that stands in the question, .2 for
    its first article, .15 and .1 for the shares of its tokens that the title, and all of the row, have, and .05 for rows of level article; 1 at
    most; ties by row_id. rows: row_id, level, doc_number, article, title, citation, content; queries: query_id, question. Numbers and articles
    are looked up by equality; questions that name none find nothing."""
    c = lambda name: F.coalesce(F.trim(F.col(name)), F.lit(""))
    found = lambda p: F.regexp_extract_all(F.coalesce("question", F.lit("")), F.lit(p), F.lit(0))
    q = queries.select("query_id", F.coalesce("question", F.lit("")).alias("question"), F.concat(found(NAMED_NUMBER), found(NAMED_ARTICLE)).alias("names"), F.size(found(NAMED_NUMBER)).alias("n_numbers"), F.get(found(NAMED_ARTICLE), F.lit(0)).alias("first"))
    keyed = rows.select("*", F.explode(F.array_distinct(F.array(F.lower(c("doc_number")), F.lower(c("article"))))).alias("_key")).where("_key <> ''")
    met = q.select("*", F.explode(F.array_distinct(F.transform("names", F.lower))).alias("_key")).join(keyed, "_key").drop("_key", "names").dropDuplicates(["query_id", "row_id", "level"])
    citation = F.when(c("citation") == "", c("title")).otherwise(c("citation"))
    qt = F.array_distinct(T.index_tokens(T.fold(F.col("question"))))
    share = lambda text: F.when(F.size(qt) == 0, 0.0).otherwise(F.size(F.array_intersect(qt, T.index_tokens(T.fold(text)))) / F.size(qt))
    number = ((c("doc_number") != "") & (F.col("n_numbers") > 0) & F.contains("question", c("doc_number"))).cast("double")
    article = ((c("article") != "") & F.coalesce(F.contains(T.fold(c("article")), T.fold(F.col("first"))), F.lit(False))).cast("double")
    titled, held = share(F.concat_ws(" ", c("title"), citation, c("article"))), share(F.concat_ws("\n", c("doc_number"), c("title"), c("article"), citation, c("content")))
    value = 0.6 * number + 0.2 * article + 0.15 * titled + 0.1 * held
    scored = met.withColumn("score", F.when(value > 0, F.round(F.least(F.lit(1.0), value + F.when(F.col("level") == "article", 0.05).otherwise(0.0)), 6))).where("score > 0")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "row_id", "level")
    out = scored.withColumn("rank", F.row_number().over(w)).select("query_id", "row_id", "level", "score", "rank")
    return out if k is None else out.where(F.col("rank") <= k)
