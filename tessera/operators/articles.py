"""Articles of legal corpora: headings, identities of documents, article rows and their index, and chunks by article."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.structure import split_stripped

#: The line that begins an article, the full name of a document, what a number adds to a name, and where a chunk begins.
HEADING = r"(?m)^(Điều\s+\d+[A-Za-zÀ-ỹăâêôơưĂÂÊÔƠƯđĐ]*)(?:[\.:][^\S\n]*(.*))?$"
FULL_NAME = r"(Luật|Nghị định|Thông tư|Bộ luật)\s+([^\n]+)"
NUMBERED = r"(?iu)\s+số\s+[^\s,.;]+.*$"
CHUNK_HEADING = r"(?imu)^\s*Điều\s+\d+\s*[\.:]?\s*"


def article_info(text: Column) -> Column:
    """Number and title of the first article heading as a struct; null without one."""
    t = T.strip(text)
    number = T.squash(F.regexp_extract(t, HEADING, 1))
    title = F.nullif(T.strip(F.regexp_extract(t, HEADING, 2)), F.lit(""))
    return F.when(number != "", F.struct(number.alias("number"), title.alias("title")))


def identity(doc_id: Column, text: Column) -> Column:
    """Short and full name of a document as a struct: from its full name, else from its last line in capitals, else its id."""
    kind, rest = F.regexp_extract(text, FULL_NAME, 1), T.squash(F.regexp_extract(text, FULL_NAME, 2))
    short = F.regexp_replace(F.regexp_replace(rest, NUMBERED, ""), r"^[ ,.;]+|[ ,.;]+$", "")
    capitals = F.filter(F.transform(F.split(text, "\n"), T.strip), lambda x: (x == F.upper(x)) & (x != F.lower(x)))
    last = F.initcap(F.lower(F.get(capitals, F.size(capitals) - 1)))
    named = F.struct(F.trim(F.concat_ws(" ", kind, short)).alias("title"), F.trim(F.concat_ws(" ", kind, rest)).alias("full_name"))
    return F.when(kind != "", named).when(F.size(capitals) > 0, F.struct(last.alias("title"), last.alias("full_name"))).otherwise(F.struct(doc_id.alias("title"), doc_id.alias("full_name")))


def article_rows(chunks: DataFrame, doc_id: str, chunk_id: str, text: str, position: str) -> DataFrame:
    """One row per chunk that is an article: names of its document come from the document's first chunk that is none."""
    c = chunks.select(F.trim(F.col(doc_id).cast("string")).alias("doc_id"), F.trim(F.col(chunk_id).cast("string")).alias("chunk_id"), T.strip(F.col(text)).alias("chunk_text"), F.col(position).alias("_p"))
    c = c.where("doc_id <> '' and chunk_text <> ''").withColumn("_a", article_info(F.col("chunk_text")))
    names = c.where("_a is null").groupBy("doc_id").agg(F.min_by("chunk_text", F.struct("_p", "chunk_id")).alias("_t")).select("doc_id", identity(F.col("doc_id"), F.col("_t")).alias("_n"))
    out = c.where("_a is not null and chunk_id <> ''").join(names, "doc_id", "left")
    title, full = F.coalesce("_n.title", "doc_id"), F.coalesce("_n.full_name", "doc_id")
    return out.select("doc_id", title.alias("doc_title"), full.alias("doc_full_name"), F.concat_ws("|", "doc_id", title, "_a.number").alias("article_id"), F.col("_a.number").alias("article_number"), F.col("_a.title").alias("article_title"), "chunk_id", "chunk_text")


def article_index(chunks: DataFrame, doc_id: str, article: str, chunk_id: str, level: str, position: str) -> DataFrame:
    """One row per document and article: its last chunk of level 'article', else its first chunk."""
    whole = F.col(level) == "article"
    place = F.struct((~whole).alias("a"), F.when(whole, -F.col(position)).otherwise(F.col(position)).alias("p"))
    return chunks.where(F.coalesce(F.trim(article), F.lit("")) != "").groupBy(doc_id, article).agg(F.min_by(chunk_id, place).alias(chunk_id))


def chunk_text(text: str | None, size: int = 1000, overlap: int = 200) -> list[str]:
    """Articles where a text has two or more, longer ones split; else the whole text split."""
    plain = regex.sub(r"\r\n?", "\n", text or "").strip()
    starts = [m.start() for m in regex.finditer(CHUNK_HEADING, plain)]
    blocks = [plain[a:b].strip() for a, b in zip(starts, [*starts[1:], len(plain)])]
    if len(blocks) < 2:
        return split_stripped(text or "", size, overlap)
    return [c for b in blocks for c in ([b] if len(b) <= size else split_stripped(b, size, overlap))]


def chunks(df: DataFrame, key: str, text: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """(key, chunk_no, content) by chunk_text(), document by document on Arrow batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(k, n, c) for k, t in zip(f["k"], f["t"]) for n, c in enumerate(chunk_text(t, size, overlap))], columns=[key, "chunk_no", "content"])

    return df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInPandas(run, f"{key} long, chunk_no int, content string")


def aliases(title: Column, number: Column, prefixes: tuple[str, ...] = ("luat ", "nghi dinh ", "thong tu ", "bo luat ")) -> Column:
    """Names a document goes by: title, number, and the folded title without its kind."""
    folded = F.lower(T.strip_accents(F.coalesce(title, F.lit(""))))
    bare = F.coalesce(*(F.when(F.startswith(folded, F.lit(p)), F.substr(folded, F.lit(len(p) + 1))) for p in prefixes))
    return F.array_distinct(F.filter(F.array(title, number, bare), lambda x: F.coalesce(x, F.lit("")) != ""))


def doc_ref(number: Column, title: Column, doc_id: Column) -> Column:
    """number|title, each the id where missing."""
    given = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.trim(doc_id.cast("string")))
    return F.concat_ws("|", given(number), given(title))


def article_ref(number: Column, title: Column, doc_id: Column, article: Column) -> Column:
    """number|title|Điều n; the squashed text of an article without a number; null without an article."""
    n = F.regexp_extract(article, r"(\d+[A-Za-z]?)", 1)
    label = F.when(n != "", F.concat(F.lit("Điều "), n)).otherwise(T.squash(article))
    return F.when(F.coalesce(article, F.lit("")) != "", F.concat_ws("|", doc_ref(number, title, doc_id), label))
