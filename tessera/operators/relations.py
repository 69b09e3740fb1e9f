"""Relations between documents by where their numbers are mentioned: zones of a text, the words before a mention, guards, and what
rank, year and words allow; then edges between known documents.

Zones are cut in the JVM, so that only the beginning and the end of a text, and of those only such with a number, reach the table
function that finds each mention's place, its named parts and the characters before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from tessera.operators import validity

#: What may stand before a mention, for each relation; what stands before mentions that relate to nothing.
GUIDED_BY, REPLACES, AMENDS = r"(?iU)Căn\s+cứ", r"(?iU)thay\s+thế|bãi\s+bỏ", r"(?iU)sửa\s+đổi|bổ\s+sung"
GUIDANCE = r"(?iU)hướng\s+dẫn\s+(?:thi\s+hành|thực\s+hiện|áp\s+dụng|tổ\s+chức\s+thực\s+hiện)"
GENERIC = r"(?iU)liên\s+quan\s+(?:đến|tới)|có\s+liên\s+quan|cùng\s+(?:lĩnh\s+vực|ngành)"
#: Texts of web pages (two of them make a text no document), the mark that legal text ends at, and links.
PAGE = (
    r"(?iU)Nội\s+dung\s+hợp\s+nhất|Văn\s+bản\s+hợp\s+nhất|tính\s+năng\s+phần\s+mềm|danh\s+mục\s+văn\s+bản\s+hết\s+hiệu\s+lực|CHÍNH\s+SÁCH\s+BẢO\s+VỆ\s+DỮ\s+LIỆU\s+CÁ\s+NHÂN"
    r"|Yêu\s+cầu\s+hỗ\s+trợ|Chú\s+thích\s+màu\s+chỉ\s+dẫn"
)
ANNOTATIONS = "Chú thích màu chỉ dẫn"
LINK = r"(?d)\[.*?\]\(https?://.*?\)"
#: Numbers of documents as Python's patterns write them.
NUMBER = validity.NUMBER.removeprefix("(?U)")


class Mentions:
    """mentions(text, pattern, before): a row for each match of the pattern in the text, with its place, what matched, up to ``before``
    characters in front of it, and a column for each named part of the pattern. Null texts have none."""

    @staticmethod
    def analyze(text: AnalyzeArgument, pattern: AnalyzeArgument, before: AnalyzeArgument) -> AnalyzeResult:
        if not pattern.isConstantExpression or not before.isConstantExpression:
            raise ValueError("the pattern and the number of characters must be constant")
        schema = StructType().add("start", LongType()).add("ref", StringType()).add("context", StringType())
        for name in sorted(regex.compile(pattern.value).groupindex):
            schema = schema.add(name, StringType())
        return AnalyzeResult(schema)

    def eval(self, text: str | None, pattern: str, before: int) -> Iterator[tuple]:
        found = regex.compile(pattern)
        for m in found.finditer(text or ""):
            yield m.start(), m[0], text[max(0, m.start() - before) : m.start()], *(m[name] for name in sorted(found.groupindex))


mentions = udtf(Mentions)


def register(spark) -> None:
    """Makes the table function known to SQL: FROM docs, LATERAL mentions(text, '...', 600)."""
    spark.udtf.register("mentions", mentions)


def legal_text(df: DataFrame, text: str) -> DataFrame:
    """Rows whose text is one of a document, not of a web page, up to its annotations and without links."""
    kept = df.where((F.coalesce(F.col(text), F.lit("")) != "") & (F.regexp_count(text, F.lit(PAGE)) < 2))
    return kept.withColumn(text, F.regexp_replace(F.substring_index(text, ANNOTATIONS, 1), LINK, ""))


def zones(df: DataFrame, text: str, first: int = 5000, last: int = 5000) -> DataFrame:
    """The first and the last characters of each text, as rows (zone, zone_start, zone_text); a short text is in both whole."""
    c = F.col(text)
    low = F.greatest(F.length(c) - last, F.lit(0))
    both = F.array(F.struct(F.lit("preamble").alias("zone"), F.lit(0).alias("zone_start"), F.left(c, F.lit(first)).alias("zone_text")), F.struct(F.lit("ending").alias("zone"), low.alias("zone_start"), F.substr(c, low + 1).alias("zone_text")))
    return df.select("*", F.inline(both))


def documents(docs: DataFrame, key: str = "doc_id", number: str = "doc_number", text: str = "text", first: int = 5000, last: int = 5000, before: int = 600) -> DataFrame:
    """(source_id, source_number, target_number, relation, confidence, zone, start, note): what a document says of others. In the first
    characters, numbers after words of a basis: GUIDED_BY. In the last ones, numbers after words of replacement, else of change, unless
    words of guidance or of a general reference stand before them too, or rank and year forbid it; where the words say otherwise, their relation,
    confidence .9 and a note. Rows without id or text have none; a mention of a document's own number counts until edges are resolved."""
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("source_id"), F.coalesce(F.col(number), F.lit("")).alias("source_number"), F.col(text).alias("text"))
    clean = legal_text(rows, "text")
    parts = zones(clean.withColumn("year_text", F.concat_ws("|", *(F.regexp_extract("text", p, 0) for p in (r"(?iU)năm\s+\d{4}", r"(?iU)\d{4}\s*,?\s*số\s+\d+")))), "text", first, last).drop("text")
    linked = (F.col("zone") == "ending") & (F.regexp_count("zone_text", F.lit(LINK)) >= 3) & (F.col("source_number") != "") & ~F.contains("zone_text", F.col("source_number"))
    parts = parts.where(F.regexp_like("zone_text", F.lit(validity.NUMBER)) & ~linked)
    found = parts.lateralJoin(mentions(F.col("zone_text").outer(), F.lit(NUMBER), F.lit(before))).drop("zone_text")
    holds = lambda p: F.regexp_like("context", F.lit(p))
    ending = F.when(holds(REPLACES), "REPLACES").when(holds(AMENDS), "AMENDS")
    related = found.withColumn("proposed", F.when(F.col("zone") == "preamble", F.when(holds(GUIDED_BY), "GUIDED_BY")).when(~holds(GUIDANCE) & ~holds(GENERIC), ending)).where("proposed is not null")
    c = [F.col(n) for n in ("source_number", "ref", "proposed")]
    allowed = related.where((F.col("zone") == "preamble") | (validity.rank_allows(*c) & validity.year_allows(*c, F.col("year_text"), F.lit(""))))
    judged = allowed.withColumn("v", F.when(F.col("zone") == "ending", validity.by_words(F.col("context"), F.col("proposed"), F.col("source_number"), F.col("ref"))))
    wrong = F.coalesce(~F.col("v.valid"), F.lit(False))
    return judged.select(
        "source_id", "source_number", F.col("ref").alias("target_number"), F.when(wrong, F.col("v.relation")).otherwise(F.col("proposed")).alias("relation"), F.when(wrong, 0.9).otherwise(1.0).alias("confidence"), "zone",
        (F.col("zone_start") + F.col("start")).cast("long").alias("start"), F.nullif("v.reason", F.lit("")).alias("note"),
    )


def resolved(found: DataFrame, docs: DataFrame, key: str = "doc_id", number: str = "doc_number") -> DataFrame:
    """found with target_id, the largest id of a document with the number mentioned; null where there is none or it is the source itself."""
    known = docs.where(F.col(key).isNotNull() & (F.coalesce(F.col(number), F.lit("")) != "")).groupBy(F.col(number).alias("target_number")).agg(F.max(F.col(key).cast("string")).alias("target_id"))
    return found.join(known, "target_number", "left").withColumn("target_id", F.when(F.col("target_id") != F.col("source_id"), F.col("target_id")))


def edges(found: DataFrame) -> DataFrame:
    """(source_id, target_id, relation_type, confidence) of resolved mentions, a row each."""
    return found.where("target_id is not null").select("source_id", "target_id", F.col("relation").alias("relation_type"), "confidence")


def counts(found: DataFrame) -> DataFrame:
    """One row: edges, those of each relation, and mentions that could not be resolved."""
    there = F.col("target_id").isNotNull()
    of = lambda kind, name: F.count_if(there & (F.col("relation") == kind)).alias(name)
    return found.agg(F.count_if(there).alias("edges_written"), of("GUIDED_BY", "guided_by_found"), of("REPLACES", "replaces_found"), of("AMENDS", "amends_found"), F.count_if(~there).alias("rejected_by_validation"))
