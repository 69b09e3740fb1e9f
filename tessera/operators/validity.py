"""Whether relations between legal documents can hold: rank and year, words around them, references between chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

#: Kinds of documents by what follows the year in their number, and their rank, 1 the highest.
KIND = r"/(QH\d+|NĐ-CP|TT-[A-Z]+|QĐ-[A-Z]+|CT-[A-Z]+|TLT-[A-Z]+|VBHN-[A-Z]+)(?:/|$)"
RANKS = {"QH": 1, "NĐ-CP": 2, "TT-": 3, "TLT-": 3, "QĐ-": 4, "CT-": 4, "VBHN-": 5}
CHANGING = ("AMENDS", "REPLACES")
#: Words that show a relation, each one's first place counts; numbers of documents, references between chunks, and what excludes one.
SHOWS = {
    "GUIDED_BY": (r"căn\s+cứ\s+vào", r"phù\s+hợp\s+với", r"hướng\s+dẫn\s+thi\s+hành", r"hướng\s+dẫn\s+thực\s+hiện", r"hướng\s+dẫn\s+một\s+số\s+nội\s+dung", r"theo\s+quy\s+định\s+tại"),
    "AMENDS": (r"sửa\s+đổi,\s*bổ\s+sung", r"sửa\s+đổi", r"bổ\s+sung"),
    "REPLACES": (r"thay\s+thế\s+toàn\s+bộ", r"thay\s+thế", r"bãi\s+bỏ\s+toàn\s+bộ", r"bãi\s+bỏ"),
}
NUMBER = r"(?U)\b\d+/\d{4}/[A-ZĐ0-9\-]+\b"
#: Reasons against a relation, in the order of their checks.
REASONS = (
    "same_law_different_year_is_replacement_not_amendment", "multiple_docs_in_context_ambiguous", "context_shows_guided_by_not_amends", "context_shows_amends_not_guided", "context_shows_replaces_not_amends",
    "target_too_far_from_relation_keyword",
)
REFERENCE = r"(?iu)Điều\s+(\d+).*?(?:Nghị\s+định|Luật|Thông\s+tư)\s+số\s+(\d+/\d{4}/[A-ZĐ0-9\-]+)"
EXCLUDES = r"(?iu)không\s+áp\s+dụng|ngoại\s+trừ|trừ\s+trường\s+hợp|không\s+bao\s+gồm"


def rank_of(number: Column) -> Column:
    """Rank of a document's kind; null where its number does not tell."""
    kind = F.regexp_extract(number, KIND, 1)
    return F.coalesce(*(F.when(F.startswith(kind, F.lit(k)), F.lit(n)) for k, n in RANKS.items()))


def rank_allows(source: Column, target: Column, relation: Column) -> Column:
    """A document changes or replaces none of higher rank; unknown ranks allow everything."""
    return F.coalesce(~relation.isin(*CHANGING) | (rank_of(source) <= rank_of(target)), F.lit(True))


def year(number: Column, text: Column) -> Column:
    """The year in a number, else the one a text names; null without."""
    found = (F.regexp_extract(number, r"/(\d{4})/", 1), F.regexp_extract(text, r"(?iu)năm\s+(\d{4})", 1), F.regexp_extract(text, r"(?iu)(\d{4})\s*,?\s*số\s+\d+", 1))
    return F.coalesce(*(F.nullif(c, F.lit("")).try_cast("int") for c in found))


def year_allows(source: Column, target: Column, relation: Column, source_text: Column, target_text: Column) -> Column:
    """A document changes or replaces none of a later year; unknown years allow everything."""
    return F.coalesce(~relation.isin(*CHANGING) | (year(source, source_text) >= year(target, target_text)), F.lit(True))


def by_words(context: Column, relation: Column, source: Column, target: Column, within: int = 300) -> Column:
    """What the words around a relation say of it, as a struct: valid, the relation they show, and a reason. In order: one document of two
    years; more than two documents; words of another relation; a target farther than ``within`` characters from the first place of every word."""
    bare = lambda c: F.regexp_replace(c, r"/\d{4}/", "")
    low = F.lower(context)
    shows = {k: F.regexp_like(low, F.lit("(?U)" + "|".join(words))) for k, words in SHOWS.items()}
    sequel = (F.coalesce(source, F.lit("")) != "") & (F.coalesce(target, F.lit("")) != "") & (bare(source) == bare(target)) & (source != target)
    several = F.size(F.array_distinct(F.regexp_extract_all(context, F.lit(NUMBER), F.lit(0)))) > 2
    guided = relation.isin(*CHANGING) & shows["GUIDED_BY"] & ~shows["AMENDS"] & ~shows["REPLACES"]
    amended = (relation == "GUIDED_BY") & shows["AMENDS"] & ~shows["GUIDED_BY"]
    replaced = (relation == "AMENDS") & shows["REPLACES"] & ~shows["AMENDS"]
    # the first place of a word is the length of what stands before it
    at = F.nullif(F.instr(context, target), F.lit(0)) - 1
    place = lambda w: F.when(F.regexp_like(low, F.lit(f"(?U){w}")), F.length(F.regexp_extract(low, f"(?Us)^(.*?)(?:{w})", 1)))
    gaps = F.transform(F.array(*(place(w) for words in SHOWS.values() for w in words)), lambda p: F.abs(at - p))
    far = F.coalesce(F.array_min(F.filter(gaps, lambda g: g.isNotNull())) > within, F.lit(False))
    verdict = lambda kind, why: F.struct(F.lit(False).alias("valid"), kind.alias("relation"), F.lit(why).alias("reason"))
    return (
        F.when(sequel, verdict(F.lit("REPLACES"), REASONS[0])).when(several, verdict(relation, REASONS[1])).when(guided, verdict(F.lit("GUIDED_BY"), REASONS[2]))
        .when(amended, verdict(F.lit("AMENDS"), REASONS[3])).when(replaced, verdict(F.lit("REPLACES"), REASONS[4])).when(far, verdict(relation, REASONS[5]))
        .otherwise(F.struct(F.lit(True).alias("valid"), relation.alias("relation"), F.lit("").alias("reason")))
    )


def chunk_references(chunks: DataFrame, key: str, text: str, before: int = 60) -> DataFrame:
    """(key, article, number, relation, confidence, start): articles of numbered documents that a chunk refers to; one that words of exclusion
    precede within so many characters is EXCLUDED_REF at .8. Offsets of matches are needed: Arrow batches, a chunk at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reference, excludes = regex.compile(REFERENCE), regex.compile(EXCLUDES)
        for f in frames:
            out = []
            for k, t in zip(f["k"], f["t"]):
                for m in reference.finditer(t or ""):
                    out_ = bool(excludes.search(t[max(0, m.start() - before) : m.start()]))
                    out.append((k, m[1], m[2], "EXCLUDED_REF" if out_ else "REFERS_TO", 0.8 if out_ else 1.0, m.start()))
            yield pd.DataFrame(out, columns=[key, "article", "number", "relation", "confidence", "start"])

    return chunks.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).mapInPandas(run, f"{key} string, article string, number string, relation string, confidence double, start long")


def fixed_tag(tag: Column, number: Column) -> Column:
    """A tag "a|b" whose first part lacks the document's number gets it; other tags stay."""
    rest = F.trim(F.regexp_extract(tag, r"(?s)^[^|]*\|(.*)$", 1))
    return F.when((F.coalesce(tag, F.lit("")) != "") & ~F.contains(tag, F.coalesce(number, F.lit(""))) & (rest != ""), F.concat_ws("|", number, rest)).otherwise(tag)


#: What two phrases together add to a row's score, and words of which one is enough.
BRIDGES = (("sme_procurement_bridge", 25, ("doanh nghiep nho va vua", "dau thau"), True), ("invoice_tax_bridge", 20, ("hoa don", "quan ly thue"), True), ("tax_registration_bridge", 18, ("dang ky thue", "khai thue", "quyet toan thue"), False), ("enforcement_invoice_bridge", 15, ("ngung su dung hoa don", "cuong che"), False))


def row_score(number: Column, title: Column, content: Column, issued_year: Column, priority: list[str], tax_priority: list[str], title_phrases: list[str], scenarios: list[tuple[str, int, str]]) -> Column:
    """Score and labels of a document as a struct: 100 and 120 for listed numbers, 10 for each phrase of the title, weights of scenario
    phrases, bridges, 3 from 2019 on and 2 more from 2023 on. The first 12,000 characters of the content count."""
    t = T.match_text(F.coalesce(title, F.lit("")))
    hay = T.match_text(F.concat_ws("\n", F.coalesce(F.trim(number), F.lit("")), F.coalesce(title, F.lit("")), F.substring(F.coalesce(content, F.lit("")), 1, 12_000)))
    hits = [(F.trim(number).isin(*priority), 100, "priority_doc"), (F.trim(number).isin(*tax_priority), 120, "tax_priority_doc"), *((F.contains(t, F.lit(p)), 10, f"title:{p}") for p in title_phrases), *((F.contains(hay, F.lit(p)), w, label) for p, w, label in scenarios)]
    for name, w, words, every in BRIDGES:
        has = [F.contains(hay, F.lit(x)) for x in words]
        both = has[0]
        for h in has[1:]:
            both = both & h if every else both | h
        hits.append((both, w, name))
    rows = F.filter(F.array(*(F.when(c, F.struct(F.lit(w).alias("w"), F.lit(label).alias("l"))) for c, w, label in hits)), lambda x: x.isNotNull())
    recent = F.when(issued_year >= 2023, 5).when(issued_year >= 2019, 3).otherwise(0)
    return F.struct((F.aggregate(rows, F.lit(0), lambda s, r: s + r["w"]) + recent).alias("score"), F.array_join(F.array_distinct(F.transform(rows, lambda r: r["l"])), ",").alias("labels"))


#: Prefixes of a rewritten question.
PREFIXES = ("rewritten standalone query:", "standalone query:", "rewritten query:", "rewrite:", "query:", "trả lời:")


def clean_rewrite(c: Column) -> Column:
    """The first line of a rewritten question, without code marks, a known prefix and quotes."""
    line = F.trim(F.split(T.strip(F.replace(T.strip(c), F.lit("```"), F.lit(""))), r"\r\n|\r|\n")[0])
    bare = F.coalesce(*(F.when(F.startswith(F.lower(line), F.lit(p)), F.trim(F.substr(line, F.lit(len(p) + 1)))) for p in PREFIXES), line)
    return F.trim(F.regexp_replace(bare, "^[\"'“”‘’]+|[\"'“”‘’]+$", ""))


#: Fields that every source of a registry has.
REQUIRED = ("id", "name", "provider", "source_type", "domain", "url", "enabled", "priority", "crawl_frequency")


def registry_errors(sources: DataFrame, allowed: list[str], required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """(id, error) of sources: missing fields, repeated ids, domains and related domains that are not allowed, urls of another form."""
    blank = lambda c: F.lit(True) if c not in sources.columns else F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    missing = F.array_join(F.array_sort(F.filter(F.array(*(F.when(blank(c), F.lit(c)) for c in required)), lambda x: x.isNotNull())), ",")
    stray = lambda d: (F.coalesce(d, F.lit("")) != "") & ~d.isin(*allowed)
    related = F.filter("related_domains", stray) if "related_domains" in sources.columns else F.expr("cast(array() as array<string>)")
    found = [F.when(missing != "", F.concat(F.lit("missing: "), missing)), F.when(stray(F.col("domain")), F.concat(F.lit("domain: "), F.col("domain"))), F.when(~F.coalesce(F.regexp_like(F.col("url"), F.lit("^https?://")), F.lit(False)), "url")]
    each = F.concat(F.filter(F.array(*found), lambda x: x.isNotNull()), F.transform(F.coalesce(related, F.expr("cast(array() as array<string>)")), lambda d: F.concat(F.lit("related: "), d)))
    twice = sources.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.lit("duplicate id").alias("error"))
    return sources.select("id", F.explode(each).alias("error")).unionByName(twice)


def by_domain(sources: DataFrame) -> DataFrame:
    """(domain, sources): ids of enabled sources by priority."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("priority", "id"))), lambda x: x["id"])
    return sources.where("enabled").groupBy("domain").agg(rows.alias("sources"))
