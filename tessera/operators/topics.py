"""Scoring contexts of a question by all their signals: words, titles, citations, domains, topics and profiles, relations, issuers, numbers.

Topics and profiles are tables of phrases that callers give (from_json() reads them): a topic says what its questions hold, what texts and
titles on it hold, and what that is worth; a profile is the first whose phrases a question holds, and says which sources speak for a context and
which titles, and texts or titles without certain phrases, speak against it. All phrases are compared in folded form. Two scales weigh them: that of search
among candidates, and the milder one of reranking.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.routing import MAIN_DOMAIN, holds


@dataclass(frozen=True)
class Topic:
    """keywords: what a question on it holds; required, titles: what texts, and titles or texts, on it hold; domains that it prefers."""

    keywords: tuple[str, ...]
    required: tuple[str, ...] = ()
    titles: tuple[str, ...] = ()
    domains: tuple[str, ...] = ()
    boost: float = 0.0
    missing: float = 0.0


@dataclass(frozen=True)
class Profile:
    """needs: groups of phrases, of each of which a question holds one. text_words, title_words: if a text or a title has none, the penalty is added."""

    name: str
    needs: tuple[tuple[str, ...], ...]
    sources: tuple[str, ...] = ()
    generic: tuple[str, ...] = ()
    text_words: tuple[str, ...] = ()
    text_penalty: float = 0.0
    title_words: tuple[str, ...] = ()
    title_penalty: float = 0.0


def from_json(text: str) -> tuple[list[Topic], list[Profile]]:
    """Topics and profiles of {"topics": [...], "profiles": [...]}; phrases are folded, unknown fields are an error."""
    fold = lambda x: tuple(fold(y) for y in x) if isinstance(x, (list, tuple)) else T.folded(x)

    def made(kind, row: dict):
        if stray := set(row) - {f.name for f in fields(kind)}:
            raise ValueError(f"unknown fields: {', '.join(sorted(stray))}")
        return kind(**{k: tuple(v) if k == "domains" else fold(v) if isinstance(v, list) else v for k, v in row.items()})

    tables = json.loads(text)
    return [made(Topic, t) for t in tables.get("topics", [])], [made(Profile, p) for p in tables.get("profiles", [])]


@dataclass(frozen=True)
class Scale:
    """What topics and profiles weigh. SEARCH and RERANK. absent: where a topic has neither phrases nor keywords; bare: the
    least loss where it has no phrases, of which ``bare_missing`` of its missing value is the other bound; weak: what words, titles and topic must be
    below for the last loss."""

    keyword: float
    absent: float
    bare: float
    bare_missing: float
    domain: float
    source: float
    generic: float
    each_generic: float
    weak: float
    weak_loss: float
    weak_topic: float | None


SEARCH = Scale(keyword=0.2, absent=1.0, bare=0.75, bare_missing=1.0, domain=0.0, source=0.18, generic=0.85, each_generic=0.15, weak=0.12, weak_loss=0.12, weak_topic=None)
RERANK = Scale(keyword=0.3, absent=0.0, bare=0.2, bare_missing=0.3, domain=0.04, source=0.18, generic=0.2, each_generic=0.05, weak=0.05, weak_loss=0.05, weak_topic=-0.2)
#: What each signal counts for; what relations, and a citation and a source, add.
SEARCH_WEIGHTS = {"base": 0.18, "lexical_overlap": 0.22, "title_match": 0.18, "citation_match": 0.06, "domain_match": 0.14, "topic_boost": 1.0}
RERANK_WEIGHTS = {"base": 0.35, "lexical_overlap": 0.18, "title_match": 0.15, "citation_match": 0.05, "domain_match": 0.1, "relation_boost": 0.07, "topic_boost": 0.25, "issuer_boost": 0.1, "doc_number_penalty": 1.0}
RELATIONS = {"seed": 0.2, "parent": 0.15, "explicit_reference": 0.18, "same_article": 0.12, "cross_domain": 0.1, "neighbor": 0.05}
GIVEN, NO_NUMBER = 0.02, -0.08
#: A context goes if it is below all of these.
MINIMA = {"final_score": 0.06, "lexical_overlap": 0.04, "title_match": 0.03}
#: Numbers of documents; folded words of provinces and of national documents; ends of numbers by issuer.
DOC_NUMBER = r"(?U)\b(\d+(?:/\d+)*(?:-[A-Z]+)*/[A-Z0-9À-ỴĂÂĐÊÔƠƯ\-]+)\b"
PROVINCIAL = ("tinh ", "ubnd", "hđnd", "huyen ", "xa ", "phuong ", "thi xa", "thanh pho ")
NATIONAL = ("luat", "bo luat", "nghi dinh", "thong tu ", "nghi quyet cua quoc hoi", "chi thi cua thu tuong", "quyet dinh cua thu tuong")
ASSEMBLY, GOVERNMENT, COUNCIL = ("QH", "QH14", "QH15", "UBTVQH", "UBTVQH14", "UBTVQH15"), ("ND-CP", "ND", "QD-TTg", "TTg"), ("HDBT", "HDCP")


def profile(question: Column, profiles: list[Profile]) -> Column:
    """The name of the first profile of a folded question; null without."""
    found = []
    for p in profiles:
        fits = F.lit(True)
        for group in p.needs:
            fits = fits & holds(question, group)
        found.append(F.when(fits, F.lit(p.name)))
    return F.coalesce(*found, F.lit(None).cast("string"))


def issuer_boost(title: Column, source: Column, number: Column) -> Column:
    """By who issued a document, from its title, source and number: -.25 for provinces (unless title or number are national), .2 for the assembly, .15 for
    the government and its former councils, .05 for ministries."""
    t, s = T.fold(F.coalesce(title, F.lit(""))), T.fold(F.coalesce(source, F.lit("")))
    found = F.regexp_extract(F.coalesce(number, F.lit("")), DOC_NUMBER, 1)
    end = F.element_at(F.split(found, "/"), -1)
    starts = lambda *words: F.lit(False) if not words else holds(t, ()) | _any(F.startswith(t, F.lit(w)) for w in words)
    assembly = starts("luat ") | holds(t, ("cua quoc hoi", "phap lenh", "uy ban thuong vu quoc hoi")) | (starts("nghi quyet ") & F.contains(t, F.lit("quoc hoi"))) | end.isin(*ASSEMBLY)
    government = starts("nghi dinh ") | holds(t, ("nghi dinh cua chinh phu", "thu tuong")) | end.isin(*GOVERNMENT) | holds(t, ("hoi dong bo truong", "hoi dong chinh phu")) | end.isin(*COUNCIL)
    ministry = F.contains(t, F.lit("thong tu ")) | _any(F.startswith(end, F.lit(w)) for w in ("TT-", "TTLT-"))
    local = (holds(t, PROVINCIAL) | holds(s, PROVINCIAL)) & ~(holds(t, NATIONAL) | (found != ""))
    return F.when(local, -0.25).when(assembly, 0.2).when(government, 0.15).when(ministry, 0.05).otherwise(0.0)


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def signals(df: DataFrame, topics: list[Topic], profiles: list[Profile], scale: Scale, preferred: str | None = None) -> DataFrame:
    """df with lexical_overlap, title_match, citation_match, domain_match and topic_boost of each context, not rounded. df has question,
    content, doc_title, legal_path, citation, article, clause, domain and source_url. Domains that are preferred come from the column of that
    name, or from the topics of the question where none is named (then a citation counts by its share of the question's words, not as given)."""
    c = lambda name: F.coalesce(F.trim(F.col(name)), F.lit(""))
    text = F.array_join(F.filter(F.array(*(c(n) for n in ("doc_title", "domain", "legal_path", "citation", "article", "clause", "content"))), lambda x: x != ""), "\n")
    title = F.array_join(F.filter(F.array(*(c(n) for n in (("doc_title", "citation", "legal_path")))), lambda x: x != ""), " ")
    d = df.withColumn("_text", text).withColumn("_title", title)
    d = d.withColumns({"_q": T.fold(F.coalesce("question", F.lit(""))), "_t": T.fold(F.col("_text")), "_h": T.fold(F.col("_title")), "_s": T.fold(c("source_url")), "_qt": F.array_distinct(T.index_tokens(F.coalesce("question", F.lit(""))))})
    share = lambda x: F.when((F.size("_qt") == 0) | (F.size(x) == 0), 0.0).otherwise(F.size(F.array_intersect("_qt", x)) / F.size("_qt"))
    lexical, titled = share(T.index_tokens(F.col("_text"))), share(T.index_tokens(F.col("_title")))
    cited = share(T.index_tokens(c("citation"))) if preferred is None else F.when((F.col("_q") != "") & F.exists(T.index_tokens(c("citation")), lambda w: F.contains(F.col("_h"), w)), 1.0).otherwise(0.0)
    count = lambda where, words: F.size(T.contained(where, list(words)))
    topic, more_title, more_lexical, asked_any = F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(False)
    wanted = F.col(preferred) if preferred is not None else F.expr("cast(array() as array<string>)")
    for r in topics:
        asked = holds(F.col("_q"), r.keywords)
        required, words = count(F.col("_t"), r.required), count(F.col("_t"), r.keywords)
        titles = F.size(F.filter(F.array(*map(F.lit, r.titles)), lambda p: F.contains(F.col("_h"), p) | F.contains(F.col("_t"), p))) if r.titles else F.lit(0)
        found = required + titles > 0
        if preferred is None:
            wanted = F.concat(wanted, F.when(asked, F.array(*map(F.lit, r.domains))).otherwise(F.expr("cast(array() as array<string>)")) if r.domains else F.expr("cast(array() as array<string>)"))
        add = F.when(found, r.boost * F.least(F.lit(3.0), required + 0.6 * titles)).when(words > 0, F.lit(scale.keyword * r.boost)).otherwise(F.lit(-scale.absent * r.missing))
        add = add + F.least(F.lit(0.12), 0.03 * words) + F.least(F.lit(0.18), 0.04 * required)
        if scale.domain:
            # domains of this topic and of those before it
            add = add + F.when(F.array_contains(wanted, c("domain")), scale.domain).otherwise(0.0)
        add = add - F.when(found, 0.0).otherwise(max(scale.bare, scale.bare_missing * r.missing))
        topic = topic + F.when(asked, add).otherwise(0.0)
        more_title = more_title + F.when(asked & found, F.least(F.lit(0.45), 0.12 * titles)).otherwise(0.0)
        more_lexical = more_lexical + F.when(asked & found, F.least(F.lit(0.15), 0.03 * required)).otherwise(0.0)
        asked_any = asked_any | asked
    named = profile(F.col("_q"), profiles)
    for p in profiles:
        against = F.when(holds(F.col("_s"), p.sources), scale.source).otherwise(0.0) if p.sources else F.lit(0.0)
        n = count(F.col("_h"), p.generic)
        against = against - F.when(n > 0, scale.generic + scale.each_generic * n).otherwise(0.0)
        for where, words, penalty in ((F.col("_t"), p.text_words, p.text_penalty), (F.col("_h"), p.title_words, p.title_penalty)):
            against = against + (F.when(holds(where, words), 0.0).otherwise(penalty) if words else F.lit(0.0))
        topic = topic + F.when(F.coalesce(F.col("_p") == p.name, F.lit(False)), against).otherwise(0.0)
    d = d.withColumn("_p", named).withColumn("_wanted", F.array_distinct(wanted))
    domain = F.when(F.array_contains("_wanted", c("domain")) & (c("domain") != MAIN_DOMAIN) & (c("domain") != ""), 1.0).when((c("domain") == MAIN_DOMAIN) & (F.col("_wanted") == F.array(F.lit(MAIN_DOMAIN))), 0.25).otherwise(0.0)
    d = d.withColumns({"lexical_overlap": lexical + more_lexical, "title_match": titled + more_title, "citation_match": cited, "domain_match": domain, "topic_boost": topic})
    weak = (F.col("domain_match") == 0) & (F.col("lexical_overlap") < scale.weak) & (F.col("title_match") < scale.weak)
    weak = weak & (F.col("topic_boost") <= scale.weak_topic) if scale.weak_topic is not None else weak & asked_any
    d = d.withColumn("topic_boost", F.col("topic_boost") - F.when(weak, scale.weak_loss).otherwise(0.0))
    if scale.weak_topic is None:
        d = d.withColumn("topic_boost", F.col("topic_boost") - F.when(asked_any & (c("domain") == "banking_law") & (F.col("topic_boost") < 0), 0.05).otherwise(0.0))
    d = d.withColumns({"lexical_overlap": F.least(F.lit(1.0), "lexical_overlap"), "title_match": F.least(F.lit(1.0), "title_match")})
    return d.drop("_text", "_title", "_q", "_t", "_h", "_s", "_qt", "_p", "_wanted")


def _rounded(df: DataFrame, weights: dict[str, float], base: str) -> DataFrame:
    """final_score of the weighted signals, not below 0, to 6 places; signals to 4 (a billionth is added before, so that halves go up)."""
    total = sum((w * F.coalesce(F.col(base if c == "base" else c), F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))
    out = df.withColumn("final_score", F.round(F.greatest(F.lit(0.0), total) + 1e-9, 6))
    return out.withColumns({c: F.round(F.col(c) + 1e-9, 4) for c in weights if c != "base"})


def search_scores(df: DataFrame, topics: list[Topic], profiles: list[Profile], base: str = "score", preferred: str = "preferred_domains") -> DataFrame:
    """df with all signals of contexts among candidates of a search and final_score; preferred_domains are the question's."""
    return _rounded(signals(df, topics, profiles, SEARCH, preferred), SEARCH_WEIGHTS, base)


def rerank(df: DataFrame, topics: list[Topic], profiles: list[Profile], base: str = "score", k: int = 5) -> DataFrame:
    """The best k contexts of each query by nine signals, with the signals, final_score and rank (ties by chunk_id). df also has query_id, chunk_id,
    position (of rows of one chunk the last counts), context_type and doc_number. Contexts below all minima go, but not a query's best one if all are."""
    last = Window.partitionBy("query_id", "chunk_id").orderBy(F.desc("position"))
    d = df.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    d = signals(d, topics, profiles, RERANK)
    there = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", GIVEN).otherwise(0.0)
    relation = F.coalesce(*(F.when(F.col("context_type") == kind, x) for kind, x in RELATIONS.items()), F.lit(0.0)) + there("citation") + there("source_url")
    numbered = F.regexp_like(F.coalesce("doc_number", F.lit("")), F.lit(DOC_NUMBER)) | F.regexp_like(F.coalesce("doc_title", F.lit("")), F.lit(DOC_NUMBER))
    d = d.withColumns({"relation_boost": relation, "issuer_boost": issuer_boost(F.col("doc_title"), F.col("source_url"), F.col("doc_number")), "doc_number_penalty": F.when(numbered, 0.0).otherwise(NO_NUMBER)})
    d = _rounded(d, RERANK_WEIGHTS, base)
    low = F.lit(True)
    for c, least in MINIMA.items():
        low = low & (F.col(c) < least)
    order = Window.partitionBy("query_id").orderBy("_low", F.desc("final_score"), "chunk_id")
    d = d.withColumn("_low", low).withColumn("rank", F.row_number().over(order))
    return d.where((~F.col("_low") | (F.col("rank") == 1)) & (F.col("rank") <= k)).drop("_low")
