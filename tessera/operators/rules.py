"""Keyword rules: domain filter, domain scores, noise, routing, triage. Rules are data, given as small lists."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import contained, density, squash


@dataclass(frozen=True)
class Group:
    """A rule group: phrases that decide alone, phrases that need company, and the domains they stand for."""

    name: str
    exact: tuple[str, ...]
    weak: tuple[str, ...]
    domains: tuple[str, ...] = ()
    priority: int = 1


def noise(text: Column, exclude: list[str], core: list[str]) -> Column:
    """Has an exclude phrase and no core phrase."""
    return (F.size(contained(text, exclude)) > 0) & (F.size(contained(text, core)) == 0)


def domain_filter(df: DataFrame, title: Column, content: Column, groups: list[Group], normative: Column, public: Column, local: Column, is_noise: Column) -> DataFrame:
    """Adds include, matched_group, matched_keywords, candidate_domains. A group matches by an exact phrase in the title; by one
    in the content of a public normative document; or by weak phrases in a normative one (in the title, two, or public)."""
    out = df
    hits = []
    for g in sorted(groups, key=lambda g: g.priority):
        in_title, in_content = contained(title, list(g.exact)), contained(content, list(g.exact))
        weak, weak_title = contained(content, list(g.weak)), contained(title, list(g.weak))
        ok = (F.size(in_title) > 0) | ((F.size(in_content) > 0) & normative & public & ~local)
        ok = ok | (normative & ~local & (F.size(F.array_union(weak, weak_title)) > 0) & ((F.size(weak_title) > 0) | (F.size(weak) >= 2) | public))
        words = F.array_distinct(F.concat(in_title, in_content, weak_title, weak))
        hits.append(F.when(ok & ~is_noise, F.struct(F.lit(g.name).alias("group"), words.alias("words"), F.array(*map(F.lit, g.domains)).cast("array<string>").alias("domains"))))
    found = F.filter(F.array(*hits), lambda h: h.isNotNull())
    out = out.withColumn("_f", found)
    return out.select(
        *df.columns, (F.size("_f") > 0).alias("include"), F.get(F.col("_f"), F.lit(0))["group"].alias("matched_group"),
        F.array_distinct(F.flatten(F.transform("_f", lambda h: h["words"]))).alias("matched_keywords"), F.array_distinct(F.flatten(F.transform("_f", lambda h: h["domains"]))).alias("candidate_domains"),
    )


def domain_scores(df: DataFrame, key: str, text: Column, keywords: dict[str, list[str]]) -> DataFrame:
    """(key, domain, hits, share): for each domain of which a keyword occurs, how many of its keywords do."""
    table = F.array(*(F.struct(F.lit(d).alias("domain"), F.size(contained(text, w)).alias("hits"), F.lit(len(w)).alias("of")) for d, w in keywords.items()))
    return df.select(F.col(key), F.inline(F.filter(table, lambda x: x["hits"] > 0))).select(key, "domain", "hits", F.round(F.col("hits") / F.col("of"), 6).alias("share"))


def best_domain(scores: DataFrame, key: str) -> DataFrame:
    """The domain with the most hits, ties by name."""
    return scores.groupBy(key).agg(F.min_by("domain", F.struct((-F.col("hits")).alias("h"), "domain")).alias("domain"), F.max("hits").alias("hits"))


def first_rule(rules: list[tuple[str, Column]], default: str | None = None) -> Column:
    """The name of the first rule that holds."""
    return F.coalesce(*(F.when(c, name) for name, c in rules), F.lit(default))


def route(text: Column, triggers: dict[str, list[str]], n_words: Column, default: str) -> Column:
    """The first route of which a trigger occurs; long questions without one are 'complex', others the default."""
    return first_rule([(name, F.size(contained(text, words)) > 0) for name, words in triggers.items()] + [("complex", n_words > 30)], default)


def retrieval_policy(text: Column, n_words: Column) -> Column:
    """alpha, top_k and candidate_k by the features of a query: short or numeric ones lean on keywords."""
    numeric = F.regexp_like(text, F.lit(r"\d"))
    alpha = F.when(numeric, 0.3).when(n_words >= 12, 0.8).otherwise(0.5)
    top_k = F.when(n_words >= 12, 8).when(numeric, 6).otherwise(5)
    return F.struct(alpha.alias("alpha"), top_k.alias("top_k"), (top_k * 4).alias("candidate_k"))


#: What makes a context hard to read, what branches in it, and numbers of documents (as surveyed, misspellings included).
COMPLEX = (
    r"(?iU)ngoại\s+trừ|trừ\s+trường\s+hợp|được\s+áp\s+dụng\s+tương\s+tự\s+nhưng|hoặc|tùy\s+thuộc\s+vào|tùy\s+theo|nếu|trường\s+hợp|trừ\s+khi|ngoài\s+ra|đồng\s+thờì|cũng\s+nhu|áp\s+dụng\s+cho|không\s+áp\s+dụng\s+cho|chỉ\s+áp\s+dụng"
)
BRANCHING = r"(?iU)hoặc\s+(?:Điều|khoản|Nghị\s+định|Luật|Thông\s+tư)|tùy\s+(?:thuộc\s+vào|theo)|theo\s+quy\s+định\s+tại\s+(?:Điều\s+\d+\s+và\s+Điều|khoản\s+\d+\s+và\s+khoản)"
EDGE_NUMBER = r"(?U)\b\d+/\d{4}/[A-ZĐ0-9\-]+\b"


def edge_confidence(context: Column, relation: Column) -> Column:
    """How sure an edge that a pattern found is, and why, as a struct: 1, less .30 for more than two document numbers in its context or .10 for two, .40
    for words that make it hard to read, .35 for branches, .05 for an exclusion, .10 below 100 characters; not below 0. Null contexts are empty."""
    c = F.coalesce(context, F.lit(""))
    n = F.regexp_count(c, F.lit(EDGE_NUMBER))
    costs = [
        (n > 2, 0.30, F.concat(F.lit("multiple_doc_numbers("), n.cast("string"), F.lit(")"))), (n == 2, 0.10, F.lit("two_doc_numbers")), (F.regexp_like(c, F.lit(COMPLEX)), 0.40, F.lit("complex_context")),
        (F.regexp_like(c, F.lit(BRANCHING)), 0.35, F.lit("branching_structure")), (F.coalesce(relation == "EXCLUDED_REF", F.lit(False)), 0.05, F.lit("excluded_ref")), (F.length(c) < 100, 0.10, F.lit("short_context")),
    ]
    score = sum((-F.when(there, cost).otherwise(0.0) for there, cost, _ in costs), F.lit(1.0))
    why = F.array_join(F.filter(F.array(*(F.when(there, name) for there, _, name in costs)), lambda x: x.isNotNull()), "; ")
    return F.struct(F.round(F.greatest(score, F.lit(0.0)), 6).alias("confidence"), F.when(why == "", "simple_explicit_ref").otherwise(why).alias("reason"))


def triage(confidence: Column, least: float = 0.95) -> Column:
    """auto_pass at or above the least confidence, else flagged for a closer look."""
    return F.when(confidence >= least, "auto_pass").otherwise("flagged")


#: Phrases by which a question's features are told.
EXACT_WORDS = ("điều", "khoản", "mục", "chương", "thông tư", "nghị định", "luật", "quyết định", "article", "section")
DEPENDS = ("vậy", "thế", "còn", "nó", "đó")
ASKS = ("là gì", "bao nhiêu", "ở đâu", "khi nào", "như thế nào", "ra sao")
TECHNICAL = ("rag", "llm", "faiss", "bm25", "api", "gpu", "cpu", "sql", "bert")


def query_features(c: Column) -> Column:
    """Features of a question as a struct: length, numbers, legal words, acronyms, dependence, question form, technical words, density of words."""
    q = F.lower(squash(c))
    t = F.regexp_extract_all(q, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(q, w))
    return F.struct(
        F.size(t).alias("query_length"), (F.size(t) <= 5).alias("is_short"), (F.size(t) >= 12).alias("is_long"), F.regexp_like(c, F.lit(r"\d")).alias("has_numbers"), has(EXACT_WORDS).alias("has_exact_pattern"),
        F.regexp_like(c, F.lit(r"(?<![\p{L}\p{N}_])[A-Z0-9]{2,10}(?![\p{L}\p{N}_])")).alias("has_acronym"), has(DEPENDS).alias("is_follow_up"), has(ASKS).alias("is_question"), has(TECHNICAL).alias("has_technical_terms"), density(t).alias("keyword_density"),
    )


def prefers_sparse(f: Column) -> Column:
    """Whether keyword search suits a question of these features better."""
    return f["has_numbers"] | f["has_exact_pattern"] | f["has_acronym"] | f["has_technical_terms"] | (f["keyword_density"] > 0.9)


def adaptive_policy(f: Column) -> Column:
    """alpha, top_k, candidate_k and fusion of a question of these features, as a struct; what comes later decides."""
    exact = f["has_exact_pattern"] | f["has_numbers"] | f["has_acronym"]
    alpha = F.when(f["query_length"] >= 12, 0.8).when(f["is_follow_up"], 0.8).when(exact, 0.3).otherwise(0.7)
    return F.struct(alpha.alias("alpha"), F.when(f["is_follow_up"], 8).otherwise(5).alias("top_k"), F.when(f["is_follow_up"], 20).otherwise(15).alias("candidate_k"), F.lit("rrf").alias("fusion_type"))


@dataclass(frozen=True)
class Topic:
    """A topic rule: what a question says, what a text must and a title may hold, its weight, and what its absence costs."""

    keywords: tuple[str, ...]
    required: tuple[str, ...]
    titles: tuple[str, ...]
    boost: float
    missing: float = 0.0


def context_scores(question: Column, text: Column, title: Column, base: Column, lexical: Column, title_match: Column, citation: Column, domain: Column, topics: list[Topic]) -> Column:
    """Signals and final score of a context as a struct. Every topic that a question (folded) names weighs the phrases of the folded text and title:
    boost for phrases that occur, less where they are missing. final: .18 base .22 lexical .18 title .06 citation .14 domain and the topics, not below 0."""
    topic, more_title, more_lexical = F.lit(0.0), F.lit(0.0), F.lit(0.0)
    count = lambda c, words: F.size(contained(c, list(words)))
    named = F.lit(False)
    for t in topics:
        asked = count(question, t.keywords) > 0
        required, words = count(text, t.required), count(text, t.keywords)
        titles = F.size(F.filter(F.array(*map(F.lit, t.titles)), lambda p: F.contains(title, p) | F.contains(text, p))) if t.titles else F.lit(0)
        found = required + titles > 0
        add = F.when(found, t.boost * F.least(F.lit(3.0), required + 0.6 * titles)).when(words > 0, F.lit(0.2 * t.boost)).otherwise(-t.missing)
        add = add + F.least(F.lit(0.12), 0.03 * words) + F.least(F.lit(0.18), 0.04 * required) - F.when(found, 0.0).otherwise(max(0.75, t.missing))
        topic = topic + F.when(asked, add).otherwise(0.0)
        more_title = more_title + F.when(asked & found, F.least(F.lit(0.45), 0.12 * titles)).otherwise(0.0)
        more_lexical = more_lexical + F.when(asked & found, F.least(F.lit(0.15), 0.03 * required)).otherwise(0.0)
        named = named | asked
    lex, tit = lexical + more_lexical, title_match + more_title
    topic = topic - F.when(named & (domain == 0) & (lex < 0.12) & (tit < 0.12), 0.12).otherwise(0.0)
    lex, tit = F.least(F.lit(1.0), lex), F.least(F.lit(1.0), tit)
    final = F.greatest(F.lit(0.0), 0.18 * base + 0.22 * lex + 0.18 * tit + 0.06 * citation + 0.14 * domain + topic)
    return F.struct(F.round(lex + 1e-9, 4).alias("lexical_overlap"), F.round(tit + 1e-9, 4).alias("title_match"), F.round(topic + 1e-9, 4).alias("topic_boost"), F.round(final + 1e-9, 6).alias("final_score"))
