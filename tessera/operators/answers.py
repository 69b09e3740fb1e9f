"""Answers: what their contexts cite, which documents and articles are relevant, sections, references, checks.

Contexts are rows with a rank within their query; lists keep that order, and of equal entries the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

#: Headings of an answer's sections, and phrases that say that it has no basis.
SECTIONS = (("ket_luan_ngan", "Kết luận ngắn"), ("can_cu_phap_luat", "Căn cứ pháp luật"), ("phan_tich_ap_dung", "Phân tích áp dụng"), ("viec_sme_nen_lam", "Việc SME nên làm"))
FORBIDDEN = (
    "context không cung cấp", "context khong cung cap", "chưa đủ căn cứ", "chưa đủ thông tin", "thiếu thông tin", "không đủ thông tin", "không đủ căn cứ", "chưa có đủ căn cứ", "không có đủ thông tin",
    "dữ liệu truy xuất không đủ", "chưa đủ dữ liệu",
)
FORBIDDEN_FORMS = (
    r"(?iu)context\s+(không|khong)\s+(cung cấp|cung cap|có|co)", r"(?iu)chưa\s+(đủ|du)\s+(căn cứ|can cu|thông tin|thong tin|dữ liệu|du lieu)", r"(?iu)thiếu\s+(thông tin|thong tin|căn cứ|can cu|dữ liệu|du lieu)",
    r"(?iu)không\s+(đủ|du|co| có)\s+(thông tin|thong tin|căn cứ|can cu|dữ liệu|du lieu)",
)
CITED = r"(Điều\s+\d+[a-zA-Z]?\s*(?:,\s*Khoản\s+\d+[a-zA-Z]?)?\s*(?:,\s*Điểm\s+\d+[a-zA-Z]?)?)"
ARTICLE = r"Điều\s+\d+[a-zA-ZăâêôơưĂÂÊÔƠƯĐđ]*"
REFERENCES = (r"(?iu)điều\s+\d+[a-zA-Z]?", r"(?iu)khoản\s+\d+[a-zA-Z]?", r"(?iu)điểm\s+[a-zA-Z]")
#: Sections and words of the answer quality check.
QUALITY_SECTIONS, PRACTICAL = ("Kết luận ngắn", "Căn cứ pháp lý", "Giải thích dễ hiểu", "Lưu ý"), "Gợi ý áp dụng thực tế"
BROAD_WORDS = ("điều kiện", "thủ tục", "nghĩa vụ", "quyền", "xử phạt")


def given(c) -> Column:
    """A column's text without blanks at the ends, null where nothing is left."""
    return F.nullif(F.trim(F.col(c) if isinstance(c, str) else c), F.lit(""))


def first_of_each(df: DataFrame, query: str, rank: str, key: list[Column], entry: Column, name: str, most: int | None = None) -> DataFrame:
    """(query, name): entries of rows in the order of their rank, of those with one key the first; rows with a null key go. Rows of a key meet before a query's do."""
    keys = [k.alias(f"_k{i}") for i, k in enumerate(key)]
    d = df.select(F.col(query), F.col(rank).alias("_r"), *keys, entry.alias("_e"))
    d = d.where(" and ".join(f"_k{i} is not null" for i in range(len(keys))))
    one = d.groupBy(query, *(f"_k{i}" for i in range(len(keys)))).agg(F.min(F.struct("_r", "_e")).alias("_x"))
    rows = F.transform(F.array_sort(F.collect_list("_x")), lambda x: x["_e"])
    return one.groupBy(query).agg((rows if most is None else F.slice(rows, 1, most)).alias(name))


def citations(contexts: DataFrame, query: str = "query_id", rank: str = "rank") -> DataFrame:
    """(query, citations): title, number, article, citation, url and rounded score of each title and article."""
    text = lambda c: F.coalesce(given(c), F.lit("")).alias(c)
    entry = F.struct(*(text(c) for c in ("doc_title", "doc_number", "article", "citation", "source_url")), F.round("score", 4).alias("score"))
    return first_of_each(contexts, query, rank, [F.coalesce("doc_title", F.lit("")), F.coalesce("article", F.lit(""))], entry, "citations")


def sources(contexts: DataFrame, query: str = "query_id", rank: str = "rank") -> DataFrame:
    """(query, sources): title, article, url of each, with the first citation."""
    key = [F.coalesce(c, F.lit("")) for c in ("doc_title", "article", "source_url")]
    return first_of_each(contexts, query, rank, key, F.struct("doc_title", "article", "source_url", "citation"), "sources")


def documents(contexts: DataFrame, query: str = "query_id", rank: str = "rank") -> DataFrame:
    """(query, docs): number|title, or what of them is given, of each number, else of each title."""
    return first_of_each(contexts, query, rank, [F.coalesce(given("doc_number"), given("doc_title"))], F.concat_ws("|", given("doc_number"), given("doc_title")), "docs")


def articles(contexts: DataFrame, query: str = "query_id", rank: str = "rank") -> DataFrame:
    """(query, articles): number|title|article, each once; rows without article go."""
    name = F.concat_ws("|", *(F.coalesce(given(c), F.lit("")) for c in ("doc_number", "doc_title")), given("article"))
    return first_of_each(contexts, query, rank, [F.when(given("article").isNotNull(), name)], name, "articles")


def article_details(contexts: DataFrame, most: int, query: str = "query_id", rank: str = "rank") -> DataFrame:
    """(query, details): the first ``most`` articles of documents, by document id and article."""
    entry = F.struct("doc_id", F.coalesce(given("doc_title"), F.lit("")).alias("doc_title"), given("article").alias("article"), given("clause").alias("clause"), F.coalesce(given("source_url"), F.lit("")).alias("source_url"))
    return first_of_each(contexts, query, rank, [F.coalesce(F.col("doc_id").cast("string"), F.lit("")), given("article")], entry, "details", most)


def first_list(*lists: Column) -> Column:
    """The first list that holds something, without blanks and repeats; else an empty one."""
    cleaned = [F.array_distinct(F.filter(c, lambda x: F.coalesce(F.trim(x), F.lit("")) != "")) for c in lists]
    return F.coalesce(*(F.when(F.size(c) > 0, c) for c in cleaned), F.expr("cast(array() as array<string>)"))


def context_quality(contexts: DataFrame, query: str = "query_id") -> DataFrame:
    """(query, score, is_relevant, reason): whether the first context's score is above 0. Queries without contexts have no row."""
    best = contexts.groupBy(query).agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("score"))
    return best.select(query, "score", (F.col("score") > 0).alias("is_relevant"), F.when(F.col("score") > 0, "ok").otherwise("low_score").alias("reason"))


def sections(answer: Column) -> Column:
    """The four numbered sections as a struct; null unless all are there."""
    found = []
    for k, (name, heading) in enumerate(SECTIONS, 1):
        end = rf"(.*?)(?=\n\s*{k + 1}\.|\z)" if k < len(SECTIONS) else "(.*)"
        pattern = rf"(?s){k}\.\s*{heading}\s*\n{end}"
        found.append(F.when(F.regexp_like(answer, F.lit(pattern)), T.strip(F.regexp_extract(answer, pattern, 1))).alias(name))
    whole = F.struct(*found)
    return F.when(F.forall(F.array(*(whole[name] for name, _ in SECTIONS)), lambda x: x.isNotNull()), whole)


def key_refs(text: Column) -> Column:
    """Articles, then clauses, then points that a text names."""
    return F.concat(*(F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), T.strip) for p in REFERENCES))


def cited(answer: Column) -> Column:
    """Citations of articles, clauses and points in an answer, each once, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(CITED), F.lit(1)), T.strip)))


def citation_report(answer: Column, selected: Column) -> Column:
    """Cited articles, selected ones that are missing, cited ones that are not selected, and ok where neither occurs and something is cited."""
    found = F.array_distinct(F.regexp_extract_all(answer, F.lit(ARTICLE), F.lit(0)))
    missing, stray = F.filter(selected, lambda x: ~F.array_contains(found, x)), F.filter(found, lambda x: ~F.array_contains(selected, x))
    return F.struct(found.alias("cited_articles"), missing.alias("missing_articles"), stray.alias("unsupported_citations"), ((F.size(missing) == 0) & (F.size(stray) == 0) & (F.size(found) > 0)).alias("ok"))


def with_basis(answer: Column, selected: Column, titles: Column, most: int = 3) -> Column:
    """The answer, led by the selected articles and their titles where its citations are not in order."""
    basis = F.array_join(F.slice(F.zip_with(selected, titles, lambda a, t: F.concat_ws(" ", a, t)), 1, most), "; ")
    return F.when(citation_report(answer, selected)["ok"] | (F.size(selected) == 0), answer).otherwise(F.concat(F.lit("Căn cứ pháp lý: Căn cứ "), basis, F.lit(".\n\n"), answer))


def quality(question: Column, answer: Column, selected: Column) -> Column:
    """The answer quality check as a struct: legal basis, warnings, practicality, clarity, and ok."""
    basis = citation_report(answer, selected)["ok"]
    generic = F.contains(F.lower(answer), F.lit("theo luật hiện hành")) & ~F.contains(answer, F.lit("Điều "))
    broad = F.exists(F.array(*map(F.lit, BROAD_WORDS)), lambda w: F.contains(F.lower(question), w)) & (F.size(selected) < 2)
    practical, clear = F.contains(answer, F.lit(PRACTICAL)), F.forall(F.array(*map(F.lit, QUALITY_SECTIONS)), lambda s: F.contains(answer, s))
    return F.struct((basis & ~generic & practical & clear).alias("ok"), basis.alias("legal_basis_ok"), generic.alias("generic_claim"), broad.alias("too_few_articles"), practical.alias("practicality_ok"), clear.alias("clarity_ok"))


def acceptable(answer: Column) -> Column:
    """Whether an answer stands: all four numbered sections, and no phrase that denies its basis (of short answers, in no form of it)."""
    complete = F.lit(True)
    for k, (_, heading) in enumerate(SECTIONS, 1):
        complete = complete & F.regexp_like(answer, F.lit(rf"(?iu){k}\.\s*{heading}"))
    denied = F.exists(F.array(*map(F.lit, FORBIDDEN)), lambda p: F.contains(F.lower(answer), p))
    form = F.lit(False)
    for p in FORBIDDEN_FORMS:
        form = form | F.regexp_like(answer, F.lit(p))
    return complete & ~denied & ((F.length(answer) > 300) | ~form)


def or_fallback(answer: Column, fallback: Column) -> Column:
    """The answer where it is acceptable, else the one made from contexts."""
    return F.when(acceptable(answer), answer).otherwise(fallback)


def diagnostics(contexts: DataFrame, query: str = "query_id", text: str = "text") -> DataFrame:
    """(query, n_contexts, n_tokens, top_score, mean_score, preview): what was selected, with scores rounded to 4 places and heads of 80 characters."""
    head = F.struct("rank", F.round("score", 4).alias("score"), F.substring(T.squash(F.col(text)), 1, 80).alias("head"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(head)), lambda x: F.concat_ws(" ", x["score"].cast("string"), x["head"])), "\n")
    return contexts.groupBy(query).agg(F.count(F.lit(1)).alias("n_contexts"), F.sum(T.token_estimate(F.col(text))).alias("n_tokens"), F.round(F.max("score"), 4).alias("top_score"), F.round(F.avg("score"), 4).alias("mean_score"), rows.alias("preview"))


def tidied(answer: Column) -> Column:
    """An answer in one line: without bold marks; of numbered sections, all but the second, without numbers and headings."""
    c = T.squash(F.replace(answer, F.lit("**"), F.lit(" ")))
    parts = F.filter(F.split(c, r"(?<![\p{L}\p{N}_])(?=[1-5]\.\s*)"), lambda p: F.regexp_like(p, F.lit(r"^\s*[1-5]\.\s*")))
    bodies = F.transform(F.filter(parts, lambda p: ~F.regexp_like(p, F.lit(r"^\s*2\."))), lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"^\s*[1-5]\.\s*", ""), r"^[^:]{0,80}:\s*", "")))
    kept = F.filter(bodies, lambda b: b != "")
    headings = "|".join(h for h in ("Kết luận ngắn", "Phân tích áp dụng vào tình huống", "Việc SME nên làm", "Lưu ý/rủi ro"))
    plain = F.regexp_replace(c, rf"(?iu)(?:\b\d+\.\s*)?(?<![\p{{L}}])(?:{headings})\s*:\s*", "")
    plain = F.regexp_replace(F.regexp_replace(plain, r"(?iu)\b\d+\.\s*Căn cứ pháp luật\s*:.*?(?=(\b\d+\.\s*\p{L}|$))", " "), r"(?iu)(?<![\p{L}])Căn cứ pháp luật\s*:.*$", " ")
    plain = F.regexp_replace(plain, r"\b\d+\.\s*", " ")
    out = F.when((F.size(parts) >= 2) & (F.size(kept) > 0), F.array_join(kept, " ")).otherwise(plain)
    return F.regexp_replace(T.squash(out), r"^[ ,;:\-]+|[ ,;:\-]+$", "")
