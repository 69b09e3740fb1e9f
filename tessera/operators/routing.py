"""Routing questions: domains, types, routes, how sure a result is, and which level of search to go to.

Rules are phrases that a folded question (lower case, no accents) holds. Defaults are given; others can be passed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

#: Phrases of each domain, folded. A phrase that holds a shorter one of its list decides nothing more and is left out.
DOMAINS = {
    "investment_law": ("nha dau tu nuoc ngoai", "nguoi nuoc ngoai", "fdi", "irc", "giay chung nhan dang ky dau tu"),
    "tax_law": ("thue", "hoa don", "chung tu"),
    "accounting_law": ("ke toan", "bao cao tai chinh", "hach toan", "du phong", "quyet toan", "kiem toan"),
    "labor_law": ("nguoi lao dong", "nhan vien", "hop dong lao dong", "thu viec", "sa thai", "lam them gio", "luong", "giu ban chinh", "an toan ve sinh lao dong", "nghi viec", "nghi phep", "bao hiem lao dong", "phu cap", "thoi gio lam viec"),
    "social_insurance": ("bhxh", "bao hiem xa hoi", "bhyt", "bao hiem y te", "bhtn", "bao hiem that nghiep", "bao hiem tu nguyen", "dong bao hiem", "truy thu bao hiem"),
    "administrative_penalty": ("xu phat", "bi phat", "muc phat", "vi pham hanh chinh", "khac phuc hau qua", "che tai", "phat tien", "phat canh cao", "tich thu"),
    "civil_commercial_law": ("hop dong", "thuong mai", "nhuong quyen", "logistics", "boi thuong", "tranh chap"),
    "ip_law": ("so huu tri tue", "so huu cong nghiep", "nhan hieu", "sang che", "kieu dang cong nghiep", "quyen tac gia", "ten thuong mai", "chi dan dia ly", "van bang bao ho", "tham dinh noi dung"),
}
#: Phrases of the main domain, folded, and its name.
MAIN_DOMAIN = "business_law"
MAIN_PHRASES = (
    "doanh nghiep", "sme", "dnvv", "ho kinh doanh", "cong ty", "thanh lap", "dang ky", "giai the", "chuyen doi", "hop nhat", "co dong", "thanh vien", "ban quan ly", "hoi dong", "von dieu le", "loai hinh", "hop danh", "uu dai", "ho tro",
    "thu tuc", "giay phep", "dieu kien",
)
#: The family of each domain.
FAMILIES = {
    "tax_law": "tax_accounting", "accounting_law": "tax_accounting", "labor_law": "labor_social", "social_insurance": "labor_social", "ip_law": "ip", "civil_commercial_law": "commercial", "investment_law": "investment",
    "administrative_penalty": "penalty",
}
#: Routes from the narrowest to the widest, and what each needs.
SIMPLE, PARENT, GRAPH, CROSS, MULTI = "SIMPLE_VECTOR", "PARENT_CONTEXT", "LEGAL_GRAPH_CONTEXT", "CROSS_DOMAIN_CONTEXT", "MULTI_DOMAIN_COMPLEX"
NEEDS = {"needs_parent": (PARENT, GRAPH, CROSS, MULTI), "needs_neighbor": (MULTI,), "needs_graph": (GRAPH, CROSS, MULTI), "needs_cross_domain": (CROSS, MULTI)}
#: Triggers of routes.
BROAD = ("toan bo", "nhung viec gi", "can lam gi", "cac nghia vu", "can nhung van ban nao", "so sanh")
RELATION = ("lien quan", "can cu", "theo quy dinh tai", "huong dan boi", "sua doi", "bo sung", "thay the", "het hieu luc", "con hieu luc", "ngoai le", "tru truong hop")
GROUNDING = ("dieu", "khoan", "diem", "doi tuong nao", "truong hop nao", "quyen", "nghia vu", "ai khong duoc", "xu phat", "bi phat", "muc phat")
SEVERAL = ("dong thoi", "ket hop", "bao gom ca", "lien quan den", "vua ... vua", "nhuong quyen thuong mai", "xuat nhap khau")
#: Phrases of question types (not folded), and the words that each type adds to a question.
TYPES = {
    "dinh_nghia": ("là gì", "là ai", "định nghĩa", "khái niệm", "thế nào là", "hiểu như thế nào", "được hiểu là", "bao gồm những gì"),
    "muc_phat": ("mức phạt", "xử phạt", "vi phạm", "phạt tiền", "mức xử phạt", "hình thức xử phạt", "biện pháp khắc phục", "phạt cảnh cáo", "phạt bổ sung"),
    "so_sanh": ("so sánh", "khác nhau", "phân biệt", "giống và khác", "ưu điểm", "nhược điểm"),
    "thu_tuc": ("thủ tục", "đăng ký", "xin cấp", "xin giấy", "trình tự", "hồ sơ", "thẩm quyền", "cấp giấy", "gia hạn"),
}
ADDED = {
    "co_so_hieu": "số hiệu văn bản văn bản số điều khoản", "dinh_nghia": "quy định theo quy định của pháp luật", "muc_phat": "mức phạt tiền xử phạt vi phạm hành chính chế tài", "so_sanh": "so sánh khác biệt phân biệt đối chiếu",
    "thu_tuc": "thủ tục hành chính trình tự thực hiện hồ sơ",
}
#: What shows that a text is legal.
SIGNALS = ("dieu ", "khoan ", "diem ", "luat ", "nghi dinh", "can cu", "trach nhiem", "xu phat", "muc phat", "hieu luc")
#: Reasons against a result, and what each takes from its score.
PENALTIES = {
    "top_score_below_threshold": 0.22, "insufficient_seed_chunks": 0.16, "weak_score_gap": 0.12, "missing_legal_citation": 0.14, "missing_source_url": 0.08, "missing_legal_signal": 0.12, "satellite_domain_mismatch": 0.15,
    "penalty_context_mismatch": 0.12, "procedure_context_mismatch": 0.12, "effective_status_mismatch": 0.12,
}
#: A question with one of the first phrases wants contexts with one of the second ones.
WANTED = {
    "penalty_context_mismatch": (("bi phat", "xu phat", "muc phat"), ("phat", "vi pham", "che tai", "nghi dinh")),
    "procedure_context_mismatch": (("thu tuc", "ho so", "trinh tu"), ("thu tuc", "ho so", "trinh tu", "dang ky")),
    "effective_status_mismatch": (("hieu luc",), ("hieu luc", "ap dung")),
}
#: Marks of a question that depends on what was said, of a legal one, and of an abstract one.
FOLLOW_UP = ("vậy", "còn", "trường hợp đó", "quy định này", "luật này", "điều đó", "nó", "ở đây", "trong trường hợp này")
ANAPHORA = ("đó", "này", "nó", "như vậy")
LEGAL_WORDS = ("điều", "khoản", "luật", "nghị quyết", "nghị định", "thông tư", "thẩm quyền", "hiệu lực", "ban hành", "quy phạm pháp luật")
ABSTRACT = ("thế nào", "là gì", "giải thích", "ý nghĩa", "nguyên tắc")
ARTICLE_REF = r"(?iu)(?<![\p{L}\p{N}_])(điều|khoản|điểm)\s+\d+[a-zA-Z0-9/-]*"
#: Levels of search in order, and the least score that each is content with.
LEVELS = {"simple_dense": 0.68, "rewrite_dense": 0.72, "hybrid": 0.78, "hybrid_rerank": 0.82, "full_optimal": 0.86, "hyde": 1.01}


def holds(c: Column, phrases) -> Column:
    """Whether a text holds one of the phrases."""
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(c, F.lit(p))
    return out


def _given(*items: Column) -> Column:
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def domains(question: Column, rules: dict[str, tuple[str, ...]] | None = None, taxonomy: dict[str, list[str]] | None = None) -> Column:
    """Domains of a question, in order: the main one where its phrases occur or no other does, then those of the rules, then those of a taxonomy,
    whose keywords are folded as the question is."""
    q = T.fold(question)
    main = holds(q, MAIN_PHRASES)
    named = [F.when(holds(q, words), F.lit(d)) for d, words in (rules or DOMAINS).items()]
    named += [F.when(holds(q, [T.folded(w) for w in words]), F.lit(d)) for d, words in (taxonomy or {}).items() if d != MAIN_DOMAIN]
    named.append(F.when(F.contains(q, F.lit("nuoc ngoai")) & holds(q, ("gop von", "dau tu")), F.lit("investment_law")))
    others = F.array_distinct(_given(*named))
    return F.when(main | (F.size(others) == 0), F.concat(F.array(F.lit(MAIN_DOMAIN)), others)).otherwise(others)


def families(found: Column, names: dict[str, str] | None = None) -> Column:
    """Families of domains, sorted, each once."""
    table = F.create_map(*(F.lit(x) for pair in (names or FAMILIES).items() for x in pair))
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, lambda d: F.try_element_at(table, d)), lambda x: x.isNotNull())))


def needs(route: Column) -> list[Column]:
    """What a route needs: parents, neighbours, the graph, other domains."""
    return [route.isin(*routes).alias(name) for name, routes in NEEDS.items()]


def route(df: DataFrame, question: str, seed_domains: str | None = None, taxonomy: dict[str, list[str]] | None = None) -> DataFrame:
    """Adds domains (also those of seed chunks), route and what it needs. Broad questions over several families are complex; several families
    or a phrase that joins subjects cross domains; then relations, then what wants an article or touches another domain."""
    q = T.fold(F.col(question))
    found = domains(F.col(question), None, taxonomy)
    if seed_domains:
        found = F.array_distinct(F.concat(found, F.filter(F.coalesce(F.col(seed_domains), F.expr("cast(array() as array<string>)")), lambda d: F.coalesce(d, F.lit("")) != "")))
    out = df.withColumn("domains", found)
    others = F.filter("domains", lambda d: d != MAIN_DOMAIN)
    wide = F.size(F.array_remove(families(others), "penalty")) > 1
    chosen = (
        F.when(holds(q, BROAD) & (holds(q, SEVERAL) | wide), MULTI).when(holds(q, SEVERAL) | wide, CROSS).when(holds(q, RELATION), GRAPH)
        .when(holds(q, GROUNDING) | (F.size(others) > 0), PARENT).otherwise(SIMPLE)
    )
    return out.withColumn("route", chosen).select("*", *needs(F.col("route")))


def types(question: Column) -> Column:
    """Types of a question, sorted; one with a legal number has a type of its own."""
    low = F.lower(question)
    numbered = F.when(F.regexp_like(question, F.lit(T.LEGAL_REF)), F.lit("co_so_hieu"))
    return F.array_sort(_given(numbered, *(F.when(holds(low, words), F.lit(t)) for t, words in TYPES.items())))


def type_flags(found: Column) -> list[Column]:
    """has_legal_ref, is_specific and boost_exact of types()."""
    ref = F.array_contains(found, "co_so_hieu")
    return [ref.alias("has_legal_ref"), (ref | F.array_contains(found, "muc_phat") | F.array_contains(found, "thu_tuc")).alias("is_specific"), ref.alias("boost_exact")]


def with_type_words(question: Column, found: Column) -> Column:
    """The question and the words that its types add, unless it ends in them already."""
    table = F.create_map(*(F.lit(x) for pair in ADDED.items() for x in pair))
    extra = F.array_join(F.transform(found, lambda t: F.try_element_at(table, t)), " ")
    return F.when((extra == "") | F.endswith(question, extra), question).otherwise(F.concat(question, F.lit(" "), extra))


def has_legal_signal(text: Column) -> Column:
    return holds(T.fold(text), SIGNALS)


def recommended(question: Column, current: Column, n_domains: Column, reasons: Column) -> Column:
    """The route to go on with, from the question, the route now, and the reasons against the result."""
    q = T.fold(question)
    steps = ("can lam gi", "nhung viec gi", "ho so", "trinh tu", "thu tuc")
    mixed = (n_domains > 1) | F.array_contains(reasons, "satellite_domain_mismatch")
    return (
        F.when(holds(q, ("toan bo", "nhung viec gi", "can lam gi", "so sanh")), MULTI)
        .when(mixed & (current == CROSS) & holds(q, steps), MULTI).when(mixed, CROSS)
        .when(holds(q, ("sua doi", "bo sung", "thay the", "het hieu luc", "con hieu luc", "theo quy dinh tai", "can cu", "ngoai le", "tru truong hop")), GRAPH)
        .when(holds(q, ("bi phat", "xu phat", "muc phat", "hieu luc", "thu tuc", "ho so")), F.when(current == PARENT, GRAPH).otherwise(CROSS))
        .when(holds(q, ("dieu", "khoan", "diem", "doi tuong nao", "truong hop nao", "ai khong duoc")), PARENT)
        .when(current == SIMPLE, PARENT).when((current == PARENT) & F.array_contains(reasons, "weak_score_gap"), GRAPH).otherwise(current)
    )


def check(questions: DataFrame, seeds: DataFrame, taxonomy: dict[str, list[str]] | None = None, least: float = 0.55, least_gap: float = 0.03, least_seeds: int = 2) -> DataFrame:
    """Per question: score, reasons against its seeds, whether it is confident (no reason at all), the recommended route and whether to
    go there. questions: query_id, question, route. seeds: query_id, rank, score, content, doc_title, citation, article, source_url;
    texts and metadata of the first three ranks count."""
    parts = F.array_join(F.filter(F.array(*(F.trim(F.coalesce(c, F.lit(""))) for c in ("content", "doc_title", "citation", "article"))), lambda x: x != ""), " ")
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    first = F.col("rank") <= 3
    rows = F.array_sort(F.collect_list(F.when(first, F.struct(F.col("rank").alias("r"), parts.alias("t")))))
    tops = seeds.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"),
        F.bool_or(first & given("citation") & given("article")).alias("cited"), F.bool_or(first & given("source_url")).alias("sourced"), F.array_join(F.transform(rows, lambda x: x["t"]), " ").alias("texts"),
    )
    d = questions.join(tops, "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("top", F.coalesce("top", F.lit(0.0))).withColumn("texts", F.coalesce("texts", F.lit("")))
    d = d.withColumn("gap", F.when(F.col("n") > 1, F.col("top") - F.col("second")).otherwise(0.0)).withColumn("_domains", domains(F.col("question"), None, taxonomy))
    q, t = T.fold(F.col("question")), T.fold(F.col("texts"))
    satellites = F.filter("_domains", lambda x: x != MAIN_DOMAIN)
    matching = F.lit(False)
    for name, words in (taxonomy or {}).items():
        matching = matching | (F.array_contains(satellites, name) & holds(t, [T.folded(w) for w in words]))
    against = [
        F.when(F.col("top") < least, "top_score_below_threshold"), F.when(F.col("n") < least_seeds, "insufficient_seed_chunks").when(F.col("gap") < least_gap, "weak_score_gap"),
        F.when(~F.coalesce("cited", F.lit(False)), "missing_legal_citation"), F.when(~F.coalesce("sourced", F.lit(False)), "missing_source_url"),
        F.when((F.col("n") > 0) & ~has_legal_signal(F.col("texts")), "missing_legal_signal"), F.when((F.size(satellites) > 0) & ~matching, "satellite_domain_mismatch"),
        *(F.when(holds(q, asked) & ~holds(t, wanted), F.lit(name)) for name, (asked, wanted) in WANTED.items()),
    ]
    d = d.withColumn("_reasons", _given(*against))
    cost = F.create_map(*(F.lit(x) for pair in PENALTIES.items() for x in pair))
    value = F.round(F.greatest(F.lit(0.0), 1.0 - F.aggregate("_reasons", F.lit(0.0), lambda s, r: s + cost[r])), 4)
    d = d.withColumn("confidence_score", value).withColumn("is_confident", (F.col("confidence_score") >= 0.55) & (F.size("_reasons") == 0))
    d = d.withColumn("recommended_route", recommended(F.col("question"), F.col("route"), F.size("_domains"), F.col("_reasons")))
    return d.select("query_id", F.array_join("_reasons", ",").alias("reasons"), "confidence_score", "is_confident", "recommended_route", (~F.col("is_confident") & (F.col("recommended_route") != F.col("route"))).alias("should_escalate"), F.round("top", 4).alias("top_score"), F.round("gap", 4).alias("score_gap"), F.col("n").alias("seed_chunk_count"))


def complexity(question: Column, n_turns: Column) -> Column:
    """Signals of a question as a struct: dependence on the history, marks of complexity, legal words and references, abstraction."""
    q = F.lower(T.squash(question))
    words = F.when(q == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(q, " "))
    n, ref = F.size(words), F.regexp_like(q, F.lit(ARTICLE_REF))
    followed, anaphora = holds(q, FOLLOW_UP), holds(q, ANAPHORA)
    times = lambda mark: F.length(q) - F.length(F.replace(q, F.lit(mark), F.lit("")))
    marks = [n >= 12, times("?") >= 2, F.array_contains(words, "và") | F.array_contains(words, "hoặc"), ref, times(",") >= 2]
    score = sum((m.cast("int") for m in marks), F.lit(0))
    needs_history = (n_turns > 0) & (followed | anaphora)
    return F.struct(
        (~needs_history).alias("is_standalone"), needs_history.alias("needs_history"), anaphora.alias("has_anaphora"), ((score >= 2) | (n >= 18)).alias("is_complex"), ((score >= 4) | (n >= 28)).alias("is_very_complex"),
        (holds(q, ABSTRACT) & ~ref).alias("is_abstract"), n.alias("question_length"), holds(q, LEGAL_WORDS).alias("has_legal_keywords"), ref.alias("has_article_reference"), followed.alias("has_followup_markers"),
    )


def first_level(signals: Column) -> Column:
    """The level of search to begin with."""
    return F.when(signals["is_very_complex"], "full_optimal").when(signals["has_followup_markers"] | signals["needs_history"], "rewrite_dense").when(signals["is_complex"], "hybrid").otherwise("simple_dense")


def next_level(level: Column) -> Column:
    """The level after this one; null after the last."""
    names = list(LEVELS)
    return F.coalesce(*(F.when(level == a, F.lit(b)) for a, b in zip(names, names[1:])))


def escalates(level: Column, n: Column, n_distinct: Column, low_diversity: Column, score: Column) -> Column:
    """Whether to go on to the next level: without results or ids, for few different ids on the three lower levels, or below the level's score."""
    least = F.coalesce(*(F.when(level == name, F.lit(x)) for name, x in LEVELS.items()))
    return (level != "hyde") & ((n == 0) | (n_distinct == 0) | (low_diversity & level.isin("simple_dense", "rewrite_dense", "hybrid")) | (score < least))


def first_confident(results: DataFrame) -> DataFrame:
    """Of each query's results by level (query_id, level, n, n_distinct, low_diversity, score), the first level that does not escalate, else the last one tried."""
    order = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level"))
    r = results.withColumn("_at", order).withColumn("_on", escalates(F.col("level"), F.col("n"), F.col("n_distinct"), F.col("low_diversity"), F.col("score")))
    best = F.coalesce(F.min(F.when(~F.col("_on"), F.col("_at"))), F.max("_at"))
    return r.groupBy("query_id").agg(F.element_at(F.array(*map(F.lit, LEVELS)), best.cast("int")).alias("level"), F.bool_and("_on").alias("exhausted"))
