"""Queries of routing, articles, answers, validity and collections. Fixture texts are led or followed by phrases that the rules speak of."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import web
from tessera.operators import answers, articles, bm25, fusion, relations, routing, rules, topics, validity, vectors
from tessera.plans import ranking
from tessera.plans.ranking import LISTS, MERGED
from tessera.plans.registry import registrar, sql_tokens
from tessera.plans.texts import FOLD
from tessera.session import read

QUERIES: dict = {}
ORACLE: dict = {}
query = registrar(QUERIES, ORACLE)

PHRASES = [
    "thủ tục đăng ký doanh nghiệp là gì", "mức phạt tiền khi chậm đóng bảo hiểm xã hội", "toàn bộ hồ sơ thuế và hợp đồng lao động", "so sánh nhãn hiệu và sáng chế", "Nghị định 45/2019/NĐ-CP còn hiệu lực",
    "Điều 5 khoản 2, điểm a, hoặc điều 7? Quy định này thế nào?", "nhà đầu tư nước ngoài góp vốn", "nhượng quyền thương mại liên quan đến logistics", "vậy còn trường hợp đó", "hóa đơn điện tử", "căn cứ sửa đổi, bổ sung", "ok",
]
_LIST = "[" + ", ".join(f"'{p}'" for p in PHRASES) + "]"
ASKED = f"q0 as (select item_id, p, text || ' ' || phrase as question from benchmark, (select unnest(range({len(PHRASES)}))::int as p, unnest({_LIST}) as phrase)), q as (select *, {FOLD.format('question')} as f, lower(question) as l from q0)"


def any_of(c: str, words) -> str:
    return "(" + " or ".join(f"contains({c}, '{w}')" for w in words) + ")" if words else "false"


def given(items: list[str]) -> str:
    return f"[x for x in [{', '.join(items)}] if x is not null]"


def _asked(spark, d):
    """Each benchmark item with each phrase."""
    pairs = read(spark, d, "benchmark").select("item_id", "text", F.posexplode(F.array(*map(F.lit, PHRASES))).alias("p", "phrase"))
    return pairs.select("item_id", "p", F.concat_ws(" ", "text", "phrase").alias("question"))


#: DuckDB's list_distinct loses the order; of equal entries the first stays here.
_RAW = given([*(f"case when {any_of('f', w)} then '{d}' end" for d, w in routing.DOMAINS.items()), "case when contains(f, 'nuoc ngoai') and (contains(f, 'gop von') or contains(f, 'dau tu')) then 'investment_law' end"])
_FAMILY = "case x " + " ".join(f"when '{a}' then '{b}'" for a, b in routing.FAMILIES.items()) + " end"
DOMAINS = f"""d0 as (select *, {_RAW} as o0 from q), d1 as (select *, [o0[i] for i in range(1, len(o0) + 1) if list_position(o0, o0[i]) = i] as o from d0),
d2 as (select *, case when {any_of('f', routing.MAIN_PHRASES)} or len(o) = 0 then list_concat(['business_law'], o) else o end as domains, list_sort(list_distinct([{_FAMILY} for x in o])) as families from d1)"""
_WIDE = "len([x for x in families if x <> 'penalty']) > 1"
ROUTE = f"case when {any_of('f', routing.BROAD)} and ({any_of('f', routing.SEVERAL)} or {_WIDE}) then 'MULTI_DOMAIN_COMPLEX' when {any_of('f', routing.SEVERAL)} or {_WIDE} then 'CROSS_DOMAIN_CONTEXT' when {any_of('f', routing.RELATION)} then 'LEGAL_GRAPH_CONTEXT' when {any_of('f', routing.GROUNDING)} or len(o) > 0 then 'PARENT_CONTEXT' else 'SIMPLE_VECTOR' end"
_NEEDS = ", ".join(f"route in ({', '.join(repr(r) for r in routes)}) as {name}" for name, routes in routing.NEEDS.items())


@query(f"with {ASKED}, {DOMAINS}, r as (select *, {ROUTE} as route from d2) select item_id, p, array_to_string(domains, ',') as domains, array_to_string(families, ',') as families, route, {_NEEDS} from r")
def query_routing(spark, d):
    r = routing.route(_asked(spark, d), "question")
    return r.select("item_id", "p", F.array_join("domains", ",").alias("domains"), F.array_join(routing.families(F.col("domains")), ",").alias("families"), "route", *routing.NEEDS)


_TYPES = "list_sort(" + given(["case when regexp_matches(question, '(?i)\\d+(?:/\\d+)*(?:-[A-Z]+)*/[A-Z0-9À-ỴĂÂĐÊÔƠƯ\\-]+') then 'co_so_hieu' end", *(f"case when {any_of('l', w)} then '{t}' end" for t, w in routing.TYPES.items())]) + ")"
_ADD = "case x " + " ".join(f"when '{a}' then '{b}'" for a, b in routing.ADDED.items()) + " end"


@query(f"""with {ASKED}, t as (select *, {_TYPES} as t from q), a as (select *, array_to_string([{_ADD} for x in t], ' ') as a from t)
select item_id, p, array_to_string(t, ',') as types, list_contains(t, 'co_so_hieu') as has_legal_ref, list_contains(t, 'co_so_hieu') or list_contains(t, 'muc_phat') or list_contains(t, 'thu_tuc') as is_specific, list_contains(t, 'co_so_hieu') as boost_exact, md5(case when a = '' or ends_with(question, a) then question else question || ' ' || a end) as enriched from a""")
def query_types(spark, d):
    t = _asked(spark, d).withColumn("t", routing.types(F.col("question")))
    return t.select("item_id", "p", F.array_join("t", ",").alias("types"), *routing.type_flags(F.col("t")), F.md5(routing.with_type_words(F.col("question"), F.col("t"))).alias("enriched"))


_W = "case when trim(regexp_replace(l, '\\s+', ' ', 'g')) = '' then [] else string_split(trim(regexp_replace(l, '\\s+', ' ', 'g')), ' ') end"
_N = lambda mark: f"(length(l) - length(replace(l, '{mark}', '')))"


@query(f"""with {ASKED}, w as (select *, {_W} as w, regexp_matches(l, '(^|[^\\p{{L}}\\p{{N}}_])(điều|khoản|điểm)\\s+\\d+') as ref, {any_of('l', routing.FOLLOW_UP)} as followed, {any_of('l', routing.ANAPHORA)} as anaphora from q),
m as (select *, (len(w) >= 12)::int + ({_N('?')} >= 2)::int + (list_contains(w, 'và') or list_contains(w, 'hoặc'))::int + ref::int + ({_N(',')} >= 2)::int as m, p % 2 > 0 and (followed or anaphora) as needs from w),
s as (select *, m >= 2 or len(w) >= 18 as complex, m >= 4 or len(w) >= 28 as very, case when m >= 4 or len(w) >= 28 then 'full_optimal' when followed or needs then 'rewrite_dense' when m >= 2 or len(w) >= 18 then 'hybrid' else 'simple_dense' end as level from m)
select item_id, p, needs as needs_history, complex as is_complex, very as is_very_complex, {any_of('l', routing.ABSTRACT)} and not ref as is_abstract, len(w)::bigint as question_length, {any_of('l', routing.LEGAL_WORDS)} as has_legal_keywords, ref as has_article_reference, level,
case level when 'simple_dense' then 'rewrite_dense' when 'rewrite_dense' then 'hybrid' when 'hybrid' then 'hybrid_rerank' when 'full_optimal' then 'hyde' end as next from s""")
def adaptive_route(spark, d):
    s = _asked(spark, d).withColumn("s", routing.complexity(F.col("question"), F.col("p") % 2))
    names = ("needs_history", "is_complex", "is_very_complex", "is_abstract", "question_length", "has_legal_keywords", "has_article_reference")
    s = s.withColumn("level", routing.first_level(F.col("s")))
    return s.select("item_id", "p", *(F.col(f"s.{n}").cast("long").alias(n) if n == "question_length" else F.col(f"s.{n}") for n in names), "level", routing.next_level(F.col("level")).alias("next"))


_LEVELS = "[" + ", ".join(f"'{x}'" for x in routing.LEVELS) + "]"
_LEAST = "[" + ", ".join(str(x) for x in routing.LEVELS.values()) + "]"


@query(f"""with r as (select distinct o_custkey as query_id, (o_orderkey % 6)::int + 1 as lv from orders), x as (select query_id, lv, (query_id + lv) % 5 as n, (query_id * lv) % 4 as k, (query_id + lv) % 7 = 0 as low, ((query_id * 31 + lv * 17) % 100) / 100 as score from r),
e as (select *, lv <> 6 and (n = 0 or k = 0 or (low and lv <= 3) or score < {_LEAST}[lv]) as goes from x)
select query_id, {_LEVELS}[coalesce(min(lv) filter (not goes), max(lv))] as level, bool_and(goes) as exhausted from e group by query_id""")
def first_confident_level(spark, d):
    r = read(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), ((F.col("o_orderkey") % 6).cast("int") + 1).alias("at")).distinct()
    level = F.element_at(F.array(*map(F.lit, routing.LEVELS)), F.col("at"))
    x = r.select("query_id", level.alias("level"), ((F.col("query_id") + F.col("at")) % 5).alias("n"), (F.col("query_id") * F.col("at") % 4).alias("n_distinct"), ((F.col("query_id") + F.col("at")) % 7 == 0).alias("low_diversity"), ((F.col("query_id") * 31 + F.col("at") * 17) % 100 / 100).alias("score"))
    return routing.first_confident(x)


#: Contexts of each question: the best documents by shared tokens, with metadata made of their own columns.
CONTEXTS = f"{LISTS}, x as (select b.query_id, b.doc_id, b.score, b.rank, d.text, d.source as doc_title, case when d.doc_id % 4 <> 0 then d.lang end as doc_number, case when d.doc_id % 3 <> 0 then 'Điều ' || (d.doc_id % 5) end as article, case when d.doc_id % 2 = 0 then 'c' || (d.doc_id % 2) end as citation, case when d.doc_id % 5 <> 0 then 'u' || (d.doc_id % 7) end as source_url, 'k' || (d.doc_id % 2) as clause from b join documents d using (doc_id) where b.rank <= 10)"


def _contexts(spark, d):
    i = F.col("doc_id")
    top = ranking._shared(spark, d, 10).join(read(spark, d, "documents").select("doc_id", "text", F.col("source").alias("doc_title"), "lang"), "doc_id")
    made = {"doc_number": F.when(i % 4 != 0, F.col("lang")), "article": F.when(i % 3 != 0, F.concat(F.lit("Điều "), (i % 5).cast("string"))), "citation": F.when(i % 2 == 0, F.concat(F.lit("c"), (i % 2).cast("string")))}
    made |= {"source_url": F.when(i % 5 != 0, F.concat(F.lit("u"), (i % 7).cast("string"))), "clause": F.concat(F.lit("k"), (i % 2).cast("string"))}
    return top.withColumns(made)


_ROUTES = "['SIMPLE_VECTOR', 'PARENT_CONTEXT', 'LEGAL_GRAPH_CONTEXT', 'CROSS_DOMAIN_CONTEXT', 'MULTI_DOMAIN_COMPLEX']"
TAXONOMY = {"ip_law": ["nhan hieu", "the"], "tax_law": ["und", "thue"]}


def _recommended(f: str) -> str:
    mixed = "(len(domains) > 1 or list_contains(reasons, 'satellite_domain_mismatch'))"
    w = lambda *x: any_of(f, x)
    return (
        f"case when {w('toan bo', 'nhung viec gi', 'can lam gi', 'so sanh')} then 'MULTI_DOMAIN_COMPLEX' when {mixed} and route = 'CROSS_DOMAIN_CONTEXT' and {w('can lam gi', 'nhung viec gi', 'ho so', 'trinh tu', 'thu tuc')} then 'MULTI_DOMAIN_COMPLEX' when {mixed} then 'CROSS_DOMAIN_CONTEXT' "
        f"when {w('sua doi', 'bo sung', 'thay the', 'het hieu luc', 'con hieu luc', 'theo quy dinh tai', 'can cu', 'ngoai le', 'tru truong hop')} then 'LEGAL_GRAPH_CONTEXT' when {w('bi phat', 'xu phat', 'muc phat', 'hieu luc', 'thu tuc', 'ho so')} then case when route = 'PARENT_CONTEXT' then 'LEGAL_GRAPH_CONTEXT' else 'CROSS_DOMAIN_CONTEXT' end "
        f"when {w('dieu', 'khoan', 'diem', 'doi tuong nao', 'truong hop nao', 'ai khong duoc')} then 'PARENT_CONTEXT' when route = 'SIMPLE_VECTOR' then 'PARENT_CONTEXT' when route = 'PARENT_CONTEXT' and list_contains(reasons, 'weak_score_gap') then 'LEGAL_GRAPH_CONTEXT' else route end"
    )


_REASONS = given([
    "case when coalesce(top, 0) < 0.55 then 'top_score_below_threshold' end", "case when coalesce(n, 0) < 2 then 'insufficient_seed_chunks' when top - second < 0.03 then 'weak_score_gap' end", "case when not coalesce(cited, false) then 'missing_legal_citation' end",
    "case when not coalesce(sourced, false) then 'missing_source_url' end", f"case when n > 0 and not {any_of('t', routing.SIGNALS)} then 'missing_legal_signal' end",
    f"case when len(sat) > 0 and not ((list_contains(sat, 'ip_law') and {any_of('t', TAXONOMY['ip_law'])}) or (list_contains(sat, 'tax_law') and {any_of('t', TAXONOMY['tax_law'])})) then 'satellite_domain_mismatch' end",
    *(f"case when {any_of('f', a)} and not {any_of('t', b)} then '{name}' end" for name, (a, b) in routing.WANTED.items()),
])
_COST = "case r " + " ".join(f"when '{a}' then {b}" for a, b in routing.PENALTIES.items()) + " end"
_TAX = [f"case when {any_of('f', w)} then '{d}' end" for d, w in TAXONOMY.items()]


@query(f"""{CONTEXTS}, aq0 as (select item_id as query_id, text || ' ' || {_LIST}[item_id % {len(PHRASES)} + 1] as question, {_ROUTES}[item_id % 5 + 1] as route from benchmark), aq as (select *, {FOLD.format('question')} as f from aq0),
d0 as (select *, {given(_RAW[len('[x for x in ['):-len('] if x is not null]')].split(", case when contains(f, 'nuoc ngoai')")[:1] + _TAX + ["case when contains(f, 'nuoc ngoai') and (contains(f, 'gop von') or contains(f, 'dau tu')) then 'investment_law' end"])} as o0 from aq),
d1 as (select *, [o0[i] for i in range(1, len(o0) + 1) if list_position(o0, o0[i]) = i] as sat from d0), d2 as (select *, case when {any_of('f', routing.MAIN_PHRASES)} or len(sat) = 0 then list_concat(['business_law'], sat) else sat end as domains from d1),
s as (select query_id, count(*) as n, max(score) filter (rank = 1) as top, max(score) filter (rank = 2) as second, bool_or(rank <= 3 and citation is not null and article is not null) as cited, bool_or(rank <= 3 and source_url is not null) as sourced, string_agg(array_to_string([y for y in [trim(text), doc_title, citation, article] if coalesce(y, '') <> ''], ' '), ' ' order by rank) filter (rank <= 3) as texts from x where rank <= query_id % 4 group by query_id),
j as (select *, {FOLD.format("coalesce(texts, '')")} as t from d2 left join s using (query_id)), r as (select *, {_REASONS} as reasons from j),
c as (select *, round(greatest(0.0, 1.0 - coalesce(list_sum([{_COST} for r in reasons]), 0)), 4)::double as confidence_score, {_recommended('f')} as recommended_route from r)
select query_id, array_to_string(reasons, ',') as reasons, confidence_score, confidence_score >= 0.55 and len(reasons) = 0 as is_confident, recommended_route, not (confidence_score >= 0.55 and len(reasons) = 0) and recommended_route <> route as should_escalate, round(coalesce(top, 0), 4) as top_score, round(case when n > 1 then top - second else 0 end, 4)::double as score_gap, coalesce(n, 0)::bigint as seed_chunk_count from c""")
def confidence_check(spark, d):
    b = read(spark, d, "benchmark")
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), (F.col("item_id") % len(PHRASES) + 1).cast("int"))
    route = F.element_at(F.array(*(F.lit(r) for r in (routing.SIMPLE, routing.PARENT, routing.GRAPH, routing.CROSS, routing.MULTI))), (F.col("item_id") % 5 + 1).cast("int"))
    q = b.select(F.col("item_id").alias("query_id"), F.concat_ws(" ", "text", phrase).alias("question"), route.alias("route"))
    seeds = _contexts(spark, d).where("rank <= query_id % 4").withColumn("content", F.col("text"))
    return routing.check(q, seeds, TAXONOMY)


@query(f"""{LISTS}, u as (select query_id, doc_id, 1 / (60 + rank - 1) as part, 'a' as s from a union all select query_id, doc_id, 1 / (60 + rank - 1), 'b' from b), m as (select query_id, doc_id, round(sum(part), 6) as rrf_sum, count(distinct s)::int as n_sources from u group by all),
g as (select m.*, coalesce(b.score, 0) as lexical, (lang = 'en')::int as domain, (source = 'src1')::int as citation, (source = 'src2')::int as trusted, (lang = 'de')::int as wrong, 1990 + doc_id % 40 as y from m join documents using (doc_id) left join b using (query_id, doc_id)),
t as (select *, case when query_id % 2 = 0 then case abs(y - (2000 + query_id % 10)) when 0 then 0.10 when 1 then 0.05 when 2 then 0.02 when 3 then 0.02 else 0 end else case when 2026 - y <= 2 then 0.08 when 2026 - y <= 5 then 0.04 when 2026 - y <= 10 then 0.02 else 0 end end as temporal, min(rrf_sum) over w as lo, max(rrf_sum) over w as hi from g window w as (partition by query_id))
select query_id, doc_id, rrf_sum, n_sources, round(greatest(0, (rrf_sum - lo) / greatest(1e-8, hi - lo) + 0.08 * lexical + 0.04 * domain + 0.05 * citation + 0.05 * trusted + 1.2 * temporal - 0.3 * wrong) + 1e-9, 6)::double as final from t""")
def rrf_bonuses(spark, d):
    a, b = ranking._lists(spark, d)
    docs = read(spark, d, "documents")
    every = a.select("query_id", "doc_id").union(b.select("query_id", "doc_id")).distinct()
    asked = F.when(F.col("query_id") % 2 == 0, F.array(2000 + F.col("query_id") % 10)).otherwise(F.expr("cast(array() as array<bigint>)"))
    signals = every.join(docs, "doc_id").join(b.select("query_id", "doc_id", F.col("score").alias("lexical")), ["query_id", "doc_id"], "left")
    signals = signals.select("query_id", "doc_id", "lexical", (F.col("lang") == "en").cast("int").alias("domain"), (F.col("source") == "src1").cast("int").alias("citation"), (F.col("source") == "src2").cast("int").alias("trusted"), (F.col("lang") == "de").cast("int").alias("wrong_domain"), fusion.temporal(1990 + F.col("doc_id") % 40, asked, F.lit(2026)).alias("temporal"))
    return fusion.rrf_with_bonuses({"a": a, "b": b}, signals)


@query(f"""{LISTS}, {MERGED}, s as (select query_id, doc_id, 0.35 * 0 + 0.25 * coalesce(bm25 / 100, 0) + 0.20 * (doc_id % 3 = 0)::int + 0.08 * (source = 'src1')::int + 0.08 * coalesce(lexical, 0) + 0.06 * (lang = 'en')::int + 0.03 * (doc_id % 7 = 0)::int + case when source = 'src2' then 0.05 else 0 end - case when lang = 'de' then 0.2 else 0 end as raw from m join documents using (doc_id)),
r as (select query_id, doc_id, greatest(raw, 0) as raw from s) select query_id, doc_id, round(case when max(raw) over w = min(raw) over w then 1.0 else (raw - min(raw) over w) / (max(raw) over w - min(raw) over w) end, 6) as score from r window w as (partition by query_id)""")
def linear_fuse_signals(spark, d):
    m = ranking.merge_candidates(spark, d).withColumn("bm25", F.col("bm25") / 100).join(read(spark, d, "documents").select("doc_id", "source", "lang"), "doc_id")
    flag = lambda c: c.cast("int")
    m = m.withColumns({"dense": F.lit(0.0), "exact": flag(F.col("doc_id") % 3 == 0), "title": flag(F.col("source") == "src1"), "domain": flag(F.col("lang") == "en"), "citation": flag(F.col("doc_id") % 7 == 0)})
    out = fusion.linear(m, trusted=F.col("source") == "src2", wrong_domain=F.col("lang") == "de")
    return out.select("query_id", "doc_id", "score")


@query(f"""{LISTS}, {MERGED}, c as (select query_id, doc_id, round(0.6 * coalesce(lexical, 0) + 0.4 * n_sources / 3 + 1e-9, 6) as consensus, length(text) % 13 as model, lang from m join documents using (doc_id)), h as (select *, round(0.7 * consensus + 0.1 * (lang = 'en')::int + 1e-9, 6) as heuristic from c),
r as (select *, row_number() over (partition by query_id order by heuristic desc, doc_id)::int as heuristic_rank from h), k as (select * from r where heuristic_rank <= case query_id % 4 when 0 then 10 when 1 then 25 when 2 then 60 else 120 end)
select query_id, doc_id, consensus, heuristic, heuristic_rank, final_rank from (select *, row_number() over (partition by query_id order by model desc, doc_id)::int as final_rank from k) where final_rank <= 8""")
def cascade_rerank(spark, d):
    m = ranking.merge_candidates(spark, d).select("query_id", "doc_id", F.coalesce("lexical", F.lit(0.0)).alias("score"), "n_sources").join(read(spark, d, "documents").select("doc_id", "lang", (F.length("text") % 13).alias("model")), "doc_id")
    difficulty = F.element_at(F.array(*map(F.lit, fusion.CASCADE)), (F.col("query_id") % 4 + 1).cast("int"))
    out = fusion.cascade(m, 0.7 * F.col("consensus") + 0.1 * (F.col("lang") == "en").cast("int"), "model", difficulty, 8)
    return out.select("query_id", "doc_id", "consensus", "heuristic", "heuristic_rank", "final_rank")


@query(f"""{LISTS}, x as (select b.*, case lang when 'en' then 'same' when 'de' then 'wrong' when 'fr' then 'trade' else 'enterprise' end as g, source = 'src1' as t from b join documents using (doc_id)),
f as (select *, case g when 'same' then 1.15 when 'wrong' then 0.5 when 'trade' then 0.9 else 1.0 end * case when g = 'wrong' and t then 0.5 else 1 end as c, case g when 'same' then 1.35 when 'wrong' then 0.25 when 'trade' then 0.9 else 1.15 end * case when g = 'wrong' and t then 0.1 else 1 end as a from x)
select query_id, doc_id, case when query_id % 3 <> 0 then round(score * c + 1e-9, 6) else score end as conservative, case when query_id % 3 <> 0 then round(score * a + 1e-9, 6) else score end as aggressive from f""")
def domain_adjust(spark, d):
    top = ranking._shared(spark, d).join(read(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")
    group = F.when(F.col("lang") == "en", "same").when(F.col("lang") == "de", "wrong").when(F.col("lang") == "fr", "trade").otherwise("enterprise")
    made = lambda mode: fusion.domain_adjusted(F.col("score"), group, F.col("source") == "src1", F.col("query_id") % 3 != 0, mode).alias(mode)
    return top.select("query_id", "doc_id", made("conservative"), made("aggressive"))


@query(f"{LISTS}, {MERGED} select query_id, doc_id, coalesce(bm25, lexical, 0) as effective, coalesce(greatest(bm25, lexical), 0) as best from m")
def score_coalesce(spark, d):
    m = ranking.merge_candidates(spark, d)
    return m.select("query_id", "doc_id", fusion.effective_score(F.col("bm25"), F.col("lexical")).alias("effective"), fusion.best_score(F.col("bm25"), F.col("lexical")).alias("best"))


_LINES = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
#: Chunks of documents: the first turn names a law, later ones are articles of their turn's number, every third one is none.
CHUNKS = f"t as (select distinct conv_id, turn, role, {_LINES.format('text')} as text from conversations), k0 as (select *, row_number() over (partition by conv_id order by turn, role, text)::int as n from t where text <> ''), k as (select conv_id::varchar as doc_id, conv_id || '-' || n as chunk_id, n, case when n = 1 and conv_id % 3 = 0 then 'Luật ' || substr(text, 1, 30) || ' số 5/2020 của' when n = 1 and conv_id % 3 = 1 then 'abc' || chr(10) || upper('LUẬT MỚI ' || conv_id) when n % 3 = 0 then text else 'Điều ' || n || 'a. ' || text end as text from k0)"


def _chunks(spark, d):
    from pyspark.sql import Window

    t = read(spark, d, "conversations").select("conv_id", "turn", "role", T.squash(F.col("text")).alias("text")).distinct().where("text <> ''")
    k = t.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")))
    first, law, capitals = F.col("n") == 1, F.concat(F.lit("Luật "), F.substring("text", 1, 30), F.lit(" số 5/2020 của")), F.concat(F.lit("abc\nLUẬT MỚI "), F.col("conv_id").cast("string"))
    text = F.when(first & (F.col("conv_id") % 3 == 0), law).when(first & (F.col("conv_id") % 3 == 1), capitals).when(F.col("n") % 3 == 0, F.col("text")).otherwise(F.concat(F.lit("Điều "), F.col("n").cast("string"), F.lit("a. "), F.col("text")))
    return k.select(F.col("conv_id").cast("string").alias("doc_id"), F.concat_ws("-", "conv_id", "n").alias("chunk_id"), "n", text.alias("text"))


@query(f"""with {CHUNKS}, h as (select *, starts_with(text, 'Điều ') as is_article from k), f as (select doc_id, arg_min(text, n) as text from h where not is_article group by doc_id),
z as (select doc_id, regexp_extract(text, '(Luật|Nghị định|Thông tư|Bộ luật)\\s+([^\\n]+)', 1) as kind, trim(regexp_replace(regexp_extract(text, '(Luật|Nghị định|Thông tư|Bộ luật)\\s+([^\\n]+)', 2), '\\s+', ' ', 'g')) as rest, contains(text, chr(10)) as capitals from f),
i as (select doc_id, case when kind <> '' then trim(kind || ' ' || regexp_replace(regexp_replace(rest, '(?i)\\s+số\\s+[^\\s,.;]+.*$', ''), '^[ ,.;]+|[ ,.;]+$', '', 'g')) when capitals then 'Luật Mới ' || doc_id else doc_id end as title, case when kind <> '' then trim(kind || ' ' || rest) when capitals then 'Luật Mới ' || doc_id else doc_id end as full_name from z)
select h.doc_id, coalesce(i.title, h.doc_id) as doc_title, coalesce(full_name, h.doc_id) as doc_full_name, h.doc_id || '|' || coalesce(i.title, h.doc_id) || '|Điều ' || n || 'a' as article_id, 'Điều ' || n || 'a' as article_number, nullif(substr(text, length('Điều ' || n || 'a. ') + 1), '') as article_title, chunk_id, md5(text) as digest from h left join i using (doc_id) where is_article""")
def corpus_articles(spark, d):
    a = articles.article_rows(_chunks(spark, d), "doc_id", "chunk_id", "text", "n")
    return a.withColumn("digest", F.md5("chunk_text")).drop("chunk_text")


@query(f"with {CHUNKS}, h as (select *, 'Điều ' || (n % 3) as article, case when n % 2 = 0 then 'article' else 'clause' end as level from k where n % 5 <> 0), w as (select doc_id, article, max(n) filter (level = 'article') as a, min(n) as c from h group by all) select w.doc_id, w.article, h.chunk_id from w join h on h.doc_id = w.doc_id and h.n = coalesce(a, c)")
def article_index(spark, d):
    c = _chunks(spark, d).where("n % 5 <> 0").withColumns({"article": F.concat(F.lit("Điều "), (F.col("n") % 3).cast("string")), "level": F.when(F.col("n") % 2 == 0, "article").otherwise("clause")})
    return articles.article_index(c, "doc_id", "article", "chunk_id", "level", "n")


@query()
def article_chunks(spark, d):
    text = F.concat_ws("\n", F.concat(F.lit("Điều 1. "), F.col("text")), F.concat(F.lit("Điều 2. "), F.substring("text", 1, 500)))
    return articles.chunks(read(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, text).otherwise(F.col("text")).alias("text")), "doc_id", "text", 1000, 200)


@query(f"""with x as (select p_partkey as id, case when p_partkey % 3 = 0 then 'Luật ' || p_name when p_partkey % 3 = 1 then 'Bộ luật ' || p_brand else p_type end as title, case when p_partkey % 4 <> 0 then p_size || '/2020/QH' end as number, case when p_partkey % 2 = 0 then 'Điều ' || p_size || 'b và' when p_partkey % 5 <> 0 then 'Phần  chung' end as article from part),
f as (select *, {FOLD.format('title')} as f from x), b as (select *, case when starts_with(f, 'luat ') then substr(f, 6) when starts_with(f, 'bo luat ') then substr(f, 9) end as bare, coalesce(number, id::varchar) || '|' || title as ref from f)
select id, array_to_string([y for y in [title, number, bare] if y is not null], ';') as aliases, ref, case when article is null then null when contains(article, 'b và') then ref || '|Điều ' || regexp_extract(article, '(\\d+[A-Za-z]?)', 1) else ref || '|Phần chung' end as article_ref from b""")
def document_refs(spark, d):
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    x = read(spark, d, "part").select(k.alias("id"), F.when(k % 3 == 0, F.concat(F.lit("Luật "), F.col("p_name"))).when(k % 3 == 1, F.concat(F.lit("Bộ luật "), F.col("p_brand"))).otherwise(F.col("p_type")).alias("title"), F.when(k % 4 != 0, F.concat(n, F.lit("/2020/QH"))).alias("number"), F.when(k % 2 == 0, F.concat(F.lit("Điều "), n, F.lit("b và"))).when(k % 5 != 0, F.lit("Phần  chung")).alias("article"))
    c = [F.col(n) for n in ("number", "title", "id")]
    return x.select("id", F.array_join(articles.aliases(F.col("title"), F.col("number")), ";").alias("aliases"), articles.doc_ref(*c).alias("ref"), articles.article_ref(*c, F.col("article")).alias("article_ref"))


def _first(key: str, entry: str, name: str, where: str = "true", most: str = "") -> str:
    return f"select query_id, array_to_string(list(e order by rank){most}, ';') as {name} from (select query_id, {key} as k, min(rank) as rank, arg_min({entry}, rank) as e from x where {where} group by all) group by query_id"


@query(f"""{CONTEXTS}, d as ({_first("coalesce(doc_number, doc_title)", "case when doc_number is null then doc_title else doc_number || '|' || doc_title end", "docs")}), a as materialized ({_first("coalesce(doc_number, '') || '|' || doc_title || '|' || article", "coalesce(doc_number, '') || '|' || doc_title || '|' || article", "articles", "article is not null")}),
c as ({_first("doc_title || '|' || coalesce(article, '')", "doc_title || '|' || coalesce(article, '') || '|' || coalesce(citation, '') || '|' || round(score, 4)", "citations")}), s as ({_first("doc_title || '|' || coalesce(article, '') || '|' || coalesce(source_url, '')", "doc_title || coalesce(article, '') || coalesce(source_url, '')", "sources")}), t as ({_first("doc_id || '|' || article", "doc_id || '|' || article || '|' || clause", "details", "article is not null", "[1:3]")})
select query_id, docs, articles, len(string_split(citations, ';')) as n_citations, sources, details from d left join a using (query_id) left join c using (query_id) left join s using (query_id) left join t using (query_id)""".replace(", a as materialized (", ", a_ as (").replace("left join a using", "left join a_ using").replace(", d as (", ", d_ as (").replace("from d left", "from d_ left").replace(", s as (", ", s_ as (").replace("left join s using", "left join s_ using"))
def relevant_lists(spark, d):
    c = _contexts(spark, d)
    out = answers.documents(c).select("query_id", F.array_join("docs", ";").alias("docs")).join(answers.articles(c).select("query_id", F.array_join("articles", ";").alias("articles")), "query_id", "left")
    out = out.join(answers.citations(c).select("query_id", F.size("citations").cast("long").alias("n_citations")), "query_id", "left")
    one = lambda x: F.concat(F.coalesce(x["doc_title"], F.lit("")), F.coalesce(x["article"], F.lit("")), F.coalesce(x["source_url"], F.lit("")))
    out = out.join(answers.sources(c).select("query_id", F.array_join(F.transform("sources", one), ";").alias("sources")), "query_id", "left")
    pair = lambda x: F.concat_ws("|", x["doc_id"].cast("string"), x["article"], x["clause"])
    return out.join(answers.article_details(c, 3).select("query_id", F.array_join(F.transform("details", pair), ";").alias("details")), "query_id", "left")


@query(f"{CONTEXTS} select query_id, max(score) filter (rank = 1) as score, max(score) filter (rank = 1) > 0 as is_relevant, case when max(score) filter (rank = 1) > 0 then 'ok' else 'low_score' end as reason from x group by query_id")
def context_quality(spark, d):
    return answers.context_quality(_contexts(spark, d))


@query(f"{CONTEXTS}, y as (select *, trim(regexp_replace(text, '\\s+', ' ', 'g')) as s from x) select query_id, count(*) as n_contexts, sum(case when s = '' then 0 else floor(len(string_split(s, ' ')) * 1.3) end)::bigint as n_tokens, round(max(score), 4) as top_score, round(avg(score), 4) as mean_score, md5(string_agg(substr(s, 1, 80), chr(10) order by rank)) as heads from y group by query_id")
def context_diagnostics(spark, d):
    out = answers.diagnostics(_contexts(spark, d))
    heads = F.array_join(F.transform(F.split("preview", "\n"), lambda x: F.regexp_replace(x, r"^[0-9.E\-]+ ?", "")), "\n")
    return out.select("query_id", "n_contexts", "n_tokens", "top_score", "mean_score", F.md5(heads).alias("heads"))


@query("""with p as (select doc_id, case when lang = 'en' then [source] else [] end as a, case when source <> 'src1' then [lang, '', lang] else [' '] end as b, ['x', 'x', source] as c from documents)
select doc_id, array_to_string(case when len(a) > 0 then a when b[1] <> ' ' then [b[1]] else case when c[3] = 'x' then ['x'] else ['x', c[3]] end end, ',') as chosen from p""")
def fallback_lists(spark, d):
    none = F.expr("cast(array() as array<string>)")
    lists = [F.when(F.col("lang") == "en", F.array("source")).otherwise(none), F.when(F.col("source") != "src1", F.array("lang", F.lit(""), "lang")).otherwise(F.array(F.lit(" "))), F.array(F.lit("x"), F.lit("x"), "source")]
    return read(spark, d, "documents").select("doc_id", F.array_join(answers.first_list(*lists), ",").alias("chosen"))


_S = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
#: Answers made of documents' first words, with all sections, with three, or without.
ANSWERS = f"w as (select doc_id, substr({_S}, 1, 120) as s, length(text) % 4 as m, doc_id % 6 as n from documents), a as (select doc_id, n, s, m, case when m < 2 then '1. Kết luận ngắn' || chr(10) || s || chr(10) || '2. Căn cứ pháp luật' || chr(10) || 'Điều ' || n || ', Khoản 2, Điểm a; Điều ' || (n + 1) || ' theo luật hiện hành' || chr(10) || '3. Phân tích áp dụng' || chr(10) || s || case when n = 3 then ' thiếu thông tin' else '' end || chr(10) || '4. Việc SME nên làm' || chr(10) || 'làm ' || n when m = 2 then '1. Kết luận ngắn' || chr(10) || s || ' điều ' || n || 'b khoản 3 điểm c' else s end as answer from w)"


def _answers(spark, d):
    w = read(spark, d, "documents").select("doc_id", F.substring(T.squash(F.col("text")), 1, 120).alias("s"), (F.length("text") % 4).alias("m"), (F.col("doc_id") % 6).alias("n"))
    n = F.col("n").cast("string")
    full = F.concat(F.lit("1. Kết luận ngắn\n"), F.col("s"), F.lit("\n2. Căn cứ pháp luật\nĐiều "), n, F.lit(", Khoản 2, Điểm a; Điều "), (F.col("n") + 1).cast("string"), F.lit(" theo luật hiện hành\n3. Phân tích áp dụng\n"), F.col("s"), F.when(F.col("n") == 3, " thiếu thông tin").otherwise(""), F.lit("\n4. Việc SME nên làm\nlàm "), n)
    part = F.concat(F.lit("1. Kết luận ngắn\n"), F.col("s"), F.lit(" điều "), n, F.lit("b khoản 3 điểm c"))
    return w.withColumn("answer", F.when(F.col("m") < 2, full).when(F.col("m") == 2, part).otherwise(F.col("s")))


@query(f"""with {ANSWERS} select doc_id, case when m < 2 then md5(trim(s)) end as first_section, case when m < 2 then 'làm ' || n end as last_section, case when m < 2 then 'Điều ' || n || ';Điều ' || (n + 1) || ';Khoản 2;Điểm a' when m = 2 then 'điều ' || n || 'b;khoản 3;điểm c' else '' end as refs, case when m < 2 then 'Điều ' || n || ', Khoản 2;Điều ' || (n + 1) else '' end as cited, m < 2 and n <> 3 as acceptable from a""")
def answer_parts(spark, d):
    a = _answers(spark, d)
    s = answers.sections(F.col("answer"))
    return a.select("doc_id", F.md5(s["ket_luan_ngan"]).alias("first_section"), s["viec_sme_nen_lam"].alias("last_section"), F.array_join(answers.key_refs(F.col("answer")), ";").alias("refs"), F.array_join(answers.cited(F.col("answer")), ";").alias("cited"), answers.acceptable(F.col("answer")).alias("acceptable"))


@query(f"""with {ANSWERS}, s as (select *, case when m < 2 then ['Điều ' || n, 'Điều ' || (n + 1)] else [] end as found, case when n % 2 = 0 then ['Điều ' || n, 'Điều ' || (n + 1)] else ['Điều 1'] end as sel from a), r as (select *, [x for x in sel if not list_contains(found, x)] as missing, [x for x in found if not list_contains(sel, x)] as stray from s)
select doc_id, array_to_string(missing, ';') as missing, array_to_string(stray, ';') as unsupported, len(missing) = 0 and len(stray) = 0 and len(found) > 0 as basis_ok, contains(answer, 'theo luật hiện hành') and not contains(answer, 'Điều ') as generic_claim, m = 2 and len(sel) < 2 as too_few_articles,
md5(case when len(missing) = 0 and len(stray) = 0 and len(found) > 0 then answer else 'Căn cứ pháp lý: Căn cứ ' || array_to_string([x || ' T' for x in sel], '; ') || '.' || chr(10) || chr(10) || answer end) as with_basis from r""")
def answer_quality(spark, d):
    a = _answers(spark, d)
    name = lambda k: F.concat(F.lit("Điều "), (F.col("n") + k).cast("string"))
    sel = F.when(F.col("n") % 2 == 0, F.array(name(0), name(1))).otherwise(F.array(F.lit("Điều 1")))
    a = a.withColumn("sel", sel).withColumn("titles", F.transform("sel", lambda x: F.lit("T")))
    r = answers.citation_report(F.col("answer"), F.col("sel"))
    q = answers.quality(F.when(F.col("m") == 2, "thủ tục gì").otherwise("gì"), F.col("answer"), F.col("sel"))
    return a.select("doc_id", F.array_join(r["missing_articles"], ";").alias("missing"), F.array_join(r["unsupported_citations"], ";").alias("unsupported"), q["legal_basis_ok"].alias("basis_ok"), q["generic_claim"].alias("generic_claim"), q["too_few_articles"].alias("too_few_articles"), F.md5(answers.with_basis(F.col("answer"), F.col("sel"), F.col("titles"))).alias("with_basis"))


_KINDS = "['QH14', 'NĐ-CP', 'TT-BTC', 'QĐ-TTG', 'XX']"


@query(f"""with x as (select o_orderkey as k, o_orderkey || '/' || year(o_orderdate) || '/' || {_KINDS}[o_orderkey % 5 + 1] as source, o_custkey || '/' || case when o_custkey % 3 = 0 then 'x' else (1990 + o_custkey % 12)::varchar end || '/' || {_KINDS}[o_custkey % 5 + 1] as target, ['AMENDS', 'REPLACES', 'GUIDED_BY'][o_orderkey % 3 + 1] as relation, 'năm ' || (1992 + o_custkey % 9) as t from orders),
r as (select *, [1, 2, 3, 4, null][k % 5 + 1] as a, case when regexp_matches(target, 'QH14$') then 1 when regexp_matches(target, 'NĐ-CP$') then 2 when regexp_matches(target, 'TT-BTC$') then 3 when regexp_matches(target, 'QĐ-TTG$') then 4 end as b, regexp_extract(source, '/(\\d+)/', 1)::int as y, case when contains(target, '/x/') then substr(t, 5)::int else regexp_extract(target, '/(\\d+)/', 1)::int end as z from x)
select k, relation = 'GUIDED_BY' or coalesce(a <= b, true) as rank_ok, relation = 'GUIDED_BY' or y >= z as year_ok from r""")
def relation_validity(spark, d):
    kinds = F.array(*map(F.lit, ("QH14", "NĐ-CP", "TT-BTC", "QĐ-TTG", "XX")))
    at = lambda c: F.element_at(kinds, (c % 5 + 1).cast("int"))
    o, k, u = read(spark, d, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    x = o.select(k.alias("k"), F.concat_ws("/", k, F.year("o_orderdate"), at(k)).alias("source"), F.concat_ws("/", u, F.when(u % 3 == 0, "x").otherwise((1990 + u % 12).cast("string")), at(u)).alias("target"), F.element_at(F.array(*map(F.lit, ("AMENDS", "REPLACES", "GUIDED_BY"))), (k % 3 + 1).cast("int")).alias("relation"), F.concat(F.lit("năm "), (1992 + u % 9).cast("string")).alias("t"))
    c = [F.col(n) for n in ("source", "target", "relation")]
    return x.select("k", validity.rank_allows(*c).alias("rank_ok"), validity.year_allows(*c, F.lit(""), F.col("t")).alias("year_ok"))


_CTX = ["căn cứ vào luật và", "được sửa đổi, bổ sung bởi", "thay thế", "theo quy định tại 1/2011/AB, 2/2012/CD và 3/2013/EF", "nói về"]
_CTXS = "[" + ", ".join(f"'{c}'" for c in _CTX) + "]"


@query(f"""with x as (select l_orderkey as k, l_linenumber as l, ['AMENDS', 'GUIDED_BY', 'REPLACES'][l_linenumber % 3 + 1] as relation, l_suppkey % 5 as c, l_partkey % 4 as g from lineitem), y as (select *, case when g = 0 then '9/2001/NĐ' else '7/2003/QH' end as source, '9/2005/NĐ' as target, c in (0, 3) as guided, c = 1 as amends, c = 2 as replaces from x),
v as (select *, case when g = 0 then 'same_law_different_year_is_replacement_not_amendment' when c = 3 then 'multiple_docs_in_context_ambiguous' when relation in ('AMENDS', 'REPLACES') and guided then 'context_shows_guided_by_not_amends' when relation = 'GUIDED_BY' and amends then 'context_shows_amends_not_guided' when relation = 'AMENDS' and replaces then 'context_shows_replaces_not_amends' when c < 3 and g = 1 then 'target_too_far_from_relation_keyword' else '' end as reason from y)
select k, l, reason = '' as valid, case reason when 'same_law_different_year_is_replacement_not_amendment' then 'REPLACES' when 'context_shows_guided_by_not_amends' then 'GUIDED_BY' when 'context_shows_amends_not_guided' then 'AMENDS' when 'context_shows_replaces_not_amends' then 'REPLACES' else relation end as relation, reason from v""")
def relation_words(spark, d):
    li = read(spark, d, "lineitem")
    g = F.col("l_partkey") % 4
    context = F.concat(F.element_at(F.array(*map(F.lit, _CTX)), (F.col("l_suppkey") % 5 + 1).cast("int")), F.when(g == 1, F.repeat(F.lit(" x"), 200)).otherwise(""), F.lit(" 9/2005/NĐ"))
    x = li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("l"), F.element_at(F.array(*map(F.lit, ("AMENDS", "GUIDED_BY", "REPLACES"))), (F.col("l_linenumber") % 3 + 1).cast("int")).alias("r"), F.when(g == 0, "9/2001/NĐ").otherwise("7/2003/QH").alias("source"), context.alias("context"))
    return x.withColumn("v", validity.by_words(F.col("context"), F.col("r"), F.col("source"), F.lit("9/2005/NĐ"))).select("k", "l", "v.valid", "v.relation", "v.reason")


@query(f"""with x as (select doc_id, substr({_S}, 1, 100) as s, doc_id % 3 as m from documents where doc_id is not null) select doc_id::varchar as doc_id, (doc_id % 9)::varchar as article, doc_id || '/2019/NĐ-CP' as number, case when m = 1 then 'EXCLUDED_REF' else 'REFERS_TO' end as relation, case when m = 1 then 0.8 else 1.0 end::double as confidence, (length(s) + case m when 0 then 1 when 1 then length(' ngoại trừ ') else length(' ngoại trừ ') + 70 end)::bigint as start from x""")
def chunk_references(spark, d):
    k, m = F.col("doc_id").cast("string"), F.col("doc_id") % 3
    lead = F.when(m == 0, " ").when(m == 1, " ngoại trừ ").otherwise(F.concat(F.lit(" ngoại trừ "), F.repeat(F.lit("y"), 70)))
    text = F.concat(F.substring(T.squash(F.col("text")), 1, 100), lead, F.lit("Điều "), (F.col("doc_id") % 9).cast("string"), F.lit(" của Nghị định số "), k, F.lit("/2019/NĐ-CP"))
    return validity.chunk_references(read(spark, d, "documents").where("doc_id is not null").select("doc_id", text.alias("t")), "doc_id", "t")


@query("""with x as (select p_partkey as k, p_size || '/2020' as number, case p_partkey % 4 when 0 then p_size || '/2020|' || p_brand when 1 then 'old|' || p_brand || ' ' when 2 then 'old' else 'old| ' end as tag, case p_partkey % 3 when 0 then 'Query: "' || p_name || '"' || chr(10) || 'more' when 1 then '```' || p_name || '```' else 'Rewritten query: ' || p_type end as rewrite, p_name as name, p_type as type from part)
select k, case k % 4 when 1 then number || '|' || trim(substr(tag, 5)) else tag end as tag, case k % 3 when 2 then type else name end as cleaned from x""")
def tag_and_rewrite(spark, d):
    k, size = F.col("p_partkey"), F.concat(F.col("p_size").cast("string"), F.lit("/2020"))
    tag = F.when(k % 4 == 0, F.concat_ws("|", size, "p_brand")).when(k % 4 == 1, F.concat(F.lit("old|"), "p_brand", F.lit(" "))).when(k % 4 == 2, "old").otherwise("old| ")
    rewrite = F.when(k % 3 == 0, F.concat(F.lit('Query: "'), "p_name", F.lit('"\nmore'))).when(k % 3 == 1, F.concat(F.lit("```"), "p_name", F.lit("```"))).otherwise(F.concat(F.lit("Rewritten query: "), "p_type"))
    return read(spark, d, "part").select(k.alias("k"), validity.fixed_tag(tag, size).alias("tag"), validity.clean_rewrite(rewrite).alias("cleaned"))


@query(f"""with x as (select doc_id, source as number, {FOLD.format('lang')} as title, 1 + doc_id % 30 + 2000 as y, case doc_id % 4 when 0 then 'doanh nghiep nho va vua dau thau' when 1 then 'hoa don quan ly thue' when 2 then 'khai thue' else 'hoa don cuong che' end as words from documents)
select doc_id, ((number = 'src1')::int * 100 + (number = 'src2')::int * 120 + (title = 'en')::int * 10 + contains(words, 'hoa don')::int * 7 + case doc_id % 4 when 0 then 25 when 1 then 20 when 2 then 18 else 15 end + case when y >= 2023 then 5 when y >= 2019 then 3 else 0 end)::int as score,
array_to_string([l for l in [case when number = 'src1' then 'priority_doc' end, case when number = 'src2' then 'tax_priority_doc' end, case when title = 'en' then 'title:en' end, case when contains(words, 'hoa don') then 'invoice' end, case doc_id % 4 when 0 then 'sme_procurement_bridge' when 1 then 'invoice_tax_bridge' when 2 then 'tax_registration_bridge' else 'enforcement_invoice_bridge' end] if l is not null], ',') as labels from x""")
def subset_score(spark, d):
    words = F.element_at(F.array(*map(F.lit, ("Doanh nghiệp nhỏ và vừa đấu thầu", "hóa đơn, quản lý thuế", "khai thuế", "hóa đơn; cưỡng chế"))), (F.col("doc_id") % 4 + 1).cast("int"))
    s = validity.row_score(F.col("source"), F.col("lang"), words, (2001 + F.col("doc_id") % 30).cast("int"), ["src1"], ["src2"], ["en"], [("hoa don", 7, "invoice")])
    return read(spark, d, "documents").select("doc_id", s.alias("s")).select("doc_id", "s.score", "s.labels")


@query("""with x as (select s_suppkey % 40 as id, case when s_suppkey % 7 <> 0 then s_name end as name, ['tax', 'labor', 'other'][s_suppkey % 3 + 1] as domain, case when s_suppkey % 5 = 0 then 'ftp://x' else 'https://x' end as url, [case when s_suppkey % 11 = 0 then 'stray' else 'tax' end] as related from supplier)
select id, unnest([e for e in [case when name is null then 'missing: name' end, case when domain = 'other' then 'domain: other' end, case when url = 'ftp://x' then 'url' end, case when related[1] = 'stray' then 'related: stray' end] if e is not null]) as error from x union all select id, 'duplicate id' from x group by id having count(*) > 1""")
def registry_errors(spark, d):
    k = F.col("s_suppkey")
    s = read(spark, d, "supplier").select((k % 40).alias("id"), F.when(k % 7 != 0, F.col("s_name")).alias("name"), F.element_at(F.array(*map(F.lit, ("tax", "labor", "other"))), (k % 3 + 1).cast("int")).alias("domain"), F.when(k % 5 == 0, "ftp://x").otherwise("https://x").alias("url"), F.array(F.when(k % 11 == 0, "stray").otherwise("tax")).alias("related_domains"))
    return validity.registry_errors(s, ["tax", "labor"], ("id", "name", "domain", "url"))


@query("select n_name as domain, array_to_string(list(s_suppkey order by s_acctbal, s_suppkey), ',') as sources from supplier join nation on s_nationkey = n_nationkey where s_acctbal > 0 group by n_name")
def sources_by_domain(spark, d):
    s = read(spark, d, "supplier").join(read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    out = validity.by_domain(s.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("priority"), (F.col("s_acctbal") > 0).alias("enabled"), F.col("n_name").alias("domain")))
    return out.select("domain", F.array_join("sources", ",").alias("sources"))


@query("""with x as (select o_orderkey as k, o_orderdate::date as day, o_orderkey % 4 as m from orders)
select k, day as issued_date, case m when 0 then day when 1 then day + 30 when 2 then day + 30 else null end as effective_date, case when m = 3 then day + 60 end as expiry_date, case m when 0 then 'X' when 3 then 'Hết hiệu lực' else 'Vẫn còn hiệu lực' end as status, year(day) * 10000 + month(day) * 100 + day(day) as sort_key, case m when 0 then null when 1 then strftime(day + 30, '%d/%m/%Y') when 2 then null else strftime(day + 60, '%d/%m/%Y') end as described from x""")
def legal_dates(spark, d):
    k, m = F.col("o_orderkey"), F.col("o_orderkey") % 4
    day = F.col("o_orderdate").cast("date")
    shown = lambda c: F.date_format(c, "dd/MM/yyyy")
    values = F.when(m == 0, F.create_map(F.lit("ngay_ban_hanh"), F.date_format(day, "yyyy/MM/dd"), F.lit("hieu_luc_tu"), shown(day), F.lit("trang_thai"), F.lit(" X "))).otherwise(F.create_map(F.lit("issued_date"), shown(day)))
    text = (
        F.when(m == 0, "không").when(m == 1, F.concat(F.lit("Luật này Có hiệu lực từ ngày "), F.date_format(F.date_add(day, 30), "d/M/yyyy")))
        .when(m == 2, F.concat(F.lit("hiệu lực thi hành từ ngày "), F.date_format(F.date_add(day, 30), "d"), F.lit(" tháng "), F.date_format(F.date_add(day, 30), "M"), F.lit(" năm "), F.date_format(F.date_add(day, 30), "yyyy")))
        .otherwise(F.concat(F.lit("hết hiệu lực vào ngày "), shown(F.date_add(day, 60))))
    )
    described = F.when(m == 1, F.concat(F.lit("Có hiệu lực từ "), shown(F.date_add(day, 30)))).when(m == 3, F.concat(F.lit("ngày "), shown(F.date_add(day, 60)), F.lit(" hết hiệu lực"))).otherwise("không")
    s = web.sort_date(shown(day))
    out = read(spark, d, "orders").select(k.alias("k"), web.legal_dates(values, F.lit("tên"), text).alias("x"), (s["y"] * 10000 + s["m"] * 100 + s["d"]).cast("long").alias("sort_key"), web.effective_from_description(described).alias("described"))
    return out.select("k", "x.*", "sort_key", "described")


@query("select p_partkey as k, case p_partkey % 3 when 0 then '1/2/2020' when 1 then nullif(trim(p_name), '') end as value from part")
def boilerplate_clean(spark, d):
    k = F.col("p_partkey")
    c = F.when(k % 3 == 0, "Ngày ban hành là ngày 1/2/2020 của văn bản").when(k % 3 == 1, F.col("p_name")).otherwise("Đang  cập nhật")
    return read(spark, d, "part").select(k.alias("k"), web.without_boilerplate(c).alias("value"))


@query("""with x as (select page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) as root from pages) select page_id, array_to_string([root || '/list?page=' || (page_id % 7 + 2), root || '/last'], ' ') as urls from x""")
def next_page_links(spark, d):
    html = F.concat(F.lit('<a href="/list?page='), (F.col("page_id") % 7 + 2).cast("string"), F.lit('#x">Trang <b>tiếp</b></a><a href="/about">about</a><a class="n" href="/last">&raquo;</a><a href="http://else.where/">next</a><a href="/last">Sau</a>'))
    return read(spark, d, "pages").select("page_id", F.array_join(web.next_pages(html, F.col("url")), " ").alias("urls"))


@query(f"""with {ASKED}, t as (select *, regexp_extract_all(l, '[\\p{{L}}\\p{{N}}_]+') as t from q), f as (select *, len(t) as n, regexp_matches(question, '\\d') as num, {any_of('l', rules.EXACT_WORDS)} as exact, regexp_matches(question, '(^|[^\\p{{L}}\\p{{N}}_])[A-Z0-9]{{2,10}}($|[^\\p{{L}}\\p{{N}}_])') as acr, {any_of('l', rules.DEPENDS)} as follow, {any_of('l', rules.TECHNICAL)} as tech, len(list_distinct(t)) / len(t) as density from t)
select item_id, p, n as query_length, num as has_numbers, exact as has_exact_pattern, acr as has_acronym, follow as is_follow_up, {any_of('l', rules.ASKS)} as is_question, num or exact or acr or tech or density > 0.9 as sparse, case when n >= 12 or follow then 0.8 when exact or num or acr then 0.3 else 0.7 end::double as alpha, case when follow then 8 else 5 end as top_k, case when follow then 20 else 15 end as candidate_k from f""")
def query_features(spark, d):
    f = _asked(spark, d).withColumn("f", rules.query_features(F.col("question")))
    f = f.withColumn("o", rules.adaptive_policy(F.col("f"))).withColumn("sparse", rules.prefers_sparse(F.col("f")))
    return f.select("item_id", "p", F.col("f.query_length").cast("long").alias("query_length"), "f.has_numbers", "f.has_exact_pattern", "f.has_acronym", "f.is_follow_up", "f.is_question", "sparse", "o.alpha", "o.top_k", "o.candidate_k")


TOPICS = [rules.Topic(("the ", "thue"), ("tion", "en "), ("src1", "src2"), 0.4, 0.3), rules.Topic(("de ",), ("la ",), (), 0.25)]


def _topic_sql() -> str:
    out = []
    for t in TOPICS:
        size = lambda c, w: "(" + " + ".join(f"contains({c}, '{x}')::int" for x in w) + ")" if w else "0"
        titles = "(" + " + ".join(f"(contains(title, '{x}') or contains(f, '{x}'))::int" for x in t.titles) + ")" if t.titles else "0"
        out.append((any_of("q", t.keywords), size("f", t.required), titles, size("f", t.keywords), t))
    topic = " + ".join(f"case when {a} then case when {r} + {ti} > 0 then {t.boost} * least(3.0, {r} + 0.6 * {ti}) when {w} > 0 then {0.2 * t.boost} else -{t.missing} end + least(0.12, 0.03 * {w}) + least(0.18, 0.04 * {r}) - case when {r} + {ti} > 0 then 0 else {max(0.75, t.missing)} end else 0 end" for a, r, ti, w, t in out)
    more_t = " + ".join(f"case when {a} and {r} + {ti} > 0 then least(0.45, 0.12 * {ti}) else 0 end" for a, r, ti, _, _ in out)
    more_l = " + ".join(f"case when {a} and {r} + {ti} > 0 then least(0.15, 0.03 * {r}) else 0 end" for a, r, ti, _, _ in out)
    named = " or ".join(a for a, *_ in out)
    return f"z as (select *, ({topic})::double as topic0, (lex0 + {more_l})::double as lex1, (tit0 + {more_t})::double as tit1, ({named}) as named from y)"


@query(f"""{LISTS}, y as (select b.query_id, b.doc_id, b.score as base, {FOLD.format('i.text')} as q, {FOLD.format('d.text')} as f, d.source as title, b.score as lex0, (d.source = 'src1')::int * 0.5 as tit0, (d.doc_id % 2)::double as cit, (d.lang = 'en')::int::double as dom from b join documents d using (doc_id) join benchmark i on i.item_id = b.query_id where b.rank <= 10),
{_topic_sql()}, t as (select *, topic0 - case when named and dom = 0 and lex1 < 0.12 and tit1 < 0.12 then 0.12 else 0 end as topic from z)
select query_id, doc_id, round(topic + 1e-9, 4)::double as topic_boost, round(greatest(0, 0.18 * base + 0.22 * least(1.0, lex1) + 0.18 * least(1.0, tit1) + 0.06 * cit + 0.14 * dom + topic) + 1e-9, 6)::double as final_score from t""")
def context_score(spark, d):
    top = ranking._shared(spark, d, 10).join(read(spark, d, "documents"), "doc_id").join(read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question")), "query_id")
    flag = lambda c: c.cast("double")
    s = rules.context_scores(T.fold(F.col("question")), T.fold(F.col("text")), F.col("source"), F.col("score"), F.col("score"), 0.5 * flag(F.col("source") == "src1"), flag(F.col("doc_id") % 2), flag(F.col("lang") == "en"), TOPICS)
    return top.select("query_id", "doc_id", s.alias("s")).select("query_id", "doc_id", F.col("s.topic_boost").alias("topic_boost"), F.col("s.final_score").alias("final_score"))


@query(f"""with q as (select item_id, case when item_id % 2 = 0 then 'src1 ' || text else text end as text from benchmark), qt as (select item_id, lower(text) as l, list_distinct({sql_tokens('text')}) as t from q), p as (select doc_id, source, list_distinct({sql_tokens('source')}) as a, list_distinct({sql_tokens('text')}) as b from documents),
s as (select item_id as query_id, doc_id, 2.5 * (len(list_intersect(qt.t, p.a)) / len(qt.t)) + 0.75 * (len(list_intersect(qt.t, p.b)) / len(qt.t)) as raw, contains(l, lower(source)) as held, doc_id % 3 = 0 as numbered from qt, p where len(qt.t) > 0), v as (select query_id, doc_id, round(raw + case when held then 2.0 else 0 end + case when numbered then 0.5 else 0 end, 6)::double as score from s where raw > 0)
select query_id, doc_id, score, rank from (select *, cast(row_number() over (partition by query_id order by score desc, doc_id) as int) as rank from v) where rank <= 10""")
def keyword_article_search(spark, d):
    q = read(spark, d, "benchmark").select("item_id", F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("src1 "), F.col("text"))).otherwise(F.col("text")).alias("text"))
    docs = read(spark, d, "documents")
    s = bm25.field_score(docs, q, "doc_id", "item_id", T.tokens(F.col("source")), T.tokens(F.col("text")), T.tokens(F.col("text")), F.col("source"), F.col("text"), F.col("doc_id") % 3 == 0)
    return bm25.top(s, 10)


@query("""select (('0x' || substr(sha256('docs:' || vec_id), 1, 16))::ubigint & 9223372036854775807::ubigint)::bigint as point_id, len(embedding)::bigint as size, label as label, vec_id from embeddings where embedding is not null and len(embedding) > 0""")
def collection_points(spark, d):
    p = vectors.points(read(spark, d, "embeddings").select("vec_id", "label", "embedding"), "docs", "vec_id", "embedding")
    return p.select("point_id", F.size("vector").cast("long").alias("size"), F.col("payload.label").alias("label"), F.col("payload.vec_id").alias("vec_id"))


@query("select p_partkey as k, md5(array_to_string([x for x in [nullif(trim(p_name), ''), nullif(trim(p_brand), ''), nullif(trim(p_type), '')] if x is not null], chr(10))) as document, md5(case when p_partkey % 2 = 0 then 'own' else p_name || chr(10) || p_type end) as chunk from part")
def level_texts(spark, d):
    p = read(spark, d, "part")
    doc = p.select("p_partkey", F.col("p_name").alias("doc_title"), F.col("p_brand").alias("doc_number"), F.col("p_type").alias("cleaned_text"))
    chunk = p.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, " own ").alias("embedding_text"), F.col("p_name").alias("doc_title"), F.col("p_type").alias("content"))
    a = doc.select("p_partkey", F.md5(vectors.level_text(doc, "document")).alias("document"))
    return a.join(chunk.select("p_partkey", F.md5(vectors.level_text(chunk, "chunk")).alias("chunk")), "p_partkey").withColumnRenamed("p_partkey", "k")


#: Documents whose texts are led or followed by what relates them to another one, by their id modulo 8; the last kind says it in the middle only.
_TAILS = {
    1: " Văn bản này thay thế Nghị định {0}.", 2: " Sửa đổi,  bổ sung Nghị định {0}.", 3: " hướng dẫn thi hành, thay thế {0}.", 4: " liên quan đến việc thay thế {0}.", 5: " Bãi bỏ {1}.", 6: " bổ sung 1/2001/AA, 2/2002/BB, 3/2003/CC và {0}.",
}


def _related(spark, d):
    i = F.col("doc_id")
    m = i % 8
    kind = F.when(F.floor(i / 8) % 2 == 0, "NĐ-CP").otherwise("TT-BTC")
    other = F.concat((i - m + F.when(m == 2, 5).otherwise(2)).cast("string"), F.lit("/2020/"), kind)
    before = F.concat(i.cast("string"), F.lit("/2018/"), kind)
    tail = F.coalesce(*(F.when(m == k, F.replace(F.replace(F.lit(t), F.lit("{0}"), other), F.lit("{1}"), before)) for k, t in _TAILS.items()), F.lit(""))
    body = F.coalesce("text", F.lit(""))
    text = F.when(m == 0, F.concat(F.lit("Căn cứ Luật số "), other, F.lit(", "), body, F.lit(" Chú thích màu chỉ dẫn thay thế 9/2009/XX"))).when(m == 7, F.concat(F.repeat(F.lit("y "), 3000), F.lit("Căn cứ, thay thế "), other, F.repeat(F.lit(" z"), 3000))).otherwise(F.concat(body, tail))
    return read(spark, d, "documents").where("doc_id is not null").select("doc_id", F.concat(i.cast("string"), F.lit("/2020/"), kind).alias("doc_number"), text.alias("text"))


_RELATED = """with x as (select doc_id as i, doc_id % 8 as m, doc_id // 8 % 2 as g, length(coalesce(text, '')) as n from documents where doc_id is not null),
y as (select i, m, n, case g when 0 then 'NĐ-CP' else 'TT-BTC' end as kind, i - m + case when m = 2 then 5 else 2 end as j from x), z as (select *, j || '/2020/' || kind as t from y),
r as (select i, t, 'GUIDED_BY' as relation, 1.0::double as confidence, 15 as start, null::varchar as note from z where m = 0
union all select i, t, 'REPLACES', 1.0, n + length(' Văn bản này thay thế Nghị định '), null from z where m = 1
union all select i, t, 'AMENDS', 1.0, n + length(' Sửa đổi,  bổ sung Nghị định '), null from z where m = 2
union all select i, i || '/2018/' || kind, 'REPLACES', 0.9, n + length(' Bãi bỏ '), 'same_law_different_year_is_replacement_not_amendment' from z where m = 5
union all select i, t, 'AMENDS', 0.9, n + length(' bổ sung 1/2001/AA, 2/2002/BB, 3/2003/CC và '), 'multiple_docs_in_context_ambiguous' from z where m = 6
union all select i, a, 'AMENDS', 1.0, n + 9 + b, null from z, (values ('1/2001/AA', 0), ('2/2002/BB', 11), ('3/2003/CC', 22)) v(a, b) where m = 6)"""


@query(f"{_RELATED} select r.i::varchar as source_id, d.doc_id::varchar as target_id, t as target_number, relation, confidence, start::bigint as start, note from r left join (select i as doc_id, i || '/2020/' || case i // 8 % 2 when 0 then 'NĐ-CP' else 'TT-BTC' end as number from x) d on d.number = r.t")
def document_relations(spark, d):
    docs = _related(spark, d)
    return relations.resolved(relations.documents(docs), docs).select("source_id", "target_id", "target_number", "relation", "confidence", "start", "note")


@query(f"{_RELATED}, e as (select relation, d.i is not null as there from r left join (select i, i || '/2020/' || case i // 8 % 2 when 0 then 'NĐ-CP' else 'TT-BTC' end as number from x) d on d.number = r.t) select count(*) filter (there) as edges_written, count(*) filter (there and relation = 'GUIDED_BY') as guided_by_found, count(*) filter (there and relation = 'REPLACES') as replaces_found, count(*) filter (there and relation = 'AMENDS') as amends_found, count(*) filter (not there) as rejected_by_validation from e")
def relation_counts(spark, d):
    docs = _related(spark, d)
    return relations.counts(relations.resolved(relations.documents(docs), docs))


_SIGNAL_TOPICS = [topics.Topic(("the ",), ("tion", "en "), ("luat",), ("business_law",), 0.4, 0.3), topics.Topic(("de ",), ("la ",), (), ("tax_law", "business_law"), 0.25)]
_SIGNAL_PROFILES = [topics.Profile("p", (("the ", "de "),), ("src1",), ("ubnd",), ("tion",), -0.2, ("luat",), -0.15)]


def _index_sql(words: str, c: str) -> str:
    refs = f"regexp_extract_all(trim(regexp_replace(lower({c}), '\\s+', ' ', 'g')), '(?i)\\d+(?:/\\d+)*(?:-[A-Z]+)*/[A-Z0-9À-ỴĂÂĐÊÔƠƯ\\-]+')"
    return f"list_distinct(list_concat({words}, {refs}, [z[1] || '_' || z[2] for z in list_zip({words}[:-2], {words}[2:])]))"


def _share_sql(a: str, b: str) -> str:
    return f"case when len({a}) = 0 or len({b}) = 0 then 0 else len(list_intersect({a}, {b})) / len({a}) end"


@query(f"""{LISTS}, x as (select b.query_id, d.doc_id, b.score, i.text as question, coalesce(d.text, '') as content, d.doc_id % 4 as m, case d.doc_id % 4 when 0 then 'Luật ' || source when 1 then 'UBND tỉnh ' || source when 2 then 'Thông tư ' || source || ' 12/2020/TT-BTC' else source end as title,
case lang when 'en' then 'business_law' when 'fr' then 'tax_law' else lang end as dom, case when d.doc_id % 3 = 0 then 'Điều 5' end as cit, 'https://' || source as url, case when d.doc_id % 2 = 0 then 0.2 else 0.05 end as ctx from b join documents d using (doc_id) join benchmark i on i.item_id = b.query_id where b.rank <= 10),
y as (select *, concat_ws(chr(10), title, dom, cit, nullif(trim(content), '')) as txt, concat_ws(' ', title, cit) as ttl from x), yw as (select *, {sql_tokens('question')} as qw, {sql_tokens('txt')} as tw, {sql_tokens('ttl')} as hw, {sql_tokens("coalesce(cit, '')")} as cw from y),
k as (select *, {_index_sql('qw', 'question')} as qt, {_index_sql('tw', 'txt')} as tt, {_index_sql('hw', 'ttl')} as ht, {_index_sql('cw', "coalesce(cit, '')")} as ct, {FOLD.format('question')} as q, {FOLD.format('txt')} as f, {FOLD.format('ttl')} as h from yw),
n as (select *, {_share_sql('qt', 'tt')} as lex0, {_share_sql('qt', 'ht')} as tit0, {_share_sql('qt', 'ct')} as cm, contains(q, 'the ') as a1, contains(q, 'de ') as a2, contains(f, 'tion')::int + contains(f, 'en ')::int as r1, contains(f, 'the ')::int as w1, (contains(h, 'luat') or contains(f, 'luat'))::int as t1, contains(f, 'la ')::int as r2, contains(f, 'de ')::int as w2 from k),
s as (select *, lex0 + case when a1 then least(0.15, 0.03 * r1) else 0 end + case when a2 then 0.03 * r2 else 0 end as lex, tit0 + case when a1 then 0.12 * t1 else 0 end as tit, case when a2 and dom = 'tax_law' then 1.0 when a1 and not a2 and dom = 'business_law' then 0.25 else 0 end as dm,
case when a1 then case when r1 + t1 > 0 then 0.4 * least(3.0, r1 + 0.6 * t1) when w1 > 0 then 0.12 else 0 end + 0.03 * w1 + 0.04 * r1 + case when dom = 'business_law' then 0.04 else 0 end - case when r1 + t1 > 0 then 0 else 0.2 end else 0 end
+ case when a2 then case when r2 > 0 then 0.25 when w2 > 0 then 0.075 else 0 end + 0.03 * w2 + 0.04 * r2 + case when dom in ('business_law', 'tax_law') then 0.04 else 0 end - case when r2 > 0 then 0 else 0.2 end else 0 end
+ case when a1 or a2 then case when contains(url, 'src1') then 0.18 else 0 end - case when contains(h, 'ubnd') then 0.25 else 0 end - case when contains(f, 'tion') then 0 else 0.2 end - case when contains(h, 'luat') then 0 else 0.15 end else 0 end as topic0 from n),
t as (select *, topic0 - case when lex < 0.05 and tit < 0.05 and dm = 0 and topic0 <= -0.2 then 0.05 else 0 end as topic from s),
z as (select query_id, doc_id, round(least(1.0, lex) + 1e-9, 4) as lexical_overlap, round(least(1.0, tit) + 1e-9, 4) as title_match, round(topic + 1e-9, 4) as topic_boost,
round(greatest(0, 0.35 * score + 0.18 * least(1.0, lex) + 0.15 * least(1.0, tit) + 0.05 * cm + 0.1 * dm + 0.07 * (ctx + 0.02 + case when cit is null then 0 else 0.02 end) + 0.25 * topic + 0.1 * case m when 0 then 0.2 when 1 then -0.25 when 2 then 0.05 else 0 end + case when m in (0, 2) then 0 else -0.08 end) + 1e-9, 6) as final_score from t),
r as (select *, final_score < 0.06 and lexical_overlap < 0.04 and title_match < 0.03 as low from z), o as (select *, row_number() over (partition by query_id order by low, final_score desc, doc_id) as rank from r)
select query_id, doc_id, lexical_overlap::double as lexical_overlap, title_match::double as title_match, topic_boost::double as topic_boost, final_score::double as final_score, rank::int as rank from o where (not low or rank = 1) and rank <= 5""")
def rerank_signals(spark, d):
    """All nine signals of reranking on the ten best documents of each benchmark item, with titles, citations and numbers made of ids and sources."""
    i, m = F.col("doc_id"), F.col("doc_id") % 4
    s = F.col("source")
    docs = read(spark, d, "documents").select("doc_id", F.col("text").alias("content"), F.when(m == 0, F.concat(F.lit("Luật "), s)).when(m == 1, F.concat(F.lit("UBND tỉnh "), s)).when(m == 2, F.concat(F.lit("Thông tư "), s, F.lit(" 12/2020/TT-BTC"))).otherwise(s).alias("doc_title"), F.when(F.col("lang") == "en", "business_law").when(F.col("lang") == "fr", "tax_law").otherwise(F.col("lang")).alias("domain"), F.when(i % 3 == 0, "Điều 5").alias("citation"), F.concat(F.lit("https://"), s).alias("source_url"), F.when(m == 0, "59/2020/QH14").alias("doc_number"), F.when(i % 2 == 0, "seed").otherwise("neighbor").alias("context_type"), *(F.lit(None).cast("string").alias(c) for c in ("legal_path", "article", "clause")))
    asked = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    top = ranking._shared(spark, d, 10).drop("rank").join(docs, "doc_id").join(asked, "query_id").withColumns({"chunk_id": i, "position": F.lit(1)})
    return topics.rerank(top, _SIGNAL_TOPICS, _SIGNAL_PROFILES).select("query_id", "doc_id", "lexical_overlap", "title_match", "topic_boost", "final_score", "rank")


@query(f"""{LISTS}, asked as (select item_id as query_id, case when item_id % 2 = 0 then {_LIST}[item_id % {len(PHRASES)} + 1] else text end as question from benchmark), words as (select *, lower(question) as l, regexp_extract_all(lower(question), '[\\p{{L}}\\p{{N}}_]+') as t from asked),
f as (select *, len(t) as n, regexp_matches(question, '\\d') or {any_of('l', rules.EXACT_WORDS)} or regexp_matches(question, '(^|[^\\p{{L}}\\p{{N}}_])[A-Z0-9]{{2,10}}($|[^\\p{{L}}\\p{{N}}_])') as exact, {any_of('l', rules.DEPENDS)} as follow from words),
pol as (select query_id, case when n >= 12 or follow then 0.8 when exact then 0.3 else 0.7 end as alpha, case when follow then 8 else 5 end as top_k, case when follow then 20 else 15 end as candidate_k, query_id % 3 = 0 as weighted from f),
c as (select b.query_id, doc_id, top_k, case when weighted then alpha * score else 1.0 / (60 + rank) end as v from b join pol on b.query_id = pol.query_id where rank <= candidate_k union all select a.query_id, doc_id, top_k, case when weighted then (1 - alpha) * score / 100 else 1.0 / (60 + rank) end from a join pol on a.query_id = pol.query_id where rank <= candidate_k),
z as (select query_id, doc_id, top_k, round(sum(v), 6)::double as score from c group by all), o as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from z) select query_id, doc_id, score, rank::int as rank from o where rank <= top_k""")
def adaptive_hybrid(spark, d):
    """Features of each question, its policy, both searches and their fusion in one plan; a third of the questions is fused by scores."""
    asked = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 2 == 0, F.element_at(F.array(*map(F.lit, PHRASES)), (F.col("item_id") % len(PHRASES) + 1).cast("int"))).otherwise(F.col("text")).alias("question"))
    o = asked.select("query_id", rules.adaptive_policy(rules.query_features(F.col("question"))).alias("o")).select("query_id", "o.*")
    sparse, dense = ranking._lists(spark, d)
    policy = o.withColumn("fusion_type", F.when(F.col("query_id") % 3 == 0, "weighted").otherwise(F.col("fusion_type")))
    return fusion.adaptive(dense.select("query_id", "doc_id", "score"), sparse.select("query_id", "doc_id", (F.col("score") / 100).alias("score")), policy)
