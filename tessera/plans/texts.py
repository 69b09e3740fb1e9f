"""Queries over texts and pages: folding, tokens, cleaning, URLs, HTML, rules, structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import web
from tessera.operators import dedupe, rules, structure
from tessera.plans.registry import registrar, sql_tokens
from tessera.session import read

QUERIES: dict = {}
ORACLE: dict = {}
query = registrar(QUERIES, ORACLE)

SQUASH = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
FOLD = "replace(strip_accents(lower({})), 'đ', 'd')"


@query(f"select doc_id, md5({SQUASH.format('text')}) as digest, length({SQUASH.format('text')}) as n from documents")
def text_normalise(spark, d):
    c = T.squash(F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.md5(c).alias("digest"), F.length(c).cast("long").alias("n"))


@query(f"select doc_id, md5({FOLD.format('text')}) as digest from documents")
def accent_fold(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(T.fold(F.col("text"))).alias("digest"))


@query(f"select doc_id, md5(trim(regexp_replace(regexp_replace({FOLD.format('text')}, '[^0-9a-z\\s/.\\-]+', ' ', 'g'), '\\s+', ' ', 'g'))) as digest from documents")
def match_normalise(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(T.match_text(F.col("text"))).alias("digest"))


@query(f"with s as (select page_id, regexp_replace(regexp_replace({FOLD.format('url')}, '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as w from pages) select page_id, case when length(w) <= 40 then w else rtrim(substr(w, 1, 31), '_') || '_' || substr(md5(w), 1, 8) end as slug from s")
def slug(spark, d):
    return read(spark, d, "pages").select("page_id", T.slug(F.col("url"), 40).alias("slug"))


@query(f"with t as (select doc_id, {sql_tokens('text')} as t from documents) select doc_id, len(t) as n_tokens, len(list_distinct(t)) as n_distinct, case when len(t) = 0 then 0.0 else round(len(list_distinct(t)) / len(t), 6) end as density from t")
def bm25_tokens(spark, d):
    t = read(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.round(T.density(F.col("t")), 6).alias("density"))


@query(f"with t as (select item_id, {sql_tokens('text')} as t from benchmark) select item_id, array_to_string([t[i] || '_' || t[i + 1] for i in range(1, len(t))], ' ') as bigrams from t")
def bigrams(spark, d):
    return read(spark, d, "benchmark").select("item_id", F.array_join(T.bigrams(T.tokens(F.col("text"))), " ").alias("bigrams"))


@query(f"select doc_id, case when {SQUASH.format('text')} = '' then 0 else len(string_split({SQUASH.format('text')}, ' ')) end as n_words, cast(floor(case when {SQUASH.format('text')} = '' then 0 else len(string_split({SQUASH.format('text')}, ' ')) end * 1.3) as int) as estimate from documents")
def token_estimate(spark, d):
    return read(spark, d, "documents").select("doc_id", T.word_count(F.col("text")).cast("long").alias("n_words"), T.token_estimate(F.col("text")).alias("estimate"))


@query("select doc_id, len([s for s in [regexp_replace(x, '^\\s+|\\s+$', '', 'g') for x in regexp_split_to_array(text, '[.!?\\n]')] if s != '']) as n_sentences from documents")
def sentence_split(spark, d):
    return read(spark, d, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).cast("long").alias("n_sentences"))


@query("select event_id, try_cast(nullif(regexp_replace(props, '\\D', '', 'g'), '') as bigint) as n from events")
def int_like(spark, d):
    return read(spark, d, "events").select("event_id", T.int_like(F.col("props")).alias("n"))


NOISE, CORE = ["!!", "***", "$$$", " | "], ["license", "lizenz"]


def _sql_any(c: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains({c}, '{w}')" for w in words) + ")"


@query(f"select doc_id, ({_sql_any('lower(text)', NOISE)} and not {_sql_any('lower(text)', CORE)}) as noisy from documents")
def noise_filter(spark, d):
    return read(spark, d, "documents").select("doc_id", rules.noise(F.lower("text"), NOISE, CORE).alias("noisy"))


DROP = r"^[^\p{L}\p{N}]*$|\*\*\*|!!"


@query(f"with l as (select doc_id, array_to_string([y for y in [trim(regexp_replace(regexp_replace(x, '^\\s*(?:[-*+]\\s+|#+\\s*)', ''), '[ \\t]+', ' ', 'g')) for x in string_split(text, chr(10))] if y != '' and not regexp_matches(y, '{DROP}')], chr(10)) as c from documents) select doc_id, md5(c) as digest, length(c) as n from l")
def clean_lines(spark, d):
    c = structure.clean_lines(F.col("text"), DROP)
    return read(spark, d, "documents").select("doc_id", c.alias("c")).select("doc_id", F.md5("c").alias("digest"), F.length("c").cast("long").alias("n"))


@query("select page_id, len(regexp_extract_all(html, '<li><a ')) >= 3 as link_list, len(regexp_extract_all(html, '(?i)cookie|login|subscribe|menu')) >= 2 as ui_text from pages")
def ui_text_flag(spark, d):
    c = F.col("html")
    return read(spark, d, "pages").select("page_id", structure.repeated(c, "<li><a ", 3).alias("link_list"), structure.repeated(c, "(?i)cookie|login|subscribe|menu", 2).alias("ui_text"))


TEXT_SQL = "regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
for _n, _c in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("amp", "&")):
    TEXT_SQL = f"replace({TEXT_SQL}, '&{_n};', '{_c}')"


@query(f"with t as (select page_id, trim(regexp_replace({TEXT_SQL}, '\\s+', ' ', 'g')) as t from pages) select page_id, length(t) as n, md5(t) as digest from t")
def html_to_text(spark, d):
    return read(spark, d, "pages").select("page_id", web.visible_text(F.col("html")).alias("t")).select("page_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("digest"))


@query("select page_id, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*?href=\"([^\"]*)\"', 1)) as link from pages")
def html_links(spark, d):
    return read(spark, d, "pages").select("page_id", F.explode(web.links(F.col("html"))).alias("link"))


@query("select page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) as title from pages")
def html_title(spark, d):
    return read(spark, d, "pages").select("page_id", web.title(F.col("html")).alias("title"))


CANON = "with u as (select page_id, regexp_replace(trim(url), '#.*$', '') as u from pages), p as (select page_id, regexp_extract(u, '^([^?]*)', 1) as head, array_to_string([x for x in string_split(regexp_extract(u, '\\?(.*)$', 1), '&') if x != '' and not regexp_matches(x, '^(utm_[^=]*|fbclid|gclid|yclid)(=|$)')], '&') as q from u), c as (select page_id, case when q = '' then head else head || '?' || q end as canonical from p)"


@query(f"{CANON} select page_id, canonical, lower(regexp_extract(canonical, '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/@?#]*@)?([^/:?#]*)', 1)) as host from c")
def url_canonicalise(spark, d):
    return read(spark, d, "pages").select("page_id", web.canonical(F.col("url")).alias("canonical")).withColumn("host", web.host(F.col("canonical")))


@query(f"{CANON} select min(page_id) as page_id, canonical, sha256(canonical) as url_hash from c group by canonical")
def url_dedupe(spark, d):
    p = read(spark, d, "pages").select("page_id", web.canonical(F.col("url")).alias("canonical"))
    return dedupe.first_wins(p, ["canonical"], ["page_id"]).withColumn("url_hash", F.sha2("canonical", 256))


@query("with h as (select page_id, regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])page=\\d*&?', '\\1', 'g'), '[?&]$', '') as h from pages) select page_id, h || case when contains(h, '?') then '&' else '?' end || 'page=' || n as url from h, range(1, 4) r(n)")
def pagination_urls(spark, d):
    p = read(spark, d, "pages").select("page_id", web.without_fragment(F.col("url")).alias("u"))
    return p.select("page_id", F.explode(web.pagination(F.col("u"), F.lit(3))).alias("url"))


@query("select o_orderkey, strftime(o_orderdate, '%d/%m/%Y') as written, cast(o_orderdate as date) as parsed, year(o_orderdate) as y from orders")
def date_parse(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("written"))
    return o.withColumn("parsed", web.date_of(F.concat(F.lit("on "), F.col("written")))).withColumn("y", web.year_of(F.lit(""), F.col("written")).cast("long"))


@query("select o_orderkey, (o_orderdate <= timestamp '1996-01-01' and case when o_orderstatus = 'F' then o_orderdate + interval 365 day > timestamp '1996-01-01' else o_orderstatus = 'O' end) as valid from orders")
def valid_on_date(spark, d):
    o, day = read(spark, d, "orders"), F.lit("1996-01-01").cast("timestamp_ntz")
    expiry = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate") + F.expr("interval 365 day"))
    status = F.when(F.col("o_orderstatus") == "O", "active").otherwise("void")
    return o.select("o_orderkey", web.valid_on(F.col("o_orderdate"), expiry, status, day).alias("valid"))


DOMAINS = {"english": ["the ", " and ", " that "], "german": [" der ", " und ", " ein"], "french": [" le ", " de la ", " que"], "spanish": [" el ", " los ", "ción"]}


def _sql_hits(c: str, words: list[str]) -> str:
    return " + ".join(f"cast(contains({c}, '{w}') as int)" for w in words)


_SCORES = " union all ".join(f"select doc_id, '{k}' as domain, {_sql_hits('lower(text)', w)} as hits, {len(w)} as n from documents" for k, w in DOMAINS.items())


@query(f"select doc_id, domain, hits, round(hits / n, 6) as share from ({_SCORES}) where hits > 0")
def domain_score(spark, d):
    return rules.domain_scores(read(spark, d, "documents"), "doc_id", F.lower("text"), DOMAINS)


@query(f"select doc_id, first(domain order by hits desc, domain) as domain, max(hits) as hits from ({_SCORES}) where hits > 0 group by doc_id")
def domain_detect(spark, d):
    return rules.best_domain(domain_score(spark, d), "doc_id")


_W = f"case when {SQUASH.format('text')} = '' then 0 else len(string_split({SQUASH.format('text')}, ' ')) end"


@query(f"select item_id, case when {_sql_any('lower(text)', ['ción', ' los '])} then 'spanish' when {_sql_any('lower(text)', [' und ', ' der '])} then 'german' when {_W} > 30 then 'complex' else 'simple' end as route, case when regexp_matches(text, '\\d') then 0.3::double when {_W} >= 12 then 0.8 else 0.5 end as alpha, case when {_W} >= 12 then 8 when regexp_matches(text, '\\d') then 6 else 5 end as top_k from benchmark")
def route_query(spark, d):
    b = read(spark, d, "benchmark")
    n = T.word_count(F.col("text"))
    p = rules.retrieval_policy(F.col("text"), n)
    return b.select("item_id", rules.route(F.lower("text"), {"spanish": ["ción", " los "], "german": [" und ", " der "]}, n, "simple").alias("route"), p["alpha"].alias("alpha"), p["top_k"].cast("int").alias("top_k"))


GROUPS = [rules.Group("licences", ("license", "licensed under"), ("copyright", "rights reserved"), ("legal",), 1), rules.Group("contacts", ("e-mail", "phone"), ("@", "tel"), ("personal",), 2)]


@query("""
with t as (select doc_id, lower(split_part(text, chr(10), 1)) as title, lower(text) as body, lang = 'en' as normative, source in ('src0', 'src1', 'src2') as public from documents),
g as (select *, contains(title, 'license') or contains(title, 'licensed under') as t1, contains(body, 'license') or contains(body, 'licensed under') as c1,
 cast(contains(title, 'copyright') as int) + cast(contains(title, 'rights reserved') as int) as wt1, cast(contains(body, 'copyright') as int) + cast(contains(body, 'rights reserved') as int) as w1,
 contains(title, 'e-mail') or contains(title, 'phone') as t2, contains(body, 'e-mail') or contains(body, 'phone') as c2,
 cast(contains(title, '@') as int) + cast(contains(title, 'tel') as int) as wt2, cast(contains(body, '@') as int) + cast(contains(body, 'tel') as int) as w2 from t),
m as (select doc_id, t1 or (c1 and normative and public) or (normative and w1 + wt1 > 0 and (wt1 > 0 or w1 >= 2 or public)) as m1, t2 or (c2 and normative and public) or (normative and w2 + wt2 > 0 and (wt2 > 0 or w2 >= 2 or public)) as m2 from g)
select doc_id, m1 or m2 as include, case when m1 then 'licences' when m2 then 'contacts' end as matched_group from m""")
def rule_domain_filter(spark, d):
    t = read(spark, d, "documents").select("doc_id", F.lower(F.split_part("text", F.lit("\n"), F.lit(1))).alias("title"), F.lower("text").alias("body"), (F.col("lang") == "en").alias("normative"), F.col("source").isin("src0", "src1", "src2").alias("public"))
    out = rules.domain_filter(t, F.col("title"), F.col("body"), GROUPS, F.col("normative"), F.col("public"), F.lit(False), F.lit(False))
    return out.select("doc_id", "include", "matched_group")


#: What leads a document's text as the context of an edge, by its id modulo 8.
EDGE_CONTEXTS = ["", "1/2020/NĐ-CP và 2/2021/QH14 ", "1/2020/NĐ-CP, 2/2021/QH14, 3/2021/TT-BTC ", "Ngoại  trừ ", "điều này hoặc Điều 5 ", "tùy theo ", "theo quy định tại Điều 3 và Điều 4 ", "Nếu "]
_EDGES = """e as (select doc_id, length(coalesce(text, '')) as n, doc_id % 8 as m, doc_id % 3 = 0 as excluded from documents), s as (select doc_id, m, excluded, n + [0, 28, 41, 11, 21, 9, 35, 4][m + 1] < 100 as short from e),
c as (select doc_id, round(greatest(0, 1 - [0, 0.1, 0.3, 0.4, 0.75, 0.75, 0.35, 0.4][m + 1] - case when excluded then 0.05 else 0 end - case when short then 0.1 else 0 end), 6)::double as confidence,
array_to_string([x for x in [['', 'two_doc_numbers', 'multiple_doc_numbers(3)', 'complex_context', 'complex_context; branching_structure', 'complex_context; branching_structure', 'branching_structure', 'complex_context'][m + 1], case when excluded then 'excluded_ref' else '' end, case when short then 'short_context' else '' end] if x <> ''], '; ') as why from s)"""


@query(f"with {_EDGES} select doc_id, confidence, case when why = '' then 'simple_explicit_ref' else why end as reason, case when confidence >= 0.95 then 'auto_pass' else 'flagged' end as verdict from c")
def edge_confidence(spark, d):
    lead = F.element_at(F.array(*map(F.lit, EDGE_CONTEXTS)), (F.col("doc_id") % 8 + 1).cast("int"))
    relation = F.when(F.col("doc_id") % 3 == 0, "EXCLUDED_REF").otherwise("REFERS_TO")
    c = read(spark, d, "documents").select("doc_id", rules.edge_confidence(F.concat(lead, F.coalesce("text", F.lit(""))), relation).alias("c"))
    return c.select("doc_id", "c.confidence", "c.reason", rules.triage(F.col("c.confidence")).alias("verdict"))


@query(f"with {_EDGES} select case when confidence >= 0.95 then 'auto_pass' else 'flagged' end as verdict, count(*) as n from c group by verdict")
def triage(spark, d):
    return edge_confidence(spark, d).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


PARAGRAPHS = "with x as (select doc_id, [p for p in [trim(y) for y in string_split(text, chr(10))] if length(p) >= 1] as ps from documents), c as (select doc_id, unnest(range(len(ps))) as chunk_no, unnest(ps) as content from x)"


@query(f"{PARAGRAPHS} select doc_id, doc_id || '_' || chunk_no as chunk_id, lag(doc_id || '_' || chunk_no) over w as prev_id, lead(doc_id || '_' || chunk_no) over w as next_id from c window w as (partition by doc_id order by chunk_no)")
def prev_next_links(spark, d):
    c = structure.paragraphs(read(spark, d, "documents"), "doc_id", "text")
    return structure.neighbours(c, "doc_id", "chunk_id", "chunk_no").select("doc_id", "chunk_id", "prev_id", "next_id")


@query("with l as (select doc_id, string_split(text, chr(10)) as ls from documents), x as (select doc_id, unnest(range(len(ls))) as line_no, unnest(ls) as line from l) select doc_id, line_no, md5(line) as digest, coalesce(sum(length(line) + 1) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0)::bigint as start_char from x")
def line_structure(spark, d):
    return structure.lines(read(spark, d, "documents"), "doc_id", "text").select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.md5("line").alias("digest"), "start_char")


@query()
def chunk_recursive(spark, d):
    return structure.recursive_chunks(read(spark, d, "documents"), "doc_id", "text", 1000, 200)


@query("""with l as (select doc_id, unnest(range(len(ls))) as line_no, unnest(ls) as line from (select doc_id, string_split(text, chr(10)) as ls from documents)),
m as (select *, case when regexp_matches(line, '^(\\p{Lu}\\p{L}*)\\.$') then 0 when regexp_matches(line, '^\\s*(\\d+)[.)]\\s+(.*)$') then 1 else 2 end as lv, coalesce(sum(length(line) + 1) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0) as start from l),
o as (select *, max(case when lv = 0 then line_no end) over w as o0, max(case when lv = 1 then line_no end) over w as c from m window w as (partition by doc_id order by line_no rows unbounded preceding)),
n as (select *, case when c > coalesce(o0, -1) then c end as o1 from o), g as (select *, greatest(o0, o1) as node from n where o0 is not null or o1 is not null),
a as (select doc_id, node, min(lv) filter (line_no = node) as lv, min(line) filter (line_no = node) as head, min(o0) filter (line_no = node) as up, regexp_replace(string_agg(line, chr(10) order by line_no), '^\\s+|\\s+$', '', 'g') as content, min(start) as first, max(start + length(line)) as last from g group by doc_id, node)
select doc_id, node::int as node_id, case lv when 0 then 'article' else 'clause' end as level, case lv when 0 then regexp_extract(head, '^(\\p{Lu}\\p{L}*)\\.$', 1) else regexp_extract(head, '^\\s*(\\d+)', 1) end as number, case when lv = 1 and up is not null then up::varchar else '' end as path, content, first::bigint as start_char, last::bigint as end_char from a where content <> ''""")
def structure_parse(spark, d):
    """Headings of a fixture's own: lines of one capitalised word and a full stop open an article, numbered lines a clause."""
    levels = (("article", r"^(\p{Lu}\p{L}*)\.$"), ("clause", r"^\s*(\d+)[.)]\s+(.*)$"))
    return structure.parse(read(spark, d, "documents"), "doc_id", "text", levels)
