"""Queries of the smaller operators: fixes, boosts, limits, summaries, indexes, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import aliases, bm25, corpus, fusion, legal, reports
from tessera.plans import ranking
from tessera.plans.ranking import LISTS, MERGED, PAIRED
from tessera.plans.registry import registrar, sql_tokens
from tessera.session import read
from tessera.streaming import events as ev

QUERIES: dict = {}
ORACLE: dict = {}
query = registrar(QUERIES, ORACLE)

SQ = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"


def _wc(c: str) -> str:
    return f"case when {SQ.format(c)} = '' then 0 else len(string_split({SQ.format(c)}, ' ')) end"


@query("select p_partkey, trim(regexp_replace(regexp_replace(p_type, 'POLISHED|BRUSHED', 'FINISHED', 'g'), '[AEIOU]', '', 'g')) as fixed from part")
def number_fix(spark, d):
    c = legal.replaced(F.col("p_type"), [("POLISHED|BRUSHED", "FINISHED"), ("[AEIOU]", "")])
    return read(spark, d, "part").select("p_partkey", c.alias("fixed"))


@query("select doc_id from documents where source is null or source = '' or contains('src1 src2', source) or contains(source, 'src1')")
def domain_allow(spark, d):
    docs = read(spark, d, "documents")
    return docs.where(legal.allowed(F.col("source"), ["src1 src2", "src1"])).select("doc_id")


@query("select doc_id, quality from labels where coalesce(toxic = 0, true)")
def active_filter(spark, d):
    return read(spark, d, "labels").where(F.coalesce(F.col("toxic") == 0, F.lit(True))).select("doc_id", "quality")


@query("select event_id, value from events where value >= 50")
def low_score_filter(spark, d):
    return read(spark, d, "events").where("value >= 50").select("event_id", "value")


@query("select conv_id, turn, len(list_distinct([x for x in regexp_extract_all(text, '[A-Za-z]+') if regexp_matches(x, '^[a-z]{9,}$')])) as kept from conversations")
def bad_ref_filter(spark, d):
    refs = legal.clean_refs(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), "^[a-z]{9,}$")
    return read(spark, d, "conversations").select("conv_id", "turn", F.size(refs).cast("long").alias("kept"))


@query("select l_orderkey, l_linenumber, coalesce(a.s_name, b.s_name, c.s_name) as name from lineitem left join supplier a on a.s_suppkey = l_suppkey + 5000000 left join supplier b on b.s_suppkey = l_linenumber + 8 left join supplier c on c.s_suppkey = l_suppkey")
def fallback_key_join(spark, d):
    li = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    out = legal.join_first(li, read(spark, d, "supplier"), [F.col("l_suppkey") + 5000000, F.col("l_linenumber") + 8, F.col("l_suppkey")], "s_suppkey", "s_name", "name")
    return out.select("l_orderkey", "l_linenumber", "name")


ALIASES = [("/fr/", "French"), ("/de/", "German"), ("/es/", "Spanish"), ("/en/", "English")]


@query("select page_id, case when contains(url, '/fr/') then 'French' when contains(url, '/de/') then 'German' when contains(url, '/es/') then 'Spanish' when contains(url, '/en/') then 'English' else 'other' end as name from pages")
def alias_containment(spark, d):
    return read(spark, d, "pages").select("page_id", legal.first_contained(F.col("url"), ALIASES, "other").alias("name"))


@query("""with a as (select item_id as o, split_part(lower(text), ' ', 1) || ' ' || split_part(lower(text), ' ', 2) as alias from benchmark), u as (select alias, min(o) as o from a where alias <> ' ' and alias <> '' group by alias)
select doc_id, (select first('i' || u.o order by u.o, u.alias) from u where contains(lower(d.text), u.alias)) as name from documents d""")
def alias_lookup(spark, d):
    """The first benchmark item whose first two words a document holds."""
    two = F.concat_ws(" ", F.split_part(F.lower("text"), F.lit(" "), F.lit(1)), F.split_part(F.lower("text"), F.lit(" "), F.lit(2)))
    table = read(spark, d, "benchmark").select("item_id", two.alias("alias"), F.concat(F.lit("i"), "item_id").alias("name")).where("alias <> ' '")
    docs = read(spark, d, "documents").select("doc_id", F.lower("text").alias("text"))
    return aliases.lookup(docs, "doc_id", "text", table, "alias", "name", "item_id")


@query("select page_id, (('0x' || substr(sha256(url), 1, 16))::ubigint & 9223372036854775807::ubigint)::bigint as stable_id from pages")
def stable_ids(spark, d):
    return read(spark, d, "pages").select("page_id", T.stable_id(F.col("url")).alias("stable_id"))


@query(f"{LISTS}, x as (select b.*, d.source from b join documents d using (doc_id)) select query_id, source, max(score) as score, count(*) as n, array_to_string(list(doc_id order by score desc, doc_id)[1:2], ',') as evidence from x group by query_id, source")
def group_by_article(spark, d):
    top = ranking._shared(spark, d).join(read(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return legal.group_evidence(top, ["source"])


@query(f"{LISTS} select d.source, round(min(b.score), 6) as least, round(avg(b.score), 6) as mean, count(*) as hits from b join documents d using (doc_id) group by d.source")
def top_files(spark, d):
    top = ranking._shared(spark, d).join(read(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return top.groupBy("source").agg(F.round(F.min("score"), 6).alias("least"), F.round(F.avg("score"), 6).alias("mean"), F.count(F.lit(1)).alias("hits"))


SENT = "[x for x in [regexp_replace(y, '^\\s+|\\s+$', '', 'g') for y in regexp_split_to_array({}, '[.!?\\n]')] if x != '']"


@query(f"with s as (select doc_id, {SENT.format('text')} as s from documents), l as (select *, [x for x in s if length(x) > 30] as l from s) select doc_id, md5(substr(coalesce([x for x in l if regexp_matches(x, '(the|der|de) ')][1], l[1], s[1]), 1, 300)) as digest from l")
def context_summary(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(legal.summary(F.col("text"), "(the|der|de) ")).alias("digest"))


@query("select page_id, md5(array_to_string([x for x in [nullif(trim(url), ''), nullif(trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)), '')] if x is not null], chr(10))) as digest from pages")
def combined_text(spark, d):
    c = T.joined_text(F.col("url"), F.regexp_extract("html", "<h1>([^<]*)</h1>", 1))
    return read(spark, d, "pages").select("page_id", F.md5(c).alias("digest"))


TABLE = [{"docs": 2, "articles": 3, "contexts": 4}, {"docs": 2, "articles": 4, "contexts": 6}, {"docs": 3, "articles": 5, "contexts": 8}]


@query(f"with l as (select item_id, least(case when contains(text, 'ción') then 1 else 0 end + case when {_wc('text')} > 30 then 1 else 0 end + case when length(text) > 250 then 1 else 0 end, 2) as difficulty from benchmark) select item_id, difficulty, [2, 2, 3][difficulty + 1] as docs, [3, 4, 5][difficulty + 1] as articles, [4, 6, 8][difficulty + 1] as contexts from l")
def difficulty_limits(spark, d):
    route = F.when(F.contains("text", F.lit("ción")), "spanish").otherwise("other")
    s = legal.limits(route, {"spanish": 1}, [T.word_count(F.col("text")) > 30, F.length("text") > 250], TABLE)
    return read(spark, d, "benchmark").select("item_id", s.alias("s")).select("item_id", "s.*")


@query(f"{LISTS}, x as (select *, max(score) over (partition by query_id) as top from b) select query_id, doc_id, score, rank from x where ((score >= 0.35 and score >= 0.75 * top) or rank = 1) and rank <= 5")
def article_trim(spark, d):
    return legal.trim(ranking._shared(spark, d))


@query(f"{LISTS}, x as (select b.*, d.lang = 'en' as signal, max(score) over (partition by query_id) as best, max(case when score >= 0.5 then 1 else 0 end) over (partition by query_id) as s from b join documents d using (doc_id)) select query_id, doc_id, score from x where case when s = 1 then score >= 0.5 else score >= least(0.5, greatest(0.08, 0.7 * best)) and signal end")
def citation_threshold(spark, d):
    from tessera.operators import selection

    top = ranking._shared(spark, d).join(read(spark, d, "documents").select("doc_id", (F.col("lang") == "en").alias("signal")), "doc_id")
    return selection.citations(top).select("query_id", "doc_id", "score")


@query(f"{LISTS}, {MERGED}, f as (select *, round(greatest(0.35 * coalesce(bm25 / 100, 0) + 0.18 * coalesce(lexical, 0), 0), 6) as final from m), r as (select *, cast(row_number() over (partition by query_id order by final desc, doc_id) as int) as rank from f) select query_id, doc_id, final, rank from r where not (coalesce(bm25 / 100, 0) < 0.06 and coalesce(lexical, 0) < 0.4) or rank = 1")
def heuristic_rerank(spark, d):
    m = ranking.merge_candidates(spark, d).withColumn("bm25", F.col("bm25") / 100)
    return fusion.heuristic(m, {"bm25": 0.35, "lexical": 0.18}, {"bm25": 0.06, "lexical": 0.4}).select("query_id", "doc_id", "final", "rank")


@query(f"{LISTS} select query_id, doc_id, round(greatest(0.0, least(1.0, b.score + case when source = 'src0' then -0.25 when source in ('src1', 'src2') then 0.2 when lang = 'de' then 0.05 else 0.0 end)), 6) as boosted from b join documents using (doc_id)")
def issuer_boost(spark, d):
    top = ranking._shared(spark, d).join(read(spark, d, "documents").select("doc_id", "source", "lang"), "doc_id")
    rules = [(F.col("source") == "src0", -0.25), (F.col("source").isin("src1", "src2"), 0.2), (F.col("lang") == "de", 0.05)]
    return top.select("query_id", "doc_id", legal.boost(F.col("score"), rules).alias("boosted"))


SCENARIO = [("the ", 0.4, "english"), (" und ", 0.3, "german"), ("license", 1.5, "licence"), ("ción", 0.2, "spanish")]


@query("select doc_id, round(case when contains(text, 'the ') then 0.4 else 0 end + case when contains(text, ' und ') then 0.3 else 0 end + case when contains(text, 'license') then 1.5 else 0 end + case when contains(text, 'ción') then 0.2 else 0 end, 6)::double as scenario_score, array_to_string([x for x in [case when contains(text, 'the ') then 'english' end, case when contains(text, ' und ') then 'german' end, case when contains(text, 'license') then 'licence' end, case when contains(text, 'ción') then 'spanish' end] if x is not null], ',') as labels from documents")
def scenario_score(spark, d):
    return read(spark, d, "documents").select("doc_id", *legal.scenario(F.col("text"), SCENARIO))


@query(f"with {PAIRED} select conv_id || '-' || turn as key, len(list_intersect(list_distinct(regexp_extract_all(answer, '[a-z]{{8,}}')), regexp_extract_all(question, '[a-z]{{8,}}'))) > 0 as accurate from p")
def legal_accuracy(spark, d):
    w = lambda c: F.regexp_extract_all(c, F.lit("[a-z]{8,}"), F.lit(0))
    return ranking._paired(spark, d).select("key", F.arrays_overlap(w(F.col("answer")), w(F.col("question"))).alias("accurate"))


@query(f"with {PAIRED} select conv_id || '-' || turn as key, round(0.4 * case when regexp_matches(answer, '\\d') then 1.0 else 0.0 end + 0.4 * case when regexp_matches(answer, '(?i)(^|[^\\p{{L}}])(must|shall|should)([^\\p{{L}}]|$)') then 1.0 else 0.0 end + 0.2 * least(1.0, {_wc('answer')} / 50), 6) as practicality from p")
def practicality(spark, d):
    return ranking._paired(spark, d).select("key", legal.practicality(F.col("answer"), duties=r"(?i)(^|[^\p{L}])(must|shall|should)([^\p{L}]|$)").alias("practicality"))


@query("with x as (select doc_id, [y for y in [trim(z) for z in string_split(text, chr(10))] if y != ''] as c from documents) select doc_id, unnest(range(len(c)))::int as chunk_index, sha256(unnest(c)) as content_hash, true as is_active from x")
def chunk_metadata(spark, d):
    return legal.chunk_rows(read(spark, d, "documents"), "doc_id", "text")


@query("select lang, count(*) as n, count(*) filter (source <> 'src3') as active from documents group by lang")
def soft_delete(spark, d):
    docs = legal.soft_delete(read(spark, d, "documents").withColumn("is_active", F.lit(None).cast("boolean")), F.col("source") == "src3")
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_active").alias("active"))


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def json_column(spark, d):
    return read(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("with u as (select conv_id, turn, text, sum(length(text)) over (partition by conv_id order by turn desc, text rows unbounded preceding) as used from (select distinct conv_id, turn, text from conversations)) select conv_id, turn, used::bigint as used from u where used <= 800")
def history_truncate(spark, d):
    c = read(spark, d, "conversations").select("conv_id", "turn", "text").distinct()
    return legal.char_budget(c, "conv_id", "turn", "text", 800).select("conv_id", "turn", "used")


@query("select o_orderkey from orders order by md5('42-' || o_orderkey), o_orderkey limit 100")
def seeded_sample(spark, d):
    return legal.sample(read(spark, d, "orders").select("o_orderkey"), "o_orderkey", 42, 100)


@query("select time_bucket(interval 30 minute, ts) - o * interval 30 minute as start, time_bucket(interval 30 minute, ts) - o * interval 30 minute + interval 1 hour as \"end\", event_type, count(*) as n, round(sum(value), 4) as total from events, range(0, 2) r(o) group by all")
def sliding_windows(spark, d):
    return ev.windows(read(spark, d, "events"), "ts", ["event_type"], "1 hour", "30 minutes")


@query(f"with t as (select item_id, {sql_tokens('text')} as t from benchmark), u as (select item_id, unnest(list_distinct(t)) as token from t) select token, count(*) as df, min(item_id) as first_item from u group by token")
def keyword_index(spark, d):
    u = read(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("token"))
    return u.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.min("item_id").alias("first_item"))


@query("with x as (select case when contains(text, 'ción') then 'spanish' when contains(text, ' und ') then 'german' when contains(text, 'the ') then 'english' else 'unclassified' end as domain from benchmark) select domain, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from x group by domain")
def question_domains(spark, d):
    b = read(spark, d, "benchmark").select(legal.first_contained(F.col("text"), [("ción", "spanish"), (" und ", "german"), ("the ", "english")], "unclassified").alias("domain"))
    return reports.counts(b, ["domain"])


@query(f"with {PAIRED} select count(*) as n, round(avg(length(answer)), 6) as mean_length, count(*) filter (length(trim(answer)) = 0) as empty, round(count(*) filter (contains(question, '?')) / count(*), 6) as asked from p")
def regression_report(spark, d):
    p = ranking._paired(spark, d)
    return p.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.length("answer")), 6).alias("mean_length"), F.count_if(F.length(F.trim("answer")) == 0).alias("empty"), F.round(F.count_if(F.contains("question", F.lit("?"))) / F.count(F.lit(1)), 6).alias("asked"))


@query(f"{LISTS} select query_id, doc_id, score, rank from (select *, cast(row_number() over (partition by query_id order by score desc, doc_id) as int) as rank from (select query_id, doc_id, round(sum(1.0::double / (60 + rank)), 6) as score from (select query_id, doc_id, rank from a union all select query_id, doc_id, rank from b) group by all)) where rank <= 20")
def multi_query_hybrid(spark, d):
    return bm25.top(fusion.rrf(list(ranking._lists(spark, d))), 20)


@query("select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by all")
def pricing_summary(spark, d):
    li = read(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.count(F.lit(1)).alias("n"))


@query("select conv_id, turn, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\\[(\\d+)\\]', 1))), ',') as cited from conversations where role = 'assistant'")
def citation_extract(spark, d):
    c = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\[(\d+)\]"), F.lit(1))))
    return read(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.array_join(c, ",").alias("cited"))


@query("with g as (select doc_id, quality as q from labels), p as (select doc_id, (length(text) > 500)::int as q from documents) select count(*) as n, round(count(*) filter (p.q = 1 and g.q = 1) / nullif(count(*) filter (p.q = 1), 0), 6) as precision, round(count(*) filter (p.q = 1 and g.q = 1) / nullif(count(*) filter (g.q = 1), 0), 6) as recall from g left join p using (doc_id)")
def evaluate_predictions(spark, d):
    g = read(spark, d, "labels").select("doc_id", F.col("quality").alias("g"))
    p = read(spark, d, "documents").select("doc_id", (F.length("text") > 500).cast("int").alias("p"))
    both = F.count_if((F.col("p") == 1) & (F.col("g") == 1))
    return g.join(p, "doc_id", "left").agg(F.count(F.lit(1)).alias("n"), F.round(both / F.nullif(F.count_if(F.col("p") == 1), F.lit(0)), 6).alias("precision"), F.round(both / F.nullif(F.count_if(F.col("g") == 1), F.lit(0)), 6).alias("recall"))



@query("select page_id, coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')), ''), nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')), '')) as title from pages")
def page_metadata(spark, d):
    return corpus.html_metadata(read(spark, d, "pages"), "page_id", "html", {}).select("page_id", "title")


@query("select p_partkey as id, coalesce(nullif(trim(p_brand), ''), p_type) as name, coalesce(case when p_size > 25 then p_type end, p_name) as label from part")
def document_record(spark, d):
    p = read(spark, d, "part")
    a = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"), F.when(F.col("p_size") > 25, F.col("p_type")).alias("label"))
    b = p.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("name"), F.col("p_name").alias("label"))
    return corpus.record([a, b], "id", ["name", "label"])


@query("select page_id as id, substr(html, 1, 1000) as html, length(url) as n from pages")
def copy_projection(spark, d):
    return corpus.projected(read(spark, d, "pages"), {"id": F.col("page_id"), "n": F.length("url").cast("long")}, "html", 1000)


@query("with i as (select doc_id, md5(text) as digest, true as is_active from documents where source <> 'src5'), f as (select doc_id, case when lang = 'de' then md5(text || 'x') else md5(text) end as digest from documents where source <> 'src6'), o as (select i.doc_id, i.digest, (f.doc_id is not null and f.digest = i.digest) as is_active from i left join f on f.doc_id = i.doc_id), n as (select f.doc_id, f.digest, true from f left join i on f.doc_id = i.doc_id where i.doc_id is null or i.digest <> f.digest) select * from o union all select * from n")
def incremental_update(spark, d):
    docs = read(spark, d, "documents")
    index = docs.where("source <> 'src5'").select("doc_id", F.md5("text").alias("digest"), F.lit(True).alias("is_active"))
    files = docs.where("source <> 'src6'").select("doc_id", F.md5(F.when(F.col("lang") == "de", F.concat("text", F.lit("x"))).otherwise(F.col("text"))).alias("digest"))
    return corpus.incremental(index, files, "doc_id", "digest")


@query(f"with {PAIRED} select conv_id || '-' || turn as key, array_to_string([s for s in ['.', ','] if not contains(answer, s)], ',') as missing, contains(lower(answer), 'sorry') as forbidden, contains(answer, '.') and contains(answer, ',') and not contains(lower(answer), 'sorry') as valid from p")
def answer_validate(spark, d):
    return ranking._paired(spark, d).select("key", *corpus.answer_flags(F.col("answer"), [".", ","], ["sorry"]))


@query(f"{LISTS}, x as (select b.query_id, b.rank, '[' || b.rank || '] ' || d.source || ': ' || substr(trim(regexp_replace(d.text, '\\s+', ' ', 'g')), 1, 200) as line from b join documents d using (doc_id) where b.rank <= 3) select query_id, string_agg(line, chr(10) order by rank) as answer from x group by query_id")
def template_answer(spark, d):
    top = ranking._shared(spark, d).join(read(spark, d, "documents").select("doc_id", "source", "text"), "doc_id")
    return corpus.template_answer(top, "query_id", "source", "text", "rank")


@query(f"""{LISTS.replace("with ", "with recursive ", 1)}, x as (select b.query_id, b.doc_id, b.score, length(d.text) % 11 as model, length(d.text) // 8 as cost from b join documents d using (doc_id)),
y as (select *, round(0.15 * score + (1 - 0.15) * case when max(model) over w = min(model) over w then 0.5 else (model - min(model) over w) / (max(model) over w - min(model) over w) end, 6) as blend from x window w as (partition by query_id)),
z as (select *, cast(row_number() over (partition by query_id order by blend desc, doc_id) as int) as rank, max(blend) over (partition by query_id) as top, avg(blend) over (partition by query_id) as mu, stddev_pop(blend) over (partition by query_id) as sd from y),
k as (select *, cast(row_number() over (partition by query_id order by rank) as int) as i from z where blend >= 0.8 * top and blend >= round(case when top >= 0.9 then greatest(0.75, top - 0.5 * sd) when top >= 0.8 then greatest(0.65, mu + 0.3 * sd) else greatest(0.55, mu) end, 6)),
f as (select query_id, 0 as i, 0::bigint as used, 0 as n, null::bigint as doc_id, null::double as blend, null::int as rank, false as taken from (select distinct query_id from z)
union all select f.query_id, f.i + 1, f.used + case when f.used + k.cost <= 1200 and f.n < 8 then k.cost else 0 end, f.n + case when f.used + k.cost <= 1200 and f.n < 8 then 1 else 0 end, k.doc_id, k.blend, k.rank, f.used + k.cost <= 1200 and f.n < 8 from f join k on k.query_id = f.query_id and k.i = f.i + 1)
select query_id, doc_id, blend, rank, used from f where taken union all select query_id, doc_id, blend, rank, cost::bigint from z where rank = 1 and query_id not in (select query_id from f where taken)""")
def adaptive_context_select(spark, d):
    top = ranking._shared(spark, d).join(read(spark, d, "documents").select("doc_id", (F.length("text") % 11).alias("model"), F.expr("length(text) div 8").alias("cost")), "doc_id")
    return corpus.adaptive_contexts(top.drop("rank"), "model", "cost").select("query_id", "doc_id", "blend", "rank", "used")


@query("select item_id as question_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as question from benchmark where trim(text) <> ''")
def question_prepare(spark, d):
    return corpus.questions(read(spark, d, "benchmark"), ["text"], ["item_id"])


@query("with c as (select user_id, max(ts) as at from events group by user_id), q as (select event_id, user_id, ts from events where event_type = 'error') select event_id as question_id, c.at - q.ts <= interval 1 hour as recent from q join c using (user_id)")
def error_recency(spark, d):
    e = read(spark, d, "events")
    last = e.groupBy("user_id").agg(F.max("ts").alias("at"))
    q = e.where("event_type = 'error'").join(last, "user_id")
    return q.select(F.col("event_id").alias("question_id"), (F.col("at") - F.col("ts") <= F.expr("interval 1 hour")).alias("recent"))
