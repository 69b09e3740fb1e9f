"""Queries over relational tables, events and conversations: de-duplication, changes, reports, history, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import dedupe, evaluation, history, reports
from tessera.plans.registry import registrar
from tessera.session import read
from tessera.streaming import events as ev
from tessera.streaming import stateful

QUERIES: dict = {}
ORACLE: dict = {}
query = registrar(QUERIES, ORACLE)


@query("select min(doc_id) as doc_id, md5(text) as content_hash from documents group by md5(text)")
def dedupe_first_wins(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.md5("text").alias("content_hash"))
    return dedupe.first_wins(docs, ["content_hash"], ["doc_id"])


@query("select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by value desc nulls last, event_id) as r from events) where r = 1")
def dedupe_best_score(spark, d):
    e = read(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    return dedupe.best_wins(e, ["user_id", "event_type"], "value", ["event_id"])


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by event_id desc) as r from events) where r = 1")
def dedupe_last_wins(spark, d):
    return dedupe.last_wins(read(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"])


@query("select sha256(text) as content_hash, count(*) as n, min(doc_id) as first_id, count(distinct source) as n_sources from documents group by sha256(text) having count(*) > 1")
def content_hash_groups(spark, d):
    g = read(spark, d, "documents").groupBy(F.sha2("text", 256).alias("content_hash"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"), F.countDistinct("source").alias("n_sources")).where("n > 1")


@query("select user_id, event_id, value, sources from (select *, row_number() over (partition by user_id order by value desc nulls last, event_id) as r from events) join (select user_id, array_to_string(list_sort(list(distinct event_type)), ',') as sources from events group by user_id) using (user_id) where r = 1")
def result_merge_sources(spark, d):
    out = dedupe.merge_sources(read(spark, d, "events"), ["user_id"], "value", "event_type", ["event_id"])
    return out.select("user_id", "event_id", "value", F.array_join("sources", ",").alias("sources"))


@query("with o as (select o_orderkey as k, o_orderstatus as c from orders where o_orderdate < timestamp '1997-01-01'), n as (select o_orderkey as k, case when o_orderpriority = '1-URGENT' then 'X' else o_orderstatus end as c from orders where o_orderdate >= timestamp '1993-01-01') select coalesce(o.k, n.k) as k, case when o.k is null then 'added' when n.k is null then 'removed' when o.c is not distinct from n.c then 'same' else 'changed' end as change from o full join n on o.k = n.k")
def manifest_diff(spark, d):
    o = read(spark, d, "orders")
    old = o.where("o_orderdate < timestamp_ntz '1997-01-01'").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("c"))
    new = o.where("o_orderdate >= timestamp_ntz '1993-01-01'").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderpriority") == "1-URGENT", "X").otherwise(F.col("o_orderstatus")).alias("c"))
    return dedupe.difference(old, new, "k", "c")


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def resume_antijoin(spark, d):
    return dedupe.not_in(read(spark, d, "documents"), read(spark, d, "labels"), ["doc_id"]).select("doc_id")


@query("select c_custkey as k, c_acctbal as v from customer where c_acctbal >= 0 and c_custkey not in (select o_custkey from orders where o_orderstatus = 'P') union all select distinct o_custkey, 0.0 from orders where o_orderstatus = 'P'")
def merge_upsert(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    new = read(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k"), F.lit(0.0).alias("v")).distinct()
    return dedupe.upsert(c, new, c.where("v < 0"), "k")


@query("with s as (select r_regionkey as k, r_name as name, 0 as o from region union all select n_nationkey, n_name, 1 from nation) select k, name from (select *, row_number() over (partition by k order by o, name) as r from s) where r = 1")
def union_first_wins(spark, d):
    r = read(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))
    n = read(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return dedupe.union_first([r, n], ["k"], ["name"])


@query("select o_orderpriority, o_orderkey, o_totalprice, rank from (select *, cast(row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) as int) as rank from orders) where rank <= 50")
def topk_per_group(spark, d):
    o = read(spark, d, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return dedupe.top_per_group(o, ["o_orderpriority"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 50)


@query("select p_brand, p_partkey, p_retailprice from (select *, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as r from part) where r = 1 order by p_retailprice desc, p_partkey limit 10")
def greedy_distinct_topk(spark, d):
    p = read(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice")
    return dedupe.best_wins(p, ["p_brand"], "p_retailprice", ["p_partkey"]).orderBy(F.col("p_retailprice").desc(), "p_partkey").limit(10)


@query("select o_orderkey, c_name, n_name, o_totalprice from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where o_orderstatus = 'F' and c_mktsegment = 'BUILDING'")
def metadata_content_join(spark, d):
    o = read(spark, d, "orders").where("o_orderstatus = 'F'")
    c = read(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_name", "n_name", "o_totalprice")


@query("select lang, source, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from documents group by lang, source")
def filter_report(spark, d):
    return reports.counts(read(spark, d, "documents"), ["lang", "source"])


@query("select d.lang, count(*) as n, count(*) filter (length(text) < 500) as short, count(*) filter (trim(text) = '') as empty, count(*) filter (l.quality = 1) as good, count(*) filter (l.doc_id is null) as unlabelled from documents d left join labels l using (doc_id) group by d.lang")
def quality_report(spark, d):
    j = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left")
    return reports.flags(j, ["lang"], {"short": F.length("text") < 500, "empty": F.trim("text") == "", "good": F.col("quality") == 1, "unlabelled": F.col("quality").isNull()})


@query("select 'c_nationkey' as kind, count(*) as n from customer where c_nationkey not in (select n_nationkey from nation) union all select 'o_custkey', count(*) from orders where o_custkey not in (select c_custkey from customer) union all select 'l_orderkey', count(*) from lineitem where l_orderkey not in (select o_orderkey from orders)")
def sanity_report(spark, d):
    pairs = [("customer", "c_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey")]
    out = None
    for child, ref, parent, key in pairs:
        bad = read(spark, d, child).join(read(spark, d, parent).select(F.col(key).alias(ref)), ref, "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit(ref).alias("kind"), "n")
        out = bad if out is None else out.unionByName(bad)
    return out


@query("select event_type, event_id, value from (select *, row_number() over (partition by event_type order by value desc nulls last, event_id) as r from events) where r <= 3")
def report_samples(spark, d):
    return reports.samples(read(spark, d, "events").select("event_type", "event_id", "value"), ["event_type"], [F.col("value").desc_nulls_last(), F.col("event_id")], 3)


@query("select t as value, count(*) as n from (select unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) as t from benchmark) group by t order by n desc, t limit 20")
def query_analytics(spark, d):
    words = read(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))).alias("w"))
    return reports.top_values(words, F.col("w"), 20)


@query("select event_type, count(*) as n, count(*) filter (value < 0) as negative, count(*) filter (value is null) as missing, count(*) filter (value > 100) as large from events group by event_type")
def error_analysis(spark, d):
    return reports.flags(read(spark, d, "events"), ["event_type"], {"negative": F.col("value") < 0, "missing": F.col("value").isNull(), "large": F.col("value") > 100})


@query("select event_type, count(*) as n, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as sd, round(min(value), 6) as least, round(max(value), 6) as most from events group by event_type")
def score_stats(spark, d):
    return reports.distribution(read(spark, d, "events"), ["event_type"], "value")


@query("select event_id, epoch(timestamp '2024-01-15') - epoch(ts) > 3600 as expired from events")
def ttl_expiry(spark, d):
    return reports.expired(read(spark, d, "events"), "ts", F.lit("2024-01-15").cast("timestamp"), 3600).select("event_id", "expired")


@query("select doc_id, min(ts) as ts, count(*) as n from (select user_id as doc_id, ts from events) group by doc_id")
def stream_first_seen(spark, d):
    return read(spark, d, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.min("ts").alias("ts"), F.count(F.lit(1)).alias("n"))


@query("select distinct user_id from events")
def stream_dedupe(spark, d):
    return ev.first_of_key(read(spark, d, "events"), "user_id", "ts").select("user_id")


@query("select time_bucket(interval 1 hour, ts) as start, time_bucket(interval 1 hour, ts) + interval 1 hour as \"end\", event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def tumbling_windows(spark, d):
    return ev.windows(read(spark, d, "events"), "ts", ["event_type"], "1 hour")


@query("with g as (select user_id, ts, case when lag(ts) over w is null or ts >= lag(ts) over w + interval 30 minute then 1 else 0 end as b from events window w as (partition by user_id order by ts)), s as (select *, sum(b) over (partition by user_id order by ts rows unbounded preceding) as s from g) select user_id, min(ts) as start, max(ts) + interval 30 minute as \"end\", count(*) as n from s group by user_id, s")
def session_windows(spark, d):
    return ev.sessions(read(spark, d, "events"), "ts", "user_id", "30 minutes")


NOISE = "('ok','okay','thanks','thank you','hi','hello','yes','no')"
WORDS = "case when trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' then 0 else len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) end"
MEANINGFUL = f"(lower(trim(regexp_replace(text, '[.!]+$', ''))) not in {NOISE} and (contains(text, '?') or regexp_matches(text, '\\d') or {WORDS} >= 3))"


@query(f"select conv_id, turn, {MEANINGFUL} as meaningful from conversations")
def history_meaningful(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", history.meaningful(F.col("text")).alias("meaningful"))


@query(f"select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by turn desc) as r from (select distinct conv_id, turn, role, text from conversations) where {MEANINGFUL}) where r <= 3")
def history_recency(spark, d):
    c = read(spark, d, "conversations").distinct().where(history.meaningful(F.col("text")))
    return history.latest(c, "conv_id", "turn", 3).select("conv_id", "turn", "role")


@query(f"with w as (select *, row_number() over (partition by conv_id order by turn desc) as r from (select distinct conv_id, turn, role, text from conversations) where {MEANINGFUL}), x as (select conv_id, turn, 1.0 / (1 + {WORDS}) as likeness from w where r <= 20), y as (select *, round(0.8 * likeness + 0.2 * row_number() over (partition by conv_id order by turn) / count(*) over (partition by conv_id), 6) as blend from x) select conv_id, turn, blend from (select *, row_number() over (partition by conv_id order by blend desc, turn) as k from y) where k <= 3")
def history_hybrid(spark, d):
    c = read(spark, d, "conversations").distinct().where(history.meaningful(F.col("text"))).withColumn("likeness", 1.0 / (1 + T.word_count(F.col("text"))))
    return history.hybrid(c, "conv_id", "turn", "likeness").select("conv_id", "turn", "blend")


@query(f"select conv_id, turn, role, ({WORDS} <= 6 or regexp_matches(text, '(?i)\\b(it|that|this|they|he|she|those)\\b')) as needs_rewrite from conversations where role = 'user'")
def rewrite_decision(spark, d):
    return read(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", "role", history.needs_rewrite(F.col("text")).alias("needs_rewrite"))


@query("select conv_id, md5(string_agg(role || ': ' || text, chr(10) order by turn, role || ': ' || text)) as digest from conversations group by conv_id")
def history_transcript(spark, d):
    return history.transcript(read(spark, d, "conversations"), "conv_id", "turn", "role", "text").select("conv_id", F.md5("transcript").alias("digest"))


@query("select doc_id, error from (select doc_id, 'duplicate_id' as error from labels group by doc_id having count(*) > 1 union all select doc_id, 'bad_id' from labels where not regexp_matches(cast(doc_id as varchar), '^[1-9]\\d*$'))")
def submission_validate(spark, d):
    return evaluation.submission_errors(read(spark, d, "labels").withColumn("t", F.lit("x")), "doc_id", r"^[1-9]\d*$", "t")


_ATTEMPTS = "e as (select user_id::varchar as service, (epoch_us(ts) // 1000) as now, event_type <> 'error' as ok, row_number() over (partition by user_id order by (epoch_us(ts) // 1000), event_id) as n from events where user_id is not null and ts is not null)"


@query(f"""with recursive {_ATTEMPTS},
m as (select service, 0::bigint as n, 'closed' as st, min(now) as since, 0 as f, null::bigint as first, 0::bigint as until, 0 as att, 0 as rej, false as a, false as b, false as c, 0::bigint as s0, 0::bigint as e0, 0 as n0, 0 as r0, 0::bigint as s1, 0::bigint as e1, 0::bigint as s2, 0::bigint as e2, 0 as n2 from e group by service
union all select service, n, case when blocked then 'open' when opens then 'open' else 'closed' end, case when blocked then since1 when opens then now else since2 end, case when blocked then f else f1 end, case when blocked then first else first1 end, case when opens then now + 43200000 else until end,
  case when blocked then att1 + 1 when opens then 0 else att2 + 1 end, case when blocked then rej1 + 1 else 0 end, ended, half, opens, since, until, att, rej, until, now, since2, now, att2 + 1
from (select *, not blocked and not ok and f1 >= 2 as opens from (select *, case when blocked then f when ok then 0 when now - coalesce(first, now) > 86400000 then 1 else f + 1 end as f1, case when blocked then first when ok then null when now - coalesce(first, now) > 86400000 then now else coalesce(first, now) end as first1 from (
  select *, ended as half, st = 'open' and not ended as blocked, since as since1, case when ended then now else since end as since2, att as att1, rej as rej1, case when ended then 0 else att end as att2 from (
    select m.service, e.n, st, since, f, first, until, att, rej, now, ok, st = 'open' and now >= until as ended from m join e on e.service = m.service and e.n = m.n + 1))))),
r as (select service, 'open' as state, s0 as s, e0 as t, n0 as attempts, r0 as rejected from m where a union all select service, 'half_open', s1, e1, 0, 0 from m where b union all select service, 'closed', s2, e2, n2, 0 from m where c)
select service, state, make_timestamp(s * 1000) as start, make_timestamp(t * 1000) as "end", attempts::bigint as attempts, rejected::bigint as rejected from r""")
def breaker_spans(spark, d):
    """Each user as a service that errors fail: two within a day of the first open the breaker for half a day."""
    e = read(spark, d, "events").withColumn("ok", F.col("event_type") != "error")
    return stateful.breaker(e, "user_id", "event_id", "ts", "ok", threshold=2, window=86_400, cooldown=43_200)


@query()
def answer_cache(spark, d):
    """Embeddings as questions of their label, one a minute; tests hold the operator against hand-worked sequences and a stream."""
    v = read(spark, d, "embeddings").where("label is not null")
    asked = v.select("vec_id", "embedding", F.col("label").cast("string").alias("scope"), F.timestamp_seconds(F.col("vec_id") * 60).alias("at"), F.concat(F.lit("q"), "vec_id").alias("question"), F.concat(F.lit("a"), "vec_id").alias("answer"))
    return stateful.answers(asked, "scope", "vec_id", "at", "question", "embedding", "answer")
