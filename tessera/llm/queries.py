"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import collocations, decontaminate, embeddings, language_id, language_model, licenses, neardup, packing, periodic, quality, substrings, token_counts, warc
from tessera.session import read


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), window=10)
    return decontaminate.digest(found)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.duplicates(read(spark, sf_dir, "documents"), length=400)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"), licenses.known_licenses(spark))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(read(spark, sf_dir, "documents"), shingle=5, threshold=0.8)


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write(read(spark, sf_dir, "pages"), revisit_bytes=1000)
    return warc.read_records(manifest).withColumnRenamed("id", "page_id")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(read(spark, sf_dir, "documents"), folds=10)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), threshold=0.3, folds=5)
    return scored.select("doc_id", "held_out", "score", "predicted")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op10_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings"), threshold=0.98, tables=32, bits=16)


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify(read(spark, sf_dir, "documents"), folds=4, fold=2)
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.top(read(spark, sf_dir, "documents"), min_count=10, most=2000, within=50)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(periodic.detect(periodic.repeat_tails(read(spark, sf_dir, "documents")), min_length=12))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_substring_dedup, op3_licenses, op4_near_duplicates, op5_pack, op6_warc, op7_lm_score, op8_quality, op9_token_counts, op10_embedding_dups, op11_language_id, op12_collocations, op13_periodic_runs)}

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

#: CRC-32 of a decimal doc_id, bit by bit.
_CRC32 = "xor(list_reduce(list_prepend(4294967295::bigint, flatten([[ascii(ch)::bigint, -1, -1, -1, -1, -1, -1, -1, -1] for ch in string_split(doc_id::varchar, '')])), lambda c, x: case when x >= 0 then xor(c, x) when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end), 4294967295)"

_LINE = f"regexp_replace(lower(x), '{licenses.COPYRIGHT}', '', 'g')"
for _from, _to in licenses.EQUIVALENT:
    _LINE = f"regexp_replace({_LINE}, '{_from}', '{_to.replace(chr(39), chr(39) * 2)}', 'g')"
_CANON = f"[c for c in [trim(regexp_replace({_LINE}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) for x in ls] if c <> '']"
_KNOWN = ", ".join(f"('{name}', '{text}')" for name, text in [*licenses.STATEMENTS, ("MIT", licenses.MIT), ("MIT", "MIT License\n\n" + licenses.MIT), ("ISC", licenses.ISC), ("ISC", "ISC License\n\n" + licenses.ISC)])

ORACLE: dict[str, str] = {
    "op1_decontaminate": f"""
with d as (select doc_id, {_WORDS} as w from documents), i as (select item_id, {_WORDS} as w from benchmark),
n as (select distinct item_id, least(10, len(w)) as k, array_to_string(w[p : p + least(10, len(w)) - 1], ' ') as win from (select *, unnest(range(1, greatest(1, len(w) - 9) + 1)) as p from i where len(w) > 0)),
s as (select doc_id, p, k, array_to_string(w[p : p + k - 1], ' ') as win from (select *, unnest(range(1, len(w) + 1)) as p from d), (select distinct k from n) where p + k - 1 <= len(w)),
m as (select doc_id, p, n.k, item_id from s join n on s.win = n.win and s.k = n.k),
h as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + k)) as q from m) group by doc_id),
t as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as names from (select distinct doc_id, cast(item_id as varchar) as item_id from m) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h using (doc_id) left join t using (doc_id)""",
    "op3_licenses": f"""
with k(license, text) as (values {_KNOWN}), u as (select 0 as known, license, null as doc_id, 0 as row, text from k union all select 1, null, doc_id, row_number() over (), coalesce(text, '') from documents),
l as (select *, {_CANON} as lines from (select *, regexp_split_to_array(text, '\\r\\n|\\r|\\n') as ls from u)),
d as (select *, sha256(array_to_string(lines, ' ')) as digest from l),
n as (select digest, string_agg(distinct license, ',' order by license) as license from d where known = 0 group by digest),
s as (select row, string_agg(distinct x.license, ',' order by x.license) as statements, count(distinct x.license) as n from (select row, sha256(unnest(lines)) as digest from d where known = 1) y join (select digest, license from d where known = 0) x using (digest) group by row)
select doc_id, digest, n.license, coalesce(statements, '') as statements, coalesce(s.n, 0)::bigint as n_statements, n.license is not null or s.n is not null as licensed from d left join n using (digest) left join s using (row) where known = 1""",
    "op6_warc": """
with p as (select page_id, coalesce(html, '') as h from pages), s as (select page_id, strlen(h) as payload_bytes, sha1(h) as payload_digest from p),
x as (select *, max(page_id) over (partition by payload_digest) as head from s)
select page_id, payload_bytes::bigint as payload_bytes, payload_digest, case when payload_bytes >= 1000 and head <> page_id then 'revisit' else 'response' end as record_type, case when payload_bytes >= 1000 and head <> page_id then head end as refers_to from x""",
    "op10_embedding_dups": """
with recursive v as (select vec_id, label, embedding::double[] as e from embeddings where label is not null and embedding is not null and len([x for x in embedding if x is null or isnan(x) or isinf(x)]) = 0 and len([x for x in embedding if x <> 0]) > 0),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.98),
r as (select vec_id as a, vec_id as b from embeddings union select r.a, l.b from r join l on r.b = l.a),
c as (select a as vec_id, min(b) as component_id from r group by a), n as (select a as vec_id, count(*) as n_links from l group by a)
select vec_id, coalesce(n_links, 0)::bigint as n_links, component_id, component_id = vec_id as kept from c left join n using (vec_id)""",
    "op12_collocations": """
with d as (select row_number() over () as row, coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select lang, row, unnest(range(1, len(x) + 1)) as piece, unnest(x) as t from (select *, regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]') as x from d)),
w as (select lang, row, piece, unnest(range(1, len(x) + 1)) as i, unnest(x) as a from (select *, regexp_extract_all(t, '[^\\x20\\x09]+') as x from p)),
t as (select lang, a, lead(a, 1) over o as b, lead(a, 2) over o as c from w window o as (partition by row, piece order by i)),
n as (select lang, count(*) as n from t group by lang), f1 as (select lang, a, count(*) as f from t group by all), f2 as (select lang, a, b, count(*) as f from t where b is not null group by all),
f3 as (select lang, a, b, c, count(*) as f from t where c is not null group by all having count(*) >= 10),
two as (select x.lang, x.a || ' ' || x.b as phrase, x.f as a, y.f as l, z.f as r, (1000000::hugeint * x.f * x.f) // (y.f::hugeint * z.f) as score from f2 x join f1 y on x.lang = y.lang and x.a = y.a join f1 z on x.lang = z.lang and x.b = z.a where x.f >= 10),
cuts as (select x.lang, x.a || ' ' || x.b || ' ' || x.c as phrase, x.f as a, l1.f as l1, r1.f as r1, l2.f as l2, r2.f as r2, (1000000::hugeint * x.f * x.f) // (l1.f::hugeint * r1.f) as s1, (1000000::hugeint * x.f * x.f) // (l2.f::hugeint * r2.f) as s2
  from f3 x join f1 l1 on x.lang = l1.lang and x.a = l1.a join f2 r1 on x.lang = r1.lang and x.b = r1.a and x.c = r1.b join f2 l2 on x.lang = l2.lang and x.a = l2.a and x.b = l2.b join f1 r2 on x.lang = r2.lang and x.c = r2.a),
three as (select lang, phrase, a, case when s2 < s1 then l2 else l1 end as l, case when s2 < s1 then r2 else r1 end as r, least(s1, s2) as score from cuts),
inner2 as (select lang, phrase, max(f) as f from (select lang, a || ' ' || b as phrase, f from f3 union all select lang, b || ' ' || c, f from f3) group by all),
k as (select * from three union all select two.* from two left join inner2 i on two.lang = i.lang and two.phrase = i.phrase where i.f is null or 100 * i.f < 50 * two.a),
o as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from k)
select o.lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score from o join n on o.lang = n.lang where rank <= 2000""",
    "op13_periodic_runs": f"""
with d as (select row_number() over () as row, doc_id, {_CRC32} as h, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
e as (select *, h // 10 as g, len(w) as n from d), a as (select *, case when h % 10 = 0 and n > 0 then g % n end as a from e),
t as (select row, i - 1 as i, w[case when a is null or i <= a then i else a + (i - 1 - a) % (1 + (n - a) // (3 + g % 8)) + 1 end] as word from (select *, unnest(range(1, n + 1)) as i from a)),
s as (select row, i, concat_ws(' ', word, lead(word, 1) over x, lead(word, 2) over x, lead(word, 3) over x, lead(word, 4) over x, lead(word, 5) over x) as six, lead(word, 5) over x is not null as whole from t window x as (partition by row order by i)),
p as (select l.row, l.i, r.i - l.i as q from s l join s r on l.row = r.row and l.six = r.six and l.i < r.i where l.whole and r.whole),
c as (select row, q, min(i) as start, count(*) + 5 + q as length from (select *, i - row_number() over (partition by row, q order by i) as island from p) group by row, q, island having count(*) + 5 + q >= greatest(12, 2 * q)),
r as (select * from c where not exists (select 1 from c o where o.row = c.row and o.q < c.q and o.start <= c.start and o.start + o.length >= c.start + c.length)),
b as (select row, count(*) as n_runs, max(struct_pack(length := length, start := -start, q := -q)) as top, string_agg(start || ',' || length || ',' || q || chr(10), '' order by start, q) as lines from r group by row),
g as (select distinct row, unnest(range(start + q, start + length)) as i from r),
k as (select row, string_agg(word, ' ' order by i) as collapsed from t anti join g using (row, i) group by row)
select doc_id, coalesce(n_runs, 0)::bigint as n_runs, -top.start::bigint as start, top.length::bigint as length, -top.q::bigint as period, (1000 * top.length // -top.q)::bigint as exponent_milli, sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(collapsed, '')) as collapsed_sha256
from d left join b using (row) left join k using (row)""",
}
