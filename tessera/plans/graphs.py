"""Queries over graphs: nations and regions, customers' and suppliers' places, links between pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import web
from tessera.operators import graph
from tessera.plans.registry import registrar
from tessera.session import read

QUERIES: dict = {}
ORACLE: dict = {}
query = registrar(QUERIES, ORACLE)

EDGES = """e as (select 'n' || n_nationkey as src, 'r' || n_regionkey as dst, 'HAS_PARENT' as relation from nation
union select 'r' || n_regionkey, 'n' || n_nationkey, 'HAS_CHILD' from nation
union select 's' || s_suppkey, 'n' || s_nationkey, 'HAS_PARENT' from supplier union select 'n' || s_nationkey, 's' || s_suppkey, 'HAS_CHILD' from supplier)"""


def _edges(spark, d):
    n = read(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"), F.lit("HAS_PARENT").alias("relation"))
    s = read(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.concat(F.lit("n"), "s_nationkey").alias("dst"), F.lit("HAS_PARENT").alias("relation"))
    return graph.both_ways(n.unionByName(s), "HAS_CHILD")


@query(f"with {EDGES} select src, dst, relation, trim(regexp_replace(lower(src || ' ' || dst || ' ' || relation), '[^a-z0-9]+', '_', 'g'), '_') as edge_id from e")
def graph_build(spark, d):
    e = _edges(spark, d)
    return e.withColumn("edge_id", graph.edge_id(e))


@query(f"with recursive {EDGES}, b as (select src, dst from e union select dst, src from e), w as (select distinct 'r0' as seed, 'r0' as node, 0 as hops union all select w.seed, b.dst, w.hops + 1 from w join b on w.node = b.src where w.hops < 3) select seed, node, min(hops)::int as hops from w where node <> seed group by seed, node")
def k_hop(spark, d):
    return graph.k_hop(_edges(spark, d), spark.createDataFrame([("r0",)], "seed string"), 3).select("seed", "node", "hops")


@query(f"""with recursive {EDGES}, x as (select src as a, dst as z, 0 as way, src, dst, relation from e union all select dst, src, 1, src, dst, relation from e),
w as (select 'n' || n_nationkey as seed, 'n' || n_nationkey as node, 0 as hops from nation where n_nationkey % 5 = 0 union all select distinct w.seed, z, w.hops + 1 from w join x on w.node = x.a where w.hops < 3), h as (select seed, node, min(hops) as hops from w group by all),
v as (select h.seed, h.node, h.hops, x.src, x.dst, x.relation, row_number() over (partition by h.seed, h.node order by way, relation, a) as r from h join h p on p.seed = h.seed and p.hops = h.hops - 1 join x on x.a = p.node and x.z = h.node)
select seed, node, hops::int as hops, src as via_src, dst as via_dst, relation as via_relation from v where r = 1""")
def k_hop_edges(spark, d):
    seeds = read(spark, d, "nation").where("n_nationkey % 5 = 0").select(F.concat(F.lit("n"), "n_nationkey").alias("seed"))
    return graph.k_hop(_edges(spark, d), seeds, 3)


@query(f"with {EDGES}, c as (select dst as node, src as child from e where relation = 'HAS_PARENT' union select src, dst from e where relation = 'HAS_CHILD'), p as (select src as node, min(dst) as parent from e where relation = 'HAS_PARENT' group by src) select c.node, c.child, p.parent from c left join p on c.node = p.node")
def parent_children(spark, d):
    e = _edges(spark, d)
    return graph.children(e).join(graph.parents(e), "node", "left").select("node", "child", "parent")


@query("with l as (select distinct page_id as src, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*?href=\"/([A-Za-z]+)\"', 1)) as ref from pages), k as (select regexp_extract(url, '://[^/]*/([^/?#]*)', 1) as ref, max(page_id) as dst from pages group by 1) select src, ref, dst, case when dst is null then 0.4::double else 1.0 end as confidence from l left join k using (ref) where dst is null or dst <> src")
def explicit_refs(spark, d):
    p = read(spark, d, "pages")
    target = p.select("page_id", F.regexp_extract("url", "://[^/]*/([^/?#]*)", 1).alias("name"))
    return graph.references(p, "page_id", "html", r'(?i)<a\s[^>]*?href="/([A-Za-z]+)"', target, "page_id", "name")


@query("with l as (select page_id as node, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*?href=\"([^\"]*)\"', 1)) as link from pages) select link, count(*) as n, count(distinct node) as n_pages from l group by link")
def link_degrees(spark, d):
    links = read(spark, d, "pages").select("page_id", F.explode(web.links(F.col("html"))).alias("link"))
    return links.groupBy("link").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("page_id").alias("n_pages"))


@query(f"with {EDGES}, s as (select 'n' || n_nationkey as query_id, 'n' || n_nationkey as node from nation), x as (select s.query_id, dst as node, relation as via, case relation when 'HAS_PARENT' then 1 else 3 end as prio, row_number() over (partition by s.query_id, src, relation order by dst) as r from s join e on s.node = e.src), u as (select query_id, node, 'seed' as via, 0 as prio from s union all select query_id, node, via, prio from x where (via = 'HAS_PARENT' and r <= 1) or (via = 'HAS_CHILD' and r <= 3)) select query_id, node, first(via order by prio, via) as via, min(prio) as prio from u group by query_id, node")
def context_expand(spark, d):
    seeds = read(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("query_id"), F.concat(F.lit("n"), "n_nationkey").alias("node"))
    return graph.expand(seeds, _edges(spark, d), {"HAS_PARENT": 1, "HAS_CHILD": 3}, {"HAS_PARENT": 1, "HAS_CHILD": 3})
