"""Queries on answers, their evidence, and the operators around a build."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexgrove.operators import dedup, evidence, gates, hierarchy, references, review, windows
from lexgrove.plans import requirements
from lexgrove.plans.registry import query, table

_STATUS = ("applicable", "satisfied_by_evidence", "requires_human_review")


@query(f"""
select o_orderkey, ['applicable', 'satisfied_by_evidence', 'requires_human_review'][cast(o_orderkey % 3 as integer) + 1] as status, 1.0::double as confidence, 'eu:' || o_custkey as source_nodes,
  case when o_orderkey % 5 = 0 then 1 else 0 end as n_missing, 'not_applicable_deterministic' as judge_verdict, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000000+00:00') as generated_at, 'g1' as graph_version,
  {len(evidence.NOTICE)} as notice_chars, 12 as n_fields from orders
""")
def answer_envelope(spark, d):
    k = F.col("o_orderkey")
    status = F.element_at(F.array(*[F.lit(x) for x in _STATUS]), (k % 3 + 1).cast("int"))
    whole = evidence.envelope(F.lit("x"), status, "g1", nodes=F.array(F.concat(F.lit("eu:"), F.col("o_custkey").cast("string"))), missing=F.when(k % 5 == 0, F.array(F.lit("domain"))), at=F.col("o_orderdate").cast("timestamp"))
    out = table(spark, d, "orders").select("o_orderkey", whole.alias("e"))
    return out.select(
        "o_orderkey", "e.status", "e.confidence", F.array_join("e.source_nodes", ",").alias("source_nodes"), F.size("e.missing_facts").alias("n_missing"), "e.judge_verdict", "e.generated_at", "e.graph_version",
        F.length("e.non_legal_advice_notice").alias("notice_chars"), F.lit(len(out.schema["e"].dataType.fieldNames())).alias("n_fields"),
    )


@query("""
select l_orderkey, l_linenumber, case when l_linenumber = 1 then 'providers of AI systems' else 'deployer' end as actor, case when l_linenumber = 1 then 'explicit' else 'inferred' end as actor_source,
  case when l_returnflag = 'A' then 'where needed' end as conditions, case when l_linestatus = 'F' then 'small firms|research' end as exceptions from lineitem
""")
def requirement_projection(spark, d):
    none = F.array().cast("array<string>")
    explicit = F.when(F.col("l_linenumber") == 1, "providers of AI systems").when(F.col("l_linenumber") == 2, "")
    entry = evidence.requirement(explicit, F.lit("deployer"), F.when(F.col("l_returnflag") == "A", F.array(F.lit("where needed"))).otherwise(none), F.when(F.col("l_linestatus") == "F", F.array(F.lit("small firms"), F.lit("research"))))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", entry.alias("e")).select("l_orderkey", "l_linenumber", "e.actor", "e.actor_source", F.array_join("e.conditions", "|").alias("conditions"), F.array_join("e.exceptions", "|").alias("exceptions"))


@query("""
select c_custkey, case when c_nationkey < 20 then 'n:' || c_nationkey || ',n:' || (c_nationkey + 5) else 'n:' || c_nationkey end as source_nodes, case when c_nationkey < 20 then '' else 'not in the graph: n:' || (c_nationkey + 5) end as missing_facts from customer
""")
def checked_citations(spark, d):
    cited = F.array(F.concat(F.lit("n:"), F.col("c_nationkey").cast("string")), F.concat(F.lit("n:"), (F.col("c_nationkey") + 5).cast("string")))
    nodes = table(spark, d, "nation").select(F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("id"))
    found = evidence.checked(table(spark, d, "customer").select("c_custkey", cited.alias("cited")), "c_custkey", "cited", nodes)
    return found.select("c_custkey", F.array_join("source_nodes", ",").alias("source_nodes"), F.array_join("missing_facts", ",").alias("missing_facts"))


@query("select p_partkey as id, 'Paragraph' as type, 's:' || p_partkey as span_id, p_size as span_start, p_size + 10 as span_stop from part")
def flat_nodes(spark, d):
    span = F.struct(F.concat(F.lit("s:"), F.col("p_partkey").cast("string")).alias("span_id"), F.col("p_size").alias("start"), (F.col("p_size") + 10).alias("stop"))
    return evidence.flat_nodes(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit("Paragraph").alias("type"), span.alias("source_span")))


@query("select p_partkey, case p_size % 4 when 1 then 'Bad Label' when 2 then 'article' else null end as label from part where p_size % 4 > 0")
def refused_labels(spark, d):
    label = F.when(F.col("p_size") % 4 == 0, "Article").when(F.col("p_size") % 4 == 1, "Bad Label").when(F.col("p_size") % 4 == 2, "article")
    return evidence.refused(table(spark, d, "part").select("p_partkey", label.alias("label")), "label", evidence.NODE_LABELS)


@query("""
with a as (select o_orderkey, o_orderkey % 120 as n from orders)
select o_orderkey, case when o_orderkey % 2 = 0 then n between 5 and 27 or n in (50, 72, 73) else o_orderkey % 3 = 0 end as candidate from a
""")
def usage_candidates(spark, d):
    k = F.col("o_orderkey")
    node = F.when(k % 2 == 0, F.concat(F.lit("r:article-"), (k % 120).cast("string"), F.lit(":paragraph-1"))).when(k % 3 == 0, F.lit("r:annex-iii:point-1")).otherwise(F.lit("r:annex-iii"))
    return table(spark, d, "orders").select("o_orderkey", evidence.usage_candidate(node).alias("candidate"))


@query("select c_custkey, case when c_custkey % 3 = 0 then '?' else 'provider' end || ' shall ' || c_mktsegment || ' ' || case when c_custkey % 4 = 0 then '?' else 'records' end as line from customer")
def norm_digests(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", evidence.norm_digest(F.when(k % 3 != 0, "provider"), F.lit("shall"), F.col("c_mktsegment"), F.when(k % 4 == 0, "").otherwise("records")).alias("line"))


@query("select o_orderkey, case when o_orderkey % 7 = 0 or o_orderkey % 11 = 0 then null else o_totalprice end as value from orders")
def finite_values(spark, d):
    k = F.col("o_orderkey")
    value = F.when(k % 7 == 0, float("nan")).when(k % 11 == 0, float("-inf")).otherwise(F.col("o_totalprice"))
    return table(spark, d, "orders").select("o_orderkey", evidence.finite(value).alias("value"))


@query("select o_orderkey, o_orderkey % 4 in (0, 1) as claims from orders")
def claims_scan(spark, d):
    k = F.col("o_orderkey") % 4
    own = F.when(k == 0, "The system is Compliant.").when(k == 1, "legally approved").when(k == 2, "needs review")
    answer = evidence.without_quotes(F.struct(own.alias("summary"), F.lit("certified bodies").alias("excerpt")), ("excerpt",))
    return table(spark, d, "orders").select("o_orderkey", evidence.claims(F.to_json(answer)).alias("claims"))


@query("select p_partkey as id, p_name as text from part where p_size % 3 < 2")
def index_passages(spark, d):
    kind = F.when(F.col("p_size") % 3 == 0, "Article").when(F.col("p_size") % 3 == 1, "Recital").otherwise("Chapter")
    return evidence.passages(table(spark, d, "part").select(F.col("p_partkey").alias("id"), kind.alias("type"), F.col("p_name").alias("text")), ("Article", "Recital"))


@query("""
select o_orderkey as item_id, 'minimal_or_none' as gold, 'high_risk' as predicted, case when o_orderkey % 2 = 0 then 'biometric_categorisation' end as trigger from orders where o_orderkey % 6 in (0, 1)
""")
def over_classified(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders")
    results = o.select(k.alias("item_id"), F.when(k % 3 < 2, "high_risk").otherwise("uncertain").alias("predicted"), F.when(k % 2 == 0, "rule 4; trigger: biometric_categorisation").otherwise("rule 4").alias("rationale"))
    items = o.select(k.alias("item_id"), F.when(k % 6 < 2, "minimal_or_none").otherwise("high_risk").alias("gold"))
    return evidence.over_classified(results, items, [("minimal_or_none", "high_risk"), ("transparency_only", "high_risk")])


@query("""
with m as (select role, avg(length(text)) as c, count(*) as n from conversations group by role)
select role, n, round_even(c / 4, 0) as tokens, round_even(round_even(c / 4, 0) * 0.75, 0) as low, round_even(round_even(c / 4, 0) * 1.25, 0) as high, round_even(c / 4, 0) * n * 2.5 / 1e6 as cost from m
""")
def output_sizes(spark, d):
    return evidence.output_sizes(table(spark, d, "conversations"), ["role"], "text", 2.5)


@query("""
with m as (select event_type as kind, count(*) as n, min(event_id) as f from events group by event_type)
select kind, n, cast(row_number() over (order by n desc, f) as integer) as place from m
""")
def census_order(spark, d):
    return evidence.most_common(table(spark, d, "events").select(F.col("event_type").alias("kind"), "event_id"), "kind", "event_id")


@query("select case c_custkey % 6 when 2 then 'that system' else 'Office' end as raw, count(*) as n from customer where c_custkey % 6 in (2, 3) group by 1")
def unresolved_actors(spark, d):
    k = F.col("c_custkey") % 6
    raw = F.when(k == 0, "the Providers of high-risk AI systems").when(k == 1, "European Commission").when(k == 2, "that system").when(k == 3, "Office").when(k == 4, " ").otherwise("market surveillance authorities")
    named = table(spark, d, "customer").select(raw.alias("raw")).withColumn("method", requirements.canonical_actor(F.col("raw"))["method"])
    return evidence.unresolved(named)


@query("select doc_id, row_number() over (order by lang, source, doc_id) - 1 as doc_ord from documents")
def document_order(spark, d):
    return windows.positions(table(spark, d, "documents").select("doc_id", "lang", "source"), ["lang", "source", "doc_id"], "doc_ord").select("doc_id", "doc_ord")


@query("""
with l as (select 'judge' as log_kind, cast(ts as varchar) as ts, 'accepted' as verdict from events where event_type = 'click' union all select 'norm', null, 'rejected' from events where event_type = 'error')
select log_kind, verdict, count(*) as n, row_number() over (order by min(coalesce(ts, ''))) as place from l group by log_kind, verdict
""")
def merged_log_order(spark, d):
    e = table(spark, d, "events")
    logs = [("judge", e.filter("event_type = 'click'").select(F.col("ts").cast("string").alias("ts"), F.lit("accepted").alias("verdict"), F.lit("m").alias("model"))), ("norm", e.filter("event_type = 'error'").select(F.lit(None).cast("string").alias("ts"), F.lit("rejected").alias("verdict"), F.lit("m").alias("model")))]
    ordered = windows.positions(review.consolidated(logs).withColumn("_ts", F.coalesce("ts", F.lit(""))), ["_ts"], "at")
    per = ordered.groupBy("log_kind", "verdict").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    return windows.positions(per, ["at"], "place").select("log_kind", "verdict", "n", (F.col("place") + 1).alias("place"))


@query("""
select o_orderkey, case when o_orderkey % 2 = 0 then 'article-' || o_custkey || '-paragraph-1_annex-i_plus1_' || substr(sha1('r:article-' || o_custkey || ':paragraph-1,r:annex-i,x'), 1, 8)
  else 'article-' || o_custkey || '-paragraph-1_' || substr(sha1('r:article-' || o_custkey || ':paragraph-1'), 1, 8) end as slug from orders
""")
def file_slugs(spark, d):
    first = F.concat(F.lit("r:article-"), F.col("o_custkey").cast("string"), F.lit(":paragraph-1"))
    ids = F.when(F.col("o_orderkey") % 2 == 0, F.array(first, F.lit("r:annex-i"), F.lit("x"))).otherwise(F.array(first))
    return table(spark, d, "orders").select("o_orderkey", evidence.file_slug(ids, "r").alias("slug"))


@query("""
select 'P1' as gate, 3 as n union all select 'P2', 0 union all select 'P3', (select count(*) from orders where o_orderkey % 5 = 0 and o_orderkey % 2 = 0)
union all select 'P4', (select count(*) from customer where c_custkey % 4 = 0) union all select 'P5', (select count(*) from nation where n_nationkey % 7 = 0)
""")
def post_load_gates(spark, d):
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    norms = table(spark, d, "orders").select(F.when(k % 2 == 0, "accepted").otherwise("rejected").alias("judge_verdict"), F.when(k % 5 == 0, "").otherwise("s").alias("source_span_id"))
    spans = F.array(F.lit("s"))
    assertions = table(spark, d, "customer").select(F.lit("accepted").alias("judge_verdict"), spans.alias("source_evidence_span_ids"), F.when(c % 4 == 0, F.array().cast("array<string>")).otherwise(spans).alias("target_evidence_span_ids"))
    edges = table(spark, d, "nation").select(F.when(F.col("n_nationkey") % 7 == 0, F.lit(None)).otherwise(F.lit("b1")).alias("build_id"))
    return gates.post_load(norms, norms.count() + 3, assertions, assertions.count(), edges, "b1")


@query("""
with leaves as (select p_partkey, p_name, row_number() over (order by p_size, p_partkey) as r from part where p_name <> '')
select 'gold:ret-' || lpad(cast(r as varchar), 2, '0') as item_id, 'ret' as kind, 'Which provision says: ' || substr(p_name, 1, 80) as question, 'r:annex-' || p_partkey as gold_citation from leaves where r <= 28
""")
def gold_drafts(spark, d):
    nodes = table(spark, d, "part").select(F.concat(F.lit("r:annex-"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("text"), F.col("p_size").alias("size"), "p_partkey")
    return evidence.drafts(nodes.select("id", "text", (F.col("size").cast("long") * 1_000_000_000 + F.col("p_partkey")).alias("ord")), "ret", 28)


@query("""
select o_orderkey, case when o_orderkey % 3 = 0 then 'r:article-' || (o_orderkey % 50) when o_orderkey % 3 = 1 then 'r:article-7' else 'r:other' end as source from orders
""")
def reference_sources(spark, d):
    k = F.col("o_orderkey")
    node = F.when(k % 3 == 0, F.concat(F.lit("r:article-"), (k % 50).cast("string"), F.lit(":paragraph-2"))).when(k % 3 == 1, F.lit("r:p7")).otherwise(F.lit("r:other"))
    edges = table(spark, d, "orders").select("o_orderkey", node.alias("from_id"))
    return references.article_source(edges, spark.createDataFrame([("r:article-7", "r:p7")], "src string, dst string")).select("o_orderkey", "source")


@query("""
select o_orderkey as from_id, 'r:article-' || (o_orderkey % 30 + 1) as target, 'CONTEXT_FOR' as edge_type from orders where o_orderkey % 4 = 0 and o_orderkey % 30 < 20
""")
def recital_context(spark, d):
    nodes = spark.range(1, 21).select(F.concat(F.lit("r:article-"), F.col("id").cast("string")).alias("id"))
    edges, _ = references.context_edges(_recitals(spark, d), "o_orderkey", "t", nodes, "r")
    return edges.select("from_id", "target", "edge_type")


def _recitals(spark, d):
    k = F.col("o_orderkey")
    after = F.when(k % 4 == 0, " of this Regulation and the Charter").when(k % 4 == 1, " TFEU").when(k % 4 == 2, " of that Directive").otherwise(" of the Treaties")
    return table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("See Article "), (k % 30 + 1).cast("string"), after, F.lit(".")).alias("t"))


@query("""
select o_orderkey as from_id, case when o_orderkey % 4 = 0 then 'unresolved_target' else 'external_instrument' end as reason from orders where o_orderkey % 4 > 0 or o_orderkey % 30 >= 20
""")
def recital_queue(spark, d):
    nodes = spark.range(1, 21).select(F.concat(F.lit("r:article-"), F.col("id").cast("string")).alias("id"))
    return references.context_edges(_recitals(spark, d), "o_orderkey", "t", nodes, "r")[1].select("from_id", "reason")


@query("""
with p as (select doc_id, lang, source, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as t from documents),
j as (select a.doc_id as id_a, b.doc_id as id_b, len(list_intersect(a.t, b.t)) as i, len(a.t) + len(b.t) as n from p a join p b on a.lang is not distinct from b.lang and a.source is not distinct from b.source and a.doc_id < b.doc_id),
s as (select id_a, id_b, round(i::double / (n - i), 4) as similarity from j where n > i and i * 5 >= (n - i) * 3)
select id_a, id_b, similarity, row_number() over (order by similarity desc, id_a, id_b) as place from s
""")
def near_dup_report(spark, d):
    pairs = dedup.near_duplicate_pairs(table(spark, d, "documents"), "doc_id", F.col("text"), ["lang", "source"])
    rows = dedup.ordered(pairs).select("id_a", "id_b", "similarity", (-F.col("similarity")).alias("_s"))
    return windows.positions(rows, ["_s", "id_a", "id_b"], "place").select("id_a", "id_b", "similarity", (F.col("place") + 1).alias("place"))


@query("""
with n as (select n_regionkey, '{"id":"n' || n_nationkey || '","name":"' || n_name || '","customers":' || (select count(*) from customer where c_nationkey = n_nationkey) || '}' as j, n_nationkey from nation),
queue as (select item_id, text from (select 'd' || doc_id as item_id, substring(trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g'), ' '), 1, 40) as text, n_chars, doc_id from documents where doc_id not in (select doc_id from labels)) order by n_chars desc, doc_id limit 20)
select 'r' || r_regionkey as id, (select count(*) from events) as n_events, (select count(distinct event_type) from events) as n_kinds, (select count(*) from documents where doc_id not in (select doc_id from labels)) as n_pending,
  '{"id":"r' || r_regionkey || '","name":"' || r_name || '"' || coalesce(',"children":[' || (select string_agg(j, ',' order by n_nationkey) from n where n_regionkey = r_regionkey) || ']', '') || '}' as structure,
  (select string_agg(item_id, ',' order by item_id) from queue) as queue from region
""")
def interface_export(spark, d):
    """What an interface shows: counts, the first of what waits for review, and each region's structure as one tree."""
    null, name = F.lit(None), lambda mark, c: F.concat(F.lit(mark), F.col(c).cast("string"))
    per = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    nation = table(spark, d, "nation").join(per, "n_nationkey", "left")
    nodes = table(spark, d, "region").select(name("r", "r_regionkey").alias("id"), null.cast("string").alias("parent"), F.col("r_regionkey").cast("long").alias("o"), F.col("r_name").alias("name"), null.cast("long").alias("customers"))
    nodes = nodes.union(nation.select(name("n", "n_nationkey"), name("r", "n_regionkey"), F.col("n_nationkey").cast("long"), "n_name", F.coalesce("n", F.lit(0))))
    trees = hierarchy.nested(nodes, "id", "parent", ["o"], F.struct("id", "name", "customers")).withColumnRenamed("json", "structure")
    pending = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti")
    first = review.pending([("document", pending.orderBy(F.desc("n_chars"), "doc_id").limit(20).select(name("d", "doc_id").alias("item_id"), "text"))], pending.limit(0).select(F.col("lang").alias("item_id")))
    counts = table(spark, d, "events").agg(F.count("*").alias("n_events"), F.count_distinct("event_type").alias("n_kinds"))
    waiting = pending.agg(F.count("*").alias("n_pending"))
    shown = first.agg(F.array_join(F.array_sort(F.collect_list("item_id")), ",").alias("queue"))  # 20 rows
    return trees.join(F.broadcast(counts)).join(F.broadcast(waiting)).join(F.broadcast(shown)).select("id", "n_events", "n_kinds", "n_pending", "structure", "queue")  # one row each


@query("""
with n as (select n_nationkey + 1 as n from nation where n_nationkey < 13)
select 'annex_order' as gate, 'xiv' as id from n where n = 5
""")
def annex_order_gate(spark, d):
    n = (F.col("n_nationkey") + 1).cast("int")
    from lexgrove.functions.text import roman

    annexes = table(spark, d, "nation").filter("n_nationkey < 13").select(n.alias("n"), F.when(n == 5, "xiv").otherwise(roman(n)).alias("numeral"))
    return gates.annex_gates(annexes)
