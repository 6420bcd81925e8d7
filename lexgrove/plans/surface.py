"""Queries on the tool surface, the model lane with scripted clients, graph rows and streams' windows."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lexgrove.operators import gates, graph, model, references, review, windows
from lexgrove.plans import ladder, requirements, tools
from lexgrove.plans.registry import query, table
from lexgrove.sources import files
from lexgrove.streaming import metering

_S = "string"


def _id(prefix, column):
    return F.concat(F.lit(prefix), F.col(column).cast(_S))


@query("""
select 'n:' || n_nationkey as id, n_name as excerpt, false as truncated, 'applicable' as status from nation union all select 'n:99', null, null, 'rejected_as_unsupported'
""")
def source_traces(spark, d):
    nodes = table(spark, d, "nation").select(_id("n:", "n_nationkey").alias("id"), F.lit("Point").alias("type"), F.col("n_name").alias("text"), F.lit("s").alias("source_span"))
    ids = nodes.select("id").union(spark.createDataFrame([("n:99",)], "id string"))
    return tools.source_trace(nodes, ids).select("id", "excerpt", "truncated", "status")


@query("""
with a as (select c_custkey, 'norm:' || c_nationkey as s, 'goal:' || (c_custkey % 7) as t, c_custkey % 5 as m from customer)
select s as asked, 'a:' || c_custkey as assertion_id, case when m = 0 then 'mapping_run' else '' end as missing, case when m = 0 then 'requires_human_review' else 'applicable' end as status from a
union all select t, 'a:' || c_custkey, case when m = 0 then 'mapping_run' else '' end, case when m = 0 then 'requires_human_review' else 'applicable' end from a where t = 'goal:3'
""")
def alignment_traces(spark, d):
    a = table(spark, d, "customer").select(_id("a:", "c_custkey").alias("id"), _id("norm:", "c_nationkey").alias("source_norm_id"), F.concat(F.lit("goal:"), (F.col("c_custkey") % 7).cast(_S)).alias("target_id"), (F.col("c_custkey") % 5).cast(_S).alias("mapping_run_id"), F.lit("j").alias("judge_run_id"), F.lit("accepted").alias("judge_verdict"))
    runs = spark.createDataFrame([(str(i), "g") for i in range(1, 5)], "id string, generator_model string")
    judges = spark.createDataFrame([("j", "m", "fine")], "id string, judge_model string, rationale string")
    ids = a.select(F.col("source_norm_id").alias("id")).distinct().union(spark.createDataFrame([("goal:3",)], "id string"))
    return tools.trace_alignment(a, runs, judges, ids).select("asked", "assertion_id", F.array_join("missing", ",").alias("missing"), "status")


@query("""
select 'norm:' || o_orderkey as norm_id, 'text ' || (o_orderkey % 9) as source_text, case when o_orderkey % 2 = 0 then 'AI system,risk' else '' end as terms, case when o_orderkey % 3 = 0 then 1 else 0 end as n_alignments from orders
""")
def norm_explanations(spark, d):
    k = F.col("o_orderkey")
    norms = table(spark, d, "orders").select(_id("norm:", "o_orderkey").alias("norm_id"), (k % 9).cast(_S).alias("source_node_id"), F.when(k % 2 == 0, "manage the risk").otherwise("keep logs").alias("action"), F.when(k % 2 == 0, "of an AI system").otherwise("for a while").alias("object"))
    nodes = spark.range(9).select(F.col("id").cast(_S).alias("id"), _id("text ", "id").alias("text"))
    terms = spark.createDataFrame([("risk",), ("AI system",), ("placing on the market",)], "term string")
    assertions = table(spark, d, "orders").select(_id("norm:", "o_orderkey").alias("source_norm_id"), F.when(k % 3 == 0, "accepted").otherwise("rejected").alias("judge_verdict"))
    return tools.explain(norms, nodes, terms, assertions).select("norm_id", "source_text", F.array_join("terms", ",").alias("terms"), "n_alignments")


@query("""
select count(*) filter (p_size % 3 = 0) as n_articles, count(*) filter (p_size % 3 = 1) as n_recitals, 0 as n_annexes, count(*) filter (p_size % 3 = 2) as n_paragraphs, false as complete,
  (select count(*) from orders where o_orderstatus = 'F') as n_norms_accepted, (select count(*) from orders where o_orderstatus = 'O') as n_norms_rejected, 0 as n_norms_needs_human_review from part
""")
def graph_coverage(spark, d):
    kind = F.element_at(F.array(F.lit("Article"), F.lit("Recital"), F.lit("Paragraph")), (F.col("p_size") % 3 + 1).cast("int"))
    norms = table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "F", "accepted").when(F.col("o_orderstatus") == "O", "rejected").otherwise("open").alias("judge_verdict"))
    return tools.coverage(table(spark, d, "part").select(kind.alias("type")), norms)


@query("""
select 's:' || d.doc_id as span_id, case when d.doc_id % 3 = 0 then null when n < 0 then null else substr(text, 3, least(8, n)) end as text, case when d.doc_id % 3 = 0 then 'checksum_mismatch' when n < 0 then 'bad_offsets' end as reason
from (select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) - 2 as n from documents) d
""")
def span_texts(spark, d):
    texts = table(spark, d, "documents").select(F.col("doc_id").cast(_S).alias("file"), F.lit("x").alias("sha256"), F.coalesce("text", F.lit("")).alias("text"))
    stop = F.when(F.length("text") >= 2, F.least(F.lit(10), F.length("text"))).otherwise(10)
    wanted = texts.select(F.concat(F.lit("s:"), F.col("file")).alias("span_id"), "file", F.when(F.col("file").cast("long") % 3 == 0, "y").otherwise("x").alias("snapshot_sha256"), F.lit(2).alias("start"), stop.alias("stop"))
    return files.spans(texts, wanted)


_PROOF = "case when o_orderkey % 3 = 0 then 'LLM_ACCEPTED' when o_orderkey % 3 = 1 then 'LLM_REJECTED' else 'LLM_PROPOSED' end"


@query(f"""
select 'norm:' || o_orderkey as src, o.dst, o.edge_type, {_PROOF} as provenance_class, 'edge:' || lower(o.edge_type) || ':norm:' || o_orderkey || ':' || o.dst as edge_id from orders,
  lateral (values ('art:' || o_custkey, 'DERIVED_FROM'), ('run:1', 'JUDGED_BY'), (case when o_orderkey % 2 = 0 then 'cond:a' end, 'HAS_CONDITION'), (case when o_orderkey % 5 = 0 then 'exc:b' end, 'HAS_EXCEPTION')) o(dst, edge_type) where o.dst is not null
""")
def norm_graph_rows(spark, d):
    k = F.col("o_orderkey")
    none = F.array().cast("array<string>")
    verdict = F.when(k % 3 == 0, "accepted").when(k % 3 == 1, "rejected").otherwise("needs_human_review")
    norms = table(spark, d, "orders").select(_id("norm:", "o_orderkey").alias("norm_id"), _id("art:", "o_custkey").alias("source_node_id"), F.lit("run:1").alias("judge_run_id"), verdict.alias("judge_verdict"), F.when(k % 2 == 0, F.array(F.lit("cond:a"))).otherwise(none).alias("condition_ids"), F.when(k % 5 == 0, F.array(F.lit("exc:b"))).alias("exception_ids"))
    return graph.of_norms(norms, "b1")[1].select("src", "dst", "edge_type", "provenance_class", "edge_id")


@query("""
with e as (select o.dst, o.edge_type, 'al:' || c_custkey as src from customer, lateral (values ('norm:' || c_nationkey, 'ASSERTS_ALIGNMENT_OF'), ('goal:1', 'ASSERTS_ALIGNMENT_TO'), ('m:1', 'PRODUCED_BY_MAPPING_RUN'), ('j:1', 'JUDGED_BY')) o(dst, edge_type))
select edge_type, count(*) as n, count(distinct dst) as n_targets from e group by edge_type
""")
def alignment_graph_rows(spark, d):
    a = table(spark, d, "customer").select(_id("al:", "c_custkey").alias("id"), _id("norm:", "c_nationkey").alias("source_norm_id"), F.lit("goal:1").alias("target_id"), F.lit("m:1").alias("mapping_run_id"), F.lit("j:1").alias("judge_run_id"), F.lit("accepted").alias("judge_verdict"))
    return graph.of_alignments(a, "b1")[1].groupBy("edge_type").agg(F.count("*").alias("n"), F.count_distinct("dst").alias("n_targets"))


@query("""
select 'cond:' || substr(sha256(lower(trim(c_mktsegment))), 1, 12) as id, 'Condition' as type, ' ' || c_mktsegment as first_text from customer group by c_mktsegment
""")
def clause_nodes(spark, d):
    none = F.array().cast("array<string>")
    norms = table(spark, d, "customer").select(_id("norm:", "c_custkey").alias("norm_id"), F.lit("provider").alias("actor_explicit"), F.lit(None).cast(_S).alias("actor_inferred"), F.array(F.col("c_mktsegment"), F.lit(" ")).alias("conditions"), none.alias("exceptions"))
    return review.clauses(norms)[1].select("id", "type", F.concat(F.lit(" "), "text").alias("first_text"))


@query("""
select 'G1' as gate, 'p:' || p_partkey as id from part where p_size > 25
union all select 'G2', 'p:' || p_partkey from part where p_partkey % 4 = 3
union all select 'G3', 'norm:' || o_orderkey from orders where o_orderkey % 10 = 0
union all select 'G5', 'p:' || p_partkey from part where p_partkey % 2 = 1
""")
def build_gate_violations(spark, d):
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    nodes = p.select(_id("p:", "p_partkey").alias("id"), F.lit(1).alias("layer"), F.lit("Recital").alias("type"), (k % 2 == 1).alias("binding"), F.lit(None).cast(_S).alias("legal_status"), (k % 4).cast(_S).alias("span_sha256"))
    root = spark.createDataFrame([("root", 1, "Regulation", None, None, None)], nodes.schema)
    edges = p.filter("p_size <= 25").select(_id("e:", "p_partkey").alias("edge_id"), F.lit("HAS_RECITAL").alias("edge_type"), F.lit("root").alias("src"), _id("p:", "p_partkey").alias("dst"))
    norms = table(spark, d, "orders").select(_id("norm:", "o_orderkey").alias("norm_id"), F.when(F.col("o_orderkey") % 10 == 0, "").otherwise("s").alias("source_span_id"))
    return gates.build_gates(nodes.union(root), edges, spark.createDataFrame([("0",), ("1",), ("2",)], "sha256 string"), norms)


@query("""
select o_orderkey as ord, case o_orderkey % 4 when 0 then 'title' when 1 then 'no_norms' when 2 then 'unknown_norms' end as reason from orders
""")
def backlog_reasons(spark, d):
    k = F.col("o_orderkey")
    ids = F.when(k % 4 == 1, F.array().cast("array<string>")).when(k % 4 == 2, F.array(F.lit("n1"), F.lit("n9"))).otherwise(F.array(F.lit("n1")))
    items = table(spark, d, "orders").select(k.alias("ord"), F.when(k % 4 == 0, " ").otherwise("t").alias("title"), F.lit("d").alias("description"), ids.alias("norm_ids"))
    return model.backlog(items, spark.createDataFrame([("n1",)], "norm_id string")).select("ord", "reason")


@query("select count(*) as n_edges, (select count(*) from (select c_nationkey from customer union select 100 + c_custkey % 10 from customer)) as n_nodes from (select distinct c_nationkey, c_custkey % 10 as t, c_custkey % 3 as v from customer)")
def evidence_subgraph(spark, d):
    k = F.col("c_custkey")
    edges = table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("src"), (k % 10 + 100).alias("dst"), (k % 3).alias("via"), F.lit("CITES").alias("relation"))
    nodes, kept = graph.subgraph(edges)
    return kept.agg(F.count("*").alias("n_edges")).withColumn("_k", F.lit(1)).join(nodes.agg(F.count("*").alias("n_nodes")).withColumn("_k", F.lit(1)), "_k").drop("_k")


@query("select c_custkey from customer where c_nationkey < 20 and c_custkey % 30 < 25")
def edges_that_land_twice(spark, d):
    edges = table(spark, d, "customer").select("c_custkey", _id("n:", "c_nationkey").alias("src"), F.concat(F.lit("n:"), (F.col("c_custkey") % 30).cast(_S)).alias("dst"))
    ids = table(spark, d, "nation").select(_id("n:", "n_nationkey").alias("id"))
    ids = ids.union(ids)
    return review.landing(edges.filter("c_nationkey < 20"), ids).select("c_custkey")


@query("""
with w as (select unnest([floor(epoch(ts))::bigint // 300 * 300, floor(epoch(ts))::bigint // 300 * 300 - 300]) as s from events)
select make_timestamp(s * 1000000) as start, make_timestamp((s + 600) * 1000000) as stop, count(*) as n from w group by s
""")
def sliding_usage(spark, d):
    found = metering.sliding(table(spark, d, "events"), "ts", "10 minutes", "5 minutes")
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("stop"), "n")


@query("""
with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as new from events),
s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as g from e)
select user_id as client, min(ts) as start, count(*) as n from s group by user_id, g
""")
def session_usage(spark, d):
    found = metering.sessions(table(spark, d, "events").filter("user_id is not null"), "ts", "user_id", "30 minutes")
    return found.select("client", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("select c_custkey, c_custkey % 3 in (0, 1) as acts from customer")
def actor_requirements(spark, d):
    k = F.col("c_custkey") % 3
    explicit = F.when(k == 0, "Providers of high-risk AI systems").when(k == 2, "importers")
    return table(spark, d, "customer").select("c_custkey", requirements.acts(explicit, F.when(k == 1, "provider"), "provider").alias("acts"))


@query("select c_custkey, case when c_custkey % 2 = 0 then 'a,b' else 'b' end as known, case when c_custkey % 2 = 0 then 'a' else '' end as rest from customer")
def cleaned_facts(spark, d):
    flags = F.create_map(F.lit("a"), F.when(F.col("c_custkey") % 2 == 0, True), F.lit("b"), F.lit(False), F.lit("other"), F.lit(True))
    clean = ladder.cleaned(flags, ["a", "b"])
    out = table(spark, d, "customer").select("c_custkey", clean.alias("x"))
    return out.select("c_custkey", F.array_join(F.array_sort(F.map_keys("x")), ",").alias("known"), F.array_join(F.map_keys(ladder.changed(F.col("x"), ["b"], None)), ",").alias("rest"))


@query("select n_name as role, n_nationkey % 3 > 0 as matches from nation")
def chain_checks(spark, d):
    k = F.col("n_nationkey")
    recorded = table(spark, d, "nation").select(F.col("n_name").alias("role"), F.lit("x").alias("sha"))
    live = table(spark, d, "nation").filter(k % 6 != 0).select(F.col("n_name").alias("role"), F.when(k % 3 == 0, "y").otherwise("x").alias("sha"))
    return review.chain_matches(recorded, live)


@query("select o_orderkey, case o_orderkey % 4 when 0 then 0 when 1 then 2 when 2 then 3 else 1 end as layer from orders")
def identifier_layers(spark, d):
    kind = F.element_at(F.array(F.lit("file:"), F.lit("norm:"), F.lit("align:"), F.lit("r:article-")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", graph.layer(F.concat(kind, F.col("o_orderkey").cast(_S))).alias("layer"))


def _scripted():
    good = {"verdict": "accepted", "scores": dict.fromkeys(model.DIMENSIONS, 0.8), "rationale": "fits"}
    return model.ScriptedClient([("BUILDING", json.dumps(good)), ("MACHINERY", json.dumps({"verdict": "maybe"})), ("FURNITURE", "no object")], json.dumps(good | {"verdict": "rejected"}))


@query("""
select c_custkey as id, case c_mktsegment when 'BUILDING' then 'accepted' when 'MACHINERY' then 'needs_human_review' when 'FURNITURE' then 'needs_human_review' else 'rejected' end as judge_verdict,
  case when c_mktsegment in ('MACHINERY', 'FURNITURE') then 0.0::double else round((0.8::double * 5) / 5, 6) end as final_score from customer
""")
def grounded_answers(spark, d):
    answers = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("yes").alias("answer_text"), F.col("c_mktsegment").alias("evidence_text"))
    return model.ground_check(answers, _scripted, "judge").select("id", "judge_verdict", F.round("final_score", 6).alias("final_score"))


@query("select 'edge-' || row_number() over (order by o_orderkey, n) as edge_id, o_orderkey as from_id, 'r:article-' || n as target from (select o_orderkey, unnest(range(o_orderkey % 9 + 1, o_orderkey % 9 + 4)) as n from orders)")
def numbered_references(spark, d):
    k = F.col("o_orderkey") % 9
    texts = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("Articles "), (k + 1).cast(_S), F.lit(" to "), (k + 3).cast(_S)).alias("t"))
    nodes = spark.range(1, 20).select(_id("r:article-", "id").alias("id"))
    edges, _ = references.resolve(texts, "o_orderkey", "t", nodes, "r")
    return references.numbered(edges, "edge-").select("edge_id", "from_id", "target")


@query("select event_id, lag(event_id, 1) over (order by ts, event_id) as before from events")
def global_places(spark, d):
    placed = windows.positions(table(spark, d, "events").select("ts", "event_id"), ["ts", "event_id"], "at")
    after = placed.select((F.col("at") + 1).alias("at"), F.col("event_id").alias("before"))
    return placed.join(after, "at", "left").select("event_id", "before")
