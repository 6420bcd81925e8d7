"""Queries on order, groups, joins and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexgrove.operators import joins, review, windows
from lexgrove.plans.registry import query, table
from lexgrove.streaming import metering


@query("select event_id, last_value(case when event_type = 'purchase' then value end ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding) as last_purchase from events")
def forward_fill_context(spark, d):
    value = F.when(F.col("event_type") == "purchase", F.col("value"))
    return windows.carried(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], value, "last_purchase").select("event_id", "last_purchase")


@query("""
with e as (select event_id, user_id, ts, case event_type when 'signup' then 1 when 'purchase' then 2 when 'error' then 3 else 4 end as r from events),
w as (select *, min(case when r <= 1 then event_id end) over x as m1, min(case when r <= 2 then event_id end) over x as m2, min(case when r <= 3 then event_id end) over x as m3, min(event_id) over x as m4
  from e window x as (partition by user_id order by event_id rows between 1 following and unbounded following))
select event_id, coalesce(case r when 1 then m1 when 2 then m2 when 3 then m3 else m4 end, -1) as closes_at from w
""")
def next_greater_rank(spark, d):
    rank = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "error", 3).otherwise(4)
    events = table(spark, d, "events").select("event_id", "user_id", rank.alias("r"))
    return windows.next_of_rank(events, ["user_id"], ["event_id"], "r", "event_id", [1, 2, 3, 4], F.lit(-1), "closes_at").select("event_id", "closes_at")


@query("""
with r as (select l_partkey, l_orderkey, l_linenumber, row_number() over (partition by l_partkey order by l_orderkey, l_linenumber) as rank, count(*) over (partition by l_partkey) as total from lineitem)
select l_partkey, l_orderkey, l_linenumber, cast(rank as integer) as rank, total from r where rank <= 30
""")
def cap_with_total(spark, d):
    lines = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber")
    return windows.capped(lines, ["l_partkey"], ["l_orderkey", "l_linenumber"], 30, "total", "rank")


@query("with r as (select l_orderkey, l_partkey, l_extendedprice, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber) as k from lineitem) select l_orderkey, l_partkey, l_extendedprice from r where k = 1")
def first_per_group(spark, d):
    return windows.first_per_group(table(spark, d, "lineitem"), ["l_orderkey"], [F.desc("l_extendedprice"), "l_linenumber"]).select("l_orderkey", "l_partkey", "l_extendedprice")


@query("""
with r as (select doc_id, quality, toxic, row_number() over (partition by quality, toxic order by sha256(cast(doc_id as varchar))) as k, count(*) over (partition by quality, toxic) as n from labels)
select doc_id, quality, toxic from r where k <= greatest(3, n // 20)
""")
def stratified_hash_sample(spark, d):
    labels = table(spark, d, "labels")
    sizes = labels.groupBy("quality", "toxic").agg(F.greatest(F.lit(3), F.floor(F.count("*") / 20)).alias("k"))
    return windows.hash_sample(labels, ["quality", "toxic"], "doc_id", sizes).select("doc_id", "quality", "toxic")


@query("""
with r as (select doc_id, quality, row_number() over (partition by quality order by sha256('7:' || cast(doc_id as varchar))) as k, count(*) over (partition by quality) as n from labels)
select doc_id, quality from r where k <= greatest(1, round_even(n * 0.25, 0))
""")
def second_annotator_share(spark, d):
    labels = table(spark, d, "labels").withColumn("_key", F.concat(F.lit("7:"), F.col("doc_id").cast("string")))
    sizes = labels.groupBy("quality").agg(F.greatest(F.lit(1), F.bround(F.count("*") * F.lit(0.25)).cast("long")).alias("k"))
    return windows.hash_sample(labels, ["quality"], "_key", sizes).select("doc_id", "quality")


@query("select conv_id, turn, row_number() over (partition by conv_id order by turn, text) as ordinal, 'turn:' || conv_id || ':' || row_number() over (partition by conv_id order by turn, text) as id from conversations")
def ordinal_ids(spark, d):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text"))
    return table(spark, d, "conversations").select("conv_id", "turn", n.alias("ordinal")).withColumn("id", F.concat(F.lit("turn:"), F.col("conv_id").cast("string"), F.lit(":"), F.col("ordinal").cast("string")))


@query("select user_id, date_trunc('minute', ts) as minute, count(*) as n from events group by 1, 2 having count(*) > 1")
def rate_limit_violations(spark, d):
    found = metering.violations(table(spark, d, "events"), "ts", "user_id", 1)
    return found.select(F.col("client").alias("user_id"), F.col("minute").cast("timestamp_ntz").alias("minute"), "n")


@query("select coalesce(cast(user_id as varchar), 'anonymous') as client, event_type as tool, count(*) filter (event_type <> 'error') as n_allowed, count(*) filter (event_type = 'error') as n_denied from events group by 1, 2")
def usage_metering(spark, d):
    return metering.usage(table(spark, d, "events"), "user_id", "event_type", F.col("event_type") != "error")


@query("select o_orderkey, c_name, o_totalprice from orders join customer on c_custkey = o_custkey where o_orderstatus = 'F' and c_acctbal > 0")
def accepted_filter_join(spark, d):
    accepted = table(spark, d, "orders").filter("o_orderstatus = 'F'")
    return accepted.join(table(spark, d, "customer").filter("c_acctbal > 0"), F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "c_name", "o_totalprice")


@query("select c_custkey, case when exists (select 1 from orders where o_custkey = c_custkey) then 'edge' else 'queue' end as lands from customer")
def semi_anti_targets(spark, d):
    found, lost = joins.resolved(table(spark, d, "customer").select("c_custkey"), "c_custkey", table(spark, d, "orders"), "o_custkey")
    return found.withColumn("lands", F.lit("edge")).unionByName(lost.withColumn("lands", F.lit("queue")))


@query("select o_orderkey, coalesce(case when o_orderkey % 4 = 0 then 'R' end, o_orderstatus) as o_orderstatus, o_totalprice from orders")
def left_coalesce_overlay(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    changes = orders.filter("o_orderkey % 4 = 0").select("o_orderkey", F.lit("R").alias("o_orderstatus"))
    return joins.overlaid(orders, changes, "o_orderkey", ["o_orderstatus"])


@query("""
with ids as (select p_partkey, 'r:' || p_brand || ':' || p_size || ':' || p_partkey as id from part),
nodes as (select distinct 'r:' || p_brand as k, 'brand ' || p_brand as title from part union all select distinct 'r:' || p_brand || ':' || p_size, 'size ' || p_size from part where p_size % 2 = 0)
select p_partkey, coalesce((select title from nodes where starts_with(id, k || ':') order by length(k) desc limit 1), '') as context from ids
""")
def prefix_ancestor_join(spark, d):
    part = table(spark, d, "part")
    brand = F.concat(F.lit("r:"), F.col("p_brand"))
    size = F.concat(brand, F.lit(":"), F.col("p_size").cast("string"))
    ids = part.select("p_partkey", F.concat(size, F.lit(":"), F.col("p_partkey").cast("string")).alias("id"))
    nodes = part.select(brand.alias("k"), F.concat(F.lit("brand "), F.col("p_brand")).alias("title")).union(part.filter("p_size % 2 = 0").select(size, F.concat(F.lit("size "), F.col("p_size").cast("string")))).distinct()
    return joins.closest_ancestor(ids, "id", nodes, "k", "title", "context").select("p_partkey", F.coalesce("context", F.lit("")).alias("context"))


@query("""
with terms as (select distinct p_type as term from part), texts as (select p_partkey, lower(p_name || ' ' || p_type) as t from part)
select term, p_partkey from terms join texts on contains(' ' || array_to_string(regexp_extract_all(t, '[a-z0-9]+'), ' ') || ' ', ' ' || array_to_string(regexp_extract_all(lower(term), '[a-z0-9]+'), ' ') || ' ')
""")
def regex_theta_join(spark, d):
    part = table(spark, d, "part")
    texts = part.select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("t"))
    return joins.mentioned(part.select(F.col("p_type").alias("term")).distinct(), "term", texts, "t").select("term", "p_partkey")


@query("""
with spans as (select user_id, min(floor(epoch(ts)))::bigint as a, min(floor(epoch(ts)))::bigint + 86400 as b from events group by 1)
select event_id, spans.user_id as span_user from events join spans on spans.a <= floor(epoch(ts))::bigint and floor(epoch(ts))::bigint < spans.b
""")
def interval_containment(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"))
    spans = events.groupBy(F.col("user_id").alias("span_user")).agg(F.min("at").alias("a")).withColumn("b", F.col("a") + 86400)
    return joins.contained(events.select("event_id", "at"), F.col("at"), spans, "a", "b", 86400).select("event_id", "span_user")


@query("""
with e as (select o_orderkey as id, o_orderdate as ts, 'order' as kind, o_orderstatus as verdict from orders union all select event_id, ts, 'event', event_type from events)
select kind, verdict, count(*) as n, max(ts) as last_ts from e group by grouping sets ((kind), (kind, verdict))
""")
def audit_merge(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderdate").alias("ts"), F.col("o_orderstatus").alias("verdict"), F.lit("x").alias("model"))
    events = table(spark, d, "events").select("ts", F.col("event_type").alias("verdict"), F.lit("x").alias("model"))
    merged = review.consolidated([("order", orders), ("event", events)])
    return merged.groupingSets([["log_kind"], ["log_kind", "verdict"]], "log_kind", "verdict").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts")).withColumnRenamed("log_kind", "kind")


@query("""
with pools as (select 0 as pool, 'norm' as kind, 'o' || o_orderkey as item_id, o_orderpriority as text from orders where o_orderstatus = 'P'
  union all select 1, 'alignment', 'e' || event_id, event_type || '  ' || props from events where event_type = 'error'
  union all select 2, 'crossref', 'd' || doc_id, text from documents where text like '%@%' or source = 'src3'),
t as (select pool, kind, item_id, trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g'), ' ') as x from pools)
select pool, kind, item_id, substring(x, 1, 280) as text, length(x) > 280 as truncated from t where not (item_id in (select 'o' || o_orderkey from orders where o_orderkey % 3 = 0))
""")
def review_queue(spark, d):
    orders = table(spark, d, "orders")
    key = lambda mark, c: F.concat(F.lit(mark), F.col(c).cast("string")).alias("item_id")
    norms = orders.filter("o_orderstatus = 'P'").select(key("o", "o_orderkey"), F.col("o_orderpriority").alias("text"))
    alignments = table(spark, d, "events").filter("event_type = 'error'").select(key("e", "event_id"), F.concat_ws("  ", "event_type", "props").alias("text"))
    references = table(spark, d, "documents").filter("text like '%@%' or source = 'src3'").select(key("d", "doc_id"), "text")
    decided = orders.filter("o_orderkey % 3 = 0").select(key("o", "o_orderkey"))
    return review.pending([("norm", norms), ("alignment", alignments), ("crossref", references)], decided)


@query("select kind, count(*) as n_total, count(*) filter (k % 3 = 0) as n_decided, count(*) filter (k % 3 <> 0) as n_pending from (select o_orderstatus as kind, o_orderkey as k from orders) group by kind")
def queue_statistics(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderstatus").alias("kind"), F.col("o_orderkey").alias("k"))
    return orders.groupBy("kind").agg(F.count("*").alias("n_total"), F.count(F.when(F.col("k") % 3 == 0, 1)).alias("n_decided"), F.count(F.when(F.col("k") % 3 != 0, 1)).alias("n_pending"))


@query("""
select o_orderkey, case when o_orderkey % 5 = 0 then 'rejected' else verdict end as judge_verdict, case when o_orderkey % 5 = 0 then 'human_reviewed' else 'auto' end as review_status,
  case when o_orderkey % 5 = 0 then 'HUMAN_REJECTED' when verdict = 'accepted' then 'LLM_ACCEPTED' when verdict = 'rejected' then 'LLM_REJECTED' else 'LLM_PROPOSED' end as provenance
from (select o_orderkey, case o_orderstatus when 'F' then 'accepted' when 'O' then 'rejected' else 'needs_human_review' end as verdict from orders)
""")
def apply_decisions(spark, d):
    status = F.col("o_orderstatus")
    verdict = F.when(status == "F", "accepted").when(status == "O", "rejected").otherwise("needs_human_review")
    rows = table(spark, d, "orders").select("o_orderkey", verdict.alias("judge_verdict"), F.lit("auto").alias("review_status"))
    decisions = rows.filter("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("item_id"), F.lit("rejected").alias("decision"))
    out = review.decided_over(rows, decisions, "o_orderkey")
    human = F.when(F.col("review_status") == "human_reviewed", F.col("judge_verdict"))
    return out.select("o_orderkey", "judge_verdict", "review_status", review.provenance(human, F.col("judge_verdict")).alias("provenance"))


@query("""
with a as (select c_custkey, c_name, c_acctbal from customer where c_custkey % 10 <> 1), b as (select c_custkey, 'new ' || c_name as c_name, 0.0::double as c_acctbal from customer where c_custkey % 10 <= 2)
select * from b union all select * from a where c_custkey not in (select c_custkey from b)
""")
def upsert_by_key(spark, d):
    customer = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = customer.filter("c_custkey % 10 <= 2").select("c_custkey", F.concat(F.lit("new "), F.col("c_name")).alias("c_name"), F.lit(0.0).alias("c_acctbal"))
    return review.upsert(customer.filter("c_custkey % 10 <> 1"), new, "c_custkey")


@query("select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')")
def resume_undone(spark, d):
    return metering.undone(table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("with r as (select l_orderkey, l_partkey, l_linenumber, row_number() over (partition by l_orderkey, l_partkey order by l_linenumber desc) as k from lineitem) select l_orderkey, l_partkey, l_linenumber from r where k = 1")
def last_record_wins(spark, d):
    return windows.first_per_group(table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber"), ["l_orderkey", "l_partkey"], [F.desc("l_linenumber")])


@query("select * from (select c_custkey as id from customer where c_nationkey < 5 intersect select o_custkey from orders) union all select * from (select -c_custkey from customer except all select -o_custkey from orders)")
def set_operations(spark, d):
    customer, orders = table(spark, d, "customer"), table(spark, d, "orders")
    both = customer.filter("c_nationkey < 5").select(F.col("c_custkey").alias("id")).intersect(orders.select("o_custkey"))
    return both.union(customer.select(-F.col("c_custkey")).exceptAll(orders.select(-F.col("o_custkey"))))


@query("""
with w as (select p_partkey, p_type, ' ' || array_to_string(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9]+'), ' ') || ' ' as t from part), terms as (select distinct p_type as term from part),
f as (select term, p_partkey from terms join w on contains(t, ' ' || array_to_string(regexp_extract_all(lower(term), '[a-z0-9]+'), ' ') || ' ')),
r as (select term, p_partkey, cast(row_number() over (partition by term order by p_partkey) as integer) as rank, count(*) over (partition by term) as total from f)
select * from r where rank <= 30
""")
def definition_usage(spark, d):
    part = table(spark, d, "part")
    texts = part.select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("t"))
    return joins.usage(part.select(F.col("p_type").alias("term")).distinct(), "term", texts, "t", "p_partkey")


@query("select p_partkey, 'r:' || p_size || ':' || p_partkey as id from part where p_size in (5, 7)")
def expanded_units(spark, d):
    nodes = table(spark, d, "part").select("p_partkey", F.concat_ws(":", F.lit("r"), F.col("p_size").cast("string"), F.col("p_partkey").cast("string")).alias("id"))
    return joins.expanded(spark.createDataFrame([("r:5",), ("r:7",), ("r:7",)], "id string"), nodes)


@query("""
with e as (select 'n' || n_nationkey as a, 'r' || n_regionkey as b from nation), x as (select a as id, b as other, true as outward from e union all select b, a, false from e)
select n.id, case when x.id is not null then 'IN' end as relation, other, outward from (select distinct a as id from e union select b from e union select 'lone') n left join x on x.id = n.id
""")
def neighbourhood(spark, d):
    from lexgrove.operators import graph

    edges = table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("src"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("dst"), F.lit("IN").alias("edge_type"))
    ids = edges.select(F.col("src").alias("id")).union(edges.select("dst")).union(spark.createDataFrame([("lone",)], "id string")).distinct()
    return graph.neighbourhood(ids, edges)
