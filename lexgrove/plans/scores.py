"""Queries that score, count and compare."""

from __future__ import annotations

from pyspark.sql import functions as F


from lexgrove.operators import dedup, metrics, retrieval
from lexgrove.plans.registry import query, table

_PAIRS = """
with t as (select doc_id, lang, source, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as s from documents),
p as (select a.doc_id as id_a, b.doc_id as id_b, len(list_intersect(a.s, b.s)) as i, len(a.s) + len(b.s) as n
  from t a join t b on a.lang is not distinct from b.lang and a.source is not distinct from b.source and a.doc_id < b.doc_id
  where len(a.s) > 0 and len(b.s) > 0),
near as (select id_a, id_b, cast(i as integer) as n_shared, cast(n - i as integer) as n_union, i / (n - i) as similarity,
  case when i * 5 >= (n - i) * 4 then 'near_duplicate' else 'review' end as band from p where i * 5 >= (n - i) * 3)
"""


def _near(spark, d):
    return dedup.near_duplicate_pairs(table(spark, d, "documents"), "doc_id", F.col("text"), ["lang", "source"])


@query(_PAIRS + "select * from near")
def near_dup_blocked(spark, d):
    return _near(spark, d)


@query(_PAIRS + "select band, count(*) as n_pairs, count(*) filter (n_shared = n_union) as n_equal from near group by band")
def near_dup_summary(spark, d):
    return dedup.summary(_near(spark, d))


@query("""
with p as (select doc_id as k, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from documents),
q as (select item_id as k, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from benchmark),
ptf as (select k, term, count(*) as tf from p group by k, term),
qtf as (select k, term, count(*) as tf from q group by k, term),
idf as (select term, ln((select count(*) from documents)::double / (1 + count(*))) + 1 as w from ptf group by term),
pw as (select k, term, tf * w as raw, sqrt(sum(tf * w * tf * w) over (partition by k)) as norm from ptf join idf using (term)),
qw as (select k, term, tf * w as raw, sqrt(sum(tf * w * tf * w) over (partition by k)) as norm from qtf join idf using (term)),
s as (select qw.k as query, pw.k as passage, round(sum((pw.raw / pw.norm) * (qw.raw / qw.norm)), 6) as s
  from pw join qw on pw.term = qw.term where pw.norm > 0 and qw.norm > 0 group by all),
r as (select query, passage, cast(row_number() over (partition by query order by s desc, passage) as integer) as rank from s where s > 0)
select query, rank, passage from r where rank <= 3
""")
def tfidf_topk(spark, d):
    return retrieval.top_k(table(spark, d, "documents"), "doc_id", F.col("text"), table(spark, d, "benchmark"), "item_id", F.col("text"), 3)


@query("select coalesce(event_type, 'none') as kind, count(*) as n, count(value) as n_valued, count(distinct user_id) as n_users from events group by 1")
def census_by_type(spark, d):
    return table(spark, d, "events").groupBy(F.coalesce("event_type", F.lit("none")).alias("kind")).agg(F.count("*").alias("n"), F.count("value").alias("n_valued"), F.countDistinct("user_id").alias("n_users"))


@query("select l_returnflag as flag, l_linestatus as status, count(*) as n, cast(sum(l_quantity) as bigint) as quantity from lineitem group by grouping sets ((l_returnflag, l_linestatus), (l_returnflag), (l_linestatus), ())")
def census_cube(spark, d):
    return table(spark, d, "lineitem").cube(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("quantity"))


@query("""
with per as (select r_name, count(distinct n_nationkey) as n_nations, count(c_custkey) as n_customers,
  count(distinct c_nationkey) as n_covered, array_to_string(list_sort(list(distinct n_name)), ',') as nations
  from region left join nation on n_regionkey = r_regionkey left join customer on c_nationkey = n_nationkey group by r_name)
select r_name, n_nations, n_customers, n_covered, n_nations = n_covered as complete, nations from per
""")
def coverage_report(spark, d):
    joined = table(spark, d, "region").join(table(spark, d, "nation"), F.col("n_regionkey") == F.col("r_regionkey"), "left").join(table(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    per = joined.groupBy("r_name").agg(F.countDistinct("n_nationkey").alias("n_nations"), F.count("c_custkey").alias("n_customers"), F.countDistinct("c_nationkey").alias("n_covered"), F.array_join(F.sort_array(F.collect_set("n_name")), ",").alias("nations"))
    return per.withColumn("complete", F.col("n_nations") == F.col("n_covered"))


@query("""
with actual as (select distinct o_orderpriority as p from orders), expected as (select unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW', '6-NEVER']) as p)
select coalesce(e.p, a.p) as item, e.p is not null as expected, a.p is not null as actual from expected e full join actual a on e.p = a.p
""")
def expected_vs_actual(spark, d):
    actual = table(spark, d, "orders").select(F.col("o_orderpriority").alias("item")).distinct().withColumn("actual", F.lit(True))
    wanted = spark.createDataFrame([(x,) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NEVER")], "item string").withColumn("expected", F.lit(True))
    return wanted.join(actual, "item", "full").na.fill(False)


@query("""
select lang, count(*) as n, count(*) filter (quality = 1) as n_accepted, count(*) filter (quality = 0) as n_rejected, count(*) filter (quality is null) as n_pending
from documents left join labels using (doc_id) group by lang
""")
def verdict_pivot(spark, d):
    joined = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    c = metrics.count_of
    return joined.groupBy("lang").agg(F.count("*").alias("n"), c(F.col("quality") == 1).alias("n_accepted"), c(F.col("quality") == 0).alias("n_rejected"), c(F.col("quality").isNull()).alias("n_pending"))


#: Gold classes of labelled documents, and a fixed predictor by length that sometimes gives no answer.
_ITEMS = """
with items as (select doc_id, case when quality = 0 then 'rejected' when toxic = 1 then 'review' else 'accepted' end as gold,
  case when n_chars % 11 = 0 then null when n_chars > 4000 then 'review' when n_chars % 5 = 0 then 'rejected' else 'accepted' end as predicted
  from labels join documents using (doc_id))
"""
_CLASSES = ["accepted", "rejected", "review"]


def _items(spark, d):
    joined = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    gold = F.when(F.col("quality") == 0, "rejected").when(F.col("toxic") == 1, "review").otherwise("accepted")
    n = F.col("n_chars")
    predicted = F.when(n % 11 == 0, F.lit(None).cast("string")).when(n > 4000, "review").when(n % 5 == 0, "rejected").otherwise("accepted")
    return joined.select("doc_id", gold.alias("gold"), predicted.alias("predicted"))


@query(_ITEMS + "select count(*) as n_items, count(*) filter (gold = predicted) as n_correct, (count(*) filter (gold = predicted))::double / count(*) as accuracy from items")
def risk_accuracy(spark, d):
    return metrics.accuracy(_items(spark, d), "gold", "predicted")


@query(_ITEMS + ", c as (select l as gold from (select unnest(['accepted', 'rejected', 'review']) as l)) select c.gold, count(*) filter (predicted = 'accepted') as n_accepted, count(*) filter (predicted = 'rejected') as n_rejected, count(*) filter (predicted = 'review') as n_review, count(*) filter (items.gold is not null and predicted is null) as n_no_prediction from c left join items on items.gold = c.gold group by c.gold")
def confusion_matrix(spark, d):
    return metrics.confusion(_items(spark, d), "gold", "predicted", _CLASSES)


@query(_ITEMS + """, c as (select unnest(['accepted', 'rejected', 'review']) as label),
k as (select label, count(*) filter (gold = label and predicted is not distinct from gold) as tp, count(*) filter (predicted = label and predicted is distinct from gold) as fp,
  count(*) filter (gold = label and predicted is distinct from gold) as fn from c cross join items group by label)
select label, tp, fp, fn, case when tp + fp = 0 then 0.0::double else tp::double / (tp + fp) end as precision, case when tp + fn = 0 then 0.0::double else tp::double / (tp + fn) end as recall,
  case when 2 * tp + fp + fn = 0 then 0.0::double else (2 * tp)::double / (2 * tp + fp + fn) end as f1 from k""")
def prf_by_class(spark, d):
    return metrics.scores_by_class(_items(spark, d), "gold", "predicted", _CLASSES)


@query(_ITEMS + "select count(*) as n_items, count(*) filter (predicted is null) as n_abstained, count(*) filter (predicted = gold) as n_correct, (count(*) filter (predicted = gold))::double / count(predicted) as selective_accuracy, (count(*) filter (predicted is null))::double / count(*) as abstention_rate from items")
def selective_accuracy(spark, d):
    return metrics.selective(_items(spark, d), "gold", "predicted", F.col("predicted").isNull())


@query("""
with n as (select count(*) as n, count(*) filter (quality = toxic) as agreed from labels where quality is not null and toxic is not null),
c as (select sum(a * b) as chance from (select quality as l, count(*) as a from labels where toxic is not null group by 1) x join (select toxic as l, count(*) as b from labels where quality is not null group by 1) y using (l))
select n as n_items, agreed as n_agreed, agreed::double / n as raw_agreement, case when n * n = chance then 1.0::double else (n * agreed - chance)::double / (n * n - chance)::double end as kappa from n, c
""")
def cohen_kappa(spark, d):
    return metrics.agreement(table(spark, d, "labels"), "quality", "toxic")


@query("""
with p as (select l_orderkey, list(distinct cast(l_partkey as varchar)) as predicted from lineitem where l_partkey % 3 > 0 group by 1),
g as (select l_orderkey, list(cast(l_partkey as varchar)) as gold from lineitem where l_linenumber <= 3 group by 1),
i as (select o_orderkey, len(list_filter(gold, lambda x: list_contains(coalesce(predicted, []), x))) as found, len(gold) as wanted
  from orders left join g on g.l_orderkey = o_orderkey left join p on p.l_orderkey = o_orderkey where len(gold) > 0)
select count(*) as n_items, cast(sum(found) as bigint) as n_found, cast(sum(wanted) as bigint) as n_wanted, sum(found)::double / sum(wanted)::double as micro,
  sum(floor(found::double / wanted::double * 1000000)::bigint)::double / (count(*) * 1000000)::double as macro from i
""")
def citation_completeness(spark, d):
    line = table(spark, d, "lineitem")
    part = F.col("l_partkey").cast("string")
    predicted = line.filter("l_partkey % 3 > 0").groupBy("l_orderkey").agg(F.collect_set(part).alias("predicted"))
    gold = line.filter("l_linenumber <= 3").groupBy("l_orderkey").agg(F.collect_list(part).alias("gold"))
    items = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")).join(gold, "l_orderkey", "left").join(predicted, "l_orderkey", "left")
    return metrics.completeness(items, "gold", "predicted")


@query("""
with c as (select distinct l_orderkey, case when l_suppkey % 17 = 0 then -l_partkey else l_partkey end as cited from lineitem where l_partkey is not null)
select count(*) as n_cited, count(*) filter (p_partkey is null) as n_unknown, (count(*) filter (p_partkey is null))::double / count(*) as rate from c left join part on p_partkey = cited
""")
def hallucination_rate(spark, d):
    cited = F.when(F.col("l_suppkey") % 17 == 0, -F.col("l_partkey")).otherwise(F.col("l_partkey"))
    return metrics.hallucination(table(spark, d, "lineitem").select("l_orderkey", cited.alias("cited")), "l_orderkey", "cited", table(spark, d, "part"), "p_partkey")


@query("""
with j as (select case doc_id % 7 when 0 then 'needs_human_review' when 1 then 'rejected' else 'accepted' end as v, case when quality = 1 then 'accept' else 'reject' end as g from labels)
select count(*) filter (v in ('accepted', 'rejected')) as n_scored, count(*) filter (v not in ('accepted', 'rejected')) as n_abstained,
  count(*) filter (v = 'accepted' and g = 'reject') as n_false_accept, count(*) filter (v = 'rejected' and g = 'accept') as n_false_reject,
  coalesce((count(*) filter (v = 'accepted' and g = 'reject'))::double / nullif(count(*) filter (v in ('accepted', 'rejected') and g = 'reject'), 0), 0) as false_accept_rate,
  coalesce((count(*) filter (v = 'rejected' and g = 'accept'))::double / nullif(count(*) filter (v in ('accepted', 'rejected') and g = 'accept'), 0), 0) as false_reject_rate from j
""")
def judge_error_rates(spark, d):
    verdict = F.when(F.col("doc_id") % 7 == 0, "needs_human_review").when(F.col("doc_id") % 7 == 1, "rejected").otherwise("accepted")
    gold = F.when(F.col("quality") == 1, "accept").otherwise("reject")
    return metrics.judge_errors(table(spark, d, "labels").select(verdict.alias("v"), gold.alias("g")), "v", "g")


@query("""
with r as (select user_id, event_id % 2 as run, mode_first as label, cited from (
  select user_id, event_id % 2 as event_id, arg_max(event_type, event_id) as mode_first, list_sort(list(distinct event_type)) as cited from events group by 1, 2) x),
p as (select a.label as la, b.label as lb, a.cited as ca, b.cited as cb from r a join r b on a.user_id = b.user_id and a.run = 0 and b.run = 1)
select count(*) as n_items, count(*) filter (la is distinct from lb) as n_flips, count(*) filter (len(ca) > 0 or len(cb) > 0) as n_citing,
  sum(floor(len(list_intersect(ca, cb))::double / len(list_distinct(list_concat(ca, cb)))::double * 1000000)::bigint)::double / (count(*) * 1000000)::double as mean_jaccard from p
""")
def run_variance(spark, d):
    runs = table(spark, d, "events").groupBy("user_id", (F.col("event_id") % 2).alias("run")).agg(F.max_by("event_type", "event_id").alias("label"), F.collect_set("event_type").alias("cited"))
    a = runs.filter("run = 0").select("user_id", F.col("label").alias("label_a"), F.col("cited").alias("cited_a"))
    b = runs.filter("run = 1").select("user_id", F.col("label").alias("label_b"), F.col("cited").alias("cited_b"))
    return metrics.variance(a.join(b, "user_id"))


@query("""
with m as (select user_id % 5 as role, nullif(value, 0) as v, length(props) as chars from events)
select role, count(*) as n_units, count(*) filter (v is null) as n_without_usage, cast(sum(chars) as bigint) as n_chars, cast(sum(chars) // 4 as bigint) as tokens,
  cast(floor(sum(chars) / 4 * 0.75) as bigint) as tokens_low, cast(floor(sum(chars) / 4 * 1.25) as bigint) as tokens_high from m group by role
""")
def token_usage(spark, d):
    units = table(spark, d, "events").select((F.col("user_id") % 5).alias("role"), F.nullif("value", F.lit(0.0)).alias("v"), F.length("props").alias("chars"))
    chars = F.sum("chars")
    return units.groupBy("role").agg(F.count("*").alias("n_units"), metrics.count_of(F.col("v").isNull()).alias("n_without_usage"), chars.alias("n_chars"), F.floor(chars / 4).alias("tokens"), F.floor(chars / 4 * 0.75).alias("tokens_low"), F.floor(chars / 4 * 1.25).alias("tokens_high"))


@query("""
with s as (select doc_id, greatest(0, least(1, n_chars % 10 / 9.0)) as a, greatest(0, least(1, n_chars % 7 / 6.0)) as b, quality as c, toxic as e, 1 as f from labels join documents using (doc_id))
select doc_id, cast(round((a + b + c + e + f) / 5.0, 9) as double) as final_score from s
""")
def alignment_score(spark, d):
    clamp = lambda c: F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c.cast("double"))), F.lit(0.0))
    joined = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    n = F.col("n_chars")
    total = clamp(n % 10 / 9.0) + clamp(n % 7 / 6.0) + clamp(F.col("quality")) + clamp(F.col("toxic")) + clamp(F.lit(1))
    return joined.select("doc_id", F.round(total / 5.0, 9).alias("final_score"))


@query("""
with t as (select source, lang, count(*) as n from documents group by 1, 2), r as (select *, row_number() over (partition by source order by n desc, lang) as k from t)
select source, lang as dominant, n from r where k = 1
""")
def dominant_target(spark, d):
    counts = table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return counts.groupBy("source").agg(F.min_by(F.struct("lang", "n"), F.struct(-F.col("n"), F.col("lang"))).alias("x")).select("source", F.col("x.lang").alias("dominant"), F.col("x.n").alias("n"))


@query("select 'calls' as part, cast(sum(n) as bigint) as total from (select count(*) as n from events group by event_type) union all select 'quantity', cast(sum(q) as bigint) from (select sum(l_quantity) as q from lineitem group by l_shipdate)")
def merged_stats(spark, d):
    calls = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("v")).select(F.lit("calls").alias("part"), F.col("v").cast("long").alias("v"))
    quantity = table(spark, d, "lineitem").groupBy("l_shipdate").agg(F.sum("l_quantity").cast("long").alias("v")).select(F.lit("quantity").alias("part"), "v")
    return calls.unionByName(quantity).groupBy("part").agg(F.sum("v").alias("total"))
