"""Queries on text, markup, graphs and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexgrove.functions import text as X
from lexgrove.operators import gates, graph, joins, references, review
from lexgrove.operators.store import small
from lexgrove.plans import ladder, requirements
from lexgrove.plans.registry import query, table


@query("select page_id, cast(pos - 1 as integer) as pos, list_extract(links, pos) as href from (select page_id, links, unnest(range(1, len(links) + 1)) as pos from (select page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) as links from pages))")
def html_links(spark, d):
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return table(spark, d, "pages").select("page_id", F.posexplode(links).alias("pos", "href"))


_VISIBLE = "trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace({0}, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \\t\\r\\n]+', ' ', 'g'), ' ')"


@query(f"select page_id, sha256({_VISIBLE.format('html')}) as digest, length({_VISIBLE.format('html')}) as n_chars from pages")
def html_text(spark, d):
    whole = X.visible(F.col("html"))
    return table(spark, d, "pages").select("page_id", X.digest(whole).alias("digest"), F.length(whole).cast("long").alias("n_chars"))


@query(f"select page_id, {_VISIBLE.format('h')} as heading from (select page_id, regexp_extract(html, '<h1>([^\\x00]*?)</h1>', 1) as h from pages)".replace("[^\\x00]", "[^<]"))
def html_headings(spark, d):
    return table(spark, d, "pages").select("page_id", X.visible(F.regexp_extract("html", "<h1>([^<]*?)</h1>", 1)).alias("heading"))


@query("""
with b as (select item_id, trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g'), ' ') as q from benchmark), t as (select doc_id, trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g'), ' ') as x from documents)
select item_id, doc_id from b join t on contains(x, q) where length(q) > 0
""")
def quote_check(spark, d):
    quotes = table(spark, d, "benchmark").select("item_id", X.collapsed(F.col("text")).alias("q")).filter(F.length("q") > 0)
    whole = table(spark, d, "documents").select("doc_id", X.collapsed(F.col("text")).alias("x"))
    # a quote of three words or more can only stand where its longest inner word does; shorter ones are held against all texts
    words = F.split("q", " ")
    inner = F.transform(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), lambda w: F.struct((-F.length(w)).alias("l"), w.alias("w")))
    keyed = quotes.withColumn("_k", F.get(F.sort_array(inner), F.lit(0))["w"])
    long, short = keyed.filter("_k is not null").select("item_id", "_k"), keyed.filter("_k is null").select("item_id", "q")
    asked = long.select("_k").distinct()
    held = whole.select("doc_id", F.explode(F.array_distinct(F.split("x", " "))).alias("_k")).join(F.broadcast(asked) if small(asked) else asked, "_k", "left_semi")
    pairs = held.join(long, "_k").select("doc_id", "item_id").distinct()
    found = pairs.join(quotes, "item_id").join(whole, "doc_id").filter(X.quoted_in(F.col("q"), F.col("x"))).select("item_id", "doc_id")
    if short.isEmpty():
        return found
    return found.union(whole.join(F.broadcast(short) if small(short) else short, F.contains("x", "q")).select("item_id", "doc_id"))


@query("""
select doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, 'sk-[A-Za-z0-9_-]{8,}', '[redacted]', 'g'), 'key_[A-Za-z0-9_-]{8,}', '[redacted]', 'g'), 'Bearer [A-Za-z0-9._-]{8,}', '[redacted]', 'g')) as digest,
  contains(regexp_replace(regexp_replace(regexp_replace(text, 'sk-[A-Za-z0-9_-]{8,}', '[redacted]', 'g'), 'key_[A-Za-z0-9_-]{8,}', '[redacted]', 'g'), 'Bearer [A-Za-z0-9._-]{8,}', '[redacted]', 'g'), '[redacted]') as scrubbed from documents
""")
def secret_scrub(spark, d):
    clean = X.scrubbed(F.col("text"), (X.SECRETS[0], X.key_shape("key_"), X.SECRETS[1]))
    return table(spark, d, "documents").select("doc_id", X.digest(clean).alias("digest"), F.contains(clean, F.lit("[redacted]")).alias("scrubbed"))


@query("""
select p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', '-', 'g'), '-') as slug, 'cond:' || substring(sha256(trim(regexp_replace(lower(p_name), '[ \\t\\r\\n]+', ' ', 'g'), ' ')), 1, 12) as clause_id,
  substring(sha256(p_type), 1, 16) as digest from part
""")
def slug_and_digest(spark, d):
    return table(spark, d, "part").select("p_partkey", X.slug(F.concat_ws(" ", "p_name", "p_type")).alias("slug"), X.clause_id("cond", F.col("p_name")).alias("clause_id"), X.digest(F.col("p_type"), 16).alias("digest"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", X.json_object(F.col("props"), "k bigint")["k"].alias("k"))


@query("select o_orderkey, substring(o_comment, 1, 12) as excerpt, length(o_comment) > 12 as truncated, coalesce(nullif(regexp_extract(id, '^[^:]*:(.*)$', 1), ''), id) as suffix, split_part(id, ':', 2) as segment from (select o_orderkey, o_orderpriority || ' ' || o_orderstatus as o_comment, 'norm:' || o_orderpriority || ':' || o_orderkey as id from orders)")
def excerpts_and_ids(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("t"), F.concat_ws(":", F.lit("norm"), "o_orderpriority", F.col("o_orderkey").cast("string")).alias("id"))
    cut = X.excerpt(F.col("t"), 12)
    return orders.select("o_orderkey", cut["excerpt"].alias("excerpt"), cut["truncated"].alias("truncated"), X.suffix(F.col("id")).alias("suffix"), X.segment(F.col("id"), 1).alias("segment"))


#: Roman numerals in SQL by concatenating the forms of the digits.
_ROMAN = "['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'][cast(n // 100 as integer) % 10 + 1] || ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][cast(n // 10 as integer) % 10 + 1] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][cast(n as integer) % 10 + 1]"


@query(f"select n, {_ROMAN} as roman, n as back from (select distinct p_size as n from part)")
def roman_numerals(spark, d):
    sizes = table(spark, d, "part").select(F.col("p_size").alias("n")).distinct().withColumn("roman", X.roman(F.col("n")))
    return sizes.withColumn("back", X.from_roman(F.col("roman")))


#: Sentences about articles, made from orders, as the documents hold none.
_CLAUSES = "select o_orderkey, 'As Article ' || (o_orderkey % 120) || '(' || (o_orderkey % 4 + 1) || ') and Annex ' || ['I', 'II', 'III', 'IV', 'XIV'][cast(o_orderkey % 5 as integer) + 1] || case when o_orderkey % 3 = 0 then ' of Regulation (EU) 2016/679' else '' end || ' say; Articles ' || (o_orderkey % 9 + 1) || ' to ' || (o_orderkey % 9 + 3) || ' apply.' as t from orders"


def _clauses(spark, d):
    k = F.col("o_orderkey")
    t = F.concat(
        F.lit("As Article "), (k % 120).cast("string"), F.lit("("), (k % 4 + 1).cast("string"), F.lit(") and Annex "), F.element_at(F.array(*[F.lit(x) for x in ("I", "II", "III", "IV", "XIV")]), (k % 5 + 1).cast("int")),
        F.when(k % 3 == 0, " of Regulation (EU) 2016/679").otherwise(""), F.lit(" say; Articles "), (k % 9 + 1).cast("string"), F.lit(" to "), (k % 9 + 3).cast("string"), F.lit(" apply."),
    )
    return table(spark, d, "orders").select("o_orderkey", t.alias("t"))


@query(f"""
with c as ({_CLAUSES}), a as (select o_orderkey, o_orderkey % 120 as n, o_orderkey % 4 + 1 as p, o_orderkey % 9 + 1 as lo, o_orderkey % 5 as x from c),
found as (
  select o_orderkey, case when n between 1 and 113 and p <= 2 then 'eu-ai-act:article-' || n || ':paragraph-' || p when n between 1 and 113 then 'eu-ai-act:article-' || n end as target from a
  union all select o_orderkey, case when x < 4 and o_orderkey % 3 <> 0 then 'eu-ai-act:annex-' || ['i', 'ii', 'iii', 'iv', 'xiv'][cast(x as integer) + 1] end from a
  union all select o_orderkey, 'eu-ai-act:article-' || unnest(range(lo, lo + 3)) from a)
select distinct o_orderkey as from_id, target from found where target is not null
""")
def cross_references(spark, d):
    numbers = spark.range(1, 114).select(F.concat(F.lit("eu-ai-act:article-"), F.col("id").cast("string")).alias("id"))
    paragraphs = numbers.select(F.explode(F.array(F.concat("id", F.lit(":paragraph-1")), F.concat("id", F.lit(":paragraph-2")))).alias("id"))
    annexes = spark.range(1, 14).select(F.concat(F.lit("eu-ai-act:annex-"), F.lower(X.roman(F.col("id")))).alias("id"))
    edges, _ = references.resolve(_clauses(spark, d), "o_orderkey", "t", numbers.union(paragraphs).union(annexes), "eu-ai-act")
    return edges.select("from_id", "target")


@query(f"""
with c as ({_CLAUSES}), a as (select o_orderkey, o_orderkey % 120 as n, o_orderkey % 4 + 1 as p, o_orderkey % 5 as x from c)
select o_orderkey as from_id, 'external_instrument' as reason, 'Annex ' || ['I', 'II', 'III', 'IV', 'XIV'][cast(x as integer) + 1] || ' of Regulation (EU) 2016/679' as mention from a where o_orderkey % 3 = 0
union all select o_orderkey, 'unresolved_target', 'Article ' || n || '(' || p || ')' from a where not n between 1 and 113
union all select o_orderkey, 'unresolved_target', 'Annex XIV' from a where x = 4 and o_orderkey % 3 <> 0
""")
def cross_reference_queue(spark, d):
    numbers = spark.range(1, 114).select(F.concat(F.lit("eu-ai-act:article-"), F.col("id").cast("string")).alias("id"))
    annexes = spark.range(1, 14).select(F.concat(F.lit("eu-ai-act:annex-"), F.lower(X.roman(F.col("id")))).alias("id"))
    _, queue = references.resolve(_clauses(spark, d), "o_orderkey", "t", numbers.union(annexes), "eu-ai-act")
    return queue.select("from_id", "reason", "mention")


def _tree(spark, d):
    region, nation, customer, orders = (table(spark, d, x) for x in ("region", "nation", "customer", "orders"))
    s = lambda mark, c: F.concat(F.lit(mark), F.col(c).cast("string"))
    parts = [
        region.filter("r_regionkey <> 3").select(F.lit("root").alias("src"), s("r", "r_regionkey").alias("dst")),
        nation.select(s("r", "n_regionkey"), s("n", "n_nationkey")), customer.select(s("n", "c_nationkey"), s("c", "c_custkey")), orders.select(s("c", "o_custkey"), s("o", "o_orderkey")),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out


_EDGES = "select 'root' as src, 'r' || r_regionkey as dst from region where r_regionkey <> 3 union all select 'r' || n_regionkey, 'n' || n_nationkey from nation union all select 'n' || c_nationkey, 'c' || c_custkey from customer union all select 'c' || o_custkey, 'o' || o_orderkey from orders"


@query(f"with recursive e as ({_EDGES}), reach(id, depth) as (select 'root', 0 union all select dst, depth + 1 from reach join e on src = id) select depth, count(distinct id) as n from reach group by depth")
def reachability(spark, d):
    roots = spark.createDataFrame([("root",)], "id string")
    return graph.reachable(_tree(spark, d), roots).groupBy("depth").agg(F.count("*").alias("n"))


@query(f"with recursive e as ({_EDGES}), reach(id) as (select 'root' union all select dst from reach join e on src = id) select distinct dst as id from e where dst not in (select id from reach)")
def orphan_nodes(spark, d):
    edges = _tree(spark, d)
    return gates.orphans(edges.select(F.col("dst").alias("id")).distinct(), edges, spark.createDataFrame([("root",)], "id string"))


@query("""
select r_name as name, count(distinct n_nationkey) as n_children, array_to_string(list_sort(list(distinct n_name)), ', ') as children, count(c_custkey) as n_leaves
from region left join nation on n_regionkey = r_regionkey left join customer on c_nationkey = n_nationkey group by r_name
""")
def containment_tree(spark, d):
    leaves = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("leaves"))
    nation = table(spark, d, "nation").join(leaves, "n_nationkey", "left")
    per = nation.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("n_name")), ", ").alias("c"), F.sum("leaves").alias("l"))
    joined = table(spark, d, "region").join(per, "r_regionkey", "left")
    return joined.select(F.col("r_name").alias("name"), F.coalesce("n", F.lit(0)).alias("n_children"), F.coalesce("c", F.lit("")).alias("children"), F.coalesce("l", F.lit(0)).alias("n_leaves"))


@query("""
with e as (select 'n' || n_nationkey as src, 'r' || n_regionkey as dst from nation), x as (select src, dst, 'x:' || src || ':' || dst as node from e)
select src as from_id, 'HAS_CROSS_REFERENCE' as relation, node as to_id from x union all select node, 'RESOLVES_TO', dst from x
""")
def reify_edges(spark, d):
    edges = table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("src"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("dst"))
    return graph.reified(edges, F.concat_ws(":", F.lit("x"), "src", "dst"), ("HAS_CROSS_REFERENCE", "RESOLVES_TO"))


@query("""
select '<urn:n:' || n_nationkey || '> <urn:name> "' || replace(replace(n_name, '\\', '\\\\'), '"', '\\"') || '" .' as line from nation
union all select '<urn:n:' || n_nationkey || '> <urn:in> <urn:r:' || n_regionkey || '> .' from nation
""")
def triples(spark, d):
    nation = table(spark, d, "nation").withColumn("s", F.concat(F.lit("urn:n:"), F.col("n_nationkey").cast("string")))
    names = graph.triples(nation, F.col("s"), F.lit("urn:name"), F.col("n_name"), F.lit(False))
    return names.union(graph.triples(nation, F.col("s"), F.lit("urn:in"), F.concat(F.lit("urn:r:"), F.col("n_regionkey").cast("string")), F.lit(True)))


@query("""
with s as (select 'urn:n:' || n_nationkey as s, 'urn:in' as p, 'urn:r:' || n_regionkey as o from nation), k as (select *, 'urn:stmt:' || substring(sha256(s || '|' || p || '|' || o), 1, 20) as k from s),
r as (select k, unnest(['type', 'subject', 'predicate', 'object']) as p, unnest(['http://www.w3.org/1999/02/22-rdf-syntax-ns#Statement', s, p, o]) as o from k)
select '<' || k || '> <http://www.w3.org/1999/02/22-rdf-syntax-ns#' || p || '> <' || o || '> .' as line from r
""")
def statements(spark, d):
    rows = table(spark, d, "nation").select(F.concat(F.lit("urn:n:"), F.col("n_nationkey").cast("string")).alias("s"), F.concat(F.lit("urn:r:"), F.col("n_regionkey").cast("string")).alias("o"))
    return graph.statements(rows, F.col("s"), F.lit("urn:in"), F.col("o"))


#: Facts of a system per user of the events: three-valued, as some users lack some kinds of event.
_FACT_NAMES = (*ladder._BANS, *ladder._RISKS, "causes_significant_harm", "annex_i_covered_product", "third_party_conformity_assessment_required", "interacts_with_natural_persons", "preparatory_or_narrow_procedural_task")


def _systems(spark, d):
    users = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    u, n = F.col("user_id"), F.col("n")
    entries = []
    for i, name in enumerate(_FACT_NAMES):
        known = (u + i) % 41 != 0
        entries.append(F.when(known, F.struct(F.lit(name).alias("key"), ((u * (i + 3) + n) % 29 == 0).alias("value"))))
    flags = F.map_from_entries(F.array_compact(F.array(*entries)))
    return users.select("user_id", flags.alias("flags"), F.when(u % 7 == 0, "banking").when(u % 7 == 1, "Employment ").otherwise("consumer").alias("domain"), F.when(u % 2 == 0, "advisory").otherwise("automated").alias("autonomy"), F.create_map(F.lit("body_governed_by_public_law"), u % 3 == 0).alias("deployer"))


def _facts_sql() -> str:
    cols = ", ".join(f"case when (user_id + {i}) % 41 <> 0 then (user_id * {i + 3} + n) % 29 = 0 end as {name}" for i, name in enumerate(_FACT_NAMES))
    return f"u as (select user_id, count(*) as n from events group by 1), f as (select user_id, case when user_id % 7 = 0 then 'banking' when user_id % 7 = 1 then 'employment' else 'consumer' end as domain, user_id % 2 = 0 as advisory, user_id % 3 = 0 as public_body, {cols} from u)"


def _or(xs) -> str:
    return "(" + " or ".join(xs) + ")"


def _ladder_sql() -> str:
    yes, no, unknown = (lambda x: f"coalesce({x}, false)" if x in _FACT_NAMES else "false"), (lambda x: f"coalesce(not {x}, false)" if x in _FACT_NAMES else "false"), (lambda x: f"({x} is null)" if x in _FACT_NAMES else "true")
    hits, pending = [], []
    for flag, (_, lift, value) in ladder.PROHIBITED.items():
        if lift is None:
            hits.append(yes(flag))
        else:
            hits.append(f"({yes(flag)} and {no(lift) if value else yes(lift)})")
            pending.append(f"({yes(flag)} and {unknown(lift)})")
    both = f"({yes(ladder.REMOTE)} and {yes(ladder.POLICE)})"
    hits.append(f"({both} and {no(ladder.REMOTE_LIFT)})")
    pending += [f"({both} and {unknown(ladder.REMOTE_LIFT)})", f"({yes(ladder.REMOTE)} and {unknown(ladder.POLICE)})"]
    points = {}
    for p, (main, more, domains) in ladder.HIGH_RISK.items():
        by_domain = f"(domain in ({', '.join(repr(x) for x in domains)}) and not ({' and '.join(no(x) for x in main)}))" if domains else "false"
        points[p] = _or([*(yes(x) for x in (*main, *more)), by_domain])
    open_ban = _or([*(unknown(x) for x in ladder._BANS), *pending])
    open_risk = _or([unknown(x) for x in ladder._RISKS])
    first = "case " + " ".join(f"when {c} then 'eu-ai-act:annex-iii:point-{p}'" for p, c in points.items()) + " end"
    return f"""with {_facts_sql()},
    k as (select user_id, public_body, {_or(hits)} as banned, {yes('annex_i_covered_product')} and {yes('third_party_conformity_assessment_required')} as embedded, {_or(points.values())} as annex, {first} as point,
      {_or(c for p, c in points.items() if p != 2)} as others, {yes('annex_i_covered_product')} and {unknown('third_party_conformity_assessment_required')} as open_product, {_or(yes(x) for x in ladder.TRANSPARENCY)} as shown,
      {open_ban} as open_ban, {open_risk} as open_risk, advisory and {yes('preparatory_or_narrow_procedural_task')} as candidate, {_or(yes(x) for x in ladder.SYSTEM_TRIGGERS)} as trigger, {_or(unknown(x) for x in ladder.SYSTEM_TRIGGERS)} as open_trigger from f),
    c as (select *, case when banned then 'prohibited' when embedded or annex then 'high_risk' when open_product then 'uncertain' when shown then 'transparency_only' when open_ban or open_risk then 'uncertain' else 'minimal_or_none' end as risk_category,
      case when banned then false when embedded then open_ban when annex then candidate or open_ban when open_product then true else open_ban or open_risk end as review from k)"""


@query(_ladder_sql() + """
select user_id, risk_category, case when review then 'requires_human_review' when risk_category = 'minimal_or_none' then 'not_applicable' else 'potentially_applicable' end as status, case when review then 0.5::double else 1.0::double end as confidence,
  case when not banned and not embedded and annex then point end as annex_iii_category, not banned and not embedded and annex and candidate as article_6_3_exception_candidate,
  case when risk_category = 'uncertain' then 'unknown' when risk_category <> 'high_risk' then 'does_not_apply' when not annex then case when open_trigger then 'unknown' else 'does_not_apply' end
    when candidate or review then 'unknown' when trigger then 'applies' when not others then case when open_trigger then 'unknown' else 'does_not_apply' end when public_body then 'applies' else 'unknown' end as fria from c
""")
def ladder_classify(spark, d):
    return ladder.classify(_systems(spark, d)).select("user_id", "risk_category", "status", "confidence", "annex_iii_category", "article_6_3_exception_candidate", "fria")


_NORMS_SQL = "select 'norm:' || p_partkey as norm_id, case when p_size <= 4 then 'article-' || (p_size + 4) when p_size > 48 then 'annex-iii' when p_size = 30 then 'article-50' else 'article-' || p_size end as norm_group, p_brand <> 'Brand#1' as accepted from part"


def _norms(spark, d):
    size = F.col("p_size")
    group = F.when(size <= 4, F.concat(F.lit("article-"), (size + 4).cast("string"))).when(size > 48, "annex-iii").when(size == 30, "article-50").otherwise(F.concat(F.lit("article-"), size.cast("string")))
    verdict = F.when(F.col("p_brand") != "Brand#1", "accepted").otherwise("rejected")
    return table(spark, d, "part").select(F.concat(F.lit("norm:"), F.col("p_partkey").cast("string")).alias("norm_id"), F.concat(F.lit("eu-ai-act:"), group, F.lit(":paragraph-1")).alias("source_node_id"), verdict.alias("judge_verdict"))


@query(_ladder_sql() + f""", n as ({_NORMS_SQL}), a as (select * from n where accepted),
s as (select norm_group, count(*) as n from a group by 1)
select risk_category, norm_group, n as n_norms, count(*) as n_systems, count(*) filter (review) as n_provisional from c join s on (risk_category = 'high_risk' and norm_group not in ('article-5', 'article-6', 'article-7') and not starts_with(norm_group, 'annex-')) or (risk_category = 'transparency_only' and norm_group = 'article-50') group by 1, 2, 3
""")
def requirements_by_group(spark, d):
    systems = ladder.classify(_systems(spark, d))
    kinds = systems.groupBy("risk_category", "status").agg(F.count("*").alias("n"))  # systems of one kind need one lookup
    found = requirements.applicable(kinds.withColumn("kind", F.struct("risk_category", "status", "n")), _norms(spark, d), "kind")
    by = found.groupBy("risk_category", "norm_group", "kind").agg(F.count("*").alias("n_norms"))
    return by.groupBy("risk_category", "norm_group", "n_norms").agg(F.sum("kind.n").alias("n_systems"), F.sum(F.when(F.col("kind.status") == "requires_human_review", F.col("kind.n")).otherwise(0)).alias("n_provisional"))


_SEVERITY = ["error", "view", "click", "signup", "purchase"]


@query("select user_id, arg_min(event_type, list_position(['error', 'view', 'click', 'signup', 'purchase'], event_type)) as worst_status, min(value) as least, bool_and(event_type <> 'error') as all_accepted from events group by user_id")
def worst_status(spark, d):
    others = [F.min("value").alias("least"), F.bool_and(F.col("event_type") != "error").alias("all_accepted")]
    return requirements.worst_status(table(spark, d, "events"), ["user_id"], "event_type", tuple(_SEVERITY), others)


@query("""
with o as (select l_orderkey, list_distinct(list(cast(l_suppkey % 7 as varchar))) as norms, max(l_linenumber) as ln from lineitem group by 1),
k as (select l_orderkey, array_to_string(list_sort(norms), ',') as norm_set, case when ln >= 7 then 'must' else 'should' end as priority from o)
select norm_set, arg_min('item ' || l_orderkey, l_orderkey) as title, count(*) as n_merged, case when bool_or(priority = 'must') then 'must' else 'should' end as priority from k group by 1
""")
def backlog_merge(spark, d):
    items = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set((F.col("l_suppkey") % 7).cast("string")).alias("norms"), F.max("l_linenumber").alias("ln"))
    items = items.select("l_orderkey", "norms", F.concat(F.lit("item "), F.col("l_orderkey").cast("string")).alias("title"), F.when(F.col("ln") >= 7, "must").otherwise("should").alias("priority"))
    return requirements.merged_backlog(items, "l_orderkey", "title", "norms", "priority")


@query("""
with p as (select 'orders' as role, sha256(cast(count(*) as varchar) || ':' || cast(max(o_orderkey) as varchar)) as sha from orders union all select 'nation', sha256(array_to_string(list_sort(list(n_name)), '|')) from nation union all select 'region', sha256(array_to_string(list_sort(list(r_name)), '|')) from region)
select substring(sha256('{' || string_agg('"' || role || '":"' || sha || '"', ',' order by role) || '}'), 1, 12) as chain_id from p
""")
def chain_id(spark, d):
    named = lambda role, df, c: df.agg(F.array_join(F.sort_array(F.collect_list(c)), "|").alias("t")).select(F.lit(role).alias("role"), X.digest(F.col("t")).alias("sha"))
    orders = table(spark, d, "orders").agg(F.concat_ws(":", F.count("*").cast("string"), F.max("o_orderkey").cast("string")).alias("t")).select(F.lit("orders").alias("role"), X.digest(F.col("t")).alias("sha"))
    return review.chain_id(orders.union(named("nation", table(spark, d, "nation"), "n_name")).union(named("region", table(spark, d, "region"), "r_name")), "role", "sha")


@query("""
with a as (select c_custkey, case c_custkey % 6 when 0 then 'the Providers of high-risk AI systems' when 1 then 'European Commission' when 2 then 'that system' when 3 then 'Office' when 4 then ' ' else 'market surveillance authorities' end as raw from customer)
select c_custkey, case c_custkey % 6 when 0 then 'provider' when 1 then 'commission' when 5 then 'market_surveillance_authority' end as actor, case c_custkey % 6 when 2 then 'unresolved' when 3 then 'ambiguous' when 4 then 'empty' else 'rule' end as method from a
""")
def canonical_actors(spark, d):
    k = F.col("c_custkey") % 6
    raw = F.when(k == 0, "the Providers of high-risk AI systems").when(k == 1, "European Commission").when(k == 2, "that system").when(k == 3, "Office").when(k == 4, " ").otherwise("market surveillance authorities")
    return table(spark, d, "customer").select("c_custkey", requirements.canonical_actor(raw).alias("x")).select("c_custkey", "x.actor", "x.method")


@query("""
with e as (select o_orderkey, list_filter([case when o_totalprice > 0 then null else 'price' end, case when o_orderstatus in ('F', 'O') then null else 'status' end, case when o_custkey % 10 <> 0 then null else 'customer' end], lambda x: x is not null) as errors from orders)
select o_orderkey as id, array_to_string(errors, ',') as errors from e where len(errors) > 0
""")
def schema_gate(spark, d):
    rules = {"price": F.col("o_totalprice") > 0, "status": F.col("o_orderstatus").isin("F", "O"), "customer": F.col("o_custkey") % 10 != 0}
    found = gates.failures(table(spark, d, "orders"), "o_orderkey", rules)
    return found.select("id", F.array_join("errors", ",").alias("errors"))


@query("select l_orderkey, l_partkey, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def uniqueness_gate(spark, d):
    return gates.repeated(table(spark, d, "lineitem"), ["l_orderkey", "l_partkey"])


@query("select l_orderkey as src, l_partkey as dst from lineitem where l_orderkey in (select o_orderkey from orders where o_orderstatus = 'F') and l_partkey in (select p_partkey from part where p_size > 10)")
def edges_that_land(spark, d):
    edges = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    sources = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    goals = table(spark, d, "part").filter("p_size > 10").select(F.col("p_partkey").alias("id"))
    found, _ = joins.resolved(edges, "src", sources, "id")
    return joins.resolved(found, "dst", goals, "id")[0].select("src", "dst")
