"""The same results in DuckDB's SQL, where SQL can express them."""

MIXING = r"""
with sized as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents),
per as (
  select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) - 1 as s from sized group by source),
weighed as (
  select *, case s % 3 when 0 then 5 when 1 then 2 else 1 end as w, 2 * source_size as cap from per),
spent as (
  select *, cap / w as key,
    (sum(source_size) over ()) * 1.5::double - coalesce(sum(cap) over (order by cap / w, s rows between unbounded preceding and 1 preceding), 0) as rest,
    (sum(w) over ()) - coalesce(sum(w) over (order by cap / w, s rows between unbounded preceding and 1 preceding), 0) as wrest
  from weighed),
free as (select rest, wrest from spent where not (rest * w > cap * wrest) order by key, s limit 1),
goals as (
  select source, source_size,
    case when spent.rest * w > cap * spent.wrest then cap::double else coalesce((select rest from free)::double * w::double / (select wrest from free)::double, 0) end as target
  from spent),
placed as (
  select doc_id, sized.source, size, source_size, target, cast(round(target) as bigint) as goal,
    cast(coalesce(sum(size) over (partition by sized.source order by md5(coalesce(cast(doc_id as varchar), '')), doc_id rows between unbounded preceding and 1 preceding), 0) as bigint) as pos
  from sized join goals on sized.source is not distinct from goals.source),
whole as (select sum(target) as total, cast(ceil(sum(target) / 2048) as bigint) as n from goals),
edges as (
  select s, target, sum(target) over (order by s rows between unbounded preceding and current row) / total as hi, n
  from (select s, goals.target from goals join per on goals.source is not distinct from per.source where goals.target > 0), whole),
bounds as (select s, lag(hi, 1, 0) over (order by s) as lo, case when lead(s) over (order by s) is null then 1.0::double else hi end as hi from edges),
points as (
  select slot, (slot + 1) * 0.6180339887498949::double - floor((slot + 1) * 0.6180339887498949::double) as u
  from (select unnest(range((select n from whole))) as slot)),
ranked as (select s, row_number() over (partition by s order by slot) - 1 as block, slot from points join bounds on u >= lo and u < hi),
needs as (
  select s, n, cast(ceil(round(target) / 2048) as bigint) as need, coalesce((select count(*) from ranked r where r.s = edges.s), 0) as have from edges),
slots as (
  select s, block, slot from ranked
  union all
  select s, block, cast(least(floor((block + 0.5::double) / need * n), n - 1) as bigint) from (select s, n, need, unnest(range(have, need)) as block from needs where need > have)),
turns as (
  select placed.*, per.s, pos + e * placed.source_size as a, least(pos + e * placed.source_size + size, goal) as b
  from placed join per on placed.source is not distinct from per.source, (values (0), (1)) epochs(e)
  where size > 0 and pos + e * placed.source_size < goal),
firsts as (
  select turns.doc_id, turns.source, min(slot) as first_slot
  from turns join slots on turns.s = slots.s and slots.block between a // 2048 and (b - 1) // 2048 group by turns.doc_id, turns.source)
select placed.doc_id, size, source_size, target,
  greatest(0, least(pos + size, goal) - pos) + greatest(0, least(pos + source_size + size, goal) - pos - source_size) as taken, first_slot
from placed left join firsts on placed.doc_id = firsts.doc_id and placed.source is not distinct from firsts.source
"""

NEAR_DUPLICATES = r"""
with recursive lists as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sets as (
  select doc_id, list_distinct(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from lists),
items as (select doc_id, len(s) as n, unnest(s) as x from sets),
linked as (
  select a.doc_id as a, b.doc_id as b from items a join items b on a.x = b.x and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(a, b) as (select doc_id, doc_id from documents union select r.a, l.b from reach r join linked l on r.b = l.a),
roots as (select a, min(b) as root from reach group by a)
select doc_id, cast(len(s) as bigint) as n_shingles, root as component_id, doc_id = root as kept from sets join roots on doc_id = a
"""

TOP_K = r"""
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, v.vec_id, cast(list_dot_product(q.e, v.e) as bigint) as score
  from v q join v on q.vec_id % 100 = 0 and q.vec_id <> v.vec_id),
ranked as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 10
"""

MERKLE = r"""
with recursive base as (
  select doc_id, coalesce('=' || lang, '') as tree,
    coalesce(strlen(doc_id::varchar) || ':' || doc_id::varchar, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(n_chars::varchar) || ':' || n_chars::varchar, '-') as head,
    text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as lowered,
    list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: [ord(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda a, x: case when x >= 0 then xor(a, x) else xor(a >> 1, (a & 1) * 3988292384) end) as crc
  from documents),
leaves as (
  select doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf,
    case when xor(crc, 4294967295) % 3 = 0 then sha256(head || coalesce(strlen(lowered) || ':' || lowered, '-')) end as other
  from base),
numbered as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as place, count(*) over (partition by tree) as n from leaves),
nodes(tree, level, place, digest, n) as (
  select tree, 0, place, leaf, n from numbered
  union all
  select tree, level + 1, place // 8, sha256(string_agg(digest, '' order by place)), (n + 7) // 8 from nodes where n > 1 group by tree, level, place // 8, n),
subroots as (select tree, level as height, digest, row_number() over (order by tree) - 1 as place, count(*) over () as n from nodes where n = 1),
tops(level, place, digest, n) as (
  select 0, place, digest, n from subroots
  union all
  select level + 1, place // 8, sha256(string_agg(digest, '' order by place)), (n + 7) // 8 from tops where n > 1 group by level, place // 8, n),
every as (
  select tree, level, place, digest, n from nodes where n > 1
  union all
  select s.tree, s.height + t.level, t.place, t.digest, t.n from tops t, subroots s where t.n > 1),
sides as (
  select a.tree, a.level, a.place, coalesce(string_agg(b.digest, '' order by b.place) filter (b.place < a.place), '') as l,
    coalesce(string_agg(b.digest, '' order by b.place) filter (b.place > a.place), '') as r
  from every a join every b on a.tree = b.tree and a.level = b.level and a.place // 8 = b.place // 8 group by a.tree, a.level, a.place),
walk(doc_id, tree, place, leaf, level, spot, acc, proof) as (
  select doc_id, tree, place, leaf, 0, place, coalesce(other, leaf), '' from numbered
  union all
  select w.doc_id, w.tree, w.place, w.leaf, w.level + 1, case when w.level + 1 = s.height then s.place else w.here // 8 end, sha256(x.l || w.acc || x.r), w.proof || x.l || x.r
  from (select w.*, case when w.level = s.height then s.place else w.spot end as here from walk w join subroots s on w.tree = s.tree) w
  join subroots s on w.tree = s.tree join sides x on x.tree = w.tree and x.level = w.level and x.place = w.here),
ends as (select *, row_number() over (partition by tree, place order by level desc) as last from walk)
select e.doc_id, e.leaf, s.digest as subroot, t.digest as root, sha256(e.proof) as proof_sha256, e.acc as folded_root, e.acc = t.digest as verified,
  case when e.tree <> '' then substring(e.tree, 2) end as lang, e.place
from ends e join subroots s on e.tree = s.tree, (select digest from tops where n = 1) t where e.last = 1
"""

ORACLES = {"op7_top_k": TOP_K, "op2_mixing": MIXING, "op10_near_duplicates": NEAR_DUPLICATES, "op12_manifest": MERKLE}
