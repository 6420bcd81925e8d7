"""Queries over the elements of pages, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexgrove.functions.text import visible
from lexgrove.operators import nested, schemas
from lexgrove.plans.documents import _VISIBLE
from lexgrove.plans.registry import query, table

_VOID = ", ".join(f"'{x}'" for x in nested.VOID)
_PIECES = rf"""
cut as (select page_id, unnest(x) as piece, generate_subscripts(x, 1) as n from (select page_id, regexp_extract_all(html, '{nested.PIECES}') as x from pages)),
pieces as (select *, cast(sum(length(piece)) over (partition by page_id order by n) as integer) as stop from cut),
named as (select page_id, n, piece, stop - length(piece) as start, stop, lower(regexp_extract(piece, '(?is)^<(/?)([a-z][^\s/>]*)', 2)) as tag, not starts_with(piece, '</') as opens from pieces),
tags as (select * from named where tag <> '' and tag not in ({_VOID}) and not ends_with(piece, '/>') and not (opens and tag in ('script', 'style'))),
leveled as (select *, cast(sum(case when opens then 1 else -1 end) over (partition by page_id, tag order by n) + case when opens then 0 else 1 end as integer) as level from tags),
elements as (
  select o.page_id, o.tag, o.level, o.piece as opening, o.start, o.stop as begin, coalesce(c.start, length(html)) as close, coalesce(c.stop, length(html)) as stop
  from (select *, lead(case when not opens then n end) over (partition by page_id, tag, level order by n) as m from leveled) o
  left join tags c on o.page_id = c.page_id and o.m = c.n join pages on o.page_id = pages.page_id where o.opens)
"""


def _elements(spark, d):
    return nested.elements(table(spark, d, "pages"), ["page_id"], "html")


@query(f"with {_PIECES} select page_id, tag, level, start, begin, close, stop from elements")
def element_intervals(spark, d):
    return _elements(spark, d).drop("opening")


@query(f"""
with {_PIECES}
select a.page_id, a.tag, a.start, min(b.start) as inner_start, arg_min(b.stop, b.start) as inner_stop
from elements a left join elements b on a.page_id = b.page_id and b.tag = 'p' and b.start > a.start and b.start < a.stop where a.tag in ('body', 'article', 'nav', 'div', 'section', 'aside', 'footer', 'b') group by all
""")
def first_descendants(spark, d):
    found = nested.first_inside(_elements(spark, d), ["page_id"], "p")
    return found.filter(F.col("tag").isin("body", "article", "nav", "div", "section", "aside", "footer", "b")).select("page_id", "tag", "start", "inner_start", "inner_stop")


@query(f"""
with {_PIECES}
select r.page_id, r.start as root, t.start, t.stop from elements r join elements t on r.page_id = t.page_id and r.tag = 'body' and t.tag = 'p' and r.start < t.start and t.start < r.stop
where not exists (
  select 1 from elements s where s.page_id = t.page_id and s.tag in ('p', 'div', 'nav', 'footer') and s.start > r.start and s.start < t.start and t.start < s.stop)
""")
def top_level_descendants(spark, d):
    """Paragraphs of a body outside of other paragraphs, divisions, menus and footers."""
    return nested.top_level(_elements(spark, d), ["page_id"], "body", "p", ("div", "nav", "footer"))


@query(f"""
with {_PIECES},
closed as (select page_id, n, tag, opens, piece, start, stop, min(case when not opens then start end) over (partition by page_id, tag order by n rows between 1 following and unbounded following) as close from tags)
select c.page_id, tag, start, case when close is null then '' else {_VISIBLE.format("substring(html, stop + 1, close - stop)")} end as title
from closed c join pages on c.page_id = pages.page_id where opens and tag in ('h1', 'title', 'p')
""")
def element_titles(spark, d):
    """Titles and paragraphs up to the first closing tag of their name."""
    pages, found = table(spark, d, "pages"), None
    for tag in ("h1", "title", "p"):
        some = nested.first_close(pages, ["page_id"], tag, "html").select("page_id", F.lit(tag).alias("tag"), "start", "title")
        found = some if found is None else found.union(some)
    return found


@query(f"""
with {_PIECES}, counted as (
  select r.page_id, r.start as root, t.begin, t.close, row_number() over (partition by r.page_id, r.start order by t.start) as k
  from elements r join elements t on r.page_id = t.page_id and r.tag = 'article' and t.tag = 'p' and r.start < t.start and t.start < r.stop)
select c.page_id, root, {_VISIBLE.format("substring(html, begin + 1, close - begin)")} as second from counted c join pages on c.page_id = pages.page_id where k = 2
""")
def second_paragraphs(spark, d):
    found = nested.nth_inside(_elements(spark, d), ["page_id"], "article", "p", 2)
    whole = found.join(table(spark, d, "pages").select("page_id", "html"), "page_id")
    return whole.select("page_id", "root", visible(F.expr("substring(html, begin + 1, close - begin)")).alias("second"))


#: What a row of documents with its labels must be like.
RECORD = {
    "type": "object", "required": ["doc_id", "lang", "source", "labels"],
    "properties": {
        "doc_id": {"type": "integer", "minimum": 0}, "lang": {"enum": ["en", "de", "fr"]}, "source": {"type": "string", "pattern": "^src[0-4]$"}, "n_chars": {"type": "integer", "minimum": 60, "maximum": 20000},
        "labels": {"type": "object", "required": ["quality"], "properties": {"quality": {"enum": [0, 1]}, "toxic": {"const": 0}}},
        "lines": {"type": "array", "maxItems": 4, "items": {"type": "string", "minLength": 1, "maxLength": 400}},
    },
    "if": {"properties": {"lang": {"const": "de"}}}, "then": {"properties": {"n_chars": {"maximum": 4000}}}, "else": {"properties": {"n_chars": {"minimum": 80}}},
}


@query("""
with r as (select d.doc_id, lang, source, n_chars, string_split(text, chr(10)) as lines, l.doc_id is not null as labelled, quality, toxic from documents d left join labels l on d.doc_id = l.doc_id),
items as (select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) - 1 as i from r),
failed as (
  select doc_id, '/doc_id' as path, 'minimum' as keyword from r where doc_id < 0
  union all select doc_id, '/lang', 'enum' from r where lang is not null and lang not in ('en', 'de', 'fr')
  union all select doc_id, '/lang', 'required' from r where lang is null
  union all select doc_id, '/source', 'pattern' from r where source is not null and not regexp_matches(source, '^src[0-4]$')
  union all select doc_id, '/source', 'required' from r where source is null
  union all select doc_id, '/n_chars', 'minimum' from r where n_chars < 60
  union all select doc_id, '/n_chars', 'maximum' from r where n_chars > 20000
  union all select doc_id, '/labels', 'required' from r where not labelled
  union all select doc_id, '/labels/quality', 'required' from r where labelled and quality is null
  union all select doc_id, '/labels/quality', 'enum' from r where quality not in (0, 1)
  union all select doc_id, '/labels/toxic', 'const' from r where toxic <> 0
  union all select doc_id, '/lines', 'maxItems' from r where len(lines) > 4
  union all select doc_id, '/lines/' || i, 'minLength' from items where length(line) < 1
  union all select doc_id, '/lines/' || i, 'maxLength' from items where length(line) > 400
  union all select doc_id, '/n_chars', 'maximum' from r where coalesce(lang = 'de', true) and n_chars > 4000
  union all select doc_id, '/n_chars', 'minimum' from r where not coalesce(lang = 'de', true) and n_chars < 80)
select path, keyword, count(*) as n from (select regexp_replace(path, '/[0-9]+$', '/*') as path, keyword from failed) group by all
""")
def schema_failures(spark, d):
    """What the rows that a schema drops break, counted by path."""
    return schemas.split_valid(_records(spark, d), "record", RECORD)[1]


def _records(spark, d):
    labels = table(spark, d, "labels").select("doc_id", F.struct("quality", "toxic").alias("labels"))
    rows = table(spark, d, "documents").join(labels, "doc_id", "left").withColumn("lines", F.split("text", "\n"))
    return rows.select("doc_id", F.to_json(F.struct("doc_id", "lang", "source", "n_chars", "labels", "lines")).alias("record"))


@query("""
with r as (select d.doc_id, lang, source, n_chars, string_split(text, chr(10)) as lines, l.doc_id is not null as labelled, quality, toxic from documents d left join labels l on d.doc_id = l.doc_id)
select doc_id from r where doc_id >= 0 and lang in ('en', 'de', 'fr') and regexp_matches(source, '^src[0-4]$') and coalesce(n_chars between 60 and 20000, true) and labelled and quality in (0, 1)
  and coalesce(toxic = 0, true) and (lines is null or (len(lines) <= 4 and len(list_filter(lines, lambda x: length(x) not between 1 and 400)) = 0))
  and case when lang = 'de' then coalesce(n_chars <= 4000, true) else coalesce(n_chars >= 80, true) end
""")
def schema_valid(spark, d):
    return schemas.split_valid(_records(spark, d), "record", RECORD)[0].select("doc_id")
