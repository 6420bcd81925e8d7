"""Elements of markup as nested intervals, and the questions of a tree walk asked of intervals.

An element is a row (key..., tag, start, begin, close, stop): its text is [begin, close), its whole is [start, stop). A tag's elements are
matched among themselves like parentheses, so well-formed markup gives its tree and anything else still gives intervals; an element that is
never closed reaches to its text's end. What encloses what is read from depths: in the order of positions the last element that opened
at depth k is the one that is open now. So a walk is two ordered passes over a text's rows and never pairs elements that don't enclose each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexgrove.functions.text import visible

#: Comments and the contents of scripts and styles are one piece each, then come tags, texts, and a "<" that opens nothing.
PIECES = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|</?[a-z][^\s/>]*[^>]*>|[^<]+|<"
TAG = r"(?is)^<(/?)([a-z][^\s/>]*)"
#: Elements of HTML that hold nothing.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")


def pieces(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys..., n, piece, start, stop): a text's tags and what is between them in order, with code-point offsets."""
    cut = texts.select(*keys, F.posexplode(F.expr(f"regexp_extract_all({text}, r'{PIECES}', 0)")).alias("n", "piece"))
    upto = Window.partitionBy(*keys).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return cut.withColumn("stop", F.sum(F.length("piece")).over(upto).cast("int")).withColumn("start", F.col("stop") - F.length("piece"))


def tags(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., n, tag, opens, piece, start, stop) of the tags among pieces, in lower case; void and self-closed elements are left out."""
    name = F.lower(F.regexp_extract("piece", TAG, 2))
    found = parts.select(*keys, "n", name.alias("tag"), (F.regexp_extract("piece", TAG, 1) == "").alias("opens"), "piece", "start", "stop")
    return found.filter((F.col("tag") != "") & ~F.col("tag").isin(*VOID) & ~F.col("piece").endswith("/>") & ~(F.col("opens") & F.col("tag").isin("script", "style")))


def elements(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys..., tag, level, opening, start, begin, close, stop); level counts the elements of the same tag around it, from 1."""
    found = tags(pieces(texts, keys, text), keys)
    upto = Window.partitionBy(*keys, "tag").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    leveled = found.withColumn("_sum", F.sum(F.when(F.col("opens"), 1).otherwise(-1)).over(upto)).withColumn("level", (F.col("_sum") + F.when(F.col("opens"), 0).otherwise(1)).cast("int"))
    after = Window.partitionBy(*keys, "tag", "level").orderBy("n")
    # at one level openings and closings take turns, but for closings that follow closings of nothing
    matched = leveled.withColumn("_next", F.lead(F.when(~F.col("opens"), F.struct("start", "stop"))).over(after)).filter("opens")
    ends = texts.select(*keys, F.length(text).alias("_end"))
    joined = matched.join(ends, keys)
    return joined.select(*keys, "tag", "level", F.col("piece").alias("opening"), "start", F.col("stop").alias("begin"), F.coalesce("_next.start", "_end").alias("close"), F.coalesce("_next.stop", "_end").alias("stop"))


def first_close(texts: DataFrame, keys: list[str], tag: str, text: str = "text") -> DataFrame:
    """(keys..., start, opening, title): of each element of this tag, the visible text up to the first closing tag of that name, whatever that
    closes; '' if none follows."""
    parts = pieces(texts, keys, text)
    found = tags(parts, keys).filter(F.col("tag") == tag)
    after = Window.partitionBy(*keys).orderBy("n").rowsBetween(1, Window.unboundedFollowing)
    spans = found.withColumn("close", F.first(F.when(~F.col("opens"), F.col("start")), ignorenulls=True).over(after)).filter("opens")
    whole = spans.select(*keys, "start", F.col("piece").alias("opening"), F.col("stop").alias("begin"), "close").join(texts.select(*keys, F.col(text).alias("_text")), keys)
    inner = F.when(F.col("close").isNull(), "").otherwise(visible(F.expr("substring(_text, begin + 1, close - begin)")))
    return whole.select(*keys, "start", "opening", inner.alias("title"))


def enclosing(points: DataFrame, outer: DataFrame, keys: list[str], carried: list[str], nearest: bool = False) -> DataFrame:
    """points (keys..., at, carried...) with start and stop of each element of outer (keys..., start, stop; of one tag) around them, one row for each; an element that
    starts at a point is not around it. With nearest, the innermost only."""
    blank = [F.lit(None).cast(points.schema[c].dataType).alias(c) for c in carried]
    nothing = F.lit(None).cast("int")
    begins = outer.select(*keys, F.col("start").alias("_at"), F.lit(2).alias("_order"), F.lit(1).alias("_step"), "start", "stop", *blank)
    ends = outer.select(*keys, F.col("stop").alias("_at"), F.lit(0).alias("_order"), F.lit(-1).alias("_step"), nothing.alias("start"), nothing.alias("stop"), *blank)
    asked = points.select(*keys, F.col("at").alias("_at"), F.lit(1).alias("_order"), F.lit(0).alias("_step"), nothing.alias("start"), nothing.alias("stop"), *carried)
    upto = Window.partitionBy(*keys).orderBy("_at", "_order", "stop").rowsBetween(Window.unboundedPreceding, 0)
    deep = begins.unionByName(ends).unionByName(asked).withColumn("_depth", F.sum("_step").over(upto)).filter("_order > 0")
    levels = F.when(F.col("_order") == 2, F.array("_depth")).when(F.col("_depth") < 1, F.array().cast("array<bigint>")).otherwise(F.array("_depth") if nearest else F.sequence(F.lit(1).cast("long"), "_depth"))
    rows = deep.withColumn("_level", F.explode(levels))
    before = Window.partitionBy(*keys, "_level").orderBy("_at", "_order").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_order") == 2, F.struct("start", "stop")), ignorenulls=True).over(before)
    return rows.withColumn("_around", last).filter("_order = 1").select(*keys, F.col("_at").alias("at"), *carried, F.col("_around.start").alias("start"), F.col("_around.stop").alias("stop"))


def first_inside(elems: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """elems with inner_start, inner_stop: each element's first descendant of this tag, null without one. One backward pass, no join."""
    after = Window.partitionBy(*keys).orderBy("start").rowsBetween(1, Window.unboundedFollowing)
    found = F.first(F.when(F.col("tag") == tag, F.struct("start", "stop")), ignorenulls=True).over(after)
    inside = F.col("_first.start") < F.col("stop")
    return elems.withColumn("_first", found).withColumn("inner_start", F.when(inside, F.col("_first.start"))).withColumn("inner_stop", F.when(inside, F.col("_first.stop"))).drop("_first")


def top_level(elems: DataFrame, keys: list[str], roots: str, tag: str, skip: tuple[str, ...] = ("quot.s",)) -> DataFrame:
    """(keys..., root, start, stop): descendants of this tag of each element of tag roots that no element of the same tag or of skip within
    the root holds. What lies within a skipped or found element isn't looked at."""
    of = lambda t: elems.filter(F.col("tag") == t).select(*keys, "start", "stop")
    found = of(tag).select(*keys, F.col("start").alias("at"), F.col("stop").alias("end"))
    held = found.withColumn("held", F.lit(-1))
    for other in dict.fromkeys((tag, *skip)):
        around = enclosing(found.select(*keys, "at"), of(other), keys, [], nearest=True).select(*keys, "at", F.col("start").alias("_other"))
        held = held.join(around, [*keys, "at"], "left").withColumn("held", F.greatest("held", F.coalesce("_other", F.lit(-1)))).drop("_other")
    inside = enclosing(held, of(roots), keys, ["end", "held"])
    return inside.filter("start > held").select(*keys, F.col("start").alias("root"), F.col("at").alias("start"), F.col("end").alias("stop"))


def nth_inside(elems: DataFrame, keys: list[str], roots: str, tag: str, n: int, opening: Column | None = None) -> DataFrame:
    """(keys..., root, begin, close): the n-th descendant of this tag, from 1, of each element of tag roots; opening says which opening tags count."""
    counted = elems.filter((F.col("tag") == tag) & (opening if opening is not None else F.lit(True))).select(*keys, F.col("start").alias("at"), "begin", "close")
    outer = elems.filter(F.col("tag") == roots).select(*keys, "start", "stop")
    inside = enclosing(counted, outer, keys, ["begin", "close"])
    place = Window.partitionBy(*keys, "start").orderBy("at")
    return inside.withColumn("_n", F.row_number().over(place)).filter(F.col("_n") == n).select(*keys, F.col("start").alias("root"), "begin", "close")
