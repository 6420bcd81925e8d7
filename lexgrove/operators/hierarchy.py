"""Containment of any depth as nested JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrove.operators.store import kept, written

#: Levels that are folded in one job; a lower one is computed and kept apart, so plans of deep trees stay short.
FOLDED = 4


def levels(rows: DataFrame) -> list[DataFrame]:
    """rows (id, parent, ...) by depth. Roots are rows without a parent or whose parent isn't there; what no root leads to (cycles) is in no level.
    rows are read anew for each level, and each row is written once, with its level."""
    known = rows.select(F.col("id").alias("parent")).distinct()
    roots = rows.filter("parent is null").unionByName(rows.filter("parent is not null").join(known, "parent", "left_anti").select(rows.columns))
    out, front = [], written(roots)
    while not front.isEmpty():
        out.append(front)
        front = written(rows.join(front.select(F.col("id").alias("parent")).distinct(), "parent").select(rows.columns))
    return out


def nested(nodes: DataFrame, key: str, parent: str, order: list[str], body: Column, children: str = "children") -> DataFrame:
    """(key, json): each root's whole tree. A node is the JSON object of body, a struct, followed by its children in order under `children`; a
    node without children has no such member. Levels are folded from the deepest up, each by one shuffle on the parent; a row holds no more than one
    root's tree, so roots are to be chosen so that this fits."""
    rows = _written_out(nodes, key, parent, order, body)
    return _folded(levels(rows) or [rows], key, children)


def folded(by_depth: list[DataFrame], key: str, parent: str, order: list[str], body: Column, children: str = "children") -> DataFrame:
    """nested where the nodes of each level are known, roots first: each level is shuffled once and nothing is looked for or kept. Nodes whose parent isn't in the
    level above are in no tree."""
    return _folded([_written_out(x, key, parent, order, body) for x in by_depth], key, children)


def _written_out(nodes: DataFrame, key: str, parent: str, order: list[str], body: Column) -> DataFrame:
    return nodes.select(F.col(key).alias("id"), F.col(parent).alias("parent"), F.struct(*order).alias("ord"), F.to_json(body).alias("json"))


def _folded(by_depth: list[DataFrame], key: str, children: str) -> DataFrame:
    below = None  # (id, parts) of what is beneath a level
    for depth, level in reversed(list(enumerate(by_depth))[1:]):
        below = _held(level, below, children).groupBy(F.col("parent").alias("id")).agg(F.collect_list(F.struct("ord", "id", "json")).alias("parts"))
        below = kept(below) if depth % FOLDED == 0 else below
    return _held(by_depth[0], below, children).select(F.col("id").alias(key), "json")


def _held(level: DataFrame, below: DataFrame | None, children: str) -> DataFrame:
    """level with each node's parts written into its JSON."""
    if below is None:
        return level
    inner = F.array_join(F.transform(F.array_sort("parts"), lambda x: x["json"]), ",")
    head = F.concat(F.expr("substring(json, 1, length(json) - 1)"), F.when(F.col("json") == "{}", "").otherwise(","), F.lit(f'"{children}":['))
    return level.join(below, "id", "left").withColumn("json", F.when(F.col("parts").isNull(), F.col("json")).otherwise(F.concat(head, inner, F.lit("]}")))).drop("parts")
