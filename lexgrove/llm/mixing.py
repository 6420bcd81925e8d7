"""Mixing sources to target weights by a low-discrepancy schedule; DataFrame operations only.

The corpus is cut, source by source and in a hashed order, into blocks of equally many words. Slot i of the mix gets the
point frac((i + 1) * golden ratio), which the cumulative targets map to a source; the r-th slot of a source takes the r-th
block of its (repeated) shuffled stream. A source's last block is cut where its target is reached, and slots beyond it stay empty;
a source that the points gave too few slots gets the rest at even distances. So each source's taken words equal its rounded target,
and every prefix of the slots holds the sources in about their shares. The mix is the blocks in slot order; in the pipeline's table of
documents each time that a document is taken stands where the slot of its first word puts it.

Defined results: null text has size 0; a null source is a source of its own, last in order; documents without words and
sources without words take 0; an empty table gives an empty mix; rows with equal doc_id are separate documents that tie by
source and text hash; very long texts count whole; extra columns are ignored by the digest and kept by the pipeline stage.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexgrove.llm.common import WORD, columns, materialise, running_sum, with_small

#: Fixed values of the contract.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2
#: Words of a block, slots of a counting chunk, cells of [0, 1), and hexadecimal digits that make a stream's buckets.
BLOCK = 2048
CHUNK = 4096
CELLS = 4096
DIGITS = 3
GOLDEN = 0.6180339887498949


def sizes(docs: DataFrame, row: str | None = None) -> DataFrame:
    """(_row, source, doc_id, size, _h, _t): a row for each document, numbered by column row if given; _h orders the shuffled stream."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        (F.col(row) if row else F.monotonically_increasing_id()).alias("_row"), "doc_id", "source",
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("_h"),
        F.xxhash64(text).alias("_t"),
    )


def targets(sized: DataFrame) -> DataFrame:
    """(source, _s, source_size, target): water-filling over the sources, numbered _s in order. With sources sorted by
    limit over weight, the first k stop at their limit and the rest share what is left by weight; k is the least number
    for which none of the rest is above its limit. The unpartitioned windows run over a row for each source."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    w = per.withColumn("_s", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).cast("long"))
    w = w.withColumn("_w", F.element_at(F.array(*[F.lit(x) for x in WEIGHTS]), (F.col("_s") % len(WEIGHTS) + 1).cast("int")).cast("long"))
    w = w.withColumn("_cap", F.col("source_size") * LIMIT).withColumn("_key", F.col("_cap") / F.col("_w"))
    before = Window.orderBy("_key", "_s").rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("_left", F.sum("source_size").over(everything) * F.lit(SHARE) - F.coalesce(F.sum("_cap").over(before), F.lit(0)))
    w = w.withColumn("_wleft", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
    # a source stops if its share of what those before it leave is above its limit
    w = w.withColumn("_stops", F.col("_left") * F.col("_w") > F.col("_cap") * F.col("_wleft"))
    free = F.min(F.when(~F.col("_stops"), F.struct("_key", "_s", "_left", "_wleft"))).over(everything)
    w = w.withColumn("_free", free)
    target = F.when(F.col("_stops"), F.col("_cap").cast("double")).otherwise(F.col("_free._left") * F.col("_w") / F.col("_free._wleft"))
    return w.select("source", "_s", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def streams(numbered: DataFrame) -> DataFrame:
    """numbered with _at: the words before the document in its source's shuffled stream."""
    keyed = numbered.withColumn("_bucket", F.conv(F.substring("_h", 1, DIGITS), 16, 10).cast("int"))
    return running_sum(keyed, "_s", ["_h", "doc_id", "_t", "_row"], "size", "_bucket", "_at")


def schedule(goals: DataFrame, block: int = BLOCK) -> tuple[DataFrame, int]:
    """(_s, block, slot): which slot of the mix takes each block, and the number of slots; goals has (_s, target), materialised.

    Points find their source by an equal join on their cell of [0, 1) and the bounds of the sources that reach into it. Ranks
    come from counts by chunks of slots, summed by source, so no task sees all slots of a source.
    """
    spark = goals.sparkSession
    total = goals.agg(F.sum("target")).first()[0] or 0.0
    n = math.ceil(total / block)
    edge = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)
    bounds = goals.filter("target > 0").withColumn("_hi", F.sum("target").over(edge) / F.lit(total or 1.0))
    bounds = bounds.withColumn("_lo", F.lag("_hi", 1, 0.0).over(Window.orderBy("_s")))
    bounds = bounds.withColumn("_hi", F.when(F.lead("_s").over(Window.orderBy("_s")).isNull(), F.lit(1.0)).otherwise(F.col("_hi")))
    cells = bounds.select("_s", "_lo", "_hi", F.explode(F.sequence(F.floor(F.col("_lo") * CELLS).cast("int"), F.least(F.floor(F.col("_hi") * CELLS), F.lit(CELLS - 1)).cast("int"))).alias("_cell"))
    x = (F.col("id") + 1) * F.lit(GOLDEN)
    points = spark.range(0, n).select(F.col("id").alias("slot"), (x - F.floor(x)).alias("_u")).withColumn("_cell", F.floor(F.col("_u") * CELLS).cast("int"))
    found = points.join(cells, "_cell").filter("_u >= _lo and _u < _hi").select("_s", "slot", F.lit(1).alias("_one"), F.floor(F.col("slot") / CHUNK).alias("_chunk"))
    ranked = running_sum(found, "_s", ["slot"], "_one", "_chunk", "block").select("_s", "block", "slot")
    need = F.ceil(F.round("target") / block).cast("long")
    have = goals.join(ranked.groupBy("_s").agg(F.count("*").alias("_have")), "_s", "left").withColumn("_need", need).withColumn("_have", F.coalesce("_have", F.lit(0)))
    missed = have.filter("_need > _have").select("_s", "_need", F.explode(F.sequence(F.col("_have"), F.col("_need") - 1)).alias("block"))
    even = F.least(F.floor((F.col("block") + 0.5) / F.col("_need") * n), F.lit(n - 1)).cast("long")
    return ranked.union(missed.select("_s", "block", even.alias("slot"))), n


def mix(docs: DataFrame, block: int = BLOCK, row: str | None = None) -> tuple[DataFrame, DataFrame, int]:
    """(documents, pieces, slots). documents: _row, doc_id, size, source_size, target; pieces: _row, slot, _s, _epoch, _start, _from, words, the
    part of a document's words that a slot takes, where _start is the document's place in its source's repeated stream."""
    sized = materialise(sizes(docs, row), "mix-sizes")
    goals = materialise(targets(sized), "mix-targets")
    numbered = with_small(sized.withColumnRenamed("source", "_name"), goals, F.col("_name").eqNullSafe(F.col("source"))).drop("_name")
    placed = materialise(streams(numbered), "mix-streams")
    goal = F.round("target").cast("long")
    turns = placed.filter("size > 0").withColumn("_epoch", F.explode(F.array(*[F.lit(x) for x in range(LIMIT)])))
    turns = turns.withColumn("_start", F.col("_at") + F.col("_epoch") * F.col("source_size")).withColumn("_end", F.least(F.col("_start") + F.col("size"), goal)).filter("_end > _start")
    cut = turns.withColumn("block", F.explode(F.sequence(F.floor(F.col("_start") / block), F.floor((F.col("_end") - 1) / block))))
    first, last = F.greatest("_start", F.col("block") * block), F.least("_end", (F.col("block") + 1) * block)
    parts = cut.select("_row", "_s", "block", "_epoch", "_start", (first - F.col("_start")).alias("_from"), (last - first).alias("words"))
    slots, n = schedule(goals, block)
    pieces = parts.join(slots, ["_s", "block"]).select("_row", "slot", "_s", "_epoch", "_start", "_from", "words")
    return placed.select("_row", "doc_id", "size", "source_size", "target"), pieces, n


def digest(docs: DataFrame) -> DataFrame:
    """The contract's rows, with the first slot that takes some of the document."""
    documents, pieces, _ = mix(docs)
    taken = pieces.groupBy("_row").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    return documents.join(taken, "_row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")


def mixed(docs: DataFrame) -> DataFrame:
    """docs as the mix takes them, in slot order: a row for each time that a document is taken, with its first words if that isn't the
    whole; n_chars follows the text."""
    row, turn, place = (next(x + "_" * i for i in range(len(docs.columns) + 1) if x + "_" * i not in docs.columns) for x in ("_row", "_turn", "_place"))
    numbered = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")  # the numbers must not change
    documents, pieces, n = mix(numbered, row=row)
    times = pieces.groupBy("_row", "_epoch").agg(F.min_by(F.struct("slot", "_s", "_start"), "_from").alias("at"), F.sum("words").alias("words"))
    cut = times.join(documents.select("_row", "size"), "_row").groupBy(F.col("_row").alias(row)).agg(F.collect_list(F.struct("at", F.when(F.col("words") < F.col("size"), F.col("words").cast("int")).alias("words"))).alias(turn))
    rows = numbered.join(cut, row).withColumn(turn, F.explode(turn))  # LIMIT turns at most
    words = F.col(f"{turn}.words")  # one document of a source at most is cut
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), 1, words), "")
    rows = rows.withColumn("text", F.when(words.isNotNull(), part).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(words.isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    # slots hold equally many words, so their number alone makes even ranges and no sample is needed
    many = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), numbered.rdd.getNumPartitions())
    ranged = rows.withColumn(place, F.floor(F.col(f"{turn}.at.slot") / max(n, 1) * many).cast("int")).repartitionById(many, place)
    return ranged.sortWithinPartitions(f"{turn}.at").select(columns(docs))
