"""Language identification by Bayesian fusion of evidence.

Languages are the declared ones whose rows hold ENOUGH trigrams, however large the table is. Each has a distribution of hashed byte
trigrams of letters, counted over all rows that declare it and smoothed towards that of all declared rows; one more class, of even distribution, stands for text of none of them. A row's posterior multiplies
- the text's tempered likelihood,
- the likelihood of the declared (markup) language, of which a share LIES is wrong,
- the prior of its host, smoothed towards that of its address suffix, and this towards all rows'. The counts behind it are grouped
  sums of the languages that the texts alone show, less the row's own.
A row is kept if its best class is a language with a posterior of SURE at least.

Defined results: null and empty texts have no text evidence; null declarations, hosts and suffixes no evidence or a group of their
own; without any declared language all rows are of none and rejected; rows of equal id are judged each; an empty table gives no rows;
very long texts are read whole; other columns are ignored, and kept by the pipeline stage.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrove.llm import chunks
from lexgrove.llm.common import columns, give_back, map_arrow, materialise, with_few, with_small

BUCKETS = 4096
#: The trigrams that make a declared language a class, those of the whole that each class's are smoothed with, and the declared
#: values that a task sums before it hands them on.
ENOUGH = 1_000
WHOLE = 4_096
HELD = 256
LIES = 0.1
STRANGE = 0.001
#: The share of a text's trigrams that any language's text may have from anywhere: names, keys, addresses.
NOISE = 0.1
TEMPER = 0.3
SMOOTH = 20.0
SURE = 0.5
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 0x20
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)


def trigrams(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(rows, BUCKETS) counts of byte trigrams after folding case and marks; trigrams of spaces alone and over a row's end don't count."""
    folded = _FOLD[data]
    if len(data) > 1:  # Latin-1 capitals after their lead byte
        high = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        folded[high] += 0x20
    rows = len(at) - 1
    if len(data) < 3:
        return np.zeros((rows, BUCKETS))
    x = folded.astype(np.uint32)
    name = ((x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]) * np.uint32(2654435769)) >> np.uint32(20)
    row = np.repeat(np.arange(rows), np.diff(at))
    good = (row[:-2] == row[2:]) & ~((x[:-2] == 0x20) & (x[1:-1] == 0x20))
    return np.bincount(row[:-2][good] * BUCKETS + name[good], minlength=rows * BUCKETS).reshape(rows, BUCKETS).astype(np.float64)


def _counted(batch: pa.RecordBatch):
    data, at = chunks.utf8(batch.column("text"))
    for i, j in chunks.steps(at, 1 << 19):
        yield i, j, trigrams(data[at[i] : at[j]], at[i : j + 1] - at[i])


def learn(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, and the log probabilities of the trigrams in each and in none of them."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}

        def flush():
            for name, n in sums.items():
                cell = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(cell), pa.string()), pa.array(cell.astype(np.int32)), pa.array(n[cell].astype(np.int64))], names=["declared", "cell", "n"])
            sums.clear()

        for batch in batches:
            who = batch.column("declared").to_pylist()
            for i, j, counts in _counted(batch):
                for k in range(i, j):
                    if who[k] is not None:
                        if who[k] not in sums:
                            if len(sums) >= HELD:
                                yield from flush()
                            sums[who[k]] = np.zeros(BUCKETS)
                        sums[who[k]] += counts[k - i]
        yield from flush()
        give_back()

    cells = rows.select("declared", "text").mapInArrow(run, "declared string, cell int, n long").groupBy("declared", "cell").agg(F.sum("n").alias("n"))
    cells = materialise(cells, "language-trigrams")
    names = sorted(x["declared"] for x in cells.groupBy("declared").agg(F.sum("n").alias("n")).filter(F.col("n") >= ENOUGH).collect())
    whole, sums = np.zeros(BUCKETS), np.zeros((len(names), BUCKETS))
    for x in cells.groupBy("cell").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows
        whole[x["cell"]] = x["n"]
    if names:
        number = rows.sparkSession.createDataFrame(list(enumerate(names)), "language int, declared string")
        found = cells.join(F.broadcast(number), "declared").select("language", "cell", "n").toArrow()  # BUCKETS rows a language
        sums[found.column("language").to_numpy(), found.column("cell").to_numpy()] = found.column("n").to_numpy()
    sums += 0.5 + WHOLE * whole / max(whole.sum(), 1.0)
    known = np.log((1 - NOISE) * sums / sums.sum(1, keepdims=True) + NOISE / BUCKETS)
    return names, np.concatenate([known, np.full((1, BUCKETS), -math.log(BUCKETS))])


def identify(rows: DataFrame) -> DataFrame:
    """rows (id, text, declared, host, suffix) -> (id, language, posterior, text_language, kept)."""
    rows = rows.select("id", "text", "declared", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("suffix", F.lit("")).alias("suffix"))
    names, logs = learn(rows)
    classes = [*names, "und"]
    n = len(classes)
    lie, truth = math.log(LIES / max(n - 1, 1)), math.log(1 - LIES)

    def make():
        number = {x: i for i, x in enumerate(names)}

        def call(batch: pa.RecordBatch):
            likely, best = [], []
            for i, j, counts in _counted(batch):
                score = TEMPER * (counts @ logs.T)
                score -= score.max(1, keepdims=True)
                seen = counts.sum(1) > 0
                best += np.where(seen, score.argmax(1), -1).tolist()
                for k in range(i, j):
                    said = number.get(batch.column("declared")[k].as_py(), -1)
                    if said >= 0:
                        score[k - i] += lie
                        score[k - i, said] += truth - lie
                    likely.append(score[k - i])
            return [pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("id", "host", "suffix")), pa.array(best, pa.int32()), pa.array([x.tolist() for x in likely], pa.list_(pa.float64()))], names=["id", "host", "suffix", "best", "likely"])]

        return call

    judged = materialise(map_arrow(rows, make, f"id {rows.schema['id'].dataType.simpleString()}, host string, suffix string, best int, likely array<double>"), "language-texts")
    # grouped counts of what the texts show: by host (and its suffix), by suffix, and overall
    shown = judged.filter("best >= 0")
    by_host = shown.groupBy("host", "suffix", "best").agg(F.count("*").alias("n"))
    per_host = materialise(by_host.groupBy("host", "suffix").agg(F.map_from_entries(F.collect_list(F.struct("best", "n"))).alias("host_n")), "language-hosts")
    per_suffix = by_host.groupBy("suffix", "best").agg(F.sum("n").alias("n")).groupBy("suffix").agg(F.map_from_entries(F.collect_list(F.struct("best", "n"))).alias("suffix_n"))
    overall = {x["best"]: x["n"] for x in by_host.groupBy("best").agg(F.sum("n").alias("n")).collect()}  # a row for each class
    total = sum(overall.values())
    whole = [(overall.get(i, 0) + 1.0) / (total + n) if i < n - 1 else STRANGE for i in range(n)]
    hosts = materialise(with_small(per_host, materialise(per_suffix, "language-suffixes"), "suffix", "left"), "language-priors")
    joined = with_small(judged, hosts, ["host", "suffix"], "left")

    def everyone(counts: str):
        values = F.map_values(F.coalesce(F.col(counts), F.create_map().cast("map<int,bigint>")))
        return F.greatest(F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x) - F.when(F.col("best") >= 0, 1).otherwise(0), F.lit(0))

    joined = joined.withColumn("host_all", everyone("host_n")).withColumn("suffix_all", everyone("suffix_n")).withColumn("whole", F.array(*[F.lit(x) for x in whole]))

    def share(counts: str, everyone: str, before, i):
        mine = F.coalesce(F.col(counts)[i], F.lit(0)) - F.when(F.col("best") == i, 1).otherwise(0)
        return (F.greatest(mine, F.lit(0)) + SMOOTH * before) / (F.col(everyone) + SMOOTH)

    score = F.transform("likely", lambda x, i: x + F.log(share("host_n", "host_all", share("suffix_n", "suffix_all", F.col("whole")[i], i), i)))
    top = joined.withColumn("score", score).withColumn("most", F.array_max("score"))
    weight = F.transform("score", lambda x: F.exp(x - F.col("most")))
    top = top.withColumn("posterior", 1 / F.aggregate(weight, F.lit(0.0), lambda a, x: a + x)).withColumn("place", F.array_position("score", F.col("most")).cast("int"))
    name = F.array(*[F.lit(x) for x in classes])
    language = F.element_at(name, F.col("place"))
    text_language = F.when(F.col("best") >= 0, F.element_at(name, F.col("best") + 1))
    return top.select("id", language.alias("language"), "posterior", text_language.alias("text_language"), ((F.col("place") < n) & (F.col("posterior") >= SURE)).alias("kept"))


def documents(docs: DataFrame) -> DataFrame:
    """(doc_id, language, posterior, text_language, kept); a document's source is its host, and it has no address."""
    rows = docs.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"), F.lit(None).cast("string").alias("suffix"))
    return identify(rows).withColumnRenamed("id", "doc_id")


def kept(docs: DataFrame) -> DataFrame:
    """docs, with all columns, without the rows that are rejected. Rows are told apart by doc_id, text, lang and source, on which the
    decision rests, so rows of equal or null doc_id are judged each."""
    said = [F.coalesce(x, F.lit("\0none")) for x in ("text", "lang", "source")]
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.hex(F.xxhash64(*said)))
    name = "id" + "_" * len("".join(docs.columns))
    rows = docs.select(key.alias("id"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"), F.lit(None).cast("string").alias("suffix"))
    gone = materialise(identify(rows).filter("not kept").select(F.col("id").alias(name)).distinct(), "language-gone")
    return with_few(docs.withColumn(name, key), gone, name, "left_anti").select(columns(docs))


_LANG = r"(?is)<html[^>]*\slang\s*=\s*[\"']?([a-z]+)"


def pages(web: DataFrame) -> DataFrame:
    """(page_id, language, posterior, text_language, kept) from the page's text without markup, its lang, and its address."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?i)[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    text = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>|&[a-zA-Z#0-9]+;?", " ")
    said = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), _LANG, 1))
    rows = web.select(F.col("page_id").alias("id"), text.alias("text"), F.nullif(said, F.lit("")).alias("declared"), host.alias("host"), F.regexp_extract(host, r"([^.]*)$", 1).alias("suffix"))
    return identify(rows).withColumnRenamed("id", "page_id")
