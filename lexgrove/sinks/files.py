"""Writers of triples, events, checkpointed units and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrove.functions.text import scrubbed
from lexgrove.streaming.metering import undone


def write_triples(lines: DataFrame, path: str) -> None:
    lines.select("line").write.mode("overwrite").text(path)


def append_events(events: DataFrame, path: str) -> None:
    """Append event lines; secrets in string columns are blotted out."""
    strings = [c for c, kind in events.dtypes if kind == "string"]
    events.withColumns({c: scrubbed(F.col(c)) for c in strings}).write.mode("append").json(path)


def write_units(spark, units: DataFrame, key: str, work, path: str) -> int:
    """Do work(units) for the units that the Parquet folder at path doesn't hold yet, and append it; the units done now."""
    try:
        left = undone(units, spark.read.parquet(path).select(key), key)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        left = units
    n = left.count()
    if n:
        work(left).write.mode("append").parquet(path)
    return n


def markdown(df: DataFrame, title: str, most: int = 200) -> str:
    """A small table as Markdown, the first rows and how many more there are."""
    rows = df.limit(most + 1).collect()
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join("" if x is None else str(x).replace("|", "\\|") for x in row) + " |" for row in rows[:most]]
    return "\n".join(lines + (["", f"and more than {most} rows"] if len(rows) > most else [])) + "\n"
