"""Prompts, configuration, constraints, dumps that may be missing, and tags in source trees."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def prompt(folder: str, kind: str, version: str) -> tuple[str, str]:
    """(text, sha256) of the prompt file kind/version."""
    with open(os.path.join(folder, f"{kind}_{version}.md"), encoding="utf-8") as f:
        text = f.read()
    return text, hashlib.sha256(text.encode()).hexdigest()


def settings(text: str, wanted: tuple[str, ...]) -> dict[str, str]:
    """Keys of a file of two levels (`section:` and indented `key: value`) as section.key; a wanted key that is missing is an error."""
    found, section = {}, ""
    for line in text.splitlines():
        bare = line.split("#")[0].rstrip()
        if not bare:
            continue
        key, _, value = bare.strip().partition(":")
        if bare[0] not in " \t":
            section = key if not value.strip() else ""
        name = f"{section}.{key}" if section and bare[0] in " \t" else key
        if value.strip():
            found[name] = value.strip().strip("\"'")
    lost = [x for x in wanted if not found.get(x)]
    if lost:
        raise ValueError(f"not configured: {', '.join(lost)}")
    return {x: found[x] for x in wanted}


def guarded(config: Mapping[str, str], live: Mapping[str, str], environment: Mapping[str, str], switch: str) -> None:
    """A live run needs the environment's switch, and the models that the configuration of record names."""
    if environment.get(switch) != "1":
        raise PermissionError(f"{switch} is not set to 1")
    for key, value in config.items():
        if live.get(key) != value:
            raise ValueError(f"{key} is {live.get(key)!r}, of record {value!r}")


def constraints(text: str) -> list[str]:
    """Statements, one a line and ended by a semicolon; // begins a comment."""
    bare = (line.split("//")[0].strip() for line in text.splitlines())
    return [x.rstrip(";").strip() for x in bare if x.rstrip(";").strip()]


def dump(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A JSON dump as one row, or None if it is missing or can't be read, so that answers degrade and don't fail."""
    try:
        rows = spark.read.schema(schema + ", _corrupt_record string").json(path, multiLine=True, mode="PERMISSIVE").cache()
        bad = rows.filter("_corrupt_record is not null").limit(1).count()
    except Exception as problem:  # a path that isn't there shows when the frame is made or read
        if "PATH_NOT_FOUND" in str(problem) or "does not exist" in str(problem):
            return None
        raise
    return None if bad or rows.isEmpty() else rows.drop("_corrupt_record")


def tags(spark: SparkSession, folder: str, pattern: str, suffix: str = "*.py") -> DataFrame:
    """(file, tag, n) of all that a pattern finds in a tree's files."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", suffix).text(folder)
    found = lines.select(F.col("_metadata.file_path").alias("file"), F.explode(F.regexp_extract_all("value", F.lit(pattern), F.lit(0))).alias("tag"))
    return found.groupBy("file", "tag").agg(F.count("*").alias("n"))


def write_decisions(decisions: DataFrame, path: str) -> None:
    """Human decisions (item_id, decision), which are few, as one JSON object sorted by item."""
    rows = {x["item_id"]: x["decision"] for x in decisions.select("item_id", "decision").collect()}
    with open(path, "w", encoding="utf-8") as f:
        json.dump(rows, f, indent=2, sort_keys=True)
