"""Snapshots, decisions and day files in; projections and dumps out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import categorize

_RECORD = "id string, memory_id string, fact string, category string, createdAt string, created_at string, first_seen string"


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """(memory_id, fact, category, created_at, position) of a JSON array of records or {"memories": [...]}; unreadable dates are null."""
    whole = spark.read.text(path, wholetext=True)
    a = F.from_json("value", f"array<struct<{_RECORD.replace(' string', ': string')}>>")
    b = F.from_json("value", f"struct<memories: array<struct<{_RECORD.replace(' string', ': string')}>>>")["memories"]
    rows = whole.select(F.posexplode(F.when(F.ltrim("value").startswith("["), a).otherwise(b)).alias("position", "r"))
    return rows.select(F.coalesce("r.id", "r.memory_id").alias("memory_id"), "r.fact", "r.category", F.try_to_timestamp(F.coalesce("r.createdAt", "r.created_at", "r.first_seen")).alias("created_at"), F.col("position").cast("long").alias("position"))


def read_decisions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A decision file under its schema; one that doesn't parse raises."""
    df = spark.read.schema(schema + ", _corrupt_record string").option("multiLine", True).json(path)
    kept = df.cache()
    bad = kept.filter("_corrupt_record IS NOT NULL").count()
    if bad:
        raise ValueError(f"{path} can't be read as decisions")
    return kept.drop("_corrupt_record")


def day_facts(spark: SparkSession, path: str) -> DataFrame:
    """(id, day, fact, category) of markdown day files: lines without bullets, numbers and bold labels, of eight characters at least; longer ones than 220 by sentences. Headers and quotes are left out."""
    w = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"(20\d\d-\d\d-\d\d)", 1).alias("day"), "value")
    lines = w.select("day", F.posexplode(F.split("value", r"\r?\n")).alias("line", "t")).filter(~F.ltrim("t").rlike("^(#|>|```)"))
    t = F.regexp_replace(F.regexp_replace(F.trim("t"), r"^(?:[-*+]|\d+[.)])\s+", ""), r"^[*]{2}[^*]+[*]{2}:?\s*", "")
    parts = lines.select("day", "line", t.alias("t")).select("day", "line", F.posexplode(F.when(F.length("t") > 220, F.split("t", r"(?<=[.!?])\s+")).otherwise(F.array("t"))).alias("part", "fact"))
    kept = parts.filter(F.length(F.trim("fact")) >= 8)
    return kept.select(F.concat(F.lit("d"), "day", F.lit("-"), "line", F.lit("-"), "part").alias("id"), "day", F.trim("fact").alias("fact"), categorize(F.col("fact")).alias("category"))


def tool_facts(spark: SparkSession, path: str, call: str = "memorySave") -> DataFrame:
    """(id, day, fact) of tool-call day files in YAML: the saved texts of one call, four characters at least, each with its session."""
    w = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"(20\d\d-\d\d-\d\d)", 1).alias("day"), "value")
    items = w.select("day", F.posexplode(F.split("value", r"(?m)^-\s+")).alias("i", "x")).filter(F.regexp_extract("x", r"(?m)^\s*(?:tool|name):\s*\"?([A-Za-z]+)", 1) == call)
    field = lambda n: F.trim(F.regexp_replace(F.regexp_extract("x", rf"(?m)^\s*{n}:\s*(.+)$", 1), "^\"|\"$", ""))
    got = items.select("day", "i", field("(?:fact|content|text)").alias("t"), field("session").alias("s")).filter("length(t) >= 4")
    return got.select(F.concat(F.lit("d"), "day", F.lit("-"), F.col("i").cast("string")).alias("id"), "day", F.when(F.col("s") != "", F.concat(F.lit("["), "s", F.lit("] "), "t")).otherwise(F.col("t")).alias("fact"))


def write_json(df: DataFrame, path: str) -> None:
    """One JSON file in the frame's order; for projections and dumps, whose size is bounded by design."""
    df.coalesce(1).write.mode("overwrite").json(path)
