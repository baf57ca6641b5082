"""Texts that stand for derived memories, and their recognition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .temporal import RESOLUTIONS
from .text import humanize, humanize_relation

HEADS = {"semantic": "[semantic memory", "temporal": "[temporal memory"}
NOTICE = "A summary; its evidence is authoritative."
ENTRIES = 6


def is_rendered(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^\s*\[(?:semantic|temporal) memory\b"), F.lit(False))


def _cut(c: Column, n: int = 96) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("…"))).otherwise(c)


def semantic(gists: DataFrame, spans: DataFrame, landmarks: DataFrame, companions: DataFrame) -> DataFrame:
    """(signature, text): form and notice, the gist, its landmarks, and its companion's period or else its evidence's span.

    gists (signature, fact, temporal_form), spans (signature, first_day, last_day, n),
    landmarks (signature, role, ordinal, fact), companions (signature, resolution, period_start, period_end)."""
    role = F.when(F.col("role") == "before", 0).when(F.col("role") == "change", 1).otherwise(2)
    marks = landmarks.groupBy("signature").agg(F.array_sort(F.collect_list(F.struct(role.alias("r"), "ordinal", F.concat("role", F.lit(": "), _cut(F.col("fact"))).alias("line")))).alias("m"))
    j = gists.join(spans, "signature", "left").join(marks, "signature", "left").join(companions, "signature", "left")
    span = F.when(F.col("resolution").isNotNull(), F.concat(F.lit("see "), "resolution", F.lit(" "), F.col("period_start").cast("string"), F.lit(" to "), F.col("period_end").cast("string"))).when(F.col("n") > 0, F.concat(F.lit("evidence: "), F.col("n").cast("string"), F.lit(" from "), F.col("first_day").cast("string"), F.lit(" to "), F.col("last_day").cast("string")))
    head = F.concat(F.lit(HEADS["semantic"] + ", "), F.coalesce("temporal_form", F.lit("atemporal")), F.lit("] " + NOTICE))
    return j.select("signature", F.concat_ws("\n", head, "fact", F.transform(F.coalesce("m", F.array()), lambda x: x["line"]), span).alias("text"))


def spans(detail_of: DataFrame, nodes: DataFrame) -> DataFrame:
    """(signature, first_day, last_day, n): since when and until when a gist (signature) has evidence (detail_sig), and how much of it is dated."""
    d = nodes.filter("source_day IS NOT NULL").select(F.col("signature").alias("detail_sig"), "source_day")
    return detail_of.select("signature", "detail_sig").join(d, "detail_sig").groupBy("signature").agg(F.min("source_day").alias("first_day"), F.max("source_day").alias("last_day"), F.count("*").alias("n"))


def temporal(chronicles: DataFrame, entries: DataFrame, most: int = ENTRIES) -> DataFrame:
    """(node_sig, text): period and notice, then the first and last entries, and how many are left out between."""
    n = F.count("*").over(Window.partitionBy("chronicle_sig"))
    k = F.row_number().over(Window.partitionBy("chronicle_sig").orderBy("ordinal"))
    e = entries.withColumn("n", n).withColumn("k", k)
    half = (most + 1) // 2
    shown = e.filter((F.col("k") <= half) | (F.col("k") > F.col("n") - (most - half)))
    lines = shown.groupBy(F.col("chronicle_sig").alias("node_sig")).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("k", F.concat(F.lit("- "), "slot_label", F.lit(": "), _cut(F.element_at(F.split("summary", "\n"), 1))).alias("line")))).alias("l"))
    head = F.concat(F.lit(HEADS["temporal"] + ", "), "resolution", F.lit(" "), F.col("period_start").cast("string"), F.lit(" to "), F.col("period_end").cast("string"), F.lit("] " + NOTICE))
    rest = F.when(F.col("n") > most, F.concat(F.lit("("), (F.col("n") - most).cast("string"), F.lit(" more)")))
    return chronicles.join(lines, "node_sig", "left").select("node_sig", F.concat_ws("\n", head, F.transform(F.coalesce("l", F.array()), lambda x: x["line"]), rest).alias("text"))


def neighbourhood(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(signature, text): a hub in words, with its relations in both directions; what a hub without a fact is embedded by."""
    out = edges.select(F.col("src").alias("signature"), F.concat(humanize_relation(F.col("rel")), F.lit(" "), humanize(F.col("dst"))).alias("p"))
    into = edges.select(F.col("dst").alias("signature"), F.concat(humanize(F.col("src")), F.lit(" "), humanize_relation(F.col("rel")), F.lit(" this")).alias("p"))
    parts = out.unionByName(into).groupBy("signature").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    return nodes.select("signature").join(parts, "signature", "left").select("signature", F.concat_ws(". ", humanize(F.col("signature")), "ps").alias("text"))


def companion(detail_of: DataFrame, chronicle_evidence: DataFrame, chronicles: DataFrame) -> DataFrame:
    """(signature, resolution, period_start, period_end): of each gist, the chronicle that shares most of its evidence; the coarser, then the later of equals."""
    rank = F.create_map(*[F.lit(x) for k, r in enumerate(RESOLUTIONS) for x in (r, k)])[F.col("resolution")]
    shared = detail_of.select(F.col("gist_sig").alias("signature"), F.col("detail_sig").alias("evidence_sig")).join(chronicle_evidence.select("chronicle_sig", "evidence_sig").distinct(), "evidence_sig").groupBy("signature", F.col("chronicle_sig").alias("node_sig")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("signature").orderBy(F.desc("n"), rank.desc(), F.desc("period_end"), "node_sig")
    return shared.join(chronicles.select("node_sig", "resolution", "period_start", "period_end"), "node_sig").withColumn("__k", F.row_number().over(w)).filter("__k = 1").select("signature", "resolution", "period_start", "period_end")
