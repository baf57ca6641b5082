"""Snapshots into the store: insert, update, revive, prune, and the gates that check it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import temporal, text
from ..sources.store import active, not_cold

#: How rendered records begin; such texts come from the engine itself and are no edits.
ENVELOPE = r"^\s*\[(?:semantic|temporal) memory\b"


def plan(snapshot: DataFrame, nodes: DataFrame, as_of: Column, anchor: str | None = None) -> DataFrame:
    """What each record (memory_id, fact, category, created_at, position) does to the nodes: one row per memory_id with its action.

    Of repeated ids the last position counts. insert: new; update: the text changed (an
    archived one comes back); revive: unchanged but archived; relabel: only the label
    changed; keep: nothing to write; skip: a rendered text or the anchor under an unknown id.
    """
    w = Window.partitionBy("memory_id").orderBy(F.desc("position"))
    s = snapshot.filter("memory_id <> ''").withColumn("fact", text.strip_wrapper(F.col("fact"))).withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")
    old = nodes.filter("memory_id <> ''").select("memory_id", F.col("signature"), F.col("fact").alias("old_fact"), F.col("salience").alias("old_label"), "notes", "kind", F.col("first_seen").alias("old_first_seen"))
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    is_anchor = F.lit(False) if anchor is None else squeeze(F.col("fact")) == squeeze(F.lit(anchor))
    rendered = F.col("fact").rlike(ENVELOPE)
    known, archived = F.col("signature").isNotNull(), F.coalesce(F.col("notes") == "archive", F.lit(False))
    action = (
        F.when(is_anchor, "anchor")
        .when(~known, F.when(rendered | (F.col("fact") == ""), "skip").otherwise("insert"))
        .when(rendered | F.col("fact").eqNullSafe(F.col("old_fact")), F.when(archived & (F.col("kind") != "chronicle"), "revive").when(~F.col("category").eqNullSafe(F.col("old_label")) & ~rendered, "relabel").otherwise("keep"))
        .otherwise("update")
    )
    first_seen = F.coalesce("created_at", as_of)
    return s.join(old, "memory_id", "left").select("memory_id", "fact", "category", action.alias("action"), "signature", first_seen.alias("first_seen"), first_seen.cast("date").alias("source_day"), F.least(F.coalesce("created_at", "old_first_seen"), "old_first_seen").alias("backfilled"))


def prune(snapshot: DataFrame, nodes: DataFrame) -> DataFrame:
    """Facts that the snapshot no longer has; details and archive stay."""
    return nodes.filter("kind = 'fact' AND memory_id <> ''").filter(not_cold()).join(snapshot.select("memory_id"), "memory_id", "left_anti")


def missing(snapshot: DataFrame, nodes: DataFrame) -> DataFrame:
    """The completeness gate: records that didn't become nodes."""
    return snapshot.filter("memory_id <> ''").select("memory_id").distinct().join(nodes.select("memory_id"), "memory_id", "left_anti")


def inserted(planned: DataFrame, seq: int) -> DataFrame:
    """The node rows of a plan's inserts; category is a label, never a class."""
    new = planned.filter("action = 'insert'")
    sig = F.concat(F.lit("fact:"), text.derive_slug(F.col("fact")), F.lit("-"), F.substring(F.sha2("memory_id", 256), 1, 8))
    return new.select(F.xxhash64("memory_id").alias("id"), sig.alias("signature"), "memory_id", F.lit("episodic").alias("class"), F.col("category").alias("salience"), F.lit(0.30).alias("strength"), F.lit(0).cast("long").alias("reactivations"), "first_seen", "source_day", F.lit("harness-ingest").alias("notes"), "fact", F.lit("fact").alias("kind"), F.lit(seq).cast("long").alias("ingested_seq"), F.lit(seq).cast("long").alias("dirty_seq"))


def applied(planned: DataFrame, nodes: DataFrame, seq: int) -> DataFrame:
    """All nodes after a plan."""
    p = planned.filter("action IN ('update', 'revive', 'relabel')").select("memory_id", F.col("action").alias("__a"), F.col("fact").alias("__f"), F.col("category").alias("__c"))
    j = nodes.join(p, "memory_id", "left")
    back = F.col("__a").isin("update", "revive") & (F.col("notes") == "archive")
    j = j.withColumn("notes", F.when(back, F.lit(None)).otherwise(F.col("notes"))).withColumn("fact", F.when(F.col("__a") == "update", F.col("__f")).otherwise(F.col("fact")))
    j = j.withColumn("salience", F.when(F.col("__a").isin("update", "relabel"), F.col("__c")).otherwise(F.col("salience"))).withColumn("dirty_seq", F.when(F.col("__a").isNotNull(), F.lit(seq)).otherwise(F.col("dirty_seq")))
    return j.select(nodes.columns).unionByName(inserted(planned, seq), allowMissingColumns=True).select(nodes.columns)


def repaired_dates(nodes: DataFrame, allow_later: bool = False) -> DataFrame:
    """(signature, first_seen, source_day) of facts whose text names a date; only earlier ones unless allowed, and a gist gets no day."""
    found = temporal.earliest_text_date(F.col("fact"))
    c = nodes.filter("kind = 'fact'").select("signature", "notes", "first_seen", found.alias("found")).filter("found IS NOT NULL")
    moved = c.filter(F.col("first_seen").isNull() | (F.col("found") != F.col("first_seen")) if allow_later else F.col("first_seen").isNull() | (F.col("found") < F.col("first_seen")))
    return moved.select("signature", F.col("found").alias("first_seen"), F.when(F.coalesce(F.col("notes") == "gist", F.lit(False)), F.lit(None)).otherwise(F.col("found").cast("date")).alias("source_day"))


def active_only(nodes: DataFrame) -> DataFrame:
    return nodes.filter(active())
