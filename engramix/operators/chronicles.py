"""Calendar summaries: which periods are due, whether a decision covers them, and their versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import temporal

CHANGES = ("start", "end", "change", "steady", "none")


def candidates(events: DataFrame, as_of: Column) -> DataFrame:
    """(resolution, period_start, period_end, members, coverage_seq) of every period with evidence (day, seq); longer ones than a day only once closed.

    Days are counted first, so that the other resolutions add up days and not events."""
    days = events.groupBy("day").agg(F.count("*").alias("n"), F.max("seq").alias("s"))
    own = days.withColumn("resolution", F.explode(F.array(*map(F.lit, temporal.RESOLUTIONS))))
    start, end = temporal.period_start(F.col("resolution"), F.col("day")), temporal.period_end(F.col("resolution"), F.col("day"))
    return own.select("resolution", start.alias("period_start"), end.alias("period_end"), "n", "s").filter(F.col("period_end") <= as_of).groupBy("resolution", "period_start", "period_end").agg(F.sum("n").alias("members"), F.max("s").alias("coverage_seq"))


def pending(found: DataFrame, versions: DataFrame) -> DataFrame:
    """Periods without a version, or whose latest one covers less than there is."""
    have = versions.groupBy("resolution", "period_start").agg(F.max("coverage_seq").alias("__seen"))
    return found.join(have, ["resolution", "period_start"], "left").filter("__seen IS NULL OR __seen < coverage_seq").drop("__seen")


def due(found: DataFrame, n: int = 8, oldest_first: bool = False) -> DataFrame:
    """The report: newest end first, then the finer resolution."""
    rank = F.create_map(*[F.lit(x) for k, r in enumerate(temporal.RESOLUTIONS) for x in (r, k)])[F.col("resolution")]
    return found.orderBy(F.asc("period_end") if oldest_first else F.desc("period_end"), rank).limit(n)


def coverage(chronicles: DataFrame, evidence: DataFrame) -> DataFrame:
    """(chronicle_sig, covered, declared) of chronicles with evidence."""
    e = evidence.groupBy("chronicle_sig").agg(F.countDistinct("evidence_sig").alias("covered"))
    return chronicles.join(e, "chronicle_sig").select("chronicle_sig", "covered", "declared")


def faults(entries: DataFrame, evidence: DataFrame, members: DataFrame, hubs: DataFrame, facets: DataFrame) -> DataFrame:
    """(period, reason) of decisions that don't stand: entries (period, ordinal, change_kind, slot_label, summary), evidence and facets of entries, the members and hubs of each period."""
    say = lambda df, why: df.select("period", F.lit(why).alias("reason")).distinct()
    return (
        say(entries.filter(~F.col("change_kind").isin(*CHANGES)), "invalid_change_kind")
        .unionByName(say(entries.filter("length(trim(slot_label)) NOT BETWEEN 1 AND 80 OR length(trim(summary)) NOT BETWEEN 1 AND 400"), "invalid_text"))
        .unionByName(say(evidence.join(members, ["period", "evidence_sig"], "left_anti"), "evidence_outside_period"))
        .unionByName(say(members.join(evidence.select("period", "evidence_sig"), ["period", "evidence_sig"], "left_anti"), "incomplete_coverage"))
        .unionByName(say(facets.join(hubs, ["period", "entity_sig"], "left_anti"), "entity_outside_period"))
    )


def versioned(new: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new chronicles with their version, signatures of the versions that they replace)."""
    keys = ["resolution", "period_start", "period_end"]
    top = existing.groupBy(*keys).agg(F.max("version").alias("__v"), F.max_by("node_sig", "version").alias("__old"))
    j = new.join(top, keys, "left")
    return j.withColumn("version", F.coalesce("__v", F.lit(0)) + 1).drop("__v", "__old"), j.filter("__old IS NOT NULL").select(F.col("__old").alias("node_sig"))


def next_period(chronicles: DataFrame) -> DataFrame:
    """(src, dst) from each period's chronicle to the next of its resolution."""
    w = Window.partitionBy("resolution").orderBy("period_end", "version")
    return chronicles.select(F.lag("node_sig").over(w).alias("src"), F.col("node_sig").alias("dst")).filter("src IS NOT NULL")


def strengths(chronicles: DataFrame, evidence: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_sig, strength, salience_score): the most of the members', .45 at least."""
    m = evidence.join(nodes.select(F.col("signature").alias("evidence_sig"), "strength", "salience_score"), "evidence_sig")
    return m.groupBy(F.col("chronicle_sig").alias("node_sig")).agg(F.greatest(F.lit(0.45), F.max("strength")).alias("strength"), F.coalesce(F.max("salience_score"), F.lit(0.0)).alias("salience_score"))
