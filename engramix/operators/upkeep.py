"""The nightly run over facts: decay, reactivation, and what leaves the active set.

All are set-based: a run reads one version of the store and gives the next one's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scoring
from ..functions.temporal import RESOLUTIONS
from . import graph

EXAMPLES = 40


def decay_facts(facts: DataFrame, fit: DataFrame, now: Column, accel: float, multiplier: float = 1.0) -> DataFrame:
    """Facts with decayed strength and a new last_decayed; ``fit`` is (signature, fit)."""
    j = facts.join(fit.select("signature", F.col("fit").alias("__fit")), "signature", "left")
    half = scoring.half_life(F.col("class"), F.col("salience_score"), F.col("__fit"), accel, multiplier)
    since = F.coalesce("last_decayed", "first_seen", now)
    return j.withColumn("strength", scoring.decayed(F.col("strength"), since, now, half)).withColumn("last_decayed", now).select(facts.columns)


def decay_edges(edges: DataFrame, floor: float = 0.10) -> DataFrame:
    """Edges with decayed weight, without those below the floor."""
    return edges.withColumn("weight", scoring.clamp01(F.col("weight") * scoring.edge_decay(F.col("rel")))).filter(F.col("weight") >= floor)


def reactivate(new: DataFrame, mentions: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """What new facts (signature, seq) bring back through specific hubs.

    ``mentions`` is (src, dst) of all facts. Gives (signature, triggers), with the number of
    new facts that cued it, and (signature, hub, cues, seq) for the families' counters.
    """
    own, rows = graph.specific_mentions(mentions, cap)
    own = graph.cut(own)
    cues = new.select(F.col("signature").alias("src"), "seq")
    fresh = graph.cut(graph.spread(own, rows, "src").join(cues, "src").select("dst", F.col("src").alias("cue"), "seq"))
    # only what shares a hub with something new can come back
    hit = fresh.groupBy("dst").agg(F.count("*").alias("n"))
    near = graph.cut(graph.spread(own, rows, "dst").join(hit, "dst"))
    close, found = near.agg(F.count("*"), F.sum("n")).first()
    old = graph.spread(near, close, "src").join(cues.select("src").distinct(), "src", "left_anti").select(F.col("src").alias("signature"), "dst")
    met = graph.spread(graph.spread(old, max(close, found or 0), "dst").join(fresh, "dst"), found, "signature")
    triggers = met.groupBy("signature").agg(F.countDistinct("cue").alias("triggers"))
    evidence = met.groupBy("signature", F.col("dst").alias("hub")).agg(F.count("*").alias("cues"), F.max("seq").alias("seq"))
    return triggers, evidence


def example_ring(examples: DataFrame, most: int = EXAMPLES) -> DataFrame:
    """The newest examples of each family."""
    w = Window.partitionBy("family_key").orderBy(F.desc("observed_seq"), F.desc("new_sig"), F.desc("old_sig"))
    return examples.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= most).drop("__k")


def merge_counters(before: DataFrame, more: DataFrame) -> DataFrame:
    """Member counters of both: counts added, the latest sequence and its time kept."""
    both = before.unionByName(more)
    return both.groupBy("family_key", "member_sig").agg(F.sum("evidence_count").alias("evidence_count"), F.max("latest_seq").alias("latest_seq"), F.max_by("observed_at", F.struct("latest_seq", "observed_at")).alias("observed_at"))


def pending_families(families: DataFrame, reviews: DataFrame, delta: int = 2) -> DataFrame:
    """(family_key, new_evidence) of families with enough evidence since their review."""
    r = reviews.select("family_key", "reviewed_count")
    fresh = F.col("evidence_count") - F.coalesce("reviewed_count", F.lit(0))
    return families.join(r, "family_key", "left").select("family_key", "evidence_seq", fresh.alias("new_evidence")).filter(F.col("new_evidence") >= delta)


def evaporating(facts: DataFrame, protected: DataFrame, forget_threshold: float, semantic_fade: float) -> DataFrame:
    """Faded facts: weak episodes, and under pressure weak semantic facts, unless protected."""
    weak = ((F.col("class") == "episodic") & (F.col("strength") < forget_threshold)) | ((F.col("class") == "semantic") & (F.col("strength") < semantic_fade))
    return facts.filter(weak).join(protected.select("signature"), "signature", "left_anti")


def over_cap(facts: DataFrame, protected: DataFrame, cap: int) -> DataFrame:
    """(signature, pass) of the facts to evict: the weakest beyond ``cap``; unprotected, non-salient ones first, then (pass 2) any."""
    over = facts.count() - cap
    if over <= 0:
        return facts.limit(0).select("signature", F.lit(1).alias("pass"))
    salient = F.coalesce("salience_score", F.lit(0.0)) >= scoring.SALIENT
    p = protected.select("signature", F.lit(True).alias("__p")).distinct()
    j = facts.join(p, "signature", "left").withColumn("pass", F.when(F.coalesce("__p", F.lit(False)) | salient, 2).otherwise(1)).withColumn("__s", salient.cast("int"))
    return graph.numbered(j.select("signature", "pass", "__s", "strength", "last_decayed"), ["pass", "__s", "strength", "last_decayed", "signature"]).filter(F.col("place") <= over).select("signature", "pass")


def demoting(facts: DataFrame, protected: DataFrame, cap: int) -> DataFrame:
    """(signature, pass) of the facts that move to the archive: details first, then weak ones; salient ones and gists only in pass 2; protected never."""
    over = facts.count() - cap
    if over <= 0:
        return facts.limit(0).select("signature", F.lit(1).alias("pass"))
    salient = F.coalesce("salience_score", F.lit(0.0)) >= scoring.SALIENT
    note = F.coalesce("notes", F.lit(""))
    j = facts.join(protected.select("signature"), "signature", "left_anti").withColumn("pass", F.when(salient | (note == "gist"), 2).otherwise(1))
    j = j.select("signature", "pass", (note != "detail").alias("__d"), salient.alias("__s"), (note == "gist").alias("__g"), "strength", "last_decayed")
    return graph.numbered(j, ["pass", "__d", "__s", "__g", "strength", "last_decayed", "signature"]).filter(F.col("place") <= over).select("signature", "pass")


def unused_hubs(nodes: DataFrame, mentions: DataFrame, facets: DataFrame) -> DataFrame:
    """Entity hubs that nothing mentions and no chronicle names."""
    hubs = nodes.filter("kind = 'entity'")
    return hubs.join(mentions.select(F.col("dst").alias("signature")), "signature", "left_anti").join(facets.select(F.col("entity_sig").alias("signature")), "signature", "left_anti")


def housekeeping(tombstones: DataFrame, journal: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Tombstones of the last 60 days and journal of the last 30."""
    return tombstones.filter(F.col("forgotten_at") >= now - F.expr("INTERVAL 60 DAYS")), journal.filter(F.col("dreamed_at") >= now - F.expr("INTERVAL 30 DAYS"))


def skyline(chronicles: DataFrame, evidence: DataFrame, today: Column) -> DataFrame:
    """Chronicles to archive: old for their resolution, not salient, and inside a coarser active one or with all evidence in coarser ones.

    ``chronicles`` is the active ones: (node_sig, resolution, period_start, period_end, salience_score).
    """
    rank = F.create_map(*[F.lit(x) for k, r in enumerate(RESOLUTIONS) for x in (r, k)])
    most = F.create_map(*[F.lit(x) for r, d in (("day", 14), ("week", 90), ("month", 730), ("quarter", 1460)) for x in (r, d)])
    own = chronicles.withColumn("rank", rank[F.col("resolution")])
    old = own.filter((F.coalesce("salience_score", F.lit(0.0)) < scoring.SALIENT) & (F.datediff(today, F.col("period_end")) > most[F.col("resolution")]))
    years = F.explode(F.sequence(F.year("period_start"), F.year("period_end")))
    coarse = own.select(F.col("rank").alias("r2"), F.col("period_start").alias("s2"), F.col("period_end").alias("e2"), years.alias("y"))
    inside = old.withColumn("y", F.year("period_start")).join(coarse, "y").filter("s2 <= period_start AND e2 >= period_end AND r2 > rank").select("node_sig").distinct()
    e = evidence.select("chronicle_sig", "evidence_sig").distinct()
    top = e.join(own.select(F.col("node_sig").alias("chronicle_sig"), "rank"), "chronicle_sig").groupBy("evidence_sig").agg(F.max("rank").alias("top"))
    covered = old.join(e, F.col("node_sig") == F.col("chronicle_sig")).join(top, "evidence_sig").groupBy("node_sig").agg(F.min((F.col("top") > F.col("rank")).cast("int")).alias("all")).filter("all = 1").select("node_sig")
    return old.join(inside.unionByName(covered).distinct(), "node_sig", "left_semi").select("node_sig", "resolution")
