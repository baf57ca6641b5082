"""What a host sees: the ordered projection, its diff, dumps and the graph view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import temporal, text
from ..sources.store import not_cold
from .graph import numbered
from .periods import containing, latest

SLOTS = 500


def order(facts: DataFrame) -> DataFrame:
    """(signature, block, place): gists by salience, class and strength; then episodes by time. Details, archive and chronicles aren't among them."""
    f = facts.filter(not_cold())
    gist = F.coalesce(F.col("notes").rlike(r"\bgist\b"), F.lit(False))
    salient = F.coalesce("salience_score", F.lit(0.0)) >= 0.5
    g = f.filter(gist).select("signature", salient.alias("__s"), F.when(F.col("class") == "semantic", 0).otherwise(1).alias("__c"), "strength")
    e = f.filter(~gist).select("signature", "first_seen")
    g = numbered(g, [F.desc("__s"), "__c", F.desc("strength"), "signature"]).select("signature", F.lit(1).alias("block"), "place")
    return g.unionByName(numbered(e, ["first_seen", "signature"]).select("signature", F.lit(2).alias("block"), "place"))


def project(facts: DataFrame, chronicles: DataFrame, now: Column, anchor: str, slots: int = SLOTS) -> DataFrame:
    """(ord, memory_id, fact, category, block): the anchor, gists, chronicles (a fifth of the slots at most), episodes; the newest ones if they don't all fit.

    ``chronicles`` is (node_sig, resolution, period_start, period_end, version, fact) of active ones."""
    room = slots - 1
    f = facts.filter(not_cold())
    gist = F.coalesce(F.col("notes").rlike(r"\bgist\b"), F.lit(False))
    salient = F.coalesce("salience_score", F.lit(0.0)) >= 0.5
    category = F.coalesce(F.nullif(F.col("salience"), F.lit("")), F.when(salient, "salient"), F.col("class"))
    heads = latest(chronicles, ["resolution", "period_start", "period_end"], [F.desc("version")])
    shown = heads.filter(F.col("resolution") == temporal.resolution_for_age(F.datediff(now.cast("date"), F.col("period_end"))))
    top = shown.orderBy(F.desc("period_end"), "node_sig").limit(room // 5)
    n_top = top.count()
    gists = f.filter(gist).orderBy(salient.desc(), F.when(F.col("class") == "semantic", 0).otherwise(1), F.desc("strength"), "signature").limit(room - n_top)
    n_gists = gists.count()
    eps = f.filter(~gist).orderBy(F.desc("first_seen"), F.desc("signature")).limit(max(0, room - n_top - n_gists))
    age = F.concat(F.lit("["), temporal.age_tag(temporal.age_days(F.col("first_seen"), now)), F.lit("] "))
    rows = gists.select("memory_id", "fact", category.alias("category"), F.lit(1).alias("block"), F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(salient.desc(), F.when(F.col("class") == "semantic", 0).otherwise(1), F.desc("strength"), "signature")).alias("k"))
    rows = rows.unionByName(top.select(F.col("node_sig").alias("memory_id"), "fact", F.lit("chronicle").alias("category"), F.lit(2).alias("block"), F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("period_end", "node_sig")).alias("k")))
    rows = rows.unionByName(eps.select("memory_id", F.concat(age, "fact").alias("fact"), category.alias("category"), F.lit(3).alias("block"), F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("first_seen", "signature")).alias("k")))
    first = facts.sparkSession.createDataFrame([(anchor,)], "fact string").select(F.lit(None).cast("string").alias("memory_id"), "fact", F.lit("anchor").alias("category"), F.lit(0).alias("block"), F.lit(0).alias("k"))
    return first.unionByName(rows).withColumn("ord", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("block", "k")) - 1).select("ord", "memory_id", "fact", "category", "block")


def diff(want: DataFrame, have: DataFrame) -> DataFrame:
    """(memory_id, action): ADD, FORGET, UPDATE or KEEP; age prefixes don't count as a change."""
    a = want.select("memory_id", text.strip_age(F.col("fact")).alias("__a"))
    b = have.select("memory_id", text.strip_age(F.col("fact")).alias("__b"))
    action = F.when(F.col("__a").isNull(), "FORGET").when(F.col("__b").isNull(), "ADD").when(F.col("__a") == F.col("__b"), "KEEP").otherwise("UPDATE")
    return a.join(b, "memory_id", "full").select("memory_id", action.alias("action"))


def dump(nodes: DataFrame, archive: bool = False) -> DataFrame:
    """Facts and chronicles in the order of their first sight."""
    kept = nodes.filter("kind IN ('fact', 'chronicle')")
    kept = kept if archive else kept.filter("notes IS NULL OR notes <> 'archive'")
    return kept.select("signature", "kind", "class", "strength", "first_seen", "fact").orderBy("first_seen", "signature")


def view(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of the graph view: nothing archived, links with both ends, heaviest first."""
    n = nodes.filter("notes IS NULL OR notes <> 'archive'").select("signature", "kind", "class", "strength", "fact")
    ids = n.select("signature")
    e = edges.join(ids.withColumnRenamed("signature", "src"), "src", "left_semi").join(ids.withColumnRenamed("signature", "dst"), "dst", "left_semi")
    return n, e.select("src", "rel", "dst", "weight").orderBy(F.desc("weight"), "src", "rel", "dst")


def period_links(chronicles: DataFrame) -> DataFrame:
    """(fine_id, coarse_id): each period to the next coarser one that contains it."""
    rank = F.create_map(*[F.lit(x) for k, r in enumerate(temporal.RESOLUTIONS) for x in (r, k)])
    own = chronicles.select(F.col("node_sig").alias("id"), "period_start", "period_end", rank[F.col("resolution")].alias("rank"))
    pairs = containing(own, own).join(own.select(F.col("id").alias("fine_id"), F.col("rank").alias("r1")), "fine_id").join(own.select(F.col("id").alias("coarse_id"), F.col("rank").alias("r2")), "coarse_id").filter("r2 > r1")
    return latest(pairs, ["fine_id"], ["r2", "coarse_id"]).select("fine_id", "coarse_id")
