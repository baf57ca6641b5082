"""What a reviewer is shown: entities, aliases, salience, recurring families, the budget. Nothing here changes the store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scoring, text
from ..functions.vector import knn_pairs
from ..sources.store import Store, dirty, not_cold
from ..sources.tuning import Tuning
from . import graph, review, upkeep

PROVISIONAL, APPROVED, SAMPLES = 20, 10, 3
SALIENCE_REVIEW = 20
POOLS, POOL_MEMBERS, POOL_EVIDENCE = 10, 24, 12


def changed_facts(store: Store) -> DataFrame:
    """(signature, fact) of the active facts changed since the last reflection; all if there was none."""
    return store.facts().filter(dirty(store.cursor("last_reflect_seq"))).select("signature", "fact")


def hub_status(nodes: DataFrame, adjudications: DataFrame) -> DataFrame:
    """(id, signature, forms, first_seen, status) of every hub: its latest judgement, else provisional if a weave proposed it and approved otherwise."""
    last = review.keep_last(adjudications).select(F.col("sig").alias("signature"), F.col("status").alias("judged"))
    own = F.when(F.col("notes") == "weave-extract", "provisional").otherwise("approved")
    return nodes.filter("kind = 'entity'").join(last, "signature", "left").select("id", "signature", "forms", "first_seen", F.coalesce("judged", own).alias("status"))


def hubs_to_review(hubs: DataFrame, mentions: DataFrame, facts: DataFrame, cursor: int, provisional: int = PROVISIONAL, approved: int = APPROVED, samples: int = SAMPLES) -> DataFrame:
    """(place, id, sig, type, status, degree, forms, sample): the provisional hubs of most mentions, then the next approved ones after the cursor, each with its first facts.

    ``hubs`` is as of :func:`hub_status`, ``mentions`` (src, dst), ``facts`` (id, signature, fact).
    """
    live = hubs.filter("status IN ('provisional', 'approved')").join(graph.hub_degree(mentions).withColumnRenamed("dst", "signature"), "signature", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    new = live.filter("status = 'provisional'").orderBy(F.desc("degree"), "first_seen", "id").limit(provisional)
    new = new.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("degree"), "first_seen", "id")))
    old = review.rotating(live.filter("status = 'approved'"), cursor, approved)
    old = old.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("id") <= cursor, "id")) + provisional)
    both = new.unionByName(old)
    w = Window.partitionBy("dst").orderBy("id")
    said = mentions.join(F.broadcast(both.select(F.col("signature").alias("dst"))), "dst", "left_semi").join(facts.select(F.col("signature").alias("src"), "id", "fact"), "src")
    first = said.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= samples).groupBy(F.col("dst").alias("signature")).agg(F.array_sort(F.collect_list(F.struct("k", "fact"))).alias("s"))
    forms = F.array_distinct(F.concat(text.forms_for(F.col("signature")), F.coalesce("forms", F.array().cast("array<string>"))))
    return both.join(first, "signature", "left").select(
        F.col("place").cast("long").alias("place"), "id", F.col("signature").alias("sig"), text.type_of(F.col("signature")).alias("type"), "status", F.col("degree").cast("long").alias("degree"),
        F.array_sort(F.filter(forms, lambda f: F.length(f) >= 3)).alias("forms"), F.transform(F.coalesce("s", F.array().cast("array<struct<k:int,fact:string>>")), lambda x: x["fact"]).alias("sample"),
    )


def entities(store: Store) -> tuple[DataFrame, DataFrame, str, int]:
    """(changed facts, hubs to review, report id, next cursor). The id changes with whatever a decision rests on."""
    facts, mentions = store.facts(), store["edges"].filter("rel = 'mentions'").select("src", "dst")
    cursor = store.cursor("entity_hub_slow_cursor") or 0
    hubs = graph.cut(hubs_to_review(hub_status(store["nodes"], store["entity_adjudications"]), mentions, facts, cursor))
    changed = changed_facts(store)
    last = hubs.filter("status = 'approved'").orderBy(F.desc("place")).select("id").first()
    basis = changed.select(F.lit("fact").alias("what"), F.col("signature").alias("sig"), F.lit("").alias("state")).unionByName(hubs.select(F.lit("hub").alias("what"), "sig", F.concat_ws("|", "status", "degree", F.array_join("forms", ",")).alias("state")))
    return changed, hubs, review.report_id(basis, ["what", "sig", "state"]), last.id if last else cursor


def aliases(store: Store) -> DataFrame:
    """(sig, label) of every live hub."""
    return store["nodes"].filter("kind = 'entity'").select(F.col("signature").alias("sig"), text.label_of(F.col("signature")).alias("label"))


def salience(facts: DataFrame, pairs: DataFrame, supersedes: DataFrame, cursor: int | None, most: int = SALIENCE_REVIEW) -> DataFrame:
    """(surface, sig, fact, salience_score, superseded_by_new, nearest, cosine, supersedes): candidates for elevation, and salient facts to be judged again.

    ``facts`` is (id, signature, fact, notes, salience_score, dirty_seq, last_reactivated) of
    all facts, ``pairs`` their (src, dst, cosine, rank). Candidates are facts that aren't cold
    or salient, changed since the cursor; those to be judged again are at most ``most``:
    first what a candidate supersedes, then the longest untouched.
    """
    own = facts.filter(not_cold())
    salient = F.coalesce("salience_score", F.lit(0.0)) >= scoring.SALIENT
    new = own.filter(~salient & dirty(cursor))
    texts = facts.select(F.col("signature").alias("dst"), F.col("fact").alias("said"))
    corrected = supersedes.select("src", "dst").distinct().join(texts, "dst").filter("said <> ''")
    w = Window.partitionBy("src").orderBy("dst")
    three = corrected.withColumn("k", F.row_number().over(w)).filter("k <= 3").groupBy(F.col("src").alias("signature")).agg(F.array_sort(F.collect_list(F.struct("k", "said"))).alias("s"))
    near = pairs.filter("rank = 1").join(texts, "dst").select(F.col("src").alias("signature"), F.col("said").alias("nearest"), F.round("cosine", 3).alias("cosine"))
    hit = supersedes.join(new.select(F.col("signature").alias("src")), "src", "left_semi").select(F.col("dst").alias("signature"), F.lit(True).alias("hit")).distinct()
    again = own.filter(salient).join(hit, "signature", "left").orderBy(F.col("hit").isNull(), F.asc_nulls_first("last_reactivated"), "signature").limit(most)
    both = new.select(F.lit("elevate").alias("surface"), "signature", "fact", "salience_score", F.lit(None).cast("boolean").alias("hit")).unionByName(again.select(F.lit("review").alias("surface"), "signature", "fact", "salience_score", "hit"))
    j = both.join(near, "signature", "left").join(three, "signature", "left")
    return j.select("surface", F.col("signature").alias("sig"), "fact", F.round(F.coalesce("salience_score", F.lit(0.0)), 3).alias("salience_score"), F.coalesce("hit", F.lit(False)).alias("superseded_by_new"), "nearest", "cosine", F.transform(F.when(F.col("surface") == "elevate", F.col("s")), lambda x: x["said"]).alias("supersedes"))


def reactivation_pools(store: Store, now: Column, *, most: int = POOLS, members: int = POOL_MEMBERS, archive_days: int = 7) -> DataFrame:
    """(pool, family_key, degree, evidence_seq, sig, evidence_count, archive_eligible): families that came back often enough to be summed up, with their members.

    Families of specific hubs with two or more new pieces of evidence, three or more members
    and two or more of them old enough for the archive; the ``most`` newest, of equals the
    most specific. A member of several pools may be archived through the first alone.
    """
    facts = store.facts()
    mentions = store["edges"].filter("rel = 'mentions'").select("src", "dst")
    degree = graph.hub_degree(mentions).filter(F.col("degree") <= graph.hub_cap(facts.count())).select(F.col("dst").alias("family_key"), "degree")
    pending = upkeep.pending_families(store["reactivation_families"], store["reactivation_reviews"]).join(degree, "family_key")
    free = facts.filter("notes IS NULL OR notes <> 'gist'").join(store["detail_of"].select(F.col("detail_sig").alias("signature")), "signature", "left_anti").select(F.col("signature").alias("member_sig"), "first_seen")
    w = Window.partitionBy("family_key").orderBy(F.desc("evidence_count"), "first_seen", "member_sig")
    own = store["reactivation_members"].select("family_key", "member_sig", "evidence_count").join(pending, "family_key").join(free, "member_sig").withColumn("k", F.row_number().over(w)).filter(F.col("k") <= members)
    own = own.withColumn("old", F.datediff(now, F.col("first_seen")) >= archive_days)
    ripe = own.groupBy("family_key").agg(F.count("*").alias("n"), F.sum(F.col("old").cast("int")).alias("o"), F.max("evidence_seq").alias("s"), F.max("degree").alias("d")).filter("n >= 3 AND o >= 2")
    top = ripe.orderBy(F.desc("s"), "d", "family_key").limit(most)
    top = top.withColumn("pool", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("s"), "d", "family_key")))
    j = own.join(F.broadcast(top.select("family_key", "pool")), "family_key")
    first = review.claim_once(j.filter("old").select("pool", F.col("pool").alias("rank"), F.col("member_sig").alias("member"))).select("pool", F.col("member").alias("member_sig"), F.lit(True).alias("may"))
    found = j.join(first, ["pool", "member_sig"], "left").withColumn("may", F.coalesce("may", F.lit(False)))
    found = found.withColumn("__n", F.sum(F.col("may").cast("int")).over(Window.partitionBy("pool"))).filter("__n >= 2")
    return found.select(F.col("pool").cast("long").alias("pool"), "family_key", F.col("degree").cast("long").alias("degree"), "evidence_seq", F.col("member_sig").alias("sig"), "evidence_count", F.col("may").alias("archive_eligible"))


def merge_report(clusters: DataFrame, facts: DataFrame) -> DataFrame:
    """(cluster, place, member, fact, day, tier, first_day, last_day) of merge clusters (cluster, member), members in the order of their days; ``facts`` is (signature, fact, day, notes)."""
    j = clusters.join(facts.withColumnRenamed("signature", "member"), "member")
    w = Window.partitionBy("cluster")
    place = F.row_number().over(w.orderBy(F.asc_nulls_last("day"), "member")).cast("long")
    return j.select("cluster", place.alias("place"), "member", "fact", "day", F.coalesce("notes", F.lit("active")).alias("tier"), F.min("day").over(w).alias("first_day"), F.max("day").over(w).alias("last_day"))


def reclaimable(clusters: DataFrame) -> DataFrame:
    """(clusters, reclaimable): how many entries merging each cluster (cluster, member) into one would free."""
    each = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    return each.agg(F.count("*").alias("clusters"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("reclaimable"))


def budget(facts: DataFrame, clusters: DataFrame, target: int, most: int) -> DataFrame:
    """One row: what the active facts (class, strength) press on the budget, and what a night and the merges would free."""
    n = F.col("facts")
    pressed = facts.agg(F.count("*").alias("facts")).select("facts", *[c.alias(k) for k, c in scoring.budget(n, target, most).items()])
    weak = facts.groupBy("class", "strength").agg(F.count("*").alias("n")).crossJoin(F.broadcast(pressed)).agg(
        F.coalesce(F.sum(F.when((F.col("class") == "episodic") & (F.col("strength") < F.col("forget_threshold")), F.col("n"))), F.lit(0)).alias("evaporate_episodic"),
        F.coalesce(F.sum(F.when((F.col("class") == "semantic") & (F.col("strength") < F.col("semantic_fade")), F.col("n"))), F.lit(0)).alias("evaporate_semantic"),
    )
    j = pressed.crossJoin(F.broadcast(weak)).crossJoin(F.broadcast(reclaimable(clusters)))
    return j.select(
        "facts", F.lit(target).cast("long").alias("target"), "status", "pressure", F.greatest(F.lit(0), n - target).cast("long").alias("over_target_by"), "forget_threshold", "decay_accel", "merge_sim", "semantic_fade",
        "evaporate_episodic", "evaporate_semantic", F.col("clusters").alias("merge_clusters"), "reclaimable", (n - F.col("evaporate_episodic") - F.col("evaporate_semantic") - F.col("reclaimable")).alias("projected"),
    )


def merge_pool(store: Store, likeness: float, since: int | None = None, k: int = 9) -> DataFrame:
    """(cluster, member) of the active facts alike and of one hub, seeded by those changed after ``since``."""
    facts = store.facts()
    seeds = facts.filter(dirty(since))
    named = facts.select("id", "signature")
    v = store["vectors"].filter("lane = 'active'").select(F.col("id").alias("vec_id"), "embedding").join(named.select(F.col("id").alias("vec_id")), "vec_id")
    near = knn_pairs(v, k, likeness, of=None if since is None else seeds.select(F.col("id").alias("vec_id")))
    hubs = store["edges"].filter("rel = 'mentions'").groupBy(F.col("src").alias("signature")).agg(F.collect_set("dst").alias("h"))
    own = named.join(hubs, "signature")
    j = near.join(own.select(F.col("id").alias("vec_id"), F.col("signature").alias("seed"), F.col("h").alias("a")), "vec_id").join(own.select(F.col("id").alias("neighbour_id"), F.col("signature").alias("member"), F.col("h").alias("b")), "neighbour_id").filter(F.arrays_overlap("a", "b"))
    return review.merge_clusters(j.select("seed", "member"), seeds)


def store_budget(store: Store, tuning: Tuning) -> DataFrame:
    """:func:`budget` of a store under its knobs."""
    facts = store.facts()
    n = facts.count()
    sim = store.spark.range(1).select(scoring.budget(F.lit(n), tuning.target, tuning.most)["merge_sim"].alias("s")).first().s
    return budget(facts, merge_pool(store, sim), tuning.target, tuning.most)


__all__ = ["aliases", "budget", "entities", "merge_report", "reactivation_pools", "reclaimable", "salience", "store_budget"]
