"""The audit: 21 counters that must be zero, each one aggregate, and one signal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..functions.vector import pair_sums
from ..sources.store import Store, active
from .graph import dangling, degree
from .periods import latest


def _lane(s: Store, *lanes: str) -> DataFrame:
    return s["vectors"].filter(F.col("lane").isin(*lanes)).select("id")


def _anti(a: DataFrame, b: DataFrame, on: str, to: str | None = None) -> DataFrame:
    return a.join(b.select(F.col(to or on).alias(on)).distinct(), on, "left_anti")


def _more_than_one(df: DataFrame, *keys) -> DataFrame:
    return df.groupBy(*keys).count().filter("count > 1").select(F.explode(F.sequence(F.lit(2), F.col("count"))))


def _chron(s: Store, archived: bool) -> DataFrame:
    note = F.coalesce(F.col("notes") == "archive", F.lit(False))
    return s["nodes"].filter((F.col("kind") == "chronicle") & (note == F.lit(archived))).select("id", "signature")


def _gists(s: Store) -> DataFrame:
    return s["nodes"].filter(F.col("notes").rlike(r"\bgist\b") & (F.col("kind") == "fact")).select("signature")


def _stale(s: Store) -> DataFrame:
    keys = ["resolution", "period_start", "period_end"]
    top = s["chronicles"].groupBy(*keys).agg(F.max("version").alias("top"))
    live = s["chronicles"].join(_chron(s, False).select(F.col("signature").alias("node_sig")), "node_sig", "left_semi")
    return live.join(top, keys).filter("version < top")


def _outside(s: Store) -> DataFrame:
    day = F.coalesce(F.col("source_day"), F.col("first_seen").cast("date"))
    n = s["nodes"].filter("kind = 'fact'").select(F.col("signature").alias("evidence_sig"), day.alias("day"))
    c = s["chronicles"].select(F.col("node_sig").alias("chronicle_sig"), "period_start", "period_end")
    return s["chronicle_evidence"].join(n, "evidence_sig").join(c, "chronicle_sig").filter("day < period_start OR day > period_end").select("chronicle_sig", "evidence_sig").distinct()


def _coverage(s: Store) -> DataFrame:
    e = s["chronicle_evidence"].groupBy(F.col("chronicle_sig").alias("node_sig")).agg(F.countDistinct("evidence_sig").alias("n"))
    return s["chronicles"].join(e, "node_sig", "left").filter("coalesce(n, 0) <> coalesce(covered_event_count, 0)")


def _lanes(s: Store, own: str, other: str, archived: bool) -> DataFrame:
    """Chronicles that are missing from their lane or stand in the other one."""
    ids = _chron(s, archived).select("id")
    return _anti(ids, _lane(s, own), "id").unionByName(ids.join(_lane(s, other), "id", "left_semi"))


def _metadata(s: Store) -> DataFrame:
    n = s["nodes"].filter("kind = 'chronicle'").select(F.col("signature").alias("sig"))
    c = s["chronicles"].select(F.col("node_sig").alias("sig"))
    e = s["chronicle_entries"].select(F.col("chronicle_sig").alias("sig")).distinct()
    return _anti(n, c, "sig").unionByName(_anti(c, n, "sig")).unionByName(_anti(c, e, "sig"))


INVARIANTS: dict[str, Callable[[Store, int], DataFrame]] = {
    "fact_islands": lambda s, d: _anti(s.facts().select("signature"), degree(s["edges"]), "signature"),
    "dangling_edges": lambda s, d: dangling(s["edges"].select("src", "rel", "dst"), s["nodes"]),
    "facts_without_vector": lambda s, d: _anti(s.facts().select("id"), _lane(s, "active"), "id"),
    "active_facts_in_archive": lambda s, d: s.facts().select("id").join(_lane(s, "archive"), "id", "left_semi"),
    "orphan_active_vectors": lambda s, d: _anti(_lane(s, "active"), s["nodes"], "id"),
    "orphan_archive_vectors": lambda s, d: _anti(_lane(s, "archive"), s["nodes"], "id"),
    "bad_vector_dimensions": lambda s, d: s["vectors"].filter(F.size("embedding") != d),
    "duplicate_edges": lambda s, d: _more_than_one(s["edges"], "src", F.coalesce("rel", F.lit("")), "dst"),
    "duplicate_memory_ids": lambda s, d: _more_than_one(s["nodes"].filter("memory_id <> ''"), "memory_id"),
    "example_overflow": lambda s, d: s["reactivation_examples"].groupBy("family_key").count().filter("count > 40"),
    "dangling_landmarks": lambda s, d: _anti(s["gist_landmarks"].select("gist_sig", "evidence_sig"), s["nodes"], "gist_sig", "signature").unionByName(_anti(s["gist_landmarks"].select("gist_sig", "evidence_sig"), s["nodes"], "evidence_sig", "signature").select("gist_sig", "evidence_sig")).distinct(),
    "invalid_transitions": lambda s, d: s["evidence_transitions"].filter("src_sig = dst_sig").select("src_sig", "dst_sig").unionByName(_anti(s["evidence_transitions"], s["nodes"], "src_sig", "signature").select("src_sig", "dst_sig")).unionByName(_anti(s["evidence_transitions"], s["nodes"], "dst_sig", "signature").select("src_sig", "dst_sig")).distinct(),
    "dangling_chronicle_evidence": lambda s, d: _anti(s["chronicle_evidence"], s["nodes"], "evidence_sig", "signature").select("chronicle_sig", "evidence_sig").unionByName(_anti(s["chronicle_evidence"], s["chronicles"], "chronicle_sig", "node_sig").select("chronicle_sig", "evidence_sig")).distinct(),
    "dangling_chronicle_entities": lambda s, d: _anti(s["chronicle_entry_entities"], s["nodes"], "entity_sig", "signature"),
    "invalid_chronicle_metadata": lambda s, d: _metadata(s),
    "incomplete_coverage": lambda s, d: _coverage(s),
    "derived_without_evidence": lambda s, d: _anti(_gists(s), s["detail_of"], "signature", "gist_sig").unionByName(_anti(_chron(s, False).select("signature"), s["chronicle_evidence"], "signature", "chronicle_sig")),
    "out_of_period_evidence": lambda s, d: _outside(s),
    "stale_active_versions": lambda s, d: _stale(s),
    "chronicle_main_lanes": lambda s, d: _lanes(s, "active", "archive", False).unionByName(_lanes(s, "archive", "active", True)),
    "chronicle_own_lanes": lambda s, d: _lanes(s, "chron", "chron_archive", False).unionByName(_lanes(s, "chron_archive", "chron", True)),
}


def audit(store: Store, dimensions: int, only: tuple[str, ...] | None = None) -> DataFrame:
    """(invariant, faults) of each counter, in one query."""
    out = None
    for name in only or INVARIANTS:
        one = INVARIANTS[name](store, dimensions).agg(F.count("*").alias("faults")).select(F.lit(name).alias("invariant"), "faults")
        out = one if out is None else out.unionByName(one)
    return out


def gate(store: Store, dimensions: int) -> None:
    """Raise if any counter isn't zero."""
    bad = audit(store, dimensions).filter("faults > 0").collect()
    if bad:
        raise ValueError("the store is damaged: " + ", ".join(f"{r.invariant} {r.faults}" for r in bad))


def pairwise(vectors: DataFrame, collapsed_above: float = 0.9) -> DataFrame:
    """(grp, pairs, mean, collapsed) over all pairs of a group; ``vectors`` is (grp, id, embedding).

    Every pair is counted, as products of blocks: a task has a block of one group's rows and
    reads that group from the shared folder slab by slab, so that its memory doesn't grow.
    """
    found = pair_sums(vectors, collapsed_above).filter("pairs > 0")
    return found.select("grp", "pairs", F.round(F.col("total") / F.col("pairs"), 6).alias("mean"), "collapsed")


def chronicle_dispersion(store: Store, newest: int = 60) -> DataFrame:
    """The signal over the newest day chronicles; no row for fewer than three."""
    days = latest(store["chronicles"].filter("resolution = 'day'"), ["period_start"], [F.desc("version")]).orderBy(F.desc("period_end")).limit(newest)
    v = days.join(store["nodes"].select(F.col("signature").alias("node_sig"), "id"), "node_sig").join(store["vectors"].filter("lane = 'chron'").select("id", "embedding"), "id")
    return pairwise(v.select(F.lit(1).alias("grp"), "id", "embedding")).filter("pairs >= 3")


def stats(store: Store) -> DataFrame:
    """(what, n): nodes by kind, edges and tombstones."""
    n = store["nodes"].groupBy(F.concat(F.lit("nodes:"), "kind").alias("what")).agg(F.count("*").alias("n"))
    count = lambda t: store[t].agg(F.count("*").alias("n")).select(F.lit(t).alias("what"), "n")
    return n.unionByName(count("edges")).unionByName(count("tombstones"))


def active_count(store: Store) -> int:
    return store["nodes"].filter(active()).count()
