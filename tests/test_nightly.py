from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from engramix.operators import chronicles, doctor, nightly, review
from engramix.sources import store as stores
from engramix.sources.store import Store
from engramix.sources.tuning import Tuning
from engramix.streaming import runs

from .test_store import T0, edges, nodes

NOW = datetime(2024, 7, 1)


def small(spark):
    n = nodes(spark, [("f0", "the pump in hall one failed", 0.5, {"dirty_seq": 1}), ("f1", "the pump in hall two failed", 0.5, {"dirty_seq": 1}), ("f2", "the pump was replaced", 0.3, {"dirty_seq": 2}), ("f3", "lunch is at noon", 0.2, {"dirty_seq": 1}), ("topic:pump", None, 0.5, {"kind": "entity"})])
    v = [(k, "active", x) for k, x in enumerate(([1.0, 0.0], [0.9, 0.44], [0.8, 0.6], [0.0, 1.0]))]
    return Store(spark).having(nodes=n, vectors=spark.createDataFrame(v, stores.SCHEMAS["vectors"]))


def test_a_night_leaves_no_island_and_is_sound(spark):
    s = nightly.woven(small(spark), 2)
    e = {(r.src, r.rel, r.dst) for r in s["edges"].collect()}
    assert {("f0", "mentions", "topic:pump"), ("f1", "mentions", "topic:pump"), ("f2", "mentions", "topic:pump")} <= e and any("f3" in (a, b) for a, _, b in e)
    again = nightly.woven(s, 3)
    assert {(r.src, r.rel, r.dst) for r in again["edges"].collect()} == e
    after, summary = nightly.kept_up(s, NOW, 2, Tuning.resolve({}, {}))
    assert {r.what: r.n for r in summary.collect()} == {"facts": 4, "reactivated": 0, "ready for review": 0, "gone": 0, "demoted": 0, "hubs pruned": 0, "chronicles demoted": 0, "active": 4, "archived": 0}
    assert after.cursor("last_dream_seq") == 2
    faults = {r.invariant: r.faults for r in doctor.audit(after, 2).collect()}
    assert not any(faults.values())
    # the next night only one fact is new: it brings back the others of its hub, once each
    later = after.having(nodes=after["nodes"].withColumn("dirty_seq", F.when(F.col("signature") == "f2", 5).otherwise(F.col("dirty_seq"))))
    third, summary = nightly.kept_up(later, NOW + timedelta(days=1), 5, Tuning.resolve({}, {}))
    assert {r.what: r.n for r in summary.collect()}["reactivated"] == 2
    assert {r.signature: r.reactivations for r in third.facts().collect()} == {"f0": 1, "f1": 1, "f2": 0, "f3": 0}


def test_prune_and_preserve(spark):
    s = nightly.woven(small(spark), 2).moved(last_dream_seq=2)
    tight = Tuning(2, 3, 2, 1.0, True, True)
    kept, summary = nightly.kept_up(s, NOW, 3, tight)
    assert kept["nodes"].filter("kind = 'fact'").count() == 4 and kept.facts().count() == 2
    moved = {r.lane: r.n for r in kept["vectors"].groupBy("lane").agg(F.count("*").alias("n")).collect()}
    assert moved == {"active": 2, "archive": 2}
    before = {r.id: r.embedding for r in s["vectors"].collect()}
    assert {r.id: r.embedding for r in kept["vectors"].collect()} == before
    pruned, _ = nightly.kept_up(s, NOW, 3, Tuning(2, 3, 2, 1.0, False, True))
    assert pruned.facts().count() == 0 and pruned["tombstones"].count() == 4 and pruned["edges"].count() == 0


def test_merges_lose_nothing(spark):
    s = small(spark).having(edges=edges(spark, [("f0", "mentions", "topic:pump"), ("f1", "mentions", "topic:hall")]))
    d = spark.createDataFrame([(1, "f0", "recurring", "pumps fail in halls")], "decision int, survivor string, form string, fact string")
    m = spark.createDataFrame([(1, "f0"), (1, "f1")], "decision int, member string")
    c = spark.createDataFrame([("k", "f0"), ("k", "f1")], "cluster string, member string")
    out = nightly.apply_merges(s, d, m, c, NOW)
    got = {r.signature: r for r in out["nodes"].collect()}
    assert got["f0"].notes == "gist" and got["f0"].fact == "pumps fail in halls" and got["f0"].strength == pytest.approx(0.55) and got["f0"].source_day is None and got["f0"].temporal_form == "recurring"
    assert got["f0~original"].fact == "the pump in hall one failed" and got["f0~original"].notes == "detail" and got["f1"].notes == "detail"
    assert {(r.detail_sig, r.gist_sig) for r in out["detail_of"].collect()} == {("f1", "f0"), ("f0~original", "f0")}
    assert ("f0", "topic:hall") in {(r.src, r.dst) for r in out["edges"].collect()}
    with pytest.raises(ValueError, match="cross_cluster"):
        nightly.apply_merges(s, d, m.unionByName(spark.createDataFrame([(1, "f3")], "decision int, member string")), c, NOW)


def test_synthesis_moves_members_to_the_archive(spark):
    s = small(spark).having(edges=edges(spark, [("f0", "mentions", "topic:pump"), ("f3", "mentions", "topic:pump")]))
    good = spark.createDataFrame([("c1", "pumps wear out"), ("c2", "too small")], "concept string, fact string")
    m = spark.createDataFrame([("c1", "f0"), ("c1", "f1"), ("c1", "f2"), ("c2", "f3")], "concept string, member string")
    out = nightly.apply_synthesis(s, good, m, NOW)
    got = {r.signature: r.notes for r in out["nodes"].collect()}
    assert got["c1"] == "gist" and got["f0"] == got["f1"] == got["f2"] == "archive" and got["f3"] is None and "c2" not in got
    assert out["detail_of"].count() == 3 and {r.lane for r in out["vectors"].filter("id < 3").collect()} == {"archive"} and out["edges"].count() == 1


def test_chronicles_are_versioned(spark):
    day = date(2024, 1, 1)
    new = lambda sig: spark.createDataFrame([(sig, "day", day, day, "a day")], "node_sig string, resolution string, period_start date, period_end date, fact string")
    ev = lambda sig: spark.createDataFrame([(sig, 0, "f0"), (sig, 0, "f1")], stores.SCHEMAS["chronicle_evidence"])
    en = lambda sig: spark.createDataFrame([(sig, 0, "slot", "text", "none", None, None)], stores.SCHEMAS["chronicle_entries"])
    one = nightly.apply_chronicles(small(spark), new("c1"), en("c1"), ev("c1"), NOW)
    two = nightly.apply_chronicles(one, new("c2"), en("c2"), ev("c2"), NOW)
    assert {r.node_sig: r.version for r in two["chronicles"].collect()} == {"c1": 1, "c2": 2}
    assert {r.signature: r.notes for r in two["nodes"].filter("kind = 'chronicle'").collect()} == {"c1": "archive", "c2": "chronicle"}
    assert two["nodes"].filter("signature = 'c2'").first().strength == 0.5
    e = spark.createDataFrame([(day, 1), (day, 2), (date(2024, 1, 9), 3)], "day date, seq long")
    found = chronicles.candidates(e, F.lit(date(2024, 1, 10)).cast("date"))
    assert {(r.resolution, str(r.period_start), r.members, r.coverage_seq) for r in found.collect()} == {("day", "2024-01-01", 2, 2), ("day", "2024-01-09", 1, 3), ("week", "2024-01-01", 2, 2)}
    assert [r.resolution for r in chronicles.due(found).collect()] == ["day", "week", "day"]
    p = lambda rows, cols: spark.createDataFrame(rows, cols)
    bad = chronicles.faults(p([(1, 0, "odd", "s", "t"), (1, 1, "none", "", "t")], "period int, ordinal int, change_kind string, slot_label string, summary string"), p([(1, "x")], "period int, evidence_sig string"), p([(1, "a")], "period int, evidence_sig string"), p([(1, "h")], "period int, entity_sig string"), p([(1, "i")], "period int, entity_sig string"))
    assert {r.reason for r in bad.collect()} == {"invalid_change_kind", "invalid_text", "evidence_outside_period", "incomplete_coverage", "entity_outside_period"}


def test_entity_reviews(spark):
    s = small(spark).having(edges=edges(spark, [("f0", "mentions", "topic:pump"), ("f0", "similar_to", "f1"), ("f3", "similar_to", "f2")]))
    rev = lambda action, to: spark.createDataFrame([("topic:pump", action, to, "r1")], "sig string, action string, retyped_to string, report_id string")
    out = nightly.apply_entities(s, rev("retype", "system"), 9, NOW)
    assert {r.signature for r in out["nodes"].filter("kind = 'entity'").collect()} == {"system:pump"}
    assert {(r.src, r.dst) for r in out["edges"].collect()} == {("f3", "f2")} and out["nodes"].filter("signature = 'f0'").first().dirty_seq == 9
    assert out["entity_adjudications"].first().status == "approved"
    for action, to in (("burn", None), ("retype", "animal"), ("retype", None)):
        with pytest.raises(ValueError):
            nightly.apply_entities(s, rev(action, to), 9, NOW)


def test_salience(spark):
    scores = spark.createDataFrame([(f"s{k}", k / 20) for k in range(20)] + [("s1", 0.99)], "sig string, score double")
    assert [r.sig for r in review.salience_caps(scores, 20, 100, 12).orderBy(F.desc("score")).collect()] == ["s1", "s19", "s18"]
    raised = spark.createDataFrame([("a", T0)], "src string, at timestamp")
    weak = spark.createDataFrame([(f"w{k}", T0 + timedelta(hours=5 * k), 0.3 + 0.01 * k) for k in range(8)], "dst string, at timestamp, strength double")
    near = spark.createDataFrame([("a", f"w{k}", 0.6 + 0.01 * k) for k in range(8)], "src string, dst string, cosine double")
    got = {r.dst: r.strength for r in review.spotlight(raised, weak, near, spark.createDataFrame([("a", "w1")], "src string, dst string")).collect()}
    assert set(got) == {"w0", "w2", "w3", "w4"} and got["w0"] == pytest.approx(0.42) and got["w4"] == pytest.approx(0.45)


def test_streams(spark, tmp_path):
    def batch(rows, k):
        spark.createDataFrame(rows, "user_id long, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")

    batch([(1, datetime(2024, 1, 1)), (1, datetime(2024, 1, 4)), (2, datetime(2024, 1, 5))], 0)
    read = lambda: spark.readStream.schema("user_id long, ts timestamp").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    folder = f"file://{tmp_path}/out"
    step = lambda b, n: runs.period_counts(b, F.col("ts"), ("day", "month"))
    runs.incremental(read(), step, folder)
    batch([(1, datetime(2023, 12, 31)), (2, datetime(2024, 1, 5))], 1)
    parts = runs.incremental(read(), step, folder)
    got = {(r.resolution, str(r.period_start)): r.n for r in runs.added_up(parts).collect()}
    assert got == {("day", "2024-01-01"): 1, ("day", "2024-01-04"): 1, ("day", "2024-01-05"): 2, ("day", "2023-12-31"): 1, ("month", "2024-01-01"): 4, ("month", "2023-12-01"): 1}
    again = runs.incremental(read(), step, folder)
    assert again.count() == parts.count()
    out = []
    q = runs.strengths(read()).writeStream.outputMode("update").foreachBatch(lambda b, n: out.extend((n, r.user_id, r.strength, r.cues) for r in b.collect())).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    last = {u: (s, c) for _, u, s, c in sorted(out)}
    assert last[2] == (pytest.approx(0.2), 2) and last[1] == (pytest.approx(0.1 * 0.5 + 0.1 + 0.1), 3)


def test_strengths_end_and_forget(spark, tmp_path):
    for k, user in enumerate((1, 2, 2, 1)):
        spark.createDataFrame([(user, datetime(2024, 1, 1 + k))], "user_id long, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")

    def cues(ttl_days):
        out = []
        stream = spark.readStream.schema("user_id long, ts timestamp").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = runs.strengths(stream, ttl_days=ttl_days).writeStream.outputMode("update").foreachBatch(lambda b, n: out.extend((n, r.user_id, r.cues) for r in b.collect())).option("checkpointLocation", f"{tmp_path}/state-{ttl_days}").trigger(availableNow=True).start()
        try:
            assert q.awaitTermination(120)
        finally:
            q.stop()
        return {u: c for _, u, c in sorted(out)}

    # all that is there is counted, and the run ends by itself
    assert cues(60.0) == {1: 2, 2: 2}
    # a key whose time ran out while others had cues begins anew
    assert cues(1e-8) == {1: 1, 2: 2}


def test_batches_publish_versions(spark, tmp_path):
    spark.createDataFrame([("a", "x"), ("b", "y")], "memory_id string, fact string").coalesce(1).write.parquet(f"{tmp_path}/in/0")
    read = lambda: spark.readStream.schema("memory_id string, fact string").option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")

    def apply(s, b, seq):
        new = b.select("memory_id", "fact", F.concat(F.lit("f:"), "memory_id").alias("signature"), F.lit("fact").alias("kind"), F.lit(seq).alias("dirty_seq"))
        return s.having(nodes=s["nodes"].unionByName(new, allowMissingColumns=True)).moved(last_weave_seq=seq)

    root = f"file://{tmp_path}/store"
    one = runs.publish_batches(read(), root, apply, f"file://{tmp_path}/c1")
    assert one["nodes"].count() == 2 and one.cursor("last_weave_seq") == 1
    # the same batches under a lost checkpoint: their runs are known, nothing is added
    assert runs.publish_batches(read(), root, apply, f"file://{tmp_path}/c2")["nodes"].count() == 2
