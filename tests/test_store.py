from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from engramix.operators import doctor, graph, ingest, projection, review, upkeep
from engramix.sources import readers, store as stores
from engramix.sources.store import Store

T0 = datetime(2024, 1, 1)


def nodes(spark, rows):
    """rows: (signature, fact, strength, further columns)."""
    base = {"kind": "fact", "class": "episodic", "reactivations": 0, "first_seen": T0, "source_day": T0.date()}
    full = [base | {"signature": s, "fact": f, "strength": w, "id": k} | more for k, (s, f, w, more) in enumerate(rows)]
    schema = spark.createDataFrame([], stores.SCHEMAS["nodes"]).schema
    return spark.createDataFrame([tuple(r.get(c.name) for c in schema) for r in full], schema)


def edges(spark, rows):
    return spark.createDataFrame([(a, r, b, 0.8, T0, T0) for a, r, b in rows], stores.SCHEMAS["edges"])


def test_publish_is_all_or_nothing(spark, tmp_path):
    root = f"file://{tmp_path}"
    assert stores.load(spark, root).tables == {}
    s = Store(spark).having(nodes=nodes(spark, [("a", "x", 0.5, {"memory_id": "1"})]), edges=edges(spark, [("a", "mentions", "b")])).moved(last_weave_seq=3)
    assert stores.publish(s, root, "one", stores.RULES) and not stores.publish(s, root, "one", stores.RULES)
    back = stores.load(spark, root)
    assert back["nodes"].count() == 1 and back.cursor("last_weave_seq") == 3 and back.cursor("none") is None and back["tombstones"].count() == 0
    twice = s.having(edges=edges(spark, [("a", "mentions", "b"), ("a", "mentions", "b")]))
    with pytest.raises(ValueError, match="edges are unique"):
        stores.publish(twice, root, "two", stores.RULES)
    assert stores.load(spark, root)["edges"].count() == 1
    assert stores.publish(s.moved(last_weave_seq=9), root, "three") and stores.load(spark, root).cursor("last_weave_seq") == 9
    with pytest.raises(KeyError):
        s["nothing"]


def test_ingest_actions(spark):
    old = nodes(spark, [("s1", "same", 0.3, {"memory_id": "1", "salience": "fact"}), ("s2", "old text", 0.3, {"memory_id": "2", "salience": "fact", "notes": "archive"}), ("s3", "same", 0.3, {"memory_id": "3", "salience": "fact", "notes": "archive"}), ("s4", "same", 0.3, {"memory_id": "4", "salience": "fact"}), ("s5", "gone", 0.3, {"memory_id": "5"}), ("s6", "detail", 0.3, {"memory_id": "6", "notes": "detail"}), ("s7", "kept", 0.3, {"memory_id": "7", "salience": "fact"})])
    snap = spark.createDataFrame(
        [("1", "same", "fact", None, 0), ("2", "new text", "fact", None, 1), ("3", "same", "fact", None, 2), ("4", "same", "decision", None, 3), ("8", "brand new", "fact", datetime(2023, 5, 1), 4), ("8", "brand newer", "fact", datetime(2023, 5, 2), 5), ("9", "[semantic memory, x] y", "fact", None, 6), ("7", "[semantic memory, x] y", "fact", None, 7), ("10", "I am  the anchor", "fact", None, 8), ("", "no id", "fact", None, 9), (None, "null id", "fact", None, 10)],
        "memory_id string, fact string, category string, created_at timestamp, position long",
    )
    plan = ingest.plan(snap, old, F.lit(T0), "I am the anchor")
    got = {r.memory_id: r.action for r in plan.collect()}
    assert got == {"1": "keep", "2": "update", "3": "revive", "4": "relabel", "8": "insert", "9": "skip", "7": "keep", "10": "anchor"}
    after = {r.memory_id: r for r in ingest.applied(plan, old, 7).collect()}
    assert after["8"].fact == "brand newer" and after["8"].source_day == date(2023, 5, 2) and after["8"]["class"] == "episodic" and after["8"].strength == 0.30 and after["8"].dirty_seq == 7
    assert after["2"].fact == "new text" and after["2"].notes is None and after["3"].notes is None and after["4"].salience == "decision" and after["1"].dirty_seq is None and after["7"].fact == "kept"
    assert {r.memory_id for r in ingest.prune(snap.filter("memory_id <> ''"), old).collect()} == {"5"}
    assert ingest.missing(snap, ingest.applied(plan, old, 7)).count() == 2
    assert ingest.plan(snap.limit(0), old, F.lit(T0)).count() == 0


def test_dates_are_repaired(spark):
    n = nodes(spark, [("a", "seen 2023-05-04", 0.5, {}), ("b", "seen 2025-05-04", 0.5, {}), ("c", "seen 2023-05-04", 0.5, {"notes": "gist"}), ("d", "no date", 0.5, {})])
    got = {r.signature: r.source_day for r in ingest.repaired_dates(n).collect()}
    assert got == {"a": date(2023, 5, 4), "c": None} and {r.signature for r in ingest.repaired_dates(n, True).collect()} == {"a", "b", "c"}


def test_graph(spark):
    e = edges(spark, [("a", "x", "b"), ("b", "x", "c"), ("c", "x", "a"), ("d", "x", "e")])
    seeds = spark.createDataFrame([("a",), ("d",)], "seed string")
    assert {(r.seed, r.signature, r.hops) for r in graph.k_hop(e, seeds, 3).collect()} == {("a", "a", 0), ("a", "b", 1), ("a", "c", 1), ("d", "d", 0), ("d", "e", 1)}
    assert {r.node: r.component for r in graph.components(e).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d"}
    links = spark.createDataFrame([("r", "a"), ("a", "b"), ("b", "r"), ("b", "c")], "parent string, child string")
    assert {(r.node, r.depth) for r in graph.descend(links, spark.createDataFrame([("r",)], "root string"), 5).collect()} == {("r", 0), ("a", 1), ("b", 2), ("c", 3)}
    folded = graph.fold(edges(spark, [("f", "m", "x"), ("f", "m", "y"), ("x", "m", "y")]), spark.createDataFrame([("y", "x")], "alias string, canonical string"))
    assert [(r.src, r.dst) for r in folded.collect()] == [("f", "x")]
    n = nodes(spark, [("a", "x", 1.0, {}), ("b", "x", 1.0, {})])
    v = spark.createDataFrame([(0, "active", [1.0]), (77, "active", [1.0])], stores.SCHEMAS["vectors"])
    kept, alive, hubs, missing = graph.repair(n, edges(spark, [("a", "mentions", "hub"), ("a", "similar_to", "gone"), ("b", "similar_to", "a")]), v)
    assert kept.count() == 2 and alive.count() == 1 and [r.signature for r in hubs.collect()] == ["hub"] and [r.signature for r in missing.collect()] == ["b"]


def test_numbered_is_total_whatever_the_parts(spark):
    df = spark.range(1000).withColumn("v", F.pmod(F.xxhash64("id"), F.lit(7))).repartition(9)
    got = {r.id: r.place for r in graph.numbered(df, ["v", F.desc("id")]).collect()}
    want = sorted(((r.v, -r.id) for r in df.collect()))
    assert [got[-i] for _, i in want] == list(range(1, 1001)) and graph.numbered(df.limit(0), ["v", "id"]).count() == 0


def test_reactivation_skips_general_hubs(spark):
    m = spark.createDataFrame([("new", "rare"), ("old", "rare"), ("new", "all"), ("old", "all"), *[(f"f{k}", "all") for k in range(30)]], "src string, dst string")
    t, ev = upkeep.reactivate(spark.createDataFrame([("new", 5)], "signature string, seq long"), m, 8)
    assert [(r.signature, r.triggers) for r in t.collect()] == [("old", 1)] and [(r.hub, r.cues, r.seq) for r in ev.collect()] == [("rare", 1, 5)]


def test_what_leaves_the_active_set(spark):
    n = nodes(spark, [("weak", "x", 0.01, {}), ("kept", "x", 0.01, {}), ("gist", "x", 0.02, {"notes": "gist"}), ("salient", "x", 0.0, {"salience_score": 0.9}), ("detail", "x", 0.9, {"notes": "detail"}), ("strong", "x", 0.9, {})])
    safe = spark.createDataFrame([("kept",)], "signature string")
    assert {r.signature for r in upkeep.evaporating(n, safe, 0.15, 0.0).collect()} == {"weak", "gist", "salient"}
    assert {r.signature: r["pass"] for r in upkeep.demoting(n, safe, 2).collect()} == {"detail": 1, "weak": 1, "strong": 1, "gist": 2}
    assert {r.signature for r in upkeep.over_cap(n, safe, 4).collect()} == {"weak", "gist"} and upkeep.over_cap(n, safe, 6).count() == 0


def test_merge_faults_and_report_ids(spark):
    d = spark.createDataFrame([(1, "a", "atemporal"), (2, "x", "wrong"), (3, "c", None)], "decision int, survivor string, form string")
    m = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "zz"), (3, "c")], "decision int, member string")
    c = spark.createDataFrame([("k", "a"), ("k", "b"), ("k", "c")], "cluster string, member string")
    live = spark.createDataFrame([("a",), ("b",), ("c",)], "signature string")
    got = {(r.decision, r.reason) for r in review.merge_faults(d, m, c, live).collect()}
    assert got == {(2, "invalid_temporal_form"), (2, "stale_member"), (2, "cross_cluster"), (2, "malformed_decision"), (3, "insufficient_members"), (2, "overlapping_decisions"), (3, "overlapping_decisions")}
    assert review.report_id(m, ["decision", "member"]) == review.report_id(m.orderBy(F.desc("member")).repartition(3), ["decision", "member"]) != review.report_id(m.limit(4), ["decision", "member"])


def test_the_doctor_finds_each_fault(spark):
    n = nodes(spark, [("a", "x", 1.0, {"memory_id": "1"}), ("b", "x", 1.0, {"memory_id": "1"}), ("g", "x", 1.0, {"notes": "gist"}), ("c1", "x", 1.0, {"kind": "chronicle", "notes": "chronicle"}), ("c2", "x", 1.0, {"kind": "chronicle", "notes": "chronicle"}), ("c0", "x", 1.0, {"kind": "chronicle", "notes": "archive"}), ("z", "x", 1.0, {"source_day": date(2020, 1, 1)})])
    ids = {r.signature: r.id for r in n.collect()}
    v = spark.createDataFrame([(ids["a"], "active", [1.0, 0.0]), (ids["a"], "archive", [1.0, 0.0]), (999, "active", [1.0]), (998, "archive", [1.0, 0.0]), (ids["c0"], "chron", [1.0, 0.0])], stores.SCHEMAS["vectors"])
    day = date(2024, 1, 1)
    ch = lambda sig, ver, n_: (sig, "day", day, day, ver, 1, n_, 0, day, 1, T0)
    s = Store(spark).having(
        nodes=n, vectors=v, edges=edges(spark, [("a", "m", "b"), ("a", "m", "b"), ("a", "m", "gone")]),
        reactivation_examples=spark.createDataFrame([("f", f"n{k}", "o", k, T0) for k in range(41)], stores.SCHEMAS["reactivation_examples"]),
        gist_landmarks=spark.createDataFrame([("g", "change", 0, "gone")], stores.SCHEMAS["gist_landmarks"]),
        evidence_transitions=spark.createDataFrame([("a", "sequence", "a", T0, T0)], stores.SCHEMAS["evidence_transitions"]),
        chronicles=spark.createDataFrame([ch("c1", 1, 5), ch("c2", 2, 1)], stores.SCHEMAS["chronicles"]),
        chronicle_entries=spark.createDataFrame([("c1", 0, "s", "t", "none", None, None), ("c2", 0, "s", "t", "none", None, None)], stores.SCHEMAS["chronicle_entries"]),
        chronicle_evidence=spark.createDataFrame([("c1", 0, "z"), ("c2", 0, "lost")], stores.SCHEMAS["chronicle_evidence"]),
        chronicle_entry_entities=spark.createDataFrame([("c1", 0, "nobody")], stores.SCHEMAS["chronicle_entry_entities"]),
    )
    got = {r.invariant: r.faults for r in doctor.audit(s, 2).collect()}
    assert got == {
        "fact_islands": 2, "dangling_edges": 1, "facts_without_vector": 3, "active_facts_in_archive": 1, "orphan_active_vectors": 1, "orphan_archive_vectors": 1, "bad_vector_dimensions": 1, "duplicate_edges": 1, "duplicate_memory_ids": 1,
        "example_overflow": 1, "dangling_landmarks": 1, "invalid_transitions": 1, "dangling_chronicle_evidence": 1, "dangling_chronicle_entities": 1, "invalid_chronicle_metadata": 1, "incomplete_coverage": 1, "derived_without_evidence": 1,
        "out_of_period_evidence": 1, "stale_active_versions": 1, "chronicle_main_lanes": 3, "chronicle_own_lanes": 4,
    }
    with pytest.raises(ValueError, match="damaged"):
        doctor.gate(s, 2)
    assert {r.faults for r in doctor.audit(Store(spark), 2).collect()} == {0}


def test_projection(spark):
    n = nodes(spark, [("g", "gist text", 0.5, {"notes": "gist", "memory_id": "g"}), ("e1", "first", 0.5, {"memory_id": "e1", "first_seen": datetime(2024, 1, 2)}), ("e0", "before", 0.5, {"memory_id": "e0", "salience": "decision"}), ("d", "x", 0.9, {"notes": "detail"}), ("o", "x", 0.9, {"notes": "archive"})])
    c = spark.createDataFrame([(f"c{k}", "week", date(2024, 1, 1), date(2024, 1, 7), k, f"week v{k}") for k in (1, 2)] + [("d1", "day", date(2024, 1, 1), date(2024, 1, 1), 1, "day")], "node_sig string, resolution string, period_start date, period_end date, version long, fact string")
    got = [(r.memory_id, r.fact, r.category) for r in projection.project(n.filter("kind = 'fact'"), c, F.lit(datetime(2024, 2, 10)), "I am the anchor").orderBy("ord").collect()]
    assert got == [(None, "I am the anchor", "anchor"), ("g", "gist text", "episodic"), ("c2", "week v2", "chronicle"), ("e0", "[last month or so] before", "decision"), ("e1", "[last month or so] first", "episodic")]
    small = projection.project(n.filter("kind = 'fact'"), c, F.lit(datetime(2024, 2, 10)), "A", slots=3).collect()
    assert len(small) == 3 and [r.memory_id for r in small][-1] == "e1"
    a, links = projection.view(n, edges(spark, [("g", "x", "e1"), ("g", "x", "o")]))
    assert a.count() == 4 and links.count() == 1 and projection.dump(n).count() == 4 and projection.dump(n, True).count() == 5
    p = spark.createDataFrame([("d", "day", date(2024, 1, 2), date(2024, 1, 2)), ("w", "week", date(2024, 1, 1), date(2024, 1, 7)), ("y", "year", date(2024, 1, 1), date(2024, 12, 31))], "node_sig string, resolution string, period_start date, period_end date")
    assert {(r.fine_id, r.coarse_id) for r in projection.period_links(p).collect()} == {("d", "w"), ("w", "y")}


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": "1", "fact": "x", "category": "fact", "createdAt": "2024-05-01T10:00:00Z"}, {"memory_id": "2", "fact": "y", "created_at": "never"}]')
    (tmp_path / "b.json").write_text(' {"memories": [{"id": "3", "fact": "z", "first_seen": "2024-05-02"}]}')
    a = readers.read_snapshot(spark, f"file://{tmp_path}/a.json").orderBy("position").collect()
    assert [(r.memory_id, r.fact, r.position) for r in a] == [("1", "x", 0), ("2", "y", 1)] and str(a[0].created_at) == "2024-05-01 10:00:00" and a[1].created_at is None
    assert [r.memory_id for r in readers.read_snapshot(spark, f"file://{tmp_path}/b.json").collect()] == ["3"]
    (tmp_path / "d.json").write_text('[{"decision": 1, "survivor": "a"}]')
    (tmp_path / "bad.json").write_text('[{"decision": ')
    assert readers.read_decisions(spark, f"file://{tmp_path}/d.json", "decision int, survivor string").count() == 1
    with pytest.raises(ValueError):
        readers.read_decisions(spark, f"file://{tmp_path}/bad.json", "decision int, survivor string")
    days = tmp_path / "days"
    days.mkdir()
    (days / "2024-05-01.md").write_text("# Head\n> quote\n- **Plan:** we agreed to use the small plan\n2. short\n\n" + "This is a sentence of some length. " * 8 + "\n")
    got = readers.day_facts(spark, f"file://{days}").collect()
    assert len(got) == 9 and got[0].day == "2024-05-01" and {(r.fact, r.category) for r in got} == {("we agreed to use the small plan", "decision"), ("This is a sentence of some length.", "fact")}
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "2024-05-02.yaml").write_text("- tool: memorySave\n  session: s1\n  fact: \"keep this\"\n- tool: other\n  fact: not this\n- tool: memorySave\n  fact: no\n")
    assert [(r.day, r.fact) for r in readers.tool_facts(spark, f"file://{tmp_path}/t").collect()] == [("2024-05-02", "[s1] keep this")]
