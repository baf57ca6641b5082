from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from engramix.operators import recall, weave
from engramix.sources import store as stores
from engramix.sources.store import Store

from .test_store import T0, edges, nodes


def lane(spark, rows):
    return spark.createDataFrame(rows, stores.SCHEMAS["vectors"])


def unit(a):
    return [a, (1 - a * a) ** 0.5]


def ask(words, **more):
    return recall.Question(words, (1.0, 0.0), date(2024, 7, 1), **more)


def test_questions_are_clamped():
    q = ask("x", hops=9, seeds=0, k=1, nodes=1000)
    assert (q.hops, q.seeds, q.k, q.nodes) == (3, 4, 4, 200) and ask("x", k=99).k == 50


def test_corrections_come_first_unless_history_is_asked(spark):
    n = nodes(spark, [("old", "price is five", 0.6, {}), ("new", "price is seven", 0.78, {}), ("noise", "weather", 0.5, {})])
    v = lane(spark, [(0, "active", unit(0.90)), (1, "active", unit(0.86)), (2, "active", unit(0.1))])
    s = Store(spark).having(nodes=n, vectors=v, edges=edges(spark, [("new", "supersedes", "old")]))
    rep = recall.successors(s["edges"], s["evidence_transitions"])
    seeds = lambda q: [r.signature for r in recall.vector_seeds(s.facts(), recall.cosine_to(s["vectors"], q, "active"), rep, q).orderBy("rank").collect()]
    assert seeds(ask("the price"))[:2] == ["new", "old"]
    found = {r.signature: r for r in recall.recall(s, ask("the price")).collect()}
    assert found["old"].superseded_by == "new" and found["new"].place < found["old"].place
    n2 = n.withColumn("strength", F.lit(0.5))
    old_first = recall.vector_seeds(s.having(nodes=n2).facts(), recall.cosine_to(s["vectors"], ask("x"), "active"), rep, ask("the price as of then")).orderBy("rank").first().signature
    assert old_first == "old"


def test_strong_facts_win_close_races(spark):
    rows = [(0.72, 0.02), (0.71, 0.01), (0.70, 0.01), (0.69, 0.01), (0.64, 0.95), (0.25, 1.0)]
    n = nodes(spark, [(f"f{k}", f"text {k}", s, {}) for k, (_, s) in enumerate(rows)])
    v = lane(spark, [(k, "active", unit(c)) for k, (c, _) in enumerate(rows)])
    q = ask("text")
    none = spark.createDataFrame([], "signature string, successor string")
    got = [r.signature for r in recall.vector_seeds(n, recall.cosine_to(v, q, "active"), none, q).collect()]
    assert "f4" in got and "f5" not in got


def test_lexical_seeds_are_additive(spark):
    n = nodes(spark, [(f"r{k}", f"standup notes {k}", 0.5, {}) for k in range(20)] + [("d", "zanzibar ferry timetable", 0.1, {})])
    seeds = spark.createDataFrame([("r1",), ("r2",)], "signature string")
    assert [r.signature for r in recall.lexical_seeds(n, seeds, ["zanzibar", "ferry", "cost"]).collect()] == ["d"]
    assert recall.lexical_seeds(n, seeds, ["zanzibar"]).count() == 0


def test_whole_sequences_come_back(spark):
    n = nodes(spark, [(f"s{k}", f"the harbour bridge repair reached phase number {k}", 0.5, {}) for k in range(5)] + [("other", "something unrelated entirely", 0.5, {})])
    e = edges(spark, [(f"s{k}", "sequence", f"s{k + 1}") for k in range(4)] + [("s4", "sequence", "other")])
    v = lane(spark, [(k, "active", unit(0.9 if k == 0 else 0.0)) for k in range(6)])
    s = Store(spark).having(nodes=n, edges=e, vectors=v)
    got = {r.signature: r for r in recall.recall(s, ask("harbour bridge", hops=1, seeds=1)).collect()}
    assert {"s0", "s1", "s2", "s3", "s4"} <= set(got) and "other" not in got and got["s4"].tier in ("chain", "graph") and got["s4"].via == "other"


def test_archive_tiers(spark):
    n = nodes(spark, [("gist", "pump failures in general", 0.6, {"notes": "gist", "first_seen": datetime(2024, 6, 30)})] + [(f"j{k}", f"pump failure in hall {k}", 0.2, {"notes": "archive", "source_day": date(2024, 6, 20 + k)}) for k in range(4)] + [("may", "pump failure in May", 0.2, {"notes": "archive", "source_day": date(2024, 5, 5)}), ("act", "valve failure today", 0.3, {"source_day": date(2024, 6, 21)})])
    v = lane(spark, [(0, "active", unit(0.8)), (1, "archive", unit(0.9)), (6, "active", unit(0.1))])
    s = Store(spark).having(nodes=n, vectors=v)
    dated = {r.signature: r.tier for r in recall.recall(s, ask("failures in late June 2024")).collect()}
    assert dated["act"] in ("window", "seed") and {f"j{k}" for k in range(1, 4)} <= set(dated)
    assert "may" not in {r.signature for r in recall.in_window(n, n.limit(0), [], ask("failures in late June 2024"), True).collect()}
    topical = {r.signature: r.tier for r in recall.recall(s, ask("pump failure")).collect()}
    assert topical["may"] == "archive_words" and "archive_window" not in topical.values()


def test_restatements_collapse(spark):
    rows = spark.createDataFrame([("a", "[x] It is up", date(2024, 1, 1), 2), ("b", "it is up!", date(2024, 1, 5), 1), ("c", "", date(2024, 1, 1), 0), ("d", "", date(2024, 1, 1), 0)], "signature string, fact string, day date, hops int")
    got = {r.signature: (r.statements, r.hops, str(r.observed_since)) for r in recall.collapse(rows).collect()}
    assert got == {"b": (2, 1, "2024-01-01"), "c": (1, 0, "2024-01-01"), "d": (1, 0, "2024-01-01")}


def test_every_parent_keeps_evidence(spark):
    facts_ = [(f"g{k}", f"gist {k}", 0.5, {"notes": "gist"}) for k in range(3)] + [(f"g{k}d{j}", f"detail {k} {j}", 0.2, {"notes": "detail"}) for k in range(3) for j in range(9)]
    n = nodes(spark, facts_)
    links = spark.createDataFrame([(f"g{k}", f"g{k}d{j}", -0.001 * j, 0) for k in range(3) for j in range(9)], "parent string, child string, axis_score double, depth int")
    parents = spark.createDataFrame([("g0", 0.9, "semantic"), ("g1", 0.2, "semantic"), ("g2", 0.1, "temporal")], "signature string, activation double, axis string")
    cos = spark.createDataFrame([(3, 0.9)], "id long, cosine double")
    got = recall.evidence(parents, links, n, cos, ask("x"), per_parent=2).collect()
    assert sorted(r.parent for r in got) == ["g0", "g0", "g1", "g1", "g2", "g2"] and {r.parent for r in got if r["rank"] <= 3} == {"g0", "g1", "g2"}


def test_timeline_and_context(spark):
    day = lambda k: date(2024, 6, k)
    n = nodes(spark, [("f", "pump fixed", 0.5, {"source_day": day(20)})] + [(f"c{k}", f"day {k}", 0.5, {"kind": "chronicle", "notes": "chronicle"}) for k in (20, 21)] + [("w", "week", 0.5, {"kind": "chronicle", "notes": "chronicle"})])
    ch = [(f"c{k}", "day", day(k), day(k), 1) for k in (20, 21)] + [("w", "week", day(17), day(23), 1), ("w0", "week", day(17), day(23), 0)]
    c = spark.createDataFrame([(s, r, a, b, v, 1, 1, 0, b, 1, T0) for s, r, a, b, v in ch], stores.SCHEMAS["chronicles"])
    s = Store(spark).having(nodes=n, chronicles=c, vectors=lane(spark, [(0, "active", unit(0.5)), (3, "chron", unit(0.9))]))
    r = recall.routes(s, ask("June 20-21 2024"), ["pump"]).collect()
    assert [(x.signature, x.route) for x in r] == [("c21", 0), ("c20", 0), ("w", 1)]
    cluster = recall.recall(s, ask("June 20-21 2024", timeline=True))
    assert {"chronicle"} <= {x.tier for x in cluster.collect()} and "chronicle" not in {x.tier for x in recall.recall(s, ask("pump")).collect()}
    lines = [x.line for x in recall.context(cluster.filter("signature = 'f'"), F.lit(date(2024, 7, 1))).collect()]
    assert lines == ["[past couple weeks, 2024-06-20] pump fixed"]
    assert [x.tier for x in recall.hits(cluster, 6, 0).collect()][-1] == "chronicle"


def test_nothing_in_the_store(spark):
    assert recall.recall(Store(spark), ask("anything yesterday", timeline=True)).collect() == []


def test_weave_parts(spark):
    hubs = spark.createDataFrame([("person:ann-lee", ["ann"]), ("person:ann-fox", ["ann"]), ("topic:pump", None), ("topic:dead", None)], "signature string, forms array<string>")
    v = weave.vocabulary(hubs, spark.createDataFrame([("topic:dead",)], "sig string"))
    assert {(r.form, r.sig) for r in v.collect()} == {("ann lee", "person:ann-lee"), ("ann fox", "person:ann-fox"), ("pump", "topic:pump")}
    f = nodes(spark, [("a", "Ann Lee saw the pump", 0.5, {}), ("b", "Ann saw pumps", 0.5, {}), ("c", None, 0.5, {})])
    assert {(r.src, r.dst) for r in weave.co_mentions(f, v).collect()} == {("a", "person:ann-lee"), ("a", "topic:pump")}
    pairs = spark.createDataFrame([("a", "b", 0.5, 1), ("a", "c", 0.5, 2), ("b", "c", 0.7, 1)], "vec_id string, neighbour_id string, cosine double, rank int")
    m = spark.createDataFrame([("a", "h"), ("b", "h")], "src string, dst string")
    assert {(r.src, r.rel, r.dst) for r in weave.siblings(pairs, m).collect()} == {("a", "related_to", "b"), ("b", "similar_to", "c")}
    c = spark.createDataFrame([("n", "o1", 0.7, 0.5, False, False), ("n", "o2", 0.8, 0.2, True, False), ("n", "o3", 0.97, 0.9, True, True), ("m", "o1", 0.9, 0.1, True, True)], "src string, dst string, cosine double, jaccard double, shared_hub boolean, same_scope boolean")
    assert [(r.src, r.dst, r.weight) for r in weave.supersedes(c).collect()] == [("n", "o2", 0.9)]
    q = spark.createDataFrame([("o1", "n", 0.7, 3, 0.9, 1), ("o2", "n", 0.9, 4, 0.1, 2), ("o3", "n", 0.9, 2, 1.0, 3)], "older string, newer string, cosine double, shared int, containment double, at int")
    assert [(r.src, r.dst) for r in weave.sequences(q, edges(spark, [])).collect()] == [("o2", "n")]
    assert weave.sequences(q, edges(spark, [("n", "sequence", "o2")])).count() == 0
    bad = weave.pruned(edges(spark, [("a", "supersedes", "b")]).select("src", "rel", "dst"), nodes(spark, [("a", "totally different words", 0.5, {}), ("b", "nothing common herein", 0.5, {})]))
    assert bad.count() == 1


@pytest.mark.parametrize("seconds,n", [(60, 1), (3600, 3)])
def test_bands(spark, seconds, n):
    from engramix.operators.periods import band_pairs

    df = spark.createDataFrame([(1, "k", datetime(2024, 1, 1, 0, 0, 0)), (2, "k", datetime(2024, 1, 1, 0, 0, 59)), (3, "k", datetime(2024, 1, 1, 0, 59, 30)), (4, "j", datetime(2024, 1, 1))], "i int, k string, t timestamp")
    assert band_pairs(df, "k", "t", "i", seconds).count() == n


def test_the_episode_of_a_day(spark):
    rows = [("hit", "the budget review moved to Friday", 0.5, {"source_day": date(2024, 6, 20)}), ("far", "garden party", 0.5, {"source_day": date(2024, 6, 1)})]
    rows += [(f"e{k}", f"budget item {k} was noted", 0.2, {"notes": "detail", "source_day": date(2024, 6, 20)}) for k in range(14)]
    rows += [("other", "budget item noted elsewhere", 0.2, {"notes": "detail", "source_day": date(2024, 5, 2)}), ("off", "nothing of it", 0.2, {"notes": "detail", "source_day": date(2024, 6, 20)})]
    n = nodes(spark, rows)
    s = Store(spark).having(nodes=n, vectors=lane(spark, [(0, "active", unit(0.9)), (1, "active", unit(0.1))]))
    got = {r.signature: r.tier for r in recall.recall(s, ask("what exact budget items were noted")).collect()}
    episode = {x for x, t in got.items() if t == "anchor_day"}
    assert len(episode) == 12 and episode <= {f"e{k}" for k in range(14)}
    assert "anchor_day" not in {r.tier for r in recall.recall(s, ask("the budget")).collect()}
    assert "anchor_day" not in {r.tier for r in recall.recall(s, ask("what exact budget items on June 20 2024")).collect()}


def test_the_cluster_collapses_and_renders(spark):
    rows = [("a", "the gate is shut", 0.5, {"source_day": date(2024, 5, 1)}), ("b", "The gate is shut.", 0.5, {"source_day": date(2024, 6, 1)}), ("g", "gates in general", 0.9, {"notes": "gist", "temporal_form": "recurring"})]
    rows += [(f"d{k}", f"gate number {k} was oiled", 0.3, {"notes": "detail", "source_day": date(2024, 4, k + 1)}) for k in range(3)]
    links = spark.createDataFrame([(f"d{k}", "g", T0) for k in range(3)], stores.SCHEMAS["detail_of"])
    marks = spark.createDataFrame([("g", "change", 0, "d1"), ("g", "current", 0, "d2")], stores.SCHEMAS["gist_landmarks"])
    s = Store(spark).having(nodes=nodes(spark, rows), detail_of=links, gist_landmarks=marks, vectors=lane(spark, [(k, "active", unit(0.9 - k / 10)) for k in range(3)]))
    got = {r.signature: r for r in recall.recall(s, ask("gate")).collect()}
    assert "a" not in got and got["b"].statements == 2 and got["b"].observed_since == date(2024, 5, 1)
    lines = got["g"].rendered.split("\n")
    assert lines[0].startswith("[semantic memory, recurring]") and lines[1:4] == ["gates in general", "change: gate number 1 was oiled", "current: gate number 2 was oiled"] and lines[4] == "evidence: 3 from 2024-04-01 to 2024-04-03"
    assert got["b"].rendered is None
    e = edges(spark, [("a", "mentions", "h"), ("g", "similar_to", "b"), ("b", "similar_to", "a")])
    assert {(r.src, r.dst) for r in recall.in_cluster(e, spark.createDataFrame([("g",), ("b",)], "signature string")).collect()} == {("g", "b")}


def test_landmarks_stand_before_details(spark):
    n = nodes(spark, [("g", "gist", 0.5, {"notes": "gist"})] + [(f"d{k}", f"piece {k}", 0.2, {"notes": "detail", "source_day": date(2024, 6, k + 1)}) for k in range(8)])
    marks = spark.createDataFrame([("g", "before", 0, "d0"), ("g", "change", 1, "d1"), ("g", "current", 0, "d2")], stores.SCHEMAS["gist_landmarks"])
    links = spark.createDataFrame([(f"d{k}", "g", T0) for k in range(8)], stores.SCHEMAS["detail_of"])
    parents = spark.createDataFrame([("g", 0.5, "semantic")], "signature string, activation double, axis string")
    none = spark.createDataFrame([], "id long, cosine double")
    s = Store(spark).having(nodes=n, detail_of=links, gist_landmarks=marks)
    got = recall.evidence(parents, recall.axis_links(s, parents, [], ask("x")), n, none, ask("x")).orderBy("rank").collect()
    assert [(r.signature, r.score) for r in got] == [("d1", pytest.approx(0.5 + 0.08 * 2.999)), ("d2", pytest.approx(0.66)), ("d0", pytest.approx(0.58))]
    s = s.having(gist_landmarks=marks.limit(0))
    got = recall.evidence(parents, recall.axis_links(s, parents, [], ask("x")), n, none, ask("x")).orderBy("rank").collect()
    assert [r.signature for r in got] == ["d7", "d6", "d5", "d4"]
