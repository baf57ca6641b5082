"""What larger and odd tables brought out: queries against their SQL, or against brute force, on tables made for it."""

from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from engramix.functions import vector
from engramix.operators import graph, upkeep, weave
from engramix.plans import registry

from .oracles import connect, same

registry.load()


def tables(spark, tmp_path, **frames):
    """A folder of tables, the named ones replaced."""
    from .oracles import SF, TABLES

    for t in TABLES:
        (tmp_path / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet") if t not in frames else frames[t].coalesce(1).toPandas().to_parquet(tmp_path / f"{t}.parquet", coerce_timestamps="us")
    return str(tmp_path)


def check(spark, sf_dir, *names):
    con = connect(sf_dir)
    for name in names:
        same(registry.QUERIES[name](spark, sf_dir), registry.ORACLES[name], con)


def test_odd_texts_collapse_as_in_sql(spark, tmp_path):
    texts = ["", "...", "\u4f60\u597d", "[a] It is up", "it is up!", "\u00e92024-01-02 due", "\u00e9 due", "x\u0130y", "xiy", "\u000b[b] odd", "odd"]
    docs = spark.createDataFrame([(k, t, "en", "s", 7 * k + 1) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    check(spark, tables(spark, tmp_path, documents=docs), "restatement_collapse", "normalize_for_match")


def test_searches_hold_a_block_and_a_slab(spark, tmp_path):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(300, 16))
    v[200:] = v[rng.integers(0, 200, 100)]  # equal vectors, so that ranks end in ties
    v /= np.linalg.norm(v, axis=1)[:, None]
    rows = spark.createDataFrame([(int(k) * 3, v[k].astype(np.float32).tolist(), int(k % 7 == 0) + 3) for k in range(300)], "vec_id long, embedding array<float>, label int")
    sf_dir = tables(spark, tmp_path, embeddings=rows)
    con, sizes = connect(sf_dir), []
    for name in ("knn_pairs_rank", "knn_threshold_edges", "island_rescue", "merge_clusters", "neighbours_of_changed", "similarity_components", "pairwise_cosine"):
        found = registry.QUERIES[name](spark, sf_dir)
        same(found, registry.ORACLES[name], con)
        sizes.append(found._jdf.queryExecution().toString())
    # a search sends each vector once, and no row of it to a ranking or a join of all pairs
    assert "Window" not in sizes[0] and "BroadcastNestedLoop" not in sizes[-1] and "SortMergeJoin" not in sizes[-1]


def test_search_in_small_pieces(monkeypatch):
    monkeypatch.setattr(vector, "_ROWS", 7)
    rng = np.random.default_rng(3)
    v, ids = rng.normal(size=(90, 8)).astype(np.float32), np.arange(90, dtype=np.int64) * 5
    v[60:] = v[:30]
    best = vector._Best(ids, v, 4, None)
    for lo in range(0, 90, 11):
        best.meet(ids[lo : lo + 11], v[lo : lo + 11])
    near = np.round(v.astype(np.float64) @ v.astype(np.float64).T, 6)
    want = [(int(ids[k]), int(ids[j]), r + 1) for k in range(90) for r, j in enumerate(sorted((j for j in range(90) if j != k), key=lambda j: (-near[k, j], ids[j]))[:4])]
    got = best.table().to_pydict()
    assert list(zip(got["vec_id"], got["neighbour_id"], got["rank"])) == want


def test_a_text_is_normalized_once(spark, tmp_path):
    """Long texts go through the patterns once; words that tell something may come late."""
    texts = ["the of a " * 30 + "Alpha beta gamma 12 delta epsilon zeta", "One, two  three\n\u00e9four five six seven", "a b c", "", " .- ", "x" * 60]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    sf_dir = tables(spark, tmp_path, documents=docs)
    check(spark, sf_dir, "normalize_slug")
    plan = registry.QUERIES["normalize_slug"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 1


def test_ranks_of_versions_share_the_exchange_of_their_customers(spark, tmp_path):
    rng = np.random.default_rng(5)
    orders = spark.createDataFrame([(k, int(rng.integers(0, 12)), "FOP"[k % 3], float(rng.integers(100, 120)), datetime(2000, 1, 1 + k % 20), f"{k % 5}-X") for k in range(600)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string")
    sf_dir = tables(spark, tmp_path, orders=orders)
    # about 50 orders a customer: more than may be ranked, with ties
    check(spark, sf_dir, "version_pairs", "correction_links", "sequence_links")
    plan = registry.QUERIES["version_pairs"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    head = plan[plan.index("Window [") :]
    assert "Exchange hashpartitioning(o_custkey" in head and "hashpartitioning(a_key" not in plan
    assert plan.count("array_intersect") == 1


def test_shared_hubs_in_small_tasks(spark, monkeypatch):
    monkeypatch.setattr(graph, "TASK_ROWS", 20)
    rng = np.random.default_rng(11)
    rows = sorted({(f"f{int(f):02}", f"h{int(h)}") for f, h in zip(rng.integers(0, 40, 120), rng.integers(0, 9, 120) ** 2 % 60)} | {(f"g{k}", "h0") for k in range(5)})
    m = spark.createDataFrame(rows + rows[:7], "src string, dst string")
    facts = {}
    for f, h in rows:
        facts.setdefault(f, set()).add(h)
    size = {h: sum(h in x for x in facts.values()) + sum(r[1] == h for r in rows[:7]) for h in {h for _, h in rows}}
    cap = sorted(size.values())[-2]
    kept = {f: {h for h in x if size[h] <= cap} for f, x in facts.items()}
    want = {(a, b): len(kept[a] & kept[b]) for a in facts for b in facts if a < b and kept[a] & kept[b]}
    found = graph.co_mentions(m, cap)
    assert {(r.left, r.right): r.hubs for r in found.collect()} == want and found.count() == len(want)
    # pairs are added up by both names in tasks of their own number, not the session's
    assert found.rdd.getNumPartitions() > 4
    new = spark.createDataFrame([(f, 100 + k) for k, f in enumerate(list(facts)[::6])], "signature string, seq long")
    cues = {r.signature for r in new.collect()}
    triggers, _ = upkeep.reactivate(new, m, cap)
    back = {f: sum(bool(kept[f] & kept[c]) for c in cues) for f in facts if f not in cues}
    assert {r.signature: r.triggers for r in triggers.collect()} == {f: n for f, n in back.items() if n}


def test_words_are_made_of_paired_facts_alone(spark):
    said = {"a": "[Desk] pumps deliver water again", "b": "[Desk] pumps deliver water", "c": "[Desk] valves rusted", "d": "[Other] pumps deliver water"} | {f"x{k}": "[Wide] something else" for k in range(6)}
    f = spark.createDataFrame([(s, t, datetime(2024, 1, 30 - k)) for k, (s, t) in enumerate(said.items())], "signature string, fact string, first_seen timestamp")
    m = spark.createDataFrame([("a", "h"), ("b", "h"), ("d", "g")], "src string, dst string")
    pairs = spark.createDataFrame([("a", "b", 0.9, 1), ("a", "d", 0.8, 2), ("x0", "x1", 0.9, 1), ("b", "a", 0.9, 1)], "src string, dst string, cosine double, rank int")
    among = pairs.select(F.explode(F.array("src", "dst")).alias("signature")).distinct()
    rows = lambda d: sorted(map(tuple, d.collect()))
    whole, some = weave.versions(pairs, f, m, 10), weave.versions(pairs, f, m, 10, among)
    assert rows(whole) == rows(some) and {(r.src, r.dst): (r.shared, r.shared_hub, r.same_scope) for r in some.collect()} == {("a", "b"): (3, True, True), ("a", "d"): (3, False, False), ("x0", "x1"): (1, False, False)}
    assert sum(spark.read.parquet(t).count() for t in some.inputFiles() if "correction" in spark.read.parquet(t).columns) == 5
    gone = weave.pruned(spark.createDataFrame([("c", "supersedes", "a"), ("a", "supersedes", "b")], "src string, rel string, dst string"), f)
    assert rows(gone) == [("c", "supersedes", "a")]
