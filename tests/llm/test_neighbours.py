import numpy as np
import pytest

from engramix.llm import neighbours as nb


def brute(ids, v, k):
    d = np.sqrt(((v[:, None, :].astype(np.float64) - v[None, :, :]) ** 2).sum(axis=2))
    out = {}
    for i, own in enumerate(ids):
        near = {}
        for j, other in enumerate(ids):
            if other != own:
                near[other] = min(near.get(other, np.inf), d[i, j])
        out[own] = sorted(((x, j) for j, x in near.items()))[:k]
    return out


def vectors(rng, n, dims=24):
    centres = rng.normal(size=(20, dims))
    v = centres[rng.integers(0, 20, n)] + 0.4 * rng.normal(size=(n, dims))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


@pytest.mark.parametrize("cell", [10_000, 150])
def test_recall_against_brute_force(spark, cell):
    rng = np.random.default_rng(2)
    v = vectors(rng, 900)
    v[5] = v[6] = v[7]
    table = spark.createDataFrame([(int(i), x.tolist(), 1, "c") for i, x in enumerate(v)], "vec_id long, embedding array<float>, rank int, p string").repartition(3)
    found = nb.nearest(table, k=10, cell=cell).collect()
    want = brute(list(range(900)), v, 10)
    hits = sum((r.neighbour_id in {j for _, j in want[r.vec_id]}) for r in found)
    assert len(found) == 9000 and hits / 9000 >= 0.9
    assert {(r.vec_id, r["rank"]) for r in found} == {(i, k) for i in range(900) for k in range(1, 11)}
    assert {r.neighbour_id for r in found if r.vec_id == 5 and r["rank"] <= 2} == {6, 7}
    for r in found[:200]:
        assert r.distance == pytest.approx(float(np.linalg.norm(v[r.vec_id].astype(float) - v[r.neighbour_id])), abs=1e-5)


def test_the_whole_table_at_production_settings(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.collect()
    v = np.array([r.embedding for r in rows], dtype=np.float32)
    ids = [r.vec_id for r in rows]
    d = 2 - 2 * v @ v.T
    np.fill_diagonal(d, np.inf)
    want = {ids[i]: {ids[j] for j in np.argsort(d[i])[:10]} for i in range(len(ids))}
    found = nb.nearest(table, cell=512).collect()
    assert len(found) == 10 * len(ids) and sum(r.neighbour_id in want[r.vec_id] for r in found) / len(found) >= 0.9


def test_edges(spark):
    ddl = "vec_id long, embedding array<float>"
    rows = [(1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (4, None), (None, [1.0, 1.0]), (5, []), (6, [1.0]), (7, [float("nan"), 0.0]), (8, [None, 1.0])]
    table = spark.createDataFrame(rows, ddl)
    found = sorted((r.vec_id, r["rank"], r.neighbour_id, r.distance) for r in nb.nearest(table).collect())
    assert found == [(1, 1, 2, 0.0), (1, 2, 3, 1.41421), (2, 1, 1, 0.0), (2, 2, 3, 1.41421), (3, 1, 1, 1.41421), (3, 2, 2, 1.41421)]
    assert nb.nearest(table.limit(0)).collect() == []
    assert nb.nearest(spark.createDataFrame([(1, [1.0])], ddl)).collect() == []


def test_quantile_and_tree():
    assert nb.quantile(0.95, 8) == pytest.approx(15.50731, abs=1e-4)
    assert nb.quantile(0.5, 2) == pytest.approx(1.386294, abs=1e-5)
    rng = np.random.default_rng(1)
    p = rng.normal(size=(4000, 8))
    dims, values = nb.split(p, 16)
    n = np.bincount(nb.cell_of(p, dims, values), minlength=16)
    assert len(n) == 16 and n.min() > 200
    same = np.ones((100, 8))
    assert nb.cell_of(same, *nb.split(same, 4)).max() <= 3


@pytest.mark.parametrize("cell", [10_000, 60])
def test_repeated_rows_of_an_id_take_one_place(spark, cell):
    rng = np.random.default_rng(4)
    v = vectors(rng, 300)
    ids = [7] * 40 + list(range(100, 360))
    v[:40] = v[45] + 0.001 * rng.normal(size=(40, v.shape[1]))
    table = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v)], "vec_id long, embedding array<float>").repartition(3)
    found = nb.nearest(table, k=10, cell=cell).collect()
    want = brute(ids, v, 10)
    got = {}
    for r in found:
        got.setdefault(r.vec_id, {})[r.neighbour_id] = r.distance
    assert {len(x) for x in got.values()} == {10} and len(got) == 261
    hits = sum(j in got[i] for i, near in want.items() for _, j in near)
    assert hits / 2610 >= 0.9
    for near, j in want[105]:
        if j == 7:
            assert got[105][7] == pytest.approx(near, abs=1e-5)


@pytest.mark.parametrize("cell", [10_000, 60])
def test_more_equal_vectors_than_places_are_ranked_by_id(spark, cell):
    rng = np.random.default_rng(6)
    v = vectors(rng, 700)
    v[:400] = v[0]
    ids = rng.permutation(700).tolist()
    table = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v)], "vec_id long, embedding array<float>").repartition(3)
    got = {}
    for r in nb.nearest(table, k=10, cell=cell).collect():
        got.setdefault(r.vec_id, []).append((r["rank"], r.neighbour_id))
    same = sorted(ids[:400])
    for i in same:
        assert [j for _, j in sorted(got[i])] == [j for j in same if j != i][:10]


def test_a_hundred_thousand_equal_vectors(spark):
    """They are one query and a few points; the others' neighbours are found in the same cells."""
    rng = np.random.default_rng(8)
    v = vectors(rng, 1000)
    other = spark.createDataFrame([(200_000 + i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    same = spark.range(100_000).selectExpr("id AS vec_id", f"array({', '.join(f'float({float(x)!r})' for x in v[3])}) AS embedding")
    got = {}
    for r in nb.nearest(same.unionByName(other).repartition(6), cell=2000, queries=nb.F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.vec_id, []).append((r["rank"], r.neighbour_id, r.distance))
    assert len(got) == 1010 and all(len(x) == 10 for x in got.values())
    for i in (0, 500, 99_900):
        assert [j for _, j, _ in sorted(got[i])] == [j for j in range(11) if j != i][:10] and {d for *_, d in got[i]} == {0.0}
    d = np.sqrt(((v[:, None, :].astype(float) - v[None, :, :]) ** 2).sum(axis=2))
    hits = want = 0
    for i in range(0, 1000, 100):
        near = sorted([(d[i, 3], j) for j in range(10)] + [(d[i, j], 200_000 + j) for j in range(1000) if j != i])[:10]
        hits += len({j for _, j in near} & {j for _, j, _ in got[200_000 + i]})
        want += 10
    assert hits / want >= 0.9


def test_the_query_takes_every_hundredth_against_all(spark):
    from engramix.llm import queries

    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    v, ids = np.array([r.embedding for r in rows], dtype=np.float64), [r.vec_id for r in rows]
    found = queries.QUERIES["op8_nearest_neighbours"](spark, "/root/testdata/sf0.1").collect()
    asked = [i for i in ids if i % 100 == 0]
    assert len(found) == 10 * len(asked) and {r.vec_id for r in found} == set(asked)
    hits = 0
    for i in asked:
        d = np.sqrt(((v - v[ids.index(i)]) ** 2).sum(axis=1))
        near = sorted((x, j) for x, j in zip(d, ids) if j != i)[:10]
        hits += len({j for _, j in near} & {r.neighbour_id for r in found if r.vec_id == i})
    assert hits / len(found) >= 0.9
