import collections
import hashlib
import random

import pytest

from engramix.llm import sharding


def brute(groups, capacity):
    """Best fit decreasing, one group at a time."""
    room, out = [], {}
    for key, size in groups:
        fits = [(r, k) for k, r in enumerate(room) if r >= size]
        if fits:
            k = min(fits)[1]
            room[k] -= size
        else:
            k = len(room)
            room.append(max(capacity - size, -1))
        out[key] = k
    return out


@pytest.mark.parametrize("seed", range(30))
def test_pack_equals_one_by_one(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 100, 1000])
    histogram = {rng.randint(0 if seed % 3 == 0 else 1, capacity + 5): rng.choice([1, 2, 30]) for _ in range(rng.choice([1, 5, 80]))}
    runs, shards = sharding.pack(histogram.items(), capacity)
    order = [((s, k), s) for s, n in sorted(histogram.items(), reverse=True) for k in range(n)]
    want = brute(order, capacity)
    got = {}
    for (s, k), _ in order:
        size, first, low, each = max((r for r in runs if r[0] == s and r[1] <= k), key=lambda r: r[1])
        got[s, k] = low + (k - first) // each
    assert got == want and shards == max(want.values()) + 1


def test_room_tree_keeps_order():
    rng = random.Random(1)
    tree, rooms = sharding.RoomTree(), collections.Counter()
    for i in range(5000):
        r = rng.randint(0, 3000)
        tree.add(r, i, i + 1)
        rooms[r] += 1
        if i % 2:
            ask = rng.randint(0, 3100)
            want = min((x for x in rooms if x >= ask and rooms[x]), default=None)
            assert tree.tightest(ask) == want
            if want is not None:
                low, high = tree.take(want, 1)
                assert high - low == 1
                rooms[want] -= 1
    assert tree.tightest(10**9) is None


@pytest.mark.parametrize("capacity", [60, 400, 10**6])
def test_documents(spark, capacity):
    rng = random.Random(4)
    texts = ["x" * rng.randint(1, 90) for _ in range(40)] + ["é" * k for k in range(20)] + ["", None, None]
    rows = [(k, t, "s", 3) for k, t in enumerate(texts + rng.choices(texts, k=30))] + [(None, "x", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, group_bytes int").repartition(3)
    found = sharding.shard(docs, capacity).collect()
    key = lambda t: "null" if t is None else hashlib.md5(t.encode()).hexdigest()
    size = collections.Counter()
    for _, t, *_ in rows:
        size[key(t)] += len((t or "").encode())
    order = sorted(size.items(), key=lambda kv: (-kv[1], hashlib.md5(kv[0].encode()).hexdigest()[:3], kv[0]))
    want = brute(order, capacity)
    assert len(found) == len(rows)
    for r in found:
        assert r.shard == want[r.group_key] and r.group_bytes == size[r.group_key] and r.oversize == (r.group_bytes > capacity)
    assert {(r.doc_id, r.group_key) for r in found} == {(i, key(t)) for i, t, *_ in rows}
    load = collections.Counter()
    for g in {(r.group_key, r.group_bytes, r.shard) for r in found}:
        load[g[2]] += g[1]
    assert all(v <= capacity or sum(want[k] == s for k in want) == 1 for s, v in load.items())


def test_given_groups_and_nothing(spark):
    docs = spark.createDataFrame([(1, "aa", "g"), (2, "b", "g"), (3, "cc", None), (4, "d", None)], "doc_id long, text string, g string")
    found = sharding.shard(docs, 3, group="g").collect()
    assert len({r.shard for r in found if r.group_key == "=g"}) == 1 and len({r.shard for r in found}) == 2
    assert sharding.shard(docs.limit(0)).collect() == []


def test_many_groups_of_one_size(spark):
    """Numbered and placed in parts of a size, not in one task; three to a shard, in the order of the keys' hashes."""
    docs = spark.range(100_000).selectExpr("id AS doc_id", "lpad(CAST(id AS STRING), 8, '0') AS text").unionByName(spark.createDataFrame([(200_000, "x" * 20)], "doc_id long, text string"))
    found = sharding.shard(docs, 27)
    rows = found.collect()
    load = collections.Counter(r.shard for r in rows if r.group_bytes == 8)
    assert len(rows) == 100_001 and set(load.values()) == {3, 1} and sorted(load) == list(range(1, 33_335)) and [r.shard for r in rows if r.group_bytes == 20] == [0]
    order = sorted((hashlib.md5(r.group_key.encode()).hexdigest()[:3], r.group_key, r.shard) for r in rows if r.group_bytes == 8)
    assert [s for *_, s in order] == [1 + k // 3 for k in range(100_000)]
