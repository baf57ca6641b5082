import random

import numpy as np
import pyarrow as pa
import pytest

from engramix.llm import jaccard


def sets_of(text, n):
    w = text.split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n, t):
    """Pairs over stand-ins of equal sets, and stand-in to copy."""
    sets = {i: frozenset(sets_of(x, n)) for i, x in rows if i is not None and x is not None and x.split()}
    reps = {}
    for i in sorted(sets):
        reps.setdefault(sets[i], i)
    out = {(reps[s], i): (len(s), 1.0) for i, s in sets.items() if reps[s] != i}
    ids = sorted(reps.values())
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            o = len(sets[a] & sets[b])
            if (j := o / (len(sets[a]) + len(sets[b]) - o)) >= t:
                out[a, b] = (o, j)
    return out


def corpus(rng):
    words = [f"w{k}" for k in range(400)]
    rows = []
    passage = [rng.choice(words) for _ in range(50)]
    for base in range(25):
        text = [rng.choice(words) for _ in range(rng.choice([3, 8, 30, 120]))]
        if base % 3 == 0:
            text = text[: len(text) // 2] + passage + text[len(text) // 2 :]
        for _ in range(rng.choice([1, 2, 6])):
            own = [rng.choice(words) if rng.random() < rng.choice([0, 0.03, 0.1]) else w for w in text]
            rows.append((len(rows) + 100, " ".join(own)))
    return rows


@pytest.mark.parametrize("n,t", [(3, 0.5), (2, 0.8), (1, 0.3)])
def test_equals_all_pairs(spark, n, t):
    rng = random.Random(7)
    rows = corpus(rng) + [(1, "a b"), (2, "a b"), (3, ""), (4, None), (None, "a b"), (5, " \t\n")]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, x, "s", 1) for i, x in rows], "doc_id long, text string, left_id string, centre int").repartition(3)
    found = jaccard.jaccard_join(docs, n, t).collect()
    got = {(r.left_id, r.right_id): (r.shared, pytest.approx(r.jaccard)) for r in found}
    assert len(found) == len(got) and got == brute(rows, n, t)


def test_divide_skip_equals_all_pairs():
    rng = np.random.default_rng(3)
    for _ in range(15):
        top = int(rng.integers(5, 60))
        sets = sorted((np.unique(rng.integers(0, top, int(rng.integers(1, 40)))).astype(np.uint64) for _ in range(30)), key=len)
        for t in (0.3, 0.5, 0.9):
            i, j, o = jaccard.divide_skip(sets, t)
            want = {(a, b): len(np.intersect1d(sets[a], sets[b])) for a in range(30) for b in range(a + 1, 30)}
            want = {k: v for k, v in want.items() if v and v / (len(sets[k[0]]) + len(sets[k[1]]) - v) >= t}
            assert dict(zip(zip(i.tolist(), j.tolist()), o.tolist())) == want


def test_cover_leaves_less_than_half_of_the_least_overlap():
    rng = np.random.default_rng(5)
    size = 40
    centres = rng.integers(0, 12, 33) ** 2 // 12
    short = np.zeros(33, dtype=np.uint8)
    s, c = jaccard.cover(np.zeros(33, dtype=np.int64), np.full(33, size), centres, short, 0.5)
    assert set(s) == {0} and (~np.isin(centres, c)).sum() <= (20 - 1) // 2
    s, _ = jaccard.cover(np.zeros(19, dtype=np.int64), np.full(19, size), np.zeros(19, dtype=np.int64), short[:19], 0.5)
    assert len(s) == 0
    line = np.array([0] * 9 + [1] * 24)
    _, c = jaccard.cover(np.zeros(33, dtype=np.int64), np.full(33, size), line, np.where(line, 0, 3).astype(np.uint8), 0.5)
    assert c.tolist() == [1]


def test_grams_shared_by_chance_send_a_set_to_few_centres():
    """A third of a group's lists have a stranger as well, each another one. Without the order of lists, the set goes to strangers' centres too."""
    centres = np.concatenate([np.full(160, 500), np.arange(80)])  # of 240 grams
    lengths = np.concatenate([np.full(160, 5), np.full(80, 6)]).astype(np.uint8)
    names, sizes = np.zeros(240, dtype=np.int64), np.full(240, 240)
    ahead = jaccard.foremost(names, sizes, centres, lengths, 0.5, jaccard.SHARE)
    _, c = jaccard.cover(names[ahead], sizes[ahead], centres[ahead], np.zeros(len(ahead), dtype=np.int64), 0.5, jaccard.SHARE)
    assert c.tolist() == [500]
    _, c = jaccard.cover(names, sizes, centres, np.zeros(240, dtype=np.int64), 0.5)
    assert len(c) > 10


@pytest.mark.parametrize("t", [0.3, 0.5, 0.9])
def test_partners_meet_at_a_centre(t):
    """Sets with many grams that they share by chance: every pair of partners keeps a centre in common."""
    rng = np.random.default_rng(6)
    met = 0
    for _ in range(40):
        base = [rng.integers(0, 90, int(rng.integers(3, 40))) for _ in range(5)]
        sets = [np.unique(np.where(rng.random(len(b)) < rng.choice([0, 0.1, 0.3]), rng.integers(0, 90, len(b)), b)) for b in base for _ in range(3)]
        lists = {}
        for k, s in enumerate(sets):
            for g in s:
                lists.setdefault(g, []).append(k)
        rows = np.array([(k, len(s), lists[g][0], len(lists[g])) for k, s in enumerate(sets) for g in rng.permutation(s) if len(lists[g]) > 1], dtype=np.int64).T
        ahead = jaccard.foremost(*rows[:3], jaccard._length(rows[3]), t, jaccard.SHARE)
        names, sizes, centres, n = rows[:, ahead]
        s, c = jaccard.cover(names, sizes, centres, jaccard._excess(jaccard._length(n)), t, jaccard.SHARE)
        own = [set(c[s == k]) for k in range(len(sets))]
        for a in range(len(sets)):
            for b in range(a + 1, len(sets)):
                o = len(np.intersect1d(sets[a], sets[b]))
                if o and o / (len(sets[a]) + len(sets[b]) - o) >= t:
                    met += 1
                    assert own[a] & own[b]
    assert met > 100


def test_short_and_long_texts():
    words = ["x", "y z", "a b c d", "", None, "q " * 50_000]
    found = jaccard.gram_sets(pa.array(words, pa.string()), 3)
    assert [len(s) for s in found] == [1, 1, 2, 0, 0, 1]


def test_components_and_one_of_each(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 101), (101, 100), (200, 150)], "left_id long, right_id long")
    roots = {r.id: r.root for r in jaccard.components(edges).collect()}
    assert roots == {k: 1 for k in range(1, 41)} | {100: 100, 101: 100, 150: 150, 200: 150}
    assert jaccard.components(edges.limit(0)).collect() == []
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, "a"), (2, text, "b"), (3, text + " more", "c"), (4, "other words here now", "d"), (4, "other words here now", "d"), (5, "", "e"), (None, text, "f"), (6, None, "g"), (7, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, near_id string")
    kept = jaccard.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.near_id) for r in kept.collect()) == [(0, "f"), (1, "a"), (4, "d"), (5, "e"), (6, "g"), (7, "e")]
    assert jaccard.keep_one_of_each(docs.limit(0)).collect() == []
    assert jaccard.jaccard_join(docs.limit(0)).collect() == []


def test_all_pairs_of_all_copies_on_request(spark):
    rows = corpus(random.Random(8))
    rows += [(i + 1000 * k, x) for i, x in rows[::4] for k in (1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = {i: sets_of(x, 3) for i, x in rows}
    want = {}
    for a in sets:
        for b in sets:
            o = len(sets[a] & sets[b])
            if a < b and (j := o / (len(sets[a]) + len(sets[b]) - o)) >= 0.5:
                want[a, b] = (o, j)
    found = jaccard.with_all_copies(jaccard.jaccard_join(docs)).collect()
    assert len(found) == len(want) > len(brute(rows, 3, 0.5))
    assert {(r.left_id, r.right_id): (r.shared, r.jaccard) for r in found} == want


def classes(rows, n, t):
    """(id, set) -> (class, copy_of, links) over all pairs of (id, set)."""
    nodes = sorted({(i, frozenset(sets_of(x or "", n))) for i, x in rows if i is not None}, key=lambda x: (x[0], sorted(x[1])))
    links, root = {x: 0 for x in nodes}, {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(nodes):
        for b in nodes[k + 1 :]:
            o = len(a[1] & b[1])
            if o and o / (len(a[1]) + len(b[1]) - o) >= t:
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)), key=lambda z: nodes.index(z))
                root[y] = x
    return sorted((i, find((i, s))[0], min(j for j, z in nodes if z == s) if s else i, links[i, s]) for i, s in nodes)


@pytest.mark.parametrize("heavy", [jaccard.HEAVY, 150])
def test_classes_equal_all_pairs(spark, monkeypatch, heavy):
    monkeypatch.setattr(jaccard, "HEAVY", heavy)
    rng = random.Random(9)
    rows = corpus(rng)
    rows += [(i + 1000 * k, x) for i, x in rows[::4] for k in (1, 2, 3)]
    rows += [(1, "a b"), (2, "a b"), (3, ""), (4, None), (4, " "), (None, "a b"), rows[0], (rows[0][0], rows[5][1]), (rows[0][0], "nothing like the others at all")]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, x, 5, "c") for i, x in rows], "doc_id long, text string, class_id int, centre string").repartition(3)
    found = jaccard.near_classes(docs).collect()
    assert sorted((r.doc_id, r.class_id, r.copy_of, r.n_links) for r in found) == classes(rows, 3, 0.5)
    assert max(r.n_links for r in found) >= 8
    assert jaccard.near_classes(docs.limit(0)).collect() == []


def test_a_line_that_half_of_the_texts_hold(spark, monkeypatch):
    """Its list is long and its centre is split; every near copy is found all the same."""
    monkeypatch.setattr(jaccard, "HEAVY", 2_000)
    rng = random.Random(12)
    line = " ".join(f"license{k}" for k in range(40))
    rows = []
    for k in range(300):
        own = " ".join(f"w{rng.randrange(5000)}" for _ in range(rng.choice([15, 60])))
        rows.append((k, own if k % 2 else f"{line} {own}"))
    rows += [(1000 + i, x + " tail") for i, x in rows[:40]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {(r.left_id, r.right_id): (r.shared, r.jaccard) for r in jaccard.jaccard_join(docs).collect()}
    assert found == brute(rows, 3, 0.5) and len(found) > 1000


def test_each_text_of_a_repeated_id_is_judged_by_itself(spark):
    text, other = "one two three four five six seven eight nine ten", "a text that is unlike all of the others here"
    rows = [(1, text, "a"), (5, text, "b"), (5, other, "c"), (5, other, "c"), (6, other + " too", "d"), (7, "", "e"), (7, None, "f"), (8, "   ", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string")
    kept = jaccard.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.id) for r in kept.collect()) == [(1, "a"), (5, "c"), (7, "e"), (7, "f"), (8, "g")]


@pytest.mark.parametrize("heavy", [jaccard.HEAVY, 150])
def test_centres_in_turns_find_the_same(spark, monkeypatch, heavy):
    monkeypatch.setattr(jaccard, "HEAVY", heavy)
    monkeypatch.setattr(jaccard, "PASS", 0.4)
    monkeypatch.setattr(jaccard, "LEAST_PASS", 1)
    turns = []
    keep = jaccard.keep
    monkeypatch.setattr(jaccard, "keep", lambda df, name: turns.append(name) or keep(df, name))
    rows = corpus(random.Random(9))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {(r.left_id, r.right_id): (r.shared, r.jaccard) for r in jaccard.jaccard_join(docs).collect()}
    assert found == brute(rows, 3, 0.5) and turns.count("jaccard-turn") > 1
