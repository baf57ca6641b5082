import collections
import math
import random

import numpy as np
import pytest

from engramix.llm import katz


def brute(texts, least=katz.LEAST_COUNT):
    """logprob of each text by the formulas, one token at a time."""
    seqs = [["<s>"] + ["w" + x for x in t.split()] + ["</s>"] for t in texts]
    uni = collections.Counter(w for s in seqs for w in s[1:])
    big = collections.Counter((a, b) for s in seqs for a, b in zip(s, s[1:]))
    ctx = collections.Counter()
    for (a, _), n in big.items():
        ctx[a] += n
    n = sum(uni.values())
    d1, d2 = (katz.discounts(collections.Counter(c.values())) for c in (uni, big))
    disc = lambda d, c: d[c] if c <= katz.K else 1.0
    p = {w: disc(d1, c) * c / n for w, c in uni.items()}
    if 1 - sum(p.values()) <= 1e-12:
        p = {w: c / (n + 1) for w, c in uni.items()}
    stored = {k: disc(d2, c) * c for k, c in big.items() if c >= least}
    mass, low = collections.Counter(), collections.Counter()
    for (a, b), m in stored.items():
        mass[a] += m
        low[a] += p[b]
    t = {a: c + 1 if 1 - mass[a] / c <= 1e-12 else c for a, c in ctx.items()}

    def prob(a, b):
        if (a, b) in stored:
            return stored[a, b] / t[a]
        return (1 - mass[a] / t[a]) / (1 - low[a]) * p[b]

    return [sum(math.log(prob(a, b)) for a, b in zip(s, s[1:])) for s in seqs]


def zipf(rng, n):
    return " ".join(f"v{int(rng.paretovariate(0.7))}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    return [zipf(rng, rng.randint(0, 60)) for _ in range(150)] + ["", "v1 v1 v1", "v1 v1 v1", "x " * 5000]


@pytest.mark.parametrize("least", [1, 2])
def test_equals_brute_force(spark, texts, least):
    rows = list(enumerate(texts)) + [(None, "v1 v2"), (900, None)]
    docs = spark.createDataFrame([(i, t, "a", 7) for i, t in rows], "doc_id long, text string, key string, base int").repartition(3)
    found = katz.score(docs, least_count=least).collect()
    want = brute([t for _, t in rows if t is not None], least)
    assert len(found) == len(rows)
    got = {r.doc_id: r for r in found}
    for (i, t), lp in zip([x for x in rows if x[1] is not None], want):
        assert got[i].n_tokens == len(t.split()) + 1
        assert got[i].logprob == pytest.approx(lp, abs=1e-3)
        assert got[i].perplexity == pytest.approx(math.exp(-lp / got[i].n_tokens), rel=1e-4)
    assert got[900].n_tokens is None and got[900].logprob is None and got[900].perplexity is None
    assert katz.score(docs.limit(0)).collect() == []
    clash = katz.score(docs.withColumnRenamed("base", "n_tokens"), carry=("doc_id", "n_tokens"), least_count=least)
    assert clash.columns == ["doc_id", "n_tokens", "n_tokens_", "logprob", "perplexity"] and {r.n_tokens for r in clash.collect()} == {7}


def test_model_adds_up_and_scores_other_texts(spark, texts):
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    model = katz.fit(docs, most_words=40)
    v = model.vocabulary
    assert len(v.hashes) <= 40 and v.p.sum() == pytest.approx(1)
    stored = {}
    for r in model.bigrams.collect():
        for k, n in zip(katz.unplanes(bytes(r["keys"])).view(np.int64), np.frombuffer(r["counts"], dtype=np.int64)):
            stored[int(k) >> katz.BITS, int(k) & (1 << katz.BITS) - 1] = n
    assert stored
    for a in range(len(v.counts)):
        own = {b: (model.d[n] if n <= katz.K else 1.0) * n / model.total[a] for (c, b), n in stored.items() if c == a}
        rest = sum(v.p[b] for b in range(len(v.p)) if b not in own)
        assert sum(own.values()) + math.exp(model.alpha[a]) * rest == pytest.approx(1)
    other = spark.createDataFrame([("a", "never seen words"), ("b", "v1 v1 v2")], "id string, text string")
    rows = {r.id: r for r in katz.score(other, model, carry=("id",)).collect()}
    assert rows["a"].n_tokens == 4 and rows["a"].logprob < 0 and rows["b"].perplexity < rows["a"].perplexity * 100


def test_discounts():
    assert katz.discounts({}).tolist() == [1] * 6
    d = katz.discounts({1: 1000, 2: 300, 3: 150, 4: 90, 5: 60, 6: 45})
    a = 6 * 45 / 1000
    assert d[1] == pytest.approx((2 * 300 / 1000 - a) / (1 - a)) and (d[1:] < 1).all()


def test_no_word_is_dropped_beyond_a_million(spark):
    texts = [" ".join(f"n{i}" for i in range(lo, lo + 20_000)) for lo in range(0, 1_100_000, 20_000)] + ["n7 n8 n9", "n7 n8 n1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert len(katz.fit(docs).vocabulary.hashes) == 1_100_000
    found = {r.doc_id: r.logprob for r in katz.score(docs).collect()}
    for i, lp in enumerate(brute(texts)):
        assert found[i] == pytest.approx(lp, rel=1e-7, abs=1e-3)


def test_bigrams_seen_once_are_stored_and_discounted(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    seqs = [["<s>"] + ["w" + x for x in t.split()] + ["</s>"] for t in texts]
    big = collections.Counter((a, b) for s in seqs for a, b in zip(s, s[1:]))
    d = katz.discounts(collections.Counter(big.values()))
    assert 0 < d[1] < 1
    mass = {k: (d[c] if c <= katz.K else 1.0) * c for k, c in big.items()}
    n, m = collections.Counter(), collections.Counter()
    for k, c in big.items():
        n[k[0]] += c
        m[k[0]] += mass[k]
    t = {a: c + 1 if 1 - m[a] / c <= 1e-12 else c for a, c in n.items()}
    found = {r.doc_id: r.logprob for r in katz.score(docs).collect()}
    for i, s in enumerate(seqs):
        assert found[i] == pytest.approx(sum(math.log(mass[k] / t[k[0]]) for k in zip(s, s[1:])), abs=1e-3)


def test_no_row_for_each_text_and_bucket(spark, texts):
    """What the buckets find for a block of texts comes in one row each; before, the JVM added up a row for each text and bucket."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert "HashAggregate" not in katz.score(docs)._jdf.queryExecution().executedPlan().toString()
