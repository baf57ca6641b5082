import random

import numpy as np
import pyarrow as pa
import pytest

from engramix.llm import langid


def sentence(kind, rng, n=30):
    parts = {"aa": ["tion", "ing", "the", "er"], "bb": ["ung", "sch", "der", "ß"], "cc": ["ción", "ado", "que", "ñ"]}[kind]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    data = [(sentence(k, rng), k) for k in ("aa", "bb", "cc") for _ in range(80)]
    held = [(sentence(k, rng), k) for k in ("aa", "bb", "cc") for _ in range(80)]
    return langid.train([x for x, _ in data], [y for _, y in data], [x for x, _ in held], [y for _, y in held])


def judged(model, texts):
    label, confidence, coverage = langid.score(model, pa.array(texts, pa.string()))
    return [model.labels[k] if k >= 0 else None for k in label], confidence, coverage, langid.rejects(model, label, confidence, coverage)


def test_held_out_accuracy(model):
    rng = random.Random(2)
    data = [(sentence(k, rng), k) for k in ("aa", "bb", "cc") for _ in range(100)]
    names, _, _, out = judged(model, [x for x, _ in data])
    assert model.held_out_accuracy > 0.98 and np.mean([a == y for a, (_, y) in zip(names, data)]) > 0.98
    assert out.mean() < 0.02


def test_rejects_other_scripts_and_nothing(model):
    names, confidence, coverage, out = judged(model, ["日本語の文章です" * 20, "", None, "123 $$$"])
    assert out.all() and names[1:] == [None] * 3 and confidence[1:].tolist() == [0, 0, 0]


def test_equals_a_row_by_row_average(model):
    """Brute force: hash every subword of every word by itself."""

    def bucket(gram):
        h = 0
        for k, c in enumerate(gram, 1):
            h = (h * 0x100000001B3 + ord(c) + k) % 2**64
        return ((h ^ (h >> 29)) * 0x9E3779B97F4A7C15 % 2**64) >> (64 - langid.BUCKET_BITS)

    rng = random.Random(5)
    texts = [sentence(k, rng, 9) + " Über-X 12é" for k in ("aa", "bb", "cc")] + ["x" * 5000]
    _, confidence, coverage, _ = judged(model, texts)
    for i, t in enumerate(texts):
        words, run = [], ""
        for c in t.lower() + " ":
            if c.isalpha():
                run += c
            elif run:
                words.append(f"<{run}>")
                run = ""
        grams = [bucket(w[j : j + n]) for w in words for n in range(1, langid.LONGEST + 1) for j in range(len(w) - n + 1)]
        z = model.table[grams].astype(float).mean(axis=0) + model.bias
        e = np.exp((z - z.max()) / model.temperature)
        assert confidence[i] == pytest.approx((e / e.sum()).max(), abs=1e-6)
        assert coverage[i] == pytest.approx((model.seen[grams].sum() + langid.PRIOR) / (len(grams) + langid.PRIOR))


def test_the_tail_is_continued():
    rng = np.random.default_rng(6)
    sample = 10 - rng.exponential(2.0, 4000)
    assert langid.lower_tail(sample, 0.001) == pytest.approx(10 - 2 * np.log(1000), abs=2.5)
    assert langid.lower_tail(sample, 0.2) == pytest.approx(np.quantile(sample, 0.2))
    assert langid.lower_tail(np.ones(50), 0.001) == 1


def test_table_and_filter(spark, model):
    rng = random.Random(4)
    rows = [(i, sentence(k, rng), k, "x") for i, k in enumerate(["aa", "bb", "cc"] * 20)] + [(1, None, "aa", "x"), (2, "", None, "x"), (None, sentence("aa", rng), None, None), (0, "日本語" * 50, "aa", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, predicted string")
    found = langid.identify(docs, model, carry=("doc_id",)).collect()
    assert len(found) == 64 and sum(r.rejected for r in found) == 3
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.count() == 61
    assert langid.keep_identified(docs.limit(0)).collect() == []
    assert langid.identify(docs.filter("text = ''")).collect()[0].rejected
    own = langid.identify(docs, sample_per_label=10, carry=("doc_id", "lang")).filter("lang = predicted").count()
    assert own >= 57


def test_the_table_keeps_its_own_and_rejects_others(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    own = langid.fit(docs)
    assert own.held_out_accuracy > 0.95
    found = langid.identify(docs, own, carry=("doc_id", "lang")).collect()
    assert sum(r.rejected for r in found) <= 5 and sum(r.lang == r.predicted for r in found) >= 950
    others = ["Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. " * 4, "すべての人間は、生まれながらにして自由であり" * 5, "Все люди рождаются свободными и равными в своем достоинстве и правах. " * 4, "1234 5678"]
    assert judged(own, others)[3].all()
