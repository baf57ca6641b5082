"""run() against a brute-force version: the language model's own verdicts, all pairs, exact rates, a public encoder."""

import collections
import hashlib
import math
import pathlib
import random

import pytest
import tiktoken

import corpus_pipeline
from engramix.llm import bpe, jaccard, langid, mixing
from .test_jaccard import brute
from .test_langid import sentence


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    rows = []
    for k in range(120):
        text = sentence(("aa", "bb", "cc")[k % 3], rng, 30)
        for _ in range(rng.choice([1, 1, 3])):
            words = [w + "er" if rng.random() < 0.02 else w for w in text.split()]
            rows.append((len(rows), " ".join(words), ("aa", "bb", "cc")[k % 3], f"src{rng.choice([0, 0, 1, 2, 3])}", 1))
    rows += [(1000, "日本語" * 40, None, "src0", 1), (1001, "", "aa", "src1", 0), (1002, None, "aa", "src1", 0)]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path), rows


def test_equals_brute_force(spark, corpus):
    path, rows = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    verdict = {r.doc_id: r.rejected for r in langid.identify(docs).collect()}
    assert verdict[1000] and verdict[1001] and verdict[1002] and sum(verdict.values()) < 10
    left = [r for r in rows if not verdict[r[0]]]
    root = {r[0]: r[0] for r in left}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in brute([(r[0], r[1]) for r in left], jaccard.N, jaccard.THRESHOLD):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    left = [r for r in left if find(r[0]) == r[0]]
    assert 100 <= len(left) <= 130
    count = collections.Counter()
    for r in left:
        count[r[3]] += len(r[1].split())
    weight = {s: mixing.PRODUCTION_WEIGHTS.get(s, 1.0) for s in count}
    want = collections.Counter()
    for r in left:
        rate = sum(count.values()) * weight[r[3]] / sum(weight.values()) / count[r[3]]
        u = int(hashlib.md5(f"{mixing.SEED}:{r[0]}".encode()).hexdigest()[:13], 16) / 2**52
        want[r[0]] = math.floor(rate) + (u < rate - math.floor(rate))
    found = corpus_pipeline.run(spark, path).collect()
    assert collections.Counter(r.doc_id for r in found) == +want
    with open(bpe.VOCABULARY, "rb") as f:
        public = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.ByteBPE(f.read()).ranks, special_tokens={})
    text = {r[0]: r[1] for r in rows}
    for r in found:
        assert r.token_ids == public.encode_ordinary(text[r.doc_id]) and r.round_trip


def test_stages_keep_the_columns(spark, corpus):
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, corpus[0]).columns == docs.columns
        assert stage(spark, docs.limit(0), corpus[0]).count() == 0


def test_run_holds_the_texts_of_one_stage_at_a_time(spark, corpus):
    shared = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = {p.name for p in shared.rglob("pipeline-*")}
    assert corpus_pipeline.run(spark, corpus[0]).count() > 0
    left = [p.name for p in shared.rglob("pipeline-*") if p.name not in before and p.is_dir()]
    assert len(left) == 1 and left[0].startswith("pipeline-mix_sources")
