import hashlib
import math

import pytest
from pyspark.sql import functions as F

from engramix.llm import mixing

ROWS = [(i, "w " * (i % 7 + 1), ["a", "b", None][i % 3]) for i in range(60)] + [(5, "w " * 6, None), (None, "no id", "a"), (None, None, "b"), (70, "", "empty"), (71, None, "empty")]


def brute(rows, weights, default, seed):
    tokens = {}
    for _, t, s in rows:
        tokens[s] = tokens.get(s, 0) + len((t or "").split())
    w = {s: weights.get(s, default) if s is not None else default for s in tokens}
    total, share = sum(tokens.values()), sum(w[s] for s in tokens if tokens[s])
    out = []
    for i, t, s in rows:
        rate = 1.0 if not tokens[s] else total * (w[s] / share) / tokens[s] if share else 0.0
        u = int(hashlib.md5(f"{seed}:{i if i is not None else 'text:' + (t or '')}".encode()).hexdigest()[:13], 16) / 2**52
        n = math.floor(rate) + (u < rate - math.floor(rate))
        out += [(i, t, s, k + 1) for k in range(n)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, source string")


@pytest.mark.parametrize("weights,default", [({"a": 3.0}, 1.0), ({}, 1.0), ({"a": 0.0, "b": 0.0}, 0.0), ({"b": 9.0}, 0.25)])
def test_equals_brute_force(docs, weights, default):
    found = sorted([tuple(r) for r in mixing.mix_sources(docs, weights, default).collect()], key=str)
    assert found == brute(ROWS, weights, default, mixing.SEED)


def test_the_shuffle_join_gives_the_same(docs):
    a = mixing.mix_sources(docs, {"a": 3.0}).collect()
    b = mixing.mix_sources(docs, {"a": 3.0}, most_broadcast_sources=1).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_weights_are_met(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), F.when(F.col("id") % 10 == 0, "rare").otherwise("hot").alias("source"))
    n = {r["source"]: r["count"] for r in mixing.mix_sources(docs, {"rare": 1.0, "hot": 1.0}).groupBy("source").count().collect()}
    assert n["rare"] == 2000 and abs(n["hot"] - 2000) < 120


def test_clashing_columns_and_empty_tables(spark, docs):
    more = docs.withColumn("copy", F.lit("x")).withColumn("mix_rate", F.lit(1)).withColumn("tokens", F.lit(2)).withColumn("a.b", F.lit(3))
    found = mixing.mix_sources(more, {"a": 3.0})
    assert found.columns == [*more.columns, "copy_"] and found.count() == mixing.mix_sources(docs, {"a": 3.0}).count()
    assert mixing.mix_sources(docs.limit(0), {"a": 3.0}).collect() == []
    assert mixing.mix_sources(docs, {"a": 3.0}, copy_column=None).columns == docs.columns
    with pytest.raises(ValueError):
        mixing.mix_sources(docs, {"a": -1.0})
