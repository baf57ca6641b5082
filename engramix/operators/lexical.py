"""Many terms in many texts: one pass over each text, whatever the number of terms."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

#: Distinct terms that one automaton (about 200 bytes each) holds in a worker.
MOST_TERMS = 200_000


def matches(texts: DataFrame, terms: DataFrame, ident: str) -> DataFrame:
    """(ident, t): the terms (t) that each text holds anywhere.

    ``texts`` is (ident, low), ``terms`` distinct. The terms go into one automaton that reads
    each text once; beyond ``MOST_TERMS`` they are cut into as many automata as it takes, by
    hash, each of which reads the texts again.
    """
    parts = max(1, -(-12 * terms.count() // (10 * MOST_TERMS)))
    schema = T.StructType([texts.schema[ident], T.StructField("t", T.StringType())])
    out = None
    for k in range(parts):
        own = sorted(r.t for r in (terms if parts == 1 else terms.filter(F.pmod(F.xxhash64("t"), F.lit(parts)) == k)).select("t").collect())
        one = texts.select(ident, "low").mapInArrow(_scan(texts.sparkSession.sparkContext.broadcast(own), ident), schema)
        out = one if out is None else out.unionByName(one)
    return out


def _scan(shared, ident: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = ahocorasick.Automaton()
        for k, t in enumerate(shared.value):
            trie.add_word(t, k)
        trie.make_automaton()
        for batch in batches:
            ids, rows = [], []
            for k, low in enumerate(batch.column(1).to_pylist()):
                for n in {n for _, n in trie.iter(low)} if low and len(trie) else ():
                    ids.append(k)
                    rows.append(shared.value[n])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(rows, pa.string())], names=[ident, "t"])

    return scan


def term_pairs(texts: DataFrame, asked: DataFrame, ident: str, question: str) -> DataFrame:
    """(ident, question, hits): how many of a question's terms (question, terms) a text holds, where it holds one."""
    by_term = asked.select(question, F.explode("terms").alias("t"))
    seen = matches(texts, by_term.select("t").distinct(), ident)
    return seen.join(by_term, "t").groupBy(ident, question).agg(F.count("*").alias("hits"))
