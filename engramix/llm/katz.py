"""Language-model scoring with a Katz backoff bigram model.

Counts cover every word of every document. Unigram counts give the vocabulary: all words, at
every size (only a caller that names ``most_words`` closes it; the others are then one class,
<unk>). What is known of each word lies in files in the shared folder, sorted by hash, which
workers map into memory; nothing of it is broadcast or gathered by the driver.
Bigram counts are gathered by an exchange of each block's distinct bigrams and stored as a
table of buckets. All are stored; only a caller that names a higher ``least_count`` leaves the
rarer ones to backoff. Counts up to K are discounted
by Good-Turing from the exact counts of counts, and what that frees goes to the words a
context wasn't stored with:

    p(w | v) = d c(vw) / c(v)        if vw is stored
             = alpha(v) p(w)         otherwise
    alpha(v) = (1 - sum of the stored p(. | v)) / (1 - sum of their p(.))

so every context's probabilities add up to 1. A token is evaluated from the top: the stored
bigram if there is one, else the context's backoff weight and the unigram, else <unk>.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import files
from .shared import WORD, byte_slices, coded_words, col, drop, enough_parts, free_shuffles, fresh_path, frugal, frugal_group, frugal_pair, keep, mix64, planes, settled, shuffle_partitions, spare_name, unplanes

#: Of a word's id; ids 0, 1, 2 are <unk>, </s> and <s>. Two ids make a bigram's key.
BITS = 31
K = 5
LEAST_COUNT = 1
_TINY = 1e-12
#: Words that a mapper gathers before it sends their bigrams on.
_BLOCK = 500_000
#: Ids whose entries one task writes, or the driver at once.
_CHUNK = 1 << 20


def discounts(n: dict[int, int]) -> np.ndarray:
    """d[r] for r = 0..K from the counts of counts n[1..K+1]; 1 where Good-Turing has no answer between 0 and 1."""
    d = np.ones(K + 1)
    a = (K + 1) * n.get(K + 1, 0) / n[1] if n.get(1) else 1.0
    for r in range(1, K + 1):
        if n.get(r) and a < 1:
            x = ((r + 1) * n.get(r + 1, 0) / (r * n[r]) - a) / (1 - a)
            d[r] = x if 0 < x < 1 else 1.0
    return d


@dataclass(frozen=True)
class Vocabulary:
    """Files in ``folder``, mapped where they are read; only the folder's name is sent to the workers."""

    folder: str
    total: int  # of all counts, <s> included

    def __reduce__(self):
        return Vocabulary, (self.folder, self.total)

    @cached_property
    def hashes(self) -> np.ndarray:
        """Sorted; the word at place i has id i + 3."""
        return files.mapped(f"{self.folder}/hashes", np.uint64)

    @cached_property
    def counts(self) -> np.ndarray:
        """By id; of <s>, the number of texts."""
        return files.mapped(f"{self.folder}/counts", np.int64)

    @cached_property
    def p(self) -> np.ndarray:
        """Unigram probability by id; 0 for <s>."""
        return files.mapped(f"{self.folder}/p", np.float64)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(hashes), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at + 3, 0)

    def split(self, ctx: np.ndarray, buckets: int) -> np.ndarray:
        """Over how many buckets each context's bigrams are spread."""
        return np.ceil(self.counts[ctx] * (4.0 * buckets) / max(1, self.total)).clip(1, buckets).astype(np.uint64)


@dataclass(frozen=True)
class Weights:
    """By context, in the vocabulary's folder."""

    folder: str

    def __reduce__(self):
        return Weights, (self.folder,)

    @cached_property
    def alpha(self) -> np.ndarray:
        """Log backoff weight."""
        return files.mapped(f"{self.folder}/alpha", np.float64)

    @cached_property
    def total(self) -> np.ndarray:
        """Divisor."""
        return files.mapped(f"{self.folder}/total", np.float64)


@dataclass(frozen=True)
class KatzModel:
    vocabulary: Vocabulary
    weights: Weights
    d: np.ndarray
    buckets: int
    bigrams: DataFrame  # (bucket, keys, counts): ctx << BITS | word, stored only

    @property
    def alpha(self) -> np.ndarray:
        return self.weights.alpha

    @property
    def total(self) -> np.ndarray:
        return self.weights.total


def _word_counts(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        count: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal held, count
            u, inverse = np.unique(np.concatenate(held), return_inverse=True)
            n = np.bincount(inverse, weights=np.concatenate(count)).astype(np.int64)
            held, count = [], []
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], names=["word", "n"])

        for batch in batches:
            for a, b in byte_slices(batch.column(0)):
                _, number, each = coded_words(batch.column(0).slice(a, b - a))
                held.append(each)
                count.append(np.bincount(number, minlength=len(each)))
                if sum(map(len, held)) > _BLOCK:
                    yield flush()
        if held:
            yield flush()

    return docs.mapInArrow(frugal(run), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, most_words: int | None = None) -> Vocabulary:
    """Of the column text, whose nulls are left out. Only the histogram of counts and the sizes of the parts reach the driver's memory."""
    spark = docs.sparkSession
    texts = docs.count()
    words = keep(_word_counts(docs), "lm-words")
    histogram = {r.n: r.k for r in words.groupBy("n").agg(F.count("*").alias("k")).collect()}
    least, held = 1, sum(histogram.values())
    for n in sorted(histogram):
        if most_words is None or held <= most_words:
            break
        held -= histogram[n]
        least = n + 1
    if held + 3 > 1 << BITS:
        raise ValueError(f"{held} distinct words; ids have {BITS} bits")
    folder = fresh_path(spark, "lm-vocabulary")
    files.make_dir(folder)
    bits = max(1, math.ceil(math.log2(max(2 * shuffle_partitions(spark), held / _CHUNK))))

    def write(table: pa.Table) -> pa.Table:
        h = table.column("word").to_numpy().view(np.uint64)
        order = np.argsort(h)
        part, n = table.column("part")[0].as_py(), table.column("n").to_numpy()
        for name, x in (("hashes", h[order]), ("counts", n[order])):
            files.write_whole(f"{folder}/{name}-{part}", lambda stream, x=x: stream.write(x.tobytes()))
        return pa.table({"part": pa.array([part]), "n": pa.array([int(n.sum())])})

    parts = words.filter(F.col("n") >= least).withColumn("part", F.shiftrightunsigned("word", 64 - bits)).groupBy("part").applyInArrow(frugal_group(write), "part long, n long").collect()
    drop(words)
    total = sum(n * k for n, k in histogram.items()) + texts
    special = np.array([total - texts - sum(r.n for r in parts), texts, texts], dtype=np.int64)
    names = sorted(r.part for r in parts)
    files.join_whole(f"{folder}/hashes", [f"{folder}/hashes-{k}" for k in names])
    files.join_whole(f"{folder}/counts", [special.tobytes(), *[f"{folder}/counts-{k}" for k in names]])
    v = Vocabulary(folder, int(total + texts))
    if texts:
        histogram[texts] = histogram.get(texts, 0) + 1
    d = discounts(histogram)

    def discounted(counts: np.ndarray) -> np.ndarray:
        return np.where(counts <= K, d[np.minimum(counts, K)], 1.0) * counts / max(total, 1)

    chunks = [slice(lo, lo + _CHUNK) for lo in range(0, len(v.counts), _CHUNK)]
    freed = 1 - math.fsum(discounted(v.counts[c]).sum() for c in chunks) + discounted(v.counts[[0, 2]]).sum()

    def write_p(stream) -> None:
        for c in chunks:
            p = discounted(v.counts[c]) if freed > _TINY else v.counts[c] / (total + 1)
            if c.start == 0:
                p[0], p[2] = freed if freed > _TINY else 1 / (total + 1), 0
            stream.write(p.tobytes())

    files.write_whole(f"{folder}/p", write_p)
    return v


def _bucket(ctx: np.ndarray, word: np.ndarray, v: Vocabulary, buckets: int) -> np.ndarray:
    """Bigrams of a context meet in one bucket; those of a frequent context are spread over several by word."""
    own = mix64(ctx.astype(np.uint64) + np.uint64(1))
    part = mix64(word.astype(np.uint64) + np.uint64(77)) % v.split(ctx, buckets)
    return ((own + part) % np.uint64(buckets)).astype(np.int64)


def _sequences(v: Vocabulary, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, word, number of the text) of every token, </s> at the end of each text included."""
    at, number, each = coded_words(texts)
    ids = v.ids(each)[number]
    n = np.diff(at)
    ends = np.cumsum(n + 1) - 1
    word = np.empty(len(ids) + len(n), dtype=np.int64)
    inner = np.ones(len(word), dtype=bool)
    inner[ends] = False
    word[inner], word[ends] = ids, 1
    ctx = np.empty_like(word)
    ctx[1:] = word[:-1]
    ctx[np.concatenate([[0], ends[:-1] + 1])] = 2
    return ctx, word, np.repeat(np.arange(len(n)), n + 1)


def _runs(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.empty(0, dtype=np.int64)
    return sorted_[edge], np.diff(np.append(edge, len(sorted_)))


def _by_bucket(key: np.ndarray, v: Vocabulary, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    bucket = _bucket(key >> BITS, key & (1 << BITS) - 1, v, buckets)
    order = np.argsort(bucket, kind="stable")
    edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for k in np.flatnonzero(np.diff(edge)):
        yield int(k), order[edge[k] : edge[k + 1]]


def fit(docs: DataFrame, most_words: int | None = None, *, text: str = "text", least_count: int = LEAST_COUNT) -> KatzModel:
    """The model of all texts of ``docs``. Two passes; each sends on only the distinct words or bigrams of a block with their counts."""
    spark = docs.sparkSession
    given = docs.select(col(docs, text).cast("string").alias("text")).filter("text IS NOT NULL")
    v = vocabulary(given, most_words)
    buckets = enough_parts(given, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal held
            key = np.concatenate(held)
            key.sort()
            key, n = _runs(key)
            held = []
            rows = [(k, planes(key[own]), n[own].astype(np.uint32).tobytes()) for k, own in _by_bucket(key, v, buckets)]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "keys", "counts"])

        for batch in batches:
            for a, b in byte_slices(batch.column(0)):
                ctx, word, _ = _sequences(v, batch.column(0).slice(a, b - a))
                held.append((ctx << BITS) | word)
                if sum(map(len, held)) > _BLOCK:
                    yield flush()
        if held:
            yield flush()

    def add(table: pa.Table) -> pa.Table:
        key = np.concatenate([unplanes(x).view(np.int64) for x in table.column("keys").to_pylist()])
        n = np.concatenate([np.frombuffer(x, dtype=np.uint32) for x in table.column("counts").to_pylist()])
        order = np.argsort(key, kind="stable")
        key, size = _runs(key[order])
        n = np.add.reduceat(n[order].astype(np.int64), np.cumsum(size) - size)
        few = np.bincount(np.minimum(n, K + 2), minlength=K + 3)[: K + 2]
        stored = n >= least_count
        return pa.table({"bucket": table.column("bucket").slice(0, 1), "keys": pa.array([planes(key[stored])], pa.binary()), "counts": pa.array([n[stored].tobytes()], pa.binary()), "few": pa.array([few.tolist()], pa.list_(pa.int64()))})

    bigrams = keep(given.mapInArrow(frugal(run), "bucket int, keys binary, counts binary").groupBy("bucket").applyInArrow(frugal_group(add), "bucket int, keys binary, counts binary, few array<long>"), "lm-bigrams")
    free_shuffles(spark)
    few = bigrams.select(*[F.sum(F.col("few")[r]).alias(f"n{r}") for r in range(K + 2)]).first()
    d = discounts({r: few[r] or 0 for r in range(1, K + 2)})
    return KatzModel(v, _backoff(bigrams, v, d), d, buckets, bigrams.select("bucket", "keys", "counts"))


def _backoff(bigrams: DataFrame, v: Vocabulary, d: np.ndarray) -> Weights:
    """Each bucket sends on, for every slice of the contexts' ids, its sums for those contexts in one row; a context of several buckets is added up where its slice is written."""
    size = min(_CHUNK, -(-len(v.counts) // shuffle_partitions(bigrams.sparkSession)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = v.p
        for batch in batches:
            for keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                key, n = unplanes(keys).view(np.int64), np.frombuffer(counts, dtype=np.int64)
                if not len(key):
                    continue
                ctx, times = _runs(key >> BITS)
                at = np.cumsum(times) - times
                mass = np.add.reduceat(np.where(n <= K, d[np.minimum(n, K)], 1.0) * n, at)
                low = np.add.reduceat(p[key & (1 << BITS) - 1], at)
                part, n = _runs(ctx // size)
                ends = np.cumsum(n)
                own = [slice(b - k, b) for b, k in zip(ends, n)]
                yield pa.RecordBatch.from_arrays([pa.array(part), *[pa.array([f(x[s]) for s in own], pa.binary()) for f, x in ((lambda y: planes(y.view(np.uint64)), ctx), (np.ndarray.tobytes, mass), (np.ndarray.tobytes, low))]], names=["part", "ctx", "mass", "low"])

    def weights(part: int, ctx: np.ndarray, its_mass: np.ndarray, its_low: np.ndarray) -> dict[str, np.ndarray]:
        counts = v.counts[part * size : (part + 1) * size]
        mass, low = (np.bincount(ctx - part * size, weights=x, minlength=len(counts)) for x in (its_mass, its_low))
        total = np.maximum(counts, 1).astype(np.float64)
        total = np.where(1 - mass / total <= _TINY, total + 1, total)
        return {"alpha": np.log((1 - mass / total) / np.maximum(1 - low, _TINY)), "total": total}

    def write(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        ctx = np.concatenate([unplanes(x).view(np.int64) for x in table.column("ctx").to_pylist()])
        for name, x in weights(part, ctx, *(np.concatenate([np.frombuffer(x, dtype=np.float64) for x in table.column(c).to_pylist()]) for c in ("mass", "low"))).items():
            files.write_whole(f"{v.folder}/{name}-{part}", lambda stream, x=x: stream.write(x.tobytes()))
        return pa.table({"part": pa.array([part])})

    sums = bigrams.select("keys", "counts").mapInArrow(frugal(run), "part long, ctx binary, mass binary, low binary")
    made = {r.part for r in sums.groupBy("part").applyInArrow(frugal_group(write), "part long").collect()}
    free_shuffles(bigrams.sparkSession)
    nothing = np.empty(0, dtype=np.int64)
    for name in ("alpha", "total"):
        parts = range(-(-len(v.counts) // size))
        files.join_whole(f"{v.folder}/{name}", (f"{v.folder}/{name}-{k}" if k in made else weights(k, nothing, nothing, nothing)[name].tobytes() for k in parts))
    return Weights(v.folder)


def score(docs: DataFrame, model: KatzModel | None = None, *, text: str = "text", carry: tuple[str, ...] = ("doc_id",), least_count: int = LEAST_COUNT) -> DataFrame:
    """Columns ``carry``, then n_tokens, logprob (natural) and perplexity of every row; without ``model``, that of ``docs`` itself.

    Each mapper scores its tokens as if all backed off; the buckets of the stored bigrams send
    back, for each block of texts in one row, what their tokens have above that. Neither the texts nor the bigrams
    nor the vocabulary are broadcast.

    Defined results: null text gives nulls; a text without a word has one token, its end;
    words outside the vocabulary count as <unk>; repeated rows are each scored; an empty
    table gives an empty table; a carried column keeps its name, and a new one of the same name
    gets underscores. logprob and perplexity are rounded to 4 places.
    """
    model = model or fit(docs, text=text, least_count=least_count)
    spark = docs.sparkSession
    buckets, d = model.buckets, model.d
    v, weights = model.vocabulary, model.weights
    names = [f"c{i}" for i in range(len(carry))]
    own = settled(docs.select(*[col(docs, c).alias(n) for c, n in zip(carry, names)], col(docs, text).cast("string").alias("text")), "lm-texts")
    ddl = own.select(*names).schema
    schema = own.sparkSession.createDataFrame([], "bucket int, block long, keys binary, texts binary, key long, base double, n long").schema
    for f in ddl:
        schema = schema.add(f.name, f.dataType, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32

        def made(bucket, keys, of, key, base, n, others):
            k = len(others[0]) if others else len(key if key is not None else bucket)
            null = lambda t: pa.nulls(k, t)
            return pa.RecordBatch.from_arrays([bucket, pa.array([block] * k, pa.int64()), keys if keys is not None else null(pa.binary()), of if of is not None else null(pa.binary()), key if key is not None else null(pa.int64()), base if base is not None else null(pa.float64()), n if n is not None else null(pa.int64()), *others], names=schema.names)

        for batch in batches:
            texts = batch.column(len(names))
            for lo, hi in byte_slices(texts):
                for lo in range(lo, hi, 60_000):
                    part = texts.slice(lo, min(60_000, hi - lo))
                    missing = np.array(part.is_null())
                    ctx, word, of = _sequences(v, part)
                    base = np.bincount(of, weights=weights.alpha[ctx] + np.log(v.p[word]), minlength=len(part))
                    yield made(pa.array((block + np.arange(len(part))) % buckets, pa.int32()), None, None, pa.array(block + np.arange(len(part))), pa.array(base, mask=missing), pa.array(np.bincount(of, minlength=len(part)), mask=missing), [batch.column(i).slice(lo, len(part)) for i in range(len(names))])
                    live = ~missing[of]
                    key, of = (ctx[live] << BITS) | word[live], of[live].astype(np.uint16)
                    order = np.argsort(key, kind="stable")
                    key, of = key[order], of[order]
                    rows = [(k, planes(key[own]), of[own].tobytes()) for k, own in _by_bucket(key, v, buckets)]
                    if rows:
                        yield made(*[pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], None, None, None, [pa.nulls(len(rows), batch.column(i).type) for i in range(len(names))])
                    block += len(part)

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        own = left.filter(left.column("key").is_valid())
        nothing = pa.nulls(own.num_rows, pa.binary())
        tables = [pa.Table.from_arrays([*(own.column(c) for c in ("block", "key", "base", "n")), nothing, nothing, *(own.column(c) for c in names)], names=out.names)]
        found: list[tuple[int, bytes, bytes]] = []
        stored = [unplanes(x).view(np.int64) for x in right.column("keys").to_pylist()]
        if stored and len(stored[0]):
            stored, n = stored[0], np.frombuffer(right.column("counts")[0].as_py(), dtype=np.int64)
            ctx, word = stored >> BITS, stored & (1 << BITS) - 1
            above = np.log(np.where(n <= K, d[np.minimum(n, K)], 1.0) * n / weights.total[ctx]) - weights.alpha[ctx] - np.log(v.p[word])
            for block, keys, of in zip(*(left.column(c).to_pylist() for c in ("block", "keys", "texts"))):
                if keys is None:
                    continue
                pair, times = _runs(unplanes(keys).view(np.int64))
                at = np.minimum(np.searchsorted(stored, pair), len(stored) - 1)
                gain = np.repeat(np.where(stored[at] == pair, above[at], 0.0), times)
                of = np.frombuffer(of, dtype=np.uint16).astype(np.int64)
                used = np.unique(of[gain != 0])
                sums = np.bincount(of, weights=gain, minlength=65536)[used]
                found.append((block, used.astype(np.uint16).tobytes(), sums.tobytes()))
        if found:
            block, of, sums = zip(*found)
            null = lambda t: pa.nulls(len(found), t)
            tables.append(pa.Table.from_arrays([pa.array(block, pa.int64()), null(pa.int64()), null(pa.float64()), null(pa.int64()), pa.array(of, pa.binary()), pa.array(sums, pa.binary()), *[null(left.schema.field(c).type) for c in names]], schema=tables[0].schema))
        return pa.concat_tables(tables)

    def add(table: pa.Table) -> pa.Table:
        """For one block of texts: what they have by backoff, and what the buckets found above that."""
        own = table.filter(table.column("key").is_valid())
        found = table.filter(table.column("texts").is_valid())
        base = own.column("base").to_numpy(zero_copy_only=False)
        at = own.column("key").to_numpy() - own.column("block").to_numpy()
        if found.num_rows:
            of, sums = (np.concatenate([np.frombuffer(x, dtype=t) for x in found.column(c).to_pylist()]) for c, t in (("texts", np.uint16), ("sums", np.float64)))
            base = base + np.bincount(of, weights=sums, minlength=own.num_rows)[at]
        logprob = pa.array(base, mask=np.array(own.column("base").combine_chunks().is_null()))
        return pa.Table.from_arrays([logprob, own.column("n"), *(own.column(c) for c in names)], names=["logprob", "n_tokens", *names])

    out, total = (docs.sparkSession.createDataFrame([], x).schema for x in ("block long, key long, base double, n long, texts binary, sums binary", "logprob double, n_tokens long"))
    for f in ddl:
        out, total = out.add(f.name, f.dataType, True), total.add(f.name, f.dataType, True)
    parts = own.mapInArrow(frugal(run), schema).groupBy("bucket").cogroup(model.bigrams.groupBy("bucket")).applyInArrow(frugal_pair(join), out)
    summed = parts.groupBy("block").applyInArrow(frugal_group(add), total)
    carried = docs.select(*[col(docs, c) for c in carry])
    count, sum_, each = (spare_name(carried, c) for c in ("n_tokens", "logprob", "perplexity"))
    return summed.select(*[F.col(n).alias(c) for c, n in zip(carry, names)], F.col("n_tokens").alias(count), F.round("logprob", 4).alias(sum_), F.round(F.exp(-F.col("logprob") / F.col("n_tokens")), 4).alias(each))


def _d_sql(n: str) -> str:
    """d_1..d_K as columns of one row, from the counts of counts in table ``n`` (r, k)."""
    at = lambda r: f"coalesce((SELECT k FROM {n} WHERE r = {r}), 0)::DOUBLE"
    a = f"CASE WHEN {at(1)} > 0 THEN {K + 1} * {at(K + 1)} / {at(1)} ELSE 1.0 END"
    raw = ", ".join(f"CASE WHEN {at(r)} > 0 AND a < 1 THEN ({r + 1} * {at(r + 1)} / ({r} * {at(r)}) - a) / (1 - a) ELSE 1.0 END AS x{r}" for r in range(1, K + 1))
    return "SELECT " + ", ".join(f"CASE WHEN x{r} > 0 AND x{r} < 1 THEN x{r} ELSE 1.0 END AS d{r}" for r in range(1, K + 1)) + f" FROM (SELECT {raw} FROM (SELECT {a} AS a))"


def _pick(prefix: str) -> str:
    return "CASE c " + " ".join(f"WHEN {r} THEN {prefix}.d{r}" for r in range(1, K + 1)) + " ELSE 1.0 END"


def oracle() -> str:
    """DuckDB SQL for :func:`score` over documents."""
    return f"""
WITH texts AS (SELECT doc_id, row_number() OVER () AS row, ['s'] || list_transform(regexp_extract_all(text, '{WORD}'), lambda w: 'w' || w) || ['e'] AS w FROM documents WHERE text IS NOT NULL),
tokens AS (SELECT row, unnest(w[:-2]) AS ctx, unnest(w[2:]) AS word FROM texts),
uni AS (SELECT word, count(*) AS c FROM tokens GROUP BY word),
n1 AS (SELECT c AS r, count(*) AS k FROM uni GROUP BY c), n1d AS ({_d_sql('n1')}),
total AS (SELECT sum(c)::DOUBLE AS n FROM uni),
low0 AS (SELECT word, c, {_pick('n1d')} * c / n AS p FROM uni, n1d, total),
unk AS (SELECT 1 - sum(p) AS p FROM low0),
low AS (SELECT word, CASE WHEN unk.p > {_TINY} THEN low0.p ELSE c / (n + 1) END AS p FROM low0, unk, total),
big AS (SELECT ctx, word, count(*) AS c FROM tokens GROUP BY ctx, word),
n2 AS (SELECT c AS r, count(*) AS k FROM big GROUP BY c), n2d AS ({_d_sql('n2')}),
ctxs AS (SELECT ctx, sum(c)::DOUBLE AS t FROM big GROUP BY ctx),
stored AS (SELECT ctx, big.word, {_pick('n2d')} * c AS m, p AS low FROM big JOIN low ON big.word = low.word, n2d WHERE c >= {LEAST_COUNT}),
sums AS (SELECT ctx, sum(m) AS m, sum(low) AS low FROM stored GROUP BY ctx),
back AS (SELECT ctx, CASE WHEN 1 - coalesce(m, 0) / t <= {_TINY} THEN t + 1 ELSE t END AS t, coalesce(m, 0) AS m, coalesce(low, 0) AS low FROM ctxs LEFT JOIN sums USING (ctx)),
each AS (SELECT row, ln(CASE WHEN stored.m IS NOT NULL THEN stored.m / back.t ELSE (1 - back.m / back.t) / greatest(1 - back.low, {_TINY}) * low.p END) AS lp
  FROM tokens JOIN back ON tokens.ctx = back.ctx JOIN low ON tokens.word = low.word LEFT JOIN stored ON tokens.ctx = stored.ctx AND tokens.word = stored.word),
docs AS (SELECT row, count(*) AS n, sum(lp) AS lp FROM each GROUP BY row)
SELECT doc_id, n AS n_tokens, round(lp, 4) AS logprob, round(exp(-lp / n), 4) AS perplexity FROM texts JOIN docs USING (row)
UNION ALL SELECT doc_id, NULL, NULL, NULL FROM documents WHERE text IS NULL
"""
