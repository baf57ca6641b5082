"""Language identification: averaged hashed subword embeddings under a linear softmax.

A document is the average of the embeddings of all its subwords: the character n-grams of 1
to 4 of every word (runs of letters, lower case, with marks at both ends), hashed into a fixed
number of buckets. The softmax over that average is linear, so for scoring the embeddings are
multiplied by its weights once, and each distinct word of a slice is summed once.

The model is trained by stochastic gradient descent in numpy on a bounded sample of labelled
documents. A second sample of the same bound calibrates it: one temperature for the softmax,
and two thresholds (confidence, and the share of subwords met in training) that about the
fraction ``alpha`` of such documents falls below each. That is rarer than the sample can show,
so the sample's lowest twentieth is continued by an exponential tail, of the log odds of the
confidence and of the logarithm of the unmet share.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .shared import byte_slices, col, frugal, give_back, with_fields

BUCKET_BITS = 18
DIMENSIONS = 16
LONGEST = 4
#: Labelled documents of each label in the training sample and, apart from them, in the calibration sample.
SAMPLE_PER_LABEL = 400
ALPHA = 0.0002
#: Share of the calibration sample that its tail is fitted to.
TAIL = 0.05
#: Subwords that count as met besides a document's own, so that a few new ones don't reject a short text.
PRIOR = 50
SEED = 29

_MARKS = pa.scalar("<"), pa.scalar(">"), pa.scalar("")


@dataclass(frozen=True)
class LanguageModel:
    labels: tuple[str, ...]
    table: np.ndarray  # buckets x labels: embedding times softmax weights
    bias: np.ndarray
    seen: np.ndarray  # buckets met in training
    temperature: float
    least_confidence: float
    least_coverage: float
    held_out_accuracy: float


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """For each text where its words start (one entry more), the words' numbers, and the distinct words."""
    lists = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), r"[^\p{L}\p{M}]+")
    coded = pc.list_flatten(lists).dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    return lists.offsets.to_numpy() - lists.offsets[0].as_py(), coded.indices.to_numpy(), coded.dictionary


def _subwords(words: pa.Array) -> Iterator[tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """For slices of words: where each word's characters start, and for each length n the buckets and the places that have one."""
    at = 0
    size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    ends = np.cumsum(size)
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 500_000, side="right")))
        part = pc.binary_join_element_wise(_MARKS[0].cast(words.type), words.slice(at, to - at), _MARKS[1].cast(words.type), _MARKS[2].cast(words.type))
        cp = np.frombuffer("".join(part.to_pylist()).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        n = size[at:to]
        start = np.concatenate([[0], np.cumsum(n)[:-1]])
        left = np.repeat(start + n, n) - np.arange(len(cp))  # characters from here to the word's end
        empty = np.repeat(n == 2, n)  # splitting leaves empty words, which have no subwords
        grams, h = [], np.zeros(len(cp), dtype=np.uint64)
        for k in range(1, LONGEST + 1):
            h = h[: len(cp) - k + 1] * np.uint64(0x100000001B3) + cp[k - 1 :] + np.uint64(k)
            mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
            grams.append(((mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), (left[: len(h)] >= k) & ~empty[: len(h)]))
        yield start, grams
        at = to


def _bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, counts) of each text, whole; a hundred texts at a time, for the driver's memory."""
    return [bag for lo in range(0, len(texts), 100) for bag in _bags_of(texts[lo : lo + 100])]


def _bags_of(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    at, number, words = _words(pa.array(texts, pa.large_string()))
    per_word: list[np.ndarray] = []
    for start, grams in _subwords(words):
        place = np.concatenate([np.flatnonzero(ok) for _, ok in grams])
        bucket = np.concatenate([b[ok] for b, ok in grams])
        word = np.searchsorted(start, place, side="right") - 1
        order = np.argsort(word, kind="stable")
        per_word += np.split(bucket[order], np.searchsorted(word[order], np.arange(1, len(start))))
    out = []
    for i in range(len(texts)):
        w, n = np.unique(number[at[i] : at[i + 1]], return_counts=True)
        b = np.concatenate([per_word[k] for k in w]) if len(w) else np.empty(0, dtype=np.int64)
        c = np.repeat(n, [len(per_word[k]) for k in w]) if len(w) else np.empty(0, dtype=np.int64)
        u, inverse = np.unique(b, return_inverse=True)
        out.append((u, np.bincount(inverse, weights=c, minlength=len(u))))
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _averages(embedding: np.ndarray, bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    return np.stack([(n[:, None] * embedding[b]).sum(axis=0) / n.sum() for b, n in bags])


def train(texts: list[str], labels: list[str], calibration: list[str], calibration_labels: list[str], *, alpha: float = ALPHA, epochs: int = 8, rate: float = 20.0, batch: int = 16, seed: int = SEED) -> LanguageModel | None:
    """Train and calibrate; texts without a letter are left out. None if no text is left to train on."""
    bags = [(b, y) for b, y in zip(_bags(texts), labels) if len(b[0])]
    held = [(b, y) for b, y in zip(_bags(calibration), calibration_labels) if len(b[0])]
    if not bags:
        return None
    names = tuple(sorted({y for _, y in bags}))
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.1, (1 << BUCKET_BITS, DIMENSIONS)).astype(np.float32)
    w = np.zeros((DIMENSIONS, len(names)), dtype=np.float32)
    bias = np.zeros(len(names), dtype=np.float32)
    target = np.array([names.index(y) for _, y in bags])
    weight = np.array([1 / (target == k).sum() for k in range(len(names))])[target] * len(target) / len(names)
    steps, done = epochs * math.ceil(len(bags) / batch), 0
    for _ in range(epochs):
        for k in np.array_split(rng.permutation(len(bags)), math.ceil(len(bags) / batch)):
            part = [bags[i][0] for i in k]
            a = _averages(e, part)
            g = _softmax(a @ w + bias)
            g[np.arange(len(k)), target[k]] -= 1
            g *= weight[k][:, None] / len(k)
            lr = rate * (1 - done / steps)
            back = g @ w.T
            w -= (lr * 0.1 * (a.T @ g)).astype(np.float32)
            bias -= (lr * 0.01 * g.sum(axis=0)).astype(np.float32)
            for (b, n), d in zip(part, back):
                e[b] -= lr * (n / n.sum())[:, None] * d
            done += 1
    seen = np.zeros(1 << BUCKET_BITS, dtype=bool)
    for (b, _), _y in bags:
        seen[b] = True
    table = e @ w
    held = [(b, y) for b, y in held if y in names] or bags
    logits = _averages(table, [b for b, _ in held]) + bias
    truth = np.array([names.index(y) for _, y in held])
    coverage = np.array([(n[seen[b]].sum() + PRIOR) / (n.sum() + PRIOR) for (b, n), _ in held])
    scales = np.exp(np.linspace(-4, 2, 121))
    loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(truth)), truth], 1e-300)).mean() for t in scales]
    temperature = float(scales[int(np.argmin(loss))])
    confidence = np.clip(_softmax(logits / temperature).max(axis=1), 1e-12, 1 - 1e-12)
    odds = lower_tail(np.log(confidence / (1 - confidence)), alpha)
    return LanguageModel(names, table.astype(np.float32), bias, seen, temperature, float(1 / (1 + np.exp(-odds))), 1 + 1e-4 - math.exp(-lower_tail(-np.log(1 - coverage + 1e-4), alpha)), float((logits.argmax(axis=1) == truth).mean()))


def lower_tail(values: np.ndarray, alpha: float, share: float = TAIL) -> float:
    """The value that a fraction ``alpha`` lies below: a quantile of the sample, or beyond ``share`` its exponential tail."""
    if alpha >= share:
        return float(np.quantile(values, alpha))
    q = float(np.quantile(values, share))
    below = values[values < q]
    return q - float((q - below).mean()) * math.log(share / alpha) if len(below) else q


def fit(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "lang", sample_per_label: int = SAMPLE_PER_LABEL, alpha: float = ALPHA, seed: int = SEED) -> LanguageModel | None:
    """Fit to the labels of ``docs``. The sample is bounded by 2 * ``sample_per_label`` documents of each label, the first by a hash of id and
    length; repeated documents count once.

    None if no labelled document has a letter.
    """
    given = docs.select(col(docs, label).cast("string").alias("y"), col(docs, text).cast("string").alias("x"), F.pmod(F.xxhash64(F.lit(seed), col(docs, doc_id), F.length(col(docs, text))), F.lit(10**9)).alias("h")).filter("y IS NOT NULL AND x IS NOT NULL")
    counts = {r.y: r.n for r in given.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    want = 2 * sample_per_label
    share = F.create_map(*[F.lit(v) for y, n in sorted(counts.items()) for v in (y, int(min(1.0, 4 * want / n) * 10**9))])
    drawn = given.filter(F.col("h") < F.element_at(share, F.col("y"))).groupBy("y", "h").agg(F.min("x").alias("x"))
    rows = drawn.withColumn("k", F.row_number().over(Window.partitionBy("y").orderBy("h"))).filter(F.col("k") <= want).collect()
    rows.sort(key=lambda r: (r.y, r.h, r.x))
    first: list = []
    second: list = []
    for y in sorted(counts):
        own = [r for r in rows if r.y == y][:want]
        first += own[0::2]
        second += own[1::2]
    del rows, given
    model = train([r.x for r in first], [r.y for r in first], [r.x for r in second], [r.y for r in second], alpha=alpha, seed=seed)
    del first, second
    give_back()
    return model


def score(model: LanguageModel, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(label number or -1, confidence, coverage) of each text; -1, 0, 0 for null texts and texts without a letter."""
    at, number, words = _words(texts)
    classes = len(model.labels)
    sums = np.zeros((len(words), classes + 2))
    table = np.column_stack([model.table, np.ones(len(model.table), np.float32), model.seen.astype(np.float32)])
    done = 0
    for start, grams in _subwords(words):
        each = np.zeros((len(grams[0][0]), classes + 2))
        for bucket, ok in grams:
            each[: len(bucket)][ok] += table[bucket[ok]]
        sums[done : done + len(start)] = np.add.reduceat(each, start, axis=0)
        done += len(start)
    total = np.zeros((len(texts), classes + 2))
    full = np.flatnonzero(at[1:] > at[:-1])
    if len(full):
        total[full] = np.add.reduceat(sums[number], at[:-1][full], axis=0)
    n = total[:, classes]
    none = n == 0
    average = total[:, :classes] / np.maximum(n, 1)[:, None] + model.bias
    p = _softmax(average / model.temperature)
    return np.where(none, -1, p.argmax(axis=1)), np.where(none, 0.0, p.max(axis=1)), np.where(none, 0.0, (total[:, classes + 1] + PRIOR) / (n + PRIOR))


def rejects(model: LanguageModel, label: np.ndarray, confidence: np.ndarray, coverage: np.ndarray) -> np.ndarray:
    return (label < 0) | (confidence < model.least_confidence) | (coverage < model.least_coverage)


def identify(docs: DataFrame, model: LanguageModel | None = None, *, text: str = "text", carry: tuple[str, ...] = ("doc_id",), **fitting) -> DataFrame:
    """Columns ``carry``, then predicted, confidence, coverage and rejected of every row.

    Without ``model`` one is fitted to the labels of ``docs``. No shuffle; the model (fixed
    size, a few MB) is broadcast and whole texts are scored. Null and empty texts and texts
    without a letter have a null prediction, confidence and coverage 0, and are rejected;
    so is everything if there was nothing to train on. Repeated rows are judged alike, and
    equal scores take the label that sorts first. A carried column keeps its name; a new one
    of the same name gets underscores.
    """
    model = model or fit(docs, text=text, **fitting)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = with_fields(docs.select(*[col(docs, c) for c in carry]), predicted=T.StringType(), confidence=T.DoubleType(), coverage=T.DoubleType(), rejected=T.BooleanType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in byte_slices(batch.column(len(carry))):
                part = batch.slice(a, b - a)
                names, confidence, coverage, out = _judge(shared.value, part.column(len(carry)))
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(carry))], names, pa.array(confidence), pa.array(coverage), pa.array(out)], names=schema.names)

    return docs.select(*[col(docs, c) for c in carry], col(docs, text).cast("string").alias("__text")).mapInArrow(frugal(run), schema)


def _judge(model: LanguageModel | None, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    if model is None:
        return pa.nulls(len(texts), pa.string()), np.zeros(len(texts)), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
    label, confidence, coverage = score(model, texts)
    names = pa.array(np.array(model.labels, dtype=object)[label], pa.string(), mask=label < 0)
    return names, confidence, coverage, rejects(model, label, confidence, coverage)


def keep_identified(docs: DataFrame, model: LanguageModel | None = None, *, text: str = "text", **fitting) -> DataFrame:
    """``docs`` without the rows that :func:`identify` rejects, all columns as they were."""
    model = model or fit(docs, text=text, **fitting)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in byte_slices(batch.column(place)):
                part = batch.slice(a, b - a)
                yield part.filter(pa.array(~_judge(shared.value, part.column(place))[3]))

    return docs.mapInArrow(frugal(run), docs.schema)
