"""Approximate nearest neighbours by a few stable projections.

A Gaussian (2-stable) projection to M dimensions turns a distance d into a projected one whose
square over d^2 follows a chi-square law with M degrees of freedom. So points are visited in
the order of their projected distance, and the visit stops when a point that is nearer than
the k-th best so far would, with probability ``SURE``, have had a smaller projected distance
than all that is left: projected^2 >= d_k^2 * quantile(SURE). No number of candidates is fixed.

The projected points are indexed by a kd-tree. Its upper levels cut the points into cells, each
a file of the index in the shared folder, written by one exchange of the points; its lower
levels cut a cell into leaves. Cells are visited in the order of their boxes' distance, in
rounds of 1, 4, 16, ... of them: a round takes only those that the test can't rule out with the
distance found so far, and only queries are exchanged. Leaves are visited in the same order,
the points of a leaf together.

Equal vectors are one query, and one point with as many of its smallest ids as can be of use,
so a vector that a third of all rows have costs no more than another.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import files
from .shared import col, drop, free_shuffles, fresh_path, frugal, frugal_group, keep

K = 10
M = 8
SURE = 0.95
CELL = 4096
LEAF = 256
SEED = 41
#: Of a projected point's square: equal vectors may be projected with another rounding in another batch.
SLACK = 1e-10
#: Points of the sample that the splits of the tree's upper levels are fitted to (32 MB); every point is indexed.
SPLIT_SAMPLE = 1_000_000
#: Points of the sample for each cell at least.
_PER_CELL = 16
#: Times as many cells in each round as in all before.
_FACTOR = 4


def quantile(p: float, m: int = M) -> float:
    """Of the chi-square law with an even number m of degrees of freedom."""
    if m % 2 or not 0 < p < 1:
        raise ValueError("needs an even number of dimensions and a probability below 1")

    def below(x: float) -> float:
        term, total = 1.0, 1.0
        for i in range(1, m // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 1.0
    while below(high) < p:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


def split(points: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The upper tree, ``parts`` (a power of two) cells: the dimension and value of each split, in heap order."""
    dims, values = np.zeros(parts, dtype=np.int64), np.zeros(parts)
    held = {1: np.arange(len(points))}
    for node in range(1, parts):
        own = held.pop(node)
        p = points[own] if len(own) else points[:1]
        d = int(np.argmax(p.max(axis=0) - p.min(axis=0)))
        v = float(np.median(p[:, d]))
        dims[node], values[node] = d, v
        left = p[:, d] < v if len(own) else np.zeros(0, dtype=bool)
        held[2 * node], held[2 * node + 1] = own[left], own[~left]
    return dims, values


def cell_of(points: np.ndarray, dims: np.ndarray, values: np.ndarray) -> np.ndarray:
    node = np.ones(len(points), dtype=np.int64)
    while len(node) and node[0] < len(dims):
        node = 2 * node + (points[np.arange(len(points)), dims[node]] >= values[node])
    return node - len(dims)


def _leaves(proj: np.ndarray) -> list[np.ndarray]:
    done, todo = [], [np.arange(len(proj))]
    while todo:
        own = todo.pop()
        if len(own) <= LEAF:
            done.append(own)
            continue
        p = proj[own]
        d = int(np.argmax(p.max(axis=0) - p.min(axis=0)))
        order = np.argpartition(p[:, d], len(own) // 2)
        todo += [own[order[: len(own) // 2]], own[order[len(own) // 2 :]]]
    return done


def _firsts(*sorted_: np.ndarray) -> np.ndarray:
    """Whether an entry differs from the one before it in any of the arrays."""
    new = np.ones(len(sorted_[0]), dtype=bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in sorted_], axis=0)
    return new


def _ranked(row: np.ndarray, d: np.ndarray, to: np.ndarray, ids: np.ndarray, repeated: bool, shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(squared distances, places) of the nearest of each row by (distance, id), an id once, by its nearest."""
    if repeated:
        order = np.lexsort((d, ids[to], row))
        order = order[_firsts(row[order], ids[to][order])]
        row, d, to = row[order], d[order], to[order]
    order = np.lexsort((ids[to], d, row))
    row, d, to = row[order], d[order], to[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    best, at = np.full(shape, np.inf), np.full(shape, -1, dtype=np.int64)
    ok = rank < shape[1]
    best[row[ok], rank[ok]], at[row[ok], rank[ok]] = d[ok], to[ok]
    return best, at


def _squared(a: np.ndarray, row: np.ndarray, b: np.ndarray, to: np.ndarray) -> np.ndarray:
    """As in the result, so that equal vectors are equally far."""
    return np.concatenate([((a[row[x]].astype(np.float64) - b[to[x]].astype(np.float64)) ** 2).sum(axis=1) for x in (slice(lo, lo + 65_536) for lo in range(0, max(1, len(row)), 65_536))])


def _merged(d2: np.ndarray, place: np.ndarray, ids: np.ndarray, repeated: bool, k: int, error: np.ndarray, q_vecs: np.ndarray, vecs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of each row's entries, whose first k are exact and the others within ``error``."""
    if repeated:
        row, col = np.nonzero(np.isfinite(d2))
        kth = _ranked(row, d2[row, col], place[row, col], ids, True, (len(d2), k))[0][:, -1:]
    else:
        kth = np.partition(d2, k - 1, axis=1)[:, k - 1 : k]
    row, col = np.nonzero(np.isfinite(d2) & (d2 <= kth + 2 * error[:, None]))
    d, to = d2[row, col].astype(np.float64), place[row, col]
    new = col >= k
    d[new] = _squared(q_vecs, row[new], vecs, to[new])
    return _ranked(row, d, to, ids, repeated, (len(d2), k))


def search(proj: np.ndarray, vecs: np.ndarray, ids: np.ndarray, q_proj: np.ndarray, q_vecs: np.ndarray, bound: np.ndarray, k: int, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """(places, squared distances), k per query, of the nearest among one cell's points within ``bound``, each id once; -1 and inf where there are fewer."""
    n = len(q_proj)
    best = np.full((n, k), np.inf)
    place = np.full((n, k), -1, dtype=np.int64)
    leaves = _leaves(proj)
    low = np.array([proj[x].min(axis=0) for x in leaves])
    high = np.array([proj[x].max(axis=0) for x in leaves])
    gap = np.zeros((n, len(leaves)))
    for d in range(proj.shape[1]):
        gap += np.maximum(0, np.maximum(low[None, :, d] - q_proj[:, d, None], q_proj[:, d, None] - high[None, :, d])) ** 2
    order = np.argsort(gap, axis=1, kind="stable")
    norm, q_norm = (vecs**2).sum(axis=1), (q_vecs**2).sum(axis=1)
    error = (vecs.shape[1] + 8) * 1.2e-7 * (q_norm.astype(np.float64) + norm.max())
    slack = SLACK * (q_proj**2).sum(axis=1)
    repeated = len(np.unique(ids)) < len(ids)
    live = np.arange(n)
    for step in range(len(leaves)):
        leaf = order[live, step]
        reach = np.minimum(best[live, -1], bound[live])
        live, leaf = (x[gap[live, leaf] <= reach * limit + slack[live]] for x in (live, leaf))
        if not len(live):
            break
        for one in np.unique(leaf):
            rows, points = live[leaf == one], leaves[one]
            d2 = np.maximum(q_norm[rows, None] + norm[None, points] - 2 * (q_vecs[rows] @ vecs[points].T), 0)
            d2[d2 > (bound + error)[rows, None]] = np.inf
            both = np.concatenate([best[rows], d2], axis=1)
            where = np.concatenate([place[rows], np.broadcast_to(points, (len(rows), len(points)))], axis=1)
            best[rows], place[rows] = _merged(both, where, ids, repeated, k, error[rows], q_vecs[rows], vecs)
    return np.where(np.isfinite(best), place, -1), best


def _matrix(column, width: int) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.concatenate([np.frombuffer(b"".join(c.to_pylist()), dtype=np.float32).reshape(-1, width) for c in chunks] or [np.empty((0, width), np.float32)])


def few_of_equal(ids: np.ndarray, vecs: np.ndarray, most: int) -> np.ndarray:
    """Places of the rows that are left if of equal vectors the ``most`` smallest ids stay, once each."""
    raw = np.ascontiguousarray(vecs).view(np.dtype((np.void, vecs.shape[1] * vecs.itemsize))).ravel()
    _, same = np.unique(raw, return_inverse=True)
    order = np.lexsort((ids, same))
    order = order[_firsts(same[order], ids[order])]
    rank = np.arange(len(order)) - np.searchsorted(same[order], same[order])
    return np.sort(order[rank < most])


def _write_cell(folder: str, cell: int, ids: np.ndarray, p: np.ndarray, v: np.ndarray) -> None:
    files.write_whole(f"{folder}/cell-{cell}", lambda stream: [stream.write(np.ascontiguousarray(x).tobytes()) for x in (ids, p, v)])


def _read_cell(folder: str, cell: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = files.whole(f"{folder}/cell-{cell}")
    n = len(raw) // (8 + 4 * M + 4 * width)
    return np.frombuffer(raw, np.int64, n), np.frombuffer(raw, np.float32, n * M, 8 * n).reshape(n, M), np.frombuffer(raw, np.float32, n * width, (8 + 4 * M) * n).reshape(n, width)


def nearest(vectors: DataFrame, k: int = K, sure: float = SURE, seed: int = SEED, cell: int = CELL, *, vec_id: str = "vec_id", embedding: str = "embedding", queries: Column | None = None) -> DataFrame:
    """(vec_id, rank, neighbour_id, distance) of the k nearest others of the rows for which ``queries`` holds (of every row without it), by Euclidean distance; all rows are searched.

    Each true neighbour is found with a probability of ``sure`` at least. The splits are
    fitted to a sample of ``SPLIT_SAMPLE`` points at most, every row is indexed. Only the
    cells' boxes are broadcast: 72 bytes for each, at most ``SPLIT_SAMPLE`` / 16 of them.

    Defined results: rows with a null id or a null, empty or non-finite vector, and vectors of
    another length than the most frequent (of equally frequent ones the shortest), are left
    out; an id is never its own neighbour, and of an id's repeated rows the nearest counts;
    equal distances are ranked by id; with fewer than k others all are given; an empty table
    gives an empty table. Ids must be integers.
    """
    spark = vectors.sparkSession
    limit = quantile(sure)
    asked = F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))
    own = vectors.select(col(vectors, vec_id).cast("long").alias("id"), asked.alias("asked"), col(vectors, embedding).cast("array<float>").alias("v")).filter(F.col("id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    sizes = own.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if sizes is None:
        return spark.createDataFrame([], "vec_id long, rank int, neighbour_id long, distance double")
    width = sizes.n
    total = sizes["count"]
    basis = np.random.default_rng(seed).normal(size=(width, M)).astype(np.float32)

    def project(batches):
        for batch in batches:
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, width)
            p = flat @ basis
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in p], pa.binary()), pa.array([x.tobytes() for x in flat], pa.binary())], names=["id", "asked", "p", "v"])

    points = own.filter(F.size("v") == width).mapInArrow(frugal(project), "id long, asked boolean, p binary, v binary")
    share = min(1.0, 1.3 * SPLIT_SAMPLE / total)
    sample = points.filter(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(10**6)) < int(share * 10**6) + 1).select("p").limit(2 * SPLIT_SAMPLE).toArrow()
    parts = 1 << max(0, math.ceil(math.log2(max(1, min(total / cell, max(sample.num_rows, 1) / _PER_CELL)))))
    dims, values = split(_matrix(sample.column("p"), M) if sample.num_rows else np.zeros((1, M), np.float32), parts)
    del sample
    most = k + 1

    def place(batches):
        for batch in batches:
            ids, p, v = batch.column(0).to_numpy(), _matrix(batch.column(1), M), _matrix(batch.column(2), width)
            left = few_of_equal(ids, v, most)
            at = pa.array(left)
            yield pa.RecordBatch.from_arrays([pa.array(cell_of(p[left], dims, values), pa.int32()), *[c.take(at) for c in batch.columns]], names=["cell", "id", "p", "v"])

    folder = fresh_path(spark, "ann-index")
    files.make_dir(folder)

    def write(table: pa.Table) -> pa.Table:
        ids, p, v = table.column("id").to_numpy(), _matrix(table.column("p"), M), _matrix(table.column("v"), width)
        left = few_of_equal(ids, v, most)
        number = table.column("cell")[0].as_py()
        _write_cell(folder, number, ids[left], p[left], v[left])
        return pa.table({"cell": pa.array([number], pa.int32()), "low": pa.array([p.min(axis=0).tobytes()], pa.binary()), "high": pa.array([p.max(axis=0).tobytes()], pa.binary())})

    boxes = points.select("id", "p", "v").mapInArrow(frugal(place), "cell int, id long, p binary, v binary").groupBy("cell").applyInArrow(frugal_group(write), "cell int, low binary, high binary").toArrow()
    shared = spark.sparkContext.broadcast((boxes.column("cell").to_numpy(), _matrix(boxes.column("low"), M), _matrix(boxes.column("high"), M)))
    cells = boxes.num_rows
    ids = keep(points.filter("asked").select("id", F.md5("v").alias("key"), "p", "v"), "ann-asked")
    distinct = ids.groupBy("key").agg(F.first("p").alias("p"), F.first("v").alias("v"))
    distinct = keep(distinct, "ann-queries")

    def send(start: int, stop: int):
        def run(batches):
            numbers, low, high = shared.value
            for batch in batches:
                for lo in range(0, batch.num_rows, 256):
                    part = batch.slice(lo, 256)
                    p, bound = _matrix(part.column(1), M), part.column(3).to_numpy(zero_copy_only=False)
                    gap = sum(np.maximum(0, np.maximum(low[None, :, d] - p[:, d, None], p[:, d, None] - high[None, :, d])) ** 2 for d in range(M))
                    order = np.argsort(gap, axis=1, kind="stable")[:, start:stop]
                    row, rank = np.nonzero(np.take_along_axis(gap, order, axis=1) <= bound[:, None] * limit + SLACK * (p**2).sum(axis=1)[:, None])
                    at = pa.array(row)
                    yield pa.RecordBatch.from_arrays([pa.array(numbers[order[row, rank]], pa.int32()), *[part.column(i).take(at) for i in range(4)]], names=["cell", "key", "p", "v", "bound"])

        return run

    def look(table: pa.Table) -> pa.Table:
        ids, p, v = _read_cell(folder, table.column("cell")[0].as_py(), width)
        out = []
        for lo in range(0, table.num_rows, 1024):
            part = table.slice(lo, 1024)
            q_v = _matrix(part.column("v"), width)
            at, best = search(p, v, ids, _matrix(part.column("p"), M), q_v, part.column("bound").to_numpy(), most, limit)
            row, rank = np.nonzero(at >= 0)
            out.append(pa.table({"key": part.column("key").take(pa.array(row)), "neighbour_id": pa.array(ids[at[row, rank]], pa.int64()), "square": pa.array(best[row, rank])}))
        return pa.concat_tables(out)

    found, start = None, 0
    while start < cells:
        stop = max(1, _FACTOR * start)
        if found is None:
            state = distinct.withColumn("bound", F.lit(float("inf")))
        else:
            bounds = found.groupBy("key").agg(F.count("*").alias("n"), F.max("square").alias("far")).filter(F.col("n") >= most).select("key", "far")
            state = distinct.join(bounds, "key", "left").select("key", "p", "v", F.coalesce("far", F.lit(float("inf"))).alias("bound"))
        sent = state.mapInArrow(frugal(send(start, stop)), "cell int, key string, p binary, v binary, bound double")
        new = sent.groupBy("cell").applyInArrow(frugal_group(look), "key string, neighbour_id long, square double")
        both = new if found is None else found.unionByName(new)
        both = both.groupBy("key", "neighbour_id").agg(F.min("square").alias("square"))
        ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("square", "neighbour_id"))).filter(F.col("rank") <= most).drop("rank")
        last, found = found, keep(ranked, "ann-found")
        if last is not None:
            drop(last)
        free_shuffles(spark)
        start = stop
    near = ids.select(F.col("id").alias("vec_id"), "key").distinct().join(found, "key").filter("vec_id <> neighbour_id").groupBy("vec_id", "neighbour_id").agg(F.sqrt(F.min("square")).alias("distance"))
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("vec_id").orderBy("distance", "neighbour_id"))).filter(F.col("rank") <= k)
    return ranked.select("vec_id", "rank", "neighbour_id", F.round("distance", 5).alias("distance"))
