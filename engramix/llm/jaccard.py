"""N-gram Jaccard join by T-occurrence search.

Every document is the set of its word n-grams. Documents with equal sets are one node, stood
for by the smallest id. Two sets x, y with Jaccard >= t share at least max(t|x|, t|y|) grams,
so

1. one exchange by gram finds the inverted lists of two documents or more; each such list
   names a centre, its first document. A set with fewer listed grams than t|x| has no partner
   and goes.
2. Lists have one order for all sets, from the shortest on. Of its listed grams a set puts
   aside the last in this order, at most three quarters of t|x|. Of the grams that two partners
   share, all that either puts aside, one of them does, so they still share a quarter. Of the other grams it keeps centres until fewer than half of that quarter
   are uncovered: first those of lists that aren't long, the ones that most of its grams name
   before others, then the long lists' (a license line's, say) from the shortest on. Two
   partners can't leave all their shared grams uncovered, so they meet at a centre. In a large
   corpus many grams are shared by chance, and each would name a centre of its own: a group's
   lists that a stranger has joined are longer than its others, so they are put aside.
3. The sets of a centre are searched by DivideSkip: with sets in order of size, the partners of
   x that are no smaller share T = 2t/(1+t)|x| grams or more. The longest lists (at most T-1)
   are put aside, the short ones are merged, and what occurs often enough in them is probed in
   the long ones by binary search. A centre with more than ``HEAVY`` grams is searched by
   pairs of blocks of its sets, so that no task holds more than two blocks. If the sets that go
   to the centres have more than ``PASS`` times the bytes of the texts, the centres take turns.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .shared import WORD, byte_slices, col, drop, enough_parts, free_shuffles, frugal, frugal_group, keep, mix64, planes, settled, spare_name, spread, unplanes, word_hashes

N = 3
THRESHOLD = 0.5
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: Grams that a mapper gathers before it sends them on; one such block has fewer than 65,536 documents.
_BLOCK = 1_500_000
#: Weight of a probe against a step of the merge, for the share of lists that DivideSkip puts aside.
_MU = 0.0085
#: Lists of at most 2 to this power documents aren't long.
_LONG = 12
#: Of the grams that a set shares with any partner, the part that counts in the choice of centres; the rest is put aside.
SHARE = 0.25
#: Bytes of sets that one turn sends to its centres, for each byte of text; and the fewest for which it is worth a turn.
PASS, LEAST_PASS = 1.0, 200_000_000
#: Grams of the sets that one task searches at a time.
HEAVY = 1_000_000
#: A table of up to so many bytes, by its own count, is broadcast; beyond, it is joined by shuffle.
MOST_BROADCAST = 32_000_000


def least(t: float, size: int | np.ndarray, share: float = 1.0) -> int | np.ndarray:
    """The fewest grams that a set of this size shares with any partner, or a share of them, one at least."""
    return np.maximum(1, np.ceil(share * np.maximum(1, np.ceil(t * size - 1e-9)) - 1e-9)).astype(np.int64)


def gram_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit gram hashes of each text. A text of fewer than n words has one gram, all its words; one without words has none."""
    at, h = word_hashes(texts)
    size = np.diff(at)
    grams = np.zeros(len(h), dtype=np.uint64)
    have = np.zeros(len(h), dtype=bool)
    left = np.repeat(at[1:], size) - np.arange(len(h))
    first = np.zeros(len(h), dtype=bool)
    first[at[:-1][size > 0]] = True
    acc = np.zeros(len(h), dtype=np.uint64)
    for k in range(1, n + 1):
        acc = acc[: max(0, len(h) - k + 1)] * _STEP + h[k - 1 :] + np.uint64(k)
        ok = left[: len(acc)] >= k if k == n else first[: len(acc)] & (left[: len(acc)] == k)
        grams[: len(acc)][ok] = mix64(acc[ok])
        have[: len(acc)] |= ok
    return [np.unique(grams[a:b][have[a:b]]) for a, b in zip(at[:-1], at[1:])]


def _set_id(grams: np.ndarray) -> int:
    """A 64-bit name of the set, signed as Spark's longs."""
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - 2**63


def _postings(docs: DataFrame, n: int, buckets: int) -> DataFrame:
    """(kind, part, block, a, b, c): kind 0: for one bucket of grams, grams (48 bits) with the number of the document in its block (16); kind 1: the ids (a) of a block's documents, their set ids (b) and sizes (c); kind 2: ids (a) of texts without a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        sets: list[np.ndarray] = []
        held, number = 0, 0
        task = TaskContext.get().partitionId()

        def flush() -> pa.RecordBatch:
            nonlocal ids, sets, held, number
            block = (task << 24) | number
            names = np.array([_set_id(s) for s in sets], dtype=np.int64)
            size = np.array([len(s) for s in sets], dtype=np.int64)
            rows = [(1, block % buckets, block, np.concatenate(ids).tobytes(), names.tobytes(), size.tobytes())]
            key = np.concatenate(sets) & ~np.uint64(0xFFFF)
            key |= np.repeat(np.arange(len(sets), dtype=np.uint64), size)
            key.sort()
            bucket = ((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            edge = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
            for k in np.flatnonzero(np.diff(edge)):
                rows.append((0, int(k), block, planes(key[edge[k] : edge[k + 1]]), None, None))
            ids, sets, held, number = [], [], 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _SCHEMA.types)], schema=_SCHEMA)

        for batch in batches:
            for a, b in byte_slices(batch.column(1), 4_000_000):
                own = batch.column(0).slice(a, b - a).to_numpy(zero_copy_only=False)
                found = gram_sets(batch.column(1).slice(a, b - a), n)
                full = np.array([len(s) > 0 for s in found], dtype=bool)
                if not full.all():
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((2, (task + number) % buckets, -1, own[~full].astype(np.int64).tobytes(), None, None), _SCHEMA.types)], schema=_SCHEMA)
                for k in range(0, len(found), 60_000):
                    part = [s for s in found[k : k + 60_000] if len(s)]
                    if not part:
                        continue
                    if len(sets) + len(part) > 65_000:
                        yield flush()
                    ids.append(own[k : k + 60_000][full[k : k + 60_000]])
                    sets += part
                    held += sum(map(len, part))
                if held > _BLOCK:
                    yield flush()
        if sets:
            yield flush()

    return docs.mapInArrow(frugal(run), _DDL)


_DDL = "kind int, part int, block long, a binary, b binary, c binary"
_SCHEMA = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("block", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])


def _ints(x: bytes, kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(x, dtype=kind)


def _length(n: np.ndarray) -> np.ndarray:
    """A list's length in one byte, in its order: up to 128 itself, then eight steps for each doubling."""
    return np.minimum(255, np.where(n <= 128, n, 128 + 8 * np.log2(np.maximum(n, 128) / 128))).astype(np.uint8)


def _excess(length: np.ndarray) -> np.ndarray:
    """By how much a list is long, from its :func:`_length`."""
    return (np.maximum(0, length.astype(np.int64) - (128 + 8 * (_LONG - 7))) + 7) // 8


def _listed(table: pa.Table) -> pa.Table:
    """For one bucket of grams: back to every block, the numbers (a) of its documents with a listed gram, the centre (b) that the gram names and its list's length (c, as :func:`_length`). Rows of other kinds pass."""
    rows = table.to_pylist()
    out = [{k: r[k] for k in ("kind", "block", "a", "b", "c")} for r in rows if r["kind"]]
    rows = [r for r in rows if r["kind"] == 0]
    if rows:
        keys = [unplanes(r["a"]) for r in rows]
        gram = np.concatenate([k & ~np.uint64(0xFFFF) for k in keys])
        doc = np.concatenate([(k & np.uint64(0xFFFF)).astype(np.int64) | (r["block"] << 16) for k, r in zip(keys, rows)])
        order = np.argsort(gram, kind="stable")
        gram, of = gram[order], doc[order]
        start = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        low, high = np.minimum.reduceat(of, start), np.maximum.reduceat(of, start)
        n = np.diff(np.append(start, len(gram)))
        listed = np.repeat(low < high, n)
        where, centre = order[listed], np.repeat(low, n)[listed]
        long_ = np.repeat(_length(n), n)[listed]
        place = np.argsort(where)
        where, centre, long_ = where[place], centre[place], long_[place]
        edge = np.searchsorted(where, np.cumsum([0] + [len(k) for k in keys]))
        for i, r in enumerate(rows):
            if edge[i] < edge[i + 1]:
                own = slice(edge[i], edge[i + 1])
                local = doc[where[own]] & 0xFFFF
                sort = np.lexsort((centre[own], local))
                out.append({"kind": 0, "block": r["block"], "a": local[sort].astype(np.uint16).tobytes(), "b": planes(centre[own][sort]), "c": long_[own][sort].tobytes()})
    return pa.Table.from_pylist(out, _BACK)


_BACK_DDL = "kind int, block long, a binary, b binary, c binary"
_BACK = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])


def foremost(names: np.ndarray, sizes: np.ndarray, centres: np.ndarray, lengths: np.ndarray, t: float, share: float) -> np.ndarray:
    """Places of the listed grams that aren't put aside. The order is by length of the list and centre; grams alike in both stay or go together, so it is the same for all sets."""
    order = np.lexsort((centres, lengths, names))
    s, c, length = names[order], centres[order], lengths[order]
    first = np.concatenate([[True], s[1:] != s[:-1]])
    run = np.flatnonzero(first | np.concatenate([[True], (c[1:] != c[:-1]) | (length[1:] != length[:-1])]))
    ends = np.append(np.flatnonzero(first)[1:], len(s))
    size = sizes[order][run]
    after = ends[np.cumsum(first)[run] - 1] - run  # its grams from this run on
    return order[np.repeat(after > least(t, size) - least(t, size, share), np.diff(np.append(run, len(s))))]


def cover(names: np.ndarray, sizes: np.ndarray, centres: np.ndarray, long_: np.ndarray, t: float, share: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(set, centre) that are kept, from the (set, size, centre, excess length) of all listed grams of some sets, or of those that :func:`foremost` leaves at this share."""
    if not len(names):
        return names, centres
    order = np.lexsort((centres, names))
    s, size, c, long_ = names[order], sizes[order], centres[order], long_[order]
    run = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (c[1:] != c[:-1])]))
    n = np.diff(np.append(run, len(s)))
    s, size, c, long_ = s[run], size[run], c[run], np.maximum.reduceat(long_, run)
    order = np.lexsort((c, -n, long_, s))
    s, size, c, n = s[order], size[order], c[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    k = np.diff(np.append(first, len(s)))
    total = np.repeat(np.add.reduceat(n, first), k)
    before = np.cumsum(n) - n
    uncovered = total - (before - np.repeat(before[first], k))
    need = least(t, size, share)
    kept = (total >= need) & (uncovered > (need - 1) // 2)
    return s[kept], c[kept]


def _centres(t: float):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        meta = next(r for r in rows if r["kind"] == 1)
        rows = [r for r in rows if r["kind"] == 0]
        if not rows:
            return pa.table({"set_id": pa.array([], pa.int64()), "centre": pa.array([], pa.int64())})
        local = np.concatenate([_ints(r["a"], np.uint16) for r in rows]).astype(np.int64)
        centre = np.concatenate([unplanes(r["b"]).view(np.int64) for r in rows])
        long_ = np.concatenate([_ints(r["c"], np.uint8) for r in rows])
        size = _ints(meta["c"])[local]
        ahead = foremost(local, size, centre, long_, t, SHARE)
        doc, c = cover(local[ahead], size[ahead], centre[ahead], _excess(long_[ahead]), t, SHARE)
        return pa.table({"set_id": pa.array(_ints(meta["b"])[doc], pa.int64()), "centre": pa.array(c, pa.int64())})

    return run


def divide_skip(sets: list[np.ndarray], t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, shared) of all pairs of sets with Jaccard >= t; the sets come in ascending order of size."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    flat = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), size)
    order = np.lexsort((doc, flat))
    change = np.concatenate([[True], np.diff(flat[order]) != 0])
    number = np.empty(len(flat), dtype=np.int64)
    number[order] = np.cumsum(change) - 1
    lists = doc[order]  # all inverted lists, one after another
    start = np.append(np.flatnonzero(change), len(flat))
    place = np.empty(len(flat), dtype=np.int64)
    place[order] = np.arange(len(flat))
    probe = (np.cumsum(change) - 1) * len(sets) + lists
    at = np.concatenate([[0], np.cumsum(size)])
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in range(len(sets) - 1):
        own = slice(at[i], at[i + 1])
        head, tail = place[own] + 1, start[number[own] + 1]  # what follows set i in its lists
        n = tail - head
        live = np.flatnonzero(n)
        need = max(1, math.ceil(2 * t / (1 + t) * size[i] - 1e-9))
        if len(live) < need:
            continue
        live = live[np.argsort(n[live], kind="stable")]
        aside = min(need - 1, int(need / (_MU * math.log2(n[live[-1]] + 1) + 1)))
        short, long_ = (live[: len(live) - aside], live[len(live) - aside :]) if aside else (live, live[:0])
        merged = np.sort(lists[spread(head[short], n[short])], kind="stable")
        edge = np.flatnonzero(np.concatenate([[True], merged[1:] != merged[:-1]]))
        count = np.diff(np.append(edge, len(merged)))
        often = count >= need - aside
        j, count = merged[edge][often], count[often]
        near = size[j] * t <= size[i] + 1e-9
        j, count = j[near], count[near]
        if not len(j):
            continue
        if aside:
            want = (number[own][long_][:, None] * len(sets) + j[None, :]).ravel()
            hit = probe[np.minimum(np.searchsorted(probe, want), len(probe) - 1)] == want
            count = count + hit.reshape(len(long_), len(j)).sum(axis=0)
        ok = count / (size[i] + size[j] - count) >= t
        found.append((np.full(int(ok.sum()), i), j[ok], count[ok]))
    if not found:
        return (np.empty(0, dtype=np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found))


_FOUND = pa.schema([(c, pa.int64()) for c in ("left_set", "right_set", "left_id", "right_id", "left_n", "right_n", "shared")] + [("jaccard", pa.float64())])
_FOUND_DDL = "left_set long, right_set long, left_id long, right_id long, left_n long, right_n long, shared long, jaccard double"


def _search(t: float):
    def run(table: pa.Table) -> pa.Table:
        _, one = np.unique(table.column("set_id").to_numpy(), return_index=True)
        names, ids, copies = (table.column(c).to_numpy()[one] for c in ("set_id", "rep", "n"))
        blocks = table.column("blocks")[0].as_py()
        across = table.column("i")[0].as_py() != table.column("j")[0].as_py()
        sets = [_ints(x, np.uint64) for x in table.column("grams").take(pa.array(one)).to_pylist()]
        size = np.array([len(s) for s in sets], dtype=np.int64)
        order = np.lexsort((names, size))
        names, ids, copies, size, sets = names[order], ids[order], copies[order], size[order], [sets[k] for k in order]
        i, j, shared = divide_skip(sets, t) if len(sets) > 1 else (np.empty(0, dtype=np.int64),) * 3
        if across:
            other = names[i] % blocks != names[j] % blocks
            i, j, shared = i[other], j[other], shared[other]
        low, high = np.where(names[i] < names[j], i, j), np.where(names[i] < names[j], j, i)
        return pa.table([names[low], names[high], ids[low], ids[high], copies[low], copies[high], shared, shared / (size[i] + size[j] - shared)], schema=_FOUND)

    return run


def _matches(docs: DataFrame, n: int, threshold: float, doc_id: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Kept tables. members: (id, set_id, size), a row for each id and set, set_id null for texts without a word; nodes: (set_id, size, rep, n), the smallest id and the number of ids of each set; pairs of nodes, as ``_FOUND_DDL``, left_set < right_set."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    spark = docs.sparkSession
    own = docs.select(col(docs, doc_id).cast("long").alias("id"), col(docs, text).cast("string").alias("text")).filter("id IS NOT NULL")
    given = settled(own, "jaccard-texts")
    buckets = enough_parts(given, "text")
    back = keep(_postings(given, n, buckets).groupBy("part").applyInArrow(frugal_group(_listed), _BACK_DDL), "jaccard-lists")
    free_shuffles(spark)
    members = keep(back.filter("kind > 0").mapInArrow(_unpacked, "id long, set_id long, size long").distinct(), "jaccard-members")
    nodes = keep(members.filter("set_id IS NOT NULL").groupBy("set_id", "size").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "jaccard-nodes")
    centres = back.filter("kind < 2").groupBy("block").applyInArrow(frugal_group(_centres(threshold)), "set_id long, centre long").distinct()
    chosen = keep(centres.groupBy("set_id").agg(F.collect_list("centre").alias("centres")).join(nodes, "set_id"), "jaccard-centres")
    drop(back)
    free_shuffles(spark)
    heavy = keep(chosen.select(F.explode("centres").alias("centre"), "size").groupBy("centre").agg(F.sum("size").alias("grams")).filter(F.col("grams") > HEAVY).select("centre", "grams", F.ceil(F.col("grams") / HEAVY).cast("long").alias("blocks")), "jaccard-heavy")
    none_heavy = heavy.isEmpty()
    sent = (chosen.agg(F.sum(F.size("centres") * F.col("size")).alias("n")).first().n or 0) + (heavy.agg(F.sum(F.col("grams") * (F.col("blocks") - 1)).alias("n")).first().n or 0)
    turns = max(1, math.ceil(8 * sent / max(LEAST_PASS, PASS * (given.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first().n or 0))))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in byte_slices(batch.column(3), 2_000_000):
                part = batch.slice(a, b - a)
                found = gram_sets(part.column(3), n)
                ok = [k for k, (s, name) in enumerate(zip(found, part.column(0).to_pylist())) if len(s) and _set_id(s) == name]
                at = pa.array(ok, pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(at) for k in (0, 1, 2, 4)), pa.array([found[k].tobytes() for k in ok], pa.binary())], names=["set_id", "rep", "n", "centres", "grams"])

    def turn(k: int) -> DataFrame:
        """Pairs found at the centres whose turn it is; those of heavy ones by block."""
        mine = lambda *c: F.pmod(F.xxhash64(*c), F.lit(turns).cast("long")) == k
        own = chosen if turns == 1 or not none_heavy else chosen.withColumn("centres", F.filter("centres", lambda c: mine(c))).filter(F.size("centres") > 0)
        picked = _light(own, F.size("centres") * 8 + 48)
        searched = given.filter("text IS NOT NULL").join(picked, given["id"] == picked["rep"]).select("set_id", "rep", "n", "text", "centres").mapInArrow(frugal(sets), "set_id long, rep long, n long, centres array<long>, grams binary")
        each = searched.select("set_id", "rep", "n", "grams", F.explode("centres").alias("centre"))
        if none_heavy:
            placed = each.select("*", F.lit(1).cast("long").alias("blocks"), F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"))
        else:
            blocks = F.coalesce("blocks", F.lit(1).cast("long"))
            block = F.pmod("set_id", "blocks")
            placed = each.join(_light(heavy.select("centre", "blocks"), F.lit(16)), "centre", "left").withColumn("blocks", blocks).withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("set_id", "rep", "n", "grams", "centre", "blocks", F.least(block, "to").alias("i"), F.greatest(block, "to").alias("j"))
            if turns > 1:
                placed = placed.filter(mine("centre", "i", "j"))
        return best(placed.groupBy("centre", "i", "j").applyInArrow(frugal_group(_search(threshold)), _FOUND_DDL))

    def best(found: DataFrame) -> DataFrame:
        return found.groupBy("left_set", "right_set").agg(*[F.max(c).alias(c) for c in _FOUND.names[2:]])

    if turns == 1:
        pairs = keep(turn(0), "jaccard-pairs")
        drop(chosen, heavy)
        return members, nodes, pairs
    parts = []
    for k in range(turns):
        parts.append(keep(turn(k), "jaccard-turn"))
        free_shuffles(spark)
    pairs = keep(best(functools.reduce(DataFrame.unionByName, parts)), "jaccard-pairs")
    drop(*parts, chosen, heavy)
    return members, nodes, pairs


def _light(kept: DataFrame, row_bytes: Column) -> DataFrame:
    """A kept table, to be broadcast only if its rows have at most ``MOST_BROADCAST`` bytes together."""
    total = kept.agg(F.sum(row_bytes).alias("b")).first().b or 0
    return F.broadcast(kept) if total <= MOST_BROADCAST else kept


def jaccard_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(left_id, right_id, shared, jaccard) with left_id < right_id, exact over 64-bit gram hashes and whole texts.

    Documents with equal gram sets: the smallest id is paired with each of the others
    (jaccard 1), and only it takes part in further pairs, so that thousands of copies give
    thousands of rows and not millions; :func:`with_all_copies` gives the others' pairs too,
    :func:`near_classes` a row for each document.

    Defined results: rows with a null id and texts without a word (null, empty) are in no
    pair; repeated rows give no pair of an id with itself and no repeated pair; texts of fewer
    than n words are compared by all their words; an empty table gives an empty table. Ids
    must be integers. Only tables of at most ``MOST_BROADCAST`` bytes are broadcast.
    """
    members, nodes, found = _matches(docs, n, threshold, doc_id, text)
    pairs = found.filter("left_id <> right_id").select(F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id"), "shared", "jaccard")
    copies = members.join(nodes.filter("n > 1").select("set_id", "rep"), "set_id").filter("id <> rep").select(F.col("rep").alias("left_id"), F.col("id").alias("right_id"), F.col("size").alias("shared"), F.lit(1.0).alias("jaccard"))
    best = pairs.unionByName(copies).groupBy("left_id", "right_id").agg(F.max(F.struct("jaccard", "shared")).alias("best"))
    return best.select("left_id", "right_id", "best.shared", "best.jaccard")


def _classes(members: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """members of sets that have copies or partners, with (rep, n, links, class_id, class_set): of the class, the smallest id and its set."""
    ends = pairs.select(F.col("left_set").alias("set_id"), F.col("right_n").alias("m")).unionByName(pairs.select(F.col("right_set").alias("set_id"), F.col("left_n").alias("m")))
    links = ends.groupBy("set_id").agg(F.sum("m").alias("links"))
    roots = components(pairs.select(F.col("left_set").alias("left_id"), F.col("right_set").alias("right_id"))).select(F.col("id").alias("set_id"), "root")
    own = nodes.join(links, "set_id", "left").join(roots, "set_id", "left").filter("n > 1 OR links IS NOT NULL").select("set_id", "rep", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("root", "set_id").alias("root"))
    own = keep(own, "jaccard-own")
    first = own.groupBy("root").agg(F.min(F.struct("rep", "set_id")).alias("first"))
    info = own.join(first, "root").select("set_id", "rep", "n", "links", F.col("first.rep").alias("class_id"), F.col("first.set_id").alias("class_set"))
    return members.join(info, "set_id", "left")


def near_classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, copy_of, n_links), a row for each document.

    A document's links are all other documents within the threshold (every copy counts, and
    every copy of a partner); documents joined by a chain of links are a class, named by its
    smallest id; copy_of is the smallest id with an equal gram set. The links themselves
    between different sets are the rows of :func:`jaccard_join` with jaccard below 1.

    Defined results: as for :func:`jaccard_join`; a text without a word is a class of its own
    without a link; repeated rows of an id and set are one document; an id with several
    different sets has a row for each; rows with a null id have none.
    """
    members, nodes, pairs = _matches(docs, n, threshold, doc_id, text)
    found = _classes(members, nodes, pairs)
    return found.select(F.col("id").alias("doc_id"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("rep", "id").alias("copy_of"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def with_all_copies(pairs: DataFrame) -> DataFrame:
    """Rows of :func:`jaccard_join` and those of the other copies, which follow from them: every pair of near duplicates has a row.

    Copies are known by jaccard = 1, of which the smaller id is the representative. m copies
    have m(m - 1)/2 rows here. The documents' ids must be distinct.
    """
    copies = pairs.filter("jaccard = 1").select(F.col("left_id").alias("rep"), F.col("right_id").alias("id"), "shared")
    members = copies.select("rep", "id").unionByName(copies.select("rep", F.col("rep").alias("id")).distinct())
    left, right = (members.select(F.col("rep").alias(f"{side}_id"), F.col("id").alias(f"{side}_own")) for side in ("left", "right"))
    apart = pairs.filter("jaccard < 1").join(left, "left_id", "left").join(right, "right_id", "left").select(F.coalesce("left_own", "left_id").alias("a"), F.coalesce("right_own", "right_id").alias("b"), "shared", "jaccard")
    size = copies.select("rep", "shared").distinct()
    alike = left.join(right, left["left_id"] == right["right_id"]).filter("left_own < right_own").join(size, F.col("left_id") == size["rep"]).select(F.col("left_own").alias("a"), F.col("right_own").alias("b"), "shared", F.lit(1.0).alias("jaccard"))
    both = apart.unionByName(alike).filter("a <> b").select(F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id"), "shared", "jaccard")
    return both.groupBy("left_id", "right_id").agg(F.max(F.struct("jaccard", "shared")).alias("best")).select("left_id", "right_id", "best.shared", "best.jaccard")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, c in zip(*(batch.column(k).to_pylist() for k in "abc")):
            ids = pa.array(_ints(a))
            yield pa.RecordBatch.from_arrays([ids, *((pa.nulls(len(ids), pa.int64()),) * 2 if b is None else (pa.array(_ints(b)), pa.array(_ints(c))))], names=["id", "set_id", "size"])


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every id in an edge (left_id, right_id): the smallest id of its connected component.

    Alternating large and small stars: each round is two exchanges of edges alone, and the
    number of rounds grows with the logarithm of a component's size. An id's edges are
    never gathered in one row.
    """
    pairs = edges.select(F.greatest("left_id", "right_id").alias("u"), F.least("left_id", "right_id").alias("v")).filter("u > v").distinct()
    now, before = keep(pairs, "components"), None
    while True:
        stamp = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if stamp == before:
            return now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("root"))).distinct()
        before = stamp
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        around = Window.partitionBy("u")
        large = both.withColumn("m", F.least(F.min("v").over(around), F.col("u"))).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        low = large.withColumn("m", F.min("v").over(around))
        small = low.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u > v").distinct()
        last, now = now, keep(small, "components")
        drop(last)


def keep_one_of_each(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near duplicates: the one of the smallest id; all columns as they were.

    A group is a class of :func:`near_classes`. A row is judged by its id and its own gram
    set, so that of an id that occurs with different texts each text is judged by itself. Rows
    that are in no pair stay, those with a null id or without a word among them; of rows with
    the same id and gram set (or, without a word, the same text) one stays, the first by text
    and then by a hash of the row.
    """
    kept = settled(docs, "jaccard-docs")
    found = _classes(*_matches(kept, n, threshold, doc_id, text))
    gone = keep(found.filter("class_id IS NOT NULL AND (id <> class_id OR set_id <> class_set)").select("id", "set_id"), "jaccard-gone")
    key, name = spare_name(docs, "near_id"), spare_name(docs, "near_set")
    own = col(kept, doc_id).cast("long")
    again = keep(kept.filter(own.isNotNull()).groupBy(own.alias(key)).count().filter("count > 1").select(key), "jaccard-again")
    ids = gone.select(F.col("id").alias(key))
    if again.isEmpty():
        return kept.join(_light(keep(ids, "jaccard-gone-ids"), F.lit(16)), own == F.col(key), "left_anti")
    single = kept.join(_light(again, F.lit(16)), own == F.col(key), "left_anti").join(_light(keep(ids.distinct(), "jaccard-gone-ids"), F.lit(16)), own == F.col(key), "left_anti")

    at = kept.columns.index(text)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in byte_slices(batch.column(at)):
                part = batch.slice(a, b - a)
                sets = gram_sets(part.column(at).cast(pa.string()), n)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([_set_id(s) if len(s) else None for s in sets], pa.int64())], names=[*part.schema.names, name])

    several = kept.join(_light(again, F.lit(16)), own == F.col(key), "left_semi")
    several = several.mapInArrow(frugal(named), T.StructType([*several.schema.fields, T.StructField(name, T.LongType())]))
    left = several.join(gone, (own == gone["id"]) & (F.col(name) == gone["set_id"]), "left_anti")
    rank = spare_name(left, "near_rank")
    same = Window.partitionBy(own, name, F.when(F.col(name).isNull(), col(left, text))).orderBy(col(left, text), F.xxhash64(*[col(left, c) for c in docs.columns if "map<" not in dict(docs.dtypes)[c]]))
    once = left.withColumn(rank, F.row_number().over(same)).filter(F.col(rank) == 1).select(*[col(left, c) for c in docs.columns])
    return single.unionByName(once)


def oracle(n: int = N, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for :func:`near_classes` over the table documents, whose ids are distinct."""
    return f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(text, '{WORD}') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
grams AS (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, unnest(list_transform(generate_series(1, greatest(1, len(w) - {n - 1})), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS g FROM words WHERE len(w) > 0)),
sets AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS s FROM grams GROUP BY doc_id),
reps AS (SELECT s, min(doc_id) AS rep, any_value(n) AS n, count(*) AS m FROM sets GROUP BY s),
own AS (SELECT g, rep, n, m FROM grams JOIN reps ON doc_id = rep),
pairs AS (SELECT a.rep AS a, b.rep AS b, any_value(b.m) AS m FROM own a JOIN own b ON a.g = b.g AND a.rep <> b.rep GROUP BY a.rep, b.rep HAVING CAST(count(*) AS DOUBLE) / (any_value(a.n) + any_value(b.n) - count(*)) >= {threshold}),
links AS (SELECT a, sum(m) AS m FROM pairs GROUP BY a),
reach AS (SELECT DISTINCT a, a AS b FROM pairs UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a),
roots AS (SELECT a, min(b) AS root FROM reach GROUP BY a)
SELECT doc_id, coalesce(root, rep, doc_id) AS class_id, coalesce(rep, doc_id) AS copy_of, CAST(coalesce(reps.m, 1) - 1 + coalesce(links.m, 0) AS BIGINT) AS n_links
FROM (SELECT doc_id FROM documents WHERE doc_id IS NOT NULL) LEFT JOIN sets USING (doc_id) LEFT JOIN reps USING (s) LEFT JOIN links ON links.a = rep LEFT JOIN roots ON roots.a = rep
"""
