"""Packing indivisible groups into fixed-capacity shards by best fit decreasing.

Groups in descending order of size each enter the open shard with the least room that still
holds them, or open a new one. Groups of one size are alike, so the packing is done for the
histogram of sizes instead of for every group: shards with equal room are intervals of
numbers, kept in a balanced tree keyed by room; while size s is placed, the tightest shard
with room r >= s takes floor(r / s) groups in a row, as r - s is again the tightest room.
That gives the very shards that the one-by-one algorithm gives, and the driver holds only the
distinct sizes (at most the capacity, whatever the number of groups).
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window, functions as F

from .shared import col, keep, shuffle_partitions

CAPACITY = 4 * 1024 * 1024


class RoomTree:
    """Shards by room: a B-tree of two levels over the distinct rooms, each with its intervals of shard numbers in order."""

    _FULL = 512

    def __init__(self) -> None:
        self.leaves: list[list[int]] = []
        self.least: list[int] = []
        self.shards: dict[int, list[tuple[int, int]]] = {}

    def add(self, room: int, low: int, high: int) -> None:
        """Shards low..high-1 have this room."""
        own = self.shards.get(room)
        if own is not None:
            insort(own, (low, high))
            return
        self.shards[room] = [(low, high)]
        if not self.leaves:
            self.leaves, self.least = [[room]], [room]
            return
        k = max(0, bisect_left(self.least, room + 1) - 1)
        leaf = self.leaves[k]
        insort(leaf, room)
        self.least[k] = leaf[0]
        if len(leaf) > self._FULL:
            half = len(leaf) // 2
            self.leaves[k : k + 1] = [leaf[:half], leaf[half:]]
            self.least[k : k + 1] = [leaf[0], leaf[half]]

    def tightest(self, size: int) -> int | None:
        """The least room of at least ``size``."""
        k = max(0, bisect_left(self.least, size + 1) - 1)
        while k < len(self.leaves):
            leaf = self.leaves[k]
            at = bisect_left(leaf, size)
            if at < len(leaf):
                return leaf[at]
            k += 1
        return None

    def take(self, room: int, most: int) -> tuple[int, int]:
        """Remove up to ``most`` shards of this room, the lowest numbers first, and return their interval."""
        own = self.shards[room]
        low, high = own[0]
        if high - low > most:
            own[0] = (low + most, high)
            return low, low + most
        del own[0]
        if not own:
            del self.shards[room]
            k = max(0, bisect_left(self.least, room + 1) - 1)
            leaf = self.leaves[k]
            del leaf[bisect_left(leaf, room)]
            if leaf:
                self.least[k] = leaf[0]
            else:
                del self.leaves[k], self.least[k]
        return low, high


def pack(histogram: Iterable[tuple[int, int]], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Runs (size, first, shard, each) and the number of shards, from (size, groups).

    Groups first, first + 1, ... of a size go ``each`` at a time into shard, shard + 1, ...,
    until the next run of that size. Larger groups than the capacity have a shard each.
    """
    tree, runs, shards = RoomTree(), [], 0
    for size, count in sorted(histogram, reverse=True):
        first = 0
        if size > capacity or size == 0 and not shards:
            number = count if size else 1
            runs.append((size, 0, shards, 1 if size else count))
            if not size:
                tree.add(capacity, shards, shards + 1)
            shards += number
            continue
        while count:
            room = tree.tightest(size)
            each = (room if room is not None else capacity) // size if size else count
            want = max(1, count // each)
            if room is None:
                low, high = shards, shards + want
                shards, room = high, capacity
            else:
                low, high = tree.take(room, want)
            each = min(each, count)
            runs.append((size, first, low, each))
            first += each * (high - low)
            count -= each * (high - low)
            tree.add(room - each * size, low, high)
    return runs, shards


def shard(docs: DataFrame, capacity: int = CAPACITY, *, doc_id: str = "doc_id", text: str = "text", group: str | None = None) -> DataFrame:
    """(doc_id, group_key, group_bytes, shard, oversize) of every row.

    Groups are rows with equal ``group``, or without one rows with equal text (so that copies
    never end up in different shards); their size is their texts' UTF-8 bytes. Only ids, keys
    and sizes are shuffled, never texts. Groups of one size are numbered in the order of their
    keys by counts per (size, hash of key) and prefix sums, so that a frequent size isn't
    numbered in one task.

    Defined results: null and empty texts have no bytes; null texts are one group, apart from
    empty ones, and so are null keys; a group above the capacity has a shard of its own and
    oversize true; equal sizes take their keys' order and equal rooms the lowest shard;
    repeated rows count each; an empty table gives an empty table.
    """
    key = F.coalesce(F.md5(col(docs, text).cast("binary")), F.lit("null")) if group is None else F.coalesce(F.concat(F.lit("="), col(docs, group).cast("string")), F.lit("null"))
    rows = docs.select(col(docs, doc_id).alias("doc_id"), key.alias("group_key"), F.coalesce(F.octet_length(col(docs, text)), F.lit(0)).cast("long").alias("bytes"))
    spark = docs.sparkSession
    groups = keep(rows.groupBy("group_key").agg(F.sum("bytes").alias("group_bytes")).withColumn("part", F.substring(F.md5(F.col("group_key").cast("binary")), 1, 3)), "shard-groups")
    counts = groups.groupBy("group_bytes", "part").agg(F.count("*").alias("n"))
    runs, _ = pack([(r.group_bytes, r.n) for r in counts.groupBy("group_bytes").agg(F.sum("n").alias("n")).collect()], capacity)
    plan = spark.createDataFrame(runs, "group_bytes long, first long, low long, each long").repartition(max(1, min(shuffle_partitions(spark), len(runs) // 10_000 + 1)))
    ahead = Window.partitionBy("group_bytes").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    within = Window.partitionBy("group_bytes", "part").orderBy("group_key")
    # a run holds for all numbers up to the next run of its size. Runs meet the parts' first numbers, and each part its own runs: no task has all groups of a size
    nothing = F.lit(None)
    marks = plan.select("group_bytes", F.col("first").alias("at"), F.lit(0).alias("kind"), nothing.cast("string").alias("part"), F.struct("first", "low", "each").alias("run"))
    marks = marks.unionByName(offsets.select("group_bytes", F.col("ahead").alias("at"), F.lit(1).alias("kind"), "part", nothing.cast("struct<first:long,low:long,each:long>").alias("run")))
    so_far = Window.partitionBy("group_bytes").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    marks = marks.select("group_bytes", "kind", F.last("run", ignorenulls=True).over(so_far).alias("run"), F.last("part", ignorenulls=True).over(so_far).alias("part"))
    begun = offsets.join(marks.filter("kind = 1").select("group_bytes", "part", "run"), ["group_bytes", "part"])
    numbered = groups.withColumn("k", F.row_number().over(within) - 1).join(begun, ["group_bytes", "part"]).select("group_bytes", "part", (F.col("k") + F.col("ahead")).alias("at"), F.lit(1).alias("kind"), "group_key", "run")
    inner = marks.filter("kind = 0 AND part IS NOT NULL").select("group_bytes", "part", F.col("run.first").alias("at"), "kind", nothing.cast("string").alias("group_key"), "run")
    of_part = Window.partitionBy("group_bytes", "part").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    last = F.coalesce(F.last(F.when(F.col("kind") == 0, F.col("run")), ignorenulls=True).over(of_part), F.col("run"))
    placed = numbered.unionByName(inner).withColumn("run", last).filter("kind = 1").select("group_key", "group_bytes", (F.col("run.low") + F.floor((F.col("at") - F.col("run.first")) / F.col("run.each"))).cast("long").alias("shard"))
    return rows.select("doc_id", "group_key").join(placed, "group_key").select("doc_id", "group_key", "group_bytes", "shard", (F.col("group_bytes") > capacity).alias("oversize"))


def oracle(capacity: int = CAPACITY) -> str:
    """DuckDB SQL for :func:`shard` over documents: best fit decreasing one group at a time, by recursion."""
    return f"""
WITH RECURSIVE rows AS (SELECT doc_id, coalesce(md5(text), 'null') AS group_key, coalesce(strlen(text), 0) AS bytes FROM documents),
groups AS (SELECT group_key, CAST(sum(bytes) AS BIGINT) AS group_bytes FROM rows GROUP BY group_key),
steps AS (SELECT *, row_number() OVER (ORDER BY group_bytes DESC, substr(md5(group_key), 1, 3), group_key) AS i FROM groups),
packed AS (
  SELECT 0::BIGINT AS i, NULL::VARCHAR AS group_key, NULL::BIGINT AS group_bytes, NULL::BIGINT AS shard, CAST([] AS BIGINT[]) AS room
  UNION ALL
  SELECT i, group_key, group_bytes, pos, CASE WHEN pos = len(room) THEN room || [greatest({capacity} - group_bytes, -1)] ELSE list_transform(room, lambda r, k: CASE WHEN k = pos + 1 THEN r - group_bytes ELSE r END) END
  FROM (SELECT s.i, s.group_key, s.group_bytes, room, coalesce(list_position(room, list_min(list_filter(room, lambda r: r >= s.group_bytes))) - 1, len(room)) AS pos FROM packed p JOIN steps s ON s.i = p.i + 1))
SELECT doc_id, group_key, group_bytes, CAST(shard AS BIGINT) AS shard, group_bytes > {capacity} AS oversize FROM rows JOIN packed USING (group_key)
"""
