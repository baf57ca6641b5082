"""The folder that all executors share, and tables written into it.

Lineage is cut by writing a table there and reading it again, so that a lost executor costs
a re-read and never the work of earlier steps.
"""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only where it is unset (tests, local runs) a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="engramix-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return f"file://{_OWN[app]}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back; no lineage is left."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._engramix_path = path
    return found


def drop(*tables: DataFrame) -> None:
    """Delete tables written by :func:`keep` that nothing will read again, and let Spark free their shuffles."""
    for df in tables:
        path = getattr(df, "_engramix_path", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` itself if it is read straight from files, else kept: rows that a shuffle brings come in any order, and a task that is run again must see its rows in the same one."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    straight = all(x not in plan for x in ("Exchange", "Aggregate", "Join")) and ("FileScan" in plan or "LocalTableScan" in plan)
    return df if straight else keep(df, name)


#: Text bytes that one bucket of an exchange holds, where there are more of them than the session's shuffles need.
BUCKET_BYTES = 64_000_000


def enough_parts(df: DataFrame, text: str) -> int:
    """Buckets for what is made of the column's texts: three for each shuffle partition, more where there is so much text."""
    total = df.agg(F.sum(F.octet_length(text).cast("long")).alias("n")).first().n or 0
    return max(3 * shuffle_partitions(df.sparkSession), -(-total // BUCKET_BYTES))


def free_shuffles(spark: SparkSession) -> None:
    """Shuffle files go when the driver's JVM collects the plans that made them; ask it to, between large steps."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def spare_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have, whatever the letter case."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def with_fields(df: DataFrame, **new: T.DataType) -> T.StructType:
    """``df``'s schema and the new fields, under names that it doesn't have."""
    fields = list(df.schema.fields)
    return T.StructType([*fields, *(T.StructField(spare_name(df, n), t) for n, t in new.items())])


def col(df: DataFrame, name: str) -> Column:
    """A column of ``df`` by its exact name, dots and back quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def small_rows(df: DataFrame, at_most: int) -> list | None:
    """The rows of ``df``, or None if there are more than ``at_most``; never more than that reach the driver."""
    rows = df.limit(at_most + 1).collect()
    return None if len(rows) > at_most else rows


def byte_slices(texts: pa.Array, most: int = 3_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes of text each; a longer text has one to itself."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    at = 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, to
        at = to


#: What separates words; Java, RE2 and Arrow agree on these six.
WORD = "[^ \\t\\n\\x0B\\f\\r]+"
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads near values far apart."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def coded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each text's words start (one entry more), the number of every word, and the 64-bit hashes of the distinct words; words are runs without ASCII white space."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat = pc.list_flatten(lists)
    at = lists.offsets.to_numpy().astype(np.int64)
    at -= at[0]
    if len(flat) == 0:
        return at, np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    coded = flat.dictionary_encode()
    words = coded.dictionary.to_pylist()
    each = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), dtype=np.uint64, count=len(words))
    number = coded.indices.to_numpy()
    if "" not in words:
        return at, number, each
    blank = words.index("")  # white space at a text's ends leaves empty words
    ok = number != blank
    number = number[ok]
    return np.concatenate([[0], np.cumsum(ok)])[at], number - (number > blank), np.delete(each, blank)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each text's words start (one entry more), and a 64-bit hash of every word."""
    at, number, each = coded_words(texts)
    return at, each[number]


def planes(x: np.ndarray) -> bytes:
    """Sorted 64-bit numbers by byte planes, whose high ones compress to nearly nothing."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()


def unplanes(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, dtype=np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (n[0] of them), start[1], ..."""
    ends = np.cumsum(n)
    return np.arange(int(ends[-1]) if len(n) else 0, dtype=np.int64) + np.repeat(start - (ends - n), n)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def frugal(run: Callable) -> Callable:
    """``run`` over batches or groups, such that a worker gives its memory back when it is done; workers stay for later tasks."""

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            give_back()

    return batches_of


def frugal_group(run: Callable) -> Callable:
    """The same for a function of one group's table."""

    def of(table: pa.Table) -> pa.Table:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            return run(table)
        finally:
            give_back()

    return of


def frugal_pair(run: Callable) -> Callable:
    """The same for a function of two cogrouped tables."""

    def of(left: pa.Table, right: pa.Table) -> pa.Table:
        return frugal_group(lambda table: run(table, right))(left)

    return of


def give_back() -> None:
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps what it has
        pass
