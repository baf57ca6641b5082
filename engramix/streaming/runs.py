"""The nightly work as micro-batches.

A batch's number is its sequence: what it writes goes under that number and replaces whatever
an earlier attempt left there, so a batch that runs twice counts once. Late rows are new work,
never dropped: results are kept per calendar period and added up over batches.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import temporal
from ..operators.graph import shared_folder
from ..sources import store as stores
from ..sources.store import Store


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a stream's output in the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def incremental(stream: DataFrame, step: Callable[[DataFrame, int], DataFrame], folder: str) -> DataFrame:
    """Run ``step`` on every batch that is there, each into its own part of ``folder``; the parts together, with the batch's number."""
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        step(batch, number).write.mode("overwrite").parquet(f"{folder}/parts/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/parts")


def period_counts(events: DataFrame, day: Column, resolutions: tuple[str, ...] = temporal.RESOLUTIONS) -> DataFrame:
    """(resolution, period_start, n) of a batch; adding up batches gives the whole."""
    own = events.select(day.cast("date").alias("d")).groupBy("d").agg(F.count("*").alias("n")).withColumn("resolution", F.explode(F.array(*map(F.lit, resolutions))))
    return own.groupBy("resolution", temporal.period_start(F.col("resolution"), F.col("d")).alias("period_start")).agg(F.sum("n").alias("n"))


def added_up(parts: DataFrame) -> DataFrame:
    return parts.groupBy("resolution", "period_start").agg(F.sum("n").alias("n"))


def publish_batches(stream: DataFrame, root: str, apply: Callable[[Store, DataFrame, int], Store], folder: str) -> Store:
    """Each batch becomes a published version of the store under a run named by its number; one that is published already is passed over."""
    spark = stream.sparkSession

    def run(batch: DataFrame, number: int) -> None:
        before = stores.load(spark, root)
        stores.publish(apply(before, batch, number + 1), root, f"batch-{number}", stores.RULES)

    stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return stores.load(spark, root)


#: How far a clock may be set back between batches without a row being taken for a late one.
_CLOCK = 86_400_000


def strengths(stream: DataFrame, half_life_days: float = 3.0, boost: float = 0.1, ttl_days: float = 60.0) -> DataFrame:
    """(user_id, strength, cues) after each batch: a key's strength decays with time and is lifted by every cue; the state is two numbers and a time a key.

    Cues that are older than the key's last one lift without decay, so a late row is still
    counted. A key without a cue for ``ttl_days`` of processing is forgotten. The time of
    processing is a column with a watermark: a timeout by Spark's own clock asks for one empty
    batch after another, so that a run over what is there would never end.
    """
    ttl = int(ttl_days * 86_400_000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        strength, cues, last = state.get if state.exists else (0.0, 0, None)
        rows = pd.concat(list(frames))
        times = np.sort(rows["ts"].astype("datetime64[us]").to_numpy().astype(np.int64)) / 1e6
        for at in times.tolist():
            if last is not None and at > last:
                strength *= 2 ** (-(at - last) / 86_400 / half_life_days)
            strength = min(1.0, strength + boost)
            last = at if last is None else max(last, at)
            cues += 1
        state.update((strength, cues, last))
        state.setTimeoutTimestamp(max(int(rows["__ms"].max()) + ttl - _CLOCK, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": [key[0]], "strength": [strength], "cues": [cues]})

    seen = stream.withColumn("__seen", F.current_timestamp()).withColumn("__ms", F.unix_millis("__seen")).withWatermark("__seen", f"{_CLOCK} milliseconds")
    return seen.groupBy("user_id").applyInPandasWithState(step, "user_id long, strength double, cues long", "strength double, cues long, last double", "update", GroupStateTimeout.EventTimeTimeout)


def rolling(events: DataFrame, now: datetime, days: int) -> DataFrame:
    """Events (ts) of the window that ends now."""
    return events.filter((F.col("ts") > F.lit(now) - F.expr(f"INTERVAL {days} DAYS")) & (F.col("ts") <= F.lit(now)))
