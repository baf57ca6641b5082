"""Joins over time: versions, intervals, neighbours in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of each group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


def overlapping(periods: DataFrame, low, high) -> DataFrame:
    """Periods that touch a window; literals, so the filter reaches the scan."""
    return periods.filter((F.col("period_start") <= F.lit(high)) & (F.col("period_end") >= F.lit(low)))


def containing(fine: DataFrame, coarse: DataFrame) -> DataFrame:
    """(fine_id, coarse_id) of periods inside others. Joined by year, so that it is no cross product; a coarse period stands in each of its years."""
    years = F.explode(F.sequence(F.year("period_start"), F.year("period_end")))
    c = coarse.select(F.col("id").alias("coarse_id"), F.col("period_start").alias("s"), F.col("period_end").alias("e"), years.alias("y"))
    f = fine.select(F.col("id").alias("fine_id"), "period_start", "period_end", F.year("period_start").alias("y"))
    return f.join(c, "y").filter("s <= period_start AND e >= period_end").select("fine_id", "coarse_id")


def previous(df: DataFrame, keys: list[str], order: list, columns: dict[str, str]) -> DataFrame:
    """Each row with columns of the one before it in its group; null for the first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns({new: F.lag(old).over(w) for new, old in columns.items()})


def band_pairs(df: DataFrame, key: str, stamp: str, ident: str, seconds: int) -> DataFrame:
    """(left_id, right_id) of rows of a key at most ``seconds`` apart. Time is cut into bands that long and each row meets its own and the next, so a long-lived key is no hot group."""
    at = F.unix_micros(F.col(stamp).cast("timestamp"))
    width = seconds * 1_000_000
    own = df.select(F.col(key).alias("k"), F.col(ident).alias("i"), at.alias("t")).withColumn("band", F.floor(F.col("t") / width))
    left = own.select("k", F.col("i").alias("left_id"), F.col("t").alias("lt"), F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    right = own.select("k", F.col("i").alias("right_id"), F.col("t").alias("rt"), "band")
    return left.join(right, ["k", "band"]).filter((F.col("left_id") < F.col("right_id")) & (F.abs(F.col("lt") - F.col("rt")) <= width)).select("left_id", "right_id")
