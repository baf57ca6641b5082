"""Mixing sources to target weights.

Each source's tokens are summed over the whole corpus. A source with weight w of a total W
should have w / W of ``budget`` tokens, so its documents are repeated at the rate
budget * w / W / tokens: every document floor(rate) times, and once more if a number hashed
from its id falls below the fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .shared import col, small_rows, spare_name

#: Weights of sources that are named; all others get ``default_weight``.
PRODUCTION_WEIGHTS = {"src0": 4.0, "src1": 2.0, "src2": 0.5}
SEED = 17
#: Keys that the rows of one source have where rates are joined by shuffle.
SALTS = 64


def token_count(text: Column) -> Column:
    """Runs of characters other than blank, tab, line feed, form feed and carriage return."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\f\\r]+")), F.lit(0)).cast("long")


def draw(identity: Column, seed: int) -> Column:
    """A number in [0, 1) from 52 bits of MD5 over seed and identity: the same in every engine and on every run."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), identity).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(2**52))


def source_rates(
    docs: DataFrame,
    weights: dict[str, float],
    default_weight: float = 1.0,
    budget: float | None = None,
    *,
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """(source, tokens, rate) of every source, counted over all documents.

    The budget is the corpus's own number of tokens unless given. Sources without a token
    take no share of the budget and have rate 1: they pass as they are. A null source is a
    source of its own, with the default weight. With nothing but zero weights every rate is 0.
    """
    if default_weight < 0 or any(w < 0 for w in weights.values()):
        raise ValueError("weights can't be negative")
    per = docs.select(col(docs, source).cast("string").alias("source"), token_count(col(docs, text)).alias("n")).groupBy("source").agg(F.sum("n").alias("tokens"))
    weight = F.lit(float(default_weight))
    if weights:
        table = F.create_map(*[F.lit(x) for kv in sorted(weights.items()) for x in (kv[0], float(kv[1]))])
        weight = F.when(F.col("source").isNull(), weight).otherwise(F.coalesce(F.element_at(table, F.col("source")), weight))
    per = per.withColumn("weight", weight)
    total = per.agg(F.sum("tokens").alias("all_tokens"), F.sum(F.when(F.col("tokens") > 0, F.col("weight"))).alias("all_weight"))
    share = F.lit(float(budget)) if budget is not None else F.col("all_tokens").cast("double")
    rate = F.when(F.col("tokens") == 0, F.lit(1.0)).when(F.col("all_weight") > 0, share * (F.col("weight") / F.col("all_weight")) / F.col("tokens")).otherwise(F.lit(0.0))
    return per.crossJoin(total).select("source", "tokens", rate.alias("rate"))


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] = PRODUCTION_WEIGHTS,
    default_weight: float = 1.0,
    budget: float | None = None,
    seed: int = SEED,
    *,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    copy_column: str | None = "copy",
    most_broadcast_sources: int = 100_000,
) -> DataFrame:
    """``docs`` repeated to the target weights, all columns kept, with the number of the copy (from 1) last.

    Only one row per source is aggregated, with partial sums on the map side; texts are never
    shuffled while there are at most ``most_broadcast_sources`` sources, whose rates (some 50
    bytes each) are then broadcast. With more, rates are joined by shuffle, each source's rows
    spread over ``SALTS`` keys by a hash of their ids.

    Defined results: null text has no tokens but is repeated at its source's rate; a null id
    draws by its text; rows repeated in the input (same id) draw alike, so all of them get the
    extra copy or none; an empty table gives an empty table; ``copy_column=None`` leaves the
    columns as they were; a column of that name in the input keeps its place and the new one
    gets underscores.
    """
    rates = source_rates(docs, weights, default_weight, budget, source=source, text=text).select("source", "rate")
    rows = small_rows(rates, most_broadcast_sources)
    key, rate, copies = (spare_name(docs, x) for x in ("mix_source", "mix_rate", "mix_copies"))
    named = docs.sparkSession.createDataFrame(rows, rates.schema) if rows is not None else rates
    named = named.select(F.col("source").alias(key), F.col("rate").alias(rate))
    identity = F.coalesce(col(docs, doc_id).cast("string"), F.concat(F.lit("text:"), F.coalesce(col(docs, text), F.lit(""))))
    same = col(docs, source).cast("string").eqNullSafe(F.col(key))
    if rows is not None:
        joined = docs.join(F.broadcast(named), same)
    else:
        salt = spare_name(docs, "mix_salt")
        named = named.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = docs.join(named, same & (F.pmod(F.xxhash64(identity), F.lit(SALTS)).cast("int") == F.col(salt)))
    whole = F.floor(F.col(rate))
    n = (whole + (draw(identity, seed) < F.col(rate) - whole).cast("long")).cast("int")
    counted = joined.withColumn(copies, n).filter(F.col(copies) > 0)
    own = [col(docs, c) for c in docs.columns]
    if copy_column is None:
        return counted.select(*own, F.explode(F.sequence(F.lit(1), F.col(copies))).alias(copies)).select(*own)
    return counted.select(*own, F.explode(F.sequence(F.lit(1), F.col(copies))).alias(spare_name(docs, copy_column)))


def oracle(weights: dict[str, float] = PRODUCTION_WEIGHTS, default_weight: float = 1.0, seed: int = SEED) -> str:
    """DuckDB SQL for :func:`mix_sources` over the table documents."""
    cases = " ".join(f"WHEN '{k}' THEN {float(w)!r}::DOUBLE" for k, w in sorted(weights.items()))
    return f"""
WITH per AS (
  SELECT source, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\f\\r]+'))) AS BIGINT) AS tokens,
         CASE source {cases} ELSE {float(default_weight)!r}::DOUBLE END AS weight
  FROM documents GROUP BY source),
total AS (SELECT CAST(sum(tokens) AS DOUBLE) AS all_tokens, sum(weight) FILTER (tokens > 0) AS all_weight FROM per),
rates AS (
  SELECT source, CASE WHEN tokens = 0 THEN 1.0::DOUBLE WHEN all_weight > 0 THEN all_tokens * (weight / all_weight) / tokens ELSE 0.0::DOUBLE END AS rate
  FROM per, total),
drawn AS (
  SELECT d.*, floor(rate) + CASE WHEN ('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'text:' || coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE / {float(2**52)!r}::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END AS n
  FROM documents d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, text, lang, source, n_chars, CAST(unnest(generate_series(1, CAST(n AS BIGINT))) AS INTEGER) AS copy FROM drawn WHERE n > 0
"""
