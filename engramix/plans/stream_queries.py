"""Micro-batch runs, entities and rendered texts over whole tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import entities, rendering, text
from ..functions.temporal import RESOLUTIONS
from ..operators import nightly, weave
from ..sources.tuning import Tuning
from ..streaming import runs
from .registry import query, table
from .retrieval_queries import document_store
from .text_queries import NORM


def _events(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("recursiveFileLookup", True).parquet(path)


@query("stream_period_counts", " UNION ALL ".join(f"SELECT '{r}' AS resolution, CAST(date_trunc('{r}', ts) AS DATE) AS period_start, count(*) AS n FROM events GROUP BY 2" for r in RESOLUTIONS))
def stream_period_counts(spark, sf_dir):
    """STR1-STR3, STR6: events per calendar period, batch by batch."""
    parts = runs.incremental(_events(spark, sf_dir), lambda b, n: runs.period_counts(b, F.col("ts")), runs.work_folder(spark, "periods"))
    return runs.added_up(parts.drop("batch")).withColumn("n", F.col("n").cast("long"))


@query("stream_strengths")
def stream_strengths(spark, sf_dir):
    """STR5: each user's decaying strength, kept as state."""
    folder = runs.work_folder(spark, "strengths")
    out = runs.strengths(_events(spark, sf_dir).select("user_id", F.col("ts").cast("timestamp").alias("ts")))

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/parts/batch={number}")

    out.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(f"{folder}/parts")
    return found.groupBy("user_id").agg(F.max_by("strength", "batch").alias("strength"), F.max("cues").alias("cues"))


@query("rolling_window", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-20' - INTERVAL 7 DAY AND ts <= TIMESTAMP '2024-01-20'")
def rolling_window(spark, sf_dir):
    """STR4: the week that ends now."""
    return runs.rolling(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), datetime(2024, 1, 20), 7).select("event_id")


@query("case_counts", "SELECT lower(w) AS word, count(*) FILTER (NOT regexp_matches(w, '^[A-Z]')) AS lower, count(*) FILTER (regexp_matches(w, '^[A-Z]')) AS upper FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z][a-z]{2,}')) AS w FROM documents) GROUP BY 1")
def case_counts(spark, sf_dir):
    """AG14: how the corpus writes each word."""
    return entities.case_counts(table(spark, sf_dir, "documents").select(F.col("text").alias("fact")))


@query("corpus_entities")
def corpus_entities(spark, sf_dir):
    """AG15, SC18, SC19, UD4, WV2: entities that the whole corpus proposes."""
    f = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("signature"), F.concat("text", F.lit(" (issue #"), F.col("turn") + 10, F.lit(")")).alias("fact"))
    none = spark.createDataFrame([], "signature string, sig string")
    return entities.new_hubs(f, none.select("signature"), none.select("sig"))


_FORM = "SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]{4,}')) AS form FROM benchmark"


@query("vocabulary_mentions", f"WITH v AS ({_FORM}) SELECT 'd:' || doc_id AS src, 'topic:' || form AS dst FROM (SELECT doc_id, ' ' || {NORM.format('text')} || ' ' AS n FROM documents), v WHERE form <> '' AND contains(n, ' ' || form || ' ')")
def vocabulary_mentions(spark, sf_dir):
    """JN18, SC17, WV3: documents that name a hub by one of its forms."""
    form = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{4,}"), F.lit(0)))
    hubs = table(spark, sf_dir, "benchmark").select(form.alias("f")).distinct().select(F.concat(F.lit("topic:"), "f").alias("signature"), F.array("f").alias("forms"))
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d:"), "doc_id").alias("signature"), F.col("text").alias("fact"))
    return weave.co_mentions(docs, weave.vocabulary(hubs), longest=1)


@query("hub_texts", "SELECT 'nation:' || lower(n_name) AS signature, replace(lower(n_name), '-', ' ') || ' (nation). lies in ' || lower(r_name) || ' (region)' AS text FROM nation JOIN region ON r_regionkey = n_regionkey")
def hub_texts(spark, sf_dir):
    """SC20: hubs without a fact, in words."""
    j = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    e = j.select(F.concat(F.lit("nation:"), F.lower("n_name")).alias("src"), F.lit("lies_in").alias("rel"), F.concat(F.lit("region:"), F.lower("r_name")).alias("dst"))
    return rendering.neighbourhood(e.select(F.col("src").alias("signature")), e)


@query("evidence_spans", "SELECT l_suppkey AS gist, CAST(min(l_shipdate) AS DATE) AS first_day, CAST(max(l_shipdate) AS DATE) AS last_day, count(*) AS n FROM lineitem GROUP BY 1")
def evidence_spans(spark, sf_dir):
    """AG5, RC15: since when and until when there is evidence, and how much."""
    day = F.col("l_shipdate").cast("date")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("gist")).agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count("*").alias("n"))


@query("temporal_envelopes", f"""WITH e AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS s, o_orderkey, '- ' || o_orderpriority || ': ' || o_orderstatus AS line FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY o_orderkey) AS k, count(*) OVER (PARTITION BY s) AS n FROM e)
SELECT CAST(s AS VARCHAR) AS node_sig, '[temporal memory, month ' || CAST(s AS VARCHAR) || ' to ' || CAST(CAST(s + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE) AS VARCHAR) || '] {rendering.NOTICE}' || chr(10) || string_agg(line, chr(10) ORDER BY k) FILTER (k <= 3 OR k > n - 3) || CASE WHEN any_value(n) > 6 THEN chr(10) || '(' || (any_value(n) - 6) || ' more)' ELSE '' END AS text FROM r GROUP BY s""")
def temporal_envelopes(spark, sf_dir):
    """SC41: months of orders as rendered calendar memories."""
    o = table(spark, sf_dir, "orders").withColumn("s", F.trunc("o_orderdate", "month"))
    c = o.select("s").distinct().select(F.col("s").cast("string").alias("node_sig"), F.lit("month").alias("resolution"), F.col("s").alias("period_start"), F.last_day("s").alias("period_end"))
    e = o.select(F.col("s").cast("string").alias("chronicle_sig"), F.col("o_orderkey").alias("ordinal"), F.col("o_orderpriority").alias("slot_label"), F.col("o_orderstatus").alias("summary"))
    return rendering.temporal(c, e)


@query("companion_chronicles", "WITH p AS (SELECT l_suppkey, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS s, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1, 2) SELECT signature, s AS period_start FROM (SELECT 's:' || l_suppkey AS signature, s, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, s DESC) AS k FROM p) WHERE k = 1")
def companion_chronicles(spark, sf_dir):
    """AG20: the quarter that shares most of a supplier's evidence."""
    li = table(spark, sf_dir, "lineitem").withColumn("s", F.trunc("l_shipdate", "quarter"))
    # a piece of evidence is an order of the supplier in that quarter
    ev = F.concat_ws("|", "l_orderkey", "l_suppkey", "s")
    gist = li.select(F.concat(F.lit("s:"), "l_suppkey").alias("gist_sig"), ev.alias("detail_sig")).distinct()
    e = li.select(F.col("s").cast("string").alias("chronicle_sig"), ev.alias("evidence_sig")).distinct()
    c = li.select("s").distinct().select(F.col("s").cast("string").alias("node_sig"), F.lit("quarter").alias("resolution"), F.col("s").alias("period_start"), F.last_day(F.add_months("s", 2)).alias("period_end"))
    return rendering.companion(gist, e, c).select("signature", "period_start")


@query("nightly_run")
def nightly_run(spark, sf_dir):
    """Entry B, DR1-DR12: a whole night over the documents: weave, then upkeep; its summary."""
    s = nightly.woven(document_store(spark, sf_dir), 1, 0.25, 0.35)
    return nightly.kept_up(s, datetime(2024, 7, 1), 1, Tuning.resolve({"capacity": "compact"}, {}))[1]


@query("entity_forms", "SELECT DISTINCT p_brand AS brand, trim(regexp_replace(regexp_replace(lower(p_brand), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) AS form FROM part")
def entity_forms(spark, sf_dir):
    """SC16: the surface forms of a hub."""
    b = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand")).distinct()
    return b.select("brand", F.explode(text.forms_for(F.concat(F.lit("brand:"), "brand"))).alias("form"))
