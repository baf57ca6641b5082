"""Graph and time joins over whole tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import temporal
from ..operators import graph, periods
from .registry import query, table

# orders mention their customer, items their supplier; orders of a customer follow one another
_MENTIONS = "SELECT 'o:' || o_orderkey AS src, 'c:' || o_custkey AS dst FROM orders"


def mentions(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("o:"), "o_orderkey").alias("src"), F.concat(F.lit("c:"), "o_custkey").alias("dst"))


_SEQUENCE = "SELECT * FROM (SELECT CAST(lag(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS src, o_orderkey AS dst FROM orders) WHERE src IS NOT NULL"


def sequence(spark, sf_dir):
    w = Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select(F.lag("o_orderkey").over(w).alias("src"), F.col("o_orderkey").alias("dst")).filter("src IS NOT NULL")


@query("degree_map", f"WITH m AS ({_MENTIONS}) SELECT signature, count(*) AS degree FROM (SELECT src AS signature FROM m UNION ALL SELECT dst FROM m) GROUP BY 1")
def degree_map(spark, sf_dir):
    """AG1: both ends of every edge."""
    return graph.degree(mentions(spark, sf_dir))


@query("hub_specificity", f"WITH m AS ({_MENTIONS}), n AS (SELECT greatest(8, ceil(0.2 * count(*))) AS cap FROM m) SELECT dst, count(*) AS degree, count(*) <= any_value(cap) AS specific FROM m, n GROUP BY dst")
def hub_specificity(spark, sf_dir):
    """AG2: mentions of each hub, and whether it is specific."""
    m = mentions(spark, sf_dir)
    return graph.hub_degree(m).withColumn("specific", F.col("degree") <= graph.hub_cap(m.count()))


@query("schema_fit", f"WITH m AS ({_MENTIONS}), d AS (SELECT dst, count(*) AS degree FROM m GROUP BY dst), n AS (SELECT greatest(8, ceil(0.2 * count(*))) AS cap FROM m) SELECT src, round(least(1.0, max(degree) / 6.0::DOUBLE), 6) AS fit FROM m JOIN d USING (dst), n WHERE degree < cap GROUP BY src")
def schema_fit(spark, sf_dir):
    """AG3: how well connected each fact is."""
    m = mentions(spark, sf_dir)
    return graph.schema_fit(m, m.count()).withColumn("fit", F.round("fit", 6))


@query("co_mention_pairs", f"WITH m AS ({_MENTIONS}), d AS (SELECT dst FROM m GROUP BY dst HAVING count(*) <= greatest(8, ceil(0.2 * (SELECT count(*) FROM m)))), o AS (SELECT DISTINCT src, dst FROM m JOIN d USING (dst)) SELECT a.src AS \"left\", b.src AS \"right\", count(*) AS hubs FROM o a JOIN o b ON a.dst = b.dst AND a.src < b.src GROUP BY 1, 2")
def co_mention_pairs(spark, sf_dir):
    """JN2: facts that share a specific hub."""
    m = mentions(spark, sf_dir)
    return graph.co_mentions(m, graph.hub_cap(m.count()))


_LINKS = "SELECT 'c:' || c_custkey AS src, 'n:' || c_nationkey AS dst FROM customer UNION ALL SELECT 'o:' || o_orderkey, 'c:' || o_custkey FROM orders"


@query("khop_reach", f"""WITH RECURSIVE e AS ({_LINKS}), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), seeds AS (SELECT 'n:' || n_nationkey AS seed FROM nation),
w AS (SELECT seed, seed AS signature, 0 AS hops FROM seeds UNION SELECT seed, dst, hops + 1 FROM w JOIN b ON signature = src WHERE hops < 2)
SELECT seed, signature, min(hops) AS hops FROM w GROUP BY 1, 2""")
def khop_reach(spark, sf_dir):
    """JN13, RC3: what each nation reaches in two hops over customers and orders."""
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c:"), "c_custkey").alias("src"), F.concat(F.lit("n:"), "c_nationkey").alias("dst"))
    seeds = table(spark, sf_dir, "nation").select(F.concat(F.lit("n:"), "n_nationkey").alias("seed"))
    return graph.k_hop(c.unionByName(mentions(spark, sf_dir)), seeds, 2)


@query("sequence_components", f"WITH RECURSIVE s AS ({_SEQUENCE}), n AS (SELECT src AS node FROM s UNION SELECT dst FROM s), h AS (SELECT node FROM n WHERE node NOT IN (SELECT dst FROM s)), w AS (SELECT node, node AS head FROM h UNION ALL SELECT dst, head FROM w JOIN s ON node = src) SELECT node, min(node) OVER (PARTITION BY head) AS component FROM w")
def sequence_components(spark, sf_dir):
    """JN14, RC5: whole chains of orders, each named by its smallest."""
    return graph.components(sequence(spark, sf_dir))


_NEAR = "SELECT a.vec_id AS src, b.vec_id AS dst FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) >= 0.35"


@query("similarity_components", f"WITH RECURSIVE e AS ({_NEAR}), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), w AS (SELECT DISTINCT src AS node, src AS root FROM b UNION SELECT dst, root FROM w JOIN b ON node = src) SELECT node, min(root) AS component FROM w GROUP BY node")
def similarity_components(spark, sf_dir):
    """JN17, RA9: groups of vectors chained by likeness."""
    from ..functions.vector import knn_pairs

    near = knn_pairs(table(spark, sf_dir, "embeddings"), None, 0.35)
    return graph.components(near.select(F.col("vec_id").alias("src"), F.col("neighbour_id").alias("dst")))


_TREE = "SELECT 'r:' || n_regionkey AS parent, 'n:' || n_nationkey AS child FROM nation UNION ALL SELECT 'n:' || c_nationkey, 'c:' || c_custkey FROM customer UNION ALL SELECT 'c:' || o_custkey, 'o:' || o_orderkey FROM orders"


def _tree(spark, sf_dir):
    pair = lambda t, a, x, b, y: table(spark, sf_dir, t).select(F.concat(F.lit(a), x).alias("parent"), F.concat(F.lit(b), y).alias("child"))
    return pair("nation", "r:", "n_regionkey", "n:", "n_nationkey").unionByName(pair("customer", "n:", "c_nationkey", "c:", "c_custkey")).unionByName(pair("orders", "c:", "o_custkey", "o:", "o_orderkey"))


@query("evidence_descent", f"WITH RECURSIVE t AS ({_TREE}), w AS (SELECT 'r:' || r_regionkey AS root, 'r:' || r_regionkey AS node, 0 AS depth FROM region UNION ALL SELECT root, child, depth + 1 FROM w JOIN t ON node = parent WHERE depth < 5) SELECT * FROM w")
def evidence_descent(spark, sf_dir):
    """JN15: everything below each region, with its depth."""
    roots = table(spark, sf_dir, "region").select(F.concat(F.lit("r:"), "r_regionkey").alias("root"))
    return graph.descend(_tree(spark, sf_dir), roots, 5)


@query("cascade_delete", f"WITH RECURSIVE t AS ({_TREE}), gone AS (SELECT 'n:' || n_nationkey AS node, 0 AS depth FROM nation WHERE n_regionkey = 1 UNION SELECT child, depth + 1 FROM gone JOIN t ON node = parent), d AS (SELECT node, max(depth) AS depth FROM gone GROUP BY node) SELECT node, row_number() OVER (ORDER BY depth DESC, node) AS place FROM d")
def cascade_delete(spark, sf_dir):
    """JN16: what depends on the nations of a region, in the order in which it can be taken away."""
    roots = table(spark, sf_dir, "nation").filter("n_regionkey = 1").select(F.concat(F.lit("n:"), "n_nationkey").alias("root"))
    below = graph.descend(_tree(spark, sf_dir), roots, 5).groupBy("node").agg(F.max("depth").alias("depth"))
    counts = below.groupBy("depth").agg(F.count("*").alias("n"))
    ahead = counts.withColumn("ahead", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("depth", "ahead")
    within = F.row_number().over(Window.partitionBy("depth").orderBy("node"))
    return below.withColumn("k", within).join(F.broadcast(ahead), "depth").select("node", (F.col("k") + F.col("ahead")).alias("place"))


@query("dangling_and_islands", "SELECT 'island' AS fault, 'c:' || c_custkey AS signature FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'dangling', 'o:' || o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')")
def dangling_and_islands(spark, sf_dir):
    """JN4, JN5: nodes without an edge, and edges without a node."""
    m = mentions(spark, sf_dir)
    c = table(spark, sf_dir, "customer")
    all_ = c.select(F.concat(F.lit("c:"), "c_custkey").alias("signature"))
    some = c.filter("c_mktsegment <> 'BUILDING'").select(F.concat(F.lit("c:"), "c_custkey").alias("signature")).unionByName(m.select(F.col("src").alias("signature")))
    lost = graph.dangling(m, some).select(F.lit("dangling").alias("fault"), F.col("src").alias("signature"))
    return graph.islands(all_, m).select(F.lit("island").alias("fault"), "signature").unionByName(lost)


@query("hub_fold", "SELECT src, 'mentions' AS rel, dst, max(w) AS weight FROM (SELECT 'o:' || o_orderkey AS src, 'n:' || c_nationkey AS dst, o_totalprice AS w FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY src, dst")
def hub_fold(spark, sf_dir):
    """WV12, RA3: customers folded into their nations; edges repointed and repeats dropped."""
    e = table(spark, sf_dir, "orders").select(F.concat(F.lit("o:"), "o_orderkey").alias("src"), F.lit("mentions").alias("rel"), F.concat(F.lit("c:"), "o_custkey").alias("dst"), F.col("o_totalprice").alias("weight"))
    alias = table(spark, sf_dir, "customer").select(F.concat(F.lit("c:"), "c_custkey").alias("alias"), F.concat(F.lit("n:"), "c_nationkey").alias("canonical"))
    return graph.fold(e, alias)


@query("nearest_older", "SELECT o_orderkey, older FROM (SELECT a.o_orderkey, b.o_orderkey AS older, row_number() OVER (PARTITION BY a.o_orderkey ORDER BY b.o_orderdate DESC, b.o_orderkey) AS k FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderdate < a.o_orderdate AND b.o_totalprice >= a.o_totalprice * 0.8) WHERE k = 1")
def nearest_older(spark, sf_dir):
    """JN10, WV8: the latest strictly older order of the customer that is about as large."""
    o = table(spark, sf_dir, "orders")
    pair = o.alias("a").join(o.alias("b"), (F.col("a.o_custkey") == F.col("b.o_custkey")) & (F.col("b.o_orderdate") < F.col("a.o_orderdate")) & (F.col("b.o_totalprice") >= F.col("a.o_totalprice") * 0.8))
    best = F.max_by("b.o_orderkey", F.struct(F.col("b.o_orderdate").alias("t"), (-F.col("b.o_orderkey")).alias("k")))
    return pair.groupBy(F.col("a.o_orderkey").alias("o_orderkey")).agg(best.alias("older"))


@query("previous_period", "WITH p AS (SELECT DISTINCT resolution, CAST(date_trunc(resolution, o_orderdate) AS DATE) AS s FROM orders, (VALUES ('month'), ('quarter'), ('year')) r(resolution)) SELECT resolution, s AS period_start, lag(s) OVER (PARTITION BY resolution ORDER BY s) AS previous_start FROM p")
def previous_period(spark, sf_dir):
    """JN11: every calendar period with orders, and the one before it."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct().withColumn("resolution", F.explode(F.array(F.lit("month"), F.lit("quarter"), F.lit("year"))))
    p = o.select("resolution", temporal.period_start(F.col("resolution"), F.col("d")).alias("period_start")).distinct()
    return periods.previous(p, ["resolution"], ["period_start"], {"previous_start": "period_start"})


@query("band_join_24h", "SELECT a.event_id AS left_id, b.event_id AS right_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id AND abs(date_diff('microsecond', a.ts, b.ts)) <= 86400000000")
def band_join_24h(spark, sf_dir):
    """JN12: a user's events at most a day apart."""
    return periods.band_pairs(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 86_400)


_VERSIONS = "SELECT 'day' AS resolution, CAST(o_orderdate AS DATE) AS period_start, o_orderkey AS node, row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderkey) AS version FROM orders"


@query("latest_version", f"SELECT period_start, max(version) AS version, arg_max(node, version) AS node FROM ({_VERSIONS}) GROUP BY period_start")
def latest_version(spark, sf_dir):
    """JN7: the newest version of every period."""
    day = F.col("o_orderdate").cast("date")
    v = table(spark, sf_dir, "orders").select(day.alias("period_start"), F.col("o_orderkey").alias("node"), F.row_number().over(Window.partitionBy(day).orderBy("o_orderkey")).cast("long").alias("version"))
    return periods.latest(v, ["period_start"], [F.desc("version")]).select("period_start", "version", "node")


def _months(spark, sf_dir, resolution):
    d = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    p = d.select(temporal.period_start(resolution, F.col("d")).alias("period_start"), temporal.period_end(resolution, F.col("d")).alias("period_end")).distinct()
    return p.withColumn("id", F.concat(F.lit(f"{resolution}:"), F.col("period_start").cast("string")))


_PERIOD = "SELECT DISTINCT '{0}:' || CAST(CAST(date_trunc('{0}', o_orderdate) AS DATE) AS VARCHAR) AS id, CAST(date_trunc('{0}', o_orderdate) AS DATE) AS s, CAST(date_trunc('{0}', o_orderdate) + INTERVAL {1} - INTERVAL 1 DAY AS DATE) AS e FROM orders"


@query("period_containment", f"SELECT w.id AS fine_id, m.id AS coarse_id FROM ({_PERIOD.format('week', '7 DAY')}) w JOIN ({_PERIOD.format('quarter', '3 MONTH')}) m ON m.s <= w.s AND m.e >= w.e")
def period_containment(spark, sf_dir):
    """JN9, SNK5: weeks inside quarters."""
    return periods.containing(_months(spark, sf_dir, "week"), _months(spark, sf_dir, "quarter"))


@query("period_overlap", f"SELECT id FROM ({_PERIOD.format('month', '1 MONTH')}) WHERE s <= DATE '1998-03-10' AND e >= DATE '1997-11-20'")
def period_overlap(spark, sf_dir):
    """JN8: months that touch a window."""
    return periods.overlapping(_months(spark, sf_dir, "month"), "1997-11-20", "1998-03-10").select("id")
