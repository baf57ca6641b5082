"""The read path over whole tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions import scoring, vector
from ..operators import recall, weave
from ..sources.shared import cut
from ..sources.store import Store
from .graph_queries import mentions
from .maintenance_queries import FACTS, facts
from .registry import query, table

_QUESTION = "(SELECT embedding::DOUBLE[] AS q FROM embeddings ORDER BY vec_id LIMIT 1)"


def _question(spark, sf_dir) -> list[float]:
    return [float(x) for x in table(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()[0]]


@query("knn_topk", f"SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], q), 6) AS cosine FROM embeddings, {_QUESTION} ORDER BY cosine DESC, vec_id LIMIT 64")
def knn_topk(spark, sf_dir):
    """WN1: the 64 nearest to one question."""
    return vector.top_k(table(spark, sf_dir, "embeddings"), _question(spark, sf_dir), 64)


_PAIR = "round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)"


@query("knn_pairs_rank", f"SELECT vec_id, neighbour_id, cosine, CAST(rank AS INTEGER) AS rank FROM (SELECT a.vec_id, b.vec_id AS neighbour_id, {_PAIR} AS cosine, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_PAIR} DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE rank <= 11")
def knn_pairs_rank(spark, sf_dir):
    """WN2: the eleven nearest of every vector."""
    return vector.knn_pairs(table(spark, sf_dir, "embeddings"), 11)


_EDGE = f"SELECT a.vec_id AS src, b.vec_id AS dst, {_PAIR} AS c, a.label = b.label AS kin, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_PAIR} DESC, b.vec_id) AS k FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id"


@query("knn_threshold_edges", f"WITH n AS ({_EDGE}), o AS (SELECT src, dst, CASE WHEN kin AND c >= 0.25 THEN 'related_to' WHEN c >= 0.35 THEN 'similar_to' END AS rel, round(c, 3) AS weight, c FROM n WHERE k <= 11), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY c DESC, dst) AS j FROM o WHERE rel IS NOT NULL) SELECT src, rel, dst, weight FROM r WHERE j <= 3")
def knn_threshold_edges(spark, sf_dir):
    """WV5: sibling links, three a fact, by kinship and likeness."""
    v = table(spark, sf_dir, "embeddings")
    hubs = v.select(F.col("vec_id").alias("src"), F.col("label").alias("dst"))
    return weave.siblings(vector.knn_pairs(v, 11), hubs, least=0.25, high=0.35)


@query("island_rescue", f"WITH n AS ({_EDGE}) SELECT src, 'similar_to' AS rel, dst, round(c, 3) AS weight FROM n WHERE k = 1 AND src NOT IN (SELECT src FROM n WHERE c >= 0.35)")
def island_rescue(spark, sf_dir):
    """WV9: the nearest fact of those without an edge."""
    # both the links and the rescue read the pairs
    pairs = cut(vector.knn_pairs(table(spark, sf_dir, "embeddings"), 11))
    linked = pairs.filter("cosine >= 0.35").select(F.col("vec_id").alias("src"), F.col("neighbour_id").alias("dst"))
    return weave.rescue(pairs, table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("signature")), linked)


@query("activation_rank", f"WITH f AS (SELECT vec_id, cosine, strength, superseded FROM (SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], q), 6) AS cosine, label / 10.0::DOUBLE AS strength, label = 3 AS superseded FROM embeddings, {_QUESTION})), a AS (SELECT vec_id, cosine, round(cosine + CASE WHEN cosine >= 0.3 THEN 0.2 * strength ELSE 0 END - CASE WHEN superseded THEN 0.15 ELSE 0 END, 6) AS activation FROM f) SELECT vec_id, cosine, activation, row_number() OVER (ORDER BY activation DESC, cosine DESC, vec_id) AS place FROM a ORDER BY place LIMIT 50")
def activation_rank(spark, sf_dir):
    """SC29, WN3, RC18: the first fifty by activation for one question."""
    q = F.array(*[F.lit(x) for x in _question(spark, sf_dir)])
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.round(vector.dot(F.col("embedding"), q), 6).alias("cosine"), (F.col("label") / 10.0).alias("strength"), (F.col("label") == 3).alias("superseded"))
    a = v.select("vec_id", "cosine", F.round(scoring.activation(F.col("cosine"), F.col("strength"), F.col("superseded")), 6).alias("activation"))
    top = a.orderBy(F.desc("activation"), F.desc("cosine"), "vec_id").limit(50)
    from pyspark.sql import Window

    return top.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("activation"), F.desc("cosine"), "vec_id")).cast("long")).select("vec_id", "cosine", "activation", "place")


@query("seed_rerank", f"WITH p AS (SELECT vec_id, label, round(list_dot_product(embedding::DOUBLE[], q), 6) AS cosine FROM embeddings, {_QUESTION} ORDER BY cosine DESC, vec_id LIMIT 96), a AS (SELECT vec_id, round(cosine + CASE WHEN cosine >= 0.3 THEN 0.1 * label / 10.0::DOUBLE ELSE 0 END + CASE WHEN d BETWEEN DATE '2024-01-05' AND DATE '2024-01-10' THEN 0.2 WHEN d > DATE '2024-01-10' THEN -0.2 ELSE 0 END, 6) AS activation FROM (SELECT *, DATE '2024-01-01' + CAST(label AS INTEGER) * 2 AS d FROM p)) SELECT vec_id, activation, row_number() OVER (ORDER BY activation DESC, vec_id) AS rank FROM a ORDER BY rank LIMIT 8")
def seed_rerank(spark, sf_dir):
    """SC29b, RC1: an overfetched pool re-ranked with a question's window."""
    v = vector.top_k(table(spark, sf_dir, "embeddings"), _question(spark, sf_dir), 96).join(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("label").cast("int") * 2)
    adjust = scoring.date_adjustment(day, F.lit(date(2024, 1, 5)), F.lit(date(2024, 1, 10)))
    act = F.round(scoring.activation(F.col("cosine"), F.col("label") / 10.0, date_intent=True, adjustment=adjust), 6)
    from pyspark.sql import Window

    ranked = v.select("vec_id", act.alias("activation")).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("activation"), "vec_id")).cast("long"))
    return ranked.filter("rank <= 8")


@query("superseded_by", "WITH e AS (SELECT o_custkey AS signature, o_orderkey AS src, o_orderdate AS t FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_custkey, o_orderkey, o_orderdate FROM orders WHERE o_orderpriority = '1-URGENT') SELECT CAST(signature AS VARCHAR) AS signature, CAST(arg_max(src, (t, CAST(src AS VARCHAR))) AS VARCHAR) AS successor FROM e GROUP BY signature")
def superseded_by(spark, sf_dir):
    """JN20, RC14: the latest correction of each fact, out of both edge tables."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("src"), F.col("o_custkey").cast("string").alias("dst"), F.lit("supersedes").alias("rel"), F.col("o_orderdate").alias("first_seen"), F.lit(None).cast("timestamp_ntz").alias("last_reinforced"), "o_orderstatus", "o_orderpriority")
    a = o.filter("o_orderstatus = 'F'")
    b = o.filter("o_orderpriority = '1-URGENT'").withColumnsRenamed({"src": "src_sig", "dst": "dst_sig"})
    return recall.successors(a, b)


_LEFT = "SELECT 'o:' || l_orderkey AS parent, 'p:' || l_partkey AS child, round(max(l_discount), 6) AS axis_score, CAST(min(l_linenumber) AS INTEGER) AS depth FROM lineitem GROUP BY 1, 2"


@query("evidence_quota", f"""WITH l AS ({_LEFT}), p AS (SELECT 'o:' || o_orderkey AS parent, round(o_totalprice / 1e6, 6) AS activation, CASE WHEN o_orderstatus = 'F' THEN 'temporal' ELSE 'semantic' END AS axis FROM orders),
a AS (SELECT *, row_number() OVER (PARTITION BY axis ORDER BY activation DESC, parent) = 1 AS f FROM p), c AS (SELECT *, row_number() OVER (ORDER BY activation DESC, axis, parent) - 1 AS place FROM (SELECT * FROM a ORDER BY f DESC, activation DESC, axis, parent LIMIT 6)),
j AS (SELECT c.parent, child, place, axis_score, depth, round(activation + 0.15 * round(p_size / 100.0::DOUBLE, 6) + 0.08 * axis_score + CASE WHEN DATE '1995-01-01' + CAST(p_partkey % 300 AS INTEGER) BETWEEN DATE '1995-06-01' AND DATE '1995-06-30' THEN 0.08 ELSE 0 END - 0.02 * depth - 0.005 * place, 6) AS score, DATE '1995-01-01' + CAST(p_partkey % 300 AS INTEGER) AS day FROM c JOIN l USING (parent) JOIN part ON child = 'p:' || p_partkey),
s AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY axis_score DESC, depth, day DESC, child) = 1 AS sure FROM j), r AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY sure DESC, score DESC, axis_score DESC, depth, child) AS parent_rank FROM s QUALIFY parent_rank <= 4)
SELECT child AS signature, parent, score, CAST(parent_rank AS INTEGER) AS parent_rank, CAST(row_number() OVER (ORDER BY sure DESC, CASE WHEN sure THEN place END, score DESC, place, axis_score DESC, depth, child, parent) AS INTEGER) AS rank FROM r QUALIFY rank <= 24""")
def evidence_quota(spark, sf_dir):
    """WN6, RC17: the evidence reserved under the most active orders: first the best of each, then by score."""
    o, li, p = (table(spark, sf_dir, x) for x in ("orders", "lineitem", "part"))
    links = li.groupBy(F.concat(F.lit("o:"), "l_orderkey").alias("parent"), F.concat(F.lit("p:"), "l_partkey").alias("child")).agg(F.round(F.max("l_discount"), 6).alias("axis_score"), F.min("l_linenumber").cast("int").alias("depth"))
    parents = o.select(F.concat(F.lit("o:"), "o_orderkey").alias("signature"), F.round(F.col("o_totalprice") / 1e6, 6).alias("activation"), F.when(F.col("o_orderstatus") == "F", "temporal").otherwise("semantic").alias("axis"))
    day = F.date_add(F.lit("1995-01-01").cast("date"), (F.col("p_partkey") % 300).cast("int"))
    n = p.select(F.col("p_partkey").alias("id"), F.concat(F.lit("p:"), "p_partkey").alias("signature"), F.lit("fact").alias("kind"), F.col("p_name").alias("fact"), day.alias("source_day"), F.lit(None).cast("timestamp").alias("first_seen"))
    cos = p.select(F.col("p_partkey").alias("id"), F.round(F.col("p_size") / 100.0, 6).alias("cosine"))
    return recall.evidence(parents, links, n, cos, recall.Question("June 1995", (1.0,), date(2001, 8, 1)))


@query("in_cluster_edges", "WITH c AS (SELECT l_partkey FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, l_partkey LIMIT 80), h AS (SELECT l_suppkey FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, l_suppkey LIMIT 40) SELECT 'p:' || l_partkey AS src, l_returnflag AS rel, 's:' || l_suppkey AS dst, l_quantity AS weight FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM c) AND l_suppkey IN (SELECT l_suppkey FROM h)")
def in_cluster_edges(spark, sf_dir):
    """JN19, RC13: the edges with both ends in a cluster, here the busiest parts and suppliers."""
    li = table(spark, sf_dir, "lineitem")
    top = lambda c, mark, n: li.groupBy(c).count().orderBy(F.desc("count"), c).limit(n).select(F.concat(F.lit(mark), c).alias("signature"))
    e = li.select(F.concat(F.lit("p:"), "l_partkey").alias("src"), F.col("l_returnflag").alias("rel"), F.concat(F.lit("s:"), "l_suppkey").alias("dst"), F.col("l_quantity").alias("weight"))
    return recall.in_cluster(e, top("l_partkey", "p:", 80).unionByName(top("l_suppkey", "s:", 40)))


@query("viz_projection_3d", "WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), r AS (SELECT vec_id, sum(v * sin(i * 12.9898::DOUBLE)) AS x, sum(v * sin(i * 20.1198::DOUBLE)) AS y, sum(v * sin(i * 27.2498::DOUBLE)) AS z FROM e GROUP BY 1), w AS (SELECT vec_id, (x - avg(x) OVER ()) / stddev_pop(x) OVER () AS x, (y - avg(y) OVER ()) / stddev_pop(y) OVER () AS y, (z - avg(z) OVER ()) / stddev_pop(z) OVER () AS z FROM r), m AS (SELECT max(sqrt(x * x + y * y + z * z)) AS r FROM w) SELECT vec_id, round(x * 210 / r, 3) AS x, round(y * 210 / r, 3) AS y, round(z * 210 / r, 3) AS z FROM w, m")
def viz_projection_3d(spark, sf_dir):
    """SNK6: three whitened axes for the graph view."""
    return vector.projection_3d(table(spark, sf_dir, "embeddings"))


def document_store(spark, sf_dir) -> Store:
    """The documents as a store: sources as hubs, vectors where there are any."""
    f = facts(spark, sf_dir).withColumn("first_seen", F.col("day").cast("timestamp")).withColumn("source_day", F.col("day"))
    n = f.withColumn("kind", F.lit("fact")).drop("day", "source", "lang")
    hubs = f.select("source").distinct().select((-F.abs(F.xxhash64("source"))).alias("id"), F.concat(F.lit("source:"), "source").alias("signature"), F.lit("entity").alias("kind"), F.lit(0.5).alias("strength"))
    e = f.select(F.col("signature").alias("src"), F.lit("mentions").alias("rel"), F.concat(F.lit("source:"), "source").alias("dst"), F.lit(0.8).alias("weight"))
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.lit("active").alias("lane"), "embedding")
    return Store(spark).having(nodes=n.unionByName(hubs, allowMissingColumns=True), edges=e, vectors=v)


@query("recall_cluster")
def recall_cluster(spark, sf_dir):
    """RC1-RC20, entry A: one question against all documents."""
    words = table(spark, sf_dir, "benchmark").orderBy("item_id").select("text").first()[0]
    q = recall.Question(words + " last month", tuple(_question(spark, sf_dir)), date(2024, 6, 30))
    return recall.recall(document_store(spark, sf_dir), q)


__all__ = ["FACTS", "mentions"]
