"""Lineage, reviews' reports and the store's bookkeeping over whole tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import vector
from ..operators import nightly, reports, weave
from ..sources.store import Store
from .maintenance_queries import FACTS, facts
from .registry import query, table
from ..functions.text import CORRECTION
from .text_queries import CONTENT, NORM

# orders as statements: near if of one customer and of like price; some under a scope, some with a correction's cue, the customer their hub
_LIKE = "round(1 - abs(a.o_totalprice - b.o_totalprice) / greatest(a.o_totalprice, b.o_totalprice), 6)"
_SAID = f"""said AS (SELECT 'o:' || o_orderkey AS signature, o_orderdate AS first_seen, 'c:' || o_custkey AS hub, CASE WHEN o_orderkey % 5 = 0 THEN '[Desk ' || (o_custkey % 400) || '] ' ELSE '' END || 'Order for ' || c_mktsegment || ' at price' || (o_orderkey % 7) || ' with priority ' || o_orderpriority || CASE o_orderstatus WHEN 'F' THEN ', changed meanwhile' WHEN 'P' THEN ' pending items' ELSE '' END AS fact FROM orders JOIN customer ON c_custkey = o_custkey),
near AS (SELECT * FROM (SELECT 'o:' || a.o_orderkey AS src, 'o:' || b.o_orderkey AS dst, {_LIKE} AS cosine, row_number() OVER (PARTITION BY a.o_orderkey ORDER BY {_LIKE} DESC, b.o_orderkey) AS rank FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey) WHERE rank <= 39),
own AS (SELECT signature, first_seen, {CONTENT.format("fact")} AS w, {NORM.format("regexp_extract(fact, '^ *\\[([^\\]]{1,40})\\]', 1)")} AS scope, regexp_matches(fact, '{CORRECTION}') AS correction, hub FROM said),
caps AS (SELECT greatest(4, CAST(round_even(0.01 * count(*), 0) AS BIGINT)) AS of_hub, greatest(4, CAST(round_even(0.02 * count(*), 0) AS BIGINT)) AS of_scope FROM said),
hubs AS (SELECT hub FROM own, caps GROUP BY hub, of_hub HAVING count(*) <= of_hub), scopes AS (SELECT scope FROM own, caps WHERE scope <> '' GROUP BY scope, of_scope HAVING count(*) <= of_scope),
v AS (SELECT a.signature AS src, b.signature AS dst, n.rank, n.cosine, CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0 ELSE len(list_intersect(a.w, b.w))::DOUBLE / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) END AS jaccard, len(list_intersect(a.w, b.w)) AS shared,
  len(list_intersect(a.w, b.w))::DOUBLE / greatest(1, least(len(a.w), len(b.w))) AS containment, a.hub = b.hub AND a.hub IN (SELECT hub FROM hubs) AS shared_hub, a.scope = b.scope AND a.scope IN (SELECT scope FROM scopes) AS same_scope, a.correction, b.first_seen AS t
  FROM near n JOIN own a ON a.signature = n.src JOIN own b ON b.signature = n.dst WHERE b.first_seen < a.first_seen)"""


def _versions(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    sig = F.concat(F.lit("o:"), "o_orderkey")
    scope = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("[Desk "), F.col("o_custkey") % 400, F.lit("] "))).otherwise("")
    end = F.when(F.col("o_orderstatus") == "F", ", changed meanwhile").when(F.col("o_orderstatus") == "P", " pending items").otherwise("")
    said = o.select(sig.alias("signature"), F.concat(scope, F.lit("Order for "), "c_mktsegment", F.lit(" at price"), F.col("o_orderkey") % 7, F.lit(" with priority "), "o_orderpriority", end).alias("fact"), F.col("o_orderdate").alias("first_seen"))
    hubs = o.select(sig.alias("src"), F.concat(F.lit("c:"), "o_custkey").alias("dst"))
    a, b = (o.select("o_custkey", F.col("o_orderkey").alias(f"{s}_key"), F.col("o_totalprice").alias(f"{s}_price"), F.col("o_orderdate").alias(f"{s}_date")) for s in "ab")
    like = F.round(1 - F.abs(F.col("a_price") - F.col("b_price")) / F.greatest("a_price", "b_price"), 6)
    # within a customer, so that the join's exchange serves the ranks; those that aren't older count in the ranks and go no further
    w = Window.partitionBy("o_custkey", "a_key").orderBy(F.desc("cosine"), "b_key")
    pairs = a.join(b, "o_custkey").filter("a_key <> b_key").withColumn("cosine", like).withColumn("rank", F.row_number().over(w)).filter((F.col("rank") <= nightly.NEAR) & (F.col("b_date") < F.col("a_date")))
    return weave.versions(pairs.select(F.concat(F.lit("o:"), "a_key").alias("src"), F.concat(F.lit("o:"), "b_key").alias("dst"), "cosine", "rank"), said, hubs, said.count())


def _no_edges(spark) -> DataFrame:
    return spark.createDataFrame([], "src string, dst string")


@query("version_pairs", f"WITH {_SAID} SELECT src, dst, CAST(rank AS INTEGER) AS rank, cosine, round(jaccard, 6) AS jaccard, CAST(shared AS INTEGER) AS shared, round(containment, 6) AS containment, shared_hub, same_scope, correction FROM v")
def version_pairs(spark, sf_dir):
    """AG9, JN10: every fact's older neighbours, with what makes them versions of one statement."""
    v = _versions(spark, sf_dir)
    return v.withColumns({"jaccard": F.round("jaccard", 6), "containment": F.round("containment", 6)}).drop("at")


@query("correction_links", f"WITH {_SAID} SELECT src, arg_max(dst, (cosine, dst)) AS dst, 0.9::DOUBLE AS weight FROM v WHERE correction AND rank <= 11 AND cosine BETWEEN 0.5 AND 0.96 AND (jaccard >= 0.34 OR (shared_hub OR same_scope) AND jaccard >= 0.12) GROUP BY src")
def correction_links(spark, sf_dir):
    """WV7: every correction's most alike older version."""
    return weave.corrections(_versions(spark, sf_dir), _no_edges(spark))


@query("sequence_links", f"WITH {_SAID} SELECT older AS src, newer AS dst, 0.8::DOUBLE AS weight FROM (SELECT arg_max(dst, (t, dst)) AS older, src AS newer FROM v WHERE cosine >= 0.6 AND shared >= 3 AND (containment >= 0.8 OR cosine >= 0.85) GROUP BY src)")
def sequence_links(spark, sf_dir):
    """WV8: from every fact's nearest older version to the fact."""
    return weave.lineage(_versions(spark, sf_dir), _no_edges(spark))


_CORRECTED = f"links AS (SELECT a.id, a.signature AS src, 'd:' || (a.id - 1) AS dst FROM ({FACTS}) a WHERE a.notes = 'gist')"


@query("corrected_strengths", f"WITH f AS ({FACTS}), {_CORRECTED}, gain AS (SELECT s, max(b) AS b FROM (SELECT src AS s, 0.18::DOUBLE AS b FROM links UNION ALL SELECT dst, 0.05 FROM links) GROUP BY s) SELECT signature, round(CASE WHEN b IS NULL THEN strength ELSE least(1.0, greatest(0.0, strength + b)) END, 6) AS strength, CASE WHEN b = 0.18 AND class = 'episodic' THEN 'semantic' ELSE class END AS class, CASE WHEN b = 0.18 THEN 1 END AS reactivations FROM f LEFT JOIN gain ON s = signature")
def corrected_strengths(spark, sf_dir):
    """WV7: what a correction does to both of its facts."""
    f = facts(spark, sf_dir)
    links = f.filter("notes = 'gist'").select(F.col("signature").alias("src"), F.concat(F.lit("d:"), F.col("id") - 1).alias("dst"))
    n = f.withColumns({"reactivations": F.lit(None).cast("long"), "last_reactivated": F.lit(None).cast("timestamp")})
    return weave.corrected(n, links, F.lit(datetime(2024, 7, 1))).select("signature", F.round("strength", 6).alias("strength"), "class", "reactivations")


@query("neighbours_of_changed", "SELECT vec_id, neighbour_id, cosine, CAST(rank AS INTEGER) AS rank FROM (SELECT a.vec_id, b.vec_id AS neighbour_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.label = 3) WHERE rank <= 39")
def neighbours_of_changed(spark, sf_dir):
    """WV5, WV8: the neighbours of the vectors of one label, as if they were the changed ones, among all."""
    v = table(spark, sf_dir, "embeddings")
    return vector.knn_pairs(v, nightly.NEAR, of=v.filter("label = 3").select("vec_id"))


@query("hub_review", """WITH m AS (SELECT DISTINCT 'o:' || o_orderkey AS src, o_orderkey AS id, o_orderpriority AS fact, o_custkey FROM orders), h AS (SELECT c_custkey AS id, 'customer:' || lower(replace(c_name, '#', '-')) AS sig, c_mktsegment AS seg, (SELECT count(*) FROM m WHERE o_custkey = c_custkey) AS degree FROM customer),
s AS (SELECT *, CASE WHEN seg = 'BUILDING' THEN 'provisional' WHEN seg = 'MACHINERY' THEN 'rejected' ELSE 'approved' END AS status FROM h),
p AS (SELECT *, row_number() OVER (ORDER BY degree DESC, id) AS place FROM s WHERE status = 'provisional' QUALIFY place <= 20), a AS (SELECT *, 20 + row_number() OVER (ORDER BY id <= 40, id) AS place FROM s WHERE status = 'approved' QUALIFY place <= 30)
SELECT CAST(place AS BIGINT) AS place, id, sig, 'customer' AS type, status, CAST(degree AS BIGINT) AS degree, coalesce((SELECT array_to_string(list(fact ORDER BY mm.id), '|') FROM (SELECT * FROM m WHERE m.o_custkey = x.id ORDER BY m.id LIMIT 3) mm), '') AS sample FROM (SELECT * FROM p UNION ALL SELECT * FROM a) x""")
def hub_review(spark, sf_dir):
    """RA1: the hubs to be reviewed, by degree and by rotation, with their first facts."""
    c = table(spark, sf_dir, "customer")
    sig = F.concat(F.lit("customer:"), F.lower(F.regexp_replace("c_name", "#", "-")))
    n = c.select(F.col("c_custkey").alias("id"), sig.alias("signature"), F.lit("entity").alias("kind"), F.lit(None).cast("array<string>").alias("forms"), F.lit(None).cast("timestamp").alias("first_seen"), F.when(F.col("c_mktsegment") == "BUILDING", "weave-extract").alias("notes"))
    judged = c.filter("c_mktsegment = 'MACHINERY'").select(sig.alias("sig"), F.lit("rejected").alias("status"), F.lit(1).alias("reviewed_seq"), F.lit("r").alias("report_id"))
    o = table(spark, sf_dir, "orders").join(c.select(F.col("c_custkey").alias("o_custkey"), sig.alias("dst")), "o_custkey")
    own = o.select(F.concat(F.lit("o:"), "o_orderkey").alias("src"), "dst")
    f = o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("o:"), "o_orderkey").alias("signature"), F.col("o_orderpriority").alias("fact"))
    found = reports.hubs_to_review(reports.hub_status(n, judged), own, f, 40)
    return found.select("place", "id", "sig", "type", "status", "degree", F.array_join("sample", "|").alias("sample"))


@query("salience_report", f"""WITH f AS ({FACTS}), l AS (SELECT 'd:' || a.doc_id AS src, 'd:' || b.doc_id AS dst, b.text AS said FROM documents a JOIN documents b ON b.doc_id = a.doc_id - 1 WHERE a.lang = 'en'),
n AS (SELECT a.vec_id, b.vec_id AS o, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS c FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id), k AS (SELECT 'd:' || vec_id AS s, 'd:' || o AS o, c FROM n QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, o) = 1),
warm AS (SELECT * FROM f WHERE notes IS NULL OR notes NOT IN ('detail', 'archive')), c AS (SELECT 'elevate' AS surface, signature, fact, salience_score, false AS hit FROM warm WHERE coalesce(salience_score, 0) < 0.5),
r AS (SELECT 'review' AS surface, signature, fact, salience_score, signature IN (SELECT dst FROM l WHERE src IN (SELECT signature FROM c)) AS hit FROM warm WHERE coalesce(salience_score, 0) >= 0.5 ORDER BY hit DESC, signature LIMIT 20)
SELECT surface, x.signature AS sig, md5(x.fact) AS fact, round(coalesce(x.salience_score, 0), 3) AS salience_score, hit AS superseded_by_new, md5(g.fact) AS nearest, round(k.c, 3) AS cosine, CASE WHEN surface = 'elevate' THEN (SELECT md5(said) FROM l WHERE src = x.signature AND said <> '') END AS supersedes
FROM (SELECT * FROM c UNION ALL SELECT * FROM r) x LEFT JOIN (k JOIN f g ON g.signature = k.o) ON k.s = x.signature""")
def salience_report(spark, sf_dir):
    """RA4: what may become salient, and the salient facts to be judged again."""
    d = facts(spark, sf_dir)
    f = d.withColumns({"dirty_seq": F.lit(1), "last_reactivated": F.lit(None).cast("timestamp")})
    links = table(spark, sf_dir, "documents").filter("lang = 'en'").select(F.concat(F.lit("d:"), "doc_id").alias("src"), F.concat(F.lit("d:"), F.col("doc_id") - 1).alias("dst"))
    pairs = vector.knn_pairs(table(spark, sf_dir, "embeddings"), 1).select(F.concat(F.lit("d:"), "vec_id").alias("src"), F.concat(F.lit("d:"), "neighbour_id").alias("dst"), "cosine", "rank")
    found = reports.salience(f, pairs, links, None)
    return found.withColumns({"fact": F.md5("fact"), "nearest": F.md5("nearest"), "supersedes": F.md5(F.col("supersedes")[0])})


_ITEMS = "SELECT 'c:' || o_custkey AS family_key, 'o:' || o_orderkey AS member_sig, count(*) AS n, o_orderdate AS first_seen, o_orderkey AS seq FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL"


@query("reactivation_pools", f"""WITH m AS ({_ITEMS}), fam AS (SELECT family_key, max(seq) AS s, sum(n) AS e, count(*) AS d FROM m GROUP BY 1 HAVING sum(n) >= 2), cap AS (SELECT greatest(8, ceil(0.2 * count(*))) AS c FROM orders),
t AS (SELECT m.*, fam.s, fam.d, date_diff('day', first_seen, TIMESTAMP '2001-08-01') >= 7 AS old, row_number() OVER (PARTITION BY family_key ORDER BY n DESC, first_seen, member_sig) AS k FROM m JOIN fam USING (family_key), cap WHERE d <= c), u AS (SELECT * FROM t WHERE k <= 24),
r AS (SELECT family_key, row_number() OVER (ORDER BY max(s) DESC, max(d), family_key) AS pool FROM u GROUP BY family_key HAVING count(*) >= 3 AND count(*) FILTER (old) >= 2 QUALIFY pool <= 10)
SELECT pool, family_key, d AS degree, s AS evidence_seq, member_sig AS sig, n AS evidence_count, old AS archive_eligible FROM u JOIN r USING (family_key)""")
def reactivation_pools(spark, sf_dir):
    """RA10: customers as families of orders that came back: the pools to be summed up."""
    j = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n")), "o_orderkey")
    key, sig = F.concat(F.lit("c:"), "o_custkey"), F.concat(F.lit("o:"), "o_orderkey")
    all_ = table(spark, sf_dir, "orders")
    members = j.select(key.alias("family_key"), sig.alias("member_sig"), F.col("n").alias("evidence_count"), F.col("o_orderkey").alias("latest_seq"), F.lit(None).cast("timestamp").alias("observed_at"))
    families = members.groupBy("family_key").agg(F.max("latest_seq").alias("evidence_seq"), F.sum("evidence_count").alias("evidence_count"), F.max("observed_at").alias("observed_at"))
    s = Store(spark).having(
        nodes=all_.select(F.col("o_orderkey").alias("id"), sig.alias("signature"), F.lit("fact").alias("kind"), F.col("o_orderdate").cast("timestamp").alias("first_seen")),
        edges=j.select(sig.alias("src"), F.lit("mentions").alias("rel"), key.alias("dst"), F.lit(0.8).alias("weight")), reactivation_members=members, reactivation_families=families,
    )
    return reports.reactivation_pools(s, F.lit("2001-08-01").cast("date"))


@query("merge_report", "SELECT p_brand AS cluster, row_number() OVER (PARTITION BY p_brand ORDER BY d NULLS LAST, p_partkey) AS place, p_partkey AS member, p_name AS fact, d AS day, p_type AS tier, min(d) OVER (PARTITION BY p_brand) AS first_day, max(d) OVER (PARTITION BY p_brand) AS last_day FROM part LEFT JOIN (SELECT l_partkey, CAST(min(l_shipdate) AS DATE) AS d FROM lineitem GROUP BY 1) ON l_partkey = p_partkey")
def merge_report(spark, sf_dir):
    """RA6: brands as clusters of parts, in the order of their first day."""
    p = table(spark, sf_dir, "part")
    d = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min(F.col("l_shipdate").cast("date")).alias("day"))
    f = p.join(d, "p_partkey", "left").select(F.col("p_partkey").alias("signature"), F.col("p_name").alias("fact"), "day", F.col("p_type").alias("notes"))
    return reports.merge_report(p.select(F.col("p_brand").alias("cluster"), F.col("p_partkey").alias("member")), f)


@query("budget_report", f"""WITH f AS ({FACTS}), n AS (SELECT count(*) AS facts, count(*) / 250.0::DOUBLE AS p FROM f), b AS (SELECT *, greatest(0, p - 0.6) AS o FROM n),
k AS (SELECT facts, 250::BIGINT AS target, CASE WHEN facts >= 500 THEN 'critical' WHEN facts > 250 THEN 'over' WHEN p >= 0.8 THEN 'elevated' ELSE 'ok' END AS status, round(p, 3) AS pressure, greatest(0, facts - 250) AS over_target_by, round(least(0.45, 0.15 + o * 0.35), 3) AS forget_threshold, round(1 + greatest(0, p - 1) + o * 0.4, 3) AS decay_accel, round(greatest(0.5, 0.62 - o * 0.18), 3) AS merge_sim, round(CASE WHEN p >= 1 THEN least(0.4, 0.25 + (p - 1) * 0.25) ELSE 0 END, 3) AS semantic_fade FROM b),
w AS (SELECT *, (SELECT count(*) FROM f WHERE class = 'episodic' AND strength < forget_threshold) AS evaporate_episodic, (SELECT count(*) FROM f WHERE class = 'semantic' AND strength < semantic_fade) AS evaporate_semantic, (SELECT count(DISTINCT source) FROM f) AS merge_clusters, (SELECT count(*) - count(DISTINCT source) FROM f) AS reclaimable FROM k)
SELECT *, facts - evaporate_episodic - evaporate_semantic - reclaimable AS projected FROM w""")
def budget_report(spark, sf_dir):
    """DR13, AG19: the budget's state, and what a night and the merges of each source would free."""
    f = facts(spark, sf_dir)
    return reports.budget(f, f.select(F.col("source").alias("cluster"), F.col("signature").alias("member")), 250, 500)


@query("alias_folds", """WITH h AS (SELECT c_custkey AS id, 'customer:' || c_custkey AS s, c_nationkey AS n FROM customer), r AS (SELECT n, min(id) AS first FROM h GROUP BY n), t AS (SELECT s AS alias, 'customer:' || CASE WHEN id % 3 = 0 THEN (SELECT min(g.id) FROM h g WHERE g.n = h.n) ELSE id END AS canonical FROM h JOIN r USING (n))
SELECT 'o:' || o_orderkey AS src, 'mentions' AS rel, canonical AS dst, max(o_totalprice) AS weight FROM orders JOIN t ON alias = 'customer:' || o_custkey GROUP BY ALL""")
def alias_folds(spark, sf_dir):
    """RA3, WV12: every third customer folded into the first of its nation, edges repointed."""
    c = table(spark, sf_dir, "customer")
    sig = F.concat(F.lit("customer:"), "c_custkey")
    first = c.groupBy("c_nationkey").agg(F.min("c_custkey").alias("first"))
    a = c.filter("c_custkey % 3 = 0").join(first, "c_nationkey").select(sig.alias("alias"), F.concat(F.lit("customer:"), "first").alias("canonical"))
    o = table(spark, sf_dir, "orders")
    s = Store(spark).having(nodes=c.select(F.col("c_custkey").alias("id"), sig.alias("signature"), F.lit("entity").alias("kind")), edges=o.select(F.concat(F.lit("o:"), "o_orderkey").alias("src"), F.lit("mentions").alias("rel"), F.concat(F.lit("customer:"), "o_custkey").alias("dst"), F.col("o_totalprice").alias("weight")))
    return nightly.fold_aliases(s, a)["edges"].select("src", "rel", "dst", "weight")


@query("unique_signatures", "WITH t AS (SELECT p_brand AS b, 1 AS n FROM part WHERE p_size > 10 UNION ALL SELECT p_brand, p_size FROM part WHERE p_size > 10), h AS (SELECT b, max(n) AS n FROM t GROUP BY b), k AS (SELECT p_partkey AS id, p_brand AS base, coalesce(n, 0) + row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part LEFT JOIN h ON b = p_brand) SELECT id, base, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS signature FROM k")
def unique_signatures(spark, sf_dir):
    """WN15: a name of its own for every part, after its brand's names in use."""
    p = table(spark, sf_dir, "part")
    used = p.filter("p_size > 10")
    taken = used.select(F.col("p_brand").alias("signature")).unionByName(used.select(F.concat("p_brand", F.lit("-"), F.col("p_size").cast("string")).alias("signature"))).distinct()
    return nightly.unique_signatures(p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("base")), taken)


@query("split_model", "SELECT p_partkey AS id, CASE WHEN p_size > 20 THEN 'fact' ELSE 'entity' END AS kind, CASE WHEN p_size > 20 THEN 'm' || p_partkey ELSE '' END AS memory_id, p_size > 20 AND p_size <= 40 AS renamed FROM part")
def split_model(spark, sf_dir):
    """CMD5: nodes with a memory become facts under their own words, the others entities."""
    p = table(spark, sf_dir, "part")
    sig = F.when(F.col("p_size") > 40, F.concat(F.lit("fact:"), "p_partkey")).otherwise(F.concat(F.lit("n:"), "p_partkey"))
    n = p.select(F.col("p_partkey").alias("id"), sig.alias("signature"), F.when(F.col("p_size") > 20, F.concat(F.lit("m"), "p_partkey")).otherwise("live").alias("memory_id"), F.lit("fact").alias("kind"), F.col("p_name").alias("fact"))
    s, named = nightly.split_model(Store(spark).having(nodes=n), datetime(2024, 7, 1))
    return s["nodes"].join(named.select("id", F.lit(True).alias("renamed")), "id", "left").select("id", "kind", "memory_id", F.coalesce("renamed", F.lit(False)).alias("renamed"))


@query("recorded_ids", "SELECT 'o:' || o_orderkey AS signature, CASE WHEN o_orderstatus = 'F' THEN 'new-' || o_orderkey ELSE 'old-' || o_orderkey END AS memory_id FROM orders UNION ALL SELECT 'anchor_memory_id', 'the-anchor'")
def recorded_ids(spark, sf_dir):
    """SNK2: the ids that a host gave to what was projected, put back; the anchor's among the cursors."""
    o = table(spark, sf_dir, "orders")
    sig = F.concat(F.lit("o:"), "o_orderkey")
    s = Store(spark).having(nodes=o.select(F.col("o_orderkey").alias("id"), sig.alias("signature"), F.lit("fact").alias("kind"), F.concat(F.lit("old-"), "o_orderkey").alias("memory_id")))
    given = o.filter("o_orderstatus = 'F'").select(sig.alias("signature"), F.concat(F.lit("new-"), "o_orderkey").alias("memory_id")).unionByName(spark.createDataFrame([(nightly.ANCHOR, "the-anchor")], "signature string, memory_id string"))
    out = nightly.recorded(s, given)
    return out["nodes"].select("signature", "memory_id").unionByName(out["meta"].select(F.col("key").alias("signature"), F.col("value").alias("memory_id")))


@query("repaired_graph", "WITH h AS (SELECT DISTINCT 's:' || l_suppkey AS s FROM lineitem), k AS (SELECT DISTINCT 'p:' || l_partkey AS src, l_returnflag AS rel, 's:' || l_suppkey AS dst FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 5)) SELECT 'edge' AS what, src || rel || dst AS name FROM k WHERE rel = 'A' OR dst IN (SELECT 's:' || s_suppkey FROM supplier WHERE s_acctbal > 0) OR dst IN (SELECT dst FROM k2) UNION ALL SELECT 'hub', s FROM h2 UNION ALL SELECT 'vector', CAST(vec_id AS VARCHAR) FROM embeddings WHERE vec_id IN (SELECT p_partkey FROM part WHERE p_size > 5)".replace("WITH h AS", "WITH k2 AS (SELECT DISTINCT 's:' || l_suppkey AS dst FROM lineitem WHERE l_returnflag = 'A'), h2 AS (SELECT dst AS s FROM k2 WHERE dst NOT IN (SELECT 's:' || s_suppkey FROM supplier WHERE s_acctbal > 0)), h AS"))
def repaired_graph(spark, sf_dir):
    """WV11: parts as facts (some lost), suppliers as hubs (some lost): what repair keeps and brings back."""
    p, sup = table(spark, sf_dir, "part").filter("p_size > 5"), table(spark, sf_dir, "supplier").filter("s_acctbal > 0")
    n = p.select(F.col("p_partkey").alias("id"), F.concat(F.lit("p:"), "p_partkey").alias("signature"), F.lit("fact").alias("kind")).unionByName(sup.select((-F.col("s_suppkey") - 1).alias("id"), F.concat(F.lit("s:"), "s_suppkey").alias("signature"), F.lit("entity").alias("kind")))
    flag = F.col("l_returnflag")
    e = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p:"), "l_partkey").alias("src"), F.when(flag == "A", "mentions").otherwise(flag).alias("rel"), F.concat(F.lit("s:"), "l_suppkey").alias("dst")).distinct()
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.lit("active").alias("lane"), "embedding")
    s = nightly.repaired(Store(spark).having(nodes=n, edges=e, vectors=v), F.lit(datetime(2024, 7, 1)))
    rel = F.when(F.col("rel") == "mentions", "A").otherwise(F.col("rel"))
    return (
        s["edges"].select(F.lit("edge").alias("what"), F.concat("src", rel, "dst").alias("name"))
        .unionByName(s["nodes"].filter("notes = 'scaffolding'").select(F.lit("hub").alias("what"), F.col("signature").alias("name")))
        .unionByName(s["vectors"].select(F.lit("vector").alias("what"), F.col("id").cast("string").alias("name")))
    )


@query("woven_edges")
def woven_edges(spark, sf_dir):
    """Entry B, WV1-WV13: the edges after two weaves over the documents: all of them first, then those of June changed again."""
    from .retrieval_queries import document_store

    s = nightly.woven(document_store(spark, sf_dir), 1, 0.25, 0.35, now=datetime(2024, 6, 30))
    changed = F.when(F.col("source_day") >= F.lit("2024-06-01").cast("date"), 2).otherwise(F.coalesce("dirty_seq", F.lit(0)))
    s = nightly.woven(s.having(nodes=s["nodes"].withColumn("dirty_seq", changed)), 2, 0.25, 0.35, now=datetime(2024, 7, 1))
    return s["edges"].select("src", "rel", "dst", F.round("weight", 3).alias("weight"))


