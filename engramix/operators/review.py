"""What a reviewer is asked and what a reviewer's decisions may do: merges, synthesis, salience, entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .graph import numbered

FORMS = tuple("atemporal trajectory recurring period-bound".split())


def report_id(rows: DataFrame, columns: list[str]) -> str:
    """A hash of a report that doesn't depend on the order of its rows: of their number and of the sums of four parts of each row's hash. No task sees more than partial sums."""
    h = F.sha2(F.to_json(F.struct(*columns)), 256)
    part = lambda k: F.sum(F.conv(F.substring("h", 15 * k + 1, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return rows.select(h.alias("h")).agg(F.sha2(F.concat_ws(",", F.count("*").cast("string"), *[F.coalesce(part(k), F.lit("0")) for k in range(4)]), 256)).first()[0]


def merge_clusters(pairs: DataFrame, seeds: DataFrame) -> DataFrame:
    """(cluster, member): each fact goes to its smallest qualifying seed, itself included; clusters of two and more.

    ``pairs`` is (seed, member) in likeness and with a shared hub. The greedy scan's result
    depends on its order; this is the order by id, as one set operation.
    """
    s = seeds.select(F.col("signature").alias("seed"))
    all_ = pairs.join(s, "seed", "left_semi").select("seed", "member").unionByName(s.select("seed", F.col("seed").alias("member")))
    own = all_.groupBy("member").agg(F.min("seed").alias("cluster"))
    # a seed that went to another cluster leads none
    leads = own.filter("member = cluster").select("cluster")
    own = all_.join(leads.withColumnRenamed("cluster", "seed"), "seed", "left_semi").groupBy("member").agg(F.min("seed").alias("cluster"))
    n = F.count("*").over(Window.partitionBy("cluster"))
    return own.withColumn("__n", n).filter("__n >= 2").select("cluster", "member")


def merge_faults(decisions: DataFrame, members: DataFrame, clusters: DataFrame, nodes: DataFrame) -> DataFrame:
    """(decision, reason) of decisions that can't be applied; any row rejects them all.

    ``decisions`` is (decision, survivor, form), ``members`` (decision, member), ``clusters``
    (cluster, member) of the report, ``nodes`` has the live signatures.
    """
    reason = lambda df, why: df.select("decision", F.lit(why).alias("reason")).distinct()
    sized = decisions.join(members.groupBy("decision").agg(F.countDistinct("member").alias("n")), "decision", "left")
    placed = members.join(clusters, "member", "left")
    return (
        reason(sized.filter("coalesce(n, 0) < 2"), "insufficient_members")
        .unionByName(reason(decisions.filter(~F.coalesce(F.col("form"), F.lit("atemporal")).isin(*FORMS)), "invalid_temporal_form"))
        .unionByName(reason(members.join(nodes.select(F.col("signature").alias("member")), "member", "left_anti"), "stale_member"))
        .unionByName(reason(placed.groupBy("decision").agg(F.countDistinct("cluster").alias("n"), F.max(F.col("cluster").isNull().cast("int")).alias("out")).filter("n > 1 OR out = 1"), "cross_cluster"))
        .unionByName(reason(decisions.join(members, "decision").groupBy("decision", "survivor").agg(F.max((F.col("member") == F.col("survivor")).cast("int")).alias("ok")).filter("ok = 0"), "malformed_decision"))
        .unionByName(reason(members.distinct().withColumn("n", F.count("*").over(Window.partitionBy("member"))).filter("n > 1"), "overlapping_decisions"))
    )


def merged(decisions: DataFrame, members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(signature, strength, salience_score, reactivations, first_seen) of the gists that the survivors become."""
    m = members.join(nodes.withColumnRenamed("signature", "member"), "member")
    best = m.groupBy("decision").agg(F.max("strength").alias("s"), F.max("salience_score").alias("salience_score"), F.max("reactivations").alias("reactivations"), F.min("first_seen").alias("first_seen"))
    return decisions.join(best, "decision").select(F.col("survivor").alias("signature"), F.least(F.lit(1.0), F.col("s") + 0.05).alias("strength"), "salience_score", "reactivations", "first_seen")


def dispersion(members: DataFrame) -> DataFrame:
    """(cluster, details, dispersion): the mean of 1 - cosine to the centroid; ``members`` is (cluster, id, embedding) of unit vectors."""
    each = members.select("cluster", "id", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    mean = each.groupBy("cluster", "i").agg(F.avg("x").alias("m"))
    length = mean.groupBy("cluster").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("len"))
    near = each.join(mean, ["cluster", "i"]).groupBy("cluster", "id").agg(F.sum(F.col("x") * F.col("m")).alias("dot"))
    return near.join(length, "cluster").groupBy("cluster").agg(F.count("*").alias("details"), F.avg(1 - F.col("dot") / F.when(F.col("len") == 0, 1.0).otherwise(F.col("len"))).alias("dispersion"))


def synthesis_groups(components: DataFrame, facts: DataFrame, today: Column) -> DataFrame:
    """(component, dormant, hot, onset, newest) of groups ripe for a concept: three or more dormant members, the newest two weeks old.

    ``facts`` is (node, strength, reactivations, day)."""
    age = F.datediff(today, F.col("day"))
    asleep = (F.col("strength") < 0.45) & (F.col("reactivations") <= 1) & (age >= 14)
    j = components.join(facts, "node").withColumn("__d", asleep)
    g = j.groupBy("component").agg(F.count(F.when(F.col("__d"), 1)).alias("dormant"), F.count(F.when(~F.col("__d"), 1)).alias("hot"), F.min(F.when(F.col("__d"), F.col("day"))).alias("onset"), F.max(F.when(F.col("__d"), F.col("day"))).alias("newest"))
    return g.filter((F.col("dormant") >= 3) & (F.datediff(today, F.col("newest")) >= 14))


def claim_once(pools: DataFrame) -> DataFrame:
    """(pool, member) with each member in its best-ranked pool alone; ``pools`` is (pool, rank, member)."""
    w = Window.partitionBy("member").orderBy("rank", "pool")
    return pools.withColumn("__k", F.row_number().over(w)).filter("__k = 1").select("pool", "member")


def salience_caps(scores: DataFrame, batch: int, active: int, salient_now: int) -> DataFrame:
    """(sig, score) that may be raised: the best of each fact, at most a fifth of the batch (3 at least) and what is left of 15 % of the active set (3 at least)."""
    most = min(max(batch // 5, 3), max(active * 15 // 100, 3) - salient_now)
    best = scores.groupBy("sig").agg(F.max("score").alias("score"))
    return numbered(best, [F.desc("score"), "sig"]).filter(F.col("place") <= max(0, most)).select("sig", "score")


def spotlight(raised: DataFrame, weak: DataFrame, near: DataFrame, done: DataFrame) -> DataFrame:
    """(src, dst, strength) of weak neighbours lifted by a raised fact: cosine .6 or more, a day apart at most, five each, once per pair.

    ``raised`` is (src, at), ``weak`` (dst, at, strength) of weak episodes, ``near`` (src, dst, cosine).
    """
    a, b = raised.withColumnRenamed("at", "at1"), weak.withColumnRenamed("at", "at2")
    j = near.filter("cosine >= 0.6").join(a, "src").join(b, "dst").filter((F.abs(F.unix_micros("at1") - F.unix_micros("at2")) <= 86_400_000_000) & (F.col("strength") <= 0.35))
    j = j.join(done.select("src", "dst"), ["src", "dst"], "left_anti")
    w = Window.partitionBy("src").orderBy(F.desc("cosine"), "dst")
    return j.withColumn("__k", F.row_number().over(w)).filter("__k <= 5").select("src", "dst", F.least(F.lit(0.45), F.col("strength") + 0.12).alias("strength"))


def rotating(hubs: DataFrame, cursor: int, n: int = 10) -> DataFrame:
    """The next ``n`` hubs (id) after the cursor, from the start again at the end."""
    return hubs.orderBy(F.col("id") <= cursor, "id").limit(n)


def keep_last(adjudications: DataFrame) -> DataFrame:
    """The latest judgement of each entity."""
    w = Window.partitionBy("sig").orderBy(F.desc("reviewed_seq"), F.desc("report_id"))
    return adjudications.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")
