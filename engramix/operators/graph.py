"""Graph operators over edge lists: degrees, co-mention, bounded walks, components, repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..sources.shared import cut, cut_folder, shared_folder  # noqa: F401


def numbered(df: DataFrame, order: list, name: str = "place") -> DataFrame:
    """``df`` with each row's place, from 1, in an order over all rows; the order must be total.

    Rows are sorted by ranges in parallel and numbered within their range; the ranges' sizes,
    one number each, are added up to what goes before. No task sees more than its range.
    """
    at = cut(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("__at", 33)
    sizes = at.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = sizes.select("__part", before.alias("__before"))
    j = at.withColumn("__part", part).join(F.broadcast(ahead), "__part")
    return j.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__at", "__part", "__before")


def both_ways(edges: DataFrame) -> DataFrame:
    """(src, dst) in both directions."""
    return edges.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select("e.src", "e.dst")


def degree(edges: DataFrame) -> DataFrame:
    """(signature, degree): how many edges a node is an end of."""
    return edges.select(F.explode(F.array("src", "dst")).alias("signature")).groupBy("signature").agg(F.count("*").alias("degree"))


def hub_degree(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy("dst").agg(F.count("*").alias("degree"))


def hub_cap(active_facts: int) -> int:
    """Hubs of more mentions are too general to say anything."""
    return max(8, -(-active_facts * 20 // 100))


def schema_fit(mentions: DataFrame, active_facts: int) -> DataFrame:
    """(src, fit): how well connected a fact's best specific hub is; hubs at the cap don't count."""
    fit = F.least(F.lit(1.0), F.max("degree") / 6.0)
    return mentions.join(hub_degree(mentions).filter(F.col("degree") < hub_cap(active_facts)), "dst").groupBy("src").agg(fit.alias("fit"))


#: Rows of one task that sorts or adds up what an exchange brings it.
TASK_ROWS = 1_000_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` by its keys over as many tasks as ``rows`` ask for: the session's number of partitions is a fixed one, and a task's memory would grow with the table."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-int(rows or 0) // TASK_ROWS)), *keys)


def specific_mentions(mentions: DataFrame, cap: int) -> tuple[DataFrame, int]:
    """(src, dst), each once, of the hubs of at most ``cap`` mentions; and how many mentions there are."""
    degree = cut(hub_degree(mentions))
    rows = degree.agg(F.sum("degree")).first()[0] or 0
    return spread(mentions.select("src", "dst"), rows, "dst").join(degree.filter(F.col("degree") <= cap).select("dst"), "dst").select("src", "dst").distinct(), rows


def co_mentions(mentions: DataFrame, cap: int) -> DataFrame:
    """(left, right, hubs): pairs of facts that share specific hubs. Hubs above the cap go before the join, so no key is larger than the cap.

    A fact of one hub shares no more than that with any other, so its pairs are whole as the
    join gives them; only pairs of facts of several hubs are added up.
    """
    own, rows = specific_mentions(mentions, cap)
    own = cut(spread(own, rows, "src").withColumn("n", F.count("*").over(Window.partitionBy("src"))))
    of = lambda some: some.groupBy("dst").agg(F.count("*").alias("d")).agg(F.sum(F.col("d") * (F.col("d") - 1) / 2)).first()[0] or 0

    def pairs(some: DataFrame, found: int) -> DataFrame:
        by_hub = spread(some, max(found, rows), "dst")
        return by_hub.alias("a").join(by_hub.alias("b"), "dst").filter("a.src < b.src").select(F.col("a.src").alias("left"), F.col("b.src").alias("right"), (F.least("a.n", "b.n") == 1).alias("alone"))

    one = pairs(own, of(own)).filter("alone").select("left", "right", F.lit(1).cast("long").alias("hubs"))
    several = own.filter("n > 1")
    found = of(several)
    return one.unionByName(spread(pairs(several, found).drop("alone"), found, "left", "right").groupBy("left", "right").agg(F.count("*").alias("hubs"))) if found else one


def k_hop(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(seed, signature, hops): what each seed reaches over undirected edges, with the fewest hops. One exchange a hop, of the frontier alone."""
    around = both_ways(edges).distinct()
    reached = seeds.select("seed", F.col("seed").alias("signature"), F.lit(0).alias("hops")).distinct()
    frontier = reached
    for k in range(1, hops + 1):
        stepped = frontier.join(around, F.col("signature") == F.col("src")).select("seed", F.col("dst").alias("signature")).distinct()
        frontier = cut(stepped.join(reached.select("seed", "signature"), ["seed", "signature"], "left_anti").withColumn("hops", F.lit(k)))
        reached = reached.unionByName(frontier)
    return reached


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of each connected component, by alternating large and small stars."""
    now = cut(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).filter("u > v").distinct())
    before = None
    around = Window.partitionBy("u")
    while True:
        stamp = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if stamp == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        before = stamp
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.withColumn("m", F.least(F.min("v").over(around), F.col("u"))).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        low = large.withColumn("m", F.min("v").over(around))
        now = cut(low.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u > v").distinct())


def descend(links: DataFrame, roots: DataFrame, depth: int = 5) -> DataFrame:
    """(root, node, depth): directed descent over (parent, child), every path's shortest depth; cycles end at the depth."""
    reached = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")).distinct()
    frontier = reached
    for k in range(1, depth + 1):
        below = frontier.join(links, F.col("node") == F.col("parent")).select("root", F.col("child").alias("node")).distinct()
        frontier = cut(below.join(reached.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(k)))
        reached = reached.unionByName(frontier)
    return reached


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that isn't there."""
    have = nodes.select("signature")
    return edges.join(have.withColumnRenamed("signature", "src"), "src", "left_anti").unionByName(edges.join(have.withColumnRenamed("signature", "dst"), "dst", "left_anti"), allowMissingColumns=True).distinct()


def islands(facts: DataFrame, edges: DataFrame) -> DataFrame:
    return facts.join(degree(edges), "signature", "left_anti")


def fold(edges: DataFrame, alias: DataFrame) -> DataFrame:
    """Edges with every alias (alias, canonical) replaced, loops and repeats dropped: of repeated ones the heaviest stays."""
    a = F.broadcast(alias) if alias.count() <= 1_000_000 else alias
    out = edges.join(a.select(F.col("alias").alias("src"), F.col("canonical").alias("s")), "src", "left").join(a.select(F.col("alias").alias("dst"), F.col("canonical").alias("d")), "dst", "left")
    out = out.select(F.coalesce("s", "src").alias("src"), "rel", F.coalesce("d", "dst").alias("dst"), "weight").filter("src <> dst")
    return out.groupBy("src", "rel", "dst").agg(F.max("weight").alias("weight"))


def repair(nodes: DataFrame, edges: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(edges, vectors, restored hubs, facts without a vector): dangling edges of facts go, dangling hubs come back, vectors of nothing go."""
    have = nodes.select("signature")
    hubs = edges.filter("rel = 'mentions'").select(F.col("dst").alias("signature")).distinct().join(have, "signature", "left_anti")
    known = have.unionByName(hubs)
    kept = edges.join(known.withColumnRenamed("signature", "src"), "src", "left_semi").join(known.withColumnRenamed("signature", "dst"), "dst", "left_semi")
    alive = vectors.join(nodes.select("id"), "id", "left_semi").dropDuplicates(["id", "lane"])
    missing = nodes.filter((F.col("kind") == "fact") & ~F.coalesce(F.col("notes") == "archive", F.lit(False))).join(alive.filter("lane = 'active'").select("id"), "id", "left_anti")
    return kept, alive, hubs, missing
