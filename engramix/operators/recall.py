"""Retrieval: one question against the store, tier by tier, into a ranked cluster.

Every tier is a DataFrame; only counts bounded by the budgets (a few hundred rows) are ever
final. The driver holds the question's own terms and window, nothing of the store.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import rendering, scoring, temporal, text
from ..functions.vector import dot
from ..sources.store import Store, active, is_gist
from . import graph


@dataclass(frozen=True)
class Question:
    """A question with its parameters clamped to their ranges; 0 and None mean the default."""

    words: str
    vector: tuple[float, ...]
    as_of: date
    hops: int = 2
    seeds: int = 4
    k: int = 12
    nodes: int = 80
    timeline: bool = False

    def __post_init__(self) -> None:
        clamp = lambda v, d, lo, hi: max(lo, min(hi, v or d))
        object.__setattr__(self, "hops", clamp(self.hops, 2, 1, 3))
        object.__setattr__(self, "seeds", clamp(self.seeds, 4, 1, 8))
        object.__setattr__(self, "k", clamp(self.k, 12, self.seeds, 50))
        object.__setattr__(self, "nodes", clamp(self.nodes, 80, 10, 200))

    @property
    def window(self) -> tuple[date, date] | None:
        return temporal.parse_date_range(self.words, self.as_of)

    def terms(self, spark, limit: int = 10) -> list[str]:
        return spark.range(1).select(text.significant_terms(F.lit(self.words), limit)).first()[0]

    def flag(self, pattern: str) -> bool:
        import re

        return re.search(pattern, self.words) is not None


def held(df: DataFrame) -> DataFrame:
    """A result of a bounded number of rows (a tier's budget), brought to the driver once and used from there; no table is written for it."""
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)


def in_cluster(edges: DataFrame, cluster: DataFrame) -> DataFrame:
    """(src, rel, dst, weight) of the edges with both ends in the cluster (signature), which is small."""
    own = F.broadcast(cluster.select("signature").distinct())
    return edges.join(own.withColumnRenamed("signature", "src"), "src", "left_semi").join(own.withColumnRenamed("signature", "dst"), "dst", "left_semi").select("src", "rel", "dst", "weight")


def successors(edges: DataFrame, transitions: DataFrame) -> DataFrame:
    """(signature, successor): the latest correction of each fact, from both edge tables; of equal times the later by name."""
    both = edges.filter("rel = 'supersedes'").select("src", "dst", F.coalesce("last_reinforced", "first_seen").alias("t"))
    more = transitions.filter("rel = 'supersedes'").select(F.col("src_sig").alias("src"), F.col("dst_sig").alias("dst"), F.coalesce("last_reinforced", "first_seen").alias("t"))
    return both.unionByName(more).distinct().groupBy(F.col("dst").alias("signature")).agg(F.max_by("src", F.struct("t", "src")).alias("successor"))


def cosine_to(vectors: DataFrame, q: Question, lane: str) -> DataFrame:
    """(id, cosine) in a lane; the scan reads that lane alone."""
    v = F.array(*[F.lit(float(x)) for x in q.vector])
    return vectors.filter(F.col("lane") == lane).select("id", F.round(dot(F.col("embedding"), v), 6).alias("cosine"))


def vector_seeds(facts: DataFrame, cosines: DataFrame, replaced: DataFrame, q: Question) -> DataFrame:
    """(signature, cosine, activation, rank): overfetched by cosine, re-ranked by activation; a fact is demoted if its correction is in the pool too."""
    historical = q.flag(text.HISTORICAL)
    pool = facts.join(cosines, "id").orderBy(F.desc("cosine"), "signature").limit(max(8 * q.k, 64))
    inside = pool.select(F.col("signature").alias("successor"), F.lit(True).alias("__in"))
    j = pool.join(replaced, "signature", "left").join(inside, "successor", "left")
    low, high = q.window or (None, None)
    day = temporal.fact_day(F.col("source_day"), F.col("first_seen"))
    adjust = scoring.date_adjustment(day, F.lit(low), F.lit(high)) if low else F.lit(0.0)
    act = scoring.activation(F.col("cosine"), F.col("strength"), F.coalesce("__in", F.lit(False)), date_intent=low is not None, historical=historical, adjustment=adjust)
    ranked = j.withColumn("activation", F.round(act, 6)).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("activation"), F.desc("cosine"), "signature")))
    return ranked.filter(F.col("rank") <= q.seeds).select("signature", "cosine", "activation", "rank")


def lexical_seeds(facts: DataFrame, seeds: DataFrame, terms: list[str], budget: int = 2) -> DataFrame:
    """(signature, hits): facts with enough of the terms that aren't seeds yet; none for fewer than two terms."""
    need = max(2, -(-4 * len(terms) // 10))
    hit = facts.select("signature", "strength", text.term_hits(F.col("fact"), terms).alias("hits"))
    found = hit.filter((F.col("hits") >= need) & F.lit(len(terms) >= 2)).join(seeds.select("signature"), "signature", "left_anti")
    return found.orderBy(F.desc("hits"), F.desc("strength"), "signature").limit(budget).select("signature", "hits")


def expand(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, q: Question) -> DataFrame:
    """(signature, hops) around the seeds: fewest hops, then strength, then name; ``q.nodes`` at most. Walks pass through chronicles, which aren't in the result."""
    reach = graph.k_hop(edges, seeds.select(F.col("signature").alias("seed")), q.hops).groupBy("signature").agg(F.min("hops").alias("hops"))
    j = reach.join(nodes.select("signature", "strength", "kind"), "signature").orderBy("hops", F.desc("strength"), "signature").limit(q.nodes)
    return j.filter("kind <> 'chronicle'").select("signature", "hops")


def sequence_members(edges: DataFrame, transitions: DataFrame) -> DataFrame:
    """(signature, chain): the sequence that each fact belongs to; a night computes it once for all questions."""
    e = edges.filter("rel = 'sequence'").select("src", "dst").unionByName(transitions.filter("rel = 'sequence'").select(F.col("src_sig").alias("src"), F.col("dst_sig").alias("dst"))).distinct()
    return graph.components(e).select(F.col("node").alias("signature"), F.col("component").alias("chain"))


def chains(facts: DataFrame, edges: DataFrame, transitions: DataFrame, seeds: DataFrame, per_chain: int = 40, total: int = 400, *, known: DataFrame | None = None) -> DataFrame:
    """(signature, chain): members of the sequences that seeds belong to, if they share the seed's topic; ``known`` has the sequences (signature, chain) if a night left them."""
    c = (sequence_members(edges, transitions) if known is None else known).select(F.col("signature").alias("node"), F.col("chain").alias("component"))
    own = c.join(seeds.select(F.col("signature").alias("node")), "node").join(facts.select(F.col("signature").alias("node"), F.col("fact").alias("seed_fact")), "node").select(F.col("component").alias("chain"), "seed_fact", F.col("node").alias("seed"))
    m = c.withColumnRenamed("component", "chain").join(own, "chain").join(facts.select(F.col("signature").alias("node"), "fact", "first_seen"), "node")
    near = m.filter((F.col("node") == F.col("seed")) | text.shares_topic(F.col("fact"), F.col("seed_fact"))).select("node", "chain", "first_seen").distinct()
    w = Window.partitionBy("chain").orderBy("first_seen", "node")
    return near.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= per_chain).orderBy("chain", "k").limit(total).select(F.col("node").alias("signature"), "chain")


def collapse(rows: DataFrame, empty: bool = False) -> DataFrame:
    """Restatements (equal texts but for scope, dates and punctuation) as their latest one, with statements and observed_since; rows need fact, day, signature and hops. Empty texts collapse only with ``empty``."""
    keyed = rows.withColumn("__key", text.normalize_for_match(F.col("fact")))
    if not empty:
        keyed = keyed.withColumn("__key", F.when(F.col("__key") == "", F.concat(F.lit("empty:"), "signature")).otherwise(F.col("__key")))
    best = F.max_by(F.struct(*[c for c in rows.columns if c != "hops"]), F.struct("day", "signature"))
    g = keyed.groupBy("__key").agg(best.alias("b"), F.min("hops").alias("hops"), F.count("*").alias("statements"), F.min("day").alias("observed_since"))
    return g.select("b.*", "hops", "statements", "observed_since")


def once(rows: DataFrame, taken: DataFrame, order: list, budget: int) -> DataFrame:
    """A tier's pick: the first of each text, none that an earlier tier has, ``budget`` at most. rows and taken need fact; order ends in a tie-break."""
    keyed = rows.withColumn("__key", text.normalize_for_match(F.col("fact"))).join(taken.select(text.normalize_for_match(F.col("fact")).alias("__key")).distinct(), "__key", "left_anti")
    return keyed.withColumn("__k", F.row_number().over(Window.partitionBy("__key").orderBy(*order))).filter("__k = 1").drop("__k", "__key").orderBy(*order).limit(budget)


def details(nodes: DataFrame, detail_of: DataFrame, found: DataFrame, terms: list[str], enumerative: bool) -> DataFrame:
    """(signature, fact, gist): what lies under strong gists: seeds, or a hop away and strong."""
    parents = 5 if enumerative else 4
    g = found.join(nodes, "signature").filter(is_gist()).filter((F.col("hops") == 0) | ((F.col("hops") <= 1) & (F.col("strength") >= 0.55))).orderBy("hops", F.desc("strength"), "signature").limit(parents)
    parent = g.select(F.col("signature").alias("gist_sig"), F.col("hops").alias("parent_hops"), F.col("strength").alias("parent_strength"))
    d = detail_of.select("gist_sig", "detail_sig").join(F.broadcast(parent), "gist_sig").join(nodes.select(F.col("signature").alias("detail_sig"), "fact", "strength", "first_seen"), "detail_sig")
    sought = text.phrases(F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>"))
    d = d.select(F.col("detail_sig").alias("signature"), "fact", F.col("gist_sig").alias("gist"), text.phrase_hits(text.padded(F.col("fact")), sought).alias("phrase_hits"), text.term_hits(F.col("fact"), terms).alias("hits"), "parent_hops", "parent_strength", "strength", "first_seen")
    order = [F.desc("phrase_hits"), F.desc("hits"), F.col("parent_hops") > 0, "parent_hops", F.desc("parent_strength"), F.desc("strength"), F.desc("first_seen"), "signature", "gist"]
    return once(d, found.join(nodes.select("signature", "fact"), "signature"), order, parents).select("signature", "fact", "gist")


def shelf_words(nodes: DataFrame, taken: DataFrame, terms: list[str], q: Question) -> DataFrame:
    """(signature, fact, hits): archived facts that hold the terms."""
    cold = nodes.filter("kind = 'fact' AND notes = 'archive'").select("signature", "fact", "strength", text.term_hits(F.col("fact"), terms).alias("hits")).filter("hits > 0").orderBy(F.desc("hits"), F.desc("strength"), "signature").limit(200)
    return once(cold, taken, [F.desc("hits"), F.desc("strength"), "signature"], max(4, q.k // 2)).select("signature", "fact", "hits")


def shelf_vectors(nodes: DataFrame, vectors: DataFrame, taken: DataFrame, q: Question) -> DataFrame:
    """(signature, fact, cosine): archived facts near the question."""
    near = cosine_to(vectors, q, "archive").filter("cosine >= 0.5").orderBy(F.desc("cosine"), "id").limit(max(2 * q.k, 20))
    return once(near.join(nodes.select("id", "signature", "fact"), "id"), taken, [F.desc("cosine"), "signature"], max(4, q.k // 2)).select("signature", "fact", "cosine")


def in_window(nodes: DataFrame, taken: DataFrame, terms: list[str], q: Question, archived: bool) -> DataFrame:
    """(signature, fact, day, hits) of facts of the window asked for; active ones must hold a term that isn't about time, if there is one. Nothing without a window."""
    inside = lambda d: d.between(*map(F.lit, q.window)) if q.window else F.lit(False)
    day = temporal.fact_day(F.col("source_day"), F.col("first_seen"))
    own = nodes.filter((F.col("kind") == "fact") & (F.col("notes") == "archive") if archived else active()).select("signature", "fact", "strength", day.alias("day")).filter(inside(F.col("day")))
    topic = [t for t in terms if t not in text.TEMPORAL_WORDS and not t.isdigit()]
    own = own.withColumn("hits", text.term_hits(F.col("fact"), topic))
    if topic and not archived:
        own = own.filter("hits > 0")
    return once(own, taken, [F.desc("hits"), F.desc("strength"), "signature"], max(4, q.k // 2) if archived else 6).select("signature", "fact", "day", "hits")


def anchor_day(nodes: DataFrame, cluster: DataFrame, taken: DataFrame, terms: list[str], q: Question, budget: int = 12) -> DataFrame:
    """(signature, fact, day, hits): what else was recorded on the days that a question without a date is about.

    ``cluster`` is (signature, day, notes, vagueness, cosine). The days are those of the two
    nearest dated facts that aren't gists, if specifics are asked for or a vague gist is
    nearest of all; their details that hold a term are the episode.
    """
    nothing = nodes.limit(0).select("signature", "fact", F.lit(None).cast("date").alias("day"), F.lit(0).cast("long").alias("hits"))
    if q.window or not terms:
        return nothing
    top = cluster.orderBy(F.desc_nulls_last("cosine"), "signature").select((is_gist() & (F.coalesce("vagueness", F.lit(0.0)) >= 0.35)).alias("vague")).first()
    if top is None or not (top.vague or q.flag(text.ENUMERATIVE) or q.flag(text.SPECIFIC)):
        return nothing
    near = cluster.filter(~is_gist() & F.col("day").isNotNull()).groupBy("day").agg(F.max("cosine").alias("c")).orderBy(F.desc_nulls_last("c"), F.desc("day")).limit(2).collect()
    if not near or (near[0].c or 0.0) < 0.30:
        return nothing
    day = temporal.fact_day(F.col("source_day"), F.col("first_seen"))
    own = nodes.filter("kind = 'fact' AND notes IN ('detail', 'harness-ingest')").filter(day.isin([r.day for r in near])).select("signature", "fact", "first_seen", day.alias("day"), text.term_hits(F.col("fact"), terms).alias("hits")).filter("hits > 0")
    return once(own, taken, [F.desc("hits"), F.desc("first_seen"), "signature"], budget).select("signature", "fact", "day", "hits")


def axis_links(store: Store, parents: DataFrame, terms: list[str], q: Question) -> DataFrame:
    """(parent, child, axis_score, depth): the evidence of derived facts (signature, axis), and how well each piece stands for its parent.

    A gist has its landmarks (a change before the current state before what was), or without
    any its details from the newest on; a chronicle what its entries rest on, five levels down:
    pieces of the window before those of its first and last entry before others.
    """
    low, high = q.window or (None, None)
    p = F.broadcast(parents.select(F.col("signature").alias("parent"), "axis"))
    gist = p.filter("axis = 'semantic'").select("parent")
    role = F.when(F.col("role") == "change", 3.0).when(F.col("role") == "current", 2.0).when(F.col("role") == "before", 1.0).otherwise(0.0)
    marks = store["gist_landmarks"].withColumnRenamed("gist_sig", "parent").join(gist, "parent").select("parent", F.col("evidence_sig").alias("child"), (role - 0.001 * F.coalesce("ordinal", F.lit(0))).alias("axis_score"), F.lit(0).alias("depth"))
    day = temporal.fact_day(F.col("source_day"), F.col("first_seen"))
    days = store["nodes"].filter("kind = 'fact'").select(F.col("signature").alias("child"), day.alias("day"))
    under = store["detail_of"].select(F.col("gist_sig").alias("parent"), F.col("detail_sig").alias("child")).join(gist, "parent").join(marks.select("parent"), "parent", "left_anti").join(days, "child")
    place = F.row_number().over(Window.partitionBy("parent").orderBy(F.desc("day"), "child")) - 1
    plain = under.select("parent", "child", (-0.001 * place).alias("axis_score"), F.lit(0).alias("depth"))
    chron = p.filter("axis = 'temporal'").select("parent")
    array = F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>")
    e = store["chronicle_entries"].withColumnRenamed("chronicle_sig", "parent").join(chron, "parent")
    ends = e.groupBy("parent").agg(F.min("ordinal").alias("first"), F.max("ordinal").alias("last"))
    slot = F.coalesce(F.to_date(F.regexp_extract("slot_label", r"^(\d{4}-\d{2}-\d{2})$", 1)).between(F.lit(low), F.lit(high)), F.lit(False)) if low else F.lit(False)
    lexical = text.entry_score(F.concat_ws(" ", "slot_label", "summary", "state_label", "aspect"), array)
    e = e.join(ends, "parent").select("parent", F.col("ordinal").alias("entry_ordinal"), (F.when(slot, 10).otherwise(0) + lexical).alias("entry"), F.when(slot, 3.0).when(F.col("ordinal").isin(F.col("first"), F.col("last")), 2.0).otherwise(1.0).alias("role"))
    roots = store["chronicle_evidence"].withColumnRenamed("chronicle_sig", "parent").join(e, ["parent", "entry_ordinal"]).select("parent", F.col("evidence_sig").alias("root"), "entry", "role")
    deep = graph.descend(store["chronicle_evidence"].select(F.col("chronicle_sig").alias("parent"), F.col("evidence_sig").alias("child")).distinct(), held(roots.select("root").distinct()), 5)
    got = roots.join(deep.select("root", F.col("node").alias("child"), "depth"), "root").join(days, "child")
    inside = F.coalesce(F.col("day").between(F.lit(low), F.lit(high)), F.lit(False)) if low else F.lit(False)
    rated = got.select("parent", "child", (F.when(inside, 3.0).otherwise(F.col("role")) + F.least(F.lit(1.0), 0.05 * F.col("entry")) - 0.02 * F.col("depth")).alias("axis_score"), "depth")
    best = rated.groupBy("parent", "child").agg(F.max(F.struct("axis_score", (-F.col("depth")).alias("d"))).alias("b")).select("parent", "child", "b.axis_score", (-F.col("b.d")).alias("depth"))
    return marks.unionByName(plain).unionByName(best)


def chosen_parents(parents: DataFrame, most: int = 6) -> DataFrame:
    """``parents`` (signature, activation, axis) with their place: the most active, but the best of each axis always."""
    own = parents.groupBy("signature").agg(F.max(F.struct("activation", "axis")).alias("p")).select("signature", "p.activation", "p.axis")
    first = F.row_number().over(Window.partitionBy("axis").orderBy(F.desc("activation"), "signature")) == 1
    one = Window.partitionBy(F.lit(1))
    own = own.withColumn("__f", first).withColumn("__k", F.row_number().over(one.orderBy(F.desc("__f"), F.desc("activation"), "axis", "signature"))).filter(F.col("__k") <= most)
    return own.withColumn("parent_place", F.row_number().over(one.orderBy(F.desc("activation"), "axis", "signature")) - 1).drop("__f", "__k")


def evidence(parents: DataFrame, links: DataFrame, nodes: DataFrame, cosines: DataFrame, q: Question, per_parent: int = 4) -> DataFrame:
    """(signature, parent, score, parent_rank, rank): evidence reserved under derived facts.

    ``parents`` is (signature, activation, axis), ``links`` (parent, child, axis_score, depth).
    The piece that stands best for each parent comes first, so that none starves; then what
    scores best, ``per_parent`` each at most and max(24, 2k) in all.
    """
    roots = F.broadcast(chosen_parents(parents).select(F.col("signature").alias("parent"), "activation", "parent_place"))
    low, high = q.window or (None, None)
    j = links.join(roots, "parent").join(nodes.filter("kind = 'fact'").select(F.col("signature").alias("child"), "id", "fact", "source_day", "first_seen"), "child").join(cosines, "id", "left")
    j = j.withColumn("day", temporal.fact_day(F.col("source_day"), F.col("first_seen")))
    inside = F.coalesce(F.col("day").between(F.lit(low), F.lit(high)), F.lit(False)) if low else F.lit(False)
    asked = F.lit(q.flag(text.ENUMERATIVE) or q.flag(text.SPECIFIC))
    specific = asked & ((F.size(text.hard_specifics(F.col("fact"))) > 0) | F.col("fact").rlike(r"\b\d{4}-\d{2}-\d{2}\b"))
    score = F.col("activation") + 0.15 * F.coalesce("cosine", F.lit(0.0)) + 0.08 * F.col("axis_score") + F.when(specific, 0.08).otherwise(0.0) + F.when(inside, 0.08).otherwise(0.0) - 0.02 * F.col("depth") - 0.005 * F.col("parent_place")
    s = j.select(F.col("child").alias("signature"), "parent", "parent_place", "axis_score", "depth", "day", F.round(score, 6).alias("score"))
    own = Window.partitionBy("parent")
    s = s.withColumn("sure", F.row_number().over(own.orderBy(F.desc("axis_score"), "depth", F.desc("day"), "signature")) == 1)
    ties = [F.desc("axis_score"), "depth", "signature"]
    s = s.withColumn("parent_rank", F.row_number().over(own.orderBy(F.desc("sure"), F.desc("score"), *ties))).filter(F.col("parent_rank") <= per_parent)
    order = [F.desc("sure"), F.when(F.col("sure"), F.col("parent_place")), F.desc("score"), "parent_place", *ties, "parent"]
    return s.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order))).filter(F.col("rank") <= max(24, 2 * q.k)).select("signature", "parent", "score", "parent_rank", "rank")


def routes(store: Store, q: Question, terms: list[str]) -> DataFrame:
    """(signature, resolution, period_start, period_end, similarity, route): chronicles by vector, archived vector, window and entry words; max(4, k/2) of them.

    A window of a week at most takes all its days; then periods at the window's ends; then the best."""
    c = store["chronicles"].select(F.col("node_sig").alias("signature"), "resolution", "period_start", "period_end", "version")
    n = store["nodes"].filter("kind = 'chronicle'").select("signature", "id")
    near = n.join(cosine_to(store["vectors"], q, "chron"), "id").select("signature", F.col("cosine").alias("similarity"))
    old = n.join(cosine_to(store["vectors"], q, "chron_archive"), "id").select("signature", (F.col("cosine") - 0.05).alias("similarity"))
    array = F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>")
    lexical = store["chronicle_entries"].groupBy(F.col("chronicle_sig").alias("signature")).agg(F.max(text.entry_score(F.concat_ws(" ", "slot_label", "summary"), array)).alias("s")).filter("s >= 3").select("signature", text.entry_similarity(F.col("s")).alias("similarity"))
    tiers = near.unionByName(old).unionByName(lexical)
    if q.window:
        low, high = q.window
        touched = c.filter((F.col("period_start") <= F.lit(high)) & (F.col("period_end") >= F.lit(low)))
        tiers = tiers.unionByName(touched.select("signature", F.when(F.col("resolution") == "day", 0.55).otherwise(0.5).alias("similarity")))
    best = tiers.groupBy("signature").agg(F.max("similarity").alias("similarity")).join(c, "signature")
    best = best.withColumn("__k", F.row_number().over(Window.partitionBy("resolution", "period_start", "period_end").orderBy(F.desc("version")))).filter("__k = 1")
    route = F.lit(2)
    if q.window:
        low, high = q.window
        if (high - low).days <= 7:
            route = F.when((F.col("resolution") == "day") & F.col("period_start").between(F.lit(low), F.lit(high)), 0).otherwise(route)
        route = F.when((route == 2) & (F.lit(low).between(F.col("period_start"), F.col("period_end")) | F.lit(high).between(F.col("period_start"), F.col("period_end"))), 1).otherwise(route)
    ranked = best.withColumn("route", route).orderBy("route", F.desc("similarity"), F.desc("period_end"), "signature")
    return ranked.limit(max(4, -(-q.k // 2))).select("signature", "resolution", "period_start", "period_end", "similarity", "route")


def rendered(cluster: DataFrame, store: Store) -> DataFrame:
    """``cluster`` (signature, notes, kind) with the text that stands for each derived memory: form, landmarks and evidence of a gist, entries of a chronicle; null for others."""
    own = F.broadcast(cluster.filter((F.col("kind") == "chronicle") | is_gist()).select("signature", "kind"))
    n = store["nodes"]
    gists = n.join(own.filter("kind = 'fact'").select("signature"), "signature", "left_semi").select("signature", "fact", "temporal_form")
    under = store["detail_of"].withColumnRenamed("gist_sig", "signature").join(own.select("signature"), "signature", "left_semi")
    spans = rendering.spans(under, n)
    marks = store["gist_landmarks"].withColumnRenamed("gist_sig", "signature").join(own.select("signature"), "signature", "left_semi").join(n.select(F.col("signature").alias("evidence_sig"), "fact"), "evidence_sig").select("signature", "role", "ordinal", "fact")
    near = rendering.companion(under.select(F.col("signature").alias("gist_sig"), "detail_sig"), store["chronicle_evidence"], store["chronicles"])
    c = store["chronicles"].withColumnRenamed("node_sig", "signature").join(own.select("signature"), "signature", "left_semi").withColumnRenamed("signature", "node_sig").select("node_sig", "resolution", "period_start", "period_end")
    e = store["chronicle_entries"].withColumnRenamed("chronicle_sig", "signature").join(own.select("signature"), "signature", "left_semi").withColumnRenamed("signature", "chronicle_sig")
    texts = rendering.semantic(gists, spans, marks, near).select("signature", F.col("text").alias("rendered")).unionByName(rendering.temporal(c, e).select(F.col("node_sig").alias("signature"), F.col("text").alias("rendered")))
    return cluster.join(texts, "signature", "left")


def recall(store: Store, q: Question) -> DataFrame:
    """(signature, tier, via, fact, activation, hops, day, superseded_by, statements, observed_since, rendered, place): the ranked cluster of a question.

    Tiers in this order: seed, graph, chain, detail, window, archive_words, archive_vector,
    archive_window, anchor_day, evidence, and chronicles where the timeline is asked for.
    Restatements of one text among seeds, graph and chains are one row, the latest.
    """
    spark, nodes = store.spark, store["nodes"]
    terms = q.terms(spark)
    facts = store.facts()
    day = temporal.fact_day(F.col("source_day"), F.col("first_seen"))
    replaced = successors(store["edges"], store["evidence_transitions"])
    cosines = graph.cut(cosine_to(store["vectors"], q, "active"))
    seeds = held(vector_seeds(facts, cosines, replaced, q))
    words = lexical_seeds(facts, seeds, terms)
    all_seeds = held(seeds.select("signature").unionByName(words.select("signature")).distinct())
    around = held(expand(nodes, store["edges"], all_seeds, q))
    linked = chains(facts, store["edges"], store["evidence_transitions"], all_seeds, known=store.tables.get("chains"))
    found = around.withColumn("tier", F.when(F.col("hops") == 0, "seed").otherwise("graph")).withColumn("via", F.lit(None).cast("string"))
    found = found.unionByName(linked.join(around, "signature", "left_anti").select("signature", F.lit(None).cast("int").alias("hops"), F.lit("chain").alias("tier"), F.col("chain").alias("via")))
    found = held(found.join(nodes.select("signature", "fact", day.alias("day")), "signature"))
    out = held(collapse(found).drop("day").select("signature", "hops", "tier", "via", "fact", "statements", "observed_since"))
    for tier, rows in (
        ("detail", lambda t: details(nodes, store["detail_of"], around, terms, q.flag(text.ENUMERATIVE)).withColumnRenamed("gist", "via")),
        ("window", lambda t: in_window(nodes, t, terms, q, False)),
        ("archive_words", lambda t: shelf_words(nodes, t, terms, q)),
        ("archive_vector", lambda t: shelf_vectors(nodes, store["vectors"], t, q)),
        ("archive_window", lambda t: in_window(nodes, t, terms, q, True)),
        ("anchor_day", lambda t: anchor_day(nodes, held(found.select("signature", "day").join(nodes.select("signature", "id", "notes", "vagueness"), "signature").join(cosines, "id", "left")), t, terms, q)),
    ):
        if tier.endswith("window") and q.window is None:
            continue
        more = rows(out)
        via = F.col("via") if "via" in more.columns else F.lit(None).cast("string")
        more = more.select("signature", F.lit(None).cast("int").alias("hops"), F.lit(tier).alias("tier"), via.alias("via"), "fact")
        out = held(out.unionByName(more.join(found.select("signature").unionByName(out.select("signature")), "signature", "left_anti"), allowMissingColumns=True))
    j = F.broadcast(out).join(nodes.select("signature", "id", "strength", "notes", "kind", day.alias("day")), "signature").join(cosines, "id", "left").join(replaced, "signature", "left")
    low, high = q.window or (None, None)
    adjust = scoring.date_adjustment(F.col("day"), F.lit(low), F.lit(high)) if low else F.lit(0.0)
    act = scoring.activation(F.coalesce("cosine", F.lit(0.0)), F.col("strength"), F.col("successor").isNotNull(), F.coalesce(F.col("notes") == "detail", F.lit(False)), date_intent=low is not None, historical=q.flag(text.HISTORICAL), adjustment=adjust)
    act = act + F.when(F.col("tier") == "anchor_day", 0.1).otherwise(0.0)
    scored = held(j.select("signature", "tier", "via", "fact", F.round(act, 6).alias("activation"), "hops", "day", F.col("successor").alias("superseded_by"), F.coalesce("statements", F.lit(1)).cast("long").alias("statements"), F.coalesce("observed_since", "day").alias("observed_since"), "notes", "kind"))
    parents = scored.filter(is_gist() & (F.col("kind") == "fact")).select("signature", "activation", F.lit("semantic").alias("axis"))
    way = None
    if q.timeline:
        way = held(routes(store, q, terms).join(nodes.select("signature", "fact", "notes", "kind"), "signature"))
        parents = parents.unionByName(way.select("signature", F.col("similarity").alias("activation"), F.lit("temporal").alias("axis")))
    if not parents.isEmpty():
        kept = held(evidence(parents, axis_links(store, parents, terms, q), nodes, cosines, q))
        kept = kept.withColumn("k", F.row_number().over(Window.partitionBy("signature").orderBy("rank"))).filter("k = 1").join(scored.select("signature"), "signature", "left_anti").join(nodes.select("signature", "fact", "notes", "kind", day.alias("day")), "signature")
        scored = scored.unionByName(kept.select("signature", F.lit("evidence").alias("tier"), F.col("parent").alias("via"), "fact", F.col("score").alias("activation"), "day", "notes", "kind"), allowMissingColumns=True)
    if way is not None:
        scored = scored.unionByName(way.select("signature", F.lit("chronicle").alias("tier"), F.col("resolution").alias("via"), "fact", F.col("similarity").alias("activation"), F.col("period_end").alias("day"), "notes", "kind"), allowMissingColumns=True)
    scored = rendered(held(scored), store).drop("notes", "kind").withColumn("statements", F.coalesce("statements", F.lit(1)))
    return scored.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("activation"), "signature", "tier")))


def context(cluster: DataFrame, now: Column, n: int = 30) -> DataFrame:
    """(place, line): the first facts of a cluster with their age, for a reader that takes plain lines."""
    age = F.when(F.col("day").isNull(), "[standing fact] ").otherwise(F.concat(F.lit("["), temporal.age_tag(temporal.age_days(F.col("day"), now)), F.lit(", "), F.col("day").cast("string"), F.lit("] ")))
    return cluster.orderBy("place").limit(n).select("place", F.concat(age, F.coalesce("fact", F.lit(""))).alias("line"))


def hits(cluster: DataFrame, k: int, reserved: int) -> DataFrame:
    """The evidence list: exact records before derived ones, then by activation; each text once; max(6, k, reserved)."""
    authority = F.when(F.col("tier").isin("evidence", "detail", "window", "anchor_day"), 0).when(F.col("tier") == "chronicle", 2).otherwise(1)
    one = cluster.withColumn("__a", authority).withColumn("__s", F.coalesce("activation", F.when(F.col("tier") == "seed", 0.45).otherwise(0.3)))
    w = Window.partitionBy(text.normalize_for_match(F.col("fact"))).orderBy("__a", F.desc("__s"), "signature")
    return one.withColumn("__k", F.row_number().over(w)).filter("__k = 1").orderBy("__a", F.desc("__s"), "signature").limit(max(6, k, reserved)).drop("__a", "__s", "__k")
