"""The nightly run: weave, then upkeep, on one version of the store; and applied decisions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import entities, rendering, scoring, text
from ..functions.vector import knn_pairs
from ..sources import plugins
from ..sources.store import Store, dirty
from ..sources.tuning import Tuning
from . import graph, recall, upkeep, weave
from .graph import cut

ANCHOR = "memory-usage-anchor"
#: Neighbours of a fact that a weave looks at: its older version may stand behind many newer ones.
NEAR = 39


def input_seq(store: Store) -> int:
    """The latest change that the store knows of: its counter, or a node's own stamp if that is later."""
    top = store["nodes"].agg(F.max("dirty_seq").alias("m")).first().m or 0
    return max(store.cursor("change_seq") or 0, top)


def changed_hubs(store: Store, evidence: DataFrame, now: Column) -> DataFrame:
    """Nodes for the entities that the evidence proposes and that no hub has and no review has judged away."""
    judged = store["entity_adjudications"].filter("status IN ('rejected', 'retyped') OR action IN ('reject', 'retype')").select("sig")
    found = entities.new_hubs(evidence.select("signature", "fact"), store["nodes"].select("signature"), judged)
    return found.select(
        F.xxhash64("sig").alias("id"), F.col("sig").alias("signature"), F.lit("entity").alias("kind"), F.lit("semantic").alias("class"), F.lit(0.5).alias("strength"), F.lit(0).cast("long").alias("reactivations"),
        now.alias("first_seen"), now.alias("last_reactivated"), now.alias("last_decayed"), F.lit("weave-extract").alias("notes"), "forms",
    )


def embedding_texts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, said): what is embedded for a node: its fact, or for a hub its forms, or else what it is linked to, in words."""
    about = rendering.neighbourhood(nodes.filter("kind = 'entity' AND size(coalesce(forms, array())) = 0").select("signature"), edges.select("src", "rel", "dst"))
    forms = F.when(F.size(F.coalesce("forms", F.array().cast("array<string>"))) > 0, F.array_join("forms", " "))
    return nodes.join(about.select("signature", F.col("text").alias("__about")), "signature", "left").select("id", F.coalesce(F.when(F.col("fact") != "", F.col("fact")), forms, "__about", "signature").alias("said"))


def reembedded(store: Store, ids: DataFrame, embedder: plugins.Embedder) -> DataFrame:
    """The vectors with those of the nodes ``ids`` (id) made anew, in the active lane alone; archived nodes stay as they are, and nothing but vectors changes."""
    live = store["nodes"].filter("notes IS NULL OR notes <> 'archive'").join(ids.select("id").distinct(), "id", "left_semi").select(store["nodes"].columns)
    texts = embedding_texts(live, store["edges"])
    new = plugins.embedded(texts, embedder, text_column="said").select("id", F.when(F.lit(True), "active").alias("lane"), "embedding")
    return store["vectors"].join(live.select("id"), "id", "left_anti").select("id", "lane", "embedding").unionByName(new)


def unembedded(store: Store) -> DataFrame:
    """(id) of the nodes that aren't archived and have no vector outside the archive."""
    have = store["vectors"].filter("lane IN ('active', 'chron')").select("id")
    return store["nodes"].filter("(notes IS NULL OR notes <> 'archive') AND kind IN ('fact', 'entity')").select("id").join(have, "id", "left_anti")


def named_pairs(pairs: DataFrame, named: DataFrame) -> DataFrame:
    """(src, dst, cosine, rank) by signature of neighbours by id."""
    a, b = named.select(F.col("id").alias("vec_id"), F.col("signature").alias("src")), named.select(F.col("id").alias("neighbour_id"), F.col("signature").alias("dst"))
    return pairs.join(a, "vec_id").join(b, "neighbour_id").select("src", "dst", "cosine", "rank")


def repaired(store: Store, now: Column) -> Store:
    """The store without hanging ends: edges of missing facts go, missing hubs come back, stubs and vectors of nothing go."""
    nodes = store["nodes"].filter("NOT (coalesce(notes, '') = 'scaffolding' AND signature LIKE 'fact:%' AND coalesce(fact, '') = '')")
    kept, vectors, hubs, _ = graph.repair(nodes, store["edges"], store["vectors"])
    back = hubs.select(F.xxhash64("signature").alias("id"), "signature", F.lit("").alias("memory_id"), F.lit("entity").alias("kind"), F.lit("semantic").alias("class"), F.lit(0.5).alias("strength"), F.lit(0).cast("long").alias("reactivations"), now.alias("first_seen"), now.alias("last_reactivated"), now.alias("last_decayed"), F.lit("scaffolding").alias("notes"), F.lit("").alias("fact"))
    nodes = nodes.withColumn("memory_id", F.when(F.col("memory_id") == "live", "").otherwise(F.col("memory_id"))).unionByName(back, allowMissingColumns=True)
    warm = nodes.filter("notes IS NULL OR notes <> 'archive'").select("id", F.lit("archive").alias("lane"))
    return store.having(nodes=cut(nodes), edges=cut(kept), vectors=cut(vectors.join(warm, ["id", "lane"], "left_anti")))


def woven(store: Store, seq: int, likeness: float = weave.LEAST, high: float = weave.HIGH, *, now: datetime | None = None, tier2: int = 2500, embedder: plugins.Embedder | None = None, hub_sigs: tuple[str, ...] = ()) -> Store:
    """The store after a weave of what changed since the last one, all of it if there was none.

    New hubs from recurring entities, mentions (and, of new hubs and ``hub_sigs``, those in
    facts woven before), vectors of what has none (with an ``embedder``), siblings,
    corrections, sequences, rescued islands, durable copies, and repair. Neighbours are
    searched of the changed facts and of islands alone, against all active facts.
    """
    at = (F.lit(now) if now is not None else F.current_timestamp()).cast("timestamp")
    since = store.cursor("last_weave_seq")
    facts = cut(store.facts())
    changed = facts if since is None else cut(facts.filter(dirty(since)))
    fresh = cut(changed_hubs(store, changed if since is None else weave.evidence_window(facts, changed, tier2), at))
    store = store.having(nodes=store["nodes"].unionByName(fresh.select(*fresh.columns), allowMissingColumns=True))
    gone = store["entity_adjudications"].filter("action IN ('reject', 'retype')")
    forms = cut(weave.vocabulary(store["nodes"].filter("kind = 'entity'").select("signature", "forms"), gone))
    mentions = weave.co_mentions(changed, forms)
    if since is not None:
        new = fresh.select(F.col("signature").alias("sig"))
        new = new.unionByName(store.spark.createDataFrame([(x,) for x in hub_sigs], "sig string")).distinct()
        old = facts.join(changed.select("signature"), "signature", "left_anti").select(facts.columns)
        mentions = mentions.unionByName(weave.co_mentions(old, forms.join(new, "sig", "left_semi").select("form", "sig")))
    mentions = cut(mentions.select("src", F.lit("mentions").alias("rel"), "dst", F.lit(0.8).alias("weight")))
    if embedder is not None:
        store = store.having(vectors=cut(reembedded(store, unembedded(store), embedder)))
    edges = store["edges"]
    mentioned = cut(edges.filter("rel = 'mentions'").select("src", "dst").unionByName(mentions.select("src", "dst")).distinct())
    named = facts.select("id", "signature")
    v = cut(store["vectors"].filter("lane = 'active'").select(F.col("id").alias("vec_id"), "embedding").join(named.select(F.col("id").alias("vec_id")), "vec_id"))
    asked = None if since is None else changed.select(F.col("id").alias("vec_id"))
    near = cut(named_pairs(knn_pairs(v, NEAR, of=asked), named))
    by_rank = near.filter(F.col("rank") <= 11).select(F.col("src").alias("vec_id"), F.col("dst").alias("neighbour_id"), "cosine", "rank")
    sib = weave.siblings(by_rank, mentioned, least=likeness, high=high)
    bad = cut(weave.pruned(edges.filter("rel = 'supersedes'").select("src", "rel", "dst"), facts))
    kept = edges.join(bad, ["src", "rel", "dst"], "left_anti")
    paired = cut(near.select(F.explode(F.array("src", "dst")).alias("signature")).distinct())
    old = cut(weave.versions(near, facts, mentioned, facts.count(), paired))
    sup = cut(weave.corrections(old, kept.filter("rel = 'supersedes'")))
    seq_ = weave.lineage(old, kept.filter("rel = 'sequence'"))
    more = mentions.unionByName(sib.select("src", "rel", "dst", "weight")).unionByName(sup.select("src", F.lit("supersedes").alias("rel"), "dst", "weight")).unionByName(seq_.select("src", F.lit("sequence").alias("rel"), "dst", "weight"))
    more = more.groupBy("src", "rel", "dst").agg(F.max("weight").alias("weight")).join(kept.select("src", "rel", "dst"), ["src", "rel", "dst"], "left_anti").filter("src <> dst")
    stamp = lambda e: e.withColumns({"first_seen": at, "last_reinforced": at})
    both = cut(kept.unionByName(stamp(more)))
    alone = cut(graph.islands(facts.select("id", "signature"), both))
    if not alone.isEmpty():
        one = named_pairs(knn_pairs(v, 1, of=alone.select(F.col("id").alias("vec_id"))), named).select(F.col("src").alias("vec_id"), F.col("dst").alias("neighbour_id"), "cosine", "rank")
        both = cut(both.unionByName(stamp(weave.rescue(one, facts, both)).select(both.columns)))
    lost = bad.select(F.col("src").alias("src_sig"), "rel", F.col("dst").alias("dst_sig"))
    durable = weave.durable(both, store["evidence_transitions"].join(lost, ["src_sig", "rel", "dst_sig"], "left_anti").select(store["evidence_transitions"].columns))
    nodes = weave.corrected(store["nodes"], sup, at)
    durable = cut(durable)
    linked = recall.sequence_members(both, durable)
    return repaired(store.having(nodes=nodes, edges=both, evidence_transitions=durable, chains=cut(linked)), at).moved(last_weave_seq=seq)


def fold_aliases(store: Store, aliases: DataFrame) -> Store:
    """The store with each alias (alias, canonical) folded into its hub: forms united, edges and chronicle facets repointed, the alias and its vector gone.

    Only live hubs count. Of an alias of several the smallest stands, a chain of aliases
    leads to its end, and one that leads back to itself is left alone.
    """
    hubs = store["nodes"].filter("kind = 'entity'").select("signature")
    live = aliases.filter("alias <> canonical").join(hubs.withColumnRenamed("signature", "alias"), "alias", "left_semi").join(hubs.withColumnRenamed("signature", "canonical"), "canonical", "left_semi")
    to = cut(live.groupBy("alias").agg(F.min("canonical").alias("canonical")))
    while True:
        step = to.select(F.col("alias").alias("canonical"), F.col("canonical").alias("__next"))
        moved = to.join(step, "canonical")
        if moved.isEmpty():
            break
        to = cut(to.join(step, "canonical", "left").select("alias", F.coalesce("__next", "canonical").alias("canonical")).filter("alias <> canonical"))
    said = store["nodes"].filter("kind = 'entity'").join(to.withColumnRenamed("alias", "signature"), "signature")
    own = F.concat(F.coalesce("forms", F.array().cast("array<string>")), F.array(F.lower(text.label_of(F.col("signature")))))
    forms = said.select("canonical", F.explode(own).alias("f")).filter("length(f) >= 3").groupBy(F.col("canonical").alias("signature")).agg(F.array_sort(F.collect_set("f")).alias("__f"))
    gone = to.select(F.col("alias").alias("signature"))
    nodes = store["nodes"].join(gone, "signature", "left_anti").join(forms, "signature", "left").withColumn("forms", F.when(F.col("__f").isNull(), F.col("forms")).otherwise(F.array_distinct(F.concat(F.coalesce("forms", F.array().cast("array<string>")), "__f"))))
    out = store["edges"].join(gone.withColumnRenamed("signature", "src"), "src", "left_anti").join(to.select(F.col("alias").alias("dst"), "canonical"), "dst", "left").withColumn("dst", F.coalesce("canonical", "dst")).filter("src <> dst")
    edges = out.groupBy("src", "rel", "dst").agg(F.max("weight").alias("weight"), F.min("first_seen").alias("first_seen"), F.max("last_reinforced").alias("last_reinforced"))
    facets = store["chronicle_entry_entities"].join(to.withColumnRenamed("alias", "entity_sig"), "entity_sig", "left").withColumn("entity_sig", F.coalesce("canonical", "entity_sig")).drop("canonical").distinct()
    dead = store["nodes"].join(gone, "signature", "left_semi").select("id")
    return store.having(nodes=cut(nodes), edges=cut(edges), chronicle_entry_entities=cut(facets), vectors=cut(store["vectors"].join(dead, "id", "left_anti")))


def kept_up(store: Store, now: datetime, seq: int, tuning: Tuning) -> tuple[Store, DataFrame]:
    """(the store after upkeep, a summary): decay, reactivation, then evaporation and eviction or demotion."""
    at = F.lit(now)
    facts = cut(store.facts())
    n = facts.count()
    mentions = cut(store["edges"].filter("rel = 'mentions'").select("src", "dst"))
    cap = graph.hub_cap(n)
    fit = cut(graph.schema_fit(mentions, n).select(F.col("src").alias("signature"), "fit"))
    pressure = n / tuning.target
    accel = round(1 + max(0.0, pressure - 1) + 0.4 * max(0.0, pressure - 0.6), 3)
    decayed = upkeep.decay_facts(facts, fit, at, accel, tuning.forget_multiplier)
    since = store.cursor("last_dream_seq")
    new = facts.select("signature", F.coalesce("dirty_seq", F.lit(seq)).alias("seq"))
    new = cut(new if since is None else new.filter((F.col("seq") > since) & (F.col("seq") <= seq)))
    triggers, evidence = upkeep.reactivate(new, mentions, cap)
    j = decayed.join(triggers, "signature", "left").join(fit, "signature", "left")
    f = F.coalesce("fit", F.lit(0.0))
    back = F.col("triggers").isNotNull()
    ready = back & (F.col("class") == "episodic") & (F.coalesce("reactivations", F.lit(0)) + 1 >= scoring.promotion_threshold(f))
    after = j.withColumn("strength", F.when(back, scoring.clamp01(F.col("strength") + scoring.reactivation_boost(f, F.col("triggers")))).otherwise(F.col("strength"))).withColumn("last_reactivated", F.when(back, at).otherwise(F.col("last_reactivated"))).withColumn("__ready", ready).withColumn("reactivations", F.coalesce("reactivations", F.lit(0)) + back.cast("long"))
    after = cut(after.drop("triggers", "fit"))
    qualified = evidence.join(after.filter("__ready").select("signature"), "signature")
    members = upkeep.merge_counters(store["reactivation_members"], qualified.select(F.col("hub").alias("family_key"), F.col("signature").alias("member_sig"), F.col("cues").alias("evidence_count"), F.col("seq").alias("latest_seq"), at.cast("timestamp").alias("observed_at")))
    families = members.groupBy("family_key").agg(F.max("latest_seq").alias("evidence_seq"), F.sum("evidence_count").alias("evidence_count"), F.max("observed_at").alias("observed_at"))
    pend = upkeep.pending_families(families, store["reactivation_reviews"]).join(graph.hub_degree(mentions).filter(F.col("degree") <= cap).select(F.col("dst").alias("family_key")), "family_key", "left_semi")
    big = members.join(pend.select("family_key"), "family_key").groupBy("family_key").count().filter("count >= 3").select("family_key")
    protected = cut(new.select("signature").unionByName(triggers.select("signature")).unionByName(members.join(big, "family_key").select(F.col("member_sig").alias("signature"))).distinct())
    rest = after.drop("__ready")
    if tuning.tiered:
        out = cut(upkeep.demoting(rest, protected.unionByName(store["edges"].filter("rel = 'supersedes'").select(F.col("dst").alias("signature"))).distinct(), tuning.tier2))
        gone = rest.limit(0).select("signature")
    else:
        over = max(0.0, pressure - 0.6)
        fade = min(0.4, 0.25 + (pressure - 1) * 0.25) if pressure >= 1 else 0.0
        faded = cut(upkeep.evaporating(rest, protected, round(min(0.45, 0.15 + 0.35 * over), 3), round(fade, 3)).select("signature"))
        left = rest.join(faded, "signature", "left_anti")
        gone = cut(faded.unionByName(upkeep.over_cap(left, protected, tuning.most).select("signature")))
        out = rest.limit(0).select("signature", F.lit(1).alias("pass"))
    moved = out.select("signature", F.lit(True).alias("__out"))
    kept = rest.join(gone, "signature", "left_anti").join(moved, "signature", "left").withColumn("notes", F.when(F.col("__out"), "archive").otherwise(F.col("notes"))).drop("__out")
    others = store["nodes"].join(facts.select("signature"), "signature", "left_anti").select(kept.columns)
    nodes = cut(kept.unionByName(others))
    dead = cut(gone.unionByName(out.select("signature")))
    edges = upkeep.decay_edges(store["edges"].join(dead.select(F.col("signature").alias("src")), "src", "left_anti").join(dead.select(F.col("signature").alias("dst")), "dst", "left_anti"))
    hubs = upkeep.unused_hubs(nodes, edges.filter("rel = 'mentions'"), store["chronicle_entry_entities"]).select("signature")
    nodes = cut(nodes.join(hubs, "signature", "left_anti"))
    lost = nodes.filter("notes = 'archive'").select("id", F.lit(True).alias("__a"))
    vectors = store["vectors"].join(nodes.select("id"), "id", "left_semi").join(lost, "id", "left").withColumn("lane", F.when(F.col("__a") & (F.col("lane") == "active"), "archive").otherwise(F.col("lane"))).drop("__a")
    tombs = store["tombstones"].unionByName(rest.join(gone, "signature").select("signature", F.coalesce("memory_id", F.lit("")).alias("memory_id"), at.cast("timestamp").alias("forgotten_at"), F.lit("faded").alias("reason")))
    new_store = store.having(nodes=nodes, edges=edges, vectors=vectors, reactivation_members=members, reactivation_families=families)
    new_store, old = demoted_chronicles(new_store, at)
    totals = (("facts", facts), ("reactivated", triggers), ("ready for review", after.filter("__ready")), ("gone", gone), ("demoted", out), ("hubs pruned", hubs), ("chronicles demoted", old), ("active", new_store.facts()), ("archived", new_store["nodes"].filter("kind = 'fact' AND notes = 'archive'")))
    summary = None
    for name, df in totals:
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
        summary = one if summary is None else summary.unionByName(one)
    summary = cut(summary)
    status = scoring.budget(F.max(F.when(F.col("what") == "active", F.col("n"))), tuning.target, tuning.most)["status"]
    said = F.concat(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "what", "n"))), ", "), F.lit("; status "), status)
    run = F.lit(f"night-{seq}")
    whole = summary.agg(said.alias("reason")).select(F.lit("keep").alias("op"), "reason")
    each = rest.join(gone.withColumn("op", F.lit("faded")).unionByName(out.select("signature", F.lit("demoted").alias("op"))), "signature").select("op", "memory_id", "signature", F.col("fact").alias("original_fact"))
    written = each.unionByName(whole, allowMissingColumns=True).withColumns({"dreamed_at": at.cast("timestamp"), "run_id": run})
    tombs, journal = upkeep.housekeeping(tombs, store["journal"].unionByName(written, allowMissingColumns=True), at.cast("timestamp"))
    return repaired(new_store.having(tombstones=cut(tombs), journal=cut(journal)), at.cast("timestamp")).moved(last_dream_seq=seq), summary


def demoted_chronicles(store: Store, today: Column) -> tuple[Store, DataFrame]:
    """(the store, the chronicles that went to the archive): those that coarser ones stand for by now; their vectors change lanes."""
    live = store["nodes"].filter("kind = 'chronicle' AND (notes IS NULL OR notes <> 'archive')").select("id", F.col("signature").alias("node_sig"), "salience_score")
    own = store["chronicles"].join(live, "node_sig")
    old = cut(upkeep.skyline(own, store["chronicle_evidence"], F.to_date(today)))
    gone = old.select(F.col("node_sig").alias("signature"), F.lit(True).alias("__g")).distinct()
    nodes = store["nodes"].join(gone, "signature", "left").withColumn("notes", F.when(F.col("__g"), "archive").otherwise(F.col("notes"))).drop("__g")
    ids = own.join(old.select("node_sig"), "node_sig", "left_semi").select("id", F.lit(True).alias("__g")).distinct()
    vectors = store["vectors"].join(ids, "id", "left").withColumn("lane", F.when(F.col("__g") & (F.col("lane") == "chron"), "chron_archive").otherwise(F.col("lane"))).drop("__g")
    return store.having(nodes=cut(nodes), vectors=cut(vectors)), old


def recorded(store: Store, ids: DataFrame) -> Store:
    """The store with the ids (signature, memory_id) that a projection was given; that of the anchor, which is no node, is kept as a cursor."""
    anchor = ids.filter(F.col("signature") == ANCHOR).select(F.lit("anchor_memory_id").alias("key"), F.coalesce("memory_id", F.lit("")).alias("value")).limit(1)
    given = ids.filter(F.col("signature") != ANCHOR).groupBy("signature").agg(F.max(F.struct(F.lit(True).alias("is"), F.col("memory_id"))).alias("__m"))
    nodes = store["nodes"].join(given, "signature", "left").withColumn("memory_id", F.when(F.col("__m").isNotNull(), F.col("__m.memory_id")).otherwise(F.col("memory_id"))).drop("__m")
    meta = store["meta"].join(anchor.select("key"), "key", "left_anti").select("key", "value").unionByName(anchor)
    return store.having(nodes=cut(nodes), meta=cut(meta))


def unique_signatures(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """``wanted`` (id, base) with a signature that neither ``taken`` (signature) nor another row has: the base itself, or by id the base with the numbers -2, -3, ... after the highest that is taken. Numbered by ranges, so that one frequent base fills no task."""
    tail = F.regexp_extract("signature", "-([0-9]{1,9})$", 1)
    used = taken.select(F.col("signature").alias("base"), F.lit(1).alias("n")).unionByName(taken.filter(tail != "").select(F.regexp_replace("signature", "-[0-9]{1,9}$", "").alias("base"), tail.cast("int").alias("n")))
    held = used.groupBy("base").agg(F.max("n").alias("__held"))
    rows = cut(graph.numbered(wanted.select("id", "base"), ["base", "id"], "__place").join(held, "base", "left"))
    first = rows.groupBy("base").agg(F.min("__place").alias("__first"))
    n = F.coalesce("__held", F.lit(0)) + F.col("__place") - F.col("__first") + 1
    return rows.join(first, "base").select("id", "base", F.when(n == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), n.cast("string"))).alias("signature"))


def split_model(store: Store, now: datetime) -> tuple[Store, DataFrame]:
    """(the store, (id, before, after) of what was renamed): nodes with a memory are facts, under signatures of their own words; the others are entities."""
    has = (F.coalesce("memory_id", F.lit("")) != "") & (F.col("memory_id") != "live")
    nodes = store["nodes"]
    due = nodes.filter(has & ~F.coalesce(F.col("signature").startswith("fact:"), F.lit(False))).select("id", F.col("signature").alias("before"), F.concat(F.lit("fact:"), text.derive_slug(F.coalesce(F.when(F.col("fact") != "", F.col("fact")), text.label_of(F.col("signature"))))).alias("base"))
    others = nodes.join(due.select("id"), "id", "left_anti").select("signature")
    named = cut(due.join(unique_signatures(due.select("id", "base"), others).select("id", F.col("signature").alias("after")), "id").select("id", "before", "after"))
    kept = nodes.withColumn("__has", F.coalesce(has, F.lit(False))).join(named.select("id", "after"), "id", "left").withColumns({"signature": F.coalesce("after", "signature"), "kind": F.when(F.col("__has"), "fact").otherwise("entity"), "memory_id": F.when(F.col("__has"), F.col("memory_id")).otherwise("")}).drop("after", "__has")
    return repaired(store.having(nodes=cut(kept)), F.lit(now).cast("timestamp")), named


def apply_merges(store: Store, decisions: DataFrame, members: DataFrame, clusters: DataFrame, now: datetime) -> Store:
    """The store after merges: survivors become gists, their own texts and all members stay as details beneath them. Any fault rejects all.

    ``decisions`` is (decision, survivor, form, fact), ``members`` (decision, member)."""
    from . import review

    bad = review.merge_faults(decisions, members, clusters, store["nodes"]).limit(20).collect()
    if bad:
        raise ValueError("merges rejected: " + ", ".join(sorted({f"{r.decision} {r.reason}" for r in bad})))
    nodes, at = store["nodes"], F.lit(now).cast("timestamp")
    gained = review.merged(decisions, members, nodes).withColumnsRenamed({"strength": "__s", "salience_score": "__p", "reactivations": "__r", "first_seen": "__f"})
    said = decisions.select(F.col("survivor").alias("signature"), F.col("fact").alias("__fact"), F.col("form").alias("__form"))
    clone = nodes.join(said, "signature").withColumn("signature", F.concat("signature", F.lit("~original"))).withColumn("id", F.xxhash64("signature")).withColumn("notes", F.lit("detail")).withColumn("memory_id", F.lit(None).cast("string")).select(nodes.columns)
    details = members.join(decisions.select("decision", "survivor"), "decision").filter("member <> survivor")
    d = details.select(F.col("member").alias("signature"), F.lit(True).alias("__d"))
    j = nodes.join(gained, "signature", "left").join(said, "signature", "left").join(d, "signature", "left")
    is_gist = F.col("__fact").isNotNull()
    after = j.withColumn("notes", F.when(is_gist, "gist").when(F.col("__d"), "detail").otherwise(F.col("notes"))).withColumn("fact", F.coalesce("__fact", "fact")).withColumn("strength", F.coalesce("__s", "strength")).withColumn("salience_score", F.coalesce("__p", "salience_score")).withColumn("reactivations", F.coalesce("__r", "reactivations")).withColumn("first_seen", F.coalesce("__f", "first_seen")).withColumn("temporal_form", F.coalesce("__form", "temporal_form")).withColumn("source_day", F.when(is_gist, F.lit(None)).otherwise(F.col("source_day"))).select(nodes.columns).unionByName(clone)
    links = details.select(F.col("member").alias("detail_sig"), F.col("survivor").alias("gist_sig")).unionByName(decisions.select(F.concat("survivor", F.lit("~original")).alias("detail_sig"), F.col("survivor").alias("gist_sig"))).withColumn("first_seen", at)
    moved = details.select(F.col("member").alias("gist_sig"), F.col("survivor").alias("__to"))
    lineage = store["detail_of"].join(moved, "gist_sig", "left").withColumn("gist_sig", F.coalesce("__to", "gist_sig")).drop("__to").unionByName(links).dropDuplicates(["detail_sig", "gist_sig"])
    copied = store["edges"].filter("rel = 'mentions'").join(details.select(F.col("member").alias("src"), "survivor"), "src").select(F.col("survivor").alias("src"), "rel", "dst", "weight", "first_seen", "last_reinforced")
    edges = store["edges"].unionByName(copied).dropDuplicates(["src", "rel", "dst"])
    return store.having(nodes=cut(after), edges=cut(edges), detail_of=cut(lineage))


def apply_synthesis(store: Store, concepts: DataFrame, members: DataFrame, now: datetime) -> Store:
    """The store with a concept (concept, fact) over each group of members (concept, member): the members go to the archive, linked beneath it; their vectors move lanes unchanged."""
    nodes, at = store["nodes"], F.lit(now).cast("timestamp")
    stale = members.join(nodes.select(F.col("signature").alias("member")), "member", "left_anti").select("concept").unionByName(members.groupBy("concept").count().filter("count < 3").select("concept")).distinct()
    good, m = concepts.join(stale, "concept", "left_anti"), members.join(stale, "concept", "left_anti")
    span = m.join(nodes.withColumnRenamed("signature", "member"), "member").groupBy("concept").agg(F.min("first_seen").alias("first_seen"))
    new = good.join(span, "concept").select(F.xxhash64("concept").alias("id"), F.col("concept").alias("signature"), F.lit("semantic").alias("class"), F.lit(0.62).alias("strength"), "first_seen", F.lit("gist").alias("notes"), "fact", F.lit("fact").alias("kind"))
    gone = m.select(F.col("member").alias("signature"), F.lit(True).alias("__g")).distinct()
    after = nodes.join(gone, "signature", "left").withColumn("notes", F.when(F.col("__g"), "archive").otherwise(F.col("notes"))).select(nodes.columns).unionByName(new, allowMissingColumns=True)
    ids = after.filter("notes = 'archive'").select("id", F.lit(True).alias("__a"))
    vectors = store["vectors"].join(ids, "id", "left").withColumn("lane", F.when(F.col("__a") & (F.col("lane") == "active"), "archive").otherwise(F.col("lane"))).drop("__a")
    links = store["detail_of"].unionByName(m.select(F.col("member").alias("detail_sig"), F.col("concept").alias("gist_sig"), at.alias("first_seen"))).dropDuplicates(["detail_sig", "gist_sig"])
    ends = gone.select(F.col("signature").alias("src"))
    edges = store["edges"].join(ends, "src", "left_anti").join(ends.withColumnRenamed("src", "dst"), "dst", "left_anti")
    return store.having(nodes=cut(after), vectors=cut(vectors), detail_of=cut(links), edges=cut(edges))


def apply_chronicles(store: Store, new: DataFrame, entries: DataFrame, evidence: DataFrame, now: datetime) -> Store:
    """The store with new chronicles (node_sig, resolution, period_start, period_end, fact, ...): versions counted on, the replaced ones archived, each linked to its neighbours in time."""
    from . import chronicles

    versioned, old = chronicles.versioned(new, store["chronicles"])
    versioned = cut(versioned.withColumn("created_at", F.lit(now).cast("timestamp")))
    strength = chronicles.strengths(store["chronicles"], evidence, store["nodes"])
    own = versioned.join(strength, "node_sig", "left").select(F.xxhash64("node_sig").alias("id"), F.col("node_sig").alias("signature"), F.lit("semantic").alias("class"), F.coalesce("strength", F.lit(0.45)).alias("strength"), "salience_score", F.lit("chronicle").alias("notes"), "fact", F.lit("chronicle").alias("kind"))
    gone = old.select(F.col("node_sig").alias("signature"), F.lit(True).alias("__g"))
    nodes = store["nodes"].join(gone, "signature", "left").withColumn("notes", F.when(F.col("__g"), "archive").otherwise(F.col("notes"))).drop("__g").unionByName(own, allowMissingColumns=True)
    live = store["chronicles"].join(old, "node_sig", "left_anti").select("node_sig", "resolution", "period_end", "version").unionByName(versioned.select("node_sig", "resolution", "period_end", "version"))
    steps = chronicles.next_period(live).select("src", F.lit("next_period").alias("rel"), "dst", F.lit(1.0).alias("weight"))
    edges = store["edges"].filter("rel <> 'next_period'").unionByName(steps, allowMissingColumns=True)
    return store.having(nodes=cut(nodes), edges=cut(edges), chronicles=cut(store["chronicles"].unionByName(versioned, allowMissingColumns=True).select(store["chronicles"].columns)), chronicle_entries=store["chronicle_entries"].unionByName(entries, allowMissingColumns=True), chronicle_evidence=store["chronicle_evidence"].unionByName(evidence))


def apply_entities(store: Store, reviews: DataFrame, seq: int, now: datetime) -> Store:
    """The store after hub reviews (sig, action, retyped_to, report_id): rejected and retyped hubs go with their mentions, their facts become new work; any unknown action or missing type rejects all."""
    bad = reviews.filter("action NOT IN ('keep', 'reject', 'retype', 'remove_forms') OR (action = 'retype' AND coalesce(retyped_to, '') NOT RLIKE '^(person|org|team|place|project|system|topic)$')").limit(5).collect()
    if bad:
        raise ValueError("reviews rejected: " + ", ".join(f"{r.sig} {r.action}" for r in bad))
    from . import review

    lost = reviews.filter("action IN ('reject', 'retype')").select("sig")
    touched = store["edges"].filter("rel = 'mentions'").join(lost.select(F.col("sig").alias("dst")), "dst", "left_semi").select(F.col("src").alias("signature")).distinct()
    sever = store["edges"].join(lost.select(F.col("sig").alias("dst")), "dst", "left_anti")
    hit = touched.select(F.col("signature").alias("src"), F.lit(True).alias("__t"))
    edges = sever.join(hit, "src", "left").filter("__t IS NULL OR rel NOT IN ('related_to', 'similar_to')").drop("__t")
    mark = touched.select("signature", F.lit(True).alias("__t"))
    new_sig = F.concat("retyped_to", F.lit(":"), F.substring_index("sig", ":", -1))
    retyped = reviews.filter("action = 'retype'").select(new_sig.alias("signature"), F.xxhash64(new_sig).alias("id"), F.lit("entity").alias("kind"), F.lit(0.5).alias("strength"))
    nodes = store["nodes"].join(lost.select(F.col("sig").alias("signature")), "signature", "left_anti").join(mark, "signature", "left").withColumn("dirty_seq", F.when(F.col("__t"), F.lit(seq)).otherwise(F.col("dirty_seq"))).drop("__t").unionByName(retyped, allowMissingColumns=True).dropDuplicates(["signature"])
    status = F.when(F.col("action") == "reject", "rejected").otherwise("approved")
    judged = store["entity_adjudications"].unionByName(reviews.select("sig", status.alias("status"), "action", "retyped_to", F.lit(now).cast("timestamp").alias("reviewed_at"), F.lit(seq).cast("long").alias("reviewed_seq"), "report_id"))
    return store.having(nodes=cut(nodes), edges=cut(edges), entity_adjudications=review.keep_last(judged))
