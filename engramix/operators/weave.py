"""Edges between facts: co-mention, siblings, corrections, sequences, and rescue of islands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import scoring, text
from . import lexical
from .graph import cut

K, LEAST, HIGH = 3, 0.45, 0.62


def vocabulary(hubs: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """(form, sig): surface forms of hubs, without hubs judged away and single-word names that several persons own."""
    h = hubs if gone is None else hubs.join(gone.select(F.col("sig").alias("signature")), "signature", "left_anti")
    forms = F.array_distinct(F.concat(text.forms_for(F.col("signature")), F.coalesce("forms", F.array().cast("array<string>"))))
    v = h.select(F.col("signature").alias("sig"), F.explode(forms).alias("form")).filter("length(form) >= 3")
    person = (text.type_of(F.col("sig")) == "person") & ~F.col("form").contains(" ")
    owners = F.size(F.collect_set("sig").over(Window.partitionBy("form")))
    return v.withColumn("__n", owners).filter(~(person & (F.col("__n") > 1))).select("form", "sig")


def co_mentions(facts: DataFrame, forms: DataFrame, longest: int = 4) -> DataFrame:
    """(src, dst): facts and the hubs whose form, of up to ``longest`` words, they hold as whole words. One pass over each text, whatever the number of forms."""
    space = F.lit(" ")
    sought = forms.filter(F.size(F.split("form", " ")) <= longest).select(F.concat(space, "form", space).alias("t"), F.col("sig").alias("dst"))
    said = facts.select("signature", F.concat(space, F.array_join(text.words(F.col("fact")), " "), space).alias("low"))
    return lexical.matches(said, sought.select("t").distinct(), "signature").join(sought, "t").select(F.col("signature").alias("src"), "dst").distinct()


def specific_caps(facts: int) -> tuple[int, int]:
    """How many mentions a hub, and how many facts a scope, may have and still tell one subject from another."""
    return max(4, round(0.01 * facts)), max(4, round(0.02 * facts))


def evidence_window(facts: DataFrame, changed: DataFrame, tier2: int) -> DataFrame:
    """The changed facts, filled up with the most recently changed others, so that what recurs over several nights is seen together."""
    fill = max(500, min(2500, tier2)) - changed.count()
    if fill <= 0:
        return changed
    rest = facts.join(changed.select("signature"), "signature", "left_anti").select(facts.columns)
    return changed.unionByName(rest.orderBy(F.desc(F.coalesce("dirty_seq", F.lit(0))), "signature").limit(fill))


def versions(pairs: DataFrame, facts: DataFrame, mentions: DataFrame, total: int, among: DataFrame | None = None) -> DataFrame:
    """Each fact (src) with its older neighbours (dst): (src, dst, rank, cosine, jaccard, shared, containment, shared_hub, same_scope, correction, at).

    ``pairs`` is (src, dst, cosine, rank), ``facts`` (signature, fact, first_seen). Hubs and
    scopes that many of the ``total`` facts have are no sign of one subject and are left out.
    ``among`` (signature) holds the facts of the pairs, if they are few: only their words are made.
    """
    of_hub, of_scope = specific_caps(total)
    specific = mentions.groupBy("dst").agg(F.count("*").alias("n")).filter(F.col("n") <= of_hub).select("dst")
    hubs = mentions.join(specific, "dst").groupBy(F.col("src").alias("signature")).agg(F.collect_set("dst").alias("hubs"))
    # both sides of the pairs read the words: they are made once
    paired = facts if among is None else facts.join(among.select("signature"), "signature", "left_semi")
    own = cut(paired.select("signature", "first_seen", text.content_words(F.col("fact")).alias("w"), text.scope_of(F.col("fact")).alias("scope"), text.is_correction(F.col("fact")).alias("correction")))
    each = own if among is None else facts.select(text.scope_of(F.col("fact")).alias("scope"))
    scopes = cut(each.filter("scope <> ''").groupBy("scope").agg(F.count("*").alias("n")).filter(F.col("n") <= of_scope).select(F.col("scope").alias("__scope"), F.lit(True).alias("narrow")))
    # most facts have no scope: they must not meet in one task
    key = F.when(F.col("scope") == "", F.concat(F.lit(" "), F.pmod(F.xxhash64("signature"), F.lit(4096)).cast("string"))).otherwise(F.col("scope"))
    own = own.withColumn("__scope", key).join(F.broadcast(scopes) if scopes.count() <= 100_000 else scopes, "__scope", "left").drop("__scope")
    own = own.join(hubs, "signature", "left")
    side = lambda s: own.select(F.col("signature").alias({"a": "src", "b": "dst"}[s]), *[F.col(c).alias(f"{s}_{c}") for c in ("first_seen", "w", "scope", "correction", "hubs", "narrow")])
    j = pairs.join(side("a"), "src").join(side("b"), "dst").filter("b_first_seen < a_first_seen")
    # the words of a pair are compared once; text.jaccard and text.containment say the same of two columns
    sized = j.withColumns({"__n": F.size(F.array_intersect("a_w", "b_w")), "__a": F.size("a_w"), "__b": F.size("b_w")}).drop("a_w", "b_w")
    n, a, b = F.col("__n"), F.col("__a"), F.col("__b")
    return sized.select(
        "src", "dst", "rank", "cosine", F.when((a == 0) | (b == 0), F.lit(0.0)).otherwise(n / (a + b - n)).alias("jaccard"), n.alias("shared"), (n / F.greatest(F.lit(1), F.least(a, b))).alias("containment"),
        F.coalesce(F.arrays_overlap("a_hubs", "b_hubs"), F.lit(False)).alias("shared_hub"), (F.coalesce(F.col("a_narrow"), F.lit(False)) & (F.col("a_scope") == F.col("b_scope"))).alias("same_scope"),
        F.col("a_correction").alias("correction"), F.col("b_first_seen").alias("at"),
    )


def corrections(near: DataFrame, existing: DataFrame, k: int = 11) -> DataFrame:
    """(src, dst, weight): new corrections out of :func:`versions`, each to the most alike of the older facts it may replace."""
    found = supersedes(near.filter(F.col("correction") & (F.col("rank") <= k)))
    return found.join(existing.select("src", "dst"), ["src", "dst"], "left_anti").select("src", "dst", "weight")


def lineage(near: DataFrame, existing: DataFrame, k: int = 39) -> DataFrame:
    """(src, dst, weight): from the nearest older version of each fact to the fact, out of :func:`versions`."""
    c = near.filter(F.col("rank") <= k).select(F.col("dst").alias("older"), F.col("src").alias("newer"), "cosine", "shared", "containment", "at")
    return sequences(c, existing)


def corrected(nodes: DataFrame, links: DataFrame, now) -> DataFrame:
    """``nodes`` after corrections (src, dst): the correcting fact is strengthened and kept as knowledge, the corrected one cued, less strongly."""
    up = links.select(F.col("src").alias("signature"), F.lit(0.18).alias("__by")).distinct()
    down = links.select(F.col("dst").alias("signature"), F.lit(0.05).alias("__by")).distinct()
    by = up.unionByName(down).groupBy("signature").agg(F.max("__by").alias("__by"))
    j = nodes.join(by, "signature", "left")
    led = F.coalesce(F.col("__by") == 0.18, F.lit(False))
    new = {
        "strength": F.when(F.col("__by").isNull(), F.col("strength")).otherwise(scoring.clamp01(F.coalesce("strength", F.lit(0.0)) + F.col("__by"))),
        "class": F.when(led & (F.col("class") == "episodic"), "semantic").otherwise(F.col("class")),
        "reactivations": F.when(led, F.coalesce("reactivations", F.lit(0)) + 1).otherwise(F.col("reactivations")),
        "last_reactivated": F.when(F.col("__by").isNotNull(), now).otherwise(F.col("last_reactivated")),
    }
    return j.withColumns(new).select(nodes.columns)


def siblings(pairs: DataFrame, hubs: DataFrame, k: int = K, least: float = LEAST, high: float = HIGH) -> DataFrame:
    """(src, rel, dst, weight): up to k of a fact's neighbours: related if they share a hub, else similar if very near."""
    h = hubs.groupBy("src").agg(F.collect_set("dst").alias("h"))
    j = pairs.filter(F.col("cosine") >= least).join(h.withColumnRenamed("src", "vec_id"), "vec_id", "left").join(h.select(F.col("src").alias("neighbour_id"), F.col("h").alias("h2")), "neighbour_id", "left")
    shared = F.coalesce(F.arrays_overlap("h", "h2"), F.lit(False))
    rel = F.when(shared, "related_to").when(F.col("cosine") >= high, "similar_to")
    j = j.withColumn("rel", rel).filter("rel IS NOT NULL")
    w = Window.partitionBy("vec_id").orderBy(F.desc("cosine"), "neighbour_id")
    return j.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= k).select(F.col("vec_id").alias("src"), "rel", F.col("neighbour_id").alias("dst"), F.round("cosine", 3).alias("weight"))


def pruned(supersedes: DataFrame, facts: DataFrame, least: float = 0.12) -> DataFrame:
    """Corrections whose facts have too few words in common to be about one thing."""
    ends = supersedes.select(F.explode(F.array("src", "dst")).alias("signature")).distinct()
    c = facts.join(ends, "signature", "left_semi").select("signature", text.content_words(F.col("fact")).alias("c"))
    j = supersedes.join(c.select(F.col("signature").alias("src"), F.col("c").alias("a")), "src").join(c.select(F.col("signature").alias("dst"), F.col("c").alias("b")), "dst")
    return j.filter(text.jaccard(F.col("a"), F.col("b")) < least).select(supersedes.columns)


def supersedes(candidates: DataFrame) -> DataFrame:
    """(src, dst, weight): each correction's best older fact; ``candidates`` is (src, dst, cosine, jaccard, shared_hub, same_scope) of older neighbours."""
    close = F.col("cosine").between(0.5, 0.96)
    same = (F.col("jaccard") >= 0.34) | ((F.col("shared_hub") | F.col("same_scope")) & (F.col("jaccard") >= 0.12))
    best = candidates.filter(close & same).groupBy("src").agg(F.max_by("dst", F.struct("cosine", (-F.col("dst")).alias("k")) if dict(candidates.dtypes)["dst"] != "string" else F.struct("cosine", "dst")).alias("dst"))
    return best.withColumn("weight", F.lit(0.9))


def sequences(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """(src, dst, weight): from the nearest older fact to each newer one, where words carry on; ``candidates`` is (older, newer, cosine, shared, containment, at) and no pair is linked twice, in either direction."""
    ok = (F.col("cosine") >= 0.6) & (F.col("shared") >= 3) & ((F.col("containment") >= 0.8) | (F.col("cosine") >= 0.85))
    best = candidates.filter(ok).groupBy("newer").agg(F.max_by("older", F.struct("at", "older")).alias("older"))
    done = existing.select("src", "dst").unionByName(existing.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return best.select(F.col("older").alias("src"), F.col("newer").alias("dst")).join(done, ["src", "dst"], "left_anti").withColumn("weight", F.lit(0.8))


def rescue(pairs: DataFrame, facts: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, rel, dst, weight): the nearest neighbour of facts without an edge."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("signature")).distinct()
    alone = facts.select("signature").join(ends, "signature", "left_anti").select(F.col("signature").alias("vec_id"))
    return pairs.filter("rank = 1").join(alone, "vec_id", "left_semi").select(F.col("vec_id").alias("src"), F.lit("similar_to").alias("rel"), F.col("neighbour_id").alias("dst"), F.round("cosine", 3).alias("weight"))


def durable(edges: DataFrame, before: DataFrame) -> DataFrame:
    """Sequence and correction edges kept for good: first seen earliest, reinforced latest."""
    e = edges.filter("rel IN ('sequence', 'supersedes')").select(F.col("src").alias("src_sig"), "rel", F.col("dst").alias("dst_sig"), "first_seen", "last_reinforced")
    return before.unionByName(e).groupBy("src_sig", "rel", "dst_sig").agg(F.min("first_seen").alias("first_seen"), F.max("last_reinforced").alias("last_reinforced"))
