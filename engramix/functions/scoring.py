"""Strength, decay and activation as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HALF_LIFE = {"episodic": 3.0, "semantic": 180.0, "salient": 365.0}
EDGE_DECAY = {"mentions": 1.0, "supersedes": 1.0, "sequence": 1.0, "related_to": 0.985, "similar_to": 0.97}
EDGE_DECAY_OTHER = 0.99
SALIENT = 0.5
SCHEMA_FULL = 6.0


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def date_adjustment(day: Column, low: Column | None, high: Column | None) -> Column:
    """What a question's window adds: in it .2, after it -.2, before it nothing."""
    if low is None or high is None:
        return F.lit(0.0)
    return F.when(day.between(low, high), 0.2).when(day > high, -0.2).otherwise(0.0)


def activation(cosine: Column, strength: Column, superseded: Column | bool = False, detail: Column | bool = False, *, date_intent: bool = False, historical: bool = False, adjustment: Column | None = None) -> Column:
    """Cosine, plus a share of the strength where the cosine is .3 or more, less what lowers trust in the record."""
    share = 0.2 * (0.5 if date_intent and not historical else 1.0)
    score = cosine + F.when(cosine >= 0.30, share * F.coalesce(strength, F.lit(0.0))).otherwise(0.0)
    if not historical:
        score = score - F.when(F.lit(superseded) if isinstance(superseded, bool) else superseded, 0.15).otherwise(0.0)
    score = score - F.when(F.lit(detail) if isinstance(detail, bool) else detail, 0.12).otherwise(0.0)
    return score if adjustment is None else score + adjustment


def half_life(kind: Column, salience: Column, fit: Column, accel: Column | float, multiplier: float = 1.0) -> Column:
    """Days until a fact has half its strength: by class, stretched by salience and by schema fit, shortened under pressure."""
    base = F.when(kind == "episodic", HALF_LIFE["episodic"]).otherwise(HALF_LIFE["semantic"])
    s = clamp01(F.coalesce(salience, F.lit(0.0)))
    return (base + s * (HALF_LIFE["salient"] - base)) * multiplier * (1 + 0.6 * F.coalesce(fit, F.lit(0.0))) / accel


def decayed(strength: Column, since: Column, now: Column, half: Column) -> Column:
    days = F.greatest(F.lit(0.0), (F.unix_micros(now.cast("timestamp")) - F.unix_micros(since.cast("timestamp"))) / 86_400_000_000)
    return clamp01(strength * F.pow(F.lit(2.0), -days / half))


def edge_decay(rel: Column) -> Column:
    out = F.when(F.lit(False), 1.0)
    for name, factor in EDGE_DECAY.items():
        out = out.when(rel == name, factor)
    return out.otherwise(EDGE_DECAY_OTHER)


def schema_fit(largest_degree: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), largest_degree / SCHEMA_FULL))


def promotion_threshold(fit: Column) -> Column:
    """Reactivations that make an episode ready for review: 3 for an isolated one, 1 for a well-connected one."""
    return F.greatest(F.lit(1), F.floor(3 - 2 * fit + 0.5)).cast("long")


def reactivation_boost(fit: Column, triggers: Column) -> Column:
    return 0.10 * (1 + 0.5 * fit) * F.least(F.lit(1.5), 1 + 0.15 * (triggers - 1))


def vagueness(dropped: Column, total: Column, dispersion: Column, details: Column) -> Column:
    """How much a summary leaves open: by lost specifics if there are any, else by how far its members lie apart."""
    lost = 0.5 + 0.5 * dropped / F.greatest(total, F.lit(1))
    return clamp01(F.when(dropped > 0, lost).otherwise(0.5 * dispersion * F.log2(1 + details)))


def budget(n: Column, target: int = 250, most: int = 500) -> dict[str, Column]:
    """Pressure of ``n`` active facts on the budget, and the thresholds that follow from it."""
    pressure = n / F.lit(float(target))
    over = F.greatest(F.lit(0.0), pressure - 0.6)
    return {
        "pressure": F.round(pressure, 3),
        "forget_threshold": F.round(F.least(F.lit(0.45), 0.15 + over * 0.35), 3),
        "decay_accel": F.round(1 + F.greatest(F.lit(0.0), pressure - 1) + over * 0.4, 3),
        "merge_sim": F.round(F.greatest(F.lit(0.5), 0.62 - over * 0.18), 3),
        "semantic_fade": F.round(F.when(pressure >= 1, F.least(F.lit(0.4), 0.25 + (pressure - 1) * 0.25)).otherwise(0.0), 3),
        "status": F.when(n >= most, "critical").when(n > target, "over").when(pressure >= 0.8, "elevated").otherwise("ok"),
    }
