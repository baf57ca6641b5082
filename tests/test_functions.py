from datetime import date

import pytest
from pyspark.sql import functions as F

from engramix.functions import entities, rendering, scoring, temporal, text, vector
from engramix.sources import plugins
from engramix.sources.tuning import Tuning, boolean, number, read_knobs, save_knob

AS_OF = date(2026, 6, 30)  # a Tuesday
WINDOWS = [
    ("the outage of 2026-06-25", "06-25", "06-25"),
    ("all of 2026-06", "06-01", "06-30"),
    ("network faults on June 25 2026", "06-25", "06-25"),
    ("June 25, 2026 notes", "06-25", "06-25"),
    ("changes on June 25", "06-25", "06-25"),
    ("June 2026 faults", "06-01", "06-30"),
    ("was it in February", "02-01", "02-28"),
    ("late June", "06-21", "06-30"),
    ("early March", "03-01", "03-10"),
    ("mid April", "04-11", "04-20"),
    ("end of May 2026", "05-21", "05-31"),
    ("June 24-29", "06-24", "06-29"),
    ("from June 3 to 7", "06-03", "06-07"),
    ("Feb 30 2026", "02-28", "02-28"),
    ("how do containers resolve names", None, None),
    ("why is the price so", None, None),
    ("Monday through Friday", "06-22", "06-26"),
    ("Tuesday to Thursday", "06-23", "06-25"),
    ("on Monday", "06-29", "06-29"),
    ("the Friday lunch rule", None, None),
    ("last week in the west", "06-23", "06-30"),
    ("yesterday", "06-29", "06-29"),
    ("today", "06-30", "06-30"),
    ("the day before yesterday", "06-28", "06-28"),
    ("the past 3 days", "06-27", "06-30"),
    ("the last 2 weeks", "06-16", "06-30"),
    ("the past few days", "06-23", "06-30"),
    ("this past week", "06-23", "06-30"),
    ("last month", "05-30", "06-30"),
    ("recently", "06-20", "06-30"),
    ("2026-06-25, so last week", "06-25", "06-25"),
    ("2/27", "02-27", "02-27"),
    ("May 27 to June 2", "05-27", "06-02"),
    ("what may be wrong", None, None),
    ("in may", "05-01", "05-31"),
    ("the past couple of weeks", "06-09", "06-30"),
    ("this quarter", "03-30", "06-30"),
]


@pytest.mark.parametrize("words,low,high", WINDOWS)
def test_windows_of_questions(words, low, high):
    want = None if low is None else (date.fromisoformat(f"2026-{low}"), date.fromisoformat(f"2026-{high}"))
    assert temporal.parse_date_range(words, AS_OF) == want


def test_windows_of_other_years():
    assert temporal.parse_date_range("2/27/2025", AS_OF) == (date(2025, 2, 27),) * 2
    assert temporal.parse_date_range("Dec 30 to Jan 2", AS_OF) == (date(2026, 12, 30), date(2027, 1, 2))
    assert temporal.parse_date_range("last year", AS_OF) == (date(2025, 6, 30), AS_OF)
    assert temporal.parse_date_range(None, AS_OF) is None and temporal.parse_date_range("2026-13-45", AS_OF) is None


def one(spark, column, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column(F.col("c")) if callable(column) else column).first()[0]


def test_normal_forms(spark):
    assert one(spark, text.normalize, "  Héllo,  World-2! ") == "h llo world 2"
    assert one(spark, text.slug, "One two  three") == "one-two-three"
    assert one(spark, text.derive_slug, "The price of the new plan is not 5 but seven dollars") == "price-new-plan-but-seven"
    assert one(spark, text.derive_slug, None) == "fact"
    assert one(spark, text.normalize_for_match, " [Team] Moved on 2026-01-02: yes!") == "moved on yes"
    assert one(spark, text.significant_terms, "What did we decide about the low-cost plan, the plan?") == ["decide", "low-cost", "plan"]
    assert one(spark, lambda c: text.phrases(text.significant_terms(c)), "alpha beta gamma") == ["alpha beta", "beta gamma", "alpha beta gamma"]
    assert one(spark, text.scope_of, " [Big Team] x") == "big team" and one(spark, text.scope_of, "x [a]") == ""
    assert one(spark, text.strip_wrapper, "<untrusted_memory> a </untrusted_memory>") == "a"
    assert one(spark, text.strip_age, "[this week] a [b]") == "a [b]"
    assert one(spark, text.forms_for, "pr:fix-1234-now") == ["fix 1234 now", "1234"]
    assert one(spark, text.hard_specifics, "It cost $5 million, $5M, 12 % and 3x for 20 Users") == ["$5m", "12%", "20users", "3x"]
    assert one(spark, text.type_of, "person:ann-lee") == "person" and one(spark, text.label_of, "person:ann-lee") == "ann lee" and one(spark, text.label_of, "plain") == "plain"


def test_shapes_of_questions(spark):
    assert one(spark, text.is_enumerative, "list every fault") and not one(spark, text.is_enumerative, "is it up")
    assert one(spark, text.is_historical, "what was it originally") and one(spark, text.is_correction, "the date is no longer May")
    assert one(spark, text.wants_specifics, "in that meeting") and not one(spark, text.is_correction, None)


def test_overlaps(spark):
    row = spark.createDataFrame([(["a", "b", "c"], ["b", "c", "d", "e"], [])], "a array<string>, b array<string>, e array<string>").select(text.jaccard(F.col("a"), F.col("b")), text.containment(F.col("a"), F.col("b")), text.jaccard(F.col("a"), F.col("e"))).first()
    assert row[0] == pytest.approx(0.4) and row[1] == pytest.approx(2 / 3) and row[2] == 0


def test_periods(spark):
    d = spark.createDataFrame([(date(2024, 2, 29),)], "d date")
    for r, a, b in (("day", "2024-02-29", "2024-02-29"), ("week", "2024-02-26", "2024-03-03"), ("month", "2024-02-01", "2024-02-29"), ("quarter", "2024-01-01", "2024-03-31"), ("year", "2024-01-01", "2024-12-31")):
        row = d.select(temporal.period_start(r, F.col("d")), temporal.period_end(r, F.col("d")), temporal.period_start(F.lit(r), F.col("d")), temporal.period_end(F.lit(r), F.col("d"))).first()
        assert [str(x) for x in row] == [a, b, a, b]


@pytest.mark.parametrize("days,tag", [(None, "undated"), (0, "just now"), (7, "this week"), (8, "past couple weeks"), (45, "last month or so"), (90, "a couple months ago"), (150, "earlier this period"), (151, "long ago")])
def test_age_tags(spark, days, tag):
    assert one(spark, temporal.age_tag, days, "long") == tag


def test_text_dates(spark):
    got = one(spark, lambda c: temporal.earliest_text_date(c).cast("string"), "v2024-99-01, 2026-03-04T10:00:00Z then 2026-03-01, not 1999-01-01")
    assert got == "2026-03-01 00:00:00" and one(spark, temporal.earliest_text_date, "none") is None


def test_activation_prefers_a_strong_near_fact(spark):
    rows = [(0.72, 0.02), (0.71, 0.01), (0.70, 0.01), (0.69, 0.01), (0.64, 0.95), (0.25, 1.0)]
    got = spark.createDataFrame(rows, "c double, s double").select("c", scoring.activation(F.col("c"), F.col("s")).alias("a")).collect()
    order = [r.c for r in sorted(got, key=lambda r: -r.a)]
    assert 0.64 in order[:4] and order[-1] == 0.25


def test_budget_and_decay(spark):
    b = spark.range(1).select(*[c.alias(k) for k, c in scoring.budget(F.lit(400)).items()]).first()
    assert b.pressure == 1.6 and b.decay_accel == 2.0 and b.status == "over" and b.merge_sim == 0.5 and b.semantic_fade == 0.4
    half = spark.range(1).select(scoring.half_life(F.lit("episodic"), F.lit(1.0), F.lit(0.0), F.lit(1.0)), scoring.half_life(F.lit("semantic"), F.lit(0.0), F.lit(1.0), F.lit(1.0))).first()
    assert half[0] == 365 and half[1] == pytest.approx(288)
    assert [one(spark, scoring.promotion_threshold, x, "double") for x in (0.0, 0.25, 0.5, 1.0)] == [3, 3, 2, 1]


def test_vectors(spark):
    v = spark.createDataFrame([(k, [float(k == j) for j in range(5)]) for k in range(3)] + [(9, [0.0] * 5)], "vec_id long, embedding array<float>")
    assert v.select(vector.norm(F.col("embedding")).alias("n")).agg(F.sum("n")).first()[0] == 3
    assert v.filter("vec_id = 9").select(vector.unit(F.col("embedding"))).first()[0] == [0.0] * 5
    assert [r.vec_id for r in vector.top_k(v, [0, 1, 0, 0, 0], 2).collect()] == [1, 0]
    for blocks in (1, 3):
        got = sorted((r.vec_id, r["rank"], r.neighbour_id) for r in vector.knn_pairs(v, 2, blocks=blocks).collect())
        assert got == [(0, 1, 1), (0, 2, 2), (1, 1, 0), (1, 2, 2), (2, 1, 0), (2, 2, 1), (9, 1, 0), (9, 2, 1)]
    assert vector.projection_3d(v.limit(3)).count() == 0 and vector.projection_3d(v).count() == 4


def test_people(spark):
    facts = spark.createDataFrame(
        [("a", "Ann Lee (alee@x.org) reported it"), ("b", "We met with Bob Jones, Carol White and Dan Brown."), ("c", "Bob Jones is here; see issue #123"), ("d", "The Current works"), ("e", "about Carol White again"), ("f", None)], "signature string, fact string"
    )
    got = {(r.signature, r.sig, r.form) for r in entities.extracted(facts).collect()}
    assert {("a", "person:ann-lee", "ann lee"), ("a", "person:ann-lee", "alee"), ("b", "person:bob-jones", "bob jones"), ("b", "person:carol-white", "carol white"), ("b", "person:dan-brown", "dan brown"), ("c", "ref:123", "123")} <= got
    assert not any("current" in s for _, s, _ in got)
    none = spark.createDataFrame([], "signature string, sig string")
    hubs = {r.sig: r for r in entities.new_hubs(facts, none.select("signature"), none.select("sig")).collect()}
    assert set(hubs) == {"person:ann-lee", "person:bob-jones", "person:carol-white", "ref:123"}
    known = spark.createDataFrame([("person:bob-jones", "person:carol-white")], "signature string, sig string")
    assert {r.sig for r in entities.new_hubs(facts, known.select("signature"), known.select("sig")).collect()} == {"person:ann-lee", "ref:123"}


def test_rendered_memories(spark):
    g = spark.createDataFrame([("g", "All is well", "recurring")], "signature string, fact string, temporal_form string")
    spans = spark.createDataFrame([("g", date(2024, 1, 1), date(2024, 2, 1), 3)], "signature string, first_day date, last_day date, n long")
    marks = spark.createDataFrame([("g", "current", 0, "x" * 200), ("g", "before", 0, "old")], "signature string, role string, ordinal int, fact string")
    none = spark.createDataFrame([], "signature string, resolution string, period_start date, period_end date")
    lines = rendering.semantic(g, spans, marks, none).first().text.split("\n")
    assert lines[0].startswith("[semantic memory, recurring]") and lines[1:3] == ["All is well", "before: old"] and len(lines[3]) == 9 + 96 and lines[4] == "evidence: 3 from 2024-01-01 to 2024-02-01"
    assert one(spark, rendering.is_rendered, lines[0]) and not one(spark, rendering.is_rendered, "a [semantic memory") and not one(spark, rendering.is_rendered, None)


def test_tuning(tmp_path):
    assert Tuning.resolve({}, {}) == Tuning(250, 500, 2500, 1.0, True, True)
    assert Tuning.resolve({"capacity": "Compact ", "retention": "prune", "forgetting": "slow"}, {"MEMORY_ENTRY_MAX": "7", "MEMORY_TIER2_MAX": "many", "MEMORY_TIERED": "yes"}) == Tuning(150, 7, 1500, 2.0, True, True)
    with pytest.raises(ValueError):
        Tuning.resolve({"capacity": "huge"})
    path = str(tmp_path / "knobs.json")
    assert read_knobs(path) == {} and save_knob(path, "capacity", "EXPANSIVE") == {"capacity": "expansive"} and read_knobs(path) == {"capacity": "expansive"}
    with pytest.raises(ValueError):
        save_knob(path, "colour", "red")
    assert number(" ", 3) == 3 and number("4", 3) == 4 and boolean("on", False) and not boolean("0", True) and boolean(None, True)


def test_plugins(spark):
    assert plugins.language() is plugins.English and plugins.language("english").id == "english"
    with pytest.raises(ValueError):
        plugins.register_language(type("Half", (), {"id": "half"}))
    with pytest.raises(ValueError):
        plugins.language("klingon")
    df = plugins.embedded(spark.createDataFrame([("red apple",), ("red apples",), (None,)], "fact string"), plugins.HashingEmbedder(64))
    a, b, c = (r.embedding for r in df.collect())
    assert sum(x * x for x in a) == pytest.approx(1, abs=1e-5) and sum(x * y for x, y in zip(a, b)) > 0 and set(c) == {0.0}


def test_many_terms_in_one_pass(spark, monkeypatch):
    from engramix.operators import lexical

    docs = spark.createDataFrame([(1, "aba bab"), (2, ""), (3, None), (1, "aba bab"), (4, "xyz")], "doc_id long, low string")
    asked = spark.createDataFrame([("q1", ["ab", "bab", "zz"]), ("q2", ["ab"]), ("q3", [])], "item string, terms array<string>")
    want = [(1, "q1", 4), (1, "q2", 2)]
    assert sorted(map(tuple, lexical.term_pairs(docs, asked, "doc_id", "item").collect())) == want
    assert lexical.term_pairs(docs, asked.limit(0), "doc_id", "item").collect() == []
