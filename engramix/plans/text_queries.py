"""Text and scalar functions over whole tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions import scoring, temporal, text
from ..operators import lexical
from .registry import query, table

_Q = ", ".join(f"'{w}'" for w in text.QUERY_STOPWORDS)
_S = ", ".join(f"'{w}'" for w in text.SIGNATURE_STOPWORDS)
_NORM = "trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"
_MATCH = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '^\s*\[[^\]]+\]\s*', ' '), '\b20[0-9]{{2}}[-/][0-9]{{1,2}}[-/][0-9]{{1,2}}\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"
_TERMS = "list_filter(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9][a-z0-9-]{{2,}}'), lambda t: t NOT IN (" + _Q + "))"
NORM, MATCH = _NORM, _MATCH


def distinct_in_order(sql: str) -> str:
    return f"list_filter({sql}, lambda t, i: list_position({sql}, t) = i)"


CONTENT = "list_distinct(list_filter(string_split(" + _NORM + ", ' '), lambda w: length(w) > 4 AND w NOT IN (" + _S + ")))"


@query("normalize_slug", f"SELECT doc_id, md5(n) AS normal, substr(replace(n, ' ', '-'), 1, 48) AS slug, substr(CASE WHEN len(w) = 0 THEN 'fact' ELSE array_to_string(w[1:5], '-') END, 1, 48) AS signature FROM (SELECT doc_id, {_NORM.format('text')} AS n, list_filter(string_split({_NORM.format('text')}, ' '), lambda x: x NOT IN ({_S}) AND length(x) > 2) AS w FROM documents)")
def normalize_slug(spark, sf_dir):
    """SC1-SC3: normal form, slug and signature of every document."""
    d, n = table(spark, sf_dir, "documents").select("doc_id", text.normalize(F.col("text")).alias("n")), F.col("n")
    return d.select("doc_id", F.md5(n).alias("normal"), text.slug_of(n).alias("slug"), text.signature_of(n).alias("signature"))


@query("normalize_for_match", f"SELECT doc_id, md5({_MATCH.format('text')}) AS matched, len(regexp_extract_all(lower(text), '[a-z0-9]+'))::BIGINT AS tokens FROM documents")
def normalize_for_match(spark, sf_dir):
    """SC4, SC5, SC9: the form in which statements are compared, and the number of tokens."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize_for_match(F.col("text"))).alias("matched"), F.size(text.tokenize(F.col("text"))).cast("long").alias("tokens"))


@query("significant_terms", f"WITH t AS (SELECT doc_id, unnest(x) AS w, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, {_TERMS.format('text')} AS x FROM documents)), f AS (SELECT doc_id, w, min(i) AS i FROM t GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM f), s AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS terms FROM r WHERE k <= 10 GROUP BY doc_id) SELECT doc_id, coalesce(terms, '') AS terms FROM documents LEFT JOIN s USING (doc_id)")
def significant_terms(spark, sf_dir):
    """SC6: the first ten distinct terms of every document."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.significant_terms(F.col("text")), " ").alias("terms"))


_ITEM = f"SELECT item_id, ({distinct_in_order(_TERMS.format('text'))})[1:10] AS terms FROM benchmark"
_EIGHT = _ITEM.replace("[1:10]", "[1:8]")


@query("lexical_hits", f"WITH q AS ({_ITEM}), hits AS (SELECT doc_id, item_id, len(list_filter(terms, lambda t: contains(lower(text), t)))::BIGINT AS hits, len(terms)::BIGINT AS terms FROM documents, q) SELECT doc_id, item_id, hits FROM hits WHERE terms >= 2 AND hits >= greatest(2, ceil(0.4 * terms))")
def lexical_hits(spark, sf_dir):
    """FLT6, RC2: documents that hold enough of a question's terms."""
    asked = table(spark, sf_dir, "benchmark").select("item_id", text.significant_terms(F.col("text")).alias("terms"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("low"))
    hits = lexical.term_pairs(docs, asked, "doc_id", "item_id").join(asked.select("item_id", F.size("terms").alias("n")), "item_id")
    return hits.filter((F.col("n") >= 2) & (F.col("hits") >= F.greatest(F.lit(2), F.ceil(0.4 * F.col("n"))))).select("doc_id", "item_id", "hits")


@query("phrase_hits", f"WITH q AS ({_EIGHT}), p AS (SELECT item_id, list_transform(generate_series(1, len(terms) - 1), lambda i: terms[i] || ' ' || terms[i + 1]) || list_transform(generate_series(1, len(terms) - 2), lambda i: terms[i] || ' ' || terms[i + 1] || ' ' || terms[i + 2]) AS phrases FROM q), h AS (SELECT doc_id, item_id, len(list_filter(phrases, lambda x: contains(m, ' ' || x || ' ')))::BIGINT AS hits FROM (SELECT doc_id, ' ' || {_MATCH.format('text')} || ' ' AS m FROM documents), p) SELECT * FROM h WHERE hits > 0")
def phrase_hits(spark, sf_dir):
    """SC7, SC8: whole phrases of two and three terms that a document shares with a question."""
    sought = text.phrases(text.significant_terms(F.col("text"), 8))
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.transform(sought, lambda p: F.concat(F.lit(" "), p, F.lit(" "))).alias("terms"))
    docs = table(spark, sf_dir, "documents").select("doc_id", text.padded(F.col("text")).alias("low"))
    return lexical.term_pairs(docs, asked, "doc_id", "item_id")


_PAIRS = f"WITH w AS (SELECT conv_id, turn, {CONTENT.format('text')} AS c, {NORM.format('text')} AS n FROM conversations), p AS (SELECT a.conv_id, a.turn, a.c AS x, b.c AS y FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"


def _turns(spark, sf_dir):
    w = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.content_words(F.col("text")).alias("c"))
    after = w.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("c").alias("y"))
    return w.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.col("c").alias("x"), "y")


@query("content_overlap", _PAIRS + " SELECT conv_id, turn, round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE len(list_intersect(x, y))::DOUBLE / (len(x) + len(y) - len(list_intersect(x, y))) END, 6) AS jaccard, round(len(list_intersect(x, y))::DOUBLE / greatest(1, least(len(x), len(y))), 6) AS containment FROM p")
def content_overlap(spark, sf_dir):
    """SC10-SC12: content words shared by a turn and the next."""
    return _turns(spark, sf_dir).select("conv_id", "turn", F.round(text.jaccard(F.col("x"), F.col("y")), 6).alias("jaccard"), F.round(text.containment(F.col("x"), F.col("y")), 6).alias("containment"))


@query("topic_gate", f"WITH w AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) > 4 AND t NOT IN ({_Q}))) AS c FROM conversations) SELECT a.conv_id, a.turn, len(list_intersect(a.c, b.c)) >= 2 AS same_topic FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def topic_gate(spark, sf_dir):
    """FLT7: whether a turn keeps to the topic of the one before."""
    w = table(spark, sf_dir, "conversations")
    after = w.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    return w.join(after, ["conv_id", "turn"]).select("conv_id", "turn", text.shares_topic(F.col("text"), F.col("next")).alias("same_topic"))


_CUES = {"enumerative": text.ENUMERATIVE, "specific": text.SPECIFIC, "historical": text.HISTORICAL, "correction": text.CORRECTION}


@query("query_shape_flags", "SELECT conv_id, turn, " + ", ".join(f"regexp_matches(text, '{p}') AS {n}" for n, p in _CUES.items()) + " FROM conversations")
def query_shape_flags(spark, sf_dir):
    """SC37: what a text asks for, and whether it corrects something."""
    c = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.is_enumerative(c).alias("enumerative"), text.wants_specifics(c).alias("specific"), text.is_historical(c).alias("historical"), text.is_correction(c).alias("correction"))


_SPELL = "replace(replace(replace(replace(regexp_replace(lower(t), '\\s+', '', 'g'), 'million', 'm'), 'billion', 'b'), 'thousand', 'k'), '–', '-')"


@query("hard_specifics", "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform(" + " || ".join(f"regexp_extract_all(x, '{p}')" for p in text._SPECIFICS) + f", lambda t: {_SPELL}))), '|') AS specifics FROM (SELECT p_partkey, p_name || ' $' || CAST(p_size AS VARCHAR) || ' million, ' || CAST(p_size AS VARCHAR) || '% of ' || CAST(p_size AS VARCHAR) || ' Units or 3 x' AS x FROM part)")
def hard_specifics(spark, sf_dir):
    """SC36: amounts, shares, multiples and counts in one spelling."""
    size = F.col("p_size").cast("string")
    x = F.concat("p_name", F.lit(" $"), size, F.lit(" million, "), size, F.lit("% of "), size, F.lit(" Units or 3 x"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.hard_specifics(x), "|").alias("specifics"))


@query("scope_and_wrappers", "SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(regexp_extract('[' || p_brand || '] ' || p_name, '^\\s*\\[([^\\]]{1,40})\\]', 1)), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) AS scope, p_name AS bare, p_type AS unwrapped FROM (SELECT p_partkey, p_brand, trim(p_name) AS p_name, trim(p_type) AS p_type FROM part)")
def scope_and_wrappers(spark, sf_dir):
    """SC13, SC14, SC39: the leading scope, and texts without age prefix or outside tags."""
    p = table(spark, sf_dir, "part")
    scoped = F.concat(F.lit("["), "p_brand", F.lit("] "), F.trim("p_name"))
    return p.select("p_partkey", text.scope_of(scoped).alias("scope"), text.strip_age(scoped).alias("bare"), text.strip_wrapper(F.concat(F.lit("<untrusted_memory> "), "p_type", F.lit("</untrusted_memory>"))).alias("unwrapped"))


@query("signature_parts", "SELECT DISTINCT source, 'source' AS kind, replace(source, '-', ' ') AS label, replace(source, '-', ' ') || ' (source)' AS human, 'mentioned in this' AS relation FROM documents")
def signature_parts(spark, sf_dir):
    """SC15, SC16, SC20: type and label of a hub's signature, and how it reads."""
    sig = F.concat(F.lit("source:"), "source")
    return table(spark, sf_dir, "documents").select("source").distinct().select("source", text.type_of(sig).alias("kind"), text.label_of(sig).alias("label"), text.humanize(sig).alias("human"), F.concat(text.humanize_relation(F.lit("mentioned_in")), F.lit(" this")).alias("relation"))


_DAY = "DATE '2024-02-01'"


@query("age_bands", f"SELECT event_id, greatest(0, date_diff('microsecond', ts, TIMESTAMP '2024-06-01') // 86400000000)::BIGINT AS days, CASE WHEN d <= 2 THEN 'just now' WHEN d <= 7 THEN 'this week' WHEN d <= 21 THEN 'past couple weeks' WHEN d <= 45 THEN 'last month or so' WHEN d <= 90 THEN 'a couple months ago' WHEN d <= 150 THEN 'earlier this period' ELSE 'long ago' END AS age FROM (SELECT *, greatest(0, date_diff('microsecond', ts, TIMESTAMP '2024-06-01') // 86400000000) AS d FROM events)")
def age_bands(spark, sf_dir):
    """SC23, SC24: whole days since an event, and the band they fall in."""
    d = temporal.age_days(F.col("ts"), F.lit("2024-06-01").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", d.alias("days"), temporal.age_tag(d).alias("age"))


@query("text_dates", "SELECT event_id, CAST(date_trunc('second', ts) AS TIMESTAMP) AS found FROM events")
def text_dates(spark, sf_dir):
    """SC22: the earliest date spelled out in a text; here each event's own time among later ones."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    x = F.concat(F.lit("moved to 2031-05-06 from "), stamp, F.lit(" (not 1999-01-01, v2024-13-01)"))
    return table(spark, sf_dir, "events").select("event_id", temporal.earliest_text_date(x).cast("timestamp_ntz").alias("found"))


@query("calendar_bounds", " UNION ALL ".join(f"SELECT o_orderkey, '{r}' AS resolution, CAST(date_trunc('{r}', d) AS DATE) AS period_start, CAST(date_trunc('{r}', d) + INTERVAL {step} - INTERVAL 1 DAY AS DATE) AS period_end FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)" for r, step in (("day", "1 DAY"), ("week", "7 DAY"), ("month", "1 MONTH"), ("quarter", "3 MONTH"), ("year", "1 YEAR"))))
def calendar_bounds(spark, sf_dir):
    """SC25, SC26: the day, week, month, quarter and year of every order."""
    own = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"), F.explode(F.array(*map(F.lit, temporal.RESOLUTIONS))).alias("resolution"))
    return own.select("o_orderkey", "resolution", temporal.period_start(F.col("resolution"), F.col("d")).alias("period_start"), temporal.period_end(F.col("resolution"), F.col("d")).alias("period_end"))


def _budget_sql(n: str) -> str:
    p, e = f"({n} / 250.0::DOUBLE)", f"greatest(0.0, {n} / 250.0::DOUBLE - 0.6)"
    return f"round({p}, 3) AS pressure, round(least(0.45, 0.15 + {e} * 0.35), 3) AS forget_threshold, round(1 + greatest(0.0, {p} - 1) + {e} * 0.4, 3) AS decay_accel, round(greatest(0.5, 0.62 - {e} * 0.18), 3) AS merge_sim, round(CASE WHEN {p} >= 1 THEN least(0.4, 0.25 + ({p} - 1) * 0.25) ELSE 0.0 END, 3) AS semantic_fade, CASE WHEN {n} >= 500 THEN 'critical' WHEN {n} > 250 THEN 'over' WHEN {p} >= 0.8 THEN 'elevated' ELSE 'ok' END AS status"


@query("budget_table", f"SELECT s_suppkey, n, {_budget_sql('n')} FROM (SELECT l_suppkey AS s_suppkey, count(*) AS n FROM lineitem GROUP BY 1)")
def budget_table(spark, sf_dir):
    """SC30, AG12: pressure and thresholds for stores of as many facts as a supplier has items."""
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"))
    return n.select("s_suppkey", "n", *[c.alias(k) for k, c in scoring.budget(F.col("n")).items()])


@query("decay_strength", "SELECT event_id, round(greatest(0, least(1, value / 100 * pow(2, -greatest(0, date_diff('microsecond', ts, TIMESTAMP '2024-02-01') / 86400000000.0::DOUBLE) / h))), 6) AS strength FROM (SELECT *, (b + s * (365 - b)) * (1 + 0.6 * f) / 1.2 AS h FROM (SELECT *, CASE WHEN event_type IN ('click', 'view') THEN 3.0::DOUBLE ELSE 180.0::DOUBLE END AS b, greatest(0.0, least(1.0, value / 200)) AS s, (user_id % 7) / 6.0::DOUBLE AS f FROM events))")
def decay_strength(spark, sf_dir):
    """SC31, DR1: strength after decay, by class, salience and schema fit."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type").isin("click", "view"), "episodic").otherwise("semantic")
    half = scoring.half_life(kind, F.col("value") / 200, (F.col("user_id") % 7) / 6.0, 1.2)
    return e.select("event_id", F.round(scoring.decayed(F.col("value") / 100, F.col("ts"), F.lit("2024-02-01").cast("timestamp"), half), 6).alias("strength"))


@query("edge_decay", "SELECT l_orderkey, l_linenumber, rel, round(greatest(0, least(1, (1 - l_discount) * CASE rel WHEN 'mentions' THEN 1.0 WHEN 'related_to' THEN 0.985 WHEN 'similar_to' THEN 0.97 ELSE 0.99 END)), 6) AS weight FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN 'mentions' WHEN 'N' THEN 'related_to' WHEN 'R' THEN CASE WHEN l_linestatus = 'F' THEN 'similar_to' ELSE 'next_period' END END AS rel FROM lineitem)")
def edge_decay(spark, sf_dir):
    """SC34, DR2: weights of edges after a night."""
    rel = F.when(F.col("l_returnflag") == "A", "mentions").when(F.col("l_returnflag") == "N", "related_to").when(F.col("l_linestatus") == "F", "similar_to").otherwise("next_period")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", rel.alias("rel"), F.round(scoring.clamp01((1 - F.col("l_discount")) * scoring.edge_decay(rel)), 6).alias("weight"))


@query("reactivation_effect", "SELECT l_orderkey, l_linenumber, greatest(1, floor(3 - 2 * f + 0.5))::BIGINT AS needed, round(0.10 * (1 + 0.5 * f) * least(1.5, 1 + 0.15 * (l_quantity - 1)), 6) AS boost, round(greatest(0, least(1, CASE WHEN l_tax > 0.04 THEN 0.5 + 0.5 * l_tax * 10 / greatest(l_quantity, 1) ELSE 0.5 * l_discount * log2(1 + l_quantity) END)), 6) AS vagueness FROM (SELECT *, least(1.0, l_linenumber / 6.0::DOUBLE) AS f FROM lineitem)")
def reactivation_effect(spark, sf_dir):
    """SC32, SC33, SC35: how often a fact must return, what a return is worth, and how vague a summary is."""
    fit = scoring.schema_fit(F.col("l_linenumber"))
    dropped = F.when(F.col("l_tax") > 0.04, F.col("l_tax") * 10).otherwise(0.0)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scoring.promotion_threshold(fit).alias("needed"), F.round(scoring.reactivation_boost(fit, F.col("l_quantity")), 6).alias("boost"), F.round(scoring.vagueness(dropped, F.col("l_quantity"), F.col("l_discount"), F.col("l_quantity")), 6).alias("vagueness"))


@query("entry_scores", f"WITH q AS (SELECT ({distinct_in_order(_TERMS.format('text'))})[1:10] AS terms, item_id FROM benchmark), s AS (SELECT turn, conv_id, item_id, list_sum(list_transform(terms, lambda t: CASE WHEN contains(lower(text), t) THEN CASE WHEN contains(t, '-') THEN 6.0 WHEN length(t) >= 7 THEN 1.5 ELSE 1.0 END ELSE 0.0 END))::DOUBLE AS score FROM conversations, q) SELECT conv_id, turn, item_id, score, round(0.45 + least(0.35, 0.03 * score), 6) AS similarity FROM s WHERE score >= 3")
def entry_scores(spark, sf_dir):
    """SC42: lexical scores of calendar entries, and the cosine they stand for."""
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.explode(text.significant_terms(F.col("text"))).alias("t"))
    said = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("entry"), F.lower("text").alias("low"))
    seen = lexical.matches(said, asked.select("t").distinct(), "entry").join(asked, "t")
    s = seen.groupBy("entry", "item_id").agg(F.sum(text.term_weight(F.col("t"))).alias("score")).filter("score >= 3")
    return s.select("entry.conv_id", "entry.turn", "item_id", "score", F.round(text.entry_similarity(F.col("score")), 6).alias("similarity"))


@query("categorize_texts", r"SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i)\b(decid(?:ed|es|ing|e)|decision|agreed|approved|chose|committed to|will (?:use|adopt|go with))\b') THEN 'decision' ELSE 'fact' END AS category FROM conversations")
def categorize_texts(spark, sf_dir):
    """SRC10: decisions among plain facts."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.categorize(F.col("text")).alias("category"))


#: What each question's window is on 2024-01-30, by hand.
_RANGES = {"what happened last week": ("d - 7", "d"), "in late June": ("DATE '2024-06-21'", "DATE '2024-06-30'"), "June 24-29": ("DATE '2024-06-24'", "DATE '2024-06-29'"), "on 2/27": ("DATE '2024-02-27'", "DATE '2024-02-27'"), "2024-01-05 to now": ("DATE '2024-01-05'", "DATE '2024-01-05'"), "recently": ("d - 10", "d"), "in the past 3 days": ("d - 3", "d"), "this quarter": ("d - 92", "d"), "yesterday": ("d - 1", "d - 1")}


@query("asked_windows", "SELECT q, event_id FROM events JOIN (" + " UNION ALL ".join(f"SELECT '{q}' AS q, {lo} AS lo, {hi} AS hi FROM (SELECT DATE '2024-01-30' AS d)" for q, (lo, hi) in _RANGES.items()) + ") w ON CAST(ts AS DATE) BETWEEN lo AND hi")
def asked_windows(spark, sf_dir):
    """SC21, FLT5: events in the windows that questions name, joined by day."""
    days = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("date").alias("day"))
    named = spark.createDataFrame([(q, *temporal.parse_date_range(q, date(2024, 1, 30))) for q in _RANGES], "q string, lo date, hi date")
    named = named.select("q", F.explode(F.sequence("lo", "hi")).alias("day"))
    return days.join(F.broadcast(named), "day").select("q", "event_id")


@query("age_resolution", "SELECT o_orderkey, CASE WHEN d <= 14 THEN 'day' WHEN d <= 90 THEN 'week' WHEN d <= 730 THEN 'month' WHEN d <= 1460 THEN 'quarter' ELSE 'year' END AS resolution FROM (SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-02') AS d FROM orders)")
def age_resolution(spark, sf_dir):
    """WN11: the calendar resolution at which a projection shows something of that age."""
    d = F.datediff(F.lit("2001-08-02").cast("date"), F.col("o_orderdate").cast("date"))
    return table(spark, sf_dir, "orders").select("o_orderkey", temporal.resolution_for_age(d).alias("resolution"))
