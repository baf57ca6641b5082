"""People and references in texts: what the words' positions propose, never what they prove.

Every family of patterns is a regular expression of the JVM's; names in a list are taken out
of the whole list's match by a second one. No row leaves the generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .text import FUNCTION_WORDS, normalize, slug

_CAPITAL = "[A-Z][a-z]+"
_NAME = rf"{_CAPITAL}\s+{_CAPITAL}"
_VERBS = "acting|are|confirmed|contributes|coordinates|coordinating|drives|driving|drove|focus|focuses|is|joining|joins|leads|participating|posting|removed|reported|reports|requested|sends|shared|submitted|supporting|was|works"
_BEFORE = "alongside|and|between|by|cc|from|including|involving|join|owners?|reviewers?|welcome|with"
_FAMILIES = (
    rf"\b({_NAME})\s+(?:{_VERBS})\b",
    rf"\b(?:{_BEFORE})\s+((?:{_NAME})(?:\s*(?:,\s*and|,|and)\s*{_NAME})*)",
    rf"({_NAME}(?:(?:\s*,\s*and\s+|\s*,\s*|\s+and\s+){_NAME})+)",
)
_MAIL = rf"({_NAME}\s*[(<][a-z0-9._-]+)@"


def _is_name(name: Column) -> Column:
    parts = F.split(name, r"\s+")
    ok = lambda w: (F.length(w) >= 2) & ~F.lower(w).isin(*FUNCTION_WORDS)
    return ok(parts[0]) & ok(parts[1])


def people(c: Column) -> Column:
    """array<struct<sig, form, mail>>: names in the position of a person, in list order; mail is the local part bound to the name."""
    c = F.coalesce(c, F.lit(""))
    found = F.flatten(F.transform(F.concat(*[F.regexp_extract_all(c, F.lit(p), F.lit(1)) for p in _FAMILIES]), lambda m: F.regexp_extract_all(m, F.lit(f"({_NAME})"), F.lit(1))))
    bound = F.transform(F.regexp_extract_all(c, F.lit(_MAIL), F.lit(1)), lambda m: F.struct(F.regexp_extract(m, f"({_NAME})", 1).alias("name"), F.lower(F.regexp_extract(m, r"[(<]([a-z0-9._-]+)$", 1)).alias("mail")))
    plain = F.transform(F.array_distinct(found), lambda n: F.struct(n.alias("name"), F.lit(None).cast("string").alias("mail")))
    named = F.filter(F.concat(bound, plain), lambda x: _is_name(x["name"]))
    return F.array_distinct(F.transform(named, lambda x: F.struct(F.concat(F.lit("person:"), slug(x["name"])).alias("sig"), normalize(x["name"]).alias("form"), x["mail"].alias("mail"))))


def references(c: Column) -> Column:
    """array<string>: ref:<number> of issues, tickets, bugs, requests and #numbers."""
    c = F.coalesce(c, F.lit(""))
    n = F.concat(F.regexp_extract_all(c, F.lit(r"(?:issue|ticket|bug|pr)\s*#?(\d{2,})"), F.lit(1)), F.regexp_extract_all(c, F.lit(r"#(\d{2,})"), F.lit(1)))
    return F.array_distinct(F.transform(n, lambda x: F.concat(F.lit("ref:"), x)))


def extracted(facts: DataFrame) -> DataFrame:
    """(signature, sig, type, form, strong) of every entity that a fact (signature, fact) proposes."""
    p = facts.select("signature", F.explode(people(F.col("fact"))).alias("e")).select("signature", "e.sig", F.lit("person").alias("type"), F.explode(F.filter(F.array("e.form", "e.mail"), lambda f: F.length(f) >= 3)).alias("form"), F.col("e.mail").isNotNull().alias("strong"))
    r = facts.select("signature", F.explode(references(F.col("fact"))).alias("sig")).select("signature", "sig", F.lit("ref").alias("type"), F.substring("sig", 5, 48).alias("form"), F.lit(False).alias("strong"))
    return p.unionByName(r)


def case_counts(facts: DataFrame) -> DataFrame:
    """(word, lower, upper): how often the corpus writes a word of three letters or more with a small and with a capital first letter."""
    w = facts.select(F.explode(F.regexp_extract_all("fact", F.lit("[A-Za-z][a-z]{2,}"), F.lit(0))).alias("w"))
    up = F.col("w").rlike("^[A-Z]")
    return w.groupBy(F.lower("w").alias("word")).agg(F.count(F.when(~up, 1)).alias("lower"), F.count(F.when(up, 1)).alias("upper"))


def new_hubs(facts: DataFrame, known: DataFrame, gone: DataFrame, least: int = 2) -> DataFrame:
    """(sig, type, forms, facts): entities worth a hub, from the whole corpus: bound to a mail address, a reference, or proposed by position and met in ``least`` facts.

    Further mentions of a proposed name count if the corpus writes neither of its words small
    at least as often as with a capital. Known hubs and ones judged away are left out.
    """
    e = extracted(facts)
    pair = rf"\b({_NAME})\b"
    wide = facts.select("signature", F.explode(F.regexp_extract_all("fact", F.lit(pair), F.lit(1))).alias("n")).filter(_is_name(F.col("n")))
    common = case_counts(facts).filter(F.col("lower") >= F.greatest(F.lit(1), F.col("upper"))).select("word")
    parts = wide.withColumn("a", F.lower(F.split("n", r"\s+")[0])).withColumn("b", F.lower(F.split("n", r"\s+")[1]))
    names = parts.join(common.withColumnRenamed("word", "a"), "a", "left_anti").join(common.withColumnRenamed("word", "b"), "b", "left_anti")
    more = names.select("signature", F.concat(F.lit("person:"), slug(F.col("n"))).alias("sig"), F.lit("person").alias("type"), normalize(F.col("n")).alias("form"), F.lit(False).alias("strong"))
    more = more.join(e.filter("type = 'person'").select("sig").distinct(), "sig", "left_semi")
    g = e.unionByName(more).groupBy("sig", "type").agg(F.countDistinct("signature").alias("facts"), F.max("strong").alias("strong"), F.array_sort(F.collect_set("form")).alias("forms"))
    kept = g.filter((F.col("facts") >= least) | F.col("strong") | (F.col("type") == "ref"))
    return kept.join(known.select(F.col("signature").alias("sig")), "sig", "left_anti").join(gone.select("sig"), "sig", "left_anti").select("sig", "type", "forms", "facts")
