"""Text functions as Column expressions: everything stays in the JVM's generated code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Words that carry no meaning in a question.
QUERY_STOPWORDS = tuple(sorted("""
you your yesterday working works work would with will why whose whom who which where when what weekly were we was us
updates updated update under tomorrow today to this they them then their the that than status should reminders reminder
over our or on of notes note not no my most more monthly me kept keeps keeping keep its it is into in i how have has had
from for does do did daily could by be at as are and an about a
""".split()))
#: The smaller list for signatures and content words.
SIGNATURE_STOPWORDS = tuple(sorted("with were was to this the that or on of not no its it is into in from for by be at as are and an a".split()))
#: Function words that are never part of a name.
FUNCTION_WORDS = tuple(sorted("your you's those these they their she our my i her his he we its it that this be are were was is as by at on in of to for from with but or and an a the".replace("your you's ", "").split()))
MONTHS = {m: k for k, names in enumerate((("jan", "january"), ("feb", "february"), ("mar", "march"), ("apr", "april"), ("may",), ("jun", "june"), ("jul", "july"), ("aug", "august"), ("sep", "sept", "september"), ("oct", "october"), ("nov", "november"), ("dec", "december")), 1) for m in names}
TEMPORAL_WORDS = tuple(sorted({*MONTHS, *"timeline summary records record happened events event incidents incident changes changed change updates update".split()}))


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _lower(c: Column) -> Column:
    """Lower case by single characters, as DuckDB's: İ becomes i without the dot that Java sets apart."""
    return F.lower(F.replace(_text(c), F.lit("\u0130"), F.lit("i")))


def _list(words: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, words))


def normalize(c: Column) -> Column:
    """Lower case; everything but a-z and 0-9 becomes one blank; trimmed."""
    return F.trim(F.regexp_replace(_lower(c), "[^a-z0-9]+", " "))


def slug_of(normal: Column) -> Column:
    """The slug of a normalized text."""
    return F.replace(F.substring(normal, 1, 48), F.lit(" "), F.lit("-"))


def slug(c: Column) -> Column:
    return slug_of(normalize(c))


def words(c: Column) -> Column:
    """The words of a normalized text."""
    return F.filter(F.split(_lower(c), "[^a-z0-9]+"), lambda w: w != "")


def signature_of(normal: Column) -> Column:
    """The first five meaningful words of a normalized text, joined; "fact" if there is none. All words are looked at only if the first 48 don't hold five."""

    def own(t: Column) -> Column:
        return F.slice(F.filter(F.split(t, " "), lambda w: (F.length(w) > 2) & ~w.isin(*SIGNATURE_STOPWORDS)), 1, 5)

    def named(found: Column) -> Column:
        return F.substring(F.when(F.size(found) == 0, F.lit("fact")).otherwise(F.array_join(found, "-")), 1, 48)

    first = own(F.substring_index(normal, " ", 48))
    return F.when(F.size(first) == 5, named(first)).otherwise(named(own(normal)))


def derive_slug(c: Column) -> Column:
    """The first five meaningful words of a fact, joined; "fact" if there is none."""
    return F.transform(F.array(normalize(c)), signature_of)[0]


#: A scope in brackets at the start.
_LEAD = r"^[\t\n\f\r ]*" + r"\[[^\]]+\]" + r"[\t\n\f\r ]*"


def normalize_for_match(c: Column) -> Column:
    """For comparing statements: without a leading [scope], dates of this century and punctuation."""
    bare = F.regexp_replace(_lower(c), _LEAD, " ")
    bare = F.regexp_replace(bare, r"(?<![0-9A-Za-z_])20[0-9]{2}[-/][0-9]{1,2}[-/][0-9]{1,2}(?![0-9A-Za-z_])", " ")
    return F.trim(F.regexp_replace(bare, "[^a-z0-9]+", " "))


def tokenize(c: Column) -> Column:
    return F.regexp_extract_all(_lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def significant_terms(c: Column, limit: int = 10) -> Column:
    """The first distinct terms of three characters or more that aren't stop words."""
    found = F.regexp_extract_all(_lower(c), F.lit("[a-z0-9][a-z0-9-]{2,}"), F.lit(0))
    return F.slice(F.array_distinct(F.array_except(found, _list(QUERY_STOPWORDS))), 1, limit)


def phrases(terms: Column) -> Column:
    """Neighbouring terms in twos, then in threes."""

    def runs(n: int) -> Column:
        last = F.size(terms) - n + 1
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(terms, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return F.concat(runs(2), runs(3))


def term_hits(c: Column, terms: Column | list[str], lowered: bool = False) -> Column:
    """How many of the terms occur anywhere in the text, whatever the case."""
    low = c if lowered else F.lower(_text(c))
    if isinstance(terms, list):
        return sum((low.contains(t).cast("long") for t in terms), F.lit(0).cast("long"))
    return F.size(F.filter(terms, lambda t: F.contains(low, t))).cast("long")


def padded(c: Column) -> Column:
    """A text in which whole phrases can be found by their padded form. Compute it before a join, once a text."""
    return F.concat(F.lit(" "), normalize_for_match(c), F.lit(" "))


def phrase_hits(padded_text: Column, sought: Column) -> Column:
    """How many of the phrases occur as whole words of a :func:`padded` text."""
    return F.size(F.filter(sought, lambda p: F.contains(padded_text, F.concat(F.lit(" "), p, F.lit(" "))))).cast("long")


def collapse_key(c: Column) -> Column:
    """Texts of equal key are restatements of one another."""
    return F.concat(F.lit("text:"), normalize_for_match(c))


def content_words(c: Column) -> Column:
    """Distinct words of more than four letters."""
    return F.array_distinct(F.filter(words(c), lambda w: (F.length(w) > 4) & ~w.isin(*SIGNATURE_STOPWORDS)))


def jaccard(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(shared / (F.size(a) + F.size(b) - shared))


def containment(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.least(F.size(a), F.size(b)))


def shares_topic(a: Column, b: Column, least: int = 2) -> Column:
    """Two texts belong to one topic: enough shared tokens of more than four letters."""
    long_ = lambda c: F.array_except(F.filter(tokenize(c), lambda t: F.length(t) > 4), _list(QUERY_STOPWORDS))
    return F.size(F.array_intersect(long_(a), long_(b))) >= least


def scope_of(c: Column) -> Column:
    """The normalized [scope] that leads a text, or an empty string."""
    return normalize(F.regexp_extract(_text(c), r"^\s*\[([^\]]{1,40})\]", 1))


def strip_wrapper(c: Column) -> Column:
    """Without the tags that mark text from outside."""
    return F.trim(F.regexp_replace(_text(c), "</?untrusted_memory>", ""))


def strip_age(c: Column) -> Column:
    """Without the leading [age] of a projected text."""
    return F.regexp_replace(_text(c), r"^\[[^\]]*\] ", "")


def type_of(sig: Column) -> Column:
    return F.when(sig.contains(":"), F.substring_index(sig, ":", 1)).otherwise(F.lit(""))


def label_of(sig: Column) -> Column:
    bare = F.when(sig.contains(":"), F.expr("1").cast("string")).otherwise(sig)
    bare = F.when(sig.contains(":"), F.substring(sig, F.instr(sig, ":") + F.lit(1), F.length(sig))).otherwise(bare)
    return F.replace(bare, F.lit("-"), F.lit(" "))


def forms_for(sig: Column) -> Column:
    """Surface forms of an entity: its whole label, and for numbered things their numbers."""
    label = normalize(label_of(sig))
    numbers = F.when(type_of(sig).isin("incident", "msrc", "pr", "release"), F.regexp_extract_all(label, F.lit("[0-9][0-9.]+"), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return F.filter(F.array_distinct(F.concat(F.array(label), numbers)), lambda f: F.length(f) >= 3)


def humanize(sig: Column) -> Column:
    kind = type_of(sig)
    return F.when(kind == "", label_of(sig)).otherwise(F.concat(label_of(sig), F.lit(" ("), kind, F.lit(")")))


def humanize_relation(rel: Column) -> Column:
    return F.replace(F.coalesce(F.nullif(rel, F.lit("")), F.lit("related to")), F.lit("_"), F.lit(" "))


_SPECIFICS = (
    r"(?i)\$\s?[0-9][0-9.,]*(?:\s?[-–]\s?[0-9][0-9.,]*)?\s?(?:thousand|million|billion|[kmb])?\b",
    r"\b[0-9]+(?:\.[0-9]+)?\s?%",
    r"(?i)\b[0-9]+(?:\.[0-9]+)?\s?x\b",
    r"(?i)\b[0-9]{1,4}\s+(?:accounts|basis points|bps|customers|deals|employees|headcount|hires|people|reps|roles|seats|shares|units|users)\b",
)


def hard_specifics(c: Column) -> Column:
    """Amounts, percentages, multiples and counts in one spelling, distinct and in order."""
    found = F.concat(*[F.regexp_extract_all(_text(c), F.lit(p), F.lit(0)) for p in _SPECIFICS])

    def spell(t: Column) -> Column:
        t = F.regexp_replace(F.lower(t), r"\s+", "")
        for long_, short in (("million", "m"), ("billion", "b"), ("thousand", "k"), ("–", "-")):
            t = F.replace(t, F.lit(long_), F.lit(short))
        return t

    return F.sort_array(F.array_distinct(F.transform(found, spell)))


ENUMERATIVE = r"(?i)\b(list|enumerate|all|each|every|which|name\s+the|how\s+many|who\s+were)\b"
SPECIFIC = r"(?i)\b(exact|exactly|verbatim|precise|specific|list|enumerate|which|when|how\s+many|what(?:\s+[^\s?]+){0,6}\s+date|that\s+(?:call|conversation|day|meeting|session|week)|in\s+that\s+(?:call|meeting|session))\b"
HISTORICAL = r"(?i)\b(originally|original|origin|previously|previous|initially|initial|before it|used to|as of|during|at the time|back then)\b"
CORRECTION = r"(?i)\b(no longer|rather than|instead of|now \w+ not|correct(?:s|ed|ion)?|chang(?:ing|ed|e)?|updat(?:ed|e)?|revis(?:ed|e)?|replac(?:es|ed|e)?|overrid(?:es|den|e)?|supersed(?:es|ed|e)?|push(?:ed)? (?:earlier|up|to)|moved? (?:from|earlier|up|to))\b"


def is_enumerative(c: Column) -> Column:
    return _text(c).rlike(ENUMERATIVE)


def wants_specifics(c: Column) -> Column:
    return _text(c).rlike(SPECIFIC)


def is_historical(c: Column) -> Column:
    return _text(c).rlike(HISTORICAL)


def is_correction(c: Column) -> Column:
    return _text(c).rlike(CORRECTION)


def entry_score(c: Column, terms: Column) -> Column:
    """Lexical score of a calendar entry: 6 for a composed term, 1.5 for a long one, else 1, if it occurs."""
    low = F.lower(_text(c))
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + F.when(F.contains(low, t), term_weight(t)).otherwise(0.0))


def term_weight(t: Column) -> Column:
    return F.when(t.rlike("[- ]"), 6.0).when(F.length(t) >= 7, 1.5).otherwise(1.0)


def entry_similarity(score: Column) -> Column:
    """What a lexical score of 3 or more counts as a cosine."""
    return F.when(score >= 3, 0.45 + F.least(F.lit(0.35), 0.03 * score)).otherwise(F.lit(0.0))


def categorize(c: Column) -> Column:
    """"decision" for texts that announce one, else "fact"."""
    return F.when(_text(c).rlike(r"(?i)\b(decid(?:ed|es|ing|e)|decision|agreed|approved|chose|committed to|will (?:use|adopt|go with))\b"), "decision").otherwise("fact")
