"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import params as P


def round_half_up(c: Column) -> Column:
    """Rounding towards plus infinity at halves, also for negative numbers."""
    return F.floor(c + F.lit(0.5))


def comparable(c: Column) -> Column:
    """Lower case, every run of other characters than letters a-z and digits as one space; null where nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")), F.lit(""))


def slug(c: Column) -> Column:
    return F.replace(comparable(c), F.lit(" "), F.lit("-"))


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(comparable(c), F.lit("")), " "), lambda t: t != "")


def material_tokens(c: Column) -> Column:
    """Tokens of three or more characters that are no number, stop word or word of mere announcements."""
    skip = F.array(*[F.lit(w) for w in dict.fromkeys([*P.STOP_WORDS, *P.UPDATE_WORDS])])
    return F.filter(tokens(c), lambda t: (F.length(t) > 2) & ~F.array_contains(skip, t) & ~t.rlike("^[0-9]+$"))


def fact_clauses(c: Column) -> Column:
    """Comparable clauses of a text that have at least two material tokens, each once."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), r"[.!?\n;:]+"), comparable)
    return F.array_distinct(F.filter(parts, lambda p: p.isNotNull() & (F.size(material_tokens(p)) >= 2)))


def dice(a: Column, b: Column) -> Column:
    a, b = F.array_distinct(a), F.array_distinct(b)
    return F.when(F.size(a) + F.size(b) > 0, 2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))).otherwise(0.0)


def first_rule(low: Column, rules, otherwise: str) -> Column:
    """The name of the first rule whose pattern a text in lower case holds."""
    return F.coalesce(*[F.when(low.rlike(pattern), F.lit(name)) for name, pattern in rules], F.lit(otherwise))


def category_of(c: Column) -> Column:
    """Category by the first rule that a text meets."""
    return first_rule(F.lower(F.coalesce(c, F.lit(""))), P.GENERIC_CATEGORIES, "technique")


def topic_hits(c: Column) -> Column:
    """The topical keywords that a text holds anywhere, in their order."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.filter(F.array(*[F.lit(k) for k in P.TOPICAL_KEYWORDS]), lambda k: F.contains(low, k))


def category_group(c: Column) -> Column:
    return F.when(c.isin("tool", "api", "library"), "artifact").otherwise(c)


def _words(*words: str) -> Column:
    return F.array(*[F.lit(w) for w in words])


def alias(c: Column) -> Column:
    """Comparable text without the words at both ends that every title has; null if nothing but digits is left."""
    noise = "|".join(P.TITLE_NOISE)
    got = F.regexp_replace(F.regexp_replace(comparable(c), rf"^(?:(?:{noise})(?: |$))+", ""), rf"(?:(?:^| )(?:{noise}))+$", "")
    return F.when((got != "") & ~got.rlike("^[0-9]+$"), got)


def is_specific(name: Column) -> Column:
    """An alias of two words, or of one of at least eight letters."""
    return F.contains(name, F.lit(" ")) | (F.length(name) >= 8)


def informative_tokens(c: Column) -> Column:
    return F.filter(tokens(c), lambda t: ~F.array_contains(_words(*P.SIMILARITY_NOISE), t))


def storyline_tokens(c: Column) -> Column:
    """Distinct tokens without words that every announcement has and versions; if none is left, the first three of all."""
    every = tokens(c)
    kept = F.array_distinct(F.filter(every, lambda t: ~F.array_contains(_words(*P.STORYLINE_STOP_WORDS), t) & ~t.rlike(P.VERSION)))
    return F.when(F.size(kept) > 0, kept).otherwise(F.slice(every, 1, P.STORYLINE_TOKENS))


def shortened(c: Column, most: int) -> Column:
    """A text of single spaces, cut at the last space, colon or hyphen before ``most`` letters, but not within its first 32."""
    plain = F.trim(F.regexp_replace(c, r"\s+", " "))
    cut = F.substring(plain, 1, most + 1)
    at = F.length(F.regexp_extract(cut, r"^(.*)[ :\-]", 1))
    head = F.when(at > 32, F.substring(cut, F.lit(1), at)).otherwise(F.substring(cut, 1, most))
    return F.when(F.length(plain) <= most, plain).otherwise(F.concat(F.trim(head), F.lit("...")))


def sentiment(c: Column) -> Column:
    """Negative words decide before positive ones; null without either."""
    low = F.lower(c)
    return F.when(low.rlike(P.NEGATIVE), "negative").when(low.rlike(P.POSITIVE), "positive")


def is_about_agents(c: Column) -> Column:
    """A text with a phrase of its own for agents, or with ``agent`` and a word of their context."""
    low = F.lower(F.coalesce(c, F.lit("")))
    holds = lambda phrases: F.exists(_words(*phrases), lambda k: F.contains(low, k))
    return holds(P.AGENT_SIGNALS) | (F.contains(low, F.lit("agent")) & holds(P.AGENT_CONTEXT))


def dimension(c: Column) -> Column:
    """The dimension most of whose keywords a text holds, the first of several; ``utility`` if it holds none, null for an empty text."""
    low = F.lower(c)
    hits = F.array(*[F.struct(F.size(F.filter(_words(*words), lambda k: F.contains(low, k))).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, (name, words) in enumerate(P.DIMENSIONS.items())])
    best = F.array_max(hits)
    return F.when(F.trim(low) != "", F.when(best["n"] > 0, best["name"]).otherwise("utility"))


def kind_category(kind: Column, c: Column) -> Column:
    """Category by the rules of a source kind; papers need two patterns together."""
    low = F.lower(F.coalesce(c, F.lit("")))
    paper = F.coalesce(*[F.when(low.rlike(a) & low.rlike(b), F.lit(name)) for name, a, b in P.PAPER_CATEGORIES], F.lit("technique"))
    return F.coalesce(F.when(kind == "arxiv", paper), *[F.when(kind == k, first_rule(low, rules, "tool")) for k, rules in P.KIND_CATEGORIES.items()], category_of(c))


def paper_tags(c: Column, primary_category: Column) -> Column:
    """Sorted tags of a paper: those every paper has, its category and what its words say."""
    low = F.lower(c)
    tags = [F.lit("source:arxiv"), F.lit("content:paper"), F.lit("curation:research"), F.concat(F.lit("arxiv:primary:"), primary_category)]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*tags, *[F.when(low.rlike(p), F.lit(t)) for t, p in P.PAPER_TAGS.items()]))))


def doi(c: Column) -> Column:
    """DOI in lower case of a link to a resolver or of a ``doi:`` text; null for other links."""
    low = F.lower(F.trim(c))
    plain = F.regexp_replace(F.regexp_replace(low, r"^https?://(?:www\.|dx\.)?doi\.org/+", ""), r"^doi:\s*", "")
    return F.when(~plain.rlike("^https?://"), F.nullif(plain, F.lit("")))


def reason_code(c: Column) -> Column:
    """Reason in lower case with underscores."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s-]+", "_")


def phase(reason: Column) -> Column:
    """The phase that a reason to exclude belongs to."""
    return F.when(reason == "out_of_scope", "scope").when(reason == "relevance_below_threshold", "scoring").when(reason.isNotNull(), "source")
