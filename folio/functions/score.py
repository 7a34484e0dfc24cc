"""Additive scores of sentences and the choice of an excerpt; counts of patterns, no user code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions.text import boundary_cut, glued_sentences, let

# What the scores look for.
NUMBER = r"[0-9][0-9,.]*"
FIRST_PERSON = r"(^|[^A-Za-z])(I|we|We|my|My|our|Our)($|[^A-Za-z])"
VERB = r"(^|[^A-Za-z])(is|are|was|has|have|will|shall|must|cannot|do|send|take|took|found|holds|proposes|promises)($|[^A-Za-z])"
PROPER = r"[a-z,;] [A-Z][a-z]{3,}"
DATE = r"(January|February|March|April|June|July|August|September|October|November|December)"
LABEL = r"^[A-Z][A-Za-z ]{0,20}[:.]$"
CONJUNCTION = r"^(And|But|For|Or|Nor|So|Yet)[^A-Za-z]"
BARE_PRONOUN = r"^(He|She|They|It|This|That)[^A-Za-z]"


def hits(c: Column, pattern: str, most: int) -> Column:
    return F.least(F.lit(most), F.regexp_count(c, F.lit(pattern)))


def flag(condition: Column, points: float) -> Column:
    return F.when(condition, F.lit(points)).otherwise(F.lit(0.0))


def sentence_score(c: Column) -> Column:
    """Length, numbers and first person count for a sentence; labels, dates alone, loose letters and signs against."""
    n = F.length(c)
    return F.round(
        flag((n >= 60) & (n <= 220), 2.0) + flag(n > 320, -1.5) + hits(c, NUMBER, 3) + flag(c.rlike(FIRST_PERSON), 0.5)
        + flag(c.rlike(LABEL), -10.0) - F.least(F.lit(2.0), 0.4 * F.regexp_count(c, F.lit(r" [b-hj-z] "))) - F.least(F.lit(4.0), 2.0 * F.regexp_count(c, F.lit(r"[a-z][0-9]|[0-9][a-z]{4}")))
        + flag(c.rlike(r"^\.\."), -2.0) - F.least(F.lit(2.0), 2.0 * F.regexp_count(c, F.lit(r"[\\^]"))),
        4,
    )


def clause_score(c: Column) -> Column:
    return F.round(
        flag(F.left(c, F.lit(120)).rlike(VERB), 3.0) + hits(c, NUMBER, 2) + F.least(F.lit(2.0), 0.5 * F.regexp_count(c, F.lit(PROPER)))
        + flag(c.rlike(CONJUNCTION), -1.0) + flag(c.contains("?"), -2.0) + flag(c.rlike(DATE), -4.0) + flag(F.length(c) > 220, -1.0),
        4,
    )


def voice_score(c: Column) -> Column:
    return F.round(
        flag(c.rlike(r"^(I|We|My|Our)[^A-Za-z]"), 3.0) + flag(c.rlike(FIRST_PERSON), 2.0) + flag(c.rlike(VERB), 2.0) + flag(c.rlike(DATE), -4.0)
        + flag(c.rlike(BARE_PRONOUN) & ~c.rlike(PROPER), -4.0) + flag(c.contains("?"), -3.0) + F.least(F.lit(1.5), 0.75 * F.regexp_count(c, F.lit(NUMBER))),
        4,
    )


def ranked_sentences(c: Column) -> Column:
    """array<struct<score, at, text>> of the glued sentences; ``at`` is minus the 1-based place, so max prefers early."""
    return F.transform(
        glued_sentences(c), lambda x, i: F.struct(sentence_score(x).alias("score"), (-(i + 1)).alias("at"), x.alias("text"))
    )


def best_sentence(c: Column) -> Column:
    """The best scored sentence as a struct; the earlier one of equals, null for a text without sentences."""
    return F.array_max(ranked_sentences(c))


def best_excerpt(c: Column, limit: int = 300, floor: float = 0.0) -> Column:
    """The best sentence, with its next neighbour (its previous at the end) if both fit and that one scores above 0."""

    def choose(all_: Column, top: Column) -> Column:
        at, n = -top["at"], F.size(all_)
        side = F.get(all_, F.when(at < n, at).otherwise(at - 2))

        def widen(s: Column) -> Column:
            both = F.when(at < n, F.concat(top["text"], F.lit(" "), s["text"])).otherwise(F.concat(s["text"], F.lit(" "), top["text"]))
            wide = (s["score"] > 0) & (F.length(both) <= limit)
            return F.when(F.coalesce(wide, F.lit(False)), both).otherwise(top["text"])

        return F.when(top["score"] >= floor, let(let(side, widen), lambda x: boundary_cut(x, limit)))

    return let(ranked_sentences(c), lambda all_: let(F.array_max(all_), lambda top: choose(all_, top)))
