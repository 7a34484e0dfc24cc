"""Column builders that clean, cut and compare text. All are Catalyst expressions; null stays null."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented Latin letters and the plain letter of each.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
#: Marks the end of a sentence while texts are split; it is not found in texts.
MARK = "␟"

# Cleaning rewrites in the order in which they apply.
CLEANING = (
    (r"\^", ""),
    (r"\[?p\. ?[0-9]+\]?", ""),
    (r"([A-Za-z])-\s+([a-z])", "$1$2"),
    (r"\s+([,.;:!?])", "$1"),
    (r"\.{2,}", "."),
    (r"([a-z])[0-9]([ ,.;])", "$1$2"),
    (r"([,;])[,;]+", "$1"),
    (r"\( *\)", ""),
    (r"\s+", " "),
)
# Separators at which a cut may fall, best first.
SEPARATORS = (". ", "! ", "? ", "; ", " — ", ", ")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it (projections would be inlined)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squeeze(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def dehyphenate(c: Column) -> Column:
    """Words broken by a hyphen and white space are joined, then white space is squeezed."""
    return squeeze(F.regexp_replace(c, r"([A-Za-z])-\s+([A-Za-z])", "$1$2"))


def fold(c: Column) -> Column:
    """Lower case without the accents of Latin-1 letters; ligatures stay."""
    return F.translate(F.lower(c), ACCENTED, PLAIN)


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def letters_key(c: Column) -> Column:
    """Only the letters and digits a-z0-9 of the lower-cased text: equal for texts that differ in punctuation."""
    return F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "")


def clean(c: Column) -> Column:
    """The cleaning rewrites in order, ends trimmed."""
    return F.trim(reduce(lambda x, r: F.regexp_replace(x, r[0], r[1]), CLEANING, c))


def polish(c: Column) -> Column:
    """Stray punctuation in front goes, spaces are squeezed, a space before the last point goes, a capital begins."""
    bare = F.regexp_replace(squeeze(F.regexp_replace(c, r"^[\s,;:.\-]+", "")), r" \.$", ".")
    return F.concat(F.upper(F.left(bare, F.lit(1))), F.substring(bare, 2, 2147483647))


def html_escape(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def last_index(c: Column, piece: str) -> Column:
    """0-based index of the last occurrence of ``piece``, -1 if there is none."""
    at = F.locate(piece[::-1], F.reverse(c))
    return F.when(at == 0, F.lit(-1)).otherwise(F.length(c) - at - len(piece) + 1)


def truncate_at_space(c: Column, limit: int, least: int, tail: str = "…") -> Column:
    """Cut at the last space beyond ``least`` of the first ``limit`` characters, else at the limit; short text as is."""
    cut = F.left(c, F.lit(limit))
    at = last_index(cut, " ")
    short = F.when(at > least, F.left(cut, at)).otherwise(cut)
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(short, F.lit(tail)))


def boundary_cut(c: Column, limit: int, share: float = 0.45, tail: str = " […]") -> Column:
    """Cut at the best separator that stands beyond ``share`` of the limit, else at the limit; short text as is."""
    cut = F.left(c, F.lit(limit))
    options = []
    for s in SEPARATORS:
        at = last_index(cut, s)
        options.append(F.when(at > share * limit, F.left(cut, at + len(s.rstrip()))))
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.coalesce(*options, cut), F.lit(tail)))


def sentences(c: Column) -> Column:
    """Pieces that end in . ! ? ; or : before white space."""
    marked = F.regexp_replace(c, r"([.!?;:])\s+", "$1" + MARK)
    return F.filter(F.split(marked, MARK), lambda x: F.length(F.trim(x)) > 0)


def glued_sentences(c: Column, least: int = 40) -> Column:
    """Sentences; one shorter than ``least`` is glued to the next, a short rest is kept only if nothing else is."""
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("rest"))

    def step(acc: Column, x: Column) -> Column:
        piece = F.when(acc["rest"] == "", x).otherwise(F.concat(acc["rest"], F.lit(" "), x))
        done = F.length(piece) >= least
        return F.struct(
            F.when(done, F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out"),
            F.when(done, F.lit("")).otherwise(piece).alias("rest"),
        )

    def finish(acc: Column) -> Column:
        keep = (acc["rest"] != "") & (F.size(acc["out"]) == 0)
        return F.when(keep, F.array(acc["rest"])).otherwise(acc["out"])

    return F.aggregate(sentences(c), empty, step, finish)


def distinct_matches(c: Column, pattern: str) -> Column:
    """The number of different lower-cased matches of a pattern with one group."""
    return F.size(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), F.lower)))


def smells(c: Column) -> dict[str, Column]:
    """Boolean columns: faults of transcription a text may show."""
    return {name: c.rlike(p) for name, p in SMELLS.items()}


# Patterns of faults, by name.
SMELLS = {
    "caps_run": r"[A-Z]{9,}",
    "digit_in_word": r"[a-z][0-9][a-z]",
    "case_break": r"[a-z][A-Z][a-z]",
    "double_space": r"  ",
    "spaced_year": r"1 ?[78] [0-9]{2}",
    "markup": r"<[a-z]+>|&[a-z]+;",
    "stray_punctuation": r" [,;:] ",
}
