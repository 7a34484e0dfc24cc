"""One consistent form for text that looks the same: compatibility forms, look-alike letters, spaces, invisibles.

``print_form`` is what a text reads as: compatibility-composed (NFKC), look-alike letters of other scripts mapped
to Latin, every kind of horizontal space mapped to a plain space, default-ignorable characters removed. Capitals,
accents, punctuation, line breaks and the number of spaces stay. ``match_form`` adds full case folding.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from folio.session import cut_lineage

# Ranges of the Unicode property Default_Ignorable_Code_Point.
IGNORABLE_RANGES = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F),
    (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF),
    (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)
# Letters of other scripts printed like Latin letters, and what they are printed like.
LOOKALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P",
    "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G", "Ӏ": "I", "Ѵ": "V",
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q",
    "ѕ": "s", "у": "y", "ү": "y", "х": "x", "ѵ": "v", "ԝ": "w", "ɡ": "g",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ι": "i", "ρ": "p", "υ": "u", "κ": "k", "α": "a", "ϲ": "c", "ϳ": "j",
    # Armenian, Latin and signs
    "Օ": "O", "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "ı": "i", "ɑ": "a", "‐": "-",
}
# Spaces and breaks that compatibility mapping leaves alone.
SPACES = {"\u1680": " ", "\u180e": " ", "\t": " ", "\u2028": "\n", "\u2029": "\n", "\u0085": "\n", "\u000b": "\n", "\u000c": "\n"}

#: Stands for the ellipsis while compatibility mapping would make three dots of it.
_ELLIPSIS = "\ue0f0"
_MAP = {ord(a): b for a, b in (LOOKALIKES | SPACES).items()}
_MAP |= {c: None for a, b in IGNORABLE_RANGES if b - a < 1000 for c in range(a, b + 1)}
#: Characters that leave a text as it is; most texts have no other and take the short way.
_PLAIN = re.compile(r"[\n -~À-ÖØ-öø-ÿŒœ“”‘’«»—–…¬£•€]*")
_TAGS = re.compile("[\U000e0000-\U000e0fff]")


def print_form(text: str) -> str:
    """The text as it reads in print; see the module's docstring. ``…`` reads as itself, not as three dots."""
    if _PLAIN.fullmatch(text):
        return text
    kept = text.replace("\r\n", "\n").replace("\r", "\n").replace("…", _ELLIPSIS)
    kept = unicodedata.normalize("NFKD", _TAGS.sub("", kept)).translate(_MAP)
    return unicodedata.normalize("NFC", kept).replace(_ELLIPSIS, "…")


def match_form(text: str) -> str:
    """``print_form`` with full case folding, for comparisons that ignore capitals."""
    return unicodedata.normalize("NFC", print_form(text).casefold())


def _per_distinct(s: pd.Series, f) -> pd.Series:
    codes, values = pd.factorize(s)
    done = pd.Series([f(v) for v in values], dtype=object)
    return pd.Series(done.reindex(codes).where(codes >= 0, None).to_numpy(), index=s.index)


@pandas_udf(StringType())
def print_form_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield _per_distinct(s, print_form)


@pandas_udf(StringType())
def match_form_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield _per_distinct(s, match_form)


def canonical(text: Column, fold_case: bool = False) -> Column:
    """The consistent form of a text column; null stays null, computed once per distinct value of an Arrow batch."""
    return match_form_udf(text) if fold_case else print_form_udf(text)


def nonblank(text: Column) -> Column:
    """Whether a text holds anything but space and invisible characters."""
    return text.rlike(r"[^\s\p{Z}\p{Cf}\x{115F}\x{1160}\x{3164}]")


def same_reading(df: DataFrame, key: str, text: str, fold_case: bool = False) -> DataFrame:
    """(key_a, key_b): records whose different texts have one consistent form.

    Rows with a null key or a null or blank text take no part; rows repeated with the same key and text count once;
    exact copies of one text are no pair. A form with a single spelling is set aside before any join, and joins go
    from variant to variant, so that a large group of exact copies is never paired with itself.
    """
    slim = df.select(F.col(key).cast("string").alias("id"), F.col(text).alias("t")).where(F.col("id").isNotNull() & nonblank(F.col("t")))
    members = cut_lineage(
        slim.select("id", F.unhex(F.md5(canonical(F.col("t"), fold_case))).alias("form"), F.unhex(F.md5("t")).alias("raw"))
    )
    forms = members.groupBy("form").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo < hi").select("form")
    shared = members.join(forms, "form", "left_semi").distinct()
    variants = shared.select("form", "raw").distinct()
    pairs = variants.withColumnRenamed("raw", "raw_a").join(variants.withColumnRenamed("raw", "raw_b"), "form").where("raw_a < raw_b")
    a = shared.select("form", F.col("raw").alias("raw_a"), F.col("id").alias("a"))
    b = shared.select("form", F.col("raw").alias("raw_b"), F.col("id").alias("b"))
    return (
        pairs.join(a, ["form", "raw_a"])
        .join(b, ["form", "raw_b"])
        .where("a <> b")
        .select(F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b"))
        .distinct()
    )
