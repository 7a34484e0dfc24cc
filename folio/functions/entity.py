"""Names and places as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions.text import fold

# Words of address and rank that do not name a person.
TITLES = (
    "the", "to", "m", "mr", "mme", "madame", "lady", "citizen", "citizeness", "general", "gen", "genl", "colonel", "col", "colnl", "captain", "capt",
    "cptn", "admiral", "adm", "adml", "marshal", "mshl", "marsh", "major", "maj", "minister", "min", "commissary", "comy", "his", "her", "grace",
)
# Places that say nothing.
VAGUE = ("", "unknown", "at sea", "camp", "on the march")


def addressee(title: Column) -> Column:
    """The text between ``To`` and the first comma; null if it holds digits or five capitals in a row."""
    raw = F.regexp_extract(title, r"^To\s+([^,]+)", 1)
    return F.when((raw != "") & ~raw.rlike("[0-9]|[A-Z]{5}"), raw)


def name_words(name: Column) -> Column:
    """The folded words of a name that are not titles."""
    words = F.split(F.trim(F.regexp_replace(fold(name), r"[^a-z]+", " ")), " ")
    return F.filter(words, lambda w: (w != "") & ~w.isin(*TITLES))


def person_key(title: Column) -> Column:
    """The words of the addressee run together; null if there is none."""
    key = F.array_join(name_words(addressee(title)), "")
    return F.when(key != "", key)


def handle(name: Column) -> Column:
    """``@`` and the last word of a name that is no title."""
    last = F.try_element_at(name_words(name), F.lit(-1))
    return F.when(last.isNotNull(), F.concat(F.lit("@"), last))


def clean_place(place: Column) -> Column:
    """Trimmed place without stray punctuation, first letter upper case; null if vague or shorter than 3 letters."""
    bare = F.regexp_replace(F.trim(place), r"^[ ,.;:]+|[ ,.;:]+$", "")
    ok = (F.length(bare) >= 3) & ~F.lower(bare).isin(*VAGUE)
    return F.when(ok, F.concat(F.upper(F.left(bare, F.lit(1))), F.substring(bare, 2, 2147483647)))
