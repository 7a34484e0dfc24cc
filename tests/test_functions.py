import pytest
from pyspark.sql import functions as F

from folio.functions import dates, entity, score, text


@pytest.fixture(scope="module")
def value(spark):
    def run(x, f, kind="string"):
        return spark.createDataFrame([(x,)], f"x {kind}").select(f(F.col("x")).alias("y")).collect()[0].y

    return run


@pytest.mark.parametrize(
    ("f", "x", "y"),
    [
        (text.dehyphenate, "trea-\n  sury  and\tmore ", "treasury and more"),
        (text.slug, "To M. De Talleyrand, Paris", "to-m-de-talleyrand-paris"),
        (text.fold, "ÉGYPTE à Noël", "egypte a noel"),
        (text.html_escape, 'a<b & "c">', "a&lt;b &amp; &quot;c&quot;&gt;"),
        (text.polish, " ,; the end .", "The end."),
        (text.clean, "p. 12 The trea-\nsury1 , was^  full..", "The treasury, was full."),
        (text.letters_key, "To M. X, 1805", "tomx1805"),
        (lambda c: text.truncate_at_space(c, 12, 4), "one two three four", "one two…"),
        (lambda c: text.truncate_at_space(c, 50, 4), "one two", "one two"),
        (lambda c: text.boundary_cut(c, 20), "One two three. Four five six seven", "One two three. […]"),
        (lambda c: text.boundary_cut(c, 10), "abcdefghijklmnop", "abcdefghij […]"),
        (entity.person_key, "To General Colbert, Paris, 1805-01-01", "colbert"),
        (entity.person_key, "To Josephine at Milan, 1796", "josephineatmilan"),
        (entity.person_key, "To X12, Paris, 1800-01-01", None),
        (entity.handle, "Marshal Michel Brun", "@brun"),
        (entity.clean_place, " st. cloud, ", "St. cloud"),
        (entity.clean_place, "camp", None),
        (dates.era_of, "1805-03-01", "empire"),
        (dates.era_of, "1700-03-01", None),
        (dates.month_number, "Sept.", 9),
        (dates.month_number, "août", 8),
        (dates.month_number, "13", None),
        (dates.day_number, "l8", 18),
        (dates.day_number, "32", None),
    ],
)
def test_scalars(value, f, x, y):
    assert value(x, f) == y
    assert value(None, f) is None or f is entity.clean_place


def test_impossible_dates_are_null(value):
    assert value("1806-02-31", dates.safe_date) is None
    assert str(value("1806-02-28", dates.safe_date)) == "1806-02-28"


def test_sentences(value):
    long = "This sentence is quite long enough to stand alone."
    assert value(f"Short one. {long} Bye.", text.glued_sentences) == [f"Short one. {long}"]
    assert value("Only this.", text.glued_sentences) == ["Only this."]
    assert value("", text.glued_sentences) == []


def test_equal_scores_choose_the_first(value):
    a, b = "The bridge of the town is held by our best men today.", "The bridge of the town is held by our best men again."
    assert value(f"{a} {b}", score.best_sentence).text == a


def test_excerpt_takes_a_neighbour_that_fits(value):
    a = "We took 40 horses, 50 wagons and 60 cannon near the bridge of the town."
    b = "I shall write to you of the bridge and of the town again in the morning."
    assert value(f"{a} {b}", lambda c: score.best_excerpt(c, 300)) == f"{a} {b}"
    assert value(f"{a} {b}", lambda c: score.best_excerpt(c, 100)) == a


def test_cleaning_is_idempotent(spark):
    rows = spark.createDataFrame([("a-\nb  c ,, d",), ("^x..",), ("",), (None,)], "x string")
    once = rows.select(text.clean(F.col("x")).alias("x"))
    assert once.exceptAll(once.select(text.clean(F.col("x")).alias("x"))).count() == 0


def test_nearest_month_against_brute_force(spark):
    import re
    from difflib import SequenceMatcher

    from folio.plans.drafting import _nearest_month

    english = "January February March April May June July August September October November December".split()
    rev = "Vendemiaire Vendémiaire Brumaire Frimaire Nivose Nivôse Pluviose Pluviôse Ventose Ventôse Germinal Floreal Floréal Prairial Messidor Thermidor Fructidor".split()
    seen = ["May", "May.", "Nov", "Nov.", "Dec.", "Feb.", "Oct.", "Jan.", "JUNE", "Febr^uary", "Octo6er", "Brumaire", "Ventôse", "12", "", None, "xyz", "Sopt."]
    expected = {}
    for x in seen:
        w = re.sub("[^A-Za-z]", "", x or "").lower()
        best, score = None, 0.0
        for m in english + rev if w else ():
            if (r := SequenceMatcher(None, w, m.lower()).ratio()) > score:
                best, score = m, r
        expected[x] = english.index(best) + 1 if best in english and score >= 0.38 else None
    got = {r["m"]: r["n"] for r in spark.createDataFrame([(x,) for x in seen], "m string").select("m", _nearest_month("m").alias("n")).collect()}
    assert got == expected
    assert [got[x] for x in ("May", "May.", "Nov.", "Dec.", "Feb.", "Oct.", "Jan.")] == [5, 5, 11, 12, 2, 10, 1]
