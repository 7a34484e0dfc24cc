import pytest

from folio.llm import names

DIRECTORY = "person_id long, kind string, full_name string, rank_name string, title_name string, nickname string"
PEOPLE = [
    (1, "person", "Robert Jerome Lorounenmet", "Minister", None, "Bob"),
    (2, "person", "Benedict Rasevois", "Minister", "Duke of Faraivel", "Ben"),
    (3, "person", "Charlotte Rasevois", "Madame", None, "Lotte"),
    (4, "office", "Council of River Navigation", None, None, None),
    (5, "person", "Robert Kalson", "Major", None, None),
    (5, "person", "Robert Kalson", "Major", None, None),
]
SAID = {
    "To Bob Lorounenmet": 1, "To LOROUNENMET, R.": 1, "To Min. Robert Loroune met": 1, "To Mr. Lorounemnet": 1,
    "To the Duke de Faraivel": 2, "To Duke of Faraivl": 2, "To B. Rasevois": 2, "To Lady Rasevois": 3,
    "To the River Navigation Council": 4, "To Counc l of River Navigation": 4, "To Bob Kalson": 5,
    "To Hector Lorounenmet": None, "To the Army": None, "To the same": None, "To": None, "": None, None: None, "To " + "very long " * 500: None,
}


@pytest.fixture(scope="module")
def directory(spark):
    return spark.createDataFrame(PEOPLE, DIRECTORY)


def test_spellings(spark, directory):
    rows = spark.createDataFrame([(f"r{i}", m, 0) for i, m in enumerate(SAID)] + [("r0", "To Bob Lorounenmet", 0), (None, "To B. Rasevois", 0)], "rec_key string, mention string, person_id int")
    got = {r.rec_key: r.person_id for r in names.link_records(rows.select("rec_key", "mention"), directory).collect()}
    assert got == {f"r{i}": p for i, p in enumerate(SAID.values()) if p}


def test_bands_reach_the_recall():
    b = names.bands_for(0.4, 2, 0.995)
    assert 1 - (1 - 0.4**2) ** b >= 0.995


def test_likeness_counts_a_swap_once():
    assert names.likeness("abcd", "abdc") == 0.75
    assert names.likeness("abcd", "abcd") == 1.0
    assert names.likeness("", "abcd") == 0.0


def test_empty_tables(spark, directory):
    none = spark.createDataFrame([], "mention string, n long")
    some = spark.createDataFrame([("To Bob Lorounenmet", 1)], "mention string, n long")
    assert names.link_mentions(none, directory).count() == 0
    assert names.link_mentions(some, directory.limit(0)).count() == 0
