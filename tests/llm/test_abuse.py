from collections import Counter

import pytest

from folio.llm import abuse


@pytest.fixture(scope="module")
def model():
    c = Counter()
    for w in "the enemy holds the river and the bridge was repaired for forty horses by our men on the road".split() * 50:
        c.update(abuse.CharModel.grams(w))
    return abuse.CharModel(dict(c))


@pytest.mark.parametrize(
    ("seen", "meant"),
    [("sh1t", "shit"), ("s h i t", "shit"), ("fuuuck", "fuck"), ("scvm", "scum"), ("wh*re", "whore"), ("crét1n", "crétin"), ("s-c-u-m", "scum")],
)
def test_disguises_are_restored(model, seen, meant):
    assert meant in abuse.Restorer(model).restore(f"He is a {seen} and knows it.")[0]


def test_ordinary_text_is_left_alone(model):
    text = "The 54th battalion took 1,500 horses, the 4e legion 20."
    assert abuse.Restorer(model).restore(text)[0] == text


def test_lexicon_scores_without_labels():
    weights, triggers = abuse.fit([], set(abuse.LEXICON))
    assert abuse.score_sentence(abuse.tokens("You are a fucking shit", set(abuse.LEXICON)), weights) > 0.5
    assert abuse.score_sentence(abuse.tokens("The dogs ran home", set(abuse.LEXICON)), weights) < 0.5


def test_documents(spark):
    docs = spark.createDataFrame(
        [(1, "You fucking shit!", "a", 9), (2, "All is quiet.", "a", 9), (3, None, "b", 9), (4, "", "b", 9), (1, "You fucking shit!", "a", 9)],
        "doc_id long, text string, source string, toxic int",
    )
    labels = spark.createDataFrame([], "doc_id long, toxic int, reviewer string")
    rows = abuse.score_documents(docs, labels, keep=("source",)).collect()
    assert sorted((r.doc_id, r.passages) for r in rows) == [(1, 1), (1, 1), (2, 0), (3, 0), (4, 0)]
    assert {r.source: r.rate for r in abuse.rates(abuse.score_documents(docs, labels, keep=("source",)), "source").collect()} == {"a": 0.666667, "b": 0.0}
    assert abuse.score_documents(docs.limit(0), labels).count() == 0


def test_an_odd_word_is_restored_to_a_frequent_one(model):
    assert "bridge" in abuse.Restorer(model, frozenset({"bridge"})).restore("They hold the br1dge now.")[0]
    long = "q" * 70 + "1" + "q" * 70
    assert abuse.Restorer(model).restore(f"All is {long} here.")[0].endswith("here.")


def test_words_are_counted_over_all_documents(spark):
    docs = spark.createDataFrame([("The river, the bridge.",), (None,), ("",), ("a" * 50 + " the",)], "text string")
    assert {r.w: r.n for r in abuse.corpus_words(docs, "text").collect()} == {"the": 3, "river": 1, "bridge": 1, "a" * 50: 1}
