from folio.llm import truncation

SAID = [
    "The treasury was repaired by the colonel. The battalion marched with the cavalry.",
    "We took the citadel and the harbour. The battalion holds the treasury.",
    "The colonel proposes to fortify the harbour. We took the citadel.",
]


def test_endings(spark):
    rows = [(f"s{i}", SAID[i % 3], "a", i) for i in range(60)]
    rows += [(f"remark{i}", SAID[i % 3] + " Time will show…”", "a", 0) for i in range(6)]
    cases = {
        "stump": "We took the citadel and the harb",
        "quoted": "We took the citadel and the harb”",
        "pointed": "We took the citadel and the harb.”",
        "dotted": "We took the citadel and the harb...",
        "marked": "We took the citadel and the harb […]”",
        "signed": "We took the citadel and the harb — Vauorbasse",
        "dated": "We took the citadel and the harb Given at Baréden, 13 October 1818”",
        "open": "The colonel proposes to",
    }
    done = {
        "plain": "We took the citadel.",
        "omitted": "“We took the citadel. […]”",
        "letter": "We took the citadel. — Vauorbasse",
        "given": "“We took the citadel. Given at Baréden, 13 October 1818”",
        "blank": "  ",
        "empty": "",
        "quote": "“”",
    }
    rows += [(k, t, "a", 0) for k, t in (cases | done).items()] + [("null", None, "a", 0), (None, "We took", "a", 0), ("stump", cases["stump"], "a", 0)]
    rows += [("long", "We took the citadel. " * 5000 + "We took the har", None, 0)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "id string, text string, archive string, source int")
    a = truncation.assess_endings(df, "id", "text", F.col("archive"))
    cut = {r.rec_key for r in a.where("cut").collect()}
    assert cut == set(cases) | {"long"}
    rate = {r.source: r for r in truncation.cut_rates(a).collect()}
    assert rate["a"].cut == len(cases) and rate[None].rate == 1.0
    assert truncation.assess_endings(df.limit(0), "id", "text", F.col("archive")).count() == 0


def test_trie_nodes(spark):
    words = spark.createDataFrame([("car",), ("cart",), ("a",)], "word string")
    assert {r.node: r.words for r in truncation.trie_nodes(words).collect()} == {"c": 2, "ca": 2, "car": 1}


def test_field_limit(spark):
    ends = spark.createDataFrame([("a", 100)] * 30 + [("a", i) for i in range(40, 99)] + [("b", i) for i in range(99)], "source string, n_chars long")
    assert [(r.source, r.n_chars) for r in truncation.field_limits(ends).collect()] == [("a", 100)]
