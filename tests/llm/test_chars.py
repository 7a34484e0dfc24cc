from folio.llm import chars


def test_print_form():
    plain = "The café, at 10 o'clock"
    for other in ("Тhe café, at 10 o'clock", "The café, at １０ o'clock", "Th​e ca﻿fé, at 10 o'clock", "The caﬁ".replace("ﬁ", "fé") + ", at 10 o'clock"):
        assert chars.print_form(other) == plain
    for other in ("The cafe, at 10 o'clock", "the café, at 10 o'clock", "The café,  at 10 o'clock", "The café at 10 o'clock", "The café, at 10 o’clock"):
        assert chars.print_form(other) != plain
    assert chars.print_form("wait…") == "wait…" != chars.print_form("wait...")
    assert chars.match_form("STRASSE") == chars.match_form("straße")


def test_forms_are_fixed_points():
    for t in ("ﬁne ｗｏｒｄ", "é", "а‍b", "", "½ ² ﷺ", "\U000e0041x"):
        assert chars.print_form(chars.print_form(t)) == chars.print_form(t)


def test_same_reading(spark):
    rows = [
        ("a", "read me", 1), ("b", "re​ad me", 1), ("c", "rеad me", 1), ("d", "read me", 1), ("e", "Read me", 1), ("f", None, 1), ("g", "  ", 1), ("h", "​", 1),
        ("b", "re​ad me", 1), (None, "read me", 1), ("i", "x" * 100_000, 1), ("j", "x" * 99_999 + "​x", 1),
    ]
    df = spark.createDataFrame(rows, "id string, t string, form int")
    got = {(r.key_a, r.key_b) for r in chars.same_reading(df, "id", "t").collect()}
    assert got == {("a", "b"), ("a", "c"), ("b", "c"), ("b", "d"), ("c", "d"), ("i", "j")}
    folded = {(r.key_a, r.key_b) for r in chars.same_reading(df, "id", "t", fold_case=True).collect()}
    assert folded - got == {("a", "e"), ("b", "e"), ("c", "e"), ("d", "e")}
    assert chars.same_reading(df.limit(0), "id", "t").count() == 0


def test_a_hot_form(spark):
    df = spark.range(3000).selectExpr("cast(id as string) as id", "case when id = 7 then 're​ad' when id % 3 = 0 then 'read' else cast(id as string) end as t")
    pairs = chars.same_reading(df, "id", "t")
    assert pairs.count() == 1000
