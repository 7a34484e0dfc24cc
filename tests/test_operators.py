import datetime

from pyspark.sql import functions as F

from folio.operators import match, orphans, records

D = datetime.date


def find(spark, refs, parents):
    r = spark.createDataFrame(refs, "id string, keys array<string>, seen int, deleted_at string")
    p = spark.createDataFrame(parents, "id string, seen int, deleted_at string, keys string")
    out = orphans.orphan_references(r, p, ref_id="id", ref_keys=F.col("keys"), ref_seen="seen", parent_key="id", parent_seen="seen", parent_deleted="deleted_at")
    return {tuple(x) for x in out.collect()}


def test_orphans(spark):
    parents = [("a", 1, None, "z"), ("b", 5, None, "z"), ("c", 1, "2020", "z"), ("b", 9, None, "z"), ("e", None, None, "z")]
    refs = [
        ("r1", ["a", "b", "c", "d"], 3, "x"), ("r1", ["a", "zz"], 7, "x"), ("r2", ["b", "A", "a "], 6, "x"), ("r3", None, 1, "x"), ("r4", [], 1, "x"),
        ("r5", [None, ""], 1, "x"), (None, ["q"], 1, "x"), ("r6", ["e"], 1, "x"), ("r7", ["k" * 50_000], 1, "x"),
    ]
    assert find(spark, refs, parents) == {
        ("r1", "b", "late"), ("r1", "c", "deleted"), ("r1", "d", "missing"), ("r1", "zz", "missing"), ("r2", "A", "missing"), ("r2", "a ", "missing"),
        ("r5", "", "missing"), ("r7", "k" * 50_000, "missing"),
    }
    assert find(spark, refs[:1], []) == {("r1", x, "missing") for x in "abcd"}
    assert find(spark, [], parents) == set()


def test_orphans_with_a_hot_key_against_brute_force(spark):
    refs = [(f"r{i}", ["hot" if i % 3 else f"k{i % 50}"], 1, None) for i in range(3000)]
    parents = [(f"k{i}", 0, None, None) for i in range(0, 50, 2)]
    got = find(spark, refs, parents)
    known = {p[0] for p in parents}
    assert got == {(r, k[0], "missing") for r, k, _, _ in refs if k[0] not in known}


def test_runs_are_contiguous(spark):
    p = spark.createDataFrame([(i,) for i in (1, 2, 3, 7, 8)], "k int")
    r = spark.createDataFrame([(i,) for i in (2, 5, 8, 9)], "k int")
    coded = orphans.key_codes(p, r)
    runs = orphans.parent_runs(coded)
    assert runs.agg(F.sum(F.col("run_end") - F.col("run_start") + 1)).collect()[0][0] == 5
    assert {x.key for x in orphans.unmatched_keys(coded, runs).collect()} == {5, 9}


def test_first_delivery_and_longest(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "yy"), ("b", 1, None), (None, 0, "q")], "id string, n int, t string")
    assert {tuple(r) for r in records.first_delivery(df, "id", F.col("n")).collect()} == {("a", 1, "yy"), ("b", 1, None)}
    assert records.longest(df.where("id = 'a'"), ["id"], "t", "n").collect()[0].t == "yy"


def test_admit_override_upsert(spark):
    df = spark.createDataFrame([("a", "ok"), ("b", None), ("c", "bad")], "id string, s string")
    ok, no = records.admit(df, {"null": F.col("s").isNull(), "bad": F.col("s") == "bad"})
    assert [r.id for r in ok.collect()] == ["a"] and {(r.id, r.reason) for r in no.collect()} == {("b", "null"), ("c", "bad")}
    new = spark.createDataFrame([("a", "new"), ("b", " "), ("z", "z")], "id string, s string")
    assert {tuple(r) for r in records.override(df, new, "id", {"s": "s"}).collect()} == {("a", "new"), ("b", None), ("c", "bad")}
    assert {tuple(r) for r in records.upsert(df, new, "id").collect()} == {("a", "new"), ("b", " "), ("c", "bad"), ("z", "z")}


def test_nearest_date_prefers_the_earlier(spark):
    days = spark.createDataFrame([(D(1800, 1, 1),), (D(1800, 1, 5),), (None,)], "d date")
    probes = spark.createDataFrame([(i, x) for i, x in enumerate([D(1800, 1, 3), D(1799, 1, 1), D(1801, 1, 1), D(1800, 1, 4)])], "i int, p date")
    got = {r.i: r.nearest for r in match.nearest_date(probes, "p", days, "d").collect()}
    assert got == {0: D(1800, 1, 1), 1: D(1800, 1, 1), 2: D(1800, 1, 5), 3: D(1800, 1, 5)}


def test_as_of_and_band(spark):
    left = spark.createDataFrame([("k", 5), ("k", 1), ("q", 9)], "k string, at int")
    right = spark.createDataFrame([("k", 2, "x"), ("k", 5, "y")], "k string, t int, v string")
    assert {tuple(r) for r in match.as_of(left, right, "k", "at", "t", "v").collect()} == {("k", 5, "y"), ("k", 1, None), ("q", 9, None)}
    a = spark.createDataFrame([("a", D(1800, 1, 2))], "a string, d date")
    b = spark.createDataFrame([("x", D(1800, 1, 1)), ("y", D(1800, 1, 4))], "b string, d date")
    assert [r.b for r in match.band_pairs(a, b, "d", 1).collect()] == ["x"]


def test_greedy(spark):
    df = spark.createDataFrame([("d", 1, "the bridge is held"), ("d", 2, "the bridge is held!"), ("d", 3, "quite another thing"), ("e", 1, None)], "d string, n int, t string")
    assert {(r.d, r.n) for r in match.greedy_distinct(df, "d", "n", "t", 0.8).collect()} == {("d", 1), ("d", 3), ("e", 1)}
