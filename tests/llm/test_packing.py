from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folio.llm import packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=200))
def test_patterns_hold_every_length_once(lengths):
    patterns = packing.pack_histogram(Counter(lengths), 50)
    held = Counter()
    for pattern, n in patterns:
        assert n > 0 and sum(a * b for a, b in pattern) <= 50
        for length, copies in pattern:
            held[length] += copies * n
    assert held == Counter(lengths)
    containers = sum(n for _, n in patterns)
    assert containers <= 2 * (sum(lengths) / 50) + 1


def test_pack(spark):
    rows = [(i, "word " * (i % 40 + 1), i) for i in range(400)] + [(1000, "word " * 200, 0), (1001, None, 0), (1002, "", 0), (3, "word word word word ", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key long")
    counts = {(r.key, r.n_tokens) for r in packing.token_counts(df, "doc_id", "text").collect()}
    placed = packing.pack(df, "doc_id", "text", capacity=64, salts=3).collect()
    whole = Counter()
    for r in placed:
        whole[r.key] += r.n_tokens
    twice = {k for k, _ in counts if k == 3}
    assert {k: n for k, n in whole.items() if k not in twice} == {k: n for k, n in counts if n and k not in twice}
    spaces = {}
    for r in placed:
        spaces.setdefault(r.container, []).append((r.start, r.start + r.n_tokens))
    for own in spaces.values():
        own.sort()
        assert own[-1][1] <= 64 and all(a[1] <= b[0] for a, b in zip(own, own[1:], strict=False))
    assert all(len([r for r in placed if r.key == k]) == 1 for k, n in counts if 0 < n <= 64 and k not in twice)
    report = packing.fill_report(packing.pack(df, "doc_id", "text", capacity=64), 64).collect()[0]
    assert report.fullest <= 64 and report.used > 0.95
    assert packing.pack(df.limit(0), "doc_id", "text").count() == 0


def test_one_length_for_all(spark):
    df = spark.range(500).selectExpr("id as doc_id", "'one two three' as text")
    rows = packing.pack(df, "doc_id", "text", capacity=10, salts=4).collect()
    n = rows[0].n_tokens
    assert len({r.container for r in rows}) == -(-500 // (10 // n)) and len({(r.container, r.start) for r in rows}) == 500


def test_capacity_must_be_positive(spark):
    with pytest.raises(ValueError):
        packing.pack(spark.range(1).selectExpr("id as doc_id", "'x' as text"), "doc_id", "text", capacity=0)
