import random
from difflib import SequenceMatcher

import numpy as np

from folio.operators import likeness, match


def made(seed, n):
    r = random.Random(seed)
    some = ["", "a", "a\0b", "\0", "ab" * 40, "été à la 🜁 mer", "the bridge is held", "the bridge is held!"]
    return some + ["".join(r.choice("abcde \0é") for _ in range(r.randint(0, 149))) for _ in range(n)]


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_kernels_equal_difflib_and_the_plain_table():
    texts = made(1, 40)
    codes, lengths = likeness.coded(texts)
    a, b = (x.reshape(-1) for x in np.indices((len(texts), len(texts))))
    want = np.array([ratio(texts[i], texts[j]) for i, j in zip(a, b, strict=True)])
    assert (likeness.ratios(codes, lengths, a, b, -1) == want).all()
    for least in (0.3, 0.55):
        got = likeness.ratios(codes, lengths, a, b, least)
        assert ((got > least) == (want > least)).all() and (got[want > least] == want[want > least]).all()
        assert (likeness.exceeds(codes, lengths, a, b, least) == (want > least)).all()
    some = slice(0, None, 7)
    assert likeness.edit_distances(codes, lengths, a[some], b[some]).tolist() == [edits(texts[i], texts[j]) for i, j in zip(a[some], b[some], strict=True)]


def days(spark, seed):
    r = random.Random(seed)
    texts = made(seed, 25)
    rows = [(f"k{i:03}", r.choice(["d", "d", "d", "e", "f"]), r.choice(texts)) for i in range(150)] + [("n", "d", None), ("m", None, "x")]
    return rows, spark.createDataFrame(rows, "id string, day string, t string").repartition(3)


def test_pairs_of_a_day_are_whole_in_one_cell_and_in_many(spark, monkeypatch):
    rows, df = days(spark, 3)
    pairs = [(x, y) for x in rows for y in rows if x[0] < y[0] and x[1] and x[1] == y[1] and None not in (x[2], y[2])]
    near = {(x[0], y[0]): ratio(x[2], y[2]) for x, y in pairs if ratio(x[2], y[2]) > 0.5}
    few = {(x[0], y[0]): n for x, y in pairs if (n := edits(x[2], y[2])) <= 60}
    for rows_a_cell in (1000, 7):
        monkeypatch.setattr(match, "CELL_ROWS", rows_a_cell)
        got = match.ratios_within(df, "day", "id", "t", 0.5).collect()
        assert {(r.key_a, r.key_b): r.ratio for r in got} == near and len(got) == len(near)
        got = match.edits_within(df, "day", "id", "t", 60).collect()
        assert {(r.key_a, r.key_b): r.edits for r in got} == few and len(got) == len(few)


def test_a_greedy_walk_in_steps_equals_the_plain_one(spark):
    rows, df = days(spark, 5)
    want = set()
    for day in {x[1] for x in rows}:
        kept = []
        for key, _, t in sorted(x for x in rows if x[1] == day):
            if all(ratio((t or "")[:150], k) <= 0.55 for k in kept):
                kept.append((t or "")[:150])
                want.add(key)
    got = [r.id for r in match.greedy_distinct(df, "day", "id", "t", 0.55).collect()]
    assert set(got) == want and len(got) == len(want)
    texts = made(7, 300)
    codes, lengths = likeness.coded(texts)
    kept = []
    for i, t in enumerate(texts):
        if all(ratio(t, texts[k]) <= 0.4 for k in kept):
            kept.append(i)
    assert len(texts) > match.AHEAD and match._kept([np.arange(len(texts))], codes, lengths, 0.4) == [set(kept)]


def test_a_crowded_day_of_copies_costs_its_distinct_texts_only(spark):
    texts = made(9, 20)
    rows = [(f"{c:04}-{k:02}", "d", t) for c in range(200) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id string, day string, t string")
    assert {r.id[:4] for r in match.greedy_distinct(df, "day", "id", "t", 0.55).collect()} == {"0000"}


def test_a_greedy_walk_compares_whole_texts(spark, monkeypatch):
    r = random.Random(12)
    head = "".join(r.choice("abcdefgh ") for _ in range(160))
    tails = ["".join(r.choice(x) for _ in range(1200)) for x in ("abcdefgh ", "ijklmnop ", "qrstuvwx ")]
    texts = [head + tails[0], head + tails[1], head + tails[0][:1100], head, tails[2], "x" + tails[2], "", None]
    rows = [(f"k{k:02}", d, t) for d in "defg" for k, t in enumerate(texts if d != "g" else texts[::-1])]
    want = set()
    for day in "defg":
        kept = []
        for key, _, t in (x for x in rows if x[1] == day):
            if all(SequenceMatcher(None, t or "", k, autojunk=False).ratio() <= 0.55 for k in kept):
                kept.append(t or "")
                want.add((day, key))
    assert ("d", "k01") in want and ("d", "k02") not in want  # unlike and like after one beginning
    df = spark.createDataFrame(rows, "id string, day string, t string")
    for walked in (match.WALKED, 1):
        monkeypatch.setattr(match, "WALKED", walked)
        got = [(x.day, x.id) for x in match.greedy_distinct(df, "day", "id", "t", 0.55).collect()]
        assert set(got) == want and len(got) == len(want)


def test_common_subsequences_of_long_texts(monkeypatch):
    r = random.Random(13)
    texts = ["", "a"] + ["".join(r.choice("abc") for _ in range(n)) for n in (62, 63, 64, 126, 127, 300)]
    codes, lengths = likeness.coded(texts)
    a, b = (x.reshape(-1) for x in np.indices((len(texts), len(texts))))
    want = []
    for x, y in zip(a, b, strict=True):
        row = [0] * (len(texts[y]) + 1)
        for c in texts[x]:
            last = row[:]
            for j, e in enumerate(texts[y], 1):
                row[j] = last[j - 1] + 1 if c == e else max(row[j - 1], last[j])
        want.append(row[-1])
    assert likeness.common_lengths(codes, lengths, a, b).tolist() == want
    monkeypatch.setattr(likeness, "LCS_MASKS", 1)
    monkeypatch.setattr(likeness, "LCS_SYMBOLS", 900)
    assert likeness.common_lengths(codes, lengths, a, b).tolist() == want
