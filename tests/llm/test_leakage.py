import random

import numpy as np

from folio.llm import leakage
from folio.llm.words import words


def brute(docs, items, n=12):
    grams = {}
    for key, t in items:
        w = words(t)
        for k in range(len(w) - n + 1):
            grams.setdefault(tuple(w[k : k + n]), set()).add(key)
    out = set()
    for key, t in docs:
        w = words(t)
        for k in range(len(w) - n + 1):
            out |= {(key, i) for i in grams.get(tuple(w[k : k + n]), ())}
    return out


def test_against_brute_force(spark):
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(60)]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, say(r.randint(5, 60))) for i in range(30)] + [(30, None), (31, ""), (0, None)]
    docs = []
    for k in range(200):
        t = say(r.randint(0, 80))
        if k % 3 == 0:
            w = words(items[k % 30][1])
            a, n = r.randrange(max(1, len(w) - 8)), r.randint(8, 16)
            t += " " + ", ".join(w[a : a + n]).upper() + "\n" + say(5)
        docs.append((k, t))
    docs += [(300, None), (301, ""), (302, items[3][1] + " " + "filler " * 50_000), docs[0]]
    d = spark.createDataFrame([(a, b, 0, "x") for a, b in docs], "doc_id long, text string, item_id int, score string")
    i = spark.createDataFrame([(a, b, 0) for a, b in items], "item_id long, text string, doc_id int")
    got = {(x.doc_id, x.item_id) for x in leakage.leaked_passages(d, i).where("longest_run >= 12").collect()}
    assert got == brute([x for x in docs if x[1]], [x for x in items if x[1]])
    blocks = {(x.doc_id, x.item_id) for x in leakage.leaked_passages(d, i, block_items=7).where("longest_run >= 12").collect()}
    assert blocks == got
    assert leakage.leaked_passages(d.limit(0), i).count() == 0
    assert leakage.leaked_passages(d, i.limit(0)).count() == 0


def test_alignment_of_an_edited_copy():
    item = np.arange(1, 31)
    doc = np.concatenate([np.zeros(9, int), item[:10], [99], item[11:20], item[21:], np.zeros(5, int)])
    score, run = leakage.align(item, doc)
    assert run == 10 and score >= 2 * 28 - 2
    assert leakage.align(item, np.zeros(0, int)) == (0, 0)


def test_copies_edited_every_few_words_are_aligned(spark):
    r = random.Random(5)
    items = [(i, [f"w{r.randrange(4000)}" for _ in range(45)]) for i in range(60)]
    docs = []
    for i, w in items:
        step = 8 + i % 3
        copy = [f"edit{i}" if k % step == step - 1 else x for k, x in enumerate(w)]
        docs.append((i, " ".join([f"w{r.randrange(4000)}" for _ in range(30)] + copy)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    t = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.score for x in leakage.leaked_passages(d, t).collect()}
    assert all(got.get((i, i), 0) >= 2 * 45 - 3 * 5 for i in range(60))
    number: dict = {}
    ids = {k: {i: np.array([number.setdefault(x, len(number) + 1) for x in x.split()]) for i, x in side} for k, side in (("d", docs), ("t", [(i, " ".join(w)) for i, w in items]))}
    want = set()
    for a, doc in ids["d"].items():
        for b, item in ids["t"].items():
            score, run = leakage.align(item, doc)
            shares = set(leakage.seed_hashes(item, 5).tolist()) & set(leakage.seed_hashes(doc, 5).tolist())
            if shares and (score >= leakage.LEAST_SHARE * 2 * len(item) or run >= 12):
                want.add((a, b))
    assert set(got) == want


def test_stretches_lose_nothing():
    r = np.random.default_rng(7)
    for _ in range(300):
        item, doc = r.integers(1, 12, r.integers(5, 30)), r.integers(0, 40, r.integers(0, 120))
        if len(doc) > 30:
            doc[10 : 10 + len(item) // 2] = item[: len(item) // 2]
        score, run = leakage.align(item, doc)
        assert leakage.align_parts(item, doc) == (score, run)
        for need in (6, 12, 20):
            got = leakage.align_parts(item, doc, need, 6)
            assert (got[0] == score if score >= need else got[0] <= score) and (got[1] == run if run >= 6 else got[1] <= run)
