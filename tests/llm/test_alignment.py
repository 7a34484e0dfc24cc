import random

import numpy as np

from folio.llm import alignment

FR = ["Le pont de {0} est tenu par {1} hommes.", "Envoyez {1} chevaux à {0}.", "Le moulin de {0} fut brûlé le {1} mai.", "Nous passerons à {0} avec {1} canons."]
EN = ["The bridge of {0} is held by {1} men.", "Send {1} horses to {0}.", "The mill of {0} was burnt on the {1} of May.", "We shall cross at {0} with {1} cannon."]


def made(n=60):
    r = random.Random(4)
    rows, want = [], {}
    for k in range(n):
        picks = [(r.randrange(4), f"Vil{r.randrange(400)}".replace("0", "a") + "ac", r.randrange(20, 900)) for _ in range(r.randint(3, 7))]
        picks = [(t, "V" + "".join(chr(97 + int(c)) for c in str(i * 37 + k)) + "ac", m) for i, (t, _, m) in enumerate(picks)]
        fr = [FR[t].format(p, m) for t, p, m in picks]
        order = list(range(len(picks)))
        if k % 4 == 0:
            order.pop(1)
        if k % 5 == 0:
            order[0], order[1] = order[1], order[0]
        en = [EN[picks[i][0]].format(picks[i][1], picks[i][2]) for i in order]
        pairs = {(i + 1, j + 1) for j, i in enumerate(order)}
        if k % 6 == 1:
            en[0] = en[0][:-1] + "; " + en.pop(1)
            pairs = {(i + 1, max(1, j)) for j, i in enumerate(order)}
        rows.append((f"r{k}", " ".join(fr), "“" + " ".join(en) + " […]”"))
        want[f"r{k}"] = pairs
    return rows, want


def test_pairs(spark):
    rows, want = made()
    extra = [("null", None, "x"), ("empty", "", "x"), ("r0", rows[0][1], rows[0][2]), (None, "a.", "a."), ("long", "Le pont est là. " * 400, "The bridge is there. " * 400)]
    df = spark.createDataFrame([(*r, 1, "y") for r in rows + extra], "id string, fr string, en string, s int, t string")
    words = spark.createDataFrame([("pont", "bridge"), (None, "x")], "fr_term string, en_term string")
    got: dict = {}
    for r in alignment.align(df, "id", "fr", "en", words).collect():
        got.setdefault(r.rec_key, set()).add((r.source_no, r.target_no))
    hit = sum(len(got.get(k, set()) & w) for k, w in want.items())
    assert hit >= 0.97 * sum(map(len, want.values())) and hit >= 0.97 * sum(len(v) for k, v in got.items() if k in want)
    assert "null" not in got and "empty" not in got
    assert alignment.align(df.limit(0), "id", "fr", "en").count() == 0


def test_sentences():
    assert alignment.split_sentences("“One. Two 1.500 men! Three”") == ["“One.", "Two 1.500 men!", "Three”"]
    assert alignment.split_sentences("One. […]”") == ["One."]
    assert alignment.split_sentences(None) == alignment.split_sentences("") == []


def test_a_word_left_out_of_the_counts_weighs_the_same_at_every_size():
    weights = [alignment.Lexicon({}, {}, n, n, {}).weight("rare", side) for n in (10_000, 25_694, 2_569_400) for side in (False, True)]
    assert max(weights) - min(weights) < 1e-9
    assert abs(alignment.Lexicon({}, {}, 3_000, 3_000, {}).weight("once", True) - np.log(3_001)) < 1e-9
