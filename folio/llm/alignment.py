"""Pairs of sentences that translate one another in bilingual records.

Each sentence of the target text is emitted by a state of a hidden Markov model. States are the sentences of the
source text, spans of two or three of them (for sentences joined in translation) and the null state (for sentences
without counterpart); jumps between states have a probability by distance, so reordering is possible and costs.
Emissions come from identical words (names, numbers) and a bilingual lexicon. The lexicon is counted over the whole
corpus in sentence pairs found by names and numbers alone, and completed by a given partial word list.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.chars import print_form

#: Entries of lexicon and word statistics have at least this count, and words this share of all sentences. A sentence
#: has some 20 words, so at most 20 / SHARE words pass, whatever the corpus; that bounds what is broadcast.
LEAST_COUNT, SHARE, LEAST_DICE = 2, 0.0005, 0.08
#: Emission of a state: SCALE * (similarity - NULL_SIMILARITY); null emits at 0.
SCALE, NULL_SIMILARITY = 12.0, 0.52
#: Source sentences of a state, from its first one: one, or two or three that may have an omitted one between them.
SHAPES = ((0,), (0, 1), (0, 2), (0, 3), (0, 1, 2), (0, 1, 3), (0, 2, 3))
SAME, FAR, PER_STEP, WINDOW, SPAN_COST = -1.0, -2.2, -0.12, 8, -0.6

# Numbers written as words.
NUMBER_WORDS = {
    w: str(i + 1)
    for line in (
        "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty",
        "un deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize dix-sept dix-huit dix-neuf vingt",
    )
    for i, w in enumerate(line.split())
    if w not in ("one", "un")
}
_END = re.compile(r"(?<=[.!?])[\"”»’']*\s+")
_CLOSING = re.compile(r"[\s\"”»’]*\[\s*(?:…|\.{3})\s*\][\s\"”»’]*$")
_TOKEN = re.compile(r"\d+(?:[.,]\d{3})*|[^\W\d_]+(?:-[^\W\d_]+)*")
_ORDINAL_ENDS = {"st", "nd", "rd", "th", "e", "er", "re"}


def split_sentences(text: str | None) -> list[str]:
    """Sentences in order: they end at . ! or ? before a space or the end; a closing […] is none."""
    if not text:
        return []
    body = _CLOSING.sub("", print_form(text)).strip()
    out: list[str] = []
    for piece in _END.split(body):
        if re.search(r"\w", piece):
            out.append(piece)
        elif out:
            out[-1] += piece
    return out


def sentence_words(sentence: str) -> tuple[list[str], set[str]]:
    """(words folded to lower case without accents, those that are numbers or capitalised inside the sentence)."""
    words, anchors, digits = [], set(), False
    for i, m in enumerate(_TOKEN.finditer(sentence)):
        raw = m[0]
        low = raw.lower()
        if digits and low in _ORDINAL_ENDS:
            digits = False
            continue
        digits = raw[0].isdigit()
        w = re.sub(r"[.,]", "", raw) if digits else NUMBER_WORDS.get(low, low)
        w = "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c))
        words.append(w)
        if w[0].isdigit() or (i and raw[0].isupper()):
            anchors.add(w)
    return words, anchors


def seed_pairs(source: list[set[str]], target: list[set[str]]) -> list[tuple[int, int]]:
    """Pairs that are each other's best by names and numbers and share at least half of them."""
    owners = defaultdict(list)
    for i, a in enumerate(source):
        for w in a:
            owners[w].append(i)
    score: Counter = Counter()
    for j, a in enumerate(target):
        for w in a:
            for i in owners.get(w, ()):
                score[i, j] += 1
    dice = {(i, j): 2 * n / (len(source[i]) + len(target[j])) for (i, j), n in score.items()}
    best_i, best_j = {}, {}
    for (i, j), d in dice.items():
        if d > best_i.get(i, (0, 0))[0]:
            best_i[i] = (d, j)
        if d > best_j.get(j, (0, 0))[0]:
            best_j[j] = (d, i)
    return [(i, j) for i, (d, j) in best_i.items() if d >= 0.5 and best_j[j][1] == i]


def _statistics(rows: DataFrame) -> DataFrame:
    """(f, e, n): sentences with source word f (e null), with target word e (f null), seed pairs with both."""

    def flush(c: Counter) -> pd.DataFrame:
        return pd.DataFrame([(*k, n) for k, n in c.items()], columns=["k", "f", "e", "n"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: Counter = Counter()
        for b in batches:
            for s, t in zip(b["s"], b["t"], strict=True):
                src = [sentence_words(x) for x in split_sentences(s)]
                tgt = [sentence_words(x) for x in split_sentences(t)]
                for name, side in (("df", src), ("de", tgt)):
                    c[name, "", ""] += len(side)
                    for w, _ in side:
                        for x in set(w):
                            c[(name, x, "") if name == "df" else (name, "", x)] += 1
                for i, j in seed_pairs([a for _, a in src], [a for _, a in tgt]):
                    fs, es = set(src[i][0]) - src[i][1], set(tgt[j][0]) - tgt[j][1]
                    for f in fs:
                        c["pf", f, ""] += 1
                        for e in es:
                            c["pp", f, e] += 1
                    for e in es:
                        c["pe", "", e] += 1
                if len(c) > 400_000:
                    yield flush(c)
                    c = Counter()
        yield flush(c)

    return rows.mapInPandas(run, "k string, f string, e string, n long").groupBy("k", "f", "e").agg(F.sum("n").alias("n"))


class Lexicon:
    """Word weights of both languages and likeness of word pairs."""

    def __init__(self, df: dict, de: dict, nf: int, ne: int, dice: dict) -> None:
        self.nf, self.ne = max(nf, 1), max(ne, 1)
        self.df, self.de = df, de
        self.by_target = defaultdict(list)
        for (f, e), d in dice.items():
            self.by_target[e].append((f, d))

    def weight(self, word: str, target: bool) -> float:
        n, counts = (self.ne, self.de) if target else (self.nf, self.df)
        # a word left out for its share counts as much as the share, so that its weight is the same at every size
        left_out = SHARE * n if SHARE * n > LEAST_COUNT else 1
        return math.log(1 + n / counts.get(word, left_out))


def similarities(source: list[list[str]], target: list[list[str]], lex: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(match_t, weight_t, match_s, weight_s): matched weight of each target sentence by each source sentence, and back."""
    n, m = len(source), len(target)
    owners = defaultdict(list)
    ws = np.zeros(n)
    for i, words in enumerate(source):
        for f in set(words):
            owners[f].append(i)
            ws[i] += lex.weight(f, False)
    mt, ms, wt = np.zeros((n, m)), np.zeros((n, m)), np.zeros(m)
    for j, words in enumerate(target):
        back: dict[tuple[int, str], float] = {}
        for e in set(words):
            w = lex.weight(e, True)
            wt[j] += w
            hit: dict[int, float] = {}
            for f, d in [(e, 1.0), *lex.by_target.get(e, ())]:
                v = min(1.0, 1.6 * d)
                for i in owners.get(f, ()):
                    hit[i] = max(hit.get(i, 0.0), v)
                    back[i, f] = max(back.get((i, f), 0.0), v)
            for i, v in hit.items():
                mt[i, j] += w * v
        for (i, f), v in back.items():
            ms[i, j] += lex.weight(f, False) * v
    return mt, wt, ms, ws


def decode(source: list[list[str]], target: list[list[str]], lex: Lexicon) -> list[tuple[int, int]]:
    """(source number, target number) from 0 of the most probable state sequence, by Viterbi."""
    n, m = len(source), len(target)
    if not n or not m:
        return []
    mt, wt, ms, ws = similarities(source, target, lex)
    emit = np.full((len(SHAPES), n, m), -np.inf)  # by shape and first source sentence
    share_s = ms / np.maximum(ws[:, None], 1e-9)
    for k, shape in enumerate(SHAPES):
        r = n - shape[-1]
        if r <= 0:
            continue
        rows = [slice(x, x + r) for x in shape]
        t = np.minimum(sum(mt[x] for x in rows), wt) / np.maximum(wt, 1e-9)
        sim = 0.5 * (t + sum(ms[x] for x in rows) / np.maximum(sum(ws[x] for x in rows), 1e-9)[:, None])
        emit[k, :r] = SCALE * (sim - NULL_SIMILARITY)
        if len(shape) > 1:  # every part of a span must bring something of its own
            weak = (np.minimum.reduce([share_s[x] for x in rows]) < 0.45) | (np.minimum.reduce([mt[x] for x in rows]) < 0.12 * wt)
            emit[k, :r] += SPAN_COST
            emit[k, :r][weak] = -np.inf
    # best[e]: best score of paths whose last source sentence is e - 1; 0 stands for none so far
    best = np.full(n + 1, -np.inf)
    best[0] = 0.0
    steps = np.arange(-WINDOW, WINDOW + 1)
    # column w of the padded scores seen from source sentence i is the end i + 1 - step, for steps from the last to the first
    step_cost = np.where(steps == 0, SAME, PER_STEP * np.abs(steps - 1))[::-1]
    width = len(steps)
    ends = np.array([shape[-1] for shape in SHAPES])
    back: list[tuple[np.ndarray, np.ndarray]] = []
    for j in range(m):
        padded = np.concatenate([np.full(WINDOW, -np.inf), best[1:], np.full(WINDOW, -np.inf)])
        padded[WINDOW - 1] = best[0]
        seen = np.lib.stride_tricks.sliding_window_view(padded, width) + step_cost
        pick = width - 1 - np.argmax(seen[:, ::-1], axis=1)  # of equals the one with the least step
        near = seen[np.arange(n), pick]
        far = best.max() + FAR
        enter = np.maximum(near, far)
        origin = np.where(near > far, np.arange(n) + 1 - steps[::-1][pick], int(best.argmax()))
        value = enter[None, :] + emit[:, :, j]
        arrive = np.full((len(SHAPES), n), -np.inf)
        for k, e in enumerate(ends):
            arrive[k, e:] = value[k, : n - e]
        shape_of = arrive.argmax(axis=0)
        top = arrive[shape_of, np.arange(n)]
        better = top > best[1:]  # the null state leaves the place in the source as it is
        after = best.copy()
        after[1:][better] = top[better]
        first = np.maximum(np.arange(n) - ends[shape_of], 0)
        state = np.full(n + 1, -1)
        state[1:][better] = (shape_of * n + first)[better]
        came = np.arange(n + 1)
        came[1:][better] = origin[first][better]
        back.append((state, came))
        best = after
    at, out = int(best.argmax()), []
    for j in range(m - 1, -1, -1):
        state, came = back[j]
        s, at = int(state[at]), int(came[at])
        if s >= 0:
            out += [(s % n + x, j) for x in SHAPES[s // n]]
    return sorted(out)


def align(df: DataFrame, key: str, source: str, target: str, word_list: DataFrame | None = None) -> DataFrame:
    """(rec_key, source_no, target_no): sentence pairs of every record, numbered from 1.

    ``word_list`` has the columns fr_term and en_term (any two languages); terms of several words count by their
    words. A null or empty text on either side gives no pairs; rows repeated with key and texts count once; records
    delivered with different texts give the pairs of each; rows with a null key are left out. Empty tables give an
    empty result; other columns are not read.
    """
    rows = (
        df.select(F.col(key).cast("string").alias("rec_key"), F.col(source).alias("s"), F.col(target).alias("t"))
        .where("rec_key is not null and s <> '' and t <> ''")
        .distinct()
    )
    spark = df.sparkSession
    # decoding costs far more than moving the texts: spread them over all cores, however few bytes they are
    rows = rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    stats = _statistics(rows).cache()
    totals = {r["k"]: r["n"] for r in stats.where("f = '' and e = ''").collect()}
    nf, ne = totals.get("df", 0), totals.get("de", 0)
    floor_f, floor_e = max(LEAST_COUNT, SHARE * nf), max(LEAST_COUNT, SHARE * ne)
    df_rows = stats.where((F.col("k") == "df") & (F.col("f") != "") & (F.col("n") >= floor_f)).select("f", "n").collect()
    de_rows = stats.where((F.col("k") == "de") & (F.col("e") != "") & (F.col("n") >= floor_e)).select("e", "n").collect()
    pf = stats.where((F.col("k") == "pf") & (F.col("n") >= floor_f)).select("f", F.col("n").alias("a"))
    pe = stats.where((F.col("k") == "pe") & (F.col("n") >= floor_e)).select("e", F.col("n").alias("b"))
    pairs = stats.where((F.col("k") == "pp") & (F.col("n") >= LEAST_COUNT)).select("f", "e", "n").join(pf, "f").join(pe, "e")
    dice = 2 * F.col("n") / (F.col("a") + F.col("b"))
    lexicon = {(r["f"], r["e"]): r["d"] for r in pairs.select("f", "e", dice.alias("d")).where(F.col("d") >= LEAST_DICE).collect()}
    stats.unpersist()
    if word_list is not None:
        for r in word_list.select("fr_term", "en_term").where("fr_term is not null and en_term is not null").collect():
            for f in sentence_words(r["fr_term"].lower())[0]:
                for e in sentence_words(r["en_term"].lower())[0]:
                    if len(f) > 3 and len(e) > 2:
                        lexicon[f, e] = max(lexicon.get((f, e), 0.0), 0.6)
    shared = spark.sparkContext.broadcast(Lexicon({r["f"]: r["n"] for r in df_rows}, {r["e"]: r["n"] for r in de_rows}, nf, ne, lexicon))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex = shared.value
        for b in batches:
            out = []
            for k, s, t in zip(b["rec_key"], b["s"], b["t"], strict=True):
                src = [sentence_words(x)[0] for x in split_sentences(s)]
                tgt = [sentence_words(x)[0] for x in split_sentences(t)]
                out += [(k, i + 1, j + 1) for i, j in decode(src, tgt, lex)]
            yield pd.DataFrame(out, columns=["rec_key", "source_no", "target_no"])

    return rows.mapInPandas(run, "rec_key string, source_no long, target_no long").distinct()
