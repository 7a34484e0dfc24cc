"""Abusive, hateful and sexually explicit language: noisy-channel restoration of disguised words, then scoring.

A character trigram model is counted over the words of all documents. Spans that look disguised (symbols or digits
among letters, letters set apart, letters repeated, letter sequences the model finds improbable) become character
lattices; Viterbi decoding under the model gives the word most likely meant. Restored sentences are scored by a
logistic model over word n-grams. Its weights are fitted on a bounded sample of human labels by multiple-instance
learning (a label says that some sentence of the document is abusive, not which) and shrink to a fixed lexicon.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.chars import print_form
from folio.session import cut_lineage

#: Labelled documents used for fitting, at most; the sample is the first of a fixed hash order.
MAX_LABELS = 5000
#: Characters of labelled documents used for fitting, at most.
MAX_LABEL_CHARS = 40_000_000
#: An odd word may be restored to any word of this share of all words; so there are 1 / share of them at most.
FREQUENT_SHARE = 5e-6

# Words that are abusive or explicit whatever stands around them, English then French.
STRONG = """
fuck fucks fucked fucker fuckers fucking motherfucker shit shits shitty bullshit shite cunt cunts twat prick wanker
asshole arsehole bollocks slut sluts slutty whore whores whoring scum scumbag subhuman subhumans untermensch
nigger faggot dyke tranny kike spic gook retard retarded moron morons imbecile dickhead bugger buggered cock-sucker whoreson turd arse arse-licker shit-eater
connard connards connasse enculé enculés enculer salope salopes salaud salauds pute putes putain putains merde merdes
merdeux foutre niquer bite couille couilles bordel pédé crétin crétins débile abruti ordure raclure sous-homme
chiennasse trouduc
""".split()
# Words that are abusive, hateful, threatening or explicit in some contexts only.
WEAK = """
vermin rat rats louse lice-ridden worm worms filth filthy pig pigs swine dog dogs mongrel mongrels ape apes dunghill cripple
maggot maggots lice leech parasite parasites animals plague piss halfwit cretin bloodless gutless spineless brainless bootlicking rotten damned hell choke
bastard bitch coward cowards idiot fool stupid worthless disgusting stinking stench devil hanged exterminate exterminated
drown drowned whipped smothered throat kill kills gut rape raped naked breasts thighs lust moaning sweating coupling
undress lick licked kneel strip tits nipples orgasm skirts virgin cock bed vermine rats chien chiens porc porcs cochon bâtard lâche
puant sale crever noyer pendre égorger exterminer chasser bêtes nu nus nue nues seins cuisses gémissant accouplés lécher gorge mort galeux étouffe corde
""".split()
STRONG_WEIGHT, WEAK_WEIGHT, BIAS = 5.0, 1.2, -3.5
#: Log odds below which the best sentence of a document does not bear out its label.
DOUBT = 0.0
#: Score from which a sentence counts as a passage.
PASSAGE = 0.4
#: Share of the abusive documents that must hold a word before it can be a trigger.
TRIGGER_SHARE = 0.005
#: Ridge that holds strong words to their weight.
STRONG_HOLD = 3.0

# What a sign may stand for in a disguised word.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "eé", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
    "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "v": "u", "u": "v", "k": "c", "e": "é", "*": "aeiouéclnrst",
    "#": "aeiouéclnrst", "%": "aeiou", "?": "aeiou",
}
LEXICON = [*STRONG, *WEAK]
LISTED = frozenset(LEXICON)
LISTED_PRIOR = 6.0
SUBSTITUTION, WILD, DROP_MARK, DROP_REPEAT = -1.0, -3.0, -0.3, -1.2
MARKS = " .-_'’·*,"

_L = "A-Za-zÀ-ÖØ-öø-ÿŒœ"
_S = r"0-9@$!|*#€£+%"
_ORDINAL = re.compile(r"\d+(?:st|nd|rd|th|e|er|re|ère|d)", re.I)
_SPACED = re.compile(rf"(?<![{_L}0-9'’])(?:[{_L}{_S}][ .\-_*·]{{1,2}}){{2,}}[{_L}{_S}](?![{_L}0-9'’])")
_MIXED = re.compile(rf"(?<![{_L}{_S}])(?=[{_L}{_S}]*[{_L}])(?=[{_L}{_S}]*[{_S}][{_L}{_S}]*[{_L}]|[{_L}]+[@$0-9*#])[{_L}{_S}]{{3,}}")
_DOTTED = re.compile(rf"[{_L}]{{2,}}[._*·][a-zà-öø-ÿ]{{2,}}")
_DASHED = re.compile(rf"(?<![{_L}-])[{_L}]-{{2,}}[{_L}]*(?![{_L}-])")
_REPEAT = re.compile(rf"[{_L}]*([{_L}])\1\1[{_L}]*")
_ANY_SIGN = re.compile(rf"[{_L}][{_S}._*·]+[{_L}]|[@$][{_L}]|[{_L}][*#@$]|\d[{_L}]{{2}}|([{_L}])\1\1|(?<![{_L}'’])[{_L}{_S}][ .\-_*·]{{1,2}}[{_L}{_S}][ .\-_*·]|--")
_WORD = re.compile(rf"[{_L}]+(?:-[{_L}]+)*")
_PLAIN_WORD = re.compile(r"[a-zà-öø-ÿœ]+")
_SENTENCE = re.compile(r"(?<=[.!?])[\"”»]?\s+|\n{2,}")
_TOKEN = re.compile(rf"[{_L}]+(?:-[{_L}]+)*|\d+")


class CharModel:
    """Interpolated character trigrams; ``^`` starts and ``$`` ends a word."""

    def __init__(self, trigrams: dict[str, int]) -> None:
        self.tri = Counter(trigrams)
        for w, n in [(w, 50) for w in STRONG] + [(w, 20) for w in WEAK]:
            for g in self.grams(w):
                self.tri[g] += n
        self.pair, self.uni = Counter(), Counter()
        self.head, self.head1 = Counter(), Counter()
        for g, n in self.tri.items():
            self.head[g[:2]] += n
            self.pair[g[1:]] += n
            self.head1[g[1]] += n
            self.uni[g[2]] += n
        self.all = sum(self.uni.values()) or 1
        self.memo: dict[str, float] = {}

    @staticmethod
    def grams(word: str) -> list[str]:
        w = f"^^{word}$"
        return [w[i : i + 3] for i in range(len(w) - 2)]

    def logp(self, g: str) -> float:
        p = self.memo.get(g)
        if p is None:
            a = self.tri[g] / self.head[g[:2]] if self.head[g[:2]] else 0.0
            b = self.pair[g[1:]] / self.head1[g[1]] if self.head1[g[1]] else 0.0
            p = self.memo[g] = math.log(0.9 * a + 0.09 * b + 0.01 * self.uni[g[2]] / self.all + 1e-9)
        return p

    def odd(self, word: str) -> bool:
        """Whether some letter of the word is very improbable after the two before it."""
        return any(self.tri[g] < 1e-3 * self.head[g[:2]] for g in self.grams(word))

    def score(self, word: str) -> float:
        return sum(self.logp(g) for g in self.grams(word))

    @staticmethod
    def arcs(low: str, i: int) -> list[tuple[str, float]]:
        """What character ``i`` may stand for, with the channel's log cost; nothing stands for a dropped one."""
        c = low[i]
        out = [(c, 0.0)] if c.isalpha() else []
        out += [(x, WILD if c in "*#%?" else SUBSTITUTION) for x in STANDS_FOR.get(c, "")]
        if c == "-" and "--" in low:
            out += [(x, WILD) for x in STANDS_FOR["*"]]
        if c in MARKS:
            out.append(("", DROP_MARK))
        elif i and c == low[i - 1]:
            out.append(("", DROP_REPEAT))
        return out

    def lexicon_path(self, span: str) -> tuple[float, str]:
        """The best word of the lexicon that is a path through the lattice, and its cost under the channel alone."""
        low, best = span.lower(), (-math.inf, span)
        for word in LEXICON:
            if len(word) > len(low):
                continue
            beam = {0: 0.0}
            for i in range(len(low)):
                after: dict[int, float] = {}
                for at, p in beam.items():
                    for x, cost in self.arcs(low, i):
                        if not x:
                            after[at] = max(after.get(at, -math.inf), p + cost)
                        elif at < len(word) and word[at] == x:
                            after[at + 1] = max(after.get(at + 1, -math.inf), p + cost)
                beam = after
                if not beam:
                    break
            best = max(best, (beam.get(len(word), -math.inf), word))
        return best

    def decode(self, span: str) -> str:
        """The word with the best path through the lattice of what each character may stand for.

        A word of the lexicon competes with a prior of its own, since disguise itself makes such a word likely.
        """
        listed, word = self.lexicon_path(span)
        if listed > -math.inf and len(word) > 2:
            listed += self.score(word) + LISTED_PRIOR
        path, free = self._viterbi(span)
        return word if listed > path else free

    def _viterbi(self, span: str) -> tuple[float, str]:
        beam = {"^^": (0.0, "")}
        low = span.lower()
        for i in range(len(low)):
            arcs = self.arcs(low, i)
            if not arcs:
                return -math.inf, span
            after: dict[str, tuple[float, str]] = {}
            for state, (p, out) in beam.items():
                for x, cost in arcs:
                    s = state[1] + x if x else state
                    q = p + cost + (self.logp(state + x) if x else 0.0)
                    if s not in after or q > after[s][0]:
                        after[s] = (q, out + x)
            beam = after
        return max((p + self.logp(s + "$"), out) for s, (p, out) in beam.items())


class Restorer:
    """Restores disguised words of a text; decisions per distinct span are kept."""

    def __init__(self, model: CharModel, frequent: frozenset[str] = frozenset()) -> None:
        self.model = model
        self.frequent, self.meant = frequent, LISTED | frequent
        self.spans: dict[str, str] = {}
        self.fine: dict[str, bool] = {}

    def span(self, text: str) -> str:
        got = self.spans.get(text)
        if got is None:
            if len(self.spans) > 200_000:
                self.spans.clear()
            got = self.spans[text] = text if _ORDINAL.fullmatch(text) else self.model.decode(text)
        return got

    def _dotted(self, m: re.Match) -> str:
        return re.sub(r"[._*·]", " ", m[0])

    def odd_word(self, word: str) -> bool:
        """Whether a word may be a disguise; a frequent one is what it is, however improbable its letters."""
        got = self.fine.get(word)
        if got is None:
            if len(self.fine) > 500_000:
                self.fine.clear()
            got = self.fine[word] = len(word) > 3 and word not in self.frequent and self.model.odd(word)
        return got

    def restore(self, text: str) -> tuple[str, set[str]]:
        """(restored text, its words): as it reads in print, with disguised spans replaced by the words meant."""
        text = print_form(text)
        if _ANY_SIGN.search(text):
            text = _SPACED.sub(lambda m: self.span(m[0]), text)
            text = _MIXED.sub(lambda m: self.span(m[0]), text)
            text = _DOTTED.sub(self._dotted, text)
            text = _DASHED.sub(lambda m: self.span(m[0]), text)
            text = _REPEAT.sub(lambda m: self.span(m[0]), text)
        found = set(_PLAIN_WORD.findall(text.lower()))
        odd = [w for w in found if self.odd_word(w)]
        if odd:
            swap = {w: r for w in odd if (r := self.span(w)) != w and r in self.meant and self.model.score(r) > self.model.score(w)}
            if swap:
                text = _WORD.sub(lambda m: swap.get(m[0].lower(), m[0]), text)
                found = (found - swap.keys()) | set(swap.values())
        return text, found


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(text) if s and s.strip()]


def tokens(sentence: str, common: set[str]) -> list[str]:
    """Lower-cased words; numbers are ``<d>``; capitalised words inside a sentence, and uncommon ones, are ``<n>``."""
    shouted = sentence.isupper()
    out = []
    for i, w in enumerate(_TOKEN.findall(sentence)):
        low = w.lower()
        if w[0].isdigit():
            out.append("<d>")
        elif w[0].isupper() and (low not in common if shouted or not i else True):
            out.append("<n>")
        else:
            out.append(low)
    return out


def common_words(texts: list[list[str]]) -> set[str]:
    """Words that stand in lower case somewhere in the sample, and the lexicon."""
    return {w for ss in texts for s in ss for w in _TOKEN.findall(s) if w[0].islower()} | set(LEXICON)


def features(tok: list[str]) -> set[str]:
    pairs = [f"{a} {b}" for a, b in zip(tok, tok[1:], strict=False)]
    triples = [f"{a} {b}" for a, b in zip(pairs, tok[2:], strict=False)]
    return {*tok, *pairs, *triples}


def prior() -> dict[str, float]:
    return dict.fromkeys(WEAK, WEAK_WEIGHT) | dict.fromkeys(STRONG, STRONG_WEIGHT)


def fit(labelled: list[tuple[list[str], int]], common: set[str], rounds: int = 8, ridge: float = 0.25) -> tuple[dict[str, float], set[str]]:
    """(weights, triggers) from (restored sentences, label) of documents; without labels the lexicon alone.

    Triggers are the lexicon and the words much more frequent in documents labelled abusive than in others. Weights are
    learned from sentences with a trigger and hold for them; any other sentence scores the bias, the model's prior.
    """
    base = prior()
    docs = [([tokens(s, common) for s in ss], y) for ss, y in labelled]
    seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for toks, y in docs:
        seen[y].update({w for t in toks for w in t if w[0] != "<"})
    n = {y: sum(1 for _, z in docs if z == y) for y in (0, 1)}
    triggers = set(base)
    enough = max(2, round(TRIGGER_SHARE * n[1]))  # a rare word is in abusive documents only by chance
    for w, k in seen[1].items():
        if k >= enough and (k / max(n[1], 1)) > 6 * (seen[0][w] + 0.5) / (n[0] + 1):
            triggers.add(w)
    bags = []
    for toks, y in docs:
        kept = [features(t) for t in toks if not triggers.isdisjoint(t)]
        if kept:
            bags.append((kept, y))
    names = Counter(f for kept, _ in bags for s in kept for f in s)
    least = 2 if len(bags) < 300 else 3
    index = {f: i + 1 for i, f in enumerate(sorted(f for f, c in names.items() if c >= least or f in base))}
    w0 = np.zeros(len(index) + 1)
    w0[0] = BIAS
    for f, v in base.items():
        if f in index:
            w0[index[f]] = v
    rows = [([np.array([index[f] for f in s if f in index], dtype=np.int64) for s in kept], y) for kept, y in bags]
    # a single wrong label must not outweigh what is known of a word: the lexicon is held to its weights
    hold = np.full(len(w0), ridge)
    for f, v in base.items():
        if f in index:
            hold[index[f]] = STRONG_HOLD if v >= STRONG_WEIGHT else ridge
    w = w0.copy()
    for r in range(rounds if rows else 0):
        x, y = [], []
        for kept, label in rows:
            z = [w[0] + w[i].sum() for i in kept]
            if label:
                best = int(np.argmax(z))
                if r > 1 and z[best] < DOUBT:
                    continue  # a label that no sentence bears out is taken for a wrong one
                x.append(kept[best])
                y.append(1.0)
            else:
                clean = [i for i, v in zip(kept, z, strict=True) if r < 2 or v <= -DOUBT + 1]  # nor one plainly refuted
                x += clean
                y += [0.0] * len(clean)
        if not x:
            break
        flat, owner, y = np.concatenate(x), np.repeat(np.arange(len(x)), [len(i) for i in x]), np.array(y)
        weight = np.where(y > 0, max(1.0, 0.5 * (len(y) - y.sum()) / max(y.sum(), 1)), 1.0)
        step = np.zeros_like(w)
        for k in range(150):
            z = np.bincount(owner, w[flat], len(x)) + w[0]
            g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
            grad = np.bincount(flat, g[owner], len(w)) + hold * (w - w0)
            grad[0] = g.sum() + ridge * (w[0] - w0[0])
            step += grad * grad
            w = w - 0.3 * grad / (np.sqrt(step) + 1e-6)
    weights = base | {f: float(w[i]) for f, i in index.items()}
    weights["<bias>"] = float(min(w[0], -1.0))
    return weights, triggers


def score_sentence(tok: list[str], weights: dict[str, float]) -> float:
    z = weights["<bias>"] + sum(weights.get(f, 0.0) for f in features(tok))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def corpus_words(docs: DataFrame, text: str) -> DataFrame:
    """(w, n): the words of all documents and their counts; each task counts for itself before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: Counter = Counter()
        for b in batches:
            for t in b[text]:
                if t:
                    c.update(_PLAIN_WORD.findall(t.lower()))
            if len(c) > 300_000:
                yield pd.DataFrame({"w": list(c.keys()), "n": np.array(list(c.values()), dtype="int64")})
                c = Counter()
        if c:
            yield pd.DataFrame({"w": list(c.keys()), "n": np.array(list(c.values()), dtype="int64")})

    return docs.select(text).mapInPandas(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))


def char_trigrams(counted: DataFrame) -> dict[str, int]:
    """Character trigram counts of counted words; the alphabet bounds the result (about 50 letters)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: Counter = Counter()
        for b in batches:
            for w, n in zip(b["w"], b["n"], strict=True):
                for g in CharModel.grams(w):
                    c[g] += int(n)
        if c:
            yield pd.DataFrame({"g": list(c.keys()), "n": np.array(list(c.values()), dtype="int64")})

    return {r["g"]: r["n"] for r in counted.mapInPandas(run, "g string, n long").groupBy("g").agg(F.sum("n").alias("n")).collect()}


def score_documents(
    docs: DataFrame,
    labels: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    keep: tuple[str, ...] = (),
    max_labels: int = MAX_LABELS,
    max_chars: int = MAX_LABEL_CHARS,
) -> DataFrame:
    """(doc_id, *keep, score, passages, worst): the score of each document's worst sentence, and that sentence.

    ``passages`` counts sentences scoring ``PASSAGE`` or more. ``worst`` is null where no sentence holds a trigger; such
    a document scores what the bias gives. Null and empty texts score 0. Every row of the table gives a
    row, repeated ones too. ``labels`` may be empty (the lexicon alone scores then); of several labels of a document
    the majority counts, ties as abusive. At most ``max_labels`` labelled documents, and ``max_chars`` of
    their characters, are used for fitting. The
    columns ``doc_id``, ``text`` and ``keep`` of the documents are read; clashing names in ``labels`` do not matter.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *keep)
    counted = cut_lineage(corpus_words(slim, "text"))
    model = CharModel(char_trigrams(counted))
    all_words = counted.agg(F.sum("n")).collect()[0][0] or 0
    frequent = frozenset(r["w"] for r in counted.where(F.col("n") >= max(FREQUENT_SHARE * all_words, 2)).select("w").collect())
    votes = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null")
    sample = votes.groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels)
    known = slim.select("doc_id", "text").where("text <> ''").join(sample, "doc_id").dropDuplicates(["doc_id"])
    up_to = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # of the bounded sample
    known = known.withColumn("chars", F.sum(F.length("text")).over(up_to)).where(F.col("chars") <= max_chars).select("text", "y").collect()
    restorer = Restorer(model, frequent)
    sample_texts = [sentences(restorer.restore(r["text"])[0]) for r in known]
    common = common_words(sample_texts)
    weights, triggers = fit([(t, r["y"]) for t, r in zip(sample_texts, known, strict=True)], common)
    shared = spark.sparkContext.broadcast((model, frequent, weights, triggers, common))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, frequent, weights, triggers, common = shared.value
        restorer = Restorer(model, frequent)
        floor = score_sentence([], weights)
        plain = {p for w in triggers for p in w.split("-")}
        for b in batches:
            best, count, worst = np.zeros(len(b)), np.zeros(len(b), dtype="int64"), [None] * len(b)
            for i, t in enumerate(b["text"]):
                if not t:
                    continue
                best[i] = floor
                restored, found = restorer.restore(t)
                if found.isdisjoint(plain):
                    continue
                for s in sentences(restored):
                    tok = tokens(s, common)
                    if triggers.isdisjoint(tok):
                        continue
                    p = score_sentence(tok, weights)
                    count[i] += p >= PASSAGE
                    if p > best[i]:
                        best[i], worst[i] = p, s
            out = b.drop(columns="text")
            out["score"], out["passages"], out["worst"] = np.round(best, 6), count, worst
            yield out

    kept = "".join(f", {c} {slim.schema[c].dataType.simpleString()}" for c in keep)
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInPandas(run, f"doc_id {kind}{kept}, score double, passages long, worst string")


def rates(scored: DataFrame, source: str) -> DataFrame:
    """(source, documents, flagged, rate): the share of documents with a passage, per source."""
    return (
        scored.groupBy(source)
        .agg(F.count("*").alias("documents"), F.sum(F.when(F.col("passages") > 0, 1).otherwise(0)).alias("flagged"))
        .withColumn("rate", F.round(F.col("flagged") / F.col("documents"), 6))
    )
