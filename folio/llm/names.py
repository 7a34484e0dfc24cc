"""Linking names typed by people to the entries of a directory, however they are spelled.

Candidates come from min-hash banding over padded q-grams of name parts; the number of bands follows from the wanted
recall at the least similar typo. A candidate is verified by Monge-Elkan similarity: every content word of the
mention must have a counterpart among the entry's words, initials, ranks and titles. Mentions are then clustered in
stars whose centres are the entries: each mention joins its most similar centre. A surname that is itself frequent
and differs from every entry is a centre of its own, so people who are not listed are not drawn to a similar name.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.chars import print_form
from folio.session import cut_lineage

# Ranks and the ways people shorten them.
RANKS = {
    "colonel": "col colnl colo", "captain": "capt cptn cpt", "general": "gen genl", "admiral": "adm adml", "major": "maj majr",
    "minister": "min minr", "marshal": "mshl marsh marechal mar", "commissary": "comy commiss comm", "madame": "mme lady citizeness mrs",
}
# Forms of address that go with any man, and words that name nobody.
MALE = {"m", "mr", "citizen", "monsieur", "sir"}
FEMALE = {"mme", "madame", "lady", "citizeness", "mrs", "citoyenne"}
EMPTY = {"to", "the", "of", "de", "his", "her", "grace", "excellency", "a", "monseigneur", "and", "for", "du", "la", "le", "des"}
NOBILITY = {"duke", "duchess", "count", "countess", "earl", "baron", "baroness", "prince", "princess", "marquis", "viscount"}
#: Least likeness of any identifying word, of a surname or seat that anchors a link, of any other word, of an office.
LEAST_PART, LEAST_ANCHOR, LEAST_WORD, LEAST_OFFICE = 0.74, 0.81, 0.7, 0.86
QGRAM, ROWS, TYPO_SIMILARITY, RECALL = 2, 2, 0.4, 0.995

_SPLIT = re.compile(r"[\s,.;:()\"“”]+")


def fold(text: str) -> str:
    """Lower case without accents, as printed."""
    t = unicodedata.normalize("NFKD", print_form(text).casefold())
    return "".join(c for c in t if not unicodedata.combining(c))


def parts(text: str) -> list[str]:
    return [w for w in _SPLIT.split(fold(text)) if w]


def blocking_parts(text: str) -> list[str]:
    """The words long enough to identify somebody, and neighbours joined (a space may have got into a name)."""
    w = [x for x in parts(text) if x not in EMPTY]
    return sorted({x for x in w if len(x) > 3} | {a + b for a, b in zip(w, w[1:], strict=False) if len(a + b) > 4})


@lru_cache(maxsize=500_000)
def likeness(a: str, b: str) -> float:
    """1 less the share of edits (insertion, deletion, substitution, swap) in the longer of two words."""
    if a == b:
        return 1.0
    n, m = len(a), len(b)
    if abs(n - m) > (1 - LEAST_WORD) * max(n, m) or not n or not m:
        return 0.0  # below every threshold, whatever the letters
    two, one = None, list(range(m + 1))
    for i in range(1, n + 1):
        row = [i] + [0] * m
        for j in range(1, m + 1):
            c = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                c = min(c, two[j - 2] + 1)
            row[j] = c
        two, one = one, row
    return 1 - one[m] / max(n, m)


def monge_elkan(a: list[str], b: list[str], similar=likeness) -> float:
    """Mean over the words of ``a`` of the best similarity to a word of ``b``."""
    return sum(max((similar(x, y) for y in b), default=0.0) for x in a) / len(a) if a else 0.0


def bands_for(similarity: float, rows: int, recall: float) -> int:
    """The number of bands whose collision curve reaches ``recall`` at ``similarity``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def qgram_bands(word: str, bands: int, rows: int = ROWS, q: int = QGRAM) -> list[int]:
    w = f"{'<' * (q - 1)}{word}{'>' * (q - 1)}"
    x = np.array([xxhash.xxh64_intdigest(w[i : i + q]) for i in range(len(w) - q + 1)], dtype=np.uint64)
    seeds = (np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    h = x[:, None] * seeds
    h = ((h ^ (h >> np.uint64(31))) * np.uint64(0xC4CEB9FE1A85EC53)).min(axis=0).reshape(bands, rows)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        out = (out * np.uint64(1000003)) ^ h[:, r]
    return out.view(np.int64).tolist()


def _with_bands(words: DataFrame, bands: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"word": b["word"], "bands": [qgram_bands(w, bands) for w in b["word"]]})

    return words.mapInPandas(run, "word string, bands array<long>").select("word", F.explode("bands").alias("band"))


class Entry:
    """The words of one directory entry by which a mention may call it."""

    def __init__(self, kind, full_name, rank, title, nickname, short_for) -> None:
        name = parts(full_name or "")
        self.office = kind == "office" or not name
        self.words = [w for w in name if w not in EMPTY]
        if self.office:
            return
        *given, self.surname = name
        self.given = [*given, *parts(nickname or ""), *(short_for or [])]
        self.initials = {g[0] for g in self.given}
        self.rank = fold(rank or "")
        self.rank_forms = {self.rank, *RANKS.get(self.rank, "").split()} - {""}
        t = parts(title or "")
        self.noble = t[0] if t else ""
        self.place = "".join(w for w in t[1:] if w not in EMPTY)


def _office(mention: list[str], entry: Entry) -> float:
    def near(a: str, b: str) -> float:
        short = 0.92 if 2 < len(a) < len(b) and b.startswith(a) else 0.0
        return max(likeness(a, b), short)

    m = [w for w in mention if w not in EMPTY]
    joined = [a + b for a, b in zip(m, m[1:], strict=False)]
    back = monge_elkan(entry.words, m + joined, lambda a, b: near(b, a))
    there = monge_elkan(m, entry.words, near) if back < 0.99 else max(monge_elkan(m, entry.words, near), LEAST_OFFICE * (len(m) <= len(entry.words)))
    least = min((max(near(b, a) for b in m + joined) for a in entry.words), default=0.0) if m else 0.0
    return back if least >= LEAST_PART and (there >= LEAST_OFFICE or len(m) > len(entry.words)) else 0.0


def verify(mention: list[str], entry: Entry) -> float:
    """Monge-Elkan similarity of the mention to the entry, 0 if a word of it contradicts the entry."""
    if entry.office:
        return _office(mention, entry)
    best = 0.0
    # a space may have got into any word: also try the mention with one pair of neighbours joined
    tries = [mention] + [[*mention[:i], mention[i] + mention[i + 1], *mention[i + 2 :]] for i in range(len(mention) - 1)]
    for k, words in enumerate(tries):
        sims, anchor, noble, exact = [], 0.0, False, 0
        place = 0.0
        lady = entry.rank == "madame"
        for w in words:
            if w in EMPTY:
                continue
            if w in FEMALE:
                sims.append(1.0 if lady else 0.0)
                continue
            if w in MALE and w != "m":
                sims.append(0.0 if lady else 0.95)
                continue
            if w == "m":
                sims.append(0.95 if not lady or "m" in entry.initials else 0.0)
                continue
            if len(w) == 1:
                sims.append(0.9 if w in entry.initials else 0.0)
                continue
            if w in entry.rank_forms:
                sims.append(1.0)
                continue
            options = [likeness(w, g) for g in entry.given]
            s = likeness(w, entry.surname)
            if s >= LEAST_ANCHOR and s > anchor:
                anchor = s
            options.append(s)
            if entry.noble:
                t = likeness(w, entry.noble)
                noble |= t >= LEAST_PART
                p = likeness(w, entry.place.replace("-", "")) if "-" not in w else likeness(w, entry.place)
                p = max(p, likeness(w, entry.place))
                place = max(place, p)
                options += [t, p]
            if entry.rank:
                options += [likeness(w, r) for r in entry.rank_forms if len(r) > 4]
            sims.append(max(options))
        if not sims or min(sims) < LEAST_WORD:
            continue
        if noble and place >= LEAST_ANCHOR:
            anchor = max(anchor, place)
        if anchor < LEAST_ANCHOR:
            continue
        exact = anchor == 1.0
        best = max(best, sum(sims) / len(sims) + 0.5 * anchor + 0.01 * len(sims) + 0.02 * exact - 0.02 * (k > 0))
    return best


def best_entries(mention: str, candidates: list[dict]) -> list[tuple[int, float]]:
    """The star centres a mention may belong to: the best verified entries and their scores, equals included."""
    words = parts(mention)
    scored = []
    for c in candidates:
        e = Entry(c["kind"], c["full_name"], c["rank_name"], c["title_name"], c["nickname"], c["short_for"])
        s = verify(words, e)
        if s > 0:
            scored.append((round(s, 3), c["person_id"]))
    top = max((s for s, _ in scored), default=0.0)
    return sorted((p, s) for s, p in scored if s >= top - 0.015)


def link_mentions(mentions: DataFrame, directory: DataFrame, *, own_centre: int = 8, own_share: float = 0.25) -> DataFrame:
    """(mention, person_id): each distinct mention that calls an entry of the directory.

    ``mentions`` has the columns mention and n (how often it is found). A word that occurs at least ``own_centre``
    times, and ``own_share`` as often as the similar word of the directory, is no typo of it. Entries that fit a
    mention equally well (relatives) are decided by which is called more often without doubt, then by the lower id.
    Null and empty mentions give nothing; repeated entries count once; empty tables give an empty result.
    """
    people = directory.where("person_id is not null").dropDuplicates(["person_id"])
    first = F.lower(F.element_at(F.split("full_name", " "), 1))
    short = people.where("nickname is not null").select(first.alias("g"), F.lower("nickname").alias("n")).groupBy("g").agg(F.sort_array(F.collect_set("n")).alias("short_for"))
    people = people.withColumn("g", first).join(short, "g", "left").select("person_id", "kind", "full_name", "rank_name", "title_name", "nickname", "short_for")
    bands = bands_for(TYPO_SIMILARITY, ROWS, RECALL)

    def entry_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, kind, name, title in zip(b["person_id"], b["kind"], b["full_name"], b["title_name"], strict=True):
                w = blocking_parts(name or "") if kind == "office" else [parts(name)[-1]] if name and parts(name) else []
                place = parts(title or "")[1:]
                rows += [(p, x) for x in {*w, *(x for x in place if x not in EMPTY)}]
            yield pd.DataFrame(rows, columns=["person_id", "listed"])

    def mention_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(m, int(n), w) for m, n in zip(b["mention"], b["n"], strict=True) for w in blocking_parts(m)]
            yield pd.DataFrame(rows, columns=["mention", "n", "word"])

    kind = people.schema["person_id"].dataType.simpleString()
    listed = people.select("person_id", "kind", "full_name", "title_name").mapInPandas(entry_words, f"person_id {kind}, listed string")
    own = mentions.where("mention is not null and trim(mention) <> ''").groupBy("mention").agg(F.sum("n").alias("n"))
    said = own.mapInPandas(mention_words, "mention string, n long, word string")
    counts = said.groupBy("word").agg(F.sum("n").alias("count"))
    left = _with_bands(counts.select("word"), bands)
    right = _with_bands(listed.select(F.col("listed").alias("word")).distinct(), bands).withColumnRenamed("word", "listed")
    cores = mentions.sparkSession.sparkContext.defaultParallelism
    met = left.join(right, "band").select("word", "listed").distinct().repartition(cores)  # few bytes, but costly rows
    # a swap of neighbours is one edit here and two for levenshtein(); a short form is a prefix
    most = F.floor(2 * (1 - LEAST_PART) * F.greatest(F.length("word"), F.length("listed")) + 1e-9).cast("int")
    met = met.where((F.levenshtein("word", "listed") <= most) | F.col("listed").startswith(F.col("word")))

    def similar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = [likeness(a, c) if not (len(a) < len(c) and c.startswith(a)) else 0.92 for a, c in zip(b["word"], b["listed"], strict=True)]
            yield b.assign(similarity=s)[np.array(s, dtype=float) >= LEAST_PART]

    edges = cut_lineage(met.mapInPandas(similar, "word string, listed string, similarity double"))
    weight = counts.withColumnRenamed("word", "listed").withColumnRenamed("count", "listed_count")
    stars = (
        edges.join(counts, "word").join(weight, "listed", "left")
        .where((F.col("word") == F.col("listed")) | (F.col("count") < own_centre) | (F.col("count") < own_share * F.coalesce("listed_count", F.lit(0))))
        .select("word", "listed")
    )
    candidates = (
        said.select("mention", "word").join(stars, "word").join(listed, "listed").select("mention", "person_id").distinct()
        .join(people, "person_id")
        .groupBy("mention")
        .agg(F.collect_list(F.struct(*people.columns)).alias("c"))
    )

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for m, c in zip(b["mention"], b["c"], strict=True):
                found = best_entries(m, [x if isinstance(x, dict) else x.asDict() for x in c])
                rows += [(m, p, len(found)) for p, _ in found]
            yield pd.DataFrame(rows, columns=["mention", "person_id", "ties"])

    decided = cut_lineage(candidates.mapInPandas(decide, f"mention string, person_id {kind}, ties int"))
    sure = decided.where("ties = 1").join(own, "mention").groupBy("person_id").agg(F.sum("n").alias("sure"))
    return (
        decided.join(sure, "person_id", "left")
        .groupBy("mention")
        .agg(F.max_by("person_id", F.struct(F.coalesce("sure", F.lit(0)), -F.col("person_id"))).alias("person_id"))
    )


def link_records(records: DataFrame, directory: DataFrame) -> DataFrame:
    """(rec_key, person_id) of records (rec_key, mention); distinct mentions are linked once and joined back."""
    rows = records.where("rec_key is not null and mention is not null").distinct()
    linked = link_mentions(rows.groupBy("mention").agg(F.count("*").alias("n")), directory)
    return rows.join(linked, "mention").select("rec_key", "person_id").distinct()
