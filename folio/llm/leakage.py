"""Held-out passages inside a corpus: n-gram seeds, then Smith-Waterman alignment of whole texts.

The held-out items are the stated query set; they are taken in blocks of a bounded number of items, and a block's
vocabulary and seeds are broadcast. The corpus is read once a block. Every document that shares a seed with an item is
a candidate, however rare or frequent the seed: an edited copy keeps only the seeds between its edits, and which of
them those are cannot be told from the item. What cannot reach the wanted score or run any more is left out by bounds
before it is aligned, and alignment is cut down to the stretches of a document that can score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.words import words

#: Items whose vocabulary and seeds are broadcast at once: about 100 bytes a word, 50 words an item, so 250 MB at most.
BLOCK_ITEMS = 50_000
MATCH, MISMATCH, GAP = 2, -1, 1
#: A copy's alignment has at least this share of the score that the whole item has with itself.
LEAST_SHARE = 0.4
_MIX = np.uint64(0x9E3779B97F4A7C15)


def seed_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of each n-gram of word numbers; 0 where one of its words is unknown (number 0)."""
    if len(ids) < n:
        return np.empty(0, dtype=np.uint64)
    m = len(ids) - n + 1
    h = np.zeros(m, dtype=np.uint64)
    known = np.ones(m, dtype=bool)
    for k in range(n):
        part = ids[k : k + m].astype(np.uint64)
        known &= part > 0
        h = (h ^ part) * _MIX
        h ^= h >> np.uint64(29)
    return np.where(known, h | np.uint64(1), np.uint64(0))


def align(item: np.ndarray, doc: np.ndarray) -> tuple[int, int]:
    """(best local alignment score, longest run of equal consecutive words) of two sequences of word numbers."""
    cols = np.arange(1, len(doc) + 1, dtype=np.int64) * GAP
    above, run = np.zeros(len(doc) + 1, dtype=np.int64), np.zeros(len(doc) + 1, dtype=np.int64)
    best, longest = np.zeros(len(doc), dtype=np.int64), np.zeros(len(doc), dtype=np.int64)
    for w in item:
        same = doc == w
        now = above[:-1] + np.where(same, MATCH, MISMATCH)
        np.maximum(now, above[1:] - GAP, out=now)
        np.maximum(now, 0, out=now)
        now += cols
        np.maximum.accumulate(now, out=now)
        np.subtract(now, cols, out=above[1:])
        run[1:] = (run[:-1] + 1) * same
        np.maximum(best, above[1:], out=best)
        np.maximum(longest, run[1:], out=longest)
    return int(best.max(initial=0)), int(longest.max(initial=0))


def stretches(item: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, int]]:
    """[(bound, start, end)], highest bound first: the parts of ``doc`` outside of which no best alignment or run goes.

    A word of the document adds at most MATCH if the item has it and takes at least 1 otherwise. Where these bounds
    sum up to nothing since the last such place, dropping all before never makes an alignment worse. ``bound`` is the
    most that an alignment inside a part can score.
    """
    total = np.cumsum(np.where(np.isin(doc, item), MATCH, max(MISMATCH, -GAP)))
    rest = total - np.minimum(np.minimum.accumulate(total), 0)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], rest > 0, [False]]).astype(np.int8)))
    if not len(edges):
        return []
    starts, ends = edges[::2], edges[1::2]
    bounds = np.maximum.reduceat(rest, starts)
    order = np.argsort(-bounds, kind="stable")
    return list(zip(bounds[order].tolist(), starts[order].tolist(), ends[order].tolist(), strict=True))


def align_parts(item: np.ndarray, doc: np.ndarray, need: int = 1, run_needed: int | None = None) -> tuple[int, int]:
    """What ``align`` gives, from those stretches of ``doc`` alone whose bound is above what is found already.

    Below a score of ``need`` and a run of ``run_needed`` the result may be less than that of ``align``; where no
    ``run_needed`` is given, every run counts.
    """
    best = longest = 0
    for bound, a, b in stretches(item, doc):
        if bound <= best and bound // MATCH <= longest:
            break
        if bound < need and (run_needed is None or bound // MATCH < run_needed):
            break
        part = doc[a:b]
        score, run = align(item, part) if len(item) < len(part) else align(part, item)
        best, longest = max(best, score), max(longest, run)
    return best, longest


class _Block:
    """Word numbers and seeds of a block of items."""

    def __init__(self, items: list[tuple[int, str]], seed: int, min_run: int) -> None:
        self.number: dict[str, int] = {}
        self.items: dict[int, np.ndarray] = {}
        for key, text in items:
            w = words(text)
            if len(w) >= min_run:
                self.items[key] = np.array([self.number.setdefault(x, len(self.number) + 1) for x in w], dtype=np.int64)
        keys = list(self.items)
        seeds = [seed_hashes(self.items[k], seed) for k in keys]
        self.distinct = {k: len(np.unique(h)) for k, h in zip(keys, seeds, strict=True)}
        flat = np.concatenate([*seeds, np.empty(0, dtype=np.uint64)])
        owner = np.repeat(np.arange(len(keys)), [len(h) for h in seeds])
        order = np.argsort(flat, kind="stable")
        self.keys, self.seeds, self.owners = keys, flat[order], owner[order]

    def sharing(self, hashes: np.ndarray) -> tuple[list[int], np.ndarray]:
        """The items that hold one of these seeds, and how many of them each holds (one that stands twice, twice)."""
        lo, hi = np.searchsorted(self.seeds, hashes, "left"), np.searchsorted(self.seeds, hashes, "right")
        n = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.empty(0, dtype=np.int64)
        owners, seeds = np.unique(self.owners[at], return_counts=True)
        return [self.keys[o] for o in owners], seeds


def _numbered(number: dict[str, int], text: str) -> np.ndarray:
    get = number.get
    return np.fromiter((get(w, 0) for w in words(text)), dtype=np.int64)


def leaked_passages(
    docs: DataFrame,
    items: DataFrame,
    *,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    min_run: int = 12,
    seed: int = 5,
    block_items: int = BLOCK_ITEMS,
    least_share: float = LEAST_SHARE,
) -> DataFrame:
    """(doc_id, item_id, score, longest_run, item_words): each document that holds a copy of an item or a passage of it.

    These are the pairs that share a seed and reach ``least_share`` of the item's own score or a run of ``min_run``.

    ``score`` is the Smith-Waterman score (2 a matching word, -1 a mismatch, -1 a gap), so ``score / (2 * item_words)``
    is near 1 for whole copies, edited or not; ``longest_run`` counts equal consecutive words. Null and empty texts
    and items shorter than ``min_run`` words give nothing; repeated rows of a document or item count once; rows with
    a null id are left out. Empty tables give an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    kinds = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("text")).where("doc_id is not null and text <> ''")
    own = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).where("item_id is not null and text <> ''").distinct()
    blocks = -(-own.count() // block_items) or 1
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, score long, longest_run long, item_words long"
    out = []
    for b in range(blocks):
        part = own.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) if blocks > 1 else own
        block = _Block([tuple(r) for r in part.collect()], seed, min_run)
        out.append(_leaks_of_block(spark, slim, block, schema, seed, min_run, least_share))
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("score", "longest_run", "item_words")])


def _leaks_of_block(spark, slim: DataFrame, block: _Block, schema: str, seed: int, min_run: int, least_share: float) -> DataFrame:
    shared = spark.sparkContext.broadcast(block)

    def aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for batch in batches:
            rows = []
            for key, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = _numbered(own.number, text)
                h = seed_hashes(ids, seed)
                found, seeds = own.sharing(np.unique(h[h > 0]))
                for i, n in zip(found, seeds.tolist(), strict=True):
                    item = own.items[i]
                    need = least_share * MATCH * len(item)
                    # a run of min_run words holds min_run - seed + 1 seeds, fewer only if some are equal
                    own_seeds = own.distinct[i]
                    run = min_run if n >= min_run - seed + 1 or own_seeds < len(item) - seed + 1 else len(item) + 1
                    score, longest = align_parts(item, ids, need, run)
                    if score >= need or longest >= min_run:
                        rows.append((key, i, score, longest, len(item)))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "score", "longest_run", "item_words"])

    return slim.mapInPandas(aligned, schema)
