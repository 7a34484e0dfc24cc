"""Groups of records whose texts are re-edited versions of one another, by BK-trees in shards of rare shingles.

A text is the set of its distinct runs of ``width`` words. Sets at Jaccard similarity t share a shingle of their
prefixes (the rarer part of each set), so every pair at t or more meets in the shard of such a shingle. Each set has a
fingerprint of 64 letters of two bits, from 64 min-hash values; the number of letters in which two fingerprints differ
(their Hamming distance) falls with the similarity. In a shard only pairs are compared whose sizes and places of the
shingle allow the similarity; where the radius is small enough for trees to prune, the sets of a shard form a BK-tree.
A second fingerprint of 64 letters leaves few unlike pairs. Pairs found are verified exactly on the whole sets.

Only the order of shingles by rarity needs a count over all texts. It comes from a sketch of fixed size, which never
takes a shingle of two sets for one of a single set: so shingles of a single set, most of all, are left out without
loss, and a shingle of very many sets is split into pairs of blocks before its rows are shuffled.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.chars import print_form
from folio.llm.words import words
from folio.session import spread, write_shared

#: Letters of a fingerprint; each is two bits of a min-hash value.
LETTERS = 64
#: Probability with which the radius may miss a pair at exactly the wanted similarity.
MISS = 5e-5
#: Cells of the counting sketch (one byte each once merged) and the chunks in which it is merged.
CELL_BITS, CHUNK_BITS = 24, 18
BLOOM_BITS = 1 << 25
#: Sizes from here on are not told apart where they are sent in two bytes.
MANY = 65535
#: Sets a task remembers as sent; what it has forgotten is sent once more and falls out later.
REMEMBERED = 500_000
#: Shards are shuffled, and pairs verified, in so many turns, so that only a part of them lies on the disks at a time.
TURNS, VERIFY_TURNS = 4, 2
#: Queries walk the trees so many possible visits at a time; bounds the memory of a task.
VISITS = 4_000_000
#: Trees are walked up to this radius; at larger ones nearly every node would be visited.
TREE_RADIUS = 6
#: Pairs of a shard compared at a time, so that they stay in the cache.
COMPARED = 1 << 17
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def radius_for(similarity: float, miss: float = MISS, letters: int = LETTERS) -> int:
    """The least Hamming radius that misses a pair of this similarity with at most this probability."""
    p = (1 - similarity) * 0.75  # letters of different min-hash values are equal by chance once in four
    tail, r = 1.0, -1
    while tail > miss:
        r += 1
        tail -= math.comb(letters, r) * p**r * (1 - p) ** (letters - r)
    return r


def distances(a_lo: np.ndarray, a_hi: np.ndarray, b_lo: np.ndarray, b_hi: np.ndarray) -> np.ndarray:
    """Letters in which fingerprints differ; ``lo`` holds the first bit of each letter, ``hi`` the second."""
    return np.bitwise_count((a_lo ^ b_lo) | (a_hi ^ b_hi)).astype(np.int64)


class BKForest:
    """One BK-tree for each group of fingerprints, all of them built and walked together, level by level.

    Each child of a node hangs at its integer distance to the node. ``group`` must be sorted; the first fingerprint
    of a group is the root of its tree, and the trees are those that adding one by one would give.
    """

    def __init__(self, group: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        self.lo, self.hi, self.visited = lo, hi, 0
        n = len(group)
        self.root_of = np.searchsorted(group, group, "left")
        self.edges, self.child = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        edges, child = [], []
        at = np.arange(n)
        parent = self.root_of
        at, parent = at[at != parent], parent[at != parent]
        while len(at):
            key = parent * (LETTERS + 1) + distances(lo[at], hi[at], lo[parent], hi[parent])
            order = np.argsort(key, kind="stable")
            at, key = at[order], key[order]
            first = np.concatenate([[True], key[1:] != key[:-1]])
            edges.append(key[first])
            child.append(at[first])
            parent = at[first][np.cumsum(first) - 1]
            at, parent = at[~first], parent[~first]
        if edges:
            keys, kids = np.concatenate(edges), np.concatenate(child)
            order = np.argsort(keys)
            self.edges, self.child = keys[order], kids[order]

    def within(self, queries: np.ndarray, roots: np.ndarray, q_lo: np.ndarray, q_hi: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node): all nodes at most ``radius`` from each query in the tree of its root."""
        found_q, found_n = [], []
        q, node, lo, hi = queries, roots, q_lo, q_hi
        while len(q):
            self.visited += len(q)
            d = distances(lo, hi, self.lo[node], self.hi[node])
            hit = d <= radius
            found_q.append(q[hit])
            found_n.append(node[hit])
            base = node * (LETTERS + 1)
            a = np.searchsorted(self.edges, base + np.maximum(d - radius, 1), "left")
            b = np.searchsorted(self.edges, base + np.minimum(d + radius, LETTERS), "right")
            n = np.maximum(b - a, 0)
            starts = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            node = self.child[starts + np.arange(n.sum())] if len(self.child) else np.empty(0, dtype=np.int64)
            q, lo, hi = np.repeat(q, n), np.repeat(lo, n), np.repeat(hi, n)
        none = np.empty(0, dtype=np.int64)
        return np.concatenate([none, *found_q]), np.concatenate([none, *found_n])


def _tree_pairs(shard_t: np.ndarray, shard_q: np.ndarray, t: np.ndarray, q: np.ndarray, lo: np.ndarray, hi: np.ndarray, radius: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(i, j, nodes visited): queries ``q`` and nodes ``t`` of a shard within the radius; with ``same`` each pair once."""
    forest = BKForest(shard_t, lo[t], hi[t])
    root = np.searchsorted(shard_t, shard_q, "left")
    members = np.searchsorted(shard_t, shard_q, "right") - root
    keep = members > (1 if same else 0)
    q, root, members = q[keep], root[keep], members[keep]
    cuts = np.searchsorted(np.cumsum(members), np.arange(VISITS, members.sum() + VISITS, VISITS)) + 1 if len(q) else []
    begin = 0
    for end in cuts:
        part = slice(begin, min(int(end), len(q)))
        before = forest.visited
        i, j = forest.within(q[part], root[part], lo[q[part]], hi[q[part]], radius)
        j = t[j]
        keep = i < j if same else slice(None)
        yield i[keep], j[keep], forest.visited - before
        begin = part.stop


def _window_pairs(shard: np.ndarray, rest: np.ndarray, size: np.ndarray, q: np.ndarray, t: np.ndarray, similarity: float, equal: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j): rows ``q`` with those rows ``t`` of their shard that are larger and small enough for what the row has left.

    A set of n shingles with r of them left reaches the similarity only with sets of at most r (1 + t) / t - n. By size
    these stand together, so no other pair is made. With ``equal`` rows of one size are paired, too; if ``q`` is ``t``
    each such pair comes once. Sets of ``MANY`` shingles are paired with all.
    """
    step, once = np.int64(MANY + 1), q is t
    t = t[np.lexsort((size[t], shard[t]))]
    key, q = shard[t] * step + size[t], t if once else q
    most = np.floor((rest[q] + 1e-6) * (1 + similarity) / similarity).astype(np.int64) - size[q]
    most = np.where(size[q] == MANY, MANY, np.clip(most, -1, MANY))
    base = shard[q] * step
    begin = np.arange(1, len(q) + 1) if once else np.searchsorted(key, base + size[q], "left" if equal else "right")
    end = np.searchsorted(key, base + most, "right")
    many, last = np.searchsorted(key, base + MANY, "left"), np.searchsorted(key, base + MANY, "right")
    for low, high in ((begin, np.minimum(end, many)), (np.maximum(begin, many), last)):
        n = np.maximum(high - low, 0)
        some = np.flatnonzero(n)
        low, n, of = low[some], n[some], q[some]
        to, at, done = np.cumsum(n), 0, 0
        while at < len(n):
            stop = max(at + 1, int(np.searchsorted(to, done + COMPARED, "right")))
            m = n[at:stop]
            if stop == at + 1 and m[0] > COMPARED:  # one row with very many
                for k in range(int(low[at]), int(low[at] + m[0]), COMPARED):
                    j = t[k : min(k + COMPARED, int(low[at] + m[0]))]
                    yield np.full(len(j), of[at]), j
            else:
                yield np.repeat(of[at:stop], m), t[np.arange(to[stop - 1] - done) + np.repeat(low[at:stop] - (to[at:stop] - m - done), m)]
            at, done = stop, int(to[stop - 1])


def cell_pairs(
    cell: np.ndarray, lo: np.ndarray, hi: np.ndarray, rest: np.ndarray, size: np.ndarray, radius: int, similarity: float,
    more: tuple[np.ndarray, np.ndarray, int] | None = None,
) -> tuple[np.ndarray, np.ndarray, int]:
    """(i, j, pairs compared): pairs of rows of one cell whose fingerprints are within the radius and that ``can_reach``.

    The last two bits of a cell's number tell the side: 0 pairs all of a cell, rows of 1 are paired with those of 2.
    ``more`` has second fingerprints and a radius for the distances of both together. Rows of one cell and the same
    fingerprints count once, with the greatest rest and the least size among them.
    """
    none = np.empty(0, dtype=np.int64)
    if not len(cell):
        return none, none, 0
    prints = [lo, hi, *(more[:2] if more else ())]
    order = np.lexsort((*prints[::-1], cell))
    c = cell[order]
    prints = [x[order] for x in prints]
    first = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([x[1:] != x[:-1] for x in (c, *prints)])]))
    rest, size = np.maximum.reduceat(rest[order].astype(np.int64), first), np.minimum.reduceat(size[order].astype(np.int64), first)
    order, c, prints = order[first], c[first], [x[first] for x in prints]
    side, shard = c & 3, np.cumsum(np.concatenate([[0], (c[1:] >> 2) != (c[:-1] >> 2)]))
    alone, one, two = (np.flatnonzero(side == k) for k in (0, 1, 2))
    out_i, out_j, compared = [none], [none], 0

    def kept(i: np.ndarray, j: np.ndarray, near: bool) -> tuple[np.ndarray, np.ndarray]:
        if not near:
            d = distances(prints[0][i], prints[1][i], prints[0][j], prints[1][j])
            at = np.flatnonzero(d <= radius)
            i, j, d = i[at], j[at], d[at]
        elif more:
            d = distances(prints[0][i], prints[1][i], prints[0][j], prints[1][j])
        keep = can_reach(rest[i], size[i], rest[j], size[j], similarity)
        if more:
            keep &= d + distances(prints[2][i], prints[3][i], prints[2][j], prints[3][j]) <= more[2]
        return i[keep], j[keep]

    if radius <= TREE_RADIUS:
        for t, q in ((alone, alone), (one, two)):
            for i, j, n in _tree_pairs(shard[t], shard[q], t, q, *prints[:2], radius, t is q):
                compared += n
                i, j = kept(i, j, True)
                out_i.append(order[i])
                out_j.append(order[j])
    else:
        for q, t, equal in ((alone, alone, True), (two, one, True), (one, two, False)):
            for i, j in _window_pairs(shard, rest, size, q, t, similarity, equal):
                compared += len(i)
                i, j = kept(i, j, False)
                if q is one:
                    i, j = j, i
                out_i.append(order[i])
                out_j.append(order[j])
    return np.concatenate(out_i), np.concatenate(out_j), compared


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def _seeds(n: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(texts: list[str | None], width: int, cache: dict[str, int], salts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, offsets, hashes): the sorted distinct 32-bit shingle hashes of all texts, end to end.

    Texts of different ``salts`` share no shingle.
    """
    counts, flat = np.zeros(len(texts), dtype=np.int64), []
    get = cache.get
    for i, t in enumerate(texts):
        w = words(t)
        counts[i] = len(w)
        h = [get(x) for x in w]
        if None in h:
            if len(cache) > 500_000:
                cache.clear()
            for k, x in enumerate(w):
                if h[k] is None:
                    h[k] = cache[x] = xxhash.xxh64_intdigest(x)
        flat += h
    ids = np.array(flat, dtype=np.uint64)
    doc = np.repeat(np.arange(len(texts)), counts)
    m = max(len(ids) - width + 1, 0)
    h = np.zeros(m, dtype=np.uint64) if salts is None else salts[doc[:m]]
    for k in range(width):
        h = _mix(h * np.uint64(31) + ids[k : k + m])
    same = doc[:m] == doc[width - 1 : width - 1 + m]
    key = (doc[:m][same].astype(np.uint64) << np.uint64(32)) | (h[same] >> np.uint64(32))
    key = np.unique(key)
    owner = (key >> np.uint64(32)).astype(np.int64)
    offsets = np.searchsorted(owner, np.arange(len(texts) + 1))
    return counts, offsets, (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def min_hashes(offsets: np.ndarray, hashes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """(seeds, sets) matrix of 32-bit min-hash values; every set must have a member."""
    x = _mix(hashes.astype(np.uint64))
    out = np.empty((len(seeds), len(offsets) - 1), dtype=np.uint32)
    for i, s in enumerate(seeds):
        out[i] = np.minimum.reduceat(((x * s) >> np.uint64(32)).astype(np.uint32), offsets[:-1])
    return out


def _binary(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Binary values: the bytes of ``values`` between consecutive offsets."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64) * values.itemsize), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def fingerprints(df: DataFrame, key: str, text: str, *, width: int, min_words: int, as_printed: bool | Column = False, within: str | None = None) -> DataFrame:
    """(part, key, lo, hi, lo2, hi2, cls, sh): two fingerprints, class of equal sets, and sorted shingle hashes of each long enough text.

    ``part`` is the value of ``within`` (null without one); ``cls`` is a 128-bit hash of the set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        seeds = _seeds(2 * LETTERS)
        for b in batches:
            printed = b.column("printed").to_pylist()
            texts = [print_form(t) if p else t for t, p in zip(b.column("t").to_pylist(), printed, strict=True)]
            parts = b.column("part").to_pylist()
            salt = {p: xxhash.xxh64_intdigest(p or "") for p in set(parts)}
            counts, offsets, sh = shingle_sets(texts, width, cache, np.array([salt[p] for p in parts], dtype=np.uint64))
            keep = (counts >= max(min_words, width)) & (np.diff(offsets) > 0)
            sh, sizes = sh[np.repeat(keep, np.diff(offsets))], np.diff(offsets)[keep]
            off = np.concatenate([[0], np.cumsum(sizes)])
            bits = np.zeros((4, len(sizes)), dtype=np.uint64)  # lo, hi, lo2, hi2
            if len(sizes):
                values = min_hashes(off, sh, seeds).astype(np.uint64)
                for i in range(2 * LETTERS):
                    second, letter = divmod(i, LETTERS)
                    bits[2 * second] |= (values[i] & np.uint64(1)) << np.uint64(letter)
                    bits[2 * second + 1] |= ((values[i] >> np.uint64(1)) & np.uint64(1)) << np.uint64(letter)
            sets = _binary(sh, off)
            mask = pa.array(keep)
            cls = pa.array([xxhash.xxh3_128_digest(x.as_buffer()) for x in sets], type=pa.binary())
            yield pa.RecordBatch.from_arrays(
                [b.column("part").filter(mask), b.column("key").filter(mask), *(pa.array(x.view(np.int64)) for x in bits), cls, sets],
                names=["part", "key", "lo", "hi", "lo2", "hi2", "cls", "sh"],
            )

    part = F.lit(None).cast("string") if within is None else F.col(within).cast("string")
    printed = F.lit(as_printed) if isinstance(as_printed, bool) else as_printed
    slim = df.select(part.alias("part"), F.col(key).cast("string").alias("key"), F.col(text).alias("t"), F.coalesce(printed, F.lit(False)).alias("printed"))
    return spread(slim.where("key is not null and t is not null")).mapInArrow(run, "part string, key string, lo long, hi long, lo2 long, hi2 long, cls binary, sh binary")


def _sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes) of a column of binary sets."""
    sizes = np.array([len(x) if x is not None else 0 for x in (v.as_buffer() for v in column)], dtype=np.int64) // 4
    return np.concatenate([[0], np.cumsum(sizes)]), np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32)


class _Fresh:
    """Which sets a task has not met yet, as far as it remembers: a text copied very often is sent once a task."""

    def __init__(self) -> None:
        self.seen: set[bytes] = set()

    def mask(self, classes: pa.Array) -> np.ndarray:
        out = np.zeros(len(classes), dtype=bool)
        for i, c in enumerate(classes.to_pylist()):
            if c not in self.seen:
                if len(self.seen) >= REMEMBERED:
                    self.seen.clear()
                self.seen.add(c)
                out[i] = True
        return out


def _fresh_sets(b: pa.RecordBatch, fresh: _Fresh) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    b = b.filter(pa.array(fresh.mask(b.column("cls"))))
    return b, *_sets(b.column("sh"))


def cells_of(hashes: np.ndarray) -> np.ndarray:
    return (_mix(hashes.astype(np.uint64)) >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def log_code(counts: np.ndarray, steps: int) -> np.ndarray:
    """0 for none, else 1 + the logarithm in ``steps`` a doubling; ``least_of`` gives back the least such count."""
    out = np.zeros(len(counts), dtype=np.uint8)
    at = np.flatnonzero(counts)
    out[at] = np.minimum(np.floor(steps * np.log2(counts[at]) + 1e-9), 254).astype(np.uint8) + 1
    return out


def least_of(steps: int) -> np.ndarray:
    return np.concatenate([[0], np.ceil(2.0 ** np.minimum(np.arange(255) / steps, 50) - 1e-6).astype(np.int64)])


#: Steps of the codes that tasks send, which are compressed by the byte, and of the merged ones.
SENT_STEPS, STEPS = 1, 8
LEAST_SENT, LEAST = least_of(SENT_STEPS), least_of(STEPS)


def sketch_counts(prints: DataFrame) -> np.ndarray:
    """For each cell of the shingle hashes, the logarithmic code of how many distinct sets hold one of them.

    Each task counts for itself and sends a byte a cell, compressed; the sum is at least half the true count of any
    shingle, and 2 or more for a shingle of two sets. Of fixed size, whatever the input.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc, fresh = np.zeros(1 << CELL_BITS, dtype=np.uint32), _Fresh()
        for b in batches:
            _, _, sh = _fresh_sets(b, fresh)
            at, n = np.unique(cells_of(sh), return_counts=True)
            acc[at] += n.astype(np.uint32)
        codes = log_code(acc, SENT_STEPS).reshape(-1, 1 << CHUNK_BITS)
        used = np.flatnonzero(codes.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, type=pa.int32()), pa.array([zlib.compress(codes[i].tobytes(), 1) for i in used], type=pa.binary())], names=["chunk", "codes"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, codes in zip(b.column("chunk").to_pylist(), b.column("codes").to_pylist(), strict=True):
                code = np.frombuffer(zlib.decompress(codes), dtype=np.uint8)
                at = np.flatnonzero(code)
                sums.setdefault(chunk, np.zeros(len(code), dtype=np.int64))[at] += LEAST_SENT[code[at]]
        keys = sorted(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, type=pa.int32()), pa.array([zlib.compress(log_code(sums[k], STEPS).tobytes(), 1) for k in keys], type=pa.binary())], names=["chunk", "codes"]
        )

    schema = "chunk int, codes binary"
    merged = prints.select("cls", "sh").mapInArrow(count, schema).repartition("chunk").mapInArrow(merge, schema).toArrow()
    out = np.zeros((1 << (CELL_BITS - CHUNK_BITS), 1 << CHUNK_BITS), dtype=np.uint8)
    for chunk, codes in zip(merged.column(0).to_pylist(), merged.column(1).to_pylist(), strict=True):
        out[chunk] = np.frombuffer(zlib.decompress(codes), dtype=np.uint8)
    return out.reshape(-1)


def prefix_of(offsets: np.ndarray, hashes: np.ndarray, counts: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner, hash, count, place in the set from 0) of the shingles in a prefix; the order is by count, then by hash.

    Sets of n and m shingles at Jaccard similarity t share at least t * n of them, so one of the first n - t * n + 1
    of the one is among the first of the other, in any order that is the same for all sets. ``counts`` are codes below
    256, and a batch has fewer than 2^24 sets, so that one sort of numbers does.
    """
    sizes = np.diff(offsets)
    key = np.repeat(np.arange(len(sizes), dtype=np.uint64) << np.uint64(40), sizes) | (counts.astype(np.uint64) << np.uint64(32)) | hashes
    key.sort()
    owner = (key >> np.uint64(40)).astype(np.int64)
    place = np.arange(len(key)) - offsets[owner]
    length = sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1
    keep = place < length[owner]
    key = key[keep]
    return owner[keep], (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), ((key >> np.uint64(32)) & np.uint64(255)).astype(np.uint8), place[keep]


def can_reach(rest_a: np.ndarray, size_a: np.ndarray, rest_b: np.ndarray, size_b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether two sets can be similar enough if this shingle is the first they share.

    ``rest`` counts the shingles from this one on; no more than the lesser rest can be shared. A pair fails only
    in shards other than that of its first shared shingle, or if it is not similar enough. ``MANY`` passes always.
    """
    needed = np.ceil(similarity / (1 + similarity) * (size_a.astype(np.int64) + size_b) - 1e-9)
    return (np.minimum(rest_a, rest_b) >= needed) | (size_a == MANY) | (size_b == MANY)


def shard_rows_of(offsets: np.ndarray, hashes: np.ndarray, lo: np.ndarray, hi: np.ndarray, codes: np.ndarray, similarity: float, shard_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, cell, rest): the cells in which each set has to appear, and its shingles from that one on.

    A shard of at most ``shard_rows`` sets is one cell. A larger one is cut into blocks by fingerprint; each pair of
    blocks is a cell, so the rows are split before they are shuffled. Cells have 40 bits; if two shards get one
    number, their sets only meet in vain.
    """
    owner, shard, code, place = prefix_of(offsets, hashes, codes[cells_of(hashes)], similarity)
    shared = code > 1  # a shingle of one set brings no pair
    owner, shard, code, place = owner[shared], shard[shared].astype(np.uint64), code[shared], place[shared]
    sizes = np.diff(offsets)
    rest = np.where(sizes[owner] >= MANY, MANY, sizes[owner] - place)
    count = LEAST[code] * 2.2  # the code is at least half the count, less a step
    blocks = np.ceil(count / shard_rows).astype(np.int64)
    small = blocks <= 1
    shift = np.uint64(26)
    cells, owners, rests = [(_mix(shard[small]) >> shift) << np.uint64(2)], [owner[small]], [rest[small]]
    own, shard, blocks, rest = owner[~small], shard[~small], blocks[~small], rest[~small]
    block = (_mix(lo[own] + (hi[own] << np.uint64(1))) % blocks.astype(np.uint64)).astype(np.int64)
    other = np.arange(blocks.sum()) - np.repeat(np.concatenate([[0], np.cumsum(blocks)[:-1]]), blocks) if len(blocks) else np.empty(0, dtype=np.int64)
    own, shard, block, rest = (np.repeat(x, blocks) for x in (own, shard, block, rest))
    a, b = np.minimum(block, other).astype(np.uint64), np.maximum(block, other).astype(np.uint64)
    side = np.where(block == other, 0, np.where(block < other, 1, 2)).astype(np.uint64)
    cells.append(((_mix(shard + _mix((a << np.uint64(32)) | b)) >> shift) << np.uint64(2)) | side)
    return np.concatenate([*owners, own]), np.concatenate(cells), np.concatenate([*rests, rest])


#: What is sent to a shard: of each set once its fingerprints, size and number of rows, then of each row cell and rest.
SENT = {"lo": np.uint64, "hi": np.uint64, "lo2": np.uint64, "hi2": np.uint64, "size": np.uint16, "rows": np.uint32, "cell_hi": np.uint32, "cell_lo": np.uint8, "rest": np.uint16}


def candidate_pairs(prints: DataFrame, codes, similarity: float, shard_rows: int, radius: int, both: int, turn: int = 0, turns: int = 1) -> DataFrame:
    """(lo_a, hi_a, lo_b, hi_b): first fingerprints of sets that share a shard, a repeated pair once.

    The first fingerprints are within ``radius``, the distances of the first and the second together within ``both``.

    Of all shards only those whose turn it is; every shard has one of the ``turns``.
    """
    spark = prints.sparkSession
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = -(-parts // turns) * turns

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh = _Fresh()
        for b in batches:
            b, off, sh = _fresh_sets(b, fresh)
            if not b.num_rows:
                continue
            bits = {c: b.column(c).to_numpy().view(np.uint64) for c in ("lo", "hi", "lo2", "hi2")}
            size = np.minimum(np.diff(off), MANY)
            owner, cell, rest = shard_rows_of(off, sh, bits["lo"], bits["hi"], codes.value, similarity, shard_rows)
            if not len(owner):
                continue
            to = (_mix(cell >> np.uint64(2)) % np.uint64(parts)).astype(np.int64)
            if turns > 1:
                now = to % turns == turn
                to, cell, owner, rest = to[now], cell[now], owner[now], rest[now]
                if not len(to):
                    continue
            order = np.argsort((to << 24) | owner)
            to, cell, owner, rest = to[order], cell[order], owner[order], rest[order]
            row_cuts = np.concatenate([np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])), [len(to)]])
            first = np.flatnonzero(np.concatenate([[True], (to[1:] != to[:-1]) | (owner[1:] != owner[:-1])]))
            set_cuts = np.searchsorted(first, row_cuts)
            of = owner[first]
            by_set = {c: x[of] for c, x in bits.items()} | {"size": size[of], "rows": np.diff(np.concatenate([first, [len(to)]]))}
            by_row = {"cell_hi": cell >> np.uint64(8), "cell_lo": cell & np.uint64(255), "rest": rest}
            sent = [_binary(v.astype(SENT[k]), set_cuts) for k, v in by_set.items()] + [_binary(v.astype(SENT[k]), row_cuts) for k, v in by_row.items()]
            yield pa.RecordBatch.from_arrays([pa.array(to[row_cuts[:-1]], type=pa.int32()), *sent], names=["to", *SENT])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {k: [] for k in SENT}
        for b in batches:
            for k in SENT:
                held[k] += b.column(k).to_pylist()
        got = {k: np.frombuffer(b"".join(held.pop(k)), dtype=kind) for k, kind in SENT.items()}
        of = np.repeat(np.arange(len(got["lo"])), got["rows"])
        cell = (got["cell_hi"].astype(np.int64) << 8) | got["cell_lo"]
        lo, hi = got["lo"], got["hi"]
        i, j, _ = cell_pairs(cell, lo[of], hi[of], got["rest"], got["size"][of], radius, similarity, (got["lo2"][of], got["hi2"][of], both))
        i, j = of[i], of[j]
        swap = (lo[i] > lo[j]) | ((lo[i] == lo[j]) & (hi[i] > hi[j]))
        a, b = np.where(swap, j, i), np.where(swap, i, j)
        order = np.lexsort((hi[b], lo[b], hi[a], lo[a]))
        pairs = [x[order] for x in (lo[a], hi[a], lo[b], hi[b])]
        new = np.ones(len(order), dtype=bool)
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in pairs])
        yield pa.RecordBatch.from_arrays([pa.array(x[new].view(np.int64)) for x in pairs], names=["lo_a", "hi_a", "lo_b", "hi_b"])

    kinds = ", ".join(f"{k} binary" for k in SENT)
    # by hash some partitions would get several shares and some none
    placed = prints.mapInArrow(send, f"to int, {kinds}").repartitionById(parts // turns, F.expr(f"cast(to / {turns} as int)"))
    return placed.mapInArrow(meet, "lo_a long, hi_a long, lo_b long, hi_b long").distinct()


def _bloom_at(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return _mix(lo ^ _mix(hi)) >> np.uint64(39)


def _bloom(keys: DataFrame) -> np.ndarray:
    """A bitmap of fixed size over fingerprints (lo, hi): rows it rejects are certainly not among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BLOOM_BITS // 8, dtype=np.uint8)
        for b in batches:
            at = _bloom_at(*(b.column(i).to_numpy().view(np.uint64) for i in (0, 1)))
            np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        used = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(bits[used].astype(np.int32))], names=["at", "bits"])

    out = np.zeros(BLOOM_BITS // 8, dtype=np.uint8)
    for r in keys.select("lo", "hi").mapInArrow(run, "at int, bits int").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow().to_batches():
        out[r.column(0).to_numpy()] = r.column(1).to_numpy()
    return out


def _verified(pairs: DataFrame, similarity: float) -> DataFrame:
    """(cls_a, cls_b, similarity) of pairs (cls_a, n_a, sh_a, cls_b, n_b, sh_b) at this similarity or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (off_a, a), (off_b, c) = _sets(b.column("sh_a")), _sets(b.column("sh_b"))
            row = np.arange(b.num_rows, dtype=np.uint64) << np.uint64(32)
            both = np.sort(np.concatenate([np.repeat(row, np.diff(off_a)) | a, np.repeat(row, np.diff(off_b)) | c]))
            again = both[1:][both[1:] == both[:-1]] >> np.uint64(32)
            shared = np.bincount(again.astype(np.int64), minlength=b.num_rows)
            value = shared / np.maximum(b.column("n_a").to_numpy() + b.column("n_b").to_numpy() - shared, 1)
            keep = pa.array(value >= similarity)
            yield pa.RecordBatch.from_arrays([*(b.column(x).filter(keep) for x in ("cls_a", "cls_b")), pa.array(value).filter(keep)], names=["cls_a", "cls_b", "similarity"])

    return pairs.select("cls_a", "n_a", "sh_a", "cls_b", "n_b", "sh_b").mapInArrow(run, "cls_a binary, cls_b binary, similarity double")


def near_duplicates(
    df: DataFrame,
    key: str,
    text: str,
    *,
    similarity: float = 0.5,
    width: int = 3,
    min_words: int = 12,
    shard_rows: int = 50_000,
    as_printed: bool | Column = False,
    within: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(links, members): links (cls_a, cls_b, similarity) between classes of equal sets, members (part, cls, key).

    Texts shorter than ``min_words`` words, null texts and rows with a null key take no part; rows repeated with key
    and text count once; texts with equal sets are one class and are never paired with each other. With ``within``
    only records of an equal value of that column (``part``) are compared. Similarity is the exact Jaccard similarity
    of the sets of 32-bit shingle hashes. Empty tables give empty results; other columns are not read. Every pair of
    at least this similarity meets in a shard, and both radii together miss one at exactly it with probability ``MISS``.
    """
    radius, both = radius_for(similarity, MISS / 10), radius_for(similarity, 0.9 * MISS, 2 * LETTERS)
    prints = write_shared(fingerprints(df, key, text, width=width, min_words=min_words, as_printed=as_printed, within=within))
    bare = spread(prints.select("lo", "hi", "lo2", "hi2", "cls", "sh"))
    codes = df.sparkSession.sparkContext.broadcast(sketch_counts(bare))
    # what a turn shuffles is gone before the next one begins
    met = [write_shared(candidate_pairs(bare, codes, similarity, shard_rows, radius, both, k, TURNS)) for k in range(TURNS)]
    near = reduce(DataFrame.unionByName, met)
    # different sets with one fingerprint: rare, and as close as a pair can be
    twins = prints.groupBy("lo", "hi").agg(F.min("cls").alias("first"), F.max("cls").alias("last")).where("first < last")
    near = near.unionByName(twins.select(F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b")))
    near = write_shared(near.distinct())
    ends = near.select(F.explode(F.array(F.struct(F.col("lo_a").alias("lo"), F.col("hi_a").alias("hi")), F.struct(F.col("lo_b").alias("lo"), F.col("hi_b").alias("hi")))).alias("e"))
    bitmap = df.sparkSession.sparkContext.broadcast(_bloom(ends.select("e.lo", "e.hi")))

    def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sets that may be in a pair, once, without the shingles that no other set holds; ``n`` counts these too."""
        bits, fresh = bitmap.value, _Fresh()
        for b in batches:
            at = _bloom_at(*(b.column(c).to_numpy().view(np.uint64) for c in ("lo", "hi")))
            on = ((bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
            b, off, sh = _fresh_sets(b.filter(pa.array(on)), fresh)
            kept = codes.value[cells_of(sh)] > 1
            cut = np.concatenate([[0], np.cumsum(kept)])[off]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("lo", "hi", "cls")), pa.array(np.diff(off), type=pa.int32()), _binary(sh[kept], cut)], names=["lo", "hi", "cls", "n", "sh"])

    sets = (
        bare.select("lo", "hi", "cls", "sh").mapInArrow(maybe, "lo long, hi long, cls binary, n int, sh binary")
        .repartition("lo", "hi").groupBy("lo", "hi", "cls").agg(F.any_value("n").alias("n"), F.any_value("sh").alias("sh"))
    )
    a = sets.toDF("lo_a", "hi_a", "cls_a", "n_a", "sh_a")
    b = sets.toDF("lo_b", "hi_b", "cls_b", "n_b", "sh_b")
    same = (F.col("lo_a") == F.col("lo_b")) & (F.col("hi_a") == F.col("hi_b"))
    first = F.col("cls_a") < F.col("cls_b")
    ends_of = (F.when(first, F.col("cls_a")).otherwise(F.col("cls_b")).alias("cls_a"), F.when(first, F.col("cls_b")).otherwise(F.col("cls_a")).alias("cls_b"))
    turns = []
    for k in range(VERIFY_TURNS):
        some = near.where(F.expr(f"pmod(xxhash64(lo_a, hi_a), {VERIFY_TURNS}) = {k}"))
        pairs = some.join(a, ["lo_a", "hi_a"]).join(b, ["lo_b", "hi_b"]).where((same & (F.col("cls_a") < F.col("cls_b"))) | (~same & (F.col("cls_a") != F.col("cls_b"))))
        turns.append(write_shared(_verified(pairs, similarity).select(*ends_of, "similarity")))
    links = reduce(DataFrame.unionByName, turns)
    return links, prints.select("part", "cls", "key").repartition("cls").distinct()


def key_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """(part, key_a, key_b): links and classes spelled out as pairs of different keys."""
    many = members.groupBy("cls").agg(F.count("*").alias("n")).where("n > 1").select("cls")
    copies = members.join(many, "cls", "left_semi").select("part", "cls", "key")
    same = copies.toDF("part", "cls", "x").join(copies.drop("part").toDF("cls", "y"), "cls").where("x < y").select("part", "x", "y")
    ends = members.drop("part")
    linked = links.join(members.toDF("part", "cls_a", "x"), "cls_a").join(ends.toDF("cls_b", "y"), "cls_b").where("x <> y").select("part", "x", "y")
    return same.unionByName(linked).select("part", F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct()


def link_counts(links: DataFrame, members: DataFrame) -> DataFrame:
    """(part, key, cls, copies, links): one row a record: its class, the class's size and the linked classes."""
    ends = links.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("links"))
    sizes = members.groupBy("cls").agg(F.count("*").alias("copies"))
    return members.join(sizes, "cls").join(ends, "cls", "left").select("part", "key", F.hex("cls").alias("cls"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
