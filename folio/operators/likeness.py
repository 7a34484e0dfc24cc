"""Exact similarities of very many pairs of texts at a time: difflib's matches and edit distances, in numpy.

All pairs of a batch advance together, so a pair costs microseconds where a loop in Python costs hundreds.
"""

from __future__ import annotations

import numpy as np

#: Cells of one row of the tables that are worked on together, so that they stay in the cache.
CELLS = 1 << 17
#: Pairs, their symbols and the masks of their rows that common subsequences are measured of together.
LCS_PAIRS, LCS_SYMBOLS, LCS_MASKS = 1 << 14, 1 << 23, 1 << 24
#: Places in a block of a common subsequence; the last bit takes what is carried over.
PLACES = 63


def coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, lengths): a row of small codes from 1 on for each text, filled up with 0."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    width = max(1, int(lengths.max(initial=0)))
    points = np.frombuffer("".join(t.ljust(width, "\0") for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(texts), width)
    values, codes = np.unique(points, return_inverse=True)
    most = max(len(values) + 1, width)
    kind = np.uint8 if most < 255 else np.uint16 if most < 65535 else np.uint32
    codes = (codes.reshape(points.shape) + 1).astype(kind)
    codes[np.arange(width) >= lengths[:, None]] = 0
    return codes, lengths


def _longest(codes: np.ndarray, a: np.ndarray, b: np.ndarray, box: np.ndarray) -> np.ndarray:
    """(length, first in a, first in b) of the longest common run in each box (a from, to, b from, to).

    Of equally long runs the first in ``a``, then the first in ``b``, as difflib takes it.
    """
    out = np.zeros((len(a), 3), dtype=np.int64)
    height, width = box[:, 1] - box[:, 0], box[:, 3] - box[:, 2]
    order, last, begin = np.argsort(width, kind="stable")[::-1], codes.shape[1] - 1, 0
    nothing = np.iinfo(codes.dtype).max
    while begin < len(order):
        w = int(width[order[begin]])
        at = order[begin : begin + max(1, CELLS // (w + 1))]
        begin += len(at)
        at = at[np.argsort(-height[at], kind="stable")]
        h, n = height[at], len(at)
        cols = np.arange(w)
        right = codes[b[at][:, None], np.minimum(box[at, 2][:, None] + cols, last)]
        right[cols >= width[at][:, None]] = nothing
        right = np.ascontiguousarray(right.T)
        left = codes[a[at][:, None], np.minimum(box[at, 0][:, None] + np.arange(h[0]), last)].T.copy()
        active = np.searchsorted(-h, -np.arange(h[0]), "left")
        runs, grown = np.zeros((w + 1, n), dtype=codes.dtype), np.zeros((w + 1, n), dtype=codes.dtype)
        equal, more = np.empty((w, n), dtype=bool), np.empty((w, n), dtype=codes.dtype)
        ones = equal.view(np.uint8)
        best, row = np.zeros(n, dtype=codes.dtype), np.zeros(n, dtype=np.int64)
        for t in range(int(h[0])):
            k = int(active[t])
            np.equal(right[:, :k], left[t, :k], out=equal[:, :k])
            np.add(runs[:-1, :k], 1, out=more[:, :k])
            np.multiply(more[:, :k], ones[:, :k], out=grown[1:, :k])
            most = grown[:, :k].max(axis=0)
            new = most > best[:k]
            row[:k][new] = t
            np.maximum(best[:k], most, out=best[:k])
            runs, grown = grown, runs
        size = best.astype(np.int64)
        first = row - size + 1
        # where that run stands first in b
        down = np.argsort(-size, kind="stable")
        shown, here = right[:, down], np.ones((w, n), dtype=bool)
        longer = np.searchsorted(-size[down], -np.arange(int(size.max(initial=0))), "left")
        for d, k in enumerate(longer):
            here[: w - d, :k] &= shown[d:, :k] == left[first[down[:k]] + d, down[:k]]
            here[w - d :, :k] = False
        col = np.empty(n, dtype=np.int64)
        col[down] = here.argmax(axis=0)
        out[at] = np.stack([size, box[at, 0] + first, box[at, 2] + col], axis=1)
    return out


def ratios(codes: np.ndarray, lengths: np.ndarray, a: np.ndarray, b: np.ndarray, least: float, decide: bool = False) -> np.ndarray:
    """``SequenceMatcher(None, a, b, autojunk=False).ratio()`` of each pair of rows where it is above ``least``.

    Elsewhere any value not above ``least``: a pair is left as soon as it cannot exceed it. With ``decide`` a pair is
    also left once it does, so that only on which side of ``least`` the value lies is certain.
    """
    total = lengths[a] + lengths[b]
    matched = np.zeros(len(a), dtype=np.int64)
    pair = np.arange(len(a))
    box = np.stack([np.zeros_like(a), lengths[a], np.zeros_like(b), lengths[b]], axis=1)
    while True:
        room = np.minimum(box[:, 1] - box[:, 0], box[:, 3] - box[:, 2])
        open_ = room > 0
        ahead = matched + np.bincount(pair[open_], room[open_], len(a)).astype(np.int64)
        going = 2.0 * ahead / np.maximum(total, 1) > least
        if decide:
            going &= 2.0 * matched / np.maximum(total, 1) <= least
        open_ &= going[pair]
        pair, box = pair[open_], box[open_]
        if not len(pair):
            break
        size, i, j = _longest(codes, a[pair], b[pair], box).T
        matched += np.bincount(pair, size, len(a)).astype(np.int64)
        some = size > 0
        pair, box, size, i, j = pair[some], box[some], size[some], i[some], j[some]
        before, after = np.stack([box[:, 0], i, box[:, 2], j], axis=1), np.stack([i + size, box[:, 1], j + size, box[:, 3]], axis=1)
        pair, box = np.concatenate([pair, pair]), np.concatenate([before, after])
    return np.where(total == 0, 1.0, 2.0 * matched / np.maximum(total, 1))


def exceeds(codes: np.ndarray, lengths: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether difflib's ratio of each pair of rows is above ``least``.

    Its matches are a common subsequence, so pairs whose longest one is too short are left out first.
    """
    total = lengths[a] + lengths[b]
    out = total == 0 if least < 1 else np.zeros(len(a), dtype=bool)
    at = np.flatnonzero((total > 0) & (2.0 * np.minimum(lengths[a], lengths[b]) / np.maximum(total, 1) > least))
    at = at[2.0 * common_lengths(codes, lengths, a[at], b[at]) / total[at] > least]
    out[at] = ratios(codes, lengths, a[at], b[at], least, decide=True) > least
    return out


def _masks(codes: np.ndarray) -> np.ndarray:
    """(block of 64 places, row, code): the places of a code in a row, as bits."""
    masks = np.zeros((-(-codes.shape[1] // 64), len(codes), int(codes.max(initial=0)) + 1), dtype=np.uint64)
    for k in range(codes.shape[1]):
        masks[k // 64, np.arange(len(codes)), codes[:, k]] |= np.uint64(1) << np.uint64(k % 64)
    return masks


def _places(lengths: np.ndarray, block: int) -> np.ndarray:
    """The bits of a block of 64 places that lie within these lengths."""
    bits = np.clip(lengths - 64 * block, 0, 64)
    return np.where(bits == 64, ~np.uint64(0), (np.uint64(1) << np.minimum(bits, 63).astype(np.uint64)) - np.uint64(1))


def common_lengths(codes: np.ndarray, lengths: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each pair of rows, by bit vectors of the rows ``a`` (Hyyrö).

    Pairs with rows ``a`` of about one length go together, so that none has more blocks than it needs.
    """
    values = int(codes.max(initial=0)) + 1
    out = np.zeros(len(a), dtype=np.int64)
    order, begin = np.lexsort((a, -lengths[a])), 0
    while begin < len(order):
        blocks = max(1, -(-int(lengths[a[order[begin]]]) // PLACES))
        at = order[begin : begin + max(1, min(LCS_PAIRS, LCS_SYMBOLS // max(1, int(lengths[b].max()))))]
        rows = 1 + np.cumsum(a[at][1:] != a[at][:-1])  # a row's pairs stand together
        at = at[: 1 + int(np.searchsorted(rows, max(1, LCS_MASKS // (blocks * values)), "right"))]
        begin += len(at)
        at = at[np.argsort(-lengths[b[at]], kind="stable")]
        rows, x = np.unique(a[at], return_inverse=True)
        of = codes[rows]
        masks = np.zeros((blocks, len(rows) * values), dtype=np.uint64)
        for k in range(min(blocks * PLACES, of.shape[1])):
            masks[k // PLACES, np.arange(len(rows)) * values + of[:, k]] |= np.uint64(1) << np.uint64(k % PLACES)
        n = lengths[b[at]]
        steps = int(n[0])
        active = np.searchsorted(-n, -np.arange(steps), "left")
        symbols = np.ascontiguousarray(codes[b[at], :steps].T).astype(np.intp)
        symbols += x * values
        full, top = (np.uint64(1) << np.uint64(PLACES)) - np.uint64(1), np.uint64(PLACES)
        left = np.full((blocks, len(at)), full)
        both, sums, carry = (np.empty(len(at), dtype=np.uint64) for _ in range(3))
        for t in range(steps):
            k = int(active[t])
            where, m, s, c = symbols[t, :k], both[:k], sums[:k], carry[:k]
            for w in range(blocks):
                v = left[w, :k]
                np.take(masks[w], where, out=m, mode="clip")
                np.bitwise_and(m, v, out=m)
                np.add(v, m, out=s)
                if w:
                    np.add(s, c, out=s)
                if w + 1 < blocks:
                    np.right_shift(s, top, out=c)
                np.bitwise_xor(v, m, out=m)
                np.bitwise_or(s, m, out=s)
                np.bitwise_and(s, full, out=v)
        for w in range(blocks):
            bits = np.clip(lengths[rows] - PLACES * w, 0, PLACES).astype(np.uint64)
            out[at] += np.bitwise_count(~left[w] & ((np.uint64(1) << bits) - np.uint64(1))[x]).astype(np.int64)
    return out


def edit_distances(codes: np.ndarray, lengths: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Levenshtein's distance of each pair of rows, by bit vectors of the rows ``a`` (Myers, Hyyrö)."""
    masks = _masks(codes)
    blocks, _, values = masks.shape
    out = np.empty(len(a), dtype=np.int64)
    order = np.argsort(-lengths[b], kind="stable")
    one, top = np.uint64(1), np.uint64(63)
    for begin in range(0, len(order), CELLS // 16):
        at = order[begin : begin + CELLS // 16]
        x, y, n = a[at], b[at], lengths[b[at]]
        steps = int(n[0])
        active = np.searchsorted(-n, -np.arange(steps), "left")
        symbols = np.ascontiguousarray(codes[y, :steps].T).astype(np.int64)
        plus = np.full((blocks, len(at)), ~np.uint64(0))
        minus = np.zeros((blocks, len(at)), dtype=np.uint64)
        for t in range(steps):
            k = int(active[t])
            where = x[:k] * values + symbols[t, :k]
            carry_plus, carry_minus = one, np.uint64(0)  # the row above the first grows by one a step
            for w in range(blocks):
                eq = masks[w].reshape(-1)[where]
                p, m = plus[w, :k], minus[w, :k]
                vertical = eq | m
                eq = eq | carry_minus
                horizontal = (((eq & p) + p) ^ p) | eq
                up = m | ~(horizontal | p)
                down = p & horizontal
                out_plus, out_minus = up >> top, down >> top
                up = (up << one) | carry_plus
                down = (down << one) | carry_minus
                minus[w, :k] = up & vertical
                plus[w, :k] = down | ~(vertical | up)
                carry_plus, carry_minus = out_plus, out_minus
        distance = n.copy()
        for w in range(blocks):
            low = _places(lengths[x], w)
            distance += np.bitwise_count(plus[w] & low).astype(np.int64) - np.bitwise_count(minus[w] & low).astype(np.int64)
        out[at] = distance
    return out
