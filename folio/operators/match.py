"""Matching of records by date, containment, similarity and shared words; always blocked, never a cross join."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.operators import likeness


def nearest_date(probes: DataFrame, probe: str, dated: DataFrame, date: str) -> DataFrame:
    """``probes`` with ``nearest``: the closest of the distinct dates, the earlier of two equally close; null without any.

    Probes and dates are put in one order of days; the last date before and the first after come from windows over
    a year at a time. A year without a date before (or after) takes the last of the years before (the first after),
    of which there are as many as years in the calendar.
    """
    days = dated.select(F.col(date).alias("__d")).where("__d is not null").distinct().withColumn("__y", F.year("__d"))
    years = days.groupBy("__y").agg(F.min("__d").alias("first"), F.max("__d").alias("last"))
    asked = probes.select(F.col(probe).alias("__d")).where("__d is not null").distinct().withColumn("__y", F.year("__d"))
    all_years = years.unionByName(asked.select("__y").distinct(), allowMissingColumns=True).groupBy("__y").agg(F.max("first").alias("first"), F.max("last").alias("last"))
    order = Window.orderBy("__y")
    ends = all_years.select(
        "__y",
        F.last("last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("__past"),
        F.first("first", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("__coming"),
    )
    both = asked.withColumn("__hit", F.lit(None).cast("date")).unionByName(days.withColumn("__hit", F.col("__d")))
    merged = both.groupBy("__y", "__d").agg(F.max("__hit").alias("__hit"))
    in_year = Window.partitionBy("__y").orderBy("__d")
    around = merged.select(
        "__y", "__d",
        F.last("__hit", ignorenulls=True).over(in_year.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("__b"),
        F.first("__hit", ignorenulls=True).over(in_year.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("__a"),
    )
    known = around.join(ends, "__y")
    before, after = F.coalesce("__b", "__past"), F.coalesce("__a", "__coming")
    closer = F.datediff(after, F.col("__d")) < F.datediff(F.col("__d"), before)
    best = known.select(F.col("__d").alias(probe), F.when(before.isNull() | F.coalesce(closer, F.lit(False)), after).otherwise(before).alias("nearest"))
    return probes.join(best, probe, "left").select(*probes.columns, "nearest")


def band_pairs(a: DataFrame, b: DataFrame, date: str, days: int) -> DataFrame:
    """``a`` joined with rows of ``b`` whose date is at most ``days`` away, as an equi-join on shifted dates."""
    shifts = F.array(*[F.lit(i) for i in range(-days, days + 1)])
    near = a.withColumn("near", F.explode(F.transform(shifts, lambda x: F.date_add(F.col(date), x.cast("int")))))
    return near.join(b.withColumnRenamed(date, "near"), "near")


def first_match(pairs: DataFrame, key: str, *order: Column) -> DataFrame:
    """The least pair by ``order`` for each key, aggregated before the shuffle."""
    row = F.struct(*[F.col(c) for c in pairs.columns])
    return pairs.groupBy(key).agg(F.min_by(row, F.struct(*order)).alias("r")).select("r.*")


def as_of(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, value: str) -> DataFrame:
    """``left`` with the last ``value`` of ``right`` for the key at or before ``left_at``, null if there is none."""
    a = left.select(*left.columns, F.col(left_at).alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast(right.schema[value].dataType).alias("__value"))
    b = right.select(F.col(key), F.col(right_at).alias("__at"), F.lit(0).alias("__side"), F.col(value).alias("__value"))
    w = Window.partitionBy(key).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(b, allowMissingColumns=True).withColumn(value, F.last("__value", ignorenulls=True).over(w))
    return both.where("__side = 1").select(*left.columns, value)


#: Rows of a block that are paired at once, pairs measured at once, and texts a greedy walk decides about at once.
CELL_ROWS, PAIRS, AHEAD = 1000, 300_000, 200
#: Characters, as many for each text as the longest has, of the days that are walked together.
WALKED = 1 << 25


def _in_cells(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of a sorted partition such that none of its cells (equal ``names``) is spread over two batches."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        if held and any(held[0].column(n)[0].as_py() != b.column(n)[0].as_py() or b.column(n)[0].as_py() != b.column(n)[-1].as_py() for n in names):
            # the cell held may go on in this batch, whose own last cell may go on in the next
            b = pa.Table.from_batches([*held, b]).combine_chunks().to_batches()[0]
            held = []
        if not held:
            same = np.ones(b.num_rows, dtype=bool)
            for n in names:
                codes = _codes(b.column(n))
                same &= codes == codes[-1]
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                yield b.slice(0, cut)
            held = [b.slice(cut)]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _codes(column: pa.Array) -> np.ndarray:
    return column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def pairs_within(df: DataFrame, block: str, key: str, text: str, measure: Callable, value: str) -> DataFrame:
    """(key_a, key_b, ``value``) of the pairs of a block, key_a < key_b, that ``measure`` keeps.

    ``measure(codes, lengths, a, b)`` gives (keep, values) for pairs of rows of ``likeness.coded``. Texts repeated in a
    batch are measured once. A block of many rows is cut into parts, each pair of parts a cell, and cells go over all
    cores; no pair is left out. Keys are distinct strings; null blocks and texts take no part.
    """
    rows = df.select(F.col(block).alias("block"), F.col(key).alias("key"), F.col(text).alias("text")).where("block is not null and key is not null and text is not null")
    cuts = rows.groupBy("block").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("cuts"))
    own, other = F.expr("cast(pmod(xxhash64(key), cuts) as int)"), F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))
    placed = rows.join(cuts, "block").select("block", "key", "text", own.alias("own"), other.alias("other"))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    cells = placed.select("block", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), side.alias("side"), "key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _in_cells(batches, ["block", "low", "high"]):
            cell = np.zeros(b.num_rows, dtype=np.int64)
            for n in ("block", "low", "high"):
                c = _codes(b.column(n))
                cell[1:] += c[1:] != c[:-1]
            cell = np.cumsum(cell > 0)
            side = b.column("side").to_numpy()
            end = np.searchsorted(cell, cell, "right")
            start = np.where(side == 0, np.arange(len(cell)) + 1, np.searchsorted(cell * 3 + side, cell * 3 + 2, "left"))
            n = np.where(side == 2, 0, end - start)
            of = b.column("text").dictionary_encode()
            codes, lengths = likeness.coded(of.dictionary.to_pylist())
            of = of.indices.to_numpy().astype(np.int64)
            order = np.argsort(np.array(b.column("key").to_pylist(), dtype=object), kind="stable")
            rank = np.empty(len(order), dtype=np.int64)
            rank[order] = np.arange(len(order))
            to = np.cumsum(n)
            begin = 0
            while begin < len(n):
                stop = max(begin + 1, int(np.searchsorted(to, (to[begin - 1] if begin else 0) + PAIRS, "right")))
                m = n[begin:stop]
                i = np.repeat(np.arange(begin, stop), m)
                j = np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(start[begin:stop], m)
                begin = stop
                i, j = np.where(rank[i] < rank[j], i, j), np.where(rank[i] < rank[j], j, i)
                texts, where = np.unique(of[i] * len(lengths) + of[j], return_inverse=True)
                keep, values = measure(codes, lengths, texts // len(lengths), texts % len(lengths))
                kept = np.flatnonzero(keep[where])
                if len(kept):
                    keys = b.column("key")
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(i[kept])), keys.take(pa.array(j[kept])), pa.array(values[where[kept]])], names=["key_a", "key_b", value])

    kind = {"edits": "int", "ratio": "double"}[value]
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * df.sparkSession.sparkContext.defaultParallelism)
    spread = cells.repartition(parts, "block", "low", "high").sortWithinPartitions("block", "low", "high", "side", "key")
    return spread.mapInArrow(run, f"key_a string, key_b string, {value} {kind}")


def edits_within(df: DataFrame, block: str, key: str, text: str, most: int) -> DataFrame:
    """(key_a, key_b, edits): pairs of a block at most ``most`` edits apart."""

    def measure(codes, lengths, a, b):
        d = likeness.edit_distances(codes, lengths, a, b)
        return d <= most, d.astype(np.int32)

    return pairs_within(df, block, key, text, measure, "edits")


def ratios_within(df: DataFrame, block: str, key: str, text: str, least: float) -> DataFrame:
    """(key_a, key_b, ratio): pairs of a block whose difflib ratio is above ``least``; texts of under 200 characters."""

    def measure(codes, lengths, a, b):
        r = likeness.ratios(codes, lengths, a, b, least)
        return r > least, r

    return pairs_within(df, block, key, text, measure, "ratio")


def _kept(texts: list[np.ndarray], codes: np.ndarray, lengths: np.ndarray, ratio: float) -> list[set[int]]:
    """Of each list of distinct rows those kept, walking it in order; the lists go side by side."""
    kept: list[list[int]] = [[] for _ in texts]
    for begin in range(0, max(map(len, texts), default=0), AHEAD):
        now = [(k, t[begin : begin + AHEAD]) for k, t in enumerate(texts) if len(t) > begin]
        a, b, owner = [], [], []
        for k, t in now:
            old = np.array(kept[k], dtype=np.int64)
            i, j = np.tril_indices(len(t), -1)
            a += [np.repeat(t, len(old)), t[i]]
            b += [np.tile(old, len(t)), t[j]]
            owner.append(np.full(len(t) * len(old) + len(i), k))
        a, b, owner = np.concatenate(a), np.concatenate(b), np.concatenate(owner)
        over = np.concatenate([likeness.exceeds(codes, lengths, a[c : c + PAIRS], b[c : c + PAIRS], ratio) for c in range(0, len(a), PAIRS)] or [np.zeros(0, dtype=bool)])
        near: dict[tuple[int, int], list[int]] = {}
        for k, x, y in zip(owner[over].tolist(), a[over].tolist(), b[over].tolist(), strict=True):
            near.setdefault((k, x), []).append(y)
        for k, t in now:
            held = set(kept[k])
            for x in t.tolist():
                if held.isdisjoint(near.get((k, x), ())):
                    held.add(x)
                    kept[k].append(x)
    return [set(k) for k in kept]


def greedy_distinct(df: DataFrame, block: str, order: str, text: str, ratio: float) -> DataFrame:
    """Rows kept when walking each block in order and dropping a row too similar to one already kept.

    Whole texts are compared, by difflib's ratio with ``autojunk=False``: from 200 characters on difflib would
    otherwise leave the frequent characters out. Each decision depends on the ones before it, so a block is walked by
    one task; blocks are small by choice (a day). A text met again in its block is dropped, like the first or for it.
    A missing text counts as an empty one; ``ratio`` is under 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _in_cells(batches, [block]):
            texts = [x or "" for x in b.column(text).to_pylist()]
            day = _codes(b.column(block))
            cuts = [*np.flatnonzero(np.concatenate([[True], day[1:] != day[:-1]])).tolist(), len(day)]
            keep = np.zeros(b.num_rows, dtype=bool)
            first = 0
            while first < len(cuts) - 1:
                last, longest = first, 1
                while last < len(cuts) - 1:
                    longest = max(longest, max(map(len, texts[cuts[last] : cuts[last + 1]])))
                    if last > first and (cuts[last + 1] - cuts[first]) * longest > WALKED:
                        break
                    last += 1
                begin, end = cuts[first], cuts[last]
                of = pa.array(texts[begin:end], type=pa.string()).dictionary_encode()
                codes, lengths = likeness.coded(of.dictionary.to_pylist())
                of = of.indices.to_numpy().astype(np.int64)
                starts = np.array(cuts[first:last]) - begin
                firsts = [s + np.sort(np.unique(x, return_index=True)[1]) for s, x in zip(starts, np.split(of, starts[1:]), strict=True)]
                for rows, kept in zip(firsts, _kept([of[r] for r in firsts], codes, lengths, ratio), strict=True):
                    keep[begin + rows] = [x in kept for x in of[rows].tolist()]
                first = last
            yield b.filter(pa.array(keep))

    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(parts, block).sortWithinPartitions(F.col(block), F.col(order).asc_nulls_last()).mapInArrow(run, df.schema)
