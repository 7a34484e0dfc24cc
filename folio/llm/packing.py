"""Filling containers of a fixed capacity with texts measured in tokens of a public tokenizer.

Shortest-pack-first over the histogram of lengths: lengths are placed longest first, always into the open pattern
with the most room; when none has room, new containers are opened and filled with as many of that length as fit.
Only pattern counts are kept, so the plan's size depends on the capacity and not on the number of texts. The
patterns are joined back to the texts by each text's rank among texts of its length.
"""

from __future__ import annotations

import base64
import heapq
import importlib.util
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.session import cut_lineage

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"


def load_encoding(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY):
    """The public byte-level BPE of ``folder``; strings of special tokens are ordinary text."""
    import tiktoken

    spec = importlib.util.spec_from_file_location("folio_public_tokenizers", f"{folder}/__init__.py")
    public = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(public)
    with open(f"{folder}/{vocabulary}") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(str.split, lines)}
    return tiktoken.Encoding("folio", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, key: str, text: str, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens) of whole texts; null and empty texts have 0 tokens."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = load_encoding(folder, vocabulary)
        for b in batches:
            n = [len(encoding.encode_ordinary(t)) if t else 0 for t in b["t"]]
            yield pd.DataFrame({"key": b["key"], "n_tokens": np.asarray(n, dtype="int64")})

    slim = df.select(F.col(key).alias("key"), F.col(text).alias("t"))
    return slim.mapInPandas(count, f"key {slim.schema['key'].dataType.simpleString()}, n_tokens long")


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """[(((length, copies), ...), containers)]: patterns by shortest-pack-first, longest lengths first."""
    room: dict[int, list] = defaultdict(list)
    heap: list[int] = []

    def put(left: int, pattern: tuple, n: int) -> None:
        if not room[left]:
            heapq.heappush(heap, -left)
        room[left].append((pattern, n))

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n > 0:
            while heap and not room[-heap[0]]:
                heapq.heappop(heap)
            left = -heap[0] if heap else -1
            if left < length:
                each = capacity // length
                full, rest = divmod(n, each)
                if full:
                    put(capacity - each * length, ((length, each),), full)
                if rest:
                    put(capacity - rest * length, ((length, rest),), 1)
                break
            pattern, count = room[left].pop()
            take = min(n, count)
            if take < count:
                room[left].append((pattern, count - take))
            last, copies = pattern[-1]
            longer = (*pattern[:-1], (length, copies + 1)) if last == length else (*pattern, (length, 1))
            put(left - length, longer, take)
            n -= take
    return [x for left in room for x in room[left]]


def placement_table(patterns: list, capacity: int) -> pd.DataFrame:
    """(length, rank_from, copies, container_from, start): which ranks of a length go to which containers."""
    rows, container, used = [], 0, defaultdict(int)
    for pattern, n in patterns:
        start = 0
        for length, copies in pattern:
            rows.append((length, used[length], copies, container, start))
            used[length] += n * copies
            start += length * copies
        container += n
    t = pd.DataFrame(rows, columns=["length", "rank_from", "copies", "container_from", "start"])
    return t.sort_values(["length", "rank_from"], ignore_index=True)


def ranked(items: DataFrame, by: str, order: list[str], salts: int) -> DataFrame:
    """``items`` with ``rank`` from 0 among rows of one ``by``, without any task seeing a whole hot value.

    Rows are numbered within salted parts of each value; the parts' counts (at most ``salts`` a value) give offsets.
    """
    salted = items.withColumn("salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    part = Window.partitionBy(by, "salt").orderBy(*order)
    ahead = Window.partitionBy(by).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy(by, "salt").count().select(by, "salt", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("offset"))
    numbered = salted.withColumn("n", F.row_number().over(part) - 1)
    return numbered.join(offsets, [by, "salt"]).select(*items.columns, (F.col("offset") + F.col("n")).alias("rank"))


def pack(
    df: DataFrame,
    key: str,
    text: str,
    *,
    capacity: int = 2048,
    folder: str = TOKENIZERS,
    vocabulary: str = VOCABULARY,
    salts: int = 64,
) -> DataFrame:
    """(key, part, n_tokens, container, start): the place of every text, or of every piece of an oversized one.

    A text longer than the capacity is cut into full pieces, each a container of its own, and a remainder that is
    packed like any text; no other text is split. Null and empty texts have no tokens and take no place. Repeated
    rows are separate items (ties in rank are broken by their piece and are interchangeable). An empty table packs
    to an empty result. Other columns are not read. The histogram has at most ``capacity`` rows, whatever the input.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    spark = df.sparkSession
    counted = token_counts(df, key, text, folder, vocabulary).where("n_tokens > 0")
    pieces = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_tokens") - 1) / capacity))
    items = cut_lineage(
        counted.select("key", "n_tokens", F.explode(pieces).alias("part")).select(
            "key", "part", F.least(F.lit(capacity).cast("long"), F.col("n_tokens") - F.col("part") * capacity).alias("length")
        )
    )
    histogram = {r["length"]: r["count"] for r in items.groupBy("length").count().collect()}
    table = placement_table(pack_histogram(histogram, capacity), capacity)
    shared = spark.sparkContext.broadcast({c: table[c].to_numpy() for c in table})

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = shared.value
        first = {int(v): i for v, i in zip(*np.unique(t["length"], return_index=True))}
        for b in batches:
            length, rank = b["length"].to_numpy(), b["rank"].to_numpy()
            at = np.empty(len(b), dtype="int64")
            for v in np.unique(length):
                own, lo = length == v, first[int(v)]
                hi = np.searchsorted(t["length"], v, side="right")
                at[own] = lo + np.searchsorted(t["rank_from"][lo:hi], rank[own], side="right") - 1
            inside = rank - t["rank_from"][at]
            copy = inside % t["copies"][at]
            yield pd.DataFrame(
                {
                    "key": b["key"],
                    "part": b["part"],
                    "n_tokens": length,
                    "container": t["container_from"][at] + inside // t["copies"][at],
                    "start": t["start"][at] + copy * length,
                }
            )

    kind = items.schema["key"].dataType.simpleString()
    return ranked(items, "length", ["key", "part"], salts).mapInPandas(
        place, f"key {kind}, part long, n_tokens long, container long, start long"
    )


def fill_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: items, tokens, containers and the share of their space that is used."""
    return (
        packed.groupBy("container")
        .agg(F.count("*").alias("items"), F.sum("n_tokens").alias("tokens"))
        .agg(F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), F.count("*").alias("containers"), F.max("tokens").alias("fullest"))
        .withColumn("used", F.round(F.col("tokens") / (F.col("containers") * capacity), 6))
    )
