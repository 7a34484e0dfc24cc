"""References to parent rows that are missing, withdrawn or later than the referring row.

Keys of any orderable type are put into one global order and numbered (order-preserving integer codes), once per
distinct key, so a hot key costs one row. The parents' codes are compressed into contiguous runs; every referenced
code is matched as-of to the run that starts at or before it, and a code beyond that run's end has no parent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.session import cut_lineage

#: A code is the range partition (upper bits) and the position in it.
POSITION_BITS = 33


def key_codes(parent_keys: DataFrame, ref_keys: DataFrame) -> DataFrame:
    """(key, is_parent, is_ref, code, part): distinct non-null keys of both sides, codes in key order.

    The table is written to the shared checkpoint folder: runs and references must see the same codes even if
    an executor is lost between them.
    """
    p = parent_keys.select(parent_keys.columns[0]).toDF("key").distinct().select("key", F.lit(1).alias("p"), F.lit(0).alias("r"))
    r = ref_keys.select(ref_keys.columns[0]).toDF("key").distinct().select("key", F.lit(0).alias("p"), F.lit(1).alias("r"))
    both = p.unionByName(r).where("key is not null").groupBy("key").agg(F.max("p").alias("p"), F.max("r").alias("r"))
    code = F.monotonically_increasing_id()
    coded = (
        both.repartitionByRange("key")
        .sortWithinPartitions("key")
        .select("key", (F.col("p") == 1).alias("is_parent"), (F.col("r") == 1).alias("is_ref"), code.alias("code"))
        .withColumn("part", F.shiftright("code", POSITION_BITS))
    )
    return cut_lineage(coded)


def parent_runs(coded: DataFrame) -> DataFrame:
    """(part, run_start, run_end): maximal runs of consecutive parent codes, by gaps and islands."""
    order = Window.partitionBy("part").orderBy("code")
    island = F.col("code") - F.row_number().over(order)
    return (
        coded.where("is_parent")
        .select("part", "code", island.alias("island"))
        .groupBy("part", "island")
        .agg(F.min("code").alias("run_start"), F.max("code").alias("run_end"))
        .drop("island")
    )


def unmatched_keys(coded: DataFrame, runs: DataFrame) -> DataFrame:
    """(key): referenced keys beyond the end of the run that starts at or before them."""
    refs = coded.where("is_ref").select("part", "code", "key", F.lit(None).cast("long").alias("run_end"), F.lit(1).alias("kind"))
    starts = runs.select("part", F.col("run_start").alias("code"), F.lit(None).cast(coded.schema["key"].dataType).alias("key"), "run_end", F.lit(0).alias("kind"))
    before = Window.partitionBy("part").orderBy("code", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        refs.unionByName(starts)
        .withColumn("run_end", F.last("run_end", ignorenulls=True).over(before))
        .where((F.col("kind") == 1) & (F.col("run_end").isNull() | (F.col("code") > F.col("run_end"))))
        .select("key")
    )


def orphan_references(
    refs: DataFrame,
    parents: DataFrame,
    *,
    ref_id: str,
    ref_keys: Column,
    ref_seen: str,
    parent_key: str,
    parent_seen: str,
    parent_deleted: str,
) -> DataFrame:
    """(ref_id, ref_key, kind): each distinct reference whose parent is missing, deleted or late.

    ``ref_keys`` is an array column; null arrays, null entries and rows with a null id give nothing, an empty
    string is a key like any other. A parent delivered more than once counts from its earliest time and is deleted
    if any delivery says so; null times are later than nothing. Repeated rows give one result row; empty tables
    give an empty result (no parents: everything is missing). Extra columns of either table are not read.
    """
    seen = refs.where(F.col(ref_id).isNotNull()).groupBy(F.col(ref_id).alias("ref_id")).agg(F.min(ref_seen).alias("ref_seen"))
    pairs = (
        refs.where(F.col(ref_id).isNotNull())
        .select(F.col(ref_id).alias("ref_id"), F.explode(ref_keys).alias("ref_key"))
        .where("ref_key is not null")
        .distinct()
    )
    state = parents.where(F.col(parent_key).isNotNull()).groupBy(F.col(parent_key).alias("ref_key")).agg(
        F.min(parent_seen).alias("parent_seen"), F.max(F.col(parent_deleted).isNotNull()).alias("gone")
    )
    coded = key_codes(state.select("ref_key"), pairs.select("ref_key"))
    missing = unmatched_keys(coded, parent_runs(coded)).select(F.col("key").alias("ref_key"), F.lit(True).alias("missing"))
    verdict = missing.unionByName(state, allowMissingColumns=True)
    kind = (
        F.when(F.col("missing"), "missing")
        .when(F.col("gone"), "deleted")
        .when(F.col("parent_seen") > F.col("ref_seen"), "late")
    )
    return (
        pairs.join(verdict, "ref_key")
        .join(seen, "ref_id")
        .select("ref_id", "ref_key", kind.alias("kind"))
        .where("kind is not null")
    )


def orphans_by_period(orphans: DataFrame, refs: DataFrame, *, ref_id: str, period: Column, table: str) -> DataFrame:
    """(tbl, period, kind, refs): orphans per period of the referring row (the least period of its deliveries)."""
    when = refs.where(F.col(ref_id).isNotNull()).groupBy(F.col(ref_id).alias("ref_id")).agg(F.min(period).alias("period"))
    return (
        orphans.join(when, "ref_id")
        .groupBy("period", "kind")
        .agg(F.count("*").alias("refs"))
        .select(F.lit(table).alias("tbl"), "period", "kind", "refs")
    )
