"""Admission, deduplication and merging of records, with aggregation before every shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_delivery(df: DataFrame, key: str, *order: Column, columns: tuple[str, ...] = ()) -> DataFrame:
    """One row a key: the least by ``order``. Partial aggregation keeps one candidate a task, so hot keys are cheap.

    With ``columns`` only the key and these are kept, so that the scan reads them and the order alone.
    """
    row = F.struct(*[F.col(c) for c in (dict.fromkeys((key, *columns)) if columns else df.columns)])
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(row, F.struct(*order)).alias("r")).select("r.*")


def longest(df: DataFrame, keys: list[str], text: str, tie: str) -> DataFrame:
    """One row a key: the one with the longest text, the least ``tie`` of equals."""
    row = F.struct(*[F.col(c) for c in df.columns])
    order = F.struct(-F.coalesce(F.length(text), F.lit(0)), F.col(tie))
    return df.groupBy(*keys).agg(F.min_by(row, order).alias("r")).select("r.*")


def admit(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(admitted, rejected): rows that break no rule, and the others with the first ``reason``; a rule true rejects."""
    reason = F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()])
    judged = df.withColumn("reason", reason)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def override(df: DataFrame, changes: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """Left join of corrections: a non-blank value of ``changes`` replaces the column it is mapped to."""
    kept = changes.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in columns])
    joined = df.join(kept, key, "left")
    for new, old in columns.items():
        value = F.when(F.trim(F.col(f"__{new}").cast("string")) != "", F.col(f"__{new}"))
        joined = joined.withColumn(old, F.coalesce(value, F.col(old)))
    return joined.select(df.columns)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both by key, the new row where both have one; a full outer join of columns of equal names."""
    a, b = old.alias("a"), new.alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    is_new = F.col(f"b.{key}").isNotNull()
    return both.select(*[F.when(is_new, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in old.columns])


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(rule, severity, key): one row for each rule a row breaks; ``rules`` maps ``severity:name`` to a condition."""
    flags = F.array_compact(
        F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(n.split(":")[1]).alias("rule"), F.lit(n.split(":")[0]).alias("severity"))) for n, c in rules.items()])
    )
    return df.select(F.col(key).alias("key"), F.explode(flags).alias("v")).select("v.rule", "v.severity", "key")
