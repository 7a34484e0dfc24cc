"""Sinks: partitioned shards with fingerprints, the manifest, and an append that skips what is already there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions.dates import era_of


def write_shards(records: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet by era, sorted by date and id within files so that min/max statistics prune."""
    rows = records.withColumn("era", F.coalesce(era_of(F.col("date")), F.lit("undated")))
    # an era may hold most rows: files are split by date range, not by one task an era
    rows.repartitionByRange("era", "date", "id").sortWithinPartitions("era", "date", "id").write.mode(mode).partitionBy("era").parquet(path)


def fingerprint(*columns: str) -> Column:
    """Order-free checksum of rows: the same whatever the files and their order."""
    text = F.concat_ws("␟", *[F.coalesce(F.col(c).cast("string"), F.lit("␀")) for c in columns])
    return F.sum(F.conv(F.substring(F.sha2(text, 256), 1, 11), 16, 10).cast("decimal(38,0)"))


def shard_manifest(shards: DataFrame) -> DataFrame:
    """(era, records, first_date, last_date, checksum) of written shards."""
    return shards.groupBy("era").agg(
        F.count("*").alias("records"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), fingerprint("id", "date", "displayText").alias("checksum")
    )


def verify_shards(shards: DataFrame, manifest: DataFrame) -> DataFrame:
    """Eras whose written rows differ from the manifest, and eras only one side has."""
    now = shard_manifest(shards).select("era", F.col("records").alias("r"), F.col("checksum").alias("c"))
    both = manifest.select("era", "records", "checksum").join(now, "era", "full_outer")
    return both.where(~F.col("records").eqNullSafe(F.col("r")) | ~F.col("checksum").eqNullSafe(F.col("c")))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines, characters unescaped."""
    df.write.mode(mode).json(path)


def write_manifest(spark: SparkSession, manifest: DataFrame, path: str) -> None:
    """One JSON object of the shard rows; there are as many as eras."""
    one = manifest.agg(F.to_json(F.sort_array(F.collect_list(F.struct(*manifest.columns)))).alias("value"))
    one.coalesce(1).write.mode("overwrite").text(path)


def append_new(df: DataFrame, path: str, key: str) -> int:
    """Appends rows whose key the table does not have yet; a run that was cut short is continued by running again."""
    spark = df.sparkSession
    try:
        done = spark.read.parquet(path).select(key).distinct()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = None
    new = df if done is None else df.join(done, key, "left_anti")
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    return n


# Keys a manifest object must have.
MANIFEST_KEYS = ("counts", "contentSpan", "byYear", "dateCount", "authors", "builtFrom", "shards", "shardByYear")


def write_object(sections: DataFrame, path: str) -> None:
    """One JSON object of (section, key, value): a map a section. A manifest has as many entries as days and authors."""
    maps = sections.where("key is not null").groupBy("section").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("m"))
    one = maps.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("section", F.to_json("m")))))).alias("value"))
    one.coalesce(1).write.mode("overwrite").text(path)


def manifest_problems(spark: SparkSession, path: str) -> list[str]:
    """What is wrong with a written manifest object: not JSON, keys missing, no shards."""
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.from_json("value", "map<string,string>").alias("o")).first()
    if parsed is None or parsed["o"] is None:
        return ["not an object"]
    found = [f"missing key {k}" for k in MANIFEST_KEYS if k not in parsed["o"]]
    return found + (["no shards"] if parsed["o"].get("shards") in (None, "{}") else [])
