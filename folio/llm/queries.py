"""Queries of the training-data problems over the archive's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import abuse, alignment, chars, leakage, names, neardup, packing, scans, truncation
from folio.registry import Registry
from folio.sources.tables import table

LLM = Registry()


def _tagged(name: str, df: DataFrame) -> DataFrame:
    return df.select(F.lit(name).alias("tbl"), *df.columns)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


@LLM.add("p7_found")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    voices = chars.same_reading(table(spark, d, "nap_voices"), "id", "displayText")
    letters = chars.same_reading(table(spark, d, "nap_1794"), "id", "originalText")
    return _union([_tagged("nap_voices", voices), _tagged("nap_1794", letters)])


@LLM.add("p8_containers")
def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("key", "doc_id")


@LLM.add("p8_fill")
def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(packing.pack(table(spark, d, "documents"), "doc_id", "text"))


P9_SQL = r"""
with i as (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from heldout_items),
     iw as (select distinct item_id, array_to_string(w[k:k + 11], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 10)) as k from i)),
     t as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents),
     tw as (select doc_id, array_to_string(w[k:k + 11], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 10)) as k from t))
select distinct doc_id, item_id from tw join iw using (g)
"""


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_passages(table(spark, d, "documents"), table(spark, d, "heldout_items"))


@LLM.add("p9_found", P9_SQL)
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).where("longest_run >= 12").select("doc_id", "item_id")


@LLM.add("p9_alignments")
def p9_alignments(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).withColumn("share", F.round(F.col("score") / (2 * F.col("item_words")), 4))


@LLM.add("p9_items")
def p9_items(spark: SparkSession, d: str) -> DataFrame:
    leaked = _leaks(spark, d).where("longest_run >= 12")
    return leaked.groupBy("item_id").agg(F.count("*").alias("documents"), F.max("longest_run").alias("longest_run"))


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Both tables in one run; records of different tables are never compared."""
    kept = (("nap_voices", "id", "displayText", True), ("tarbell", "piece_key", "body", False))
    rows = [table(spark, d, t).select(F.lit(t).alias("tbl"), F.col(k).alias("key"), F.col(x).alias("text"), F.lit(p).alias("printed")) for t, k, x, p in kept]
    return neardup.near_duplicates(_union(rows), "key", "text", as_printed=F.col("printed"), within="tbl")


@LLM.add("p3_found")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.key_pairs(*_versions(spark, d)).withColumnRenamed("part", "tbl")


@LLM.add("p3_links")
def p3_links(spark: SparkSession, d: str) -> DataFrame:
    return neardup.link_counts(*_versions(spark, d)).withColumnRenamed("part", "tbl")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return abuse.score_documents(table(spark, d, "documents"), table(spark, d, "review_labels"), keep=("source",))


@LLM.add("p10_found")
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).where("passages > 0").select("doc_id").distinct()


@LLM.add("p10_scores")
def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d)


@LLM.add("p10_rates")
def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(_scored(spark, d), "source")


def _addressees(spark: SparkSession, d: str) -> DataFrame:
    """(rec_key, mention) of both tables, the table's name in front of the key; places and dates of titles cut off."""
    letters = table(spark, d, "wellington").select(F.concat(F.lit("wellington/"), "piece_key").alias("rec_key"), F.col("to").alias("mention"))
    title = F.regexp_replace("sourceTitle", r",?\s*\d{4}-\d{2}-\d{2}\s*$", "")
    last = F.lower(F.trim(F.element_at(F.split("title", ","), -1)))
    voices = table(spark, d, "nap_voices")
    places = voices.select(F.lower(F.trim("location")).alias("last")).where("last <> ''").distinct().withColumn("place", F.lit(True))
    cut = F.when(F.col("place") & F.col("title").contains(","), F.regexp_replace("title", r",[^,]*$", "")).otherwise(F.col("title"))
    titles = (
        voices.where(F.col("sourceTitle").rlike(r"(?i)^\s*to\s"))
        .select(F.concat(F.lit("nap_voices/"), "id").alias("rec_key"), title.alias("title"))
        .withColumn("last", last)
        .join(places, "last", "left")
        .select("rec_key", cut.alias("mention"))
    )
    return letters.unionByName(titles)


@LLM.add("p6_found")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    linked = names.link_records(_addressees(spark, d), table(spark, d, "correspondents"))
    key = F.split("rec_key", "/", 2)
    return linked.select(key[0].alias("tbl"), key[1].alias("rec_key"), "person_id")


@LLM.add("p6_variants")
def p6_variants(spark: SparkSession, d: str) -> DataFrame:
    said = _addressees(spark, d).where("mention is not null").groupBy("mention").agg(F.count("*").alias("n"))
    linked = names.link_mentions(said, table(spark, d, "correspondents"))
    return said.join(linked, "mention").groupBy("person_id").agg(F.count("*").alias("variants"), F.sum("n").alias("records"))


def _endings(spark: SparkSession, d: str, name: str) -> DataFrame:
    text = {"nap_voices": "displayText", "shard_sthelena": "originalText"}[name]
    return truncation.assess_endings(table(spark, d, name), "id", text, F.col("archive"))


@LLM.add("p1_found")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [_tagged(t, _endings(spark, d, t).where("cut").select("rec_key").distinct()) for t in ("nap_voices", "shard_sthelena")]
    return _union(parts)


@LLM.add("p1_rates")
def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    return _union([_tagged(t, truncation.cut_rates(_endings(spark, d, t))) for t in ("nap_voices", "shard_sthelena")])


@LLM.add("p2_found")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = alignment.align(table(spark, d, "shard_sthelena"), "id", "originalText", "displayText", table(spark, d, "glossary"))
    return pairs.toDF("id", "orig_no", "disp_no")


SCANNED = (("tarbell", "piece_key", "body"), ("wellington", "piece_key", "body"), ("nap_1794", "id", "originalText"))


def _scanned(spark: SparkSession, d: str) -> DataFrame:
    """(key, text) of the three tables, the table's name in front of the key: they share one vocabulary."""
    return _union(
        [table(spark, d, t).select(F.concat(F.lit(t + "/"), F.col(k)).alias("key"), F.col(x).alias("text")) for t, k, x in SCANNED]
    )


def _untagged(df: DataFrame, *rest: str) -> DataFrame:
    key = F.split("rec_key", "/", 2)
    return df.select(key[0].alias("tbl"), key[1].alias("rec_key"), *rest)


@LLM.add("p4_found")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _untagged(scans.kinds(_scanned(spark, d), "key", "text"), "kind")


@LLM.add("p4_texts")
def p4_texts(spark: SparkSession, d: str) -> DataFrame:
    return _untagged(scans.restored(_scanned(spark, d), "key", "text"), "text")
