"""Data-quality rules over the archive: each is a set of violations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions.dates import safe_date
from folio.operators.records import violations
from folio.plans.archive import KNOWN_LABELS, REC
from folio.plans.archive import records as voices
from folio.plans.matching import SHARD, shard
from folio.registry import CORE
from folio.sources.tables import table

LABELS_SQL = ", ".join(f"'{x}'" for x in KNOWN_LABELS)
RULES_SQL = {
    "err:date_format": "not regexp_matches(coalesce(date, ''), '^[0-9]{4}-[0-9]{2}-[0-9]{2}$')",
    "err:date_exists": "try_cast(date as date) is null",
    "err:id_format": "not regexp_matches(id, '^nap-[0-9]{8}-[0-9]+$')",
    "err:id_encodes_date": "substr(id, 5, 8) <> replace(coalesce(date, ''), '-', '')",
    "err:blank_text": "trim(coalesce(displayText, '')) = ''",
    "err:blank_title": "trim(coalesce(sourceTitle, '')) = ''",
    "err:time_label": f"coalesce(timeLabel, '') not in ({LABELS_SQL})",
    "err:certainty": "coalesce(dateCertainty, '') not in ('certain', 'approximate')",
    "warn:blank_place": "trim(coalesce(location, '')) = ''",
    "warn:padded_place": "location <> trim(location)",
    "warn:no_event": "eventIds is null or len(eventIds) = 0",
    "warn:double_space": "contains(displayText, '  ')",
}


def _rules() -> dict:
    c = F.col
    e = F.lit("")
    return {
        "err:date_format": ~F.coalesce("date", e).rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"),
        "err:date_exists": safe_date(c("date")).isNull(),
        "err:id_format": ~c("id").rlike("^nap-[0-9]{8}-[0-9]+$"),
        "err:id_encodes_date": F.substring("id", 5, 8) != F.replace(F.coalesce("date", e), F.lit("-"), e),
        "err:blank_text": F.trim(F.coalesce("displayText", e)) == "",
        "err:blank_title": F.trim(F.coalesce("sourceTitle", e)) == "",
        "err:time_label": ~F.coalesce("timeLabel", e).isin(*KNOWN_LABELS),
        "err:certainty": ~F.coalesce("dateCertainty", e).isin("certain", "approximate"),
        "warn:blank_place": F.trim(F.coalesce("location", e)) == "",
        "warn:padded_place": c("location") != F.trim("location"),
        "warn:no_event": c("eventIds").isNull() | (F.size("eventIds") == 0),
        "warn:double_space": c("displayText").contains("  "),
    }


VIOLATIONS_SQL = " union all ".join(f"select '{n.split(':')[1]}' as rule, '{n.split(':')[0]}' as severity, id as key from rec where {q}" for n, q in RULES_SQL.items())


@CORE.add("rule_violations", f"with {REC} {VIOLATIONS_SQL}")
def rule_violations(spark: SparkSession, d: str) -> DataFrame:
    """Every rule in one pass over the records."""
    return violations(voices(spark, d), "id", _rules())


@CORE.add("rule_counts", f"with {REC}, v as ({VIOLATIONS_SQL}) select rule, severity, count(*) as records, min(key) as example from v group by 1, 2")
def rule_counts(spark: SparkSession, d: str) -> DataFrame:
    return rule_violations(spark, d).groupBy("rule", "severity").agg(F.count("*").alias("records"), F.min("key").alias("example"))


@CORE.add("duplicate_ids", "select id, count(*) as deliveries, count(distinct displayText) as texts from nap_voices group by id having count(*) > 1")
def duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nap_voices").groupBy("id").agg(F.count("*").alias("deliveries"), F.count_distinct("displayText").alias("texts")).where("deliveries > 1")


@CORE.add(
    "enum_domains",
    f"with {REC} select 'evidenceType' as field, evidenceType as value, count(*) as records from rec group by 2 union all select 'timeLabel', timeLabel, count(*) from rec group by 2 union all select 'documentType', documentType, count(*) from rec group by 2",
)
def enum_domains(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the values of enumerated fields, unpivoted so that one aggregation does them all."""
    fields = ("evidenceType", "timeLabel", "documentType")
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])
    return voices(spark, d).select(F.explode(pairs).alias("p")).groupBy("p.field", "p.value").agg(F.count("*").alias("records"))


@CORE.add(
    "manifest_recount",
    f"with {REC} select 'records' as check, (select count(*) from rec) = (select sum(c) from (select count(*) as c from rec group by date)) as equal union all select 'ids', (select count(distinct id) from nap_voices) = (select count(*) from rec)",
)
def manifest_recount(spark: SparkSession, d: str) -> DataFrame:
    """The manifest's totals counted twice in different ways."""
    rec = voices(spark, d)
    by_date = rec.groupBy("date").count().agg(F.sum("count").alias("b"))
    one = rec.agg(F.count("*").alias("a")).select(F.lit("records").alias("check"), (F.col("a") == by_date.scalar()).alias("equal"))
    ids = table(spark, d, "nap_voices").agg(F.count_distinct("id").alias("a"))
    return one.unionByName(ids.select(F.lit("ids").alias("check"), (F.col("a") == rec.agg(F.count("*")).scalar()).alias("equal")))


@CORE.add(
    "quote_containment",
    f"with {SHARD} select id, contains(regexp_replace(lower(displayText), '[^a-z0-9]+', '', 'g'), left(regexp_replace(lower(tweet), '[^a-z0-9]+', '', 'g'), 30)) as contained from shard where trim(tweet) <> '' and displayText is not null",
)
def quote_containment(spark: SparkSession, d: str) -> DataFrame:
    from folio.functions.text import letters_key

    s = shard(spark, d).where("trim(tweet) <> '' and displayText is not null")
    return s.select("id", F.contains(letters_key(F.col("displayText")), F.left(letters_key(F.col("tweet")), F.lit(30))).alias("contained"))
