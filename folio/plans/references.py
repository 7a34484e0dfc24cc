"""Queries of problem 5: event references of the voices that lead nowhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators.orphans import orphan_references, orphans_by_period
from folio.registry import CORE
from folio.sources.tables import table

FOUND_SQL = """
with refs as (select distinct id, unnest(eventIds) as event_id from nap_voices),
     seen as (select id, min(loaded_at) as seen from nap_voices group by id),
     ev as (select id, min(loaded_at) as first_loaded, count(deleted_at) as gone from nap_events group by id),
     j as (select r.id, r.event_id, case when e.id is null then 'missing' when e.gone > 0 then 'deleted'
                  when e.first_loaded > s.seen then 'late' end as kind
           from refs r join seen s on s.id = r.id left join ev e on e.id = r.event_id
           where r.event_id is not null)
select id, event_id, kind from j where kind is not null
"""


def _found(spark: SparkSession, d: str) -> DataFrame:
    return orphan_references(
        table(spark, d, "nap_voices"),
        table(spark, d, "nap_events"),
        ref_id="id",
        ref_keys=F.col("eventIds"),
        ref_seen="loaded_at",
        parent_key="id",
        parent_seen="loaded_at",
        parent_deleted="deleted_at",
    )


@CORE.add("p5_found", FOUND_SQL)
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d).toDF("id", "event_id", "kind")


@CORE.add(
    "p5_by_year",
    f"""select 'nap_voices' as tbl, y.period, f.kind, count(*) as refs from ({FOUND_SQL}) f
        join (select id, min(substr(date, 1, 4)) as period from nap_voices group by id) y on y.id = f.id
        group by y.period, f.kind""",
)
def p5_by_year(spark: SparkSession, d: str) -> DataFrame:
    voices = table(spark, d, "nap_voices")
    return orphans_by_period(_found(spark, d), voices, ref_id="id", period=F.substring("date", 1, 4), table="nap_voices")
