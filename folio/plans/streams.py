"""The batch equivalents of the stream queries, and joins and aggregates over the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.registry import CORE
from folio.sources.tables import table
from folio.streaming import events as E


@CORE.add("events_tumbling", "select date_trunc('day', ts) as start, event_type, count(*) as events, round(sum(value), 4) as total from events group by 1, 2")
def events_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return E.tumbling(table(spark, d, "events"))


@CORE.add(
    "events_sessions",
    """with a as (select user_id, ts, case when ts >= lag(ts) over w + interval 12 hour or lag(ts) over w is null then 1 else 0 end as fresh from events window w as (partition by user_id order by ts)),
        b as (select *, sum(fresh) over (partition by user_id order by ts rows between unbounded preceding and current row) as n from a)
        select user_id, min(ts) as start, max(ts) + interval 12 hour as finish, count(*) as events from b group by user_id, n""",
)
def events_sessions(spark: SparkSession, d: str) -> DataFrame:
    return E.sessions(table(spark, d, "events"))


@CORE.add("event_properties", "select cast(json_extract(props, '$.k') as bigint) as k, count(*) as events, round(avg(value), 6) as mean from events group by 1")
def event_properties(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, d, "events").groupBy(k.alias("k")).agg(F.count("*").alias("events"), F.round(F.avg("value"), 6).alias("mean"))


@CORE.add(
    "revenue_by_nation",
    """select n_name, count(distinct o_orderkey) as orders, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem
        join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by n_name""",
)
def revenue_by_nation(spark: SparkSession, d: str) -> DataFrame:
    """Lines are summed per order before they meet the other tables, so the large side crosses one shuffle."""
    t = lambda name: table(spark, d, name)
    per_order = t("lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    orders = per_order.join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    customers = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("n_name").agg(F.count("*").alias("orders"), F.round(F.sum("r"), 2).alias("revenue"))
