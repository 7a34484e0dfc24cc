"""Queries over the published archive: timeline, manifest, lookup, search and rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions.dates import ERAS, era_of, era_table, hour_label, safe_date, time_rank
from folio.functions.entity import TITLES, addressee, clean_place, handle, person_key
from folio.functions.text import ACCENTED, PLAIN, fold
from folio.operators.match import nearest_date
from folio.operators.records import admit, first_delivery
from folio.registry import CORE
from folio.sources.tables import table

#: The same in the oracle: one row an id, its first delivery.
REC = """rec as (select * exclude (rn) from (select *, row_number() over (partition by id order by loaded_at,
    sourceTitle nulls first, displayText nulls first) as rn from nap_voices where id is not null) where rn = 1)"""
ERA_SQL = "case " + " ".join(f"when cast(substr(date, 1, 4) as int) >= {y} then '{n}'" for y, n in reversed(ERAS)) + " end"
FOLD_SQL = f"translate(lower({{}}), '{ACCENTED}', '{PLAIN}')"
KNOWN_LABELS = ("MORNING", "AFTERNOON", "EVENING", "TIME UNCERTAIN")
QUERY_WORDS = ("brigade", "palace")


def records(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """One row an id, its first delivery; with ``columns``, only these beside the id are carried along."""
    return first_delivery(table(spark, d, "nap_voices"), "id", F.col("loaded_at"), F.col("sourceTitle"), F.col("displayText"), columns=columns)


def blank(c: str):
    return F.coalesce(F.trim(F.col(c)) == "", F.lit(True))


@CORE.add(
    "publish_manifest",
    f"""with {REC}, ok as (select *, {ERA_SQL} as era from rec where editorialStatus = 'verified' and trim(coalesce(displayText, '')) <> ''
        and regexp_matches(coalesce(date, ''), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$'))
        select era, count(*) as records, count(distinct date) as days, min(date) as first_date, max(date) as last_date,
        cast(sum(octet_length(encode(displayText))) as bigint) as bytes,
        cast(sum(cast('0x' || substr(md5(id || displayText), 1, 11) as bigint)) as bigint) as fingerprint from ok group by era""",
)
def publish_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Admission, era partition and the manifest's pre-aggregates with an order-free fingerprint of each partition."""
    ok, _ = admit(
        records(spark, d, "editorialStatus", "displayText", "date"),
        {"status": F.col("editorialStatus") != "verified", "blank": blank("displayText"), "date": ~F.coalesce(F.col("date"), F.lit("")).rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$")},
    )
    mark = F.conv(F.substring(F.md5(F.concat("id", "displayText")), 1, 11), 16, 10).cast("bigint")
    return (
        ok.where(F.col("editorialStatus").isNotNull()).groupBy(era_of(F.col("date")).alias("era"))
        .agg(
            F.count("*").alias("records"), F.count_distinct("date").alias("days"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
            F.sum(F.octet_length("displayText")).alias("bytes"), F.sum(mark).alias("fingerprint"),
        )
    )


@CORE.add(
    "timeline_day",
    f"""with {REC}, n as (select date, count(*) as c from rec group by date), b as (select date from n order by c desc, date limit 1)
        select id, date, timeLabel, case timeLabel when 'MORNING' then 0 when 'AFTERNOON' then 1 when 'EVENING' then 2 else 3 end as rank
        from rec join b using (date) order by rank, id""",
)
def timeline_day(spark: SparkSession, d: str) -> DataFrame:
    """The records of the busiest day in the order of its feed."""
    rec = records(spark, d, "date", "timeLabel")
    busiest = rec.groupBy("date").count().orderBy(F.desc("count"), "date").limit(1).select("date")
    return rec.join(F.broadcast(busiest), "date").select("id", "date", "timeLabel", time_rank(F.col("timeLabel")).alias("rank")).orderBy("rank", "id")


@CORE.add("date_count", f"with {REC} select date, count(*) as records from rec group by date")
def date_count(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d, "date").groupBy("date").agg(F.count("*").alias("records"))


@CORE.add("year_count", f"with {REC} select substr(date, 1, 4) as year, count(*) as records, count(distinct date) as days from rec group by 1")
def year_count(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d, "date").groupBy(F.substring("date", 1, 4).alias("year")).agg(F.count("*").alias("records"), F.count_distinct("date").alias("days"))


@CORE.add("month_count", "select strftime(o_orderdate, '%Y-%m') as month, count(*) as orders, round(sum(o_totalprice), 2) as total from orders group by 1")
def month_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@CORE.add(
    "best_day_per_month",
    f"""with {REC}, n as (select date, count(*) as c from rec group by date)
        select substr(date, 1, 7) as month, arg_min(date, (-c, date)) as day, max(c) as records from n group by 1""",
)
def best_day_per_month(spark: SparkSession, d: str) -> DataFrame:
    days = records(spark, d, "date").groupBy("date").agg(F.count("*").alias("c"))
    best = F.min_by("date", F.struct(-F.col("c"), F.col("date")))
    return days.groupBy(F.substring("date", 1, 7).alias("month")).agg(best.alias("day"), F.max("c").alias("records"))


@CORE.add(
    "calendar_gaps",
    f"""with {REC}, days as (select distinct try_cast(date as date) as day from rec), span as (select min(day) as a, max(day) as b from days),
        cal as (select cast(unnest(generate_series(a, b, interval 1 day)) as date) as day from span)
        select strftime(day, '%Y') as year, count(*) as empty_days from cal where day not in (select day from days where day is not null) group by 1""",
)
def calendar_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Days of the calendar without a record, per year; the calendar bounds the generated rows."""
    days = records(spark, d, "date").select(safe_date(F.col("date")).alias("day")).distinct()
    calendar = days.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    return calendar.join(days, "day", "left_anti").groupBy(F.date_format("day", "yyyy").alias("year")).agg(F.count("*").alias("empty_days"))


@CORE.add(
    "coverage_summary",
    f"""with {REC} select count(*) as records, count(distinct date) as days, count(distinct author) as authors, min(date) as first_date,
        max(date) as last_date, date_diff('day', min(try_cast(date as date)), max(try_cast(date as date))) + 1 as calendar_days from rec""",
)
def coverage_summary(spark: SparkSession, d: str) -> DataFrame:
    day = safe_date(F.col("date"))
    return records(spark, d, "date", "author").agg(
        F.count("*").alias("records"), F.count_distinct("date").alias("days"), F.count_distinct("author").alias("authors"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), (F.datediff(F.max(day), F.min(day)) + 1).cast("bigint").alias("calendar_days"),
    )


@CORE.add(
    "nearest_date",
    f"""with {REC}, days as (select distinct try_cast(date as date) as day from rec), e as (select distinct id, try_cast(date as date) as day from nap_events)
        select e.id, cast(e.day as varchar) as day, cast(arg_min(d.day, (abs(date_diff('day', d.day, e.day)), d.day)) as varchar) as nearest
        from e, days d where e.day is not null and d.day is not null group by 1, 2""",
)
def nearest_documented_date(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "nap_events").select("id", safe_date(F.col("date")).alias("day")).where("day is not null").distinct()
    dated = records(spark, d, "date").select(safe_date(F.col("date")).alias("day"))
    return nearest_date(events, "day", dated, "day").select("id", F.col("day").cast("string"), F.col("nearest").cast("string"))


@CORE.add("era_counts", f"with {REC} select {ERA_SQL} as era, count(*) as records from rec group by 1")
def era_counts(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d, "date").groupBy(era_of(F.col("date")).alias("era")).agg(F.count("*").alias("records"))


@CORE.add(
    "era_join",
    f"""with {REC} select {ERA_SQL} as era, faction, count(*) as records from rec where {ERA_SQL} is not null group by 1, 2""",
)
def era_join(spark: SparkSession, d: str) -> DataFrame:
    """The era as an equi-join with the years of each era instead of a range condition."""
    rec = records(spark, d, "faction", "date").select("faction", F.substring("date", 1, 4).cast("int").alias("year"))
    return rec.join(F.broadcast(era_table(spark)), "year").groupBy("era", "faction").agg(F.count("*").alias("records"))


@CORE.add(
    "author_rollup",
    f"""with {REC} select author, count(*) as records, min(handle) as handle, array_to_string(list_sort(list(distinct faction)), ' → ') as factions,
        count(distinct substr(date, 1, 4)) as years, min(date) as first_date, max(date) as last_date from rec group by author""",
)
def author_rollup(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d, "author", "handle", "faction", "date").groupBy("author").agg(
        F.count("*").alias("records"), F.min("handle").alias("handle"), F.array_join(F.sort_array(F.collect_set("faction")), " → ").alias("factions"),
        F.count_distinct(F.substring("date", 1, 4)).alias("years"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
    )


WORDS_SQL = "list_filter(string_split(trim(regexp_replace({fold}, '[^a-z]+', ' ', 'g')), ' '), lambda w: w <> '' and w not in ({titles}))"
TITLES_SQL = ", ".join(f"'{t}'" for t in TITLES)


def _person_sql() -> str:
    raw = "regexp_extract(coalesce(sourceTitle, ''), '^To\\s+([^,]+)', 1)"
    key = f"array_to_string({WORDS_SQL.format(fold=FOLD_SQL.format('raw'), titles=TITLES_SQL)}, '')"
    return f"""with {REC}, a as (select id, date, {raw} as raw from rec),
        b as (select *, {key} as key from a where raw <> '' and not regexp_matches(raw, '[0-9]|[A-Z]{{5}}'))"""


@CORE.add(
    "people_rollup",
    _person_sql() + """, l as (select key, raw, count(*) as c from b where key <> '' group by 1, 2)
        select key, cast(sum(c) as bigint) as records, arg_min(raw, (-c, raw)) as label, count(*) as spellings from l group by key""",
)
def people_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Records per addressee under the most frequent label, the lesser of equals."""
    rec = records(spark, d, "sourceTitle").select(person_key(F.col("sourceTitle")).alias("key"), addressee(F.col("sourceTitle")).alias("raw")).where("key is not null")
    labels = rec.groupBy("key", "raw").agg(F.count("*").alias("c"))
    label = F.min_by("raw", F.struct(-F.col("c"), F.col("raw")))
    return labels.groupBy("key").agg(F.sum("c").alias("records"), label.alias("label"), F.count("*").alias("spellings"))


PLACE_SQL = "regexp_replace(trim(location), '^[ ,.;:]+|[ ,.;:]+$', '', 'g')"


@CORE.add(
    "place_rollup",
    f"""with {REC}, a as (select date, {PLACE_SQL} as p from rec),
        b as (select date, upper(left(p, 1)) || substr(p, 2) as place from a where length(p) >= 3 and lower(p) not in ('', 'unknown', 'at sea', 'camp', 'on the march'))
        select place, count(*) as records, max(date) as last_date, round(4 + 2.2 * sqrt(count(*)), 4) as radius from b group by place""",
)
def place_rollup(spark: SparkSession, d: str) -> DataFrame:
    rec = records(spark, d, "date", "location").select("date", clean_place(F.col("location")).alias("place")).where("place is not null")
    return rec.groupBy("place").agg(F.count("*").alias("records"), F.max("date").alias("last_date"), F.round(4 + 2.2 * F.sqrt(F.count("*")), 4).alias("radius"))


@CORE.add(
    "handles",
    f"""select person_id, case when w is null then null else '@' || w end as handle from (select person_id,
        list_extract({WORDS_SQL.format(fold=FOLD_SQL.format("full_name"), titles=TITLES_SQL)}, -1) as w from correspondents)""",
)
def handles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "correspondents").select("person_id", handle(F.col("full_name")).alias("handle"))


HAY = ("displayText", "sourceTitle", "author", "location", "context")
HAY_SQL = FOLD_SQL.format("concat_ws(' ', " + ", ".join(HAY) + ")")
MATCH_SQL = " and ".join(f"contains({HAY_SQL}, '{w}')" for w in QUERY_WORDS)


def search(df: DataFrame, query: str) -> DataFrame:
    """Rows whose folded text holds every word of the folded query."""
    hay = fold(F.concat_ws(" ", *HAY))
    words = F.filter(F.split(fold(F.lit(query)), r"\s+"), lambda w: w != "")
    return df.where(F.forall(words, lambda w: F.contains(hay, w)))


@CORE.add("search_all", f"with {REC} select id, date from rec where {MATCH_SQL}")
def search_all(spark: SparkSession, d: str) -> DataFrame:
    return search(records(spark, d, "date", *HAY), " ".join(QUERY_WORDS)).select("id", "date")


@CORE.add("search_top60", f"with {REC}, m as (select id, date from rec where {MATCH_SQL}) select id, date, (select count(*) from m) as found from m order by date, id limit 60")
def search_top60(spark: SparkSession, d: str) -> DataFrame:
    """The report of the first 60 hits with the number of all; the limit is the feature."""
    hits = search(records(spark, d, "date", *HAY), " ".join(QUERY_WORDS)).select("id", "date")
    return hits.select("id", "date", hits.agg(F.count("*")).scalar().alias("found")).orderBy("date", "id").limit(60)


@CORE.add("saved_semi", f"with {REC} select id, date from rec where id in (select distinct id from nap_voices where timeLabel = 'EVENING')")
def saved_semi(spark: SparkSession, d: str) -> DataFrame:
    saved = table(spark, d, "nap_voices").where("timeLabel = 'EVENING'").select("id").distinct()
    return records(spark, d, "date").join(saved, "id", "left_semi").select("id", "date")


@CORE.add(
    "profile_latest",
    f"""with {REC}, r as (select author, id, date, row_number() over (partition by author order by date, id) as n from rec)
        select author, id, date, n from r where n <= 5""",
)
def profile_latest(spark: SparkSession, d: str) -> DataFrame:
    """The first five records of each author; the rank limit is pushed below the shuffle."""
    rec = records(spark, d, "author", "date").select("author", "id", "date")
    n = F.row_number().over(Window.partitionBy("author").orderBy("date", "id"))
    return rec.withColumn("n", n).where("n <= 5")


@CORE.add("hour_labels", "select case when extract(hour from ts) between 5 and 11 then 'MORNING' when extract(hour from ts) between 12 and 16 then 'AFTERNOON' when extract(hour from ts) >= 17 then 'EVENING' else 'TIME UNCERTAIN' end as label, count(*) as events from events group by 1")
def hour_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(hour_label(F.hour("ts")).alias("label")).agg(F.count("*").alias("events"))


@CORE.add(
    "manifest_json",
    f"""with {REC} select 'records' as key, cast(count(*) as varchar) as value from rec union all select 'days', cast(count(distinct date) as varchar) from rec
        union all select 'from', min(date) from rec union all select 'to', max(date) from rec""",
)
def manifest_json(spark: SparkSession, d: str) -> DataFrame:
    """The manifest's scalars; ``folio.sources.sinks.write_manifest`` writes them as one object."""
    one = records(spark, d, "date").agg(F.count("*").alias("records"), F.count_distinct("date").alias("days"), F.min("date").alias("from"), F.max("date").alias("to"))
    return one.select(F.explode(F.create_map(*[x for c in one.columns for x in (F.lit(c), F.col(c).cast("string"))])).alias("key", "value"))
