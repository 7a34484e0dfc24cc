"""Queries that merge, deduplicate and match records across tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions.dates import day_number, iso_date, month_number, safe_date
from folio.functions.text import fold, letters_key
from folio.operators import match, records
from folio.plans.archive import FOLD_SQL, REC
from folio.plans.archive import records as voices
from folio.registry import CORE
from folio.sources.tables import table

SHARD = """shard as (select * exclude (rn) from (select *, row_number() over (partition by id order by originalText nulls first, displayText nulls first) as rn
    from shard_sthelena where id is not null) where rn = 1)"""
WEL = """wel as (select * exclude (rn) from (select *, row_number() over (partition by piece_key order by body nulls first) as rn
    from wellington where piece_key is not null) where rn = 1)"""
TAR = """tar as (select * exclude (rn) from (select *, row_number() over (partition by piece_key order by body nulls first) as rn
    from tarbell where piece_key is not null) where rn = 1)"""
MONTH_SQL = (
    "case when regexp_matches(m, '^[0-9]{1,2}$') and cast(m as int) between 1 and 12 then cast(m as int) "
    "when m in ('january','jan','janvier') then 1 when m in ('february','feb','février','fevrier') then 2 when m in ('march','mar','mars') then 3 "
    "when m in ('april','apr','avril') then 4 when m in ('may','mai') then 5 when m in ('june','jun','juin') then 6 when m in ('july','jul','juillet') then 7 "
    "when m in ('august','aug','août','aout') then 8 when m in ('september','sept','sep','septembre') then 9 when m in ('october','oct','octobre') then 10 "
    "when m in ('november','nov','novembre') then 11 when m in ('december','dec','décembre','decembre') then 12 end"
)
DATED = rf"""{WEL}, m as (select piece_key, "to", place, body, trim(year) as y, regexp_replace(lower(trim(month)), '\.$', '') as m,
    regexp_extract(translate(trim(day), 'OolISs', '001155'), '^([0-9]{{1,2}})', 1) as d from wel),
    n as (select *, {MONTH_SQL} as mm, case when d <> '' and cast(d as int) between 1 and 31 then cast(d as int) end as dd from m),
    dated as (select *, strftime(try_cast(case when regexp_matches(y, '^[0-9]{{4}}$') then y end || '-' || lpad(cast(mm as varchar), 2, '0') || '-' || lpad(cast(dd as varchar), 2, '0') as date), '%Y-%m-%d') as iso from n)"""


def shard(spark: SparkSession, d: str) -> DataFrame:
    return records.first_delivery(table(spark, d, "shard_sthelena"), "id", F.col("originalText"), F.col("displayText"))


def tarbell(spark: SparkSession, d: str) -> DataFrame:
    return records.first_delivery(table(spark, d, "tarbell"), "piece_key", F.col("body"))


def dispatches(spark: SparkSession, d: str) -> DataFrame:
    w = records.first_delivery(table(spark, d, "wellington"), "piece_key", F.col("body"))
    return w.withColumn("iso", iso_date(F.col("year"), F.col("month"), F.col("day"))).withColumn("mm", month_number(F.col("month"))).withColumn("dd", day_number(F.col("day")))


@CORE.add("dates_repaired", f"with {DATED} select piece_key, mm, dd, iso from dated")
def dates_repaired(spark: SparkSession, d: str) -> DataFrame:
    return dispatches(spark, d).select("piece_key", "mm", "dd", "iso")


@CORE.add(
    "tarbell_dates",
    f"""with {TAR} select piece_key, approx, cast(try_cast(case when regexp_matches(iso, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') then iso end as date) as varchar) as day,
        iso is not null and try_cast(case when regexp_matches(iso, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') then iso end as date) is null as impossible from tar""",
)
def tarbell_dates(spark: SparkSession, d: str) -> DataFrame:
    day = safe_date(F.col("iso"))
    return tarbell(spark, d).select("piece_key", "approx", day.cast("string").alias("day"), (F.col("iso").isNotNull() & day.isNull()).alias("impossible"))


@CORE.add("first_wins", f"with {REC} select id, loaded_at, displayText from rec")
def first_wins(spark: SparkSession, d: str) -> DataFrame:
    return voices(spark, d).select("id", "loaded_at", "displayText")


@CORE.add(
    "longest_body",
    """select iso, k as title_key, arg_min(piece_key, (-length(coalesce(body, '')), piece_key)) as piece_key, max(length(coalesce(body, ''))) as n_chars
        from (select *, left(regexp_replace(lower(title), '[^a-z0-9]+', '', 'g'), 36) as k from tarbell) group by iso, k""",
)
def longest_body(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "tarbell").withColumn("title_key", F.left(letters_key(F.col("title")), F.lit(36)))
    best = records.longest(t, ["iso", "title_key"], "body", "piece_key")
    return best.select("iso", "title_key", "piece_key", F.length(F.coalesce("body", F.lit(""))).cast("long").alias("n_chars"))


@CORE.add(
    "override_merge",
    f"with {REC}, {SHARD}, o as (select id, displayText as x from shard where trim(tweet) <> '') select id, case when trim(coalesce(o.x, '')) <> '' then o.x else context end as context from rec left join o using (id)",
)
def override_merge(spark: SparkSession, d: str) -> DataFrame:
    """Corrections by id replace a column where they are not blank."""
    changes = shard(spark, d).where("trim(tweet) <> ''").select("id", F.col("displayText").alias("x"))
    return records.override(voices(spark, d).select("id", "context"), changes, "id", {"x": "context"})


@CORE.add("coverage_missing", "select doc_id from documents where doc_id not in (select doc_id from review_labels where doc_id is not null)")
def coverage_missing(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").join(table(spark, d, "review_labels"), "doc_id", "left_anti").select("doc_id")


@CORE.add("stray_events", "select distinct id, label from nap_events where id not in (select unnest(eventIds) from nap_voices where eventIds is not null)")
def stray_events(spark: SparkSession, d: str) -> DataFrame:
    """Entries that point to no record: events which no record names."""
    named = table(spark, d, "nap_voices").select(F.explode("eventIds").alias("id")).where("id is not null").distinct()
    return table(spark, d, "nap_events").select("id", "label").distinct().join(named, "id", "left_anti")


@CORE.add(
    "upsert_labels",
    """with a as (select doc_id, max(toxic) as toxic from review_labels group by 1), b as (select doc_id, cast(case when n_chars > 20000 then 1 else 0 end as int) as toxic from documents)
        select coalesce(b.doc_id, a.doc_id) as doc_id, case when b.doc_id is not null then b.toxic else a.toxic end as toxic from a full join b on a.doc_id = b.doc_id""",
)
def upsert_labels(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "review_labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    new = table(spark, d, "documents").select("doc_id", (F.col("n_chars") > 20000).cast("int").alias("toxic"))
    return records.upsert(old, new, "doc_id")


@CORE.add(
    "enrich_empty",
    f"with {REC}, {SHARD} select r.id, coalesce(nullif(trim(coalesce(r.context, '')), ''), s.originalText) as context from rec r left join shard s on s.id = r.id",
)
def enrich_empty(spark: SparkSession, d: str) -> DataFrame:
    """A value is taken from the other table only where it is empty here."""
    s = shard(spark, d).select("id", "originalText")
    own = F.nullif(F.trim(F.coalesce("context", F.lit(""))), F.lit(""))
    return voices(spark, d).join(s, "id", "left").select("id", F.coalesce(own, "originalText").alias("context"))


@CORE.add("duplicate_bodies", "select regexp_replace(lower(body), '[^a-z0-9]+', '', 'g') as key, count(distinct piece_key) as pieces, min(piece_key) as first_piece from tarbell where body is not null group by 1 having count(distinct piece_key) > 1")
def duplicate_bodies(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "tarbell").where("body is not null").select(letters_key(F.col("body")).alias("key"), "piece_key").distinct()
    return rows.groupBy("key").agg(F.count("piece_key").alias("pieces"), F.min("piece_key").alias("first_piece")).where("pieces > 1")


SAME_DAY = f"with {REC}, s as (select id, date, left(regexp_replace(lower(displayText), '[^a-z0-9]+', '', 'g'), 120) as k from rec where date is not null and displayText is not null)"


@CORE.add("near_levenshtein", SAME_DAY + " select a.id as id_a, b.id as id_b, levenshtein(a.k, b.k) as edits from s a join s b on a.date = b.date and a.id < b.id where levenshtein(a.k, b.k) <= 90")
def near_levenshtein(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of one day whose first letters differ by few edits; the day is the block."""
    s = voices(spark, d).where("date is not null and displayText is not null").select("id", "date", F.left(letters_key(F.col("displayText")), F.lit(120)).alias("k"))
    return match.edits_within(s, "date", "id", "k", 90).toDF("id_a", "id_b", "edits")


@CORE.add("prefix_containment", SAME_DAY + " select a.id from s a where length(a.k) >= 30 and not exists (select 1 from s b where b.date = a.date and b.id < a.id and length(b.k) >= 30 and (contains(b.k, a.k) or contains(a.k, b.k)))")
def prefix_containment(spark: SparkSession, d: str) -> DataFrame:
    """Records not contained in, nor containing, an earlier record of their day: an anti-join within the day."""
    s = voices(spark, d).where("date is not null and displayText is not null").select("id", "date", F.left(letters_key(F.col("displayText")), F.lit(120)).alias("k")).where("length(k) >= 30")
    a, b = s.alias("a"), s.alias("b")
    cond = (F.col("a.date") == F.col("b.date")) & (F.col("b.id") < F.col("a.id")) & (F.contains("b.k", "a.k") | F.contains("a.k", "b.k"))
    return a.join(b, cond, "left_anti").select("id")


@CORE.add("greedy_same_day")
def greedy_same_day(spark: SparkSession, d: str) -> DataFrame:
    """Order-dependent deduplication of each day by difflib's ratio of whole texts; not expressible in SQL."""
    s = voices(spark, d).where("date is not null").select("id", "date", "displayText")
    return match.greedy_distinct(s, "date", "id", "displayText", 0.55)


@CORE.add("ratio_same_day")
def ratio_same_day(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of the pairs of each day by difflib's ratio of their first 150 characters."""
    s = voices(spark, d).where("date is not null and displayText is not null").select("id", "date", F.left("displayText", F.lit(150)).alias("x"))
    return match.ratios_within(s, "date", "id", "x", 0.3).select(F.col("key_a").alias("id"), F.col("key_b").alias("id_b"), F.round("ratio", 4).alias("ratio")).where("ratio > 0.3")


@CORE.add(
    "band_join",
    f"with {REC}, {DATED.replace('WEL', 'wel')} select distinct d.piece_key, r.id from dated d join rec r on abs(date_diff('day', try_cast(r.date as date), try_cast(d.iso as date))) <= 1 where lower(trim(r.location)) = lower(trim(d.place))",
)
def band_join(spark: SparkSession, d: str) -> DataFrame:
    """Dispatches and records of the same place at most a day apart."""
    a = dispatches(spark, d).select("piece_key", F.lower(F.trim("place")).alias("place"), safe_date(F.col("iso")).alias("day")).where("day is not null")
    b = voices(spark, d).select("id", F.lower(F.trim("location")).alias("place_b"), safe_date(F.col("date")).alias("day")).where("day is not null")
    return match.band_pairs(a, b, "day", 1).where("place = place_b").select("piece_key", "id").distinct()


WORDS_B = "list_distinct(list_filter(string_split(trim(regexp_replace({}, '[^a-z]+', ' ', 'g')), ' '), lambda w: length(w) >= 5))"


@CORE.add(
    "token_overlap",
    f"""with {REC}, {DATED}, a as (select piece_key, iso, unnest({WORDS_B.format(FOLD_SQL.format('"to"'))}) as w from dated where iso is not null),
        b as (select id, date, unnest({WORDS_B.format(FOLD_SQL.format('sourceTitle'))}) as w from rec)
        select piece_key, min(id) as id from a join b on left(a.iso, 7) = left(b.date, 7) and a.w = b.w group by piece_key""",
)
def token_overlap(spark: SparkSession, d: str) -> DataFrame:
    """The first record of a dispatch's month that shares a long word of the addressee: an equi-join on month and word."""

    def long_words(c):
        return F.array_distinct(F.filter(F.split(F.trim(F.regexp_replace(fold(c), "[^a-z]+", " ")), " "), lambda w: F.length(w) >= 5))

    a = dispatches(spark, d).where("iso is not null").select("piece_key", F.left("iso", F.lit(7)).alias("month"), F.explode(long_words(F.col("to"))).alias("w"))
    b = voices(spark, d, "date", "sourceTitle").select("id", F.left("date", F.lit(7)).alias("month"), F.explode(long_words(F.col("sourceTitle"))).alias("w"))
    return match.first_match(a.join(b, ["month", "w"]).select("piece_key", "id"), "piece_key", F.col("id")).select("piece_key", "id")


@CORE.add(
    "body_match",
    f"""with {REC}, {TAR}, a as (select id, date, lower(trim(location)) as place, left(regexp_replace(lower(displayText), '[^a-z0-9]+', '', 'g'), 40) as probe from rec),
        b as (select piece_key, iso, lower(title) as title, regexp_replace(lower(body), '[^a-z0-9]+', '', 'g') as body from tar where iso is not null),
        j as (select a.id, b.piece_key, case when contains(b.title, a.place) and contains(b.body, a.probe) then 1 when contains(b.body, a.probe) then 2 when contains(b.title, a.place) then 3 end as level
              from a join b on left(a.date, 7) = left(b.iso, 7) where a.place <> '')
        select id, arg_min(piece_key, (level, piece_key)) as piece_key, min(level) as level from j where level is not null group by id""",
)
def body_match(spark: SparkSession, d: str) -> DataFrame:
    """Three levels of matching within a month, the best level first: place and text, text alone, place alone."""
    a = voices(spark, d, "date", "location", "displayText").select("id", F.left("date", F.lit(7)).alias("month"), F.lower(F.trim("location")).alias("place"), F.left(letters_key(F.col("displayText")), F.lit(40)).alias("probe")).where("place <> ''")
    b = tarbell(spark, d).where("iso is not null").select("piece_key", F.left("iso", F.lit(7)).alias("month"), F.lower("title").alias("title"), letters_key(F.col("body")).alias("body"))
    in_title, in_body = F.contains("title", "place"), F.contains("body", "probe")
    level = F.when(in_title & in_body, 1).when(in_body, 2).when(in_title, 3)
    pairs = a.join(b, "month").select("id", "piece_key", level.alias("level")).where("level is not null")
    return match.first_match(pairs, "id", F.col("level"), F.col("piece_key")).select("id", "piece_key", "level")


@CORE.add(
    "as_of_event",
    f"""with {REC}, e as (select id as event_id, date as day, split_part(id, '-', 1) as place from nap_events where date is not null),
        a as (select id, date, regexp_replace({FOLD_SQL.format('trim(location)')}, '[^a-z]+', '', 'g') as place from rec),
        f as (select place, day, max(event_id) as event_id from (select event_id, day, regexp_replace(lower(place), '[^a-z]+', '', 'g') as place from e) group by 1, 2)
        select id, a.date, f.event_id from a left join (select place, day, event_id from f) f on f.place = a.place
        and f.day = (select max(g.day) from f g where g.place = a.place and g.day <= a.date) where a.place <> ''""",
)
def as_of_event(spark: SparkSession, d: str) -> DataFrame:
    """The last event at a record's place on or before its date: an as-of join by one window over both sides."""
    events = table(spark, d, "nap_events").where("date is not null").select(F.regexp_replace(F.lower(F.split("id", "-")[0]), "[^a-z]+", "").alias("place"), F.col("date").alias("day"), "id")
    right = events.groupBy("place", "day").agg(F.max("id").alias("event_id"))
    left = voices(spark, d).select("id", "date", F.regexp_replace(fold(F.trim("location")), "[^a-z]+", "").alias("place")).where("place <> ''")
    return match.as_of(left, right, "place", "date", "day", "event_id").select("id", "date", "event_id")


@CORE.add("sequence_assign", f"with {REC} select id, date, 700 + row_number() over (partition by date order by id) as seq from rec where date is not null")
def sequence_assign(spark: SparkSession, d: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("date").orderBy("id"))
    return voices(spark, d).where("date is not null").select("id", "date", (n + 700).cast("long").alias("seq"))


LINES = f"""{TAR}, l as (select piece_key, unnest(string_split(body, chr(10))) as line, generate_subscripts(string_split(body, chr(10)), 1) as line_no from tar)"""


@CORE.add(
    "carry_forward",
    f"""with {LINES} select piece_key, line_no, last_value(case when regexp_matches(line, '[0-9]{{3,}}') then regexp_extract(line, '([0-9]{{3,}})', 1) end ignore nulls)
        over (partition by piece_key order by line_no rows between unbounded preceding and current row) as last_number from l""",
)
def carry_forward(spark: SparkSession, d: str) -> DataFrame:
    """The last number seen in a body up to each line."""
    lines = tarbell(spark, d).select("piece_key", F.posexplode(F.split("body", "\n")).alias("at", "line"))
    number = F.nullif(F.regexp_extract("line", "([0-9]{3,})", 1), F.lit(""))
    w = Window.partitionBy("piece_key").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.select("piece_key", (F.col("at") + 1).cast("long").alias("line_no"), F.last(number, ignorenulls=True).over(w).alias("last_number"))


@CORE.add(
    "segment_bounds",
    f"""with {LINES}, h as (select piece_key, line_no, line from l where regexp_matches(line, '[A-Z]{{4,}} [A-Z]{{2,}}')),
        n as (select piece_key, max(line_no) as last from l group by 1)
        select h.piece_key, h.line_no as first_line, coalesce(lead(h.line_no) over (partition by h.piece_key order by h.line_no) - 1, n.last) as last_line from h join n using (piece_key)""",
)
def segment_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Segments that begin at lines in capitals and end before the next one or with the text."""
    lines = tarbell(spark, d).select("piece_key", F.size(F.split("body", "\n")).alias("last"), F.posexplode(F.split("body", "\n")).alias("at", "line"))
    heads = lines.where(F.col("line").rlike("[A-Z]{4,} [A-Z]{2,}"))
    following = F.lead("at").over(Window.partitionBy("piece_key").orderBy("at"))
    return heads.select("piece_key", (F.col("at") + 1).cast("long").alias("first_line"), F.coalesce(following, F.col("last")).cast("long").alias("last_line"))
