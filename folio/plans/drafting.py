"""Queries that pick sentences, parse the parts of documents, and derive keys, phrases and gazetteers."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType

from folio.functions import score
from folio.functions import text as T
from folio.functions.dates import MONTHS, safe_date
from folio.plans.archive import FOLD_SQL, REC, records
from folio.plans.matching import SHARD, dispatches, shard
from folio.plans.texts import CLAUSE_SQL, GLUE, ROWS, TEXT, VOICE_SQL, WORDS_SQL, has, texts
from folio.registry import CORE
from folio.sources.tables import table


def _picked(spark: SparkSession, d: str, points, floor: float, keep) -> DataFrame:
    """The best sentence of each text that passes ``keep``: aggregated per text, the earlier of equals."""
    rows = texts(spark, d).select("id", F.posexplode(T.glued_sentences(F.col("x"))).alias("n", "s")).where(keep(F.col("s")))
    scored = rows.withColumn("score", points(F.col("s"))).where(F.col("score") >= floor)
    best = scored.groupBy("id", "n").agg(F.first("score").alias("score"), F.first("s").alias("s"))
    return best.groupBy("id").agg(F.max_by(F.struct("s", "score"), F.struct("score", -F.col("n"), "s")).alias("b")).select("id", F.col("b.s").alias("sentence"), F.col("b.score").alias("score"))


VIABLE_SQL = f"length(s) between 80 and 320 and {has('^[A-Z0-9“]')} and not {has(score.CONJUNCTION)} and {has(score.VERB, 'left(s, 140)')}"


def viable(s):
    return F.length(s).between(80, 320) & s.rlike("^[A-Z0-9“]") & ~s.rlike(score.CONJUNCTION) & F.left(s, F.lit(140)).rlike(score.VERB)


def _pick_sql(points: str, floor: float, keep: str) -> str:
    return f"with {TEXT}, {GLUE}, {ROWS}, p as (select id, n, s, {points} as score from rows where {keep}) select id, arg_max(s, (score, -n, s)) as sentence, max(score) as score from p where score >= {floor} group by id"


@CORE.add("clause_pick", _pick_sql(CLAUSE_SQL, 3, VIABLE_SQL))
def clause_pick(spark: SparkSession, d: str) -> DataFrame:
    return _picked(spark, d, score.clause_score, 3.0, viable)


@CORE.add("voice_pick", _pick_sql(VOICE_SQL, 4, "length(s) between 35 and 220"))
def voice_pick(spark: SparkSession, d: str) -> DataFrame:
    return _picked(spark, d, score.voice_score, 4.0, lambda s: F.length(s).between(35, 220))


@CORE.add("display_choice", f"with {SHARD} select id, coalesce(nullif(trim(tweet), ''), nullif(trim(displayText), ''), sourceTitle) as shown from shard")
def display_choice(spark: SparkSession, d: str) -> DataFrame:
    """What is shown of a record: the first of its texts that is not blank."""
    empty = F.lit("")
    return shard(spark, d).select("id", F.coalesce(F.nullif(F.trim("tweet"), empty), F.nullif(F.trim("displayText"), empty), "sourceTitle").alias("shown"))


@CORE.add("dates_spelled", f"with {REC} select distinct date, strftime(try_cast(date as date), '%-d %B %Y') as spelled from rec where try_cast(date as date) is not null")
def dates_spelled(spark: SparkSession, d: str) -> DataFrame:
    day = safe_date(F.col("date"))
    return records(spark, d).where(day.isNotNull()).select("date", F.date_format(day, "d MMMM yyyy").alias("spelled")).distinct()


@CORE.add(
    "keyphrases",
    f"""with {TEXT}, w as ({WORDS_SQL}), c as (select id, word, count(*) as n from w where length(word) >= 6 group by 1, 2),
        r as (select *, row_number() over (partition by id order by n desc, length(word) desc, word) as k from c) select id, k, word, n from r where k <= 3""",
)
def keyphrases(spark: SparkSession, d: str) -> DataFrame:
    """The three words of a record that stand out most: repeated, then long; the report's limit is the feature."""
    w = texts(spark, d).select("id", F.explode(F.split(F.trim(F.regexp_replace(F.lower("x"), "[^a-z]+", " ")), " ")).alias("word")).where(F.length("word") >= 6)
    counted = w.groupBy("id", "word").agg(F.count("*").alias("n"))
    k = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), F.desc(F.length("word")), "word"))
    return counted.withColumn("k", k.cast("long")).where("k <= 3").select("id", "k", "word", "n")


DATELINE = r"^([A-Z][^,\n]{2,40}), ([0-9]{1,2}) ([^\s0-9]+) ([0-9]{4})\n"


@CORE.add(
    "document_parts",
    f"""with d as (select doc_id, text, regexp_extract(text, '{DATELINE}', 1) as place, regexp_extract(text, '{DATELINE}', 2) as day, regexp_extract(text, '{DATELINE}', 3) as month,
        regexp_extract(text, '{DATELINE}', 4) as year, regexp_extract(text, '\\n\\n([A-Z][^\\n.,;!?]{{2,40}})\\s*$', 1) as signed from documents where text is not null)
        select doc_id, place, day, month, year, signed, len(regexp_extract_all(text, '\\n\\n')) + 1 as paragraphs from d""",
)
def document_parts(spark: SparkSession, d: str) -> DataFrame:
    """Dateline, signature and number of paragraphs of each document; empty where a part is missing."""
    t = F.col("text")
    parts = [F.regexp_extract(t, DATELINE, i).alias(n) for i, n in enumerate(("place", "day", "month", "year"), 1)]
    signed = F.regexp_extract(t, r"\n\n([A-Z][^\n.,;!?]{2,40})\s*$", 1)
    return table(spark, d, "documents").where("text is not null").select("doc_id", *parts, signed.alias("signed"), (F.regexp_count(t, F.lit("\n\n")) + 1).cast("long").alias("paragraphs"))


@CORE.add(
    "articles",
    """with d as (select doc_id, string_split(regexp_replace(text, '(^|\\n)Article ([0-9]+)\\. ', '␟\\2␞', 'g'), '␟') as p from documents where contains(text, 'Article ')),
        u as (select doc_id, unnest(p[2:]) as x from d) select doc_id, cast(split_part(x, '␞', 1) as int) as article, trim(split_part(x, '␞', 2)) as body from u""",
)
def articles(spark: SparkSession, d: str) -> DataFrame:
    """The numbered articles of orders as rows: headings are marked, the text is split at the marks."""
    marked = F.regexp_replace("text", r"(^|\n)Article ([0-9]+)\. ", "␟$2␞")
    rows = table(spark, d, "documents").where(F.col("text").contains("Article ")).select("doc_id", F.posexplode(F.split(marked, "␟")).alias("n", "x")).where("n > 0")
    halves = F.split("x", "␞")
    return rows.select("doc_id", halves[0].cast("int").alias("article"), F.trim(halves[1]).alias("body"))


@CORE.add(
    "tarbell_titles",
    r"""select distinct piece_key, regexp_extract(title, '^([A-Z][a-z]+) (for|to|at) ([^,]+), ([A-Z][a-z]+), ([0-9]{4})', 1) as kind, regexp_extract(title, '^([A-Z][a-z]+) (for|to|at) ([^,]+), ([A-Z][a-z]+), ([0-9]{4})', 3) as place,
        regexp_extract(title, '^([A-Z][a-z]+) (for|to|at) ([^,]+), ([A-Z][a-z]+), ([0-9]{4})', 5) as year from tarbell where title is not null""",
)
def tarbell_titles(spark: SparkSession, d: str) -> DataFrame:
    p = r"^([A-Z][a-z]+) (for|to|at) ([^,]+), ([A-Z][a-z]+), ([0-9]{4})"
    names = {1: "kind", 3: "place", 5: "year"}
    return table(spark, d, "tarbell").where("title is not null").select("piece_key", *[F.regexp_extract("title", p, i).alias(n) for i, n in names.items()]).distinct()


@CORE.add(
    "event_sets",
    """with r as (select distinct unnest(eventIds) as id from nap_voices), e as (select distinct id from nap_events)
        select 'referenced only' as side, count(*) as ids from (select id from r where id is not null except select id from e) union all
        select 'defined only', count(*) from (select id from e except select id from r) union all select 'both', count(*) from (select id from r intersect select id from e)""",
)
def event_sets(spark: SparkSession, d: str) -> DataFrame:
    """Differences and intersection of two key sets from one full join of distinct keys."""
    r = table(spark, d, "nap_voices").select(F.explode("eventIds").alias("id")).where("id is not null").distinct().withColumn("r", F.lit(1))
    e = table(spark, d, "nap_events").select("id").distinct().withColumn("e", F.lit(1))
    side = F.when(F.col("e").isNull(), "referenced only").when(F.col("r").isNull(), "defined only").otherwise("both")
    return r.join(e, "id", "full_outer").groupBy(side.alias("side")).agg(F.count("*").alias("ids"))


GAZETTEER = f"""g as (select {FOLD_SQL.format('trim(location)')} as place, count(*) as n from rec where trim(location) <> '' group by 1 having count(*) >= 3)"""


@CORE.add("gazetteer", f"with {REC}, {GAZETTEER} select place, n from g where regexp_matches(place, '^[a-z][a-z -]+$')")
def gazetteer(spark: SparkSession, d: str) -> DataFrame:
    g = records(spark, d).where("trim(location) <> ''").groupBy(T.fold(F.trim("location")).alias("place")).agg(F.count("*").alias("n"))
    return g.where((F.col("n") >= 3) & F.col("place").rlike("^[a-z][a-z -]+$"))


@CORE.add(
    "places_resolved",
    f"""with {REC}, {GAZETTEER}, p as (select distinct {FOLD_SQL.format('trim(place)')} as raw from wellington where trim(place) <> '')
        select raw, arg_min(g.place, (levenshtein(raw, g.place), g.place)) as place, min(levenshtein(raw, g.place)) as edits from p join g on left(raw, 3) = left(g.place, 3) and levenshtein(raw, g.place) <= 2 group by raw""",
)
def places_resolved(spark: SparkSession, d: str) -> DataFrame:
    """Places as written and the nearest known place within two edits that begins alike: exact ones are at 0."""
    g = records(spark, d).where("trim(location) <> ''").groupBy(T.fold(F.trim("location")).alias("place")).count().where(F.col("count") >= 3).select("place", F.left("place", F.lit(3)).alias("b"))
    p = table(spark, d, "wellington").where("trim(place) <> ''").select(T.fold(F.trim("place")).alias("raw")).distinct().withColumn("b", F.left("raw", F.lit(3)))
    pairs = p.join(g, "b").withColumn("edits", F.levenshtein("raw", "place", 2)).where("edits >= 0")
    return pairs.groupBy("raw").agg(F.min_by("place", F.struct("edits", "place")).alias("place"), F.min("edits").alias("edits"))


# Months of the revolutionary calendar as spelled; they have no number here.
REVOLUTIONARY = (
    "vendemiaire", "vendémiaire", "brumaire", "frimaire", "nivose", "nivôse", "pluviose", "pluviôse", "ventose", "ventôse", "germinal", "floreal",
    "floréal", "prairial", "messidor", "thermidor", "fructidor",
)
#: The reference takes the nearest name from this ratio on.
NEAR_MONTH = 0.38


@pandas_udf(IntegerType())
def _nearest_month(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    import re

    names = [(ws[0], n) for n, ws in MONTHS.items()] + [(w, None) for w in REVOLUTIONARY]

    def nearest(x: str | None) -> int | None:
        letters = re.sub(r"[^A-Za-z]", "", x or "").lower()
        ratio, n = max(((SequenceMatcher(None, letters, w).ratio(), n) for w, n in names), key=lambda b: b[0])
        return n if letters and ratio >= NEAR_MONTH else None

    for s in batches:
        yield pd.Series([nearest(x) for x in s], dtype="Int32")


@CORE.add("months_guessed")
def months_guessed(spark: SparkSession, d: str) -> DataFrame:
    """Months as written and the month they come nearest to, by difflib's ratio of distinct spellings; null for a revolutionary one."""
    spelled = dispatches(spark, d).where("trim(month) <> ''").groupBy("month", "mm").agg(F.count("*").alias("n"))
    return spelled.select("month", "n", "mm", _nearest_month("month").alias("nearest"))


# What may stand in front of a text without belonging to it.
LEADS = (r"^[\s“\"'.,;:–—-]+", r"^\[[^\]]{1,40}\]", r"^\([^)]{1,40}\)", r"^(?:No|Nr)\.? ?\d+[.:]?", r"^[A-Z]{2,}[A-Z ]*[:.]", r"^(?:Sir|Sire|Monsieur|Madame|Citizen)s?,")


#: Any number of them, one after another: what passes of single rewrites come to.
LEAD = "^(?:" + "|".join(p.removeprefix("^") for p in LEADS) + ")+"


@CORE.add("leads_stripped", f"with {TEXT} select id, regexp_replace(x, '{LEAD.replace(chr(39), chr(39) * 2)}', '') as text from t where x is not null")
def leads_stripped(spark: SparkSession, d: str) -> DataFrame:
    """Texts without what stands in front of them, taken off until nothing of it is left."""
    return texts(spark, d).where("x is not null").select("id", F.regexp_replace("x", LEAD, "").alias("text"))
