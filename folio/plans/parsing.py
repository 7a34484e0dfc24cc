"""Parsers of running text into records, and what is assembled from their parts.

Anchors are marked with signs that texts do not hold and the text is split at the marks, so a parser is one projection
and one explode: it needs no user code, and a long text costs no more than its pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions.dates import MONTHS, iso_date
from folio.plans.archive import REC, records
from folio.plans.both import Both, c, case, lit
from folio.plans.cards import CLAUSE_SHORT, PRETTY
from folio.plans.matching import MONTH_SQL, WEL, dispatches
from folio.plans.rules import EVENTS, _events
from folio.registry import CORE
from folio.sources.tables import table

UNIT, PART = "␟", "␞"
DATELINE = r"(?:^|\n)([A-Z][^,\n]{2,40}), ([0-9]{1,2}) ([^\s0-9]{3,12}) ([0-9]{4})\n"
ENGLISH, FRENCH = "|".join(n[0].capitalize() for n in MONTHS.values()), "|".join(n for ns in MONTHS.values() for n in ns[2:] if len(n) > 2)
ANCHOR = rf"(?:the ([0-9]{{1,2}})(?:st|nd|rd|th) of ({ENGLISH})|le ([0-9]{{1,2}})(?:er)? ({FRENCH}))([^A-Za-zà-ÿ]|$)"


def pieces(text, pattern: str, to: str):
    """Array of the text before the first anchor and the pieces that begin with one."""
    return F.split(F.regexp_replace(text, pattern, to), UNIT)


def _pieces_sql(text: str, pattern: str, to: str) -> str:
    for i in range(1, 6):
        to = to.replace(f"${i}", f"\\{i}")
    return f"string_split(regexp_replace({text}, '{pattern}', '{to}', 'g'), '{UNIT}')"


HEADED = f"{UNIT}$1{PART}$2{PART}$3{PART}$4{PART}"
ANCHORED = f"{UNIT}$1$3{PART}$2$4{PART}$5"


@CORE.add(
    "headed_segments",
    f"""with p as (select doc_id, {_pieces_sql('text', DATELINE, HEADED)} as p from documents where text is not null),
        u as (select doc_id, unnest(p[2:]) as x, generate_subscripts(p[2:], 1) as n from p),
        f as (select doc_id, n, split_part(x, '{PART}', 1) as place, split_part(x, '{PART}', 2) as d, regexp_replace(lower(split_part(x, '{PART}', 3)), '\\.$', '') as m, split_part(x, '{PART}', 4) as y, split_part(x, '{PART}', 5) as body from u)
        select doc_id, n, place, strftime(try_cast(y || '-' || lpad(cast({MONTH_SQL} as varchar), 2, '0') || '-' || lpad(d, 2, '0') as date), '%Y-%m-%d') as iso, length(body) as n_chars, md5(body) as body from f""",
)
def headed_segments(spark: SparkSession, d: str) -> DataFrame:
    """Letters of a text: each begins at a dateline and ends before the next; place, date and body of each."""
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(pieces(F.col("text"), DATELINE, HEADED)).alias("n", "x")).where("n > 0")
    part = [F.split_part("x", F.lit(PART), F.lit(i)) for i in range(1, 6)]
    iso = iso_date(part[3], part[2], part[1])
    return rows.select("doc_id", F.col("n").cast("long").alias("n"), part[0].alias("place"), iso.alias("iso"), F.length(part[4]).cast("long").alias("n_chars"), F.md5(part[4]).alias("body"))


@CORE.add(
    "date_anchored",
    f"""with p as (select doc_id, {_pieces_sql('text', ANCHOR, ANCHORED)} as p from documents where text is not null),
        u as (select doc_id, unnest(p[2:]) as x, unnest(p[:-2]) as b, generate_subscripts(p[2:], 1) as n from p),
        f as (select doc_id, n, cast(split_part(x, '{PART}', 1) as int) as day, lower(split_part(x, '{PART}', 2)) as m, split_part(x, '{PART}', 3) as body, right(b, 60) as before from u)
        select doc_id, n, day, {MONTH_SQL} as month, length(body) as n_chars, regexp_extract(before, '([A-Z][A-Za-zà-ÿ-]+)[^A-Z]*$', 1) as name_before from f""",
)
def date_anchored(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of a text that begin at a date in the running text: its day and month, and the last name before it."""
    split = table(spark, d, "documents").where("text is not null").select("doc_id", pieces(F.col("text"), ANCHOR, ANCHORED).alias("p"))
    rows = split.select("doc_id", F.posexplode(F.transform("p", lambda x, i: F.struct(x.alias("x"), F.get("p", i - 1).alias("b")))).alias("n", "s")).where("n > 0")
    part = [F.split_part("s.x", F.lit(PART), F.lit(i)) for i in range(1, 4)]
    named = F.lower(part[1])
    month = F.coalesce(*[F.when(named.isin(*names), F.lit(k)) for k, names in MONTHS.items()])
    name = F.regexp_extract(F.right("s.b", F.lit(60)), r"([A-Z][A-Za-zà-ÿ-]+)[^A-Z]*$", 1)
    return rows.select("doc_id", F.col("n").cast("long").alias("n"), part[0].cast("int").alias("day"), month.alias("month"), F.length(part[2]).cast("long").alias("n_chars"), name.alias("name_before"))


# Openings looked for in running text.
PROBES = ("I have received", "Do not let", "You will give", "I forbid", "J'ai reçu", "Le siège de")
SLICE = 120


@CORE.add(
    "probe_slices",
    "with " + ", ".join(f"p{i} as (select '{p.replace(chr(39), chr(39) * 2)}' as probe, doc_id, instr(text, '{p.replace(chr(39), chr(39) * 2)}') as found_at, text from documents)" for i, p in enumerate(PROBES))
    + " select probe, doc_id, found_at, substr(text, found_at, " + str(SLICE) + ") as slice from (" + " union all ".join(f"select * from p{i}" for i in range(len(PROBES))) + ") where found_at > 0",
)
def probe_slices(spark: SparkSession, d: str) -> DataFrame:
    """Where each of a few openings first stands in a text, and what follows it; one scan for all of them."""
    at = F.array(*[F.struct(F.lit(p).alias("probe"), F.instr("text", p).cast("long").alias("found_at")) for p in PROBES])
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", "text", F.explode(F.filter(at, lambda x: x["found_at"] > 0)).alias("x"))
    return rows.select("x.probe", "doc_id", "x.found_at", F.substring("text", F.col("x.found_at").cast("int"), F.lit(SLICE)).alias("slice"))


YEAR_RAW = c("year").or_("").trim()
YEAR_DIGITS = Both(lambda: F.translate(YEAR_RAW.col, "OolISsB", "0011558"), f"translate({YEAR_RAW.sql}, 'OolISsB', '0011558')").sub("[^0-9]+")
YEAR_FIXED = case((YEAR_DIGITS.has("^17(8[4-9]|9[0-9])$|^18([01][0-9]|2[01])$"), YEAR_DIGITS), (YEAR_DIGITS.has("^170[6-9]$"), lit("179") + Both(lambda: F.right(YEAR_DIGITS.col, F.lit(1)), f"right({YEAR_DIGITS.sql}, 1)")))


@CORE.add("years_repaired", f"with {WEL} select coalesce(year, '') as written, {YEAR_FIXED.sql} as year, count(*) as pieces from wel group by 1, 2")
def years_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Years as written, with misread digits put right where a year of the archive's range comes out; else null."""
    return dispatches(spark, d).groupBy(F.coalesce("year", F.lit("")).alias("written"), YEAR_FIXED.col.alias("year")).agg(F.count("*").alias("pieces"))


OK_NAME = ~PRETTY.has("[A-Z]{5,}|[0-9]") & (PRETTY != "")
FRAME = case((OK_NAME, lit("To ") + PRETTY + ":"))
KIND_TITLE = case((OK_NAME, lit("Letter to ") + PRETTY), (c("place").or_("").trim() != "", lit("Letter from ") + c("place").trim()), other="Letter")


@CORE.add("frames", f"with {WEL} select piece_key, {FRAME.sql} as frame, {KIND_TITLE.sql} as title from wel")
def frames(spark: SparkSession, d: str) -> DataFrame:
    """The frame and the title of a letter: the addressee if readable, else the place."""
    return dispatches(spark, d).select("piece_key", FRAME.col.alias("frame"), KIND_TITLE.col.alias("title"))


@CORE.add(
    "drafts",
    f"""with {REC}, {EVENTS}, j as (select r.id, coalesce(e.v.label || '.', '') as scene, {CLAUSE_SHORT.sql.replace('"displayText"', 'r.displayText')} as clause from rec r left join e on e.id = r.eventIds[1] where r.displayText is not null),
        a as (select id, trim(scene || ' ' || clause) as draft, scene = '' as bare from j)
        select id, case when length(draft) > 200 then left(draft, 199) || '…' else draft end as draft, array_to_string(list_filter([case when bare then 'no scene' end, case when length(draft) > 200 then 'long' end, case when contains(draft, '?') then 'question' end], lambda x: x is not null), '+') as flags from a""",
)
def drafts(spark: SparkSession, d: str) -> DataFrame:
    """Scene and clause put together, shortened if long, with the flags that ask for a review."""
    r = records(spark, d, "displayText", "eventIds").where("displayText is not null").select("id", "displayText", F.get("eventIds", F.lit(0)).alias("event"))
    j = r.join(_events(spark, d).select(F.col("id").alias("event"), "label"), "event", "left")
    scene = F.coalesce(F.concat("label", F.lit(".")), F.lit(""))
    a = j.select("id", F.trim(F.concat(scene, F.lit(" "), CLAUSE_SHORT.col)).alias("draft"), (scene == "").alias("bare"))
    long = F.length("draft") > 200
    flags = F.array_compact(F.array(F.when(F.col("bare"), "no scene"), F.when(long, "long"), F.when(F.col("draft").contains("?"), "question")))
    return a.select("id", F.when(long, F.concat(F.left("draft", F.lit(199)), F.lit("…"))).otherwise(F.col("draft")).alias("draft"), F.array_join(flags, "+").alias("flags"))
