"""Admission, the verifier's rules and the manifest as relations; lookups and joins of the publishing run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions.dates import era_of, safe_date
from folio.operators import match
from folio.operators.records import longest, violations
from folio.plans.archive import ERA_SQL, REC, records
from folio.plans.both import Both, c, case, lit
from folio.plans.cards import MONTH_NAMES
from folio.plans.matching import DATED, SHARD, TAR, dispatches, shard, tarbell
from folio.registry import CORE
from folio.sources.tables import table

# Patterns of the verifier.
# Edges of words are spelled out, since engines differ about accented letters.
_A, _Z = r"(^|[^A-Za-zÀ-ÿ0-9_])", r"($|[^A-Za-zÀ-ÿ0-9_])"
VOICE = rf"(?i){_A}(I|we|my|our|me|us|you|your){_Z}"
DATES = (
    rf"(?i){_A}((January|February|April|June|July|August|September|October|November|December|1[789][0-9][0-9]|1[78]\s[0-9][0-9]|[0-9]{{1,2}}(st|nd|rd|th)|[0-9]+d){_Z}"
    r"|(jan|feb|apr|jun|jul|aug|sep|sept|oct|nov|dec)\.)"
)
CAPITAL_DATES = rf"{_A}((May|March|Jan|Feb|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec){_Z}|Mar\.)"
ADMISSION_DATES = rf"{_A}({MONTH_NAMES}|1[789][0-9][0-9]|1[78]\s[0-9][0-9]|[0-9]{{1,2}}(st|nd|rd|th)){_Z}"
DEBRIS, BROKEN = r"  |\s[,.]|,\s*,|(\s|--|-|\()\s*\z", rf"(?i){_A}((the|a|an)\s*[,.!?;:]|on the and the{_Z})"
CASING = rf"{_A}(I\s+[A-ZÀ-Þ][a-zà-þ]{{2,}}|[a-z]{{1,3}}[A-Z][A-Za-z]+{_Z})"

X = c("x")
TWEET_RULES = {
    "err:too_long": X.length() > 280, "err:no_voice": ~X.has(VOICE), "err:date": X.has(DATES) | X.has(CAPITAL_DATES), "err:debris": X.has(DEBRIS), "err:broken": X.has(BROKEN),
    "err:casing": X.has(CASING),
}


def _violations_sql(rules: dict[str, Both], source: str) -> str:
    return " union all ".join(f"select '{n.split(':')[1]}' as rule, '{n.split(':')[0]}' as severity, id as key from {source} where {q.sql}" for n, q in rules.items())


#: Paraphrases are checked with the contexts of the voices, so that every rule has something to find.
PARAPHRASES = f"{REC}, {SHARD}, p as (select id, tweet as x from shard where trim(tweet) <> '' union all select id, context from rec where trim(context) <> '')"


def _paraphrases(spark: SparkSession, d: str) -> DataFrame:
    a = shard(spark, d).where("trim(tweet) <> ''").select("id", F.col("tweet").alias("x"))
    return a.unionByName(records(spark, d, "context").where("trim(context) <> ''").select("id", F.col("context").alias("x")))


@CORE.add("paraphrase_violations", f"with {PARAPHRASES} {_violations_sql(TWEET_RULES, 'p')}")
def paraphrase_violations(spark: SparkSession, d: str) -> DataFrame:
    return violations(_paraphrases(spark, d), "id", {n: q.col for n, q in TWEET_RULES.items()})


ADMITTED = (X.length() <= 280) & X.has(VOICE) & ~X.has(ADMISSION_DATES)


@CORE.add("override_admission", f"with {PARAPHRASES} select {ADMITTED.sql} as admitted, count(*) as paraphrases, min(id) as example from p group by 1")
def override_admission(spark: SparkSession, d: str) -> DataFrame:
    """Paraphrases an override may bring in: not long, in the first or second person, without a date."""
    return _paraphrases(spark, d).groupBy(ADMITTED.col.alias("admitted")).agg(F.count("*").alias("paraphrases"), F.min("id").alias("example"))


LETTERS = c("documentType").or_("letter").lower().holds(lit("letter"))
OPENING = c("displayText").or_("").lower().sub("[^a-z0-9_]+", " ").trim().left(120)


@CORE.add(
    "letter_coverage",
    f"""with {REC}, l as (select id, date, sourceUrl, context, {OPENING.sql} as opening from rec where {LETTERS.sql})
        select 'missing' as problem, count(*) as found, min(id) as example from l where trim(coalesce(context, '')) = ''
        union all select 'repeated_text', count(*), min(e) from (select min(id) as e from l where trim(context) <> '' group by context having count(*) > 1)
        union all select 'repeated_opening', count(*), min(e) from (select min(id) as e from l where opening <> '' group by date, sourceUrl, opening having count(*) > 1)""",
)
def letter_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Letters without a paraphrase, paraphrases used twice, and openings repeated on one day from one source."""
    kept = records(spark, d, "date", "sourceUrl", "context", "displayText", "documentType").where(LETTERS.col).withColumn("opening", OPENING.col)
    missing = kept.where(F.trim(F.coalesce("context", F.lit(""))) == "").select("id")
    text = kept.where("trim(context) <> ''").groupBy("context").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n > 1").select("id")
    opening = kept.where("opening <> ''").groupBy("date", "sourceUrl", "opening").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n > 1").select("id")
    parts = {"missing": missing, "repeated_text": text, "repeated_opening": opening}
    return reduce(DataFrame.unionByName, [x.agg(F.lit(n).alias("problem"), F.count("*").alias("found"), F.min("id").alias("example")) for n, x in parts.items()])


REQUIRED = ("author", "handle", "date", "timeLabel", "location", "displayText", "sourceTitle", "archive", "editorialStatus")
YEAR = f"cast(substr(date, 1, 4) as int)"  # noqa: F541


@CORE.add(
    "publish_failures",
    f"""with v as (select * from nap_voices where editorialStatus = 'verified'), f as (
        select 'no_id' as failure, id from v where coalesce(id, '') = ''
        union all select 'duplicate_id', id from v where coalesce(id, '') <> '' group by id having count(*) > 1
        {' '.join(f"union all select 'missing_{k}', id from v where {k} is null" for k in REQUIRED)}
        union all select 'year_outside', id from v where {YEAR} not between 1790 and 1820)
        select failure, count(*) as rows, min(id) as example from f group by 1""",
)
def publish_failures(spark: SparkSession, d: str) -> DataFrame:
    """What stops a publishing run: rows without id or a required field, ids met twice, years outside the range."""
    v = table(spark, d, "nap_voices").where("editorialStatus = 'verified'")
    twice = v.where("id <> ''").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate_id").alias("failure"), "id")
    rules = {"no_id": F.coalesce("id", F.lit("")) == "", **{f"missing_{k}": F.col(k).isNull() for k in REQUIRED}, "year_outside": ~F.substring("date", 1, 4).cast("int").between(1790, 1820)}
    found = F.array_compact(F.array(*[F.when(q, F.lit(n)) for n, q in rules.items()]))
    one = v.select(F.explode(found).alias("failure"), "id")
    return one.unionByName(twice).groupBy("failure").agg(F.count("*").alias("rows"), F.min("id").alias("example"))


MANIFEST = f"""{REC}, ok as (select *, {ERA_SQL} as era from rec where editorialStatus = 'verified')"""


@CORE.add(
    "manifest_sections",
    f"""with {MANIFEST} select 'counts' as section, 'posts' as key, cast(count(*) as varchar) as value from ok
        union all select 'counts', 'dates', cast(count(distinct date) as varchar) from ok union all select 'counts', 'authors', cast(count(distinct author) as varchar) from ok
        union all select 'counts', 'slices', cast(count(distinct archive) as varchar) from ok union all select 'counts', 'events', cast(count(distinct id) as varchar) from nap_events
        union all select 'contentSpan', 'from', min(date) from ok union all select 'contentSpan', 'to', max(date) from ok
        union all select 'byYear', substr(date, 1, 4), cast(count(*) as varchar) from ok group by 2 union all select 'dateCount', date, cast(count(*) as varchar) from ok group by 2
        union all select 'builtFrom', archive, cast(count(*) as varchar) from ok group by 2 union all select 'authors', author, cast(count(*) as varchar) from ok group by 2
        union all select 'shards', era, cast(count(*) as varchar) from ok group by 2 union all select distinct 'shardByYear', substr(date, 1, 4), era from ok""",
)
def manifest_sections(spark: SparkSession, d: str) -> DataFrame:
    """The manifest object as (section, key, value), one pass for all its counts; ``sinks.write_object`` writes it."""
    ok = records(spark, d, "editorialStatus", "date", "author", "archive").where("editorialStatus = 'verified'").withColumn("era", era_of(F.col("date")))
    year = F.substring("date", 1, 4)
    cells = F.array(*[F.struct(F.lit(s).alias("section"), k.alias("key")) for s, k in (("byYear", year), ("dateCount", F.col("date")), ("builtFrom", F.col("archive")), ("authors", F.col("author")), ("shards", F.col("era")))])
    grouped = ok.select(F.explode(cells).alias("x")).groupBy("x.section", "x.key").agg(F.count("*").cast("string").alias("value"))
    one = ok.agg(*[f.cast("string").alias(n) for n, f in (("posts", F.count("*")), ("dates", F.count_distinct("date")), ("authors", F.count_distinct("author")), ("slices", F.count_distinct("archive")), ("from", F.min("date")), ("to", F.max("date")))])
    section = F.when(F.col("key").isin("from", "to"), "contentSpan").otherwise("counts")
    scalars = one.select(F.explode(F.create_map(*[x for n in one.columns for x in (F.lit(n), F.col(n))])).alias("key", "value")).select(section.alias("section"), "key", "value")
    events = table(spark, d, "nap_events").agg(F.count_distinct("id").cast("string").alias("value")).select(F.lit("counts").alias("section"), F.lit("events").alias("key"), "value")
    eras = ok.select(F.lit("shardByYear").alias("section"), year.alias("key"), F.col("era").alias("value")).distinct()
    return reduce(DataFrame.unionByName, [grouped, scalars, events, eras])


@CORE.add("source_links", "select distinct sourceUrl from nap_voices where sourceUrl is not null")
def source_links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nap_voices").where("sourceUrl is not null").select("sourceUrl").distinct()


@CORE.add(
    "author_admission",
    f"with {REC}, a as (select author from rec group by author order by count(*) desc, author limit 1) select author, author in (select author from a) as admitted, count(*) as records, min(id) as example from rec group by 1",
)
def author_admission(spark: SparkSession, d: str) -> DataFrame:
    """An allow-list of authors (here the one most recorded): what is admitted and what is skipped, with an example."""
    per = records(spark, d, "author").groupBy("author").agg(F.count("*").alias("records"), F.min("id").alias("example"))
    allowed = per.orderBy(F.desc("records"), "author").limit(1).select("author", F.lit(True).alias("admitted"))
    return per.join(F.broadcast(allowed), "author", "left").select("author", F.coalesce("admitted", F.lit(False)).alias("admitted"), "records", "example")


@CORE.add("denied_ids", f"with {REC} select id, date from rec where id not in (select id from nap_voices where editorialStatus = 'rejected' and id is not null) and date between '1796-01-01' and '1809-12-31'")
def denied_ids(spark: SparkSession, d: str) -> DataFrame:
    """Records of a range of dates whose id is not on the deny-list (here the rejected ones)."""
    denied = table(spark, d, "nap_voices").where("editorialStatus = 'rejected'").select("id")
    return records(spark, d, "date").where(F.col("date").between("1796-01-01", "1809-12-31")).join(denied, "id", "left_anti").select("id", "date")


# Addressees who are nobody.
NOBODY = ("", "the same", "same", "unknown", "the army", "soldiers")
WHO = Both(lambda: F.regexp_replace(F.lower(F.trim(F.coalesce("to", F.lit("")))), "^to ", ""), "regexp_replace(lower(trim(coalesce(\"to\", ''))), '^to ', '')")


@CORE.add("named_addressees", f"with {DATED} select piece_key, {WHO.sql} as who from dated where {(~WHO.is_in(*NOBODY)).sql}")
def named_addressees(spark: SparkSession, d: str) -> DataFrame:
    return dispatches(spark, d).where((~WHO.is_in(*NOBODY)).col).select("piece_key", WHO.col.alias("who"))


FLAGS = {"short": c("displayText").length() < 80, "number": c("displayText").has("[0-9]"), "question": c("displayText").has(r"\?"), "omission": c("displayText").has("…|\\[\\.\\.\\.\\]"), "capitals": c("displayText").has("[A-Z]{5,}")}
ALLOWED = ("number", "omission")


@CORE.add(
    "flag_approval",
    f"""with {REC}, f as (select id, list_filter([{', '.join(f"case when {q.sql} then '{n}' end" for n, q in FLAGS.items())}], lambda x: x is not null) as flags from rec where displayText is not null)
        select array_to_string(flags, '+') as flags, len(list_filter(flags, lambda x: x not in ({', '.join(map(repr, ALLOWED))}))) = 0 as approved, count(*) as records from f group by 1, 2""",
)
def flag_approval(spark: SparkSession, d: str) -> DataFrame:
    """Texts whose flags are a subset of the allowed ones pass without review."""
    flags = F.array_compact(F.array(*[F.when(q.col, F.lit(n)) for n, q in FLAGS.items()]))
    f = records(spark, d, "displayText").where("displayText is not null").select("id", flags.alias("flags"))
    approved = F.size(F.array_except("flags", F.array(*[F.lit(x) for x in ALLOWED]))) == 0
    return f.groupBy(F.array_join("flags", "+").alias("flags"), approved.alias("approved")).agg(F.count("*").alias("records"))


SECRET = r"(?i)(secret|betray[a-z]*|prisoners?)"
REDACTED = c("displayText").sub(SECRET, "████")


@CORE.add("redacted", f"with {REC} select id, {REDACTED.sql} as text from rec where displayText is not null")
def redacted(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d, "displayText").where("displayText is not null").select("id", REDACTED.col.alias("text"))


KINDS = "(?i)(note|speech|address|order|letter|proclamation|report|bulletin|decree|message)"
TITLE = c("title").or_("")
FINAL = (TITLE.count(KINDS) < 2) & ~TITLE.has("75|/e/ia|Ricssiaii") & (c("body").or_("").length() > 60) & (c("iso").or_("").left(4) != "1769")


@CORE.add(
    "pieces_final",
    f"""with k as (select *, iso as day, left(regexp_replace(lower(title), '[^a-z0-9]+', '', 'g'), 36) as tk from tarbell),
        b as (select unnest(arg_min({{'piece_key': piece_key, 'title': title, 'iso': iso, 'body': body}}, (-coalesce(length(body), 0), piece_key))) from k group by day, tk)
        select left(iso, 4) as year, count(*) as pieces, cast(sum(length(body)) as bigint) as n_chars from b where {FINAL.sql} group by 1""",
)
def pieces_final(spark: SparkSession, d: str) -> DataFrame:
    """Parsed pieces, the longest of each day and title, without junk titles, stubs and a wrong year; counted by year."""
    t = table(spark, d, "tarbell").select("piece_key", "title", "iso", "body").withColumn("tk", F.left(F.regexp_replace(F.lower("title"), "[^a-z0-9]+", ""), F.lit(36)))
    best = longest(t, ["iso", "tk"], "body", "piece_key").where(FINAL.col)
    return best.groupBy(F.left("iso", F.lit(4)).alias("year")).agg(F.count("*").alias("pieces"), F.sum(F.length("body")).alias("n_chars"))


@CORE.add(
    "day_neighbours",
    f"""with {REC}, d as (select distinct date, try_cast(date as date) as day from rec where try_cast(date as date) is not null)
        select date, case when day > date '1789-01-01' then strftime(day - interval 1 day, '%Y-%m-%d') end as day_before, case when day < date '1821-12-31' then strftime(day + interval 1 day, '%Y-%m-%d') end as day_after,
        lag(date) over (order by date) as documented_before, lead(date) over (order by date) as documented_after from d""",
)
def day_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The days before and after within the range, and the documented ones; a calendar bounds the one ordered window."""
    day = safe_date(F.col("date"))
    days = records(spark, d, "date").select("date", day.alias("day")).where("day is not null").distinct()
    order = Window.orderBy("date")
    before = F.when(F.col("day") > "1789-01-01", F.date_format(F.date_sub("day", 1), "yyyy-MM-dd"))
    after = F.when(F.col("day") < "1821-12-31", F.date_format(F.date_add("day", 1), "yyyy-MM-dd"))
    return days.select("date", before.alias("day_before"), after.alias("day_after"), F.lag("date").over(order).alias("documented_before"), F.lead("date").over(order).alias("documented_after"))


EVENTS = "e as (select id, arg_min({'label': label, 'date': date, 'blurb': blurb}, loaded_at) as v from nap_events group by id)"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nap_events").groupBy("id").agg(F.min_by(F.struct("label", "date", "blurb"), "loaded_at").alias("v")).select("id", "v.*")


@CORE.add(
    "event_scenes",
    f"""with {REC}, {EVENTS}, j as (select r.id, r.date, trim(r.location) as place, e.v.label as label, e.v.date as day, e.v.blurb as blurb from rec r left join e on e.id = r.eventIds[1])
        select id, label, case when blurb is not null and (day is null or substr(date, 1, 7) >= substr(day, 1, 7)) then blurb when coalesce(place, '') = '' then '' else place || '.' end as scene from j""",
)
def event_scenes(spark: SparkSession, d: str) -> DataFrame:
    """A record's first event: its blurb, if the event is not in the record's future, else the place."""
    r = records(spark, d, "date", "location", "eventIds").select("id", "date", F.trim("location").alias("place"), F.get("eventIds", F.lit(0)).alias("event"))
    j = r.join(_events(spark, d).select(F.col("id").alias("event"), "label", F.col("date").alias("day"), "blurb"), "event", "left")
    open_ = F.col("blurb").isNotNull() & (F.col("day").isNull() | (F.substring("date", 1, 7) >= F.substring("day", 1, 7)))
    scene = F.when(open_, F.col("blurb")).when(F.coalesce("place", F.lit("")) == "", "").otherwise(F.concat("place", F.lit(".")))
    return j.select("id", "label", scene.alias("scene"))


@CORE.add("event_banner", f"with {REC}, {EVENTS}, f as (select v.date as date, min(id) as event_id from e group by 1) select distinct rec.date, event_id from rec left join f on f.date = rec.date")
def event_banner(spark: SparkSession, d: str) -> DataFrame:
    """The first event of each documented day."""
    first = _events(spark, d).groupBy("date").agg(F.min("id").alias("event_id"))
    return records(spark, d, "date").select("date").distinct().join(first, "date", "left")


@CORE.add(
    "intake_translations",
    f"""with {SHARD}, i as (select id, originalText as fr from shard where trim(originalText) <> ''), t as (select id, displayText as en from shard where trim(displayText) <> '')
        select case when en is null then 'unmatched' else 'translated' end as state, count(*) as records, cast(sum(length(fr)) as bigint) as n_chars from i left join t using (id) group by 1""",
)
def intake_translations(spark: SparkSession, d: str) -> DataFrame:
    s = shard(spark, d)
    i, t = s.where("trim(originalText) <> ''").select("id", F.col("originalText").alias("fr")), s.where("trim(displayText) <> ''").select("id", F.col("displayText").alias("en"))
    state = F.when(F.col("en").isNull(), "unmatched").otherwise("translated")
    return i.join(t, "id", "left").groupBy(state.alias("state")).agg(F.count("*").alias("records"), F.sum(F.length("fr")).alias("n_chars"))


@CORE.add(
    "selection_match",
    f"""with {REC}, {TAR}, j as (select t.piece_key, r.id, lower(trim(r.location)) as place, lower(t.title) as title from tar t left join rec r on r.date = t.iso)
        select piece_key, arg_min(id, (case when contains(title, place) and place <> '' then 0 else 1 end, id)) as id, count(id) as candidates from j group by piece_key""",
)
def selection_match(spark: SparkSession, d: str) -> DataFrame:
    """The first record of a piece's day, one whose place the title names before others; null where there is none."""
    r = records(spark, d, "date", "location").select("id", F.col("date").alias("iso"), F.lower(F.trim("location")).alias("place"))
    j = tarbell(spark, d).select("piece_key", "iso", F.lower("title").alias("title")).join(r, "iso", "left")
    named = F.when(F.contains("title", "place") & (F.col("place") != ""), 0).otherwise(1)
    return j.groupBy("piece_key").agg(F.min_by("id", F.when(F.col("id").isNotNull(), F.struct(named, "id"))).alias("id"), F.count("id").alias("candidates"))


VOLUME = case((c("date").left(4) < "1803", "1"), (c("date").left(4) < "1810", "2"), other="3")


@CORE.add("volumes", f"with {REC} select {VOLUME.sql} as volume, count(*) as records, min(date) as first_date from rec where date is not null group by 1")
def volumes(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d, "date").where("date is not null").groupBy(VOLUME.col.alias("volume")).agg(F.count("*").alias("records"), F.min("date").alias("first_date"))


# Endings (letters cut off, letters put on) and spellings by which a word may stand for a listed one.
STEMS = (("", 0, ""), ("ies", 3, "y"), ("ied", 3, "y"), ("es", 2, ""), ("s", 1, ""), ("ed", 2, ""), ("ed", 1, ""), ("ing", 3, ""), ("ing", 3, "e"), ("re", 2, "er"), ("est", 3, ""), ("est", 3, "e"), ("men", 3, "man"))
SPELLINGS = (("our", "or"), ("oe", "e"), ("gg", "g"), ("desp", "disp"), ("nce$", "nse"), ("ise$", "ize"))


def stem_forms(w: Both) -> Both:
    """Array of the forms a word may have in a word list: itself, its stems, and each in other spellings."""
    sql = [f"case when ends_with({w.sql}, '{end}') then left({w.sql}, length({w.sql}) - {cut}) || '{add}' end" for end, cut, add in STEMS]
    stems = f"list_filter([{', '.join(sql)}], lambda x: x is not null)"
    spelled = [stems, *(f"list_transform({stems}, lambda x: regexp_replace(x, '{a}', '{b}', 'g'))" for a, b in SPELLINGS)]

    def respelled(a: str, b: str):
        return lambda x: F.regexp_replace(x, a, b)

    def make():
        forms = F.array_compact(F.array(*[F.when(F.endswith(w.col, F.lit(end)), F.concat(F.left(w.col, F.length(w.col) - cut), F.lit(add))) for end, cut, add in STEMS]))
        return F.array_distinct(F.concat(forms, *[F.transform(forms, respelled(a, b)) for a, b in SPELLINGS]))

    return Both(make, f"list_distinct(flatten([{', '.join(spelled)}]))")


FORMS = stem_forms(c("word"))
WORDS = "select word, count(distinct doc_id) as n from (select doc_id, unnest(string_split(trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')), ' ')) as word from documents where lang = 'en') where length(word) >= 4 group by word"


@CORE.add(
    "words_known",
    f"""with w as ({WORDS}), l as (select word from w where n >= 5), f as (select word, unnest({FORMS.sql}) as form from w where n < 5)
        select word, min(form) as known_as from f where form in (select word from l) group by word""",
)
def words_known(spark: SparkSession, d: str) -> DataFrame:
    """Rare words that a word list (here the words of five documents or more) knows by a stem or another spelling."""
    t = table(spark, d, "documents").where("lang = 'en'").select("doc_id", F.explode(F.array_distinct(F.split(F.trim(F.regexp_replace(F.lower("text"), "[^a-z]+", " ")), " "))).alias("word"))
    w = t.where(F.length("word") >= 4).groupBy("word").agg(F.count_distinct("doc_id").alias("n"))
    listed = w.where("n >= 5").select(F.col("word").alias("form"))
    forms = w.where("n < 5").select("word", F.explode(FORMS.col).alias("form"))
    return forms.join(listed, "form", "left_semi").groupBy("word").agg(F.min("form").alias("known_as"))


@CORE.add(
    "role_as_of",
    f"""with r as (select distinct {WHO.sql} as who, iso, "to" from (with {DATED} select * from dated) where iso is not null and {(~WHO.is_in(*NOBODY)).sql}),
        k as (select who, iso, min("to") as role from r group by 1, 2)
        select a.who, a.iso, (select min(b.iso) from k b where b.who = a.who) as first_day, count(*) over (partition by a.who order by a.iso) as letters_so_far from k a""",
)
def role_as_of(spark: SparkSession, d: str) -> DataFrame:
    """What was known of a person on a day: the first day and the letters so far, never from the person's future."""
    k = dispatches(spark, d).where("iso is not null").where((~WHO.is_in(*NOBODY)).col).select(WHO.col.alias("who"), "iso").distinct()
    first = k.groupBy("who").agg(F.min("iso").alias("first_day"))
    so_far = F.count("*").over(Window.partitionBy("who").orderBy("iso"))
    return k.withColumn("letters_so_far", so_far).join(first, "who").select("who", "iso", "first_day", "letters_so_far")
