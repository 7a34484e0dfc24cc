"""Queries that clean, split, score and judge the texts of the archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import score
from folio.functions import text as T
from folio.registry import CORE
from folio.sources.tables import table

BODY = "b as (select distinct piece_key, body from tarbell where piece_key is not null)"
TEXT = "t as (select distinct id, displayText as x from nap_voices where id is not null)"


def bodies(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tarbell").where("piece_key is not null").select("piece_key", "body").distinct()


def texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nap_voices").where("id is not null").select("id", F.col("displayText").alias("x")).distinct()


def rr(expr: str, *pairs: tuple[str, str]) -> str:
    """Nested global regexp_replace of the oracle; groups are written \\1 there."""
    for pattern, to in pairs:
        expr = f"regexp_replace({expr}, '{pattern}', '{to}', 'g')"
    return expr


SQUEEZE = "trim(" + rr("{}", (r"\s+", " ")) + ")"
CLEAN_SQL = "trim(" + rr("body", *[(p, t.replace("$", "\\")) for p, t in T.CLEANING]) + ")"


@CORE.add("text_dehyphenate", f"with {BODY} select piece_key, {SQUEEZE.format(rr('body', ('([A-Za-z])-' + chr(92) + 's+([A-Za-z])', chr(92) + '1' + chr(92) + '2')))} as text from b")
def text_dehyphenate(spark: SparkSession, d: str) -> DataFrame:
    return bodies(spark, d).select("piece_key", T.dehyphenate(F.col("body")).alias("text"))


@CORE.add("text_clean", f"with {BODY} select piece_key, {CLEAN_SQL} as text from b")
def text_clean(spark: SparkSession, d: str) -> DataFrame:
    return bodies(spark, d).select("piece_key", T.clean(F.col("body")).alias("text"))


POLISHED = rr(SQUEEZE.format(rr("x", (r"^[\s,;:.\-]+", ""))), (r" \.$", "."))


@CORE.add("text_polish", f"with {TEXT}, p as (select id, {POLISHED} as p from t) select id, upper(left(p, 1)) || substr(p, 2) as text from p")
def text_polish(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).select("id", T.polish(F.col("x")).alias("text"))


@CORE.add(
    "text_slugs",
    "select distinct sourceTitle, " + rr(rr("lower(sourceTitle)", ("[^a-z0-9]+", "-")), ("^-+|-+$", "")) + " as slug, " + rr("lower(sourceTitle)", ("[^a-z0-9]+", "")) + f" as key, translate(lower(sourceTitle), '{T.ACCENTED}', '{T.PLAIN}') as folded from nap_voices",
)
def text_slugs(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("sourceTitle")
    return table(spark, d, "nap_voices").select("sourceTitle").distinct().select("sourceTitle", T.slug(c).alias("slug"), T.letters_key(c).alias("key"), T.fold(c).alias("folded"))


CUT = "left(x, 140)"
SPACE_AT = f"(case when contains({CUT}, ' ') then length({CUT}) - instr(reverse({CUT}), ' ') else -1 end)"


@CORE.add("text_snippets", f"with {TEXT} select id, case when length(x) <= 140 then x else (case when {SPACE_AT} > 90 then left({CUT}, {SPACE_AT}) else {CUT} end) || '…' end as snippet from t")
def text_snippets(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).select("id", T.truncate_at_space(F.col("x"), 140, 90).alias("snippet"))


def _cut_sql(limit: int) -> str:
    cut, options = f"left(x, {limit})", []
    for s in T.SEPARATORS:
        at = f"(case when contains({cut}, '{s}') then length({cut}) - instr(reverse({cut}), '{s[::-1]}') - {len(s)} + 1 else -1 end)"
        options.append(f"case when {at} > {0.45 * limit} then left({cut}, {at} + {len(s.rstrip())}) end")
    return f"case when length(x) <= {limit} then x else coalesce({', '.join(options)}, {cut}) || ' […]' end"


@CORE.add("text_boundary_cut", f"with {TEXT} select id, {_cut_sql(200)} as text from t")
def text_boundary_cut(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).select("id", T.boundary_cut(F.col("x"), 200).alias("text"))


@CORE.add("text_html", f"""with {TEXT} select id, replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') as html from t""")
def text_html(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).select("id", T.html_escape(F.col("x")).alias("html"))


SPLIT = f"list_filter(string_split(regexp_replace(x, '([.!?;:])\\s+', '\\1{T.MARK}', 'g'), '{T.MARK}'), lambda s: length(trim(s)) > 0)"
GLUE = f"""g as (select id, list_reduce({SPLIT}, lambda a, s: {{'o': case when length(case when a.b = '' then s else a.b || ' ' || s end) >= 40
    then list_append(a.o, case when a.b = '' then s else a.b || ' ' || s end) else a.o end,
    'b': case when length(case when a.b = '' then s else a.b || ' ' || s end) >= 40 then '' else case when a.b = '' then s else a.b || ' ' || s end end}},
    {{'o': []::varchar[], 'b': ''}}) as g from t),
    glued as (select id, case when g.b <> '' and len(g.o) = 0 then [g.b] else g.o end as s from g)"""
ROWS = "rows as (select id, unnest(s) as s, generate_subscripts(s, 1) as n from glued)"


@CORE.add("sentence_split", f"with {TEXT}, l as (select id, {SPLIT} as s from t) select id, unnest(s) as sentence, generate_subscripts(s, 1) as n from l")
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    rows = texts(spark, d).select("id", F.posexplode(T.sentences(F.col("x"))).alias("n", "sentence"))
    return rows.select("id", "sentence", (F.col("n") + 1).cast("long").alias("n"))


@CORE.add("sentence_glue", f"with {TEXT}, {GLUE}, {ROWS} select id, s as sentence, n from rows")
def sentence_glue(spark: SparkSession, d: str) -> DataFrame:
    rows = texts(spark, d).select("id", F.posexplode(T.glued_sentences(F.col("x"))).alias("n", "sentence"))
    return rows.select("id", "sentence", (F.col("n") + 1).cast("long").alias("n"))


def cnt(pattern: str, c: str = "s") -> str:
    return f"len(regexp_extract_all({c}, '{pattern}'))"


def has(pattern: str, c: str = "s") -> str:
    return f"regexp_matches({c}, '{pattern}')"


SENTENCE_SQL = f"""round((case when length(s) between 60 and 220 then 2.0 else 0.0 end) + (case when length(s) > 320 then -1.5 else 0.0 end)
    + least(3, {cnt(score.NUMBER)}) + (case when {has(score.FIRST_PERSON)} then 0.5 else 0.0 end) + (case when {has(score.LABEL)} then -10.0 else 0.0 end)
    - least(2.0, 0.4 * {cnt(' [b-hj-z] ')}) - least(4.0, 2.0 * {cnt('[a-z][0-9]|[0-9][a-z]{4}')}) + (case when {has('^' + chr(92) + '.' + chr(92) + '.')} then -2.0 else 0.0 end)
    - least(2.0, 2.0 * {cnt('[' + chr(92) * 2 + '^]')}), 4)::double"""
CLAUSE_SQL = f"""round((case when {has(score.VERB, 'left(s, 120)')} then 3.0 else 0.0 end) + least(2, {cnt(score.NUMBER)}) + least(2.0, 0.5 * {cnt(score.PROPER)})
    + (case when {has(score.CONJUNCTION)} then -1.0 else 0.0 end) + (case when contains(s, '?') then -2.0 else 0.0 end)
    + (case when {has(score.DATE)} then -4.0 else 0.0 end) + (case when length(s) > 220 then -1.0 else 0.0 end), 4)::double"""
VOICE_SQL = f"""round((case when {has('^(I|We|My|Our)[^A-Za-z]')} then 3.0 else 0.0 end) + (case when {has(score.FIRST_PERSON)} then 2.0 else 0.0 end)
    + (case when {has(score.VERB)} then 2.0 else 0.0 end) + (case when {has(score.DATE)} then -4.0 else 0.0 end)
    + (case when {has(score.BARE_PRONOUN)} and not {has(score.PROPER)} then -4.0 else 0.0 end) + (case when contains(s, '?') then -3.0 else 0.0 end)
    + least(1.5, 0.75 * {cnt(score.NUMBER)}), 4)::double"""


@CORE.add("sentence_scores", f"with {TEXT}, {GLUE}, {ROWS} select id, n, {SENTENCE_SQL} as sentence, {CLAUSE_SQL} as clause, {VOICE_SQL} as voice from rows")
def sentence_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = texts(spark, d).select("id", F.posexplode(T.glued_sentences(F.col("x"))).alias("n", "s"))
    s = F.col("s")
    return rows.select("id", (F.col("n") + 1).cast("long").alias("n"), score.sentence_score(s).alias("sentence"), score.clause_score(s).alias("clause"), score.voice_score(s).alias("voice"))


RANKED = f"""r as (select id, n, s, {SENTENCE_SQL} as score from rows), top as (select id, arg_max(n, (score, -n)) as n, max(n) as last from r group by id),
    side as (select a.id, a.last, t.s as best, t.score as score, n.s as side, n.score as side_score, a.n as pos from top a join r t on t.id = a.id and t.n = a.n
    left join r n on n.id = a.id and n.n = case when a.n < a.last then a.n + 1 else a.n - 1 end)"""


@CORE.add("best_sentence", f"with {TEXT}, {GLUE}, {ROWS}, {RANKED} select id, best as sentence, score from side")
def best_sentence(spark: SparkSession, d: str) -> DataFrame:
    best = texts(spark, d).select("id", score.best_sentence(F.col("x")).alias("b")).where("b is not null")
    return best.select("id", F.col("b.text").alias("sentence"), F.col("b.score").alias("score"))


@CORE.add(
    "best_excerpt",
    f"""with {TEXT}, {GLUE}, {ROWS}, {RANKED}, e as (select id, case when side_score > 0 and length(best) + 1 + length(side) <= 300
        then case when pos < last then best || ' ' || side else side || ' ' || best end else best end as x from side where score >= 0)
        select id, {_cut_sql(300)} as excerpt from e""",
)
def best_excerpt(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).select("id", score.best_excerpt(F.col("x"), 300, 0.0).alias("excerpt")).where("excerpt is not null")


WORDS_SQL = "select id, unnest(string_split(trim(regexp_replace(lower(x), '[^a-z]+', ' ', 'g')), ' ')) as word from t"


@CORE.add("term_frequency", f"with {TEXT}, w as ({WORDS_SQL}) select word, count(*) as n, count(distinct id) as records from w where length(word) >= 4 group by word")
def term_frequency(spark: SparkSession, d: str) -> DataFrame:
    w = texts(spark, d).select("id", F.explode(F.split(F.trim(F.regexp_replace(F.lower("x"), "[^a-z]+", " ")), " ")).alias("word"))
    per_record = w.where(F.length("word") >= 4).groupBy("id", "word").agg(F.count("*").alias("n"))
    return per_record.groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("records"))


RESIDUE = r"(?:^|[^A-Za-z])(le|la|les|des|du|une|est|que|qui|dans|pour|avec|sur|pas|nous|vous)(?:$|[^A-Za-z])"


@CORE.add("language_residue", f"with {TEXT} select id, len(list_distinct(list_transform(regexp_extract_all(x, '{RESIDUE}', 1), lambda w: lower(w)))) as french_words from t where x is not null")
def language_residue(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).where("x is not null").select("id", T.distinct_matches(F.col("x"), RESIDUE).cast("long").alias("french_words"))


QA = (
    ("empty", "trim(coalesce(x, '')) = ''", lambda c: F.coalesce(F.trim(c) == "", F.lit(True))),
    ("length", "length(x) < 60 or length(x) > 620", lambda c: (F.length(c) < 60) | (F.length(c) > 620)),
    ("brackets", "contains(x, '[')", lambda c: c.contains("[")),
    ("capitals", "regexp_matches(x, '[A-Z]{9,}')", lambda c: c.rlike("[A-Z]{9,}")),
    ("symbols", "length(regexp_replace(x, '[A-Za-z0-9 .,;:!?-]', '', 'g')) > 0.08 * length(x)", lambda c: F.length(F.regexp_replace(c, "[A-Za-z0-9 .,;:!?-]", "")) > 0.08 * F.length(c)),
)


@CORE.add("qa_reasons", f"with {TEXT} select case {' '.join(f'when {q} then ' + repr(n) for n, q, _ in QA)} else 'ok' end as reason, count(*) as records from t group by 1")
def qa_reasons(spark: SparkSession, d: str) -> DataFrame:
    """The first reason to reject each text, counted."""
    x = F.col("x")
    reason = F.coalesce(*[F.when(f(x), F.lit(n)) for n, _, f in QA], F.lit("ok"))
    return texts(spark, d).groupBy(reason.alias("reason")).agg(F.count("*").alias("records"))


@CORE.add(
    "smell_report",
    f"with {TEXT} " + " union all ".join(f"select '{n}' as smell, count(*) as records, min(id) as example from t where regexp_matches(x, '{p}') having count(*) > 0" for n, p in T.SMELLS.items()),
)
def smell_report(spark: SparkSession, d: str) -> DataFrame:
    """One scan: every fault of a text, exploded and counted with its least example."""
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in T.smells(F.col("x")).items()]))
    rows = texts(spark, d).where("x is not null").select("id", F.explode(found).alias("smell"))
    return rows.groupBy("smell").agg(F.count("*").alias("records"), F.min("id").alias("example"))


@CORE.add(
    "dictionary_gate",
    f"""with {TEXT}, w as ({WORDS_SQL}), c as (select word, count(distinct id) as n from w where length(word) >= 4 group by word having count(distinct id) >= 3)
        select id, count(*) as unknown from (select distinct id, word from w where length(word) >= 4 and word not in (select word from c)) group by id""",
)
def dictionary_gate(spark: SparkSession, d: str) -> DataFrame:
    """Texts with words that fewer than three records use, and how many: an anti-join with the vocabulary."""
    w = texts(spark, d).select("id", F.explode(F.split(F.trim(F.regexp_replace(F.lower("x"), "[^a-z]+", " ")), " ")).alias("word"))
    w = w.where(F.length("word") >= 4).distinct()
    known = w.groupBy("word").count().where(F.col("count") >= 3).select("word")
    return w.join(known, "word", "left_anti").groupBy("id").agg(F.count("*").alias("unknown"))
