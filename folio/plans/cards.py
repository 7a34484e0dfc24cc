"""What a card shows of a record, and the clean-up and judgement of texts before they are published."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.plans.archive import FOLD_SQL, REC, records
from folio.plans.both import Both, at_most, c, case, columns, points, rounded, select_list
from folio.plans.matching import SHARD, WEL, dispatches, shard
from folio.plans.texts import BODY, GLUE, ROWS, bodies
from folio.functions import text as T
from folio.registry import CORE
from folio.sources.tables import table

# Patterns of the reference's card and clean-up rules.
PROVENANCE = r"(?i)translated for chronicle|english from the|french in the|full text in the|public domain|public-domain"
NOTEISH = r"(?i)trivial ocr|ocr repairs|single characters|running head"
MONTH_NAMES = "January|February|March|April|May|June|July|August|September|October|November|December"
FRENCH_MONTHS = (
    "janvier|fevrier|février|mars|avril|mai|juin|juillet|aout|août|septembre|octobre|novembre|decembre|décembre|vendemiaire|vendémiaire|brumaire|"
    "frimaire|nivose|nivôse|pluviose|pluviôse|ventose|ventôse|germinal|floreal|floréal|prairial|messidor|thermidor|fructidor"
)
FIRST_PERSON = r"(^|[^A-Za-z])(I|we|We|my|My|our|Our|me|us|Us)($|[^A-Za-z])"
SENTENCE = "[^.!?]+[.!?]+[\"”']?|\\S[^.!?]*$"
COMMANDS = "Let|See|Take|Send|Tell|Reply|Be|Write|Make|Give|Order|Inform|Show|Keep|Hold|Put|Set|Disarm|Burn|Shoot|March|Summon|Explain"
VIVID = r"(^|[^A-Za-z])(blood|burn|burnt|die|died|fire|guns|cannon|horses|prisoners|shot|siege|snow|storm|victory|glory|wounded)($|[^A-Za-z])"
BOILERPLATE = r"^[\"“” ]*(The following|This letter|See|Note|Translated)($|[^A-Za-z])"


def _captions() -> Both:
    """The sentences of the context that are not provenance, if they say something that the title does not."""
    kept_col = lambda: F.array_join(
        F.filter(F.transform(F.regexp_extract_all(F.coalesce("context", F.lit("")), F.lit(SENTENCE), F.lit(0)), F.trim), lambda s: ~s.rlike(PROVENANCE)), " "
    )
    kept_sql = f"array_to_string(list_filter(list_transform(regexp_extract_all(coalesce(context, ''), '{SENTENCE.replace(chr(39), chr(39) * 2)}'), lambda s: trim(s)), lambda s: not regexp_matches(s, '{PROVENANCE}')), ' ')"
    kept = Both(lambda: F.trim(kept_col()), f"trim({kept_sql})")
    same = c("sourceTitle").or_("").letters().holds(kept.letters().left(30)) & (kept.letters() != "")
    ended = kept + case((kept.has(r"[.!?]$"), ""), other=".")
    return case((kept.length() < 12, ""), (~kept.has("[A-Za-z]"), ""), (kept.has(NOTEISH), ""), (same, ""), other=ended.capital())


def _headline() -> Both:
    base = c("sourceTitle").or_("A document").sub(r",\s*[0-9]{4}-[0-9]{2}-[0-9]{2}\s*$").sub(rf",\s*({MONTH_NAMES})\s+[0-9]{{4}}\s*$").trim()
    place = c("location").or_("")
    shown = case((place.has(r"[0-9^*•]") | ~place.has(r"^[A-Za-zÀ-Þ]"), ""), other=place)
    ends = Both(lambda: F.lower(base.col).endswith(F.lower(shown.col)), f"ends_with(lower({base.sql}), lower({shown.sql}))")
    return case((shown == "", base + "."), (ends, base + "."), other=base + " — " + shown + ".")


CAPTION, HEADLINE = _captions(), _headline()


@CORE.add("captions", f"with {REC} select id, {CAPTION.sql} as caption from rec")
def captions(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d, "context", "sourceTitle").select("id", CAPTION.col.alias("caption"))


@CORE.add("headlines", f"with {REC}, k as (select id, {CAPTION.sql} as caption, {HEADLINE.sql} as base from rec) select id, coalesce(nullif(caption, ''), base) as headline from k")
def headlines(spark: SparkSession, d: str) -> DataFrame:
    """The caption, or the title without its date and with a readable place."""
    r = records(spark, d, "context", "sourceTitle", "location")
    return r.select("id", F.coalesce(F.nullif(CAPTION.col, F.lit("")), HEADLINE.col).alias("headline"))


NORM_TWEET, NORM_QUOTE = c("tweet").or_("").letters(), c("displayText").or_("").letters()
SHOWN = case(
    (c("tweet").or_("").trim() != "", "tweet"), (c("displayText").or_("").trim() != "", "quote"), (c("context").or_("").trim() != "", "context"), other="headline"
)


@CORE.add("shown_levels", f"with {SHARD} select {SHOWN.sql} as level, count(*) as records, count(*) filter ({(NORM_TWEET == NORM_QUOTE).sql}) as repeats_quote from shard group by 1")
def shown_levels(spark: SparkSession, d: str) -> DataFrame:
    """Which text of a record is shown first, and how often the paraphrase only repeats the quote."""
    repeats = F.when((NORM_TWEET == NORM_QUOTE).col, 1)
    return shard(spark, d).groupBy(SHOWN.col.alias("level")).agg(F.count("*").alias("records"), F.count(repeats).alias("repeats_quote"))


@CORE.add("client_sentences", f"with {REC}, s as (select id, regexp_extract_all(displayText, '{SENTENCE.replace(chr(39), chr(39) * 2)}') as s from rec where displayText is not null) select id, len(s) as sentences, trim(s[1]) as first from s")
def client_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences as the card splits them: up to the end marks and a closing quote, or the rest."""
    s = records(spark, d, "displayText").where("displayText is not null").select("id", F.regexp_extract_all("displayText", F.lit(SENTENCE), F.lit(0)).alias("s"))
    return s.select("id", F.size("s").cast("bigint").alias("sentences"), F.trim(F.get("s", F.lit(0))).alias("first"))


# Rewrites, in the order in which they apply.
PREEN = ((r"\bZth\b", "7th"), (r"\blot/", "1st/"), (r"2o//i", "20th"), (r"\\oth", "10th"), (r"\bJime\b", "June"), (r"\bJattuary\b", "January"))
FURNITURE_LINE = r"(?m)^[ \t]*(?:[0-9]{1,4}|[A-Z][A-Z .,']{5,60}[0-9]{0,4}|p(?:age|\.) ?[0-9]{1,4})[ \t]*$"
BODY_CLEAN = ((FURNITURE_LINE, ""), (r"[ \t]*\n[ \t\n]*", " "), (r"([A-Za-z0-9_])-\s+([A-Za-z0-9_])", "$1$2"), (r"\s+", " "), (r"^[ \"']+|[ \"']+$", ""))
ENGLISH_CLEAN = (
    *((rf"(^|[^A-Za-z]){m}($|[^A-Za-z])", f"$1{m.capitalize()}$2") for m in ("january", "february", "april", "june", "july", "august", "september", "october", "november", "december")),
    (r"\s*\[[^\]]{0,40}\]\s*", " "), (r"\s*\([^)]{0,30}$", ""), (r"\s+", " "), (r"^ | $", ""),
)
CLAUSE_CLEAN = (
    (r"[\r\n\t]+", " "), (r"\.{2,}", "…"), (r"([A-Za-z-]+)\s+-\s*([A-Za-z])", "$1-$2"), (r"([A-Za-z]),[0-9]+\s+([a-zà-þ])", "$1, $2"),
    (r"\([^)]*/[^)]*\)$", ""), (r"[;:, ]+$", ""), (r"\.[0-9]+\s+[A-Z][A-Za-zÀ-Þ ,;'()-]*$", "."),
)
PAGE_CORR = ((r"CORRESPONDANCE DE NAPOL[ÉE]ON[^.]{0,40}\.?\s*[0-9]{0,4}", " "), (r"D[ée]p[ôo]t de la guerre\.?", " "), (r"\s+", " "), (r"^ | $", ""))


def _footnotes(x: Both) -> Both:
    """``word 12 Capital`` is the end of a sentence and a footnote, unless the word is a month."""
    held = x.sub(rf"(^|[^A-Za-zÀ-ÿ])({MONTH_NAMES}|{FRENCH_MONTHS}) +([0-9]{{1,3}}) +([A-ZÀ-Þ])", "$1$2␟$3 $4")
    return held.sub(r"([A-Za-zÀ-Þ]{3,})\s+[0-9]{1,3}\s+([A-ZÀ-Þ])", "$1. $2").sub("␟", " ")


def _trim_english(x: Both, cap: int = 420) -> Both:
    cut = x.left(cap).sub(r"\s[^\s]{0,12}\z").sub(r"\s+\z")
    return case((x.length() <= cap, x), (cut.has(r"(…|\[\.\.\.\])$"), cut), other=cut + " […]")


SHAPES = {
    "preened": c("body").subs(PREEN), "lines_cleaned": c("body").subs(BODY_CLEAN), "english": c("body").subs(ENGLISH_CLEAN),
    "footnotes": _footnotes(c("body")), "trimmed": _trim_english(c("body")), "page_heads": c("body").subs(PAGE_CORR),
}
for _name, _shape in SHAPES.items():

    def _shaped(spark: SparkSession, d: str, shape: Both = _shape) -> DataFrame:
        return bodies(spark, d).select("piece_key", shape.col.alias("text"))

    CORE.add(f"body_{_name}", f"with {BODY} select piece_key, {_shape.sql} as text from b")(_shaped)

CLAUSE = c("displayText").subs(CLAUSE_CLEAN)
CLAUSE_CUT = CLAUSE.left(170).sub(r"[;:,][^;:,]*$").sub(r"[ ,;:—/\\*\"-]+$")
CLAUSE_SHORT = case((CLAUSE.length() <= 170, CLAUSE), (CLAUSE_CUT.length() > 85, CLAUSE_CUT + "…"), other=CLAUSE.left(170).sub(r"\s+[^\s]*$") + "…")


@CORE.add("clauses_trimmed", f"with {REC} select id, {CLAUSE_SHORT.sql} as clause from rec where displayText is not null")
def clauses_trimmed(spark: SparkSession, d: str) -> DataFrame:
    """Texts cut at a clause boundary beyond half of 170 characters, else at a space; debris of notes taken off first."""
    return records(spark, d, "displayText").where("displayText is not null").select("id", CLAUSE_SHORT.col.alias("clause"))


# What a written addressee may consist of.
ADDRESS_TITLES = ("general", "citizen", "citizens", "colonel", "captain", "major", "admiral", "marshal", "minister", "commissary", "prince", "count", "duke", "baron")
TO = c("to").or_("").trim()
PRETTY = TO.sub(r"(?i)^to\s+").sub(r"(?i)^citizen\s+").sub(r"[ .]+$")
FOLDED = Both(lambda: T.fold(TO.col), FOLD_SQL.format(TO.sql))


@CORE.add(
    "addressees_judged",
    f"""with {WEL}, w as (select piece_key, {PRETTY.sql} as pretty, list_filter(string_split(trim(regexp_replace({FOLDED.sql}, '[^a-z]+', ' ', 'g')), ' '), lambda w: length(w) >= 4) as words,
        {TO.length().sql} > 160 or {TO.has('[A-Z]{5,}|[0-9]').sql} as debris from wel)
        select piece_key, case when pretty = '' then null else 'To ' || pretty end as shown, len(words) > 0 and len(list_filter(words, lambda w: w not in ({', '.join(repr(t) for t in ADDRESS_TITLES)}))) > 0 and not debris as ok from w""",
)
def addressees_judged(spark: SparkSession, d: str) -> DataFrame:
    """How an addressee is shown, and whether it names somebody: a word of four letters that is no title, no debris."""
    words = F.filter(F.split(F.trim(F.regexp_replace(FOLDED.col, "[^a-z]+", " ")), " "), lambda w: F.length(w) >= 4)
    debris = (TO.length() > 160).col | TO.has("[A-Z]{5,}|[0-9]").col
    shown = F.when(PRETTY.col != "", F.concat(F.lit("To "), PRETTY.col))
    named = F.exists(words, lambda w: ~w.isin(*ADDRESS_TITLES))
    return dispatches(spark, d).select("piece_key", shown.alias("shown"), (named & ~debris).alias("ok"))


S = c("s")
THIRD = case(
    (S.has(FIRST_PERSON), False), (S.has(r"(?i)(^|[^a-z])(you|your)($|[^a-z])"), False), (S.has(f"^({COMMANDS})($|[^A-Za-z])"), False),
    (S.has(r"^(He|She|It|They)($|[^A-Za-z])"), True), (S.has("Emperor himself|His Majesty himself"), True), other=False,
)
EDITOR = (S.has(r"(^|[^A-Za-z])(Admiral|General|Marshal) [A-Z][a-z]+ (found|speaks|marched)") & ~S.has(FIRST_PERSON)) | S.has("(?i)as above|see above|following letter|preceding|see below|above-mentioned")
DANGLING = S.has(r"(?i)(^|[^a-zà-ÿ])(le|la|les|de|du|des|et|que|qui|à|au|aux|en|dans|par|pour|sur|un|une|ce|se|sa|son|the|of|and|to|a|in|on|for|with|by)[ ,;:…\[\]]*$") | S.has(r"^[a-zà-ÿ]{1,3}[ ,]")
FRENCH_SCORE = rounded(
    points(
        ((S.length() >= 60) & (S.length() <= 220), 2), (S.length() > 320, -1.5), (S.has(r"(?i)(^|[^a-zà-ÿ])(je|j'|nous|moi|mon|ma|mes|notre|nos|vous)($|[^a-zà-ÿ])"), 0.5),
        (S.has(rf"^[\"“” ]*([A-Z][A-Za-z0-9_. -]{{1,40}}?, *)?[0-9]{{1,2}} +({FRENCH_MONTHS})($|[^a-zà-ÿ])"), -10),
        (S.has(r"^[\"“” ]*(BONAPARTE\.?|NAPOLEON\.?|ORDRE\.?|ARRETE\.?|DECISION\.?|DECRET\.?|PROCLAMATION[^a-z]*|CHAPITRE[^a-z]*)[\"“” ]*$"), -10),
        (S.has(r"CORRESPONDANCE|(^|[^A-Z])AN +[IVXL]+ *\([0-9]"), -10), (S.has(r"^[^A-Za-z0-9À-ÿ]*[0-9]+ +[^ ]"), -6),
    )
    .plus(at_most(3, 1.0, S.count(r"[0-9][0-9,.]*")))
    .plus(at_most(3, 1.5, S.count(r"[a-zà-ÿ][A-ZÀ-Þ][a-zà-ÿ]")) * -1.0)
    .plus(at_most(4, 2.0, S.sub(r"[0-9]+(er|re|e|°)([^A-Za-zÀ-ÿ]|$)", "N$2").count(r"[A-Za-z]+[0-9]+[A-Za-z0-9]*|[0-9]+[A-Za-z]{2,}")) * -1.0)
    .plus(at_most(2, 2.0, S.count(r"[\\^]")) * -1.0)
)
FULL_SCORE = rounded(
    points(
        ((S.length() >= 60) & (S.length() <= 220), 2), (S.length() > 320, -1.5), (S.has(r"(?i)(^|[^a-z])(je|j'|nous|moi|i|we|my)($|[^a-z])"), 0.5), (S.has(BOILERPLATE), -4),
        (S.has(r"^[\"“” ]*([A-Z][A-Za-z0-9_. -]{1,40}?, *)?[0-9]{1,2}(st|nd|rd|th)?,? +[A-Z][a-z]+ *,? *1[78][0-9][0-9]\.? *[\"“” ]*$"), -10),
        (S.has(r"^[\"“” ]*(Napoleon\.|DECREE\.?|DECISION\.?|PROCLAMATION[^a-z]*|CHAPTER[^a-z]*|ORDER[^a-z]*) *[\"“” ]*$"), -10),
        (S.has(r"^[\"“” ]*[0-9]+ +(DECISION|DECREE)($|[^A-Za-z])"), -6), (S.has(r"^[\"“” ]*[0-9]+(st|nd|rd|th)($|[^A-Za-z])"), -2), (S.has(r"^[\"'“” ]*\.{2,}"), -2),
    )
    .plus(at_most(3, 1.0, S.count(r"[0-9][0-9,.]*"))).plus(at_most(2, 1.0, S.count(VIVID)))
    .plus(at_most(4, 2.0, S.count(r"[A-Za-z]+[0-9]+[A-Za-z0-9]*|[0-9]+[A-Za-z]+")) * -1.0)
    .plus(at_most(2, 2.0, S.count(r"[\\^]")) * -1.0).plus(at_most(2, 0.4, S.sub("[^A-Za-z]+", "  ").count(r"(^| )[A-Za-z]( |$)")) * -1.0)
)
FRENCH_TEXT = "t as (select distinct id, originalText as x from nap_1794 where id is not null)"


def _french(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nap_1794").where("id is not null").select("id", F.col("originalText").alias("x")).distinct()


def _sentences(df: DataFrame) -> DataFrame:
    rows = df.select("id", F.posexplode(T.glued_sentences(F.col("x"))).alias("n", "s"))
    return rows.select("id", (F.col("n") + 1).cast("long").alias("n"), "s")


JUDGED = dict(third_person=THIRD, editor_voice=EDITOR, dangling=DANGLING, french=FRENCH_SCORE, full=FULL_SCORE)


@CORE.add("french_sentences", f"with {FRENCH_TEXT}, {GLUE}, {ROWS} select id, n, {select_list(**JUDGED)} from rows")
def french_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of the French originals with both scores and the rules that keep one from being quoted."""
    return _sentences(_french(spark, d)).select("id", "n", *columns(**JUDGED))


GOOD = S.length() >= 80
GOOD = GOOD & ~S.has(r"^[^A-Za-z0-9À-ÿ]*[0-9]") & ~S.has(r"CORRESPONDANCE|D[ée]p[ôo]t de la guerre") & ~S.has(r"[\[(] *[….]*$")


@CORE.add(
    "french_excerpts",
    f"""with {FRENCH_TEXT}, {GLUE}, {ROWS}, r as (select id, n, s, {FRENCH_SCORE.sql} as score from rows), b as (select id, max(n) as last, arg_max(n, (score, -n)) as n, max(score) as score from r group by id),
        j as (select b.id, b.score, a.s as best, m.s as side, m.score as side_score, b.n < b.last as after from b join r a on a.id = b.id and a.n = b.n left join r m on m.id = b.id and m.n = case when b.n < b.last then b.n + 1 else b.n - 1 end where b.score >= 1),
        e as (select id, score, case when side_score > 0 and length(best) + 1 + length(side) <= 300 then case when after then best || ' ' || side else side || ' ' || best end else best end as s from j)
        select id, score, left(s, 300) || ' […]' as excerpt, {GOOD.sql} as good from e where length(s) >= 60""",
)
def french_excerpts(spark: SparkSession, d: str) -> DataFrame:
    """The best sentence of each French text with a good neighbour, if it scores 1, and whether it may be quoted."""
    scored = F.transform(T.glued_sentences(F.col("x")), lambda x, i: F.struct((i + 1).alias("n"), x.alias("s")))
    rows = _french(spark, d).select("id", F.explode(scored).alias("r")).select("id", "r.n", "r.s").withColumn("score", FRENCH_SCORE.col)
    whole = rows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "s", "score"))).alias("all"), F.max_by(F.struct("n", "s", "score"), F.struct("score", -F.col("n"))).alias("b"))
    side = F.get("all", F.when(F.col("b.n") < F.size("all"), F.col("b.n")).otherwise(F.col("b.n") - 2))
    j = whole.where("b.score >= 1").select("id", "b", side.alias("side"), (F.col("b.n") < F.size("all")).alias("after"))
    joined = F.when(F.col("after"), F.concat_ws(" ", "b.s", "side.s")).otherwise(F.concat_ws(" ", "side.s", "b.s"))
    wide = F.coalesce((F.col("side.score") > 0) & (F.length(joined) <= 300), F.lit(False))
    e = j.select("id", F.col("b.score").alias("score"), F.when(wide, joined).otherwise(F.col("b.s")).alias("s")).where("length(s) >= 60")
    return e.select("id", "score", F.concat(F.left("s", F.lit(300)), F.lit(" […]")).alias("excerpt"), GOOD.col.alias("good"))
