"""Dates, hours and eras as Column builders. Impossible dates are null, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Month names and abbreviations, English and French, by number.
MONTHS = {
    1: ("january", "jan", "janvier"), 2: ("february", "feb", "février", "fevrier"), 3: ("march", "mar", "mars"), 4: ("april", "apr", "avril"),
    5: ("may", "mai"), 6: ("june", "jun", "juin"), 7: ("july", "jul", "juillet"), 8: ("august", "aug", "août", "aout"),
    9: ("september", "sept", "sep", "septembre"), 10: ("october", "oct", "octobre"), 11: ("november", "nov", "novembre"), 12: ("december", "dec", "décembre", "decembre"),
}
# Eras as (first year, label), half open to the next.
ERAS = ((1789, "revolution"), (1796, "italy"), (1800, "consulate"), (1805, "empire"), (1812, "fall"), (1815, "island"), (1822, "after"))


def safe_date(c: Column) -> Column:
    """The date of an ISO string, null for an impossible one."""
    return F.try_to_timestamp(F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c), F.lit("yyyy-MM-dd")).cast("date")


def month_number(c: Column) -> Column:
    """1 to 12 of a month as written (number, name or abbreviation, with or without a point), else null."""
    bare = F.regexp_replace(F.lower(F.trim(c)), r"\.$", "")
    named = F.coalesce(*[F.when(bare.isin(*names), F.lit(n)) for n, names in MONTHS.items()])
    number = F.when(bare.rlike(r"^[0-9]{1,2}$"), bare.cast("int"))
    return F.coalesce(named, F.when(number.between(1, 12), number))


def day_number(c: Column) -> Column:
    """1 to 31 of a day as written, with what scanners confuse in digits put right, else null."""
    digits = F.regexp_extract(F.translate(F.trim(c), "OolISs", "001155"), r"^([0-9]{1,2})", 1)
    n = F.when(digits != "", digits.cast("int"))
    return F.when(n.between(1, 31), n)


def iso_date(year: Column, month: Column, day: Column) -> Column:
    """ISO string of written parts; null if a part is missing or the date does not exist."""
    y = F.when(F.trim(year).rlike(r"^[0-9]{4}$"), F.trim(year))
    iso = F.concat(y, F.lit("-"), F.lpad(month_number(month).cast("string"), 2, "0"), F.lit("-"), F.lpad(day_number(day).cast("string"), 2, "0"))
    return F.date_format(safe_date(iso), "yyyy-MM-dd")


def hour_label(hour: Column) -> Column:
    return F.when(hour.between(5, 11), "MORNING").when(hour.between(12, 16), "AFTERNOON").when(hour >= 17, "EVENING").otherwise("TIME UNCERTAIN")


def time_rank(label: Column) -> Column:
    """Order of time labels in a day; an unknown one comes last."""
    return F.when(label == "MORNING", 0).when(label == "AFTERNOON", 1).when(label == "EVENING", 2).otherwise(3)


def era_of(iso: Column) -> Column:
    """The era label of an ISO date string, null before the first era."""
    year = F.substring(iso, 1, 4).cast("int")
    out = F.lit(None).cast("string")
    for first, label in ERAS:
        out = F.when(year >= first, label).otherwise(out)
    return out


def era_table(spark: SparkSession) -> DataFrame:
    """(era, year): each year of each era, for equi-joins in place of range joins."""
    last = [first - 1 for first, _ in ERAS[1:]] + [ERAS[-1][0] + 50]
    rows = [(label, first, end) for (first, label), end in zip(ERAS, last, strict=True)]
    eras = spark.createDataFrame(rows, "era string, first int, last int")
    return eras.select("era", F.explode(F.sequence("first", "last")).alias("year"))
