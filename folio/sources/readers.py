"""Sources: JSON slices, whole texts and lines of texts. Schemas are explicit; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

_TEXT = (
    "id author handle accountType faction date timeLabel timePrecision location originalLanguage displayText sourceTitle archive sourceUrl "
    "documentType evidenceType dateCertainty"
).split()
RECORD = t.StructType(
    [t.StructField(c, t.StringType()) for c in _TEXT]
    + [t.StructField("eventIds", t.ArrayType(t.StringType()))]
    + [t.StructField(c, t.StringType()) for c in ("editorialStatus", "context", "originalText", "voice", "tweet")]
)
REQUIRED = [c for c in _TEXT if c not in ("timePrecision", "documentType")] + ["eventIds", "editorialStatus"]


def json_slices(spark: SparkSession, paths: str | list[str], schema: t.StructType = RECORD) -> DataFrame:
    """Records of JSON array files with the ``slice`` (file name) each came from; a malformed file is an error."""
    df = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(paths)
    return df.withColumn("slice", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))


def raw_slices(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(slice, keys): the keys each object of JSON array files really has, for rules about missing keys."""
    whole = spark.read.text(paths, wholetext=True).withColumn("slice", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    objects = F.explode(F.from_json("value", "array<map<string,string>>"))
    return whole.select("slice", objects.alias("o")).select("slice", F.map_keys("o").alias("keys"), F.col("o")["id"].alias("id"))


def missing_keys(raw: DataFrame, required: list[str] = REQUIRED) -> DataFrame:
    """(slice, id, missing): objects that lack required keys."""
    lacking = F.array_except(F.array(*[F.lit(c) for c in required]), "keys")
    return raw.select("slice", "id", lacking.alias("missing")).where(F.size("missing") > 0)


def whole_texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, text): one row a file; bytes that are not UTF-8 become the replacement character."""
    whole = spark.read.text(paths, wholetext=True)
    return whole.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.make_valid_utf8("value").alias("text"))


def numbered_lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line, before, after): lines with their neighbours, numbered from 1."""
    split = texts.select(key, F.split(text, "\n").alias("l"))
    around = F.transform("l", lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line"), F.get("l", i - 1).alias("before"), F.get("l", i + 1).alias("after")))
    return split.select(key, F.explode(around).alias("s")).select(key, "s.*")


def era_pruned(df: DataFrame, era: Column, wanted: str | list[str]) -> DataFrame:
    """Rows of wanted eras of a table written by era; the filter is on the partition column, so files are pruned."""
    return df.where(era.isin([wanted] if isinstance(wanted, str) else wanted))
