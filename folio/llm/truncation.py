"""Texts cut off by a field limit or a broken transfer.

The corpus vocabulary becomes a trie, kept as a relation of its nodes (each proper prefix of a known word), so it
grows and is joined like any table. The last word of a text is looked up in it: a word that never stands inside a text
but is a proper prefix of known words is the stump of one. Beside it count how the text ends once quotes, signatures,
datelines and omission marks are taken off, how often its last two words end sentences in the corpus, and whether the
text has exactly the length at which its archive's texts pile up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.chars import print_form
from folio.session import cut_lineage

#: A word is known if it stands inside texts at least this often.
KNOWN = 2
#: Last two words of a remark that ends in dots: so many records, and this share of all their occurrences.
REMARK_RECORDS, REMARK_SHARE = 3, 0.7
#: Two words that stand inside texts this often and hardly ever end a sentence do not end one.
OFTEN, HARDLY = 60, 0.004
#: A length is its archive's limit if this many and this share of its texts have it and hardly any are longer.
LIMIT_TEXTS, LIMIT_SHARE, LONGER_SHARE = 5, 0.05, 0.02

_WORD = re.compile(r"[^\W_]+(?:['’\-][^\W_]+)*")
_OMISSION = re.compile(r"\s*[\[(]\s*(?:…|\.{3}|\. \. \.)\s*[\])]\s*$")
_CLOSERS = "”\"»’' \t\n "
_SIGNATURE = re.compile(r"\s+[—–-]\s*[^\W\d_][^\n.!?;:,—–“”\"]{1,60}$")
_MONTHS = (
    "january february march april may june july august september october november december "
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre"
).split()  # fixed values
_DATELINE = re.compile(
    rf"(?:^|(?<=[.!?…”\"»])|(?<=\]))\s*(?:Given|Done|Written|Donné|Donnée|Fait|Écrit)\s+(?:at|in|à|au|en)\s+[^.!?\n]{{2,60}}?,?\s+(?:le\s+|the\s+)?"
    rf"\d{{1,2}}(?:st|nd|rd|th|er|e)?\s+(?:of\s+)?(?:{'|'.join(_MONTHS)}),?\s+\d{{4}}\.?$",
    re.I,
)
_DOTS = re.compile(r"(?:…|\.\s?\.\s?\.|\.\.)$")


def words_of(text: str) -> list[str]:
    return ["#" if w[0].isdigit() else w.lower() for w in _WORD.findall(text)]


def bare_end(text: str) -> tuple[str, bool]:
    """(text without what was put behind it, whether a signature was taken off)."""
    t, signed = text.rstrip(_CLOSERS), False
    while True:
        cut = _OMISSION.sub("", t).rstrip(_CLOSERS)
        cut = _DATELINE.sub("", cut).rstrip(_CLOSERS)
        if not signed and (m := _SIGNATURE.search(cut)) and all(w[0].isupper() or w in ("de", "of", "the", "le", "la") for w in m[0].split() if w[0].isalpha()):
            cut, signed = cut[: m.start()].rstrip(_CLOSERS), True
        if cut == t:
            return t, signed
        t = cut


def ending(text: str) -> tuple[str, str | None, str | None]:
    """(mark, word before last, last word) of a text: mark is ``stop``, ``dots`` or ``none``."""
    t, _ = bare_end(text)
    mark = "dots" if _DOTS.search(t) else "stop" if t[-1:] in (".", "!", "?") else "none"
    w = words_of(t[-160:])
    return mark, (w[-2] if len(w) > 1 else None), (w[-1] if w else None)


def _endings(df: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ends = [ending(print_form(t)) for t in b["text"]]
            out = b[["source", "rec_key"]].copy()
            out["n_chars"] = b["text"].str.len().astype("int64")
            for i, c in enumerate(("mark", "before", "last")):
                out[c] = [e[i] for e in ends]
            yield out

    return df.mapInPandas(run, "source string, rec_key string, n_chars long, mark string, before string, last string")


def _pair_counts(df: DataFrame) -> DataFrame:
    """(before, last, inside, ends, dots): how often two words follow one another inside a text, end a sentence there,
    or end a text in dots; pre-aggregated in each task."""

    def flush(counts: dict) -> pd.DataFrame:
        rows = [(a, b, *n) for (a, b), n in counts.items()]
        return pd.DataFrame(rows, columns=["before", "last", "inside", "ends", "dots"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict = {}
        for batch in batches:
            for t in batch["text"]:
                body, _ = bare_end(print_form(t))
                sentences = [words_of(s) for s in re.split(r"[.!?…]+[”\"»’]?(?:\s+|$)", body)]
                closed = body[-1:] in (".", "!", "?", "…")
                sentences = [s for s in sentences if s]
                for k, s in enumerate(sentences):
                    final = k == len(sentences) - 1
                    before = ""
                    for i, w in enumerate(s):
                        n = counts.get((before, w))
                        if n is None:
                            n = counts[(before, w)] = [0, 0, 0]
                        if i < len(s) - 1:
                            n[0] += 1
                        elif not final:
                            n[0] += 1
                            n[1] += 1
                        elif closed and _DOTS.search(body):
                            n[2] += 1
                        before = w
            if len(counts) > 300_000:
                yield flush(counts)
                counts = {}
        yield flush(counts)

    schema = "before string, last string, inside long, ends long, dots long"
    sums = [F.sum(c).alias(c) for c in ("inside", "ends", "dots")]
    return df.select("text").mapInPandas(run, schema).groupBy("before", "last").agg(*sums)


def trie_nodes(words: DataFrame) -> DataFrame:
    """(node, words): each proper prefix of the words and the number of words below it."""
    prefixes = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", F.lit(1), i))
    long = words.where(F.length("word") > 1)
    return long.select(F.explode(prefixes).alias("node")).groupBy("node").agg(F.count("*").alias("words"))


def field_limits(ends: DataFrame) -> DataFrame:
    """(source, n_chars): the length at which the texts of a source pile up and which hardly any exceeds."""
    lengths = ends.groupBy("source", "n_chars").agg(F.count("*").alias("n"))
    of = Window.partitionBy("source")
    longer = of.orderBy(F.desc("n_chars")).rowsBetween(Window.unboundedPreceding, -1)
    share = lengths.withColumn("all", F.sum("n").over(of)).withColumn("longer", F.coalesce(F.sum("n").over(longer), F.lit(0)))
    hit = (F.col("n") >= LIMIT_TEXTS) & (F.col("n") >= LIMIT_SHARE * F.col("all")) & (F.col("longer") <= LONGER_SHARE * F.col("all"))
    return share.where(hit).select("source", "n_chars", F.lit(True).alias("at_limit"))


def assess_endings(df: DataFrame, key: str, text: str, source: Column) -> DataFrame:
    """(source, rec_key, n_chars, cut, reason): every distinct non-blank text of a record and whether it is cut.

    ``reason`` is stump, unfinished, dots or no_end; null for a finished text. Null and blank texts and rows with a
    null key are left out; rows repeated with key and text count once, and a null source is a source of its own.
    Empty tables give an empty result; other columns are not read.
    """
    slim = (
        df.select(source.alias("source"), F.col(key).cast("string").alias("rec_key"), F.col(text).alias("text"))
        .where(F.col("rec_key").isNotNull() & F.col("text").rlike(r"[\p{L}\p{N}]"))
        .distinct()
    )
    # both are read several times below and are small beside the texts
    ends = cut_lineage(_endings(slim))
    pairs = cut_lineage(_pair_counts(slim))
    known = pairs.groupBy(F.col("last").alias("word")).agg(F.sum("inside").alias("inside"), F.sum("ends").alias("word_ends"))
    nodes = trie_nodes(known.where(F.col("inside") >= KNOWN).select("word"))
    limits = field_limits(ends)
    j = (
        ends.join(known.withColumnRenamed("word", "last"), "last", "left")
        .join(nodes.withColumnRenamed("node", "last"), "last", "left")
        .join(pairs.select("before", "last", F.col("inside").alias("pair_inside"), "ends", "dots"), ["before", "last"], "left")
        .join(limits, ["source", "n_chars"], "left")
    )
    stump = (F.coalesce("inside", F.lit(0)) < KNOWN) & (F.col("words") > 0)
    remark = (F.col("dots") >= REMARK_RECORDS) & (F.col("dots") >= REMARK_SHARE * (F.col("dots") + F.col("pair_inside") - F.col("ends")))
    rare_end = (F.col("pair_inside") >= OFTEN) & (F.col("ends") < HARDLY * F.col("pair_inside"))
    never = (F.col("inside") >= 10 * OFTEN) & (F.col("word_ends") < 0.1 * HARDLY * F.col("inside"))
    at_limit = F.coalesce("at_limit", F.lit(False))
    reason = (
        F.when((F.col("mark") == "dots") & F.coalesce(remark, F.lit(False)), F.lit(None))
        .when(F.col("mark") == "none", F.when(stump, "stump").otherwise("no_end"))
        .when(F.col("mark") == "dots", F.when(stump, "stump").otherwise("dots"))
        .when(stump & (F.length("last") > 1) & F.coalesce(F.col("words") > 0, F.lit(False)), "stump")
        .when(rare_end | never | (at_limit & (F.col("pair_inside") >= OFTEN / 6) & (F.col("ends") == 0)), "unfinished")
    )
    return j.select("source", "rec_key", "n_chars", at_limit.alias("at_limit"), "mark", "before", "last", reason.alias("reason")).withColumn(
        "cut", F.col("reason").isNotNull()
    )


def cut_rates(assessed: DataFrame) -> DataFrame:
    """(source, records, cut, rate, field_limit): how often each source truncates, and its limit if it has one."""
    one = assessed.groupBy("source", "rec_key").agg(F.max("cut").alias("cut"), F.max(F.when(F.col("at_limit"), F.col("n_chars"))).alias("limit"))
    return (
        one.groupBy("source")
        .agg(F.count("*").alias("records"), F.sum(F.col("cut").cast("long")).alias("cut"), F.max("limit").alias("field_limit"))
        .withColumn("rate", F.round(F.col("cut") / F.col("records"), 6))
    )
