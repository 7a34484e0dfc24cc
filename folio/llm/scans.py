"""Noise of scanned pages: words broken over lines, running headers and page numbers, misread characters.

The corpus vocabulary is a trie. A token is looked up by intersecting the trie with a Levenshtein automaton that also
has arcs for what scanners confuse (``rn`` for ``m``), so every word within the bound is retrieved. A token is misread
if a far more frequent word is reached by such arcs alone; the words around it decide between several. Headers are
title lines that recur in several records. Furniture is cut out, broken words are joined, lines reflow to paragraphs.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.chars import print_form
from folio.session import cut_lineage, write_shared

#: A word is in the vocabulary from this count on, however many words there are.
LEAST_COUNT = 3
#: Words of one trie; a larger vocabulary is cut into blocks, and each token is looked up in all of them.
BLOCK_WORDS = 200_000
#: A misread token is at least so many times rarer than the word it stands for.
RARER = 5
#: A title line is a running header if it stands alone in at least this many records.
HEADER_RECORDS = 3
EDIT, MOST = 2, 4

# What stands on the scanned page as read, and the letters printed.
CONFUSIONS = {
    "c": ("e", "é", "è", "ê"), "«": ("a", "o"), "»": ("a",), "0": ("o",), "^": ("t", "g"), "!": ("i", "l"), "5": ("s",), "ii": ("n", "u"),
    "b": ("h",), "1": ("l", "i"), "cl": ("d",), "li": ("h",), "rn": ("m",), "m": ("rn",), "vv": ("w",), "6": ("b", "é", "o"), "£": ("f", "e"),
    "\\'": ("v",), "}'": ("y",), "d": ("ti",), "U": ("ll",), "3": ("e",), "8": ("b", "s"), "|": ("l", "i"), "{": ("f",), "•": ("e",), "h": ("b",),
    "e": ("c",), "tl": ("d",), "iii": ("m",), "ln": ("h",), "nn": ("m",), "9": ("g",), "$": ("s",),
}
_SYMBOL = r"«»^£\\{}|!¦§*~<>•$"
_IN_WORD = re.compile(rf"[^\W\d_](?:[{_SYMBOL}]+'?|[0156])[^\W\d_]", re.U)
_NUMBERED = re.compile(r"\d+(?:st|nd|rd|th|e|er|re|ère|d)?|[\d.,]+", re.I)
_PAGE = re.compile(r"[\[(—–\-\s]*\d{1,4}[\])—–\-\s]*|p(?:age|\.)\s*\d{1,4}\.?")
_ROMAN = re.compile(r"[\[(—–\-\s]*(?=[ivxlc])c{0,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})[\])—–\-\s]*")
_INLINE_PAGE = re.compile(r"\s+(?:\[\d{1,4}\]|[—–-]\s\d{1,4}\s[—–-]|p\.\s\d{1,4})$")
_NUMBER_FIRST, _NUMBER_LAST = re.compile(r"\d{1,4}\s{2,}(\S.*)"), re.compile(r"(\S.*?)\s+\d{1,4}")
_SMALL = {"of", "and", "the", "in", "from", "to", "de", "du", "des", "la", "le", "et", "en", "d"}
_BREAK = re.compile(r"[-¬­]\s?$")
_EDGE = ".,;:?“”\"()[]…‘’—–"
_FOLD = str.maketrans({c: t for t, cs in {"E": "BK£CFG", "I": "1L!|", "O": "0Q", "S": "5"}.items() for c in cs})


def lines_of(text: str) -> list[str]:
    """Lines as printed; a soft hyphen at a line's end is kept as ``¬?`` since print forms drop it."""
    marked = re.sub("­[ \t]?(?=\r?\n)", "", text)
    return [re.sub(r"\s+$", "", x.replace("", "­")) if "" in x else x.rstrip() for x in print_form(marked).split("\n")]


def skeleton(title: str) -> str:
    """A title without its numbers and what scanners confuse in it."""
    return re.sub(r"[^A-Z]", "", re.sub(r"\d", "", title.upper()).translate(_FOLD))


def _title_like(t: str) -> bool:
    w = re.findall(r"[^\W\d_][^\s]*", t)
    return 1 < len(w) <= 8 and t[0].isupper() and all(x[0].isupper() or x.lower().strip(".,") in _SMALL for x in w) and t[-1] not in "!?,;:"


def title_lines(text: str) -> list[tuple[int, str, bool]]:
    """(line, skeleton, alone): titles a line may hold; alone if the line holds nothing else."""
    out = []
    lines = lines_of(text)
    for i, x in enumerate(lines):
        s = x.strip()
        if not s:
            continue
        m = _NUMBER_FIRST.fullmatch(s) or _NUMBER_LAST.fullmatch(s)
        if m and _title_like(m[1]):
            out.append((i, skeleton(m[1]), True))
        elif m and s[-1].isdigit():
            w = m[1].split()
            for k in range(max(1, len(w) - 7), len(w) - 1):
                if w[k][0].isupper() and _title_like(tail := " ".join(w[k:])):
                    out.append((i, skeleton(tail), False))
        elif _title_like(s) and len(s) < 70:
            bare = (i == 0 or not lines[i - 1].strip()) and (i + 1 == len(lines) or not lines[i + 1].strip())
            out.append((i, skeleton(s), bare and len(lines) > 1))
    return [x for x in out if len(x[1]) > 3]


def without_furniture(text: str, headers: frozenset[str]) -> tuple[list[str], bool]:
    """(lines left, whether page numbers or running headers were cut out)."""
    out, cut = [], False
    lines = lines_of(text)
    titles: dict[int, list[str]] = {}
    if headers:
        for i, s, _ in title_lines(text):
            if s in headers:
                titles.setdefault(i, []).append(s)
    for i, x in enumerate(lines):
        s = x.strip()
        if s and len(lines) > 1 and (_PAGE.fullmatch(s) or _ROMAN.fullmatch(s)):
            cut = True
            continue
        if i in titles:
            cut = True
            m = _NUMBER_FIRST.fullmatch(s) or _NUMBER_LAST.fullmatch(s)
            if skeleton(m[1] if m else s) in titles[i]:
                continue
            w = m[1].split()
            k = next(k for k in range(1, len(w)) if skeleton(" ".join(w[k:])) in titles[i])
            x = s = re.match(r"\s*" + r"\s+".join(map(re.escape, w[:k])), x)[0].rstrip()
        elif m := _INLINE_PAGE.search(x):
            cut = True
            x = x[: m.start()]
        out.append(x)
    return out, cut


def joints_and_tokens(lines: list[str]) -> tuple[list[tuple[int, str, str, str]], list[tuple[int, str]]]:
    """(joints, tokens): words broken over lines (line, left, mark, right), and all other tokens by line."""
    joints, tokens = [], []
    skip: set[int] = set()
    full = [i for i, x in enumerate(lines) if x.strip()]
    for a, b in zip(full, full[1:], strict=False):
        left, right = lines[a], lines[b].split()
        if _BREAK.search(left) and (stem := _BREAK.sub("", left).split()) and right and right[0][0].isalpha() and stem[-1][-1:].isalnum():
            joints.append((a, stem[-1], left.rstrip()[-1], right[0]))
            skip.add(b)
    broken = {j[0] for j in joints}
    for i in full:
        w = lines[i].split()
        w = w[1:] if i in skip else w
        w = w[:-1] if i in broken else w
        tokens += [(i, x) for x in w]
    return joints, tokens


def word_key(token: str) -> str:
    """A token as counted: without punctuation around it, lower case but for a capital U inside a word."""
    t = token.strip(_EDGE)
    return re.sub(r"(?<=[a-zà-ÿ])\x00", "U", re.sub(r"(?<=[a-zà-ÿ])U", "\x00", t).lower()) if "U" in t[1:] else t.lower()


class Vocabulary:
    """Words with counts as a trie; looked up through the automaton of edits and confusions."""

    def __init__(self, counts: dict[str, int]) -> None:
        self.counts = counts
        self.root: dict = {}
        for w, n in counts.items():
            if w.replace("'", "").replace("-", "").isalpha():
                node = self.root
                for c in w:
                    node = node.setdefault(c, {})
                node["$"] = n

    def within(self, token: str, most: int = MOST, edits: bool = True) -> dict[str, tuple[int, bool]]:
        """All words whose cost is at most ``most``: word -> (cost, whether confusions alone lead to it)."""
        found: dict[str, tuple[int, bool]] = {}
        seen: dict[tuple[int, int, bool], int] = {}
        stack = [(self.root, 0, 0, True, "")]
        while stack:
            node, i, cost, pure, word = stack.pop()
            state = (id(node), i, pure)
            if seen.get(state, most + 1) <= cost:
                continue
            seen[state] = cost
            if i == len(token) and "$" in node and (word not in found or (not pure, cost) < (not found[word][1], found[word][0])):
                found[word] = (cost, pure)
            if i < len(token) and token[i] in node and token[i] != "$":
                stack.append((node[token[i]], i + 1, cost, pure, word + token[i]))
            if cost < most:
                for width in (1, 2, 3):
                    for meant in CONFUSIONS.get(token[i : i + width], ()) if i + width <= len(token) else ():
                        at = node
                        for c in meant:
                            at = at.get(c)
                            if at is None:
                                break
                        if at is not None:
                            stack.append((at, i + width, cost + 1, pure, word + meant))
            if edits and cost + EDIT <= most:
                if i < len(token):
                    stack.append((node, i + 1, cost + EDIT, False, word))
                for c, at in node.items():
                    if c != "$":
                        stack.append((at, i, cost + EDIT, False, word + c))
                        if i < len(token):
                            stack.append((at, i + 1, cost + EDIT, False, word + c))
        return found

    def known(self, token: str) -> bool:
        return token in self.counts

    def misread(self, token: str, count: int) -> list[tuple[str, float]]:
        """[(word, log weight)] a misread token may stand for; an empty word if it is garbled beyond them."""
        bare = bare_form(token)
        if not may_be_misread(token) or (bare != token and self.counts.get(bare, 0) >= LEAST_COUNT):
            return []
        out = self.confused(token, self.counts.get(token, 0) or count)
        if not out and garbled(token):
            out = self.edited(token) or [("", 0.0)]
        return sorted(out, key=lambda x: (-x[1], x[0]))

    def confused(self, token: str, own: int) -> list[tuple[str, float]]:
        """[(word, log weight)] far more frequent words that confusions alone lead to."""
        found = self.within(token, _limit(token), edits=False)
        return [(w, math.log(self.counts[w]) - 2.5 * c) for w, (c, pure) in found.items() if pure and c and self.counts[w] >= RARER * own and len(w) > 1]

    def edited(self, token: str) -> list[tuple[str, float]]:
        """[(word, log weight)] words that edits and confusions lead to."""
        found = self.within(token, _limit(token) + 1, edits=True)
        return [(w, math.log(self.counts[w]) - 2.5 * c) for w, (c, _) in found.items() if c and len(w) > 2]

    def broken(self, left: str, mark: str, right: str) -> bool:
        return broken_word(left, mark, right, [self.counts.get(k, 0) for k in joint_keys(left, right)])


def _limit(token: str) -> int:
    return min(MOST, 1 + len(token) // 3)


def bare_form(token: str) -> str:
    return token.strip("!'«»*")


def may_be_misread(token: str) -> bool:
    return not _NUMBERED.fullmatch(token) and len(token) > 1 and any(c.isalpha() for c in token)


def garbled(token: str) -> bool:
    """Whether a sign or digit stands inside the token, which no printed word has."""
    return bool(_IN_WORD.search(token)) and not re.match(r"\d", token)


def joint_keys(left: str, right: str) -> tuple[str, str, str, str]:
    """The words that decide about a joint: joined, as a compound, and either half."""
    a, b = word_key(left), word_key(right)
    return a + b, f"{a}-{b}", a, b


def broken_word(left: str, mark: str, right: str, counts: list[int]) -> bool:
    """Whether a word was broken here, and not a compound at its own hyphen or two words at a stray soft hyphen."""
    joined, compound, a, b = counts
    if mark == "¬" or joined > compound:
        return True
    if compound or (right[0].isupper() and not left.isupper()):
        return False
    return not (mark == "­" and a >= LEAST_COUNT and b >= LEAST_COUNT)


def _slim(df: DataFrame, key: str, text: str) -> DataFrame:
    return (
        df.select(F.col(key).cast("string").alias("rec_key"), F.col(text).alias("text"))
        .where(F.col("rec_key").isNotNull() & F.col("text").rlike(r"\S"))
        .distinct()
        .withColumn("row", F.xxhash64("rec_key", "text"))
    )


def _with_headers(rows: DataFrame) -> DataFrame:
    """``rows`` with the skeletons of the running headers found in each text."""

    def titles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(r, s, alone) for r, t in zip(b["row"], b["text"], strict=True) for _, s, alone in title_lines(t)]
            yield pd.DataFrame(out, columns=["row", "skeleton", "alone"])

    found = cut_lineage(rows.select("row", "text").mapInPandas(titles, "row long, skeleton string, alone boolean").distinct())
    headers = found.where("alone").groupBy("skeleton").agg(F.count_distinct("row").alias("n")).where(F.col("n") >= HEADER_RECORDS).select("skeleton")
    own = found.join(headers, "skeleton", "left_semi").groupBy("row").agg(F.collect_set("skeleton").alias("headers"))
    return rows.join(own, "row", "left")


def _pieces(rows: DataFrame) -> DataFrame:
    """(row, kind, a, b, c, n): furniture, joints (left, mark, right) and tokens (token, before, after) of each text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r, t, h in zip(batch["row"], batch["text"], batch["headers"], strict=True):
                lines, cut = without_furniture(t, frozenset(() if h is None else h))
                joints, tokens = joints_and_tokens(lines)
                if cut:
                    out.append((r, "furniture", "", "", "", 1))
                out += [(r, "joint", left, mark, right, 1) for _, left, mark, right in joints]
                keys = [word_key(x) for _, x in tokens]
                counts: dict = {}
                for i, k in enumerate(keys):
                    if k:
                        x = (k, keys[i - 1] if i else "", keys[i + 1] if i + 1 < len(keys) else "")
                        counts[x] = counts.get(x, 0) + 1
                out += [(r, "token", *x, n) for x, n in counts.items()]
                out += [(r, "token", word_key(left + right), "", "", 0) for _, left, _, right in joints]
            yield pd.DataFrame(out, columns=["row", "kind", "a", "b", "c", "n"])

    return rows.select("row", "text", "headers").mapInPandas(run, "row long, kind string, a string, b string, c string, n long")


def _looked_up(tokens: DataFrame, words: DataFrame, blocks: int, edits: bool) -> DataFrame:
    """(a, word, score): the words of all blocks of the vocabulary that tokens (a, n) may stand for.

    A task holds one block's trie at a time; the tokens stream past it, spread over all cores.
    """
    parts = max(1, -(-tokens.sparkSession.sparkContext.defaultParallelism // blocks))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    known = words.select(F.expr(f"cast(pmod(xxhash64(a), {blocks}) as int)").alias("block"), every(parts).alias("part"), F.lit(0).alias("side"), "a", "n")
    asked = tokens.select(every(blocks).alias("block"), F.expr(f"cast(pmod(xxhash64(a), {parts}) as int)").alias("part"), F.lit(1).alias("side"), "a", "n")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, counts, trie = None, {}, None
        for b in batches:
            out = []
            for block, part, side, a, n in zip(*(b[c] for c in ("block", "part", "side", "a", "n")), strict=True):
                if (block, part) != at:
                    at, counts, trie = (block, part), {}, None
                if side == 0:
                    counts[a] = int(n)
                    continue
                trie = trie or Vocabulary(counts)
                out += [(a, w, s) for w, s in (trie.edited(a) if edits else trie.confused(a, int(n)))]
            yield pd.DataFrame(out, columns=["a", "word", "score"])

    both = known.unionByName(asked).repartition(blocks * parts, "block", "part").sortWithinPartitions("block", "part", "side")
    return both.mapInPandas(run, "a string, word string, score double")


def _meant_in_blocks(counts: DataFrame, words: DataFrame, blocks: int) -> DataFrame:
    """(a, word, score) as of ``Vocabulary.misread`` for every token, over a vocabulary too large for one trie."""

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[[may_be_misread(t) for t in b["a"]]]
            bare = [bare_form(t) for t in b["a"]]
            yield b.assign(bare=[x if x != t else None for x, t in zip(bare, b["a"], strict=True)], garbled=[garbled(t) for t in b["a"]])

    tokens = counts.mapInPandas(asked, "a string, n long, bare string, garbled boolean")
    tokens = cut_lineage(tokens.join(words.select(F.col("a").alias("bare")), "bare", "left_anti"))
    confused = cut_lineage(_looked_up(tokens, words, blocks, edits=False))
    rest = tokens.where("garbled").join(confused, "a", "left_anti")
    edited = cut_lineage(_looked_up(rest, words, blocks, edits=True))
    beyond = rest.join(edited, "a", "left_anti").select("a", F.lit("").alias("word"), F.lit(0.0).alias("score"))
    return confused.unionByName(edited).unionByName(beyond)


def _broken_in_blocks(joints: DataFrame, words: DataFrame) -> DataFrame:
    """The ``joints`` (row, a, b, c) at which a word was broken; the words that decide are joined."""
    named = ["joined", "compound", "left", "right"]

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [joint_keys(x, y) for x, y in zip(b["a"], b["c"], strict=True)]
            yield pd.concat([b.reset_index(drop=True), pd.DataFrame(found, columns=named)], axis=1)

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = b[[f"n_{k}" for k in named]].to_numpy()
            yield b.loc[np.array([broken_word(x, m, y, c) for x, m, y, c in zip(b["a"], b["b"], b["c"], n, strict=True)], dtype=bool), ["row", "a", "b", "c"]]

    joints = joints.mapInPandas(keys, "row long, a string, b string, c string, " + ", ".join(f"{k} string" for k in named))
    for k in named:
        joints = joints.join(words.toDF(k, f"n_{k}"), k, "left").fillna(0, [f"n_{k}"])
    return joints.select("row", "a", "b", "c", *[f"n_{k}" for k in named]).mapInPandas(decide, "row long, a string, b string, c string")


def assess(df: DataFrame, key: str, text: str, rank: bool = True, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """(noise, rows): noise (row, kind, token, repair), one row for each thing found; rows (row, rec_key, text, headers).

    ``kind`` is hyphen (token ``left|mark|right``), furniture or misread. Null and blank texts and rows with a null key
    are left out; rows repeated with key and text count once. Empty tables give empty results. A vocabulary of more
    than ``block_words`` words is looked up block by block, with the same result. Without ``rank`` the
    words retrieved for a misread token are not ranked by the words before and after it, and ``repair`` is empty.
    """
    spark = df.sparkSession
    rows = write_shared(_with_headers(_slim(df, key, text)))
    pieces = write_shared(_pieces(rows))
    counts = pieces.where("kind = 'token'").groupBy("a").agg(F.sum("n").alias("n"))
    words = counts.where(F.col("n") >= LEAST_COUNT)
    joints = pieces.where("kind = 'joint'").select("row", "a", "b", "c").distinct()
    held = words.limit(block_words + 1).collect()
    if len(held) > block_words:
        words = cut_lineage(words)
        meant = _meant_in_blocks(counts, words, -(-words.count() // block_words))
        joints = _broken_in_blocks(joints, words)
    else:
        trie = spark.sparkContext.broadcast(Vocabulary({r["a"]: r["n"] for r in held}))

        def misread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            v = trie.value
            for b in batches:
                out = [(t, w, s) for t, n in zip(b["a"], b["n"], strict=True) for w, s in v.misread(t, int(n))]
                yield pd.DataFrame(out, columns=["a", "word", "score"])

        def broken(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            v = trie.value
            for b in batches:
                yield b[np.array([v.broken(x, m, y) for x, m, y in zip(b["a"], b["b"], b["c"], strict=True)], dtype=bool)]

        meant = counts.mapInPandas(misread, "a string, word string, score double")
        joints = joints.mapInPandas(broken, "row long, a string, b string, c string")

    tokens = pieces.where("kind = 'token'")
    if rank:
        pairs = cut_lineage(tokens.groupBy(F.col("b").alias("before"), F.col("a").alias("word")).agg(F.sum("n").alias("pair")))
        options = tokens.select("row", "a", "b", "c").join(meant, "a").withColumnsRenamed({"b": "before", "c": "after"})
        following = pairs.toDF("word", "after", "pair_after")
        around = options.join(pairs, ["before", "word"], "left").join(following, ["word", "after"], "left")
        score = F.col("score") + F.log1p(F.coalesce("pair", F.lit(0))) + F.log1p(F.coalesce("pair_after", F.lit(0)))
        ranked = around.withColumn("score", score)
        reads = ranked.groupBy("row", F.col("a").alias("token")).agg(F.max_by("word", F.struct("score", "word")).alias("repair"))
    else:
        bad = meant.select("a").distinct()
        reads = tokens.select("row", "a").join(bad, "a", "left_semi").select("row", F.col("a").alias("token"), F.lit("").alias("repair"))
    noise = (
        reads.select("row", F.lit("misread").alias("kind"), "token", "repair")
        .unionByName(joints.select("row", F.lit("hyphen").alias("kind"), F.concat_ws("|", "a", "b", "c").alias("token"), F.concat("a", "c").alias("repair")))
        .unionByName(pieces.where("kind = 'furniture'").select("row", "kind", F.lit("").alias("token"), F.lit("").alias("repair")))
    )
    return noise, rows


def kinds(df: DataFrame, key: str, text: str) -> DataFrame:
    """(rec_key, kind): the kinds of noise in each record."""
    noise, rows = assess(df, key, text, rank=False)
    return noise.select("row", "kind").distinct().join(rows.select("row", "rec_key"), "row").select("rec_key", "kind").distinct()


def _like(original: str, repair: str) -> str:
    return repair.upper() if original.isupper() and len(original) > 1 else repair[:1].upper() + repair[1:] if original[:1].isupper() else repair


def repaired(text: str, headers: list[str], repairs: dict[str, str], broken: set[str]) -> str:
    """Continuous paragraphs: furniture cut, broken words joined, misread words replaced, lines reflowed."""
    lines, _ = without_furniture(text, frozenset(headers))

    def fix(token: str) -> str:
        k = word_key(token)
        core = token.strip(_EDGE)
        return token.replace(core, _like(core, repairs[k]), 1) if repairs.get(k) else token

    out: list[str] = []
    glue = False
    for i, x in enumerate(lines):
        if not x.strip():
            before = next((y for y in reversed(lines[:i]) if y.strip()), "")
            if out and not glue and re.search(r"[.!?…]['\"”»]*$", before.rstrip()) and out[-1] != "\n\n":
                out.append("\n\n")
            continue
        w = x.split()
        if glue and out:
            out[-1] += w.pop(0)
            out[-1] = fix(out[-1])
        glue = False
        after = next((y for y in lines[i + 1 :] if y.strip()), "").split()
        if w and after and _BREAK.search(x):
            stem, mark = _BREAK.sub("", w[-1]), w[-1][-1]
            if f"{stem}|{mark}|{after[0]}" in broken:
                w[-1], glue = stem, True
            elif mark == "-":
                glue = True
        out += [fix(t) for t in w[:-1]] + [w[-1] if glue else fix(w[-1])] if w else []
    text = " ".join(out)
    return re.sub(r" ?\n\n ?", "\n\n", text).strip()


def restored(df: DataFrame, key: str, text: str) -> DataFrame:
    """(rec_key, text): every record's text repaired into continuous paragraphs; null and blank texts are left out."""
    noise, rows = assess(df, key, text)
    fixes = noise.where("kind <> 'furniture'").groupBy("row").agg(F.collect_set(F.struct("kind", "token", "repair")).alias("fixes"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t, h, f in zip(b["text"], b["headers"], b["fixes"], strict=True):
                f = [] if f is None else [x if isinstance(x, dict) else x.asDict() for x in f]
                words = {x["token"]: x["repair"] for x in f if x["kind"] == "misread"}
                out.append(repaired(t, [] if h is None else list(h), words, {x["token"] for x in f if x["kind"] == "hyphen"}))
            yield pd.DataFrame({"rec_key": b["rec_key"], "text": out})

    return rows.join(fixes, "row", "left").select("rec_key", "text", "headers", "fixes").mapInPandas(run, "rec_key string, text string").distinct()
