"""Texts that a field limit or a transfer cut short (problem 6).

The corpus's own sentences tell which words end one and which go on.  All its words, after the word
before them, make up a vocabulary trie, kept as a sorted table, in which the words below a node are
one stretch.  A text without an end is cut where its last word is an unknown proper prefix of known
words or one that never ends a sentence; the lengths at which a source's texts pile up shift that
weight, and decide alone where the trie knows nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm.sentences import ABBREVIATIONS, keyed_texts, units
from tessera.session import cut

BLANKS = " \t\r\n\x0b\x0c\x85             ​‌‍    ⁠　﻿"
#: How many code points make the last word of a script without blanks, and the fallback.
GRAM, SHORT_GRAM = 5, 2
#: A limit is a length at which so many open texts of a source lie, so many times as many as around
#: it, and which make up such a share of all its texts of that length.
PILE, PILE_TIMES, PILE_AROUND, PILE_SHARE = 4, 4, 25, 0.6

#: Words that a terse whole remark has at most, which is all of its text.
TERSE = 4

# What systems leave where they cut a text.
LEFT = re.compile(r"\s*[(\[（【]?\s*(?:계속|이하\s*생략|중략|생략|더\s*보기|read more|more|continued|cont(?:['’]d|\.)?|truncated|cut off|待续|未完|续|続く|つづく|続きを読む)\s*[)\]）】]?\s*(?:\.{3}|…)?$", re.I)
_ELLIPSIS = re.compile(r"(?:\.{2,}|[…‥]+)[\"'”’)\]」』]*$")
_END = re.compile(r"[.!?。！？｡।॥؟]+[\"'”’»)\]}）」』】》〉]*$")
_SPACELESS = re.compile(r"[぀-ヿ㐀-鿿豈-﫿ｦ-ﾟ฀-๿]$")
_HANGUL = re.compile(r"[가-힣]")
_LABEL = re.compile(r"\(?(?:\d{1,3}|[가나다라마바사아자차카타파하]|[ivx]{1,4})[.)]|[①-⑳㉠-㉻•·▪◦*-]")
_ABBREVIATION = re.compile(rf"(?<![A-Za-z.])(?:{'|'.join(map(re.escape, ABBREVIATIONS))})\.$")
_CHAR = re.compile(r"[^\W_]")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
#: Characters that a mark of a break takes at most, besides the run of dots and blanks around it.
TAIL = 64
_MARKS = BLANKS + ".!?…‥。！？｡।॥؟\"'”’»)]}）」』】》〉"
_PAIRS = ("“”", "「」", "『』", "（）", "()", "【】", "《》", "‘’")


@lru_cache(100_000)
def word(token: str) -> str:
    """A token without marks at its edges; digits count as one.  Remembered, as words recur."""
    return re.sub(r"\d+", "0", _EDGE.sub("", token)).lower()


def grams(unit: str) -> str:
    return re.sub(r"\d+", "0", re.sub(r"[\s\W_]+$", "", unit))


def at_end(pattern: re.Pattern, text: str) -> int:
    """Where the match begins that ends the text, or -1."""
    skip = max(0, len(text.rstrip(_MARKS)) - TAIL)
    m = pattern.search(text[skip:])
    return m.start() + skip if m else -1


def open_pair(unit: str) -> bool:
    """Does speech or a bracket that begins in the unit not end in it?"""
    for a, b in _PAIRS[:7]:
        if unit.count(a) > unit.count(b) - (len(re.findall(r"(?:^|\s)\(?\w{1,3}\)", unit)) if b == ")" and unit.count(")") > unit.count("(") else 0):
            return True
    return unit.count('"') % 2 == 1


def ending(text: str, parts: list[tuple[int, int]] | None = None) -> tuple[str, str, str, int, int]:
    """(state, word before, last word, length, bytes) of how a text ends.

    ``whole`` and ``cut`` are certain from the text alone; ``ask`` leaves it to the corpus.  Length
    and bytes don't count a mark left at the break.  ``parts`` are the text's sentences, where they
    are known already.
    """
    t = text.rstrip(BLANKS)
    if not _CHAR.search(t):
        return "whole", "", "", 0, 0
    core = t.rstrip("�")
    if core != t:
        return "cut", "", "", len(core), len(core.encode())
    marked = False
    m = at_end(LEFT, core)
    if m > 0 and (core[m:].strip()[0] in "([（【" or core.endswith(("...", "…"))):
        core, marked = core[:m].rstrip(), True
        if at_end(_END, core) < 0:
            return "cut", "", "", len(core), len(core.encode("utf-8", "surrogatepass"))
    m = at_end(_ELLIPSIS, core)
    if m > 0:
        core, marked = core[:m].rstrip(), True
    size = len(core), len(core.encode("utf-8", "surrogatepass"))
    if not marked and re.search(r"\w[-–—]$", core[-2:]):
        return "cut", "", "", size[0] - 1, size[1] - 1
    if parts is None or core != t:
        parts = units(core)
    if not parts:
        return "whole", "", "", *size
    unit = core[parts[-1][0] : parts[-1][1]]
    if open_pair(unit) or _LABEL.fullmatch(unit) or _ABBREVIATION.search(unit[-16:]):
        return "cut", "", "", *size
    hangul = bool(_HANGUL.search(unit))
    if hangul and re.search(r"\d\.$", unit[-2:]):
        return "cut", "", "", *size
    if at_end(_END, unit) >= 0:
        spoken = unit[-1] in "\"”’」』" and unit[0] not in "\"“‘「『"
        if spoken and (hangul or unit[-1] in "」』"):
            return "cut", "", "", *size
        return "whole", "", "", *size
    if _SPACELESS.search(unit.rstrip("%0123456789")) and not hangul:
        g = grams(unit)
        return "ask", "\x02", g[-GRAM:], *size
    tokens = unit.split()
    before = word(tokens[-2]) if len(tokens) > 1 else "\x01"
    return "ask", before, word(tokens[-1]), *size


def counted(t: str, parts: list[tuple[int, int]], into: Counter) -> None:
    """Add to ``into`` how often each word of the sentences, after the word before it, goes on or ends one."""
    for x, (s, e) in enumerate(parts):
        unit = t[s:e]
        last = x == len(parts) - 1 and at_end(_END, unit) < 0
        if _SPACELESS.search(re.sub(r"[\s\W_0-9]+$", "", unit)) and not _HANGUL.search(unit):
            g = grams(unit)
            for n in (GRAM, SHORT_GRAM):
                for y in range(len(g) - n):
                    into["\x02", g[y : y + n], False] += 1
                if not last:
                    into["\x02", g[-n:], True] += 1
            continue
        before = "\x01"
        tokens = unit.split()
        for y, token in enumerate(tokens):
            w = word(token)
            final = y == len(tokens) - 1
            if w and not (final and last):
                into[before, w, final] += 1
            before = w


def scanned(texts: DataFrame) -> DataFrame:
    """One pass over field, essay_id, trait, text, source: a row by text and counts by word.

    Counts are summed within a batch before they are shuffled.
    """
    fields = [("field", pa.string()), ("essay_id", pa.int64()), ("trait", pa.string()), ("source", pa.string()), ("state", pa.string()), ("before", pa.string()), ("word", pa.string()), ("n_chars", pa.int32()), ("n_bytes", pa.int32()), ("same", pa.int64()), ("terse", pa.bool_()), ("ends", pa.int64()), ("goes", pa.int64())]
    schema = pa.schema(fields)

    def run(batches):
        for b in batches:
            counts: Counter = Counter()
            rows = []
            for field, key, trait, text, source in zip(*(b.column(x).to_pylist() for x in range(5))):
                t = text.rstrip(BLANKS)
                parts = units(t)
                state, before, w, n, size = ending(t, parts)
                rows.append((field, key, trait, source, state, before, w, n, size, hash_of(text), len(parts) == 1 and len(t.split()) <= TERSE, None, None))
                counted(t, parts, counts)
            for (before, w), (ends, goes) in paired(counts).items():
                rows.append((None, None, None, None, None, before, w, None, None, None, None, ends, goes))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    ddl = "field string, essay_id bigint, trait string, source string, state string, before string, word string, n_chars int, n_bytes int, same bigint, terse boolean, ends bigint, goes bigint"
    return texts.select("field", "essay_id", "trait", "text", "source").mapInArrow(run, ddl)


def hash_of(text: str) -> int:
    """A hash of a text that is the same in every process."""
    import xxhash

    return xxhash.xxh64_intdigest(text.strip(BLANKS).encode("utf-8", "surrogatepass")) - (1 << 63)


def paired(counts: Counter) -> dict[tuple[str, str], list[int]]:
    out: dict[tuple[str, str], list[int]] = {}
    for (before, w, final), n in counts.items():
        out.setdefault((before, w), [0, 0])[not final] += n
    return out


def limits(rows: DataFrame) -> DataFrame:
    """field, source, unit (``n_chars`` or ``n_bytes``) and place of the lengths where open texts of a
    source pile up; bytes go in steps of 4.

    Texts that are the same count once, so that stock phrases make no limit.  Of the two units the
    one in which the source's texts pile up higher stays: the other only shows its shadow.
    """
    is_open = (F.col("state") != "whole").cast("int")
    sizes = F.inline(F.array(F.struct(F.lit("n_chars").alias("unit"), F.col("n_chars").cast("bigint").alias("at")), F.struct(F.lit("n_bytes").alias("unit"), F.floor(F.col("n_bytes") / 4).alias("at"))))
    each = rows.groupBy("field", "source", "same").agg(F.max("n_chars").alias("n_chars"), F.max("n_bytes").alias("n_bytes"), F.max(is_open).alias("open"))
    at = each.select("field", "source", "open", sizes).groupBy("field", "source", "unit", "at").agg(F.sum("open").alias("n"), F.count("*").alias("n_all"))
    w = W.partitionBy("field", "source", "unit").orderBy("at").rangeBetween(-PILE_AROUND, PILE_AROUND)
    around = (F.sum("n").over(w) - F.col("n")) / F.lit(2 * PILE_AROUND)
    piles = at.withColumn("around", around).where((F.col("n") >= PILE) & (F.col("n") >= PILE_SHARE * F.col("n_all")) & (F.col("n") >= PILE_TIMES * F.col("around")))
    top = piles.groupBy("field", "source").agg(F.max_by("unit", F.struct("n", "unit")).alias("unit"))
    return piles.join(top, ["field", "source", "unit"]).select("field", "source", "unit", "at")


def below(nodes: DataFrame, asked: DataFrame, by: list[str]) -> DataFrame:
    """``by``, word and below: how often the words of which each asked one is a proper prefix occur.

    nodes: by, word, n, each word once; asked: by, word, distinct.  In order of their letters these words
    follow the asked one in one stretch, whose sum is a difference of two running sums; words of any
    length cost the same.  Words that begin alike are summed in one task.
    """
    nothing = F.lit(None).cast("string")
    events = nodes.select(*by, F.col("word").alias("at"), F.lit(0).alias("kind"), "n", nothing.alias("word"))
    for end in ("", "\U0010ffff"):
        events = events.unionByName(asked.select(*by, F.concat("word", F.lit(end)).alias("at"), F.lit(1).alias("kind"), F.lit(0).cast("bigint").alias("n"), "word"))
    w = W.partitionBy(*by, F.substring("at", 1, 1)).orderBy("at", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    return events.withColumn("run", F.sum("n").over(w)).where("word IS NOT NULL").groupBy(*by, "word").agg((F.max("run") - F.min("run")).alias("below"))


def evidence(words: DataFrame, asked: DataFrame) -> DataFrame:
    """What the trie tells of each asked last word (before, word): how often it ends a sentence or goes
    on and what is below it, after the word before it and (w_) after any; s_ends and s_goes of its
    short form in scripts without blanks."""
    asked = cut(asked)
    n = (F.col("ends") + F.col("goes")).alias("n")
    spaced = words.where("before <> '\x02'")
    context = spaced.join(asked.select("before").distinct(), "before", "left_semi").select("before", "word", n)
    alone = words.join(asked.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.sum("ends").alias("w_ends"), F.sum("goes").alias("w_goes"))
    any_ = below(spaced.groupBy("word").agg(F.sum(F.col("ends") + F.col("goes")).alias("n")), asked.where("before <> '\x02'").select("word").distinct(), []).withColumnRenamed("below", "w_below")
    shorts = words.where("before = '\x02'").select(F.col("before"), F.col("word").alias("_short"), F.col("ends").alias("s_ends"), F.col("goes").alias("s_goes"))
    out = asked.withColumn("_short", F.when(F.col("before") == "\x02", F.substring("word", -SHORT_GRAM, SHORT_GRAM)))
    out = out.join(words, ["before", "word"], "left").join(below(context, asked, ["before"]), ["before", "word"], "left")
    return out.join(alone, "word", "left").join(any_, "word", "left").join(shorts, ["before", "_short"], "left").drop("_short").na.fill(0)


def truncated(texts: DataFrame, trie: bool = True, lengths: bool = True) -> DataFrame:
    """field, essay_id, trait, source, truncated of every text (not null).

    Texts without any letter or digit are whole.  With no other text to learn from, a text is
    judged by its marks alone.  Without ``trie`` nothing lies below any word, without ``lengths`` no
    source has a limit: both serve to see what the two contribute.
    """
    rows = cut(scanned(texts))
    ends = rows.where("state IS NOT NULL").drop("ends", "goes")
    words = cut(rows.where("state IS NULL").groupBy("before", "word").agg(F.sum("ends").alias("ends"), F.sum("goes").alias("goes")))
    ask = ends.where("state = 'ask'")
    known = evidence(words, ask.select("before", "word").distinct())
    if not trie:
        known = known.withColumn("below", F.lit(0)).withColumn("w_below", F.lit(0))
    # of remarks of few words, how many essays have the same
    same = ask.where("terse").groupBy("same").agg(F.count_distinct("essay_id").alias("n_same")).where("n_same > 1").withColumn("terse", F.lit(True))
    lim = limits(ends).groupBy("field", "source").agg(F.collect_set(F.struct("unit", "at")).alias("piles"))  # at most one place in PILE texts
    a = ask.join(known, ["before", "word"], "left").join(same, ["terse", "same"], "left").join(lim, ["field", "source"], "left")
    at = lambda unit, c: F.array_contains("piles", F.struct(F.lit(unit).alias("unit"), c.cast("bigint").alias("at")))
    limit = F.coalesce(at("n_chars", F.col("n_chars")) | at("n_bytes", F.floor(F.col("n_bytes") / 4)), F.lit(False)) if lengths else F.lit(False)
    spaceless = F.col("before") == "\x02"
    ends_, goes, under = F.col("ends"), F.col("goes"), F.col("below")
    any_ends, any_goes, any_under = F.col("w_ends"), F.col("w_goes"), F.col("w_below")
    seen, near = any_ends + any_goes, ends_ + goes + under
    korean_whole = F.col("word").rlike(r"(?:다|[어아여해워와려져쳐껴봐돼세예네까지]요|죠|습니까|니까)$") & ~F.col("word").rlike("(?:보다|마다|^다)$")
    verdict = (
        F.when(F.col("word") == "", F.lit(False))
        .when(spaceless & (seen > 0), any_goes >= any_ends)
        .when(spaceless, F.col("s_goes") >= F.col("s_ends"))
        # the node after the word before it, then the node after any; at a limit, longer words that
        # it begins tell against an end
        .when((near > 0) & limit, (goes + under) * 3 >= ends_)
        .when(near > 0, ends_ * 10 < goes + under)
        .when((seen > 0) & limit, (any_goes * 3 >= any_ends) | (any_under * 3 >= any_ends))
        .when(seen > 0, any_goes > any_ends)
        # a remark of few words that several essays have is whole, longer text however often isn't
        .when(F.col("terse") & (F.coalesce("n_same", F.lit(1)) >= 3) & ~limit, F.lit(False))
        .when(korean_whole, limit & (any_under > 0))
        .when(any_under > 0, F.lit(True))
        # of a word that no node holds only the length tells anything
        .otherwise(limit)
    )
    keys = ["field", "essay_id", "trait", "source"]
    asked_rows = a.select(*keys, verdict.alias("truncated"))
    return ends.where("state <> 'ask'").select(*keys, (F.col("state") == "cut").alias("truncated")).unionByName(asked_rows)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """field, essay_id, trait of every text that was cut short."""
    return truncated(keyed_texts(spark, sf_dir)).where("truncated").select("field", "essay_id", "trait")


def p6_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By field and source: n_texts, n_truncated and their share."""
    g = truncated(keyed_texts(spark, sf_dir)).groupBy("field", "source").agg(F.count("*").alias("n_texts"), F.sum(F.col("truncated").cast("bigint")).alias("n_truncated"))
    return g.withColumn("rate", F.round(F.col("n_truncated") / F.col("n_texts"), 6))
