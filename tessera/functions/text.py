"""Text as tokens, sentences and counts, with built-in functions; analysers and encoders are pluggable."""



from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.vocab import FAMILIES, FAMILY_KEYWORDS


def words(c: Column) -> Column:
    """Tokens between Unicode blanks; none for NULL and empty texts."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda x: x != "")


def plain_id(c: Column) -> Column:
    """An id without differences of case, blanks and separators; NULL for fillers, which hold no digit but 0."""
    t = F.upper(F.regexp_replace(c.cast("string"), r"[^\p{L}\p{N}]+", ""))
    return F.when(t.rlike("[1-9]"), t)


def tokens(c: Column) -> Column:
    """Runs of digits, Latin and Hangul letters in lower case."""
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("([0-9A-Za-z가-힣]+)")), lambda x: F.lower(x))


def sentences(c: Column) -> Column:
    """Sentences by end marks followed by blanks, trimmed."""
    parts = F.split(F.coalesce(c, F.lit("")), r"(?<=[.!?。？！])\s+")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def occurrences(text: Column, word: str) -> Column:
    """How often ``word`` occurs, without overlap."""
    return ((F.char_length(text) - F.char_length(F.replace(text, F.lit(word)))) / len(word)).cast("int")


def slug(c: Column) -> Column:
    return F.translate(c, " /", "__")


def shortened(c: Column, most: int) -> Column:
    """The text, or its first characters and an ellipsis."""
    return F.when(F.char_length(c) > most, F.concat(F.substring(c, 1, most), F.lit("…"))).otherwise(c)


def collapsed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def filled(template: Column, values: dict[str, Column]) -> Column:
    """A template with its ``{{NAME}}`` markers replaced."""
    for k, v in values.items():
        template = F.replace(template, F.lit("{{" + k + "}}"), F.coalesce(v.cast("string"), F.lit("")))
    return template


def has_sequence(toks: Column, keyword: tuple[str, ...]) -> Column:
    """Does the sequence occur in the tokens, contiguous and whole?"""
    if len(keyword) == 1:
        return F.array_contains(toks, keyword[0])
    n = len(keyword)
    want = F.array(*map(F.lit, keyword))
    return F.when(F.size(toks) >= n, F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(toks) - n + 1)), lambda i: F.slice(toks, i, n) == want)).otherwise(F.lit(False))


def spaced(c: Column) -> Column:
    """The :func:`tokens` as one text, with blanks between and around them."""
    return F.lower(F.concat(F.lit(" "), F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9A-Za-z가-힣]+", " "), F.lit(" ")))


def named_families(text: Column, keywords: dict[str, tuple] = FAMILY_KEYWORDS) -> Column:
    """The families that a :func:`spaced` text names, in the fixed order.

    As a function of one bound value, so that the text is made once, not for each keyword.
    """

    def named(t: Column) -> Column:
        hits = []
        for f in FAMILIES:
            any_ = F.lit(False)
            for k in keywords.get(f, ()):
                any_ = any_ | F.contains(t, F.lit(f" {' '.join(k)} "))
            hits.append(F.when(any_, F.lit(f)))
        return F.array_compact(F.array(*hits))

    return F.transform(F.array(text), named)[0]


def families(toks: Column, keywords: dict[str, tuple] = FAMILY_KEYWORDS) -> Column:
    """The families that the tokens name, in the fixed order."""
    return named_families(F.concat(F.lit(" "), F.array_join(toks, " "), F.lit(" ")), keywords)


def analyser_udf(make: Callable[[], Callable[[str], list[tuple[str, str]]]]):
    """A column function of (form, tag) tokens from an analyser that is made once by worker."""

    @F.pandas_udf("array<struct<form:string,tag:string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        analyse = make()
        for s in batches:
            yield s.map(lambda t: [{"form": f, "tag": g} for f, g in analyse(t)] if t else [])

    return run


def encoder(make: Callable[[], Callable[[list[str]], list[list[float]]]]):
    """A function for ``mapInPandas`` that adds the embeddings of ``sentence``, batch by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make()
        for b in batches:
            yield b.assign(embedding=encode(b["sentence"].tolist()))

    return run
