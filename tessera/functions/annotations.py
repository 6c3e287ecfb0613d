"""Annotation records as JSON text: validation, repair, and what they hold."""

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.vocab import EVIDENCE_TAGS, NULL_REASONS, PURPOSES, TRAITS

TEXT_MOST, RATIONALE_MOST = 120, 240


def variant(c: Column) -> Column:
    return F.try_parse_json(c)


def _at(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _type(v: Column, path: str) -> Column:
    """OBJECT, ARRAY, BIGINT, BOOLEAN, ... at the path; VOID for null, NULL where nothing is."""
    s = F.schema_of_variant(_at(v, path, "variant"))
    return F.regexp_extract(s, r"^([A-Z]+)", 1)


def _is(v: Column, path: str, *kinds: str) -> Column:
    return F.coalesce(_type(v, path).isin(list(kinds)), F.lit(False))


def _head(v: Column, part: str) -> list[Column]:
    return [
        F.when(v.isNull() | ~_is(v, "$", "OBJECT"), F.lit("not a JSON object")),
        F.when(_type(v, "$.essay_id").isNull(), F.lit("missing essay_id")),
        F.when(~F.coalesce(_at(v, "$.purpose", "string").isin(list(PURPOSES)), F.lit(False)), F.lit("bad purpose")),
        F.when(~_is(v, f"$.{part}", "OBJECT"), F.lit(f"{part} must be an object")),
    ]


def _every(v: Column, path: str, test) -> Column:
    """Do all entries of the array pass?"""
    return F.coalesce(F.forall(_at(v, path, "array<variant>"), test), F.lit(False))


def _index(x: Column) -> Column:
    """Is a variant a whole number from 0?"""
    return (F.regexp_extract(F.schema_of_variant(x), r"^([A-Z]+)", 1) == "BIGINT") & (F.try_variant_get(x, "$", "bigint") >= 0)


def _below(n: Column):
    return lambda x: x < n


def score_violation(v: Column, evidence_sizes: dict[str, Column] | None = None) -> Column:
    """The first violation of a scoring record, or NULL where it is valid.

    A score is a whole number from 1 to 5 without a reason, or null with one; true is no number.
    """
    checks = _head(v, "scores")
    for t in TRAITS:
        p = f"$.scores.{t}"
        score = _type(v, f"{p}.score")
        null = score.isNull() | (score == "VOID")
        reason = _at(v, f"{p}.reason", "string")
        conf = _at(v, f"{p}.confidence", "double")
        checks += [
            F.when(_type(v, p).isNull(), f"scores missing trait {t}"),
            F.when(~_is(v, p, "OBJECT"), f"scores.{t} must be an object"),
            F.when(null & ~F.coalesce(reason.isin(list(NULL_REASONS)), F.lit(False)), f"scores.{t}: null score requires a reason"),
            F.when(~null & (score != "BIGINT"), f"scores.{t}.score must be a whole number"),
            F.when(~null & ~_at(v, f"{p}.score", "bigint").between(1, 5), f"scores.{t}.score out of range"),
            F.when(~null & reason.isNotNull(), f"scores.{t}: a score requires no reason"),
            F.when(~_is(v, f"{p}.confidence", "BIGINT", "DOUBLE", "DECIMAL"), f"scores.{t}.confidence must be a number"),
            F.when(~conf.between(0.0, 1.0), f"scores.{t}.confidence out of range"),
            F.when(~_is(v, f"{p}.span_refs", "ARRAY"), f"scores.{t}.span_refs must be a list"),
            F.when(~_every(v, f"{p}.span_refs", _index), f"scores.{t}.span_refs must be indices"),
        ]
        if evidence_sizes:
            checks.append(F.when(~F.coalesce(F.forall(_at(v, f"{p}.span_refs", "array<bigint>"), _below(evidence_sizes[t])), F.lit(True)), f"scores.{t}.span_refs out of bounds"))
    return F.coalesce(*checks, F.lit(None).cast("string"))


def evidence_violation(v: Column) -> Column:
    """The first violation of an evidence record, or NULL where it is valid."""
    checks = _head(v, "evidence")
    kind = lambda x, p: F.regexp_extract(F.schema_of_variant(F.try_variant_get(x, p, "variant")), r"^([A-Z]+)", 1)

    def good(x):
        span = F.try_variant_get(x, "$.span", "array<bigint>")
        spans = F.try_variant_get(x, "$.span", "array<variant>")
        ints = F.forall(spans, lambda y: F.regexp_extract(F.schema_of_variant(y), r"^([A-Z]+)", 1) == "BIGINT")
        return (F.size(spans) == 2) & ints & (F.get(span, 0) < F.get(span, 1))

    for t in TRAITS:
        p = f"$.evidence.{t}"
        text = lambda x: F.try_variant_get(x, "$.text", "string")
        checks += [
            F.when(_type(v, p).isNull(), f"evidence missing trait {t}"),
            F.when(~_is(v, p, "ARRAY"), f"evidence.{t} must be a list"),
            F.when(~_every(v, p, good), f"evidence.{t}: span must be [start < end]"),
            F.when(~_every(v, p, lambda x: (kind(x, "$.text") == "STRING") & (text(x) != "")), f"evidence.{t}: text must be a text"),
            F.when(~_every(v, p, lambda x: F.char_length(text(x)) <= TEXT_MOST), f"evidence.{t}: text too long"),
            F.when(~_every(v, p, lambda x: F.try_variant_get(x, "$.tag", "string").isin(list(EVIDENCE_TAGS))), f"evidence.{t}: tag unknown"),
        ]
    return F.coalesce(*checks, F.lit(None).cast("string"))


def rationale_violation(v: Column, scores: Column | None = None) -> Column:
    """The first violation of a rationale record, or NULL; with the record of scores, a score must be cited."""
    checks = _head(v, "rationale")
    for t in TRAITS:
        p = f"$.rationale.{t}"
        text = _at(v, f"{p}.text", "string")
        checks += [
            F.when(_type(v, p).isNull(), f"rationale missing trait {t}"),
            F.when(~_is(v, p, "OBJECT"), f"rationale.{t} must be an object"),
            F.when(~_is(v, f"{p}.text", "STRING") | (F.trim(text) == ""), f"rationale.{t}.text must be a text"),
            F.when(F.char_length(text) > RATIONALE_MOST, f"rationale.{t}.text too long"),
            F.when(~_is(v, f"{p}.cited_spans", "ARRAY"), f"rationale.{t}.cited_spans must be a list"),
            F.when(~_every(v, f"{p}.cited_spans", _index), f"rationale.{t}.cited_spans must be indices"),
        ]
        if scores is not None:
            checks.append(F.when(_is(scores, f"$.scores.{t}.score", "BIGINT") & (F.size(_at(v, f"{p}.cited_spans", "array<bigint>")) == 0), f"rationale.{t}: a score requires a cited span"))
    return F.coalesce(*checks, F.lit(None).cast("string"))


def long_scores(df: DataFrame, keys: list[str], record: str) -> DataFrame:
    """Scoring records in long form: keys, trait, score, confidence, reason, is_na.

    Texts that are no JSON, and scores that aren't objects or numbers, give no score.
    """
    schema = "map<string, struct<score: int, confidence: double, reason: string>>"
    m = F.try_variant_get(variant(F.col(record)), "$.scores", schema)
    e = df.select(*keys, F.explode(m).alias("trait", "e"))
    return e.select(*keys, "trait", "e.score", "e.confidence", "e.reason", F.col("e.score").isNull().alias("is_na"))


def unfenced(c: Column) -> Column:
    """A text without the Markdown fence around it."""
    t = F.trim(c, F.lit(" \t\r\n"))
    inner = F.regexp_replace(F.regexp_replace(t, r"^```[^\n]*\n?", ""), r"\n?[ \t]*```[^\n]*$", "")
    return F.when(t.startswith("```"), F.trim(inner, F.lit(" \t\r\n"))).otherwise(t)


_OPEN = re.compile(r'"text"\s*:\s*"')
_CLOSE = re.compile(r'"\s*,\s*"tag"\s*:')


def escaped_quotes(text: str | None) -> str | None:
    """Raw quotes within ``"text"`` values escaped; a value ends at the quote before its tag."""
    if not text:
        return text
    out, at = [], 0
    for m in _OPEN.finditer(text):
        if m.start() < at:
            continue  # the words stand within a value
        out.append(text[at : m.end()])
        at = m.end()
        ends = _CLOSE.search(text, at)
        end = ends.start() if ends else len(text)
        out.append(re.sub(r'(\\.)|"', lambda q: q[1] or '\\"', text[at:end], flags=re.S))
        at = end
    return "".join(out) + text[at:]


_SKIP = re.compile(r"[\s　\xa0.,!?]")


def excerpt_span(text: str | None, excerpt: str | None) -> tuple[int, int] | None:
    """Where an excerpt stands in a text, if need be with blanks and marks left aside."""
    if not text or not excerpt:
        return None
    at = text.find(excerpt)
    if at >= 0:
        return at, at + len(excerpt)
    kept = [i for i, c in enumerate(text) if not _SKIP.match(c)]
    want = _SKIP.sub("", excerpt)
    at = "".join(text[i] for i in kept).find(want) if want else -1
    return (kept[at], kept[at + len(want) - 1] + 1) if at >= 0 else None


def escape_quotes(text: Column) -> Column:
    """:func:`escaped_quotes` of a column, by Arrow batch."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(escaped_quotes)

    return run(text)


def find_excerpt(text: Column, excerpt: Column) -> Column:
    """[start, end] of :func:`excerpt_span`, by Arrow batch."""

    @F.pandas_udf("array<int>")
    def run(t: pd.Series, e: pd.Series) -> pd.Series:
        return pd.Series([list(x) if (x := excerpt_span(a, b)) else None for a, b in zip(t, e)])

    return run(text, excerpt)


def repaired_span(text: Column, start: Column, end: Column, found: Column) -> Column:
    """[start, end] of an excerpt: where it was found, else its own within the text, else NULL.

    At most as long as an excerpt may be.
    """
    n = F.char_length(text)
    s = F.coalesce(F.get(found, 0), F.when((start >= 0) & (start < n), start))
    e = F.when(found.isNotNull(), F.get(found, 1)).otherwise(F.least(F.greatest(end, start + 1), n))
    e = F.least(e, s + TEXT_MOST, n)
    return F.when(e > s, F.array(s.cast("int"), e.cast("int")))


def pruned_refs(refs: Column, n_evidence: Column, has_score: Column) -> Column:
    """References that point to evidence; a score without any gets the first, where there is one."""
    kept = F.filter(refs, lambda r: (r >= 0) & (r < n_evidence))
    return F.when(has_score & (F.size(kept) == 0) & (n_evidence > 0), F.array(F.lit(0))).otherwise(kept)
