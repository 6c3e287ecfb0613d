from __future__ import annotations

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.functions import annotations as A
from tessera.functions import nulls, rules, sets, text
from tessera.functions.vocab import FAMILIES, FAMILY_KEYWORDS, TRAITS
from tessera.operators import rank, sample
from tessera.plans import joined
from tessera.plans.features import FAMILY_OF, clean_lexicon, coherence, owners, vector_sums
from tessera.plans.ratings import rubric_key_parts


def one(spark, c, **values):
    kinds = {int: "long", float: "double", bool: "boolean", str: "string", list: "array<string>"}
    schema = ", ".join(f"{k} {kinds[type(v)] if v is not None else 'string'}" for k, v in values.items()) or "z int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(c).first()[0]


# ------------------------------------------------------------ missing values


def test_nan_and_null(spark):
    df = spark.createDataFrame([(float("nan"), 1), (None, 2), (2.0, 3)], "x double, k int")
    assert [r.x for r in nulls.nan_to_null(df).orderBy("k").collect()] == [None, None, 2.0]
    assert one(spark, nulls.ratio(F.lit(1), F.lit(0))) is None
    n = F.lit(None).cast("boolean")
    assert one(spark, nulls.fired(n)) is False and one(spark, nulls.fired(n, True)) is True
    with pytest.raises(ValueError):
        nulls.assert_unique(spark.createDataFrame([(1,), (1,)], "k int"), ["k"])
    assert nulls.not_null(df, ["x"]).count() == 2


# ------------------------------------------------------------ sets and ranks


def test_sets(spark):
    assert one(spark, sets.normalize(F.col("x")), x=" b|a||b|nan") == ["b", "a"]
    assert one(spark, sets.normalize(F.col("x")), x=None) == []
    e, a = F.array().cast("array<string>"), F.array(F.lit("a"), F.lit("b"))
    assert one(spark, sets.jaccard(e, e)) == 0.0 and one(spark, sets.jaccard(e, e, None)) is None
    assert one(spark, sets.jaccard(a, e)) == 0.0 and one(spark, sets.jaccard(a, a)) == 1.0


def test_ranks(spark):
    df = spark.createDataFrame([("g", f, v) for f, v in (("lex", 2.0), ("syn", 2.0), ("meta", 1.0), ("zzz", 2.0))], "g string, f string, v double")
    assert {r.f: r.rank for r in rank.rank_min(df, ["g"], F.col("v")).collect()} == {"lex": 1, "syn": 1, "zzz": 1, "meta": 4}
    got = rank.top_k(df, ["g"], [F.col("v").desc(), sets.family_order(F.col("f")), F.col("f")], "f").first().top
    assert got == ["lex", "syn", "zzz"]
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, None, "c")], "k int, at int, v string")
    assert {r.k: r.v for r in rank.first_by(rows, ["k"], ["at"], last=True).collect()} == {1: "b", 2: "c"}


def test_families_of_columns():
    assert set(FAMILY_OF.values()) == set(FAMILIES) and FAMILY_OF["case_diversity"] == "case_marker" and FAMILY_OF["lex_ttr"] == "lex"
    owners = [k for ks in FAMILY_KEYWORDS.values() for k in ks]
    assert len(owners) == len(set(owners)) == 36 and set(FAMILY_KEYWORDS) == set(FAMILIES)


# ------------------------------------------------------------ text


def test_text(spark):
    assert one(spark, text.words(F.col("x")), x=" a　b\xa0a ") == ["a", "b", "a"]
    assert one(spark, text.words(F.col("x")), x=None) == one(spark, text.tokens(F.col("x")), x="") == []
    assert one(spark, text.sentences(F.col("x")), x="가. 나? 다") == ["가.", "나?", "다"]
    assert one(spark, text.occurrences(F.col("x"), "aa"), x="aaaaa") == 2
    assert one(spark, text.slug(F.col("x")), x="a b/c") == "a_b_c"
    assert one(spark, text.shortened(F.col("x"), 2), x="abc") == "ab…" and one(spark, text.shortened(F.col("x"), 3), x="abc") == "abc"
    assert one(spark, text.collapsed(F.col("x")), x=" a \n b ") == "a b"
    assert one(spark, text.filled(F.lit("{{A}}-{{B}}"), {"A": F.lit(1), "B": F.lit(None).cast("string")})) == "1-"
    toks = F.array(*map(F.lit, ["문장", "구조", "어휘", "수준"]))
    assert one(spark, text.families(toks)) == ["lex", "vocab_grade", "syn"]
    assert one(spark, text.has_sequence(F.array(F.lit("글")), ("글", "길이"))) is False


def test_analyser_and_encoder(spark):
    udf = text.analyser_udf(lambda: lambda t: [(w, "N") for w in t.split()])
    df = spark.createDataFrame([("a b",), (None,)], "x string")
    assert [[(t.form, t.tag) for t in r[0]] for r in df.select(udf("x")).collect()] == [[("a", "N"), ("b", "N")], []]
    enc = text.encoder(lambda: lambda ss: [[float(len(s)), 1.0] for s in ss])
    s = spark.createDataFrame([(1, "ab"), (2, "abc")], "k int, sentence string")
    assert [r.embedding for r in s.mapInPandas(enc, "k int, sentence string, embedding array<double>").orderBy("k").collect()] == [[2.0, 1.0], [3.0, 1.0]]


def test_lexicon(spark):
    raw = spark.createDataFrame([("2등급", " 가 "), ("1학년", "가"), ("6등급", "나"), ("x", "다"), (None, "라"), ("3", "")], "grade string, word string")
    assert [tuple(r) for r in clean_lexicon(raw).collect()] == [("가", 1)]


def test_coherence(spark):
    rows = [(1, 1, [1.0, 0.0]), (1, 2, [0.0, 2.0]), (1, 3, [1.0, 1.0]), (1, 4, [0.0, 0.0]), (2, 1, [1.0, 1.0])]
    got = {r.k: r for r in coherence(spark.createDataFrame(rows, "k int, i int, v array<double>"), "k", "i", "v").collect()}
    s = 0.5**0.5
    assert got[1].coh_adjacent_mean == pytest.approx(s / 3, abs=1e-6) and got[1].coh_adjacent_min == 0
    assert got[1].coh_all_mean == pytest.approx(2 * 2 * s / 12, abs=1e-6)
    assert (got[2].coh_adjacent_mean, got[2].coh_all_mean) == (0, 0)


def test_rubric_key(spark):
    assert one(spark, rubric_key_parts(F.col("x")), x=" B-00A-1B-2G ").asDict() == {"purpose_code": "B", "segment2": "00A", "area": "1B", "detail": "2G"}
    assert one(spark, rubric_key_parts(F.col("x")), x="??") is None


# ------------------------------------------------------------ rules


BASE = {"tau_unstable_any": False, "jaccard_unstable": False, "family_rubric_match": True, "justification_rate": 0.5, "llm_code": "상", "llm_is_na": False, "human_code": "중", "feedback_impure_50": False}
KINDS = "tau_unstable_any boolean, jaccard_unstable boolean, family_rubric_match boolean, justification_rate double, llm_code string, llm_is_na boolean, human_code string, feedback_impure_50 boolean"


@pytest.mark.parametrize(
    ("change", "label", "rank_", "rules_", "compat"),
    [
        ({}, "Aligned", 4, "converge_on_rubric_relevant", None),
        ({"human_code": "하"}, "Indeterminate", 1, "residual_no_decisive_evidence", None),
        ({"tau_unstable_any": True}, "UR", 2, "shap_absent_or_unstable", None),
        ({"justification_rate": 0.1}, "CIV", 3, "rationale_mapping_below_10pct", None),
        ({"justification_rate": 0.0, "jaccard_unstable": True}, "UR", 2, "shap_absent_or_unstable|rationale_mapping_below_10pct|also_civ_triggered", None),
        ({"tau_unstable_any": True, "jaccard_unstable": True, "human_code": "NA"}, "Indeterminate", 1, "both_tau_and_jaccard_unstable|human_na", None),
        ({"llm_code": "NA", "feedback_impure_50": True}, "Indeterminate", 1, "llm_na|feedback_impure_50", None),
        ({"family_rubric_match": None}, "UR", 2, "shap_absent_or_unstable", "Indeterminate"),
        ({"tau_unstable_any": None}, "Aligned", 4, "converge_on_rubric_relevant", "UR"),
        ({"feedback_impure_50": None, "llm_is_na": None}, "Aligned", 4, "converge_on_rubric_relevant", "Indeterminate"),
        ({"justification_rate": None}, "Aligned", 4, "converge_on_rubric_relevant", None),
    ],
)
def test_decision_table(spark, change, label, rank_, rules_, compat):
    df = spark.createDataFrame([tuple((BASE | change).values())], KINDS)
    r = df.withColumns(rules.classify()).first()
    assert (r.label, r.priority_rank, r.triggered_rules) == (label, rank_, rules_)
    assert df.withColumns(rules.classify(True)).first().label == (compat or label)


def test_strict_bool(spark):
    df = spark.createDataFrame([(" TRUE",), ("0",), ("1",)], "x string")
    assert [r[0] for r in df.select(rules.strict_bool(df.x)).collect()] == [True, False, True]
    for bad in ("1.0", "", None, "yes"):
        with pytest.raises(PySparkException):
            spark.createDataFrame([(bad,)], "x string").select(rules.strict_bool(F.col("x"))).collect()


def test_small_rules(spark):
    f = lambda x: F.lit(x).cast("double")
    assert [one(spark, rules.closer(f(a), f(b))) for a, b in ((None, None), (None, 1), (1, None), (0.5, 0.52), (0.6, 0.5), (0.1, 0.5))] == ["tied", "LLM", "SHAP", "tied", "SHAP", "LLM"]
    assert [one(spark, rules.reliability_weight(f(q))) for q in (0.9, 0.35, -1, None)] == [1.0, 0.5, 0.2, 0.2]
    fam = F.array(F.lit("meta"))
    assert one(spark, rules.family_match(F.lit("task_1"), fam)) is True and one(spark, rules.family_match(F.lit("content_1"), fam)) is False
    assert one(spark, rules.negative_cue(F.lit("content_1"), fam)) is True and one(spark, rules.family_match(F.lit("other"), fam)) is None


# ------------------------------------------------------------ annotation records


def scores(**change):
    entry = {"score": 3, "confidence": 0.5, "span_refs": [0], "reason": None}
    return {"essay_id": 1, "purpose": "설명", "scores": {t: dict(entry) for t in TRAITS}} | change


def with_entry(**change):
    r = scores()
    r["scores"]["task_1"] |= change
    return r


@pytest.mark.parametrize(
    ("record", "want"),
    [
        (scores(), None), ("{", "not a JSON object"), ([1], "not a JSON object"), ({"purpose": "설명"}, "missing essay_id"), (scores(purpose="친교"), "bad purpose"), (scores(scores=[]), "scores must be an object"),
        (scores(scores={}), "scores missing trait task_1"), (with_entry(score=None), "scores.task_1: null score requires a reason"), (with_entry(score=None, reason="rubric_ambiguous"), None), (with_entry(score=True), "scores.task_1.score must be a whole number"),
        (with_entry(score=6), "scores.task_1.score out of range"), (with_entry(reason="rubric_ambiguous"), "scores.task_1: a score requires no reason"), (with_entry(confidence=1.2), "scores.task_1.confidence out of range"),
        (with_entry(confidence=True), "scores.task_1.confidence must be a number"), (with_entry(span_refs=3), "scores.task_1.span_refs must be a list"), (with_entry(span_refs=[-1]), "scores.task_1.span_refs must be indices"), (with_entry(span_refs=[]), None),
    ],
)
def test_score_records(spark, record, want):
    t = record if isinstance(record, str) else json.dumps(record)
    assert one(spark, A.score_violation(A.variant(F.col("x"))), x=t) == want


def test_score_bounds(spark):
    sizes = {t: F.lit(1) for t in TRAITS}
    assert one(spark, A.score_violation(A.variant(F.col("x")), sizes), x=json.dumps(with_entry(span_refs=[1]))) == "scores.task_1.span_refs out of bounds"


@pytest.mark.parametrize(
    ("item", "want"),
    [
        ({"span": [0, 2], "text": "ab", "tag": "transition"}, None), ({"span": [2, 2], "text": "ab", "tag": "transition"}, "span must be [start < end]"), ({"span": [0], "text": "a", "tag": "transition"}, "span must be [start < end]"),
        ({"span": [0, 2], "text": "", "tag": "transition"}, "text must be a text"), ({"span": [0, 2], "text": "a" * 121, "tag": "transition"}, "text too long"), ({"span": [0, 2], "text": "a", "tag": "x"}, "tag unknown"),
    ],
)
def test_evidence_records(spark, item, want):
    r = {"essay_id": 1, "purpose": "설득", "evidence": {t: [] for t in TRAITS} | {"task_1": [item]}}
    assert one(spark, A.evidence_violation(A.variant(F.col("x"))), x=json.dumps(r)) == (want and f"evidence.task_1: {want}")


@pytest.mark.parametrize(("entry", "want"), [({"text": "a", "cited_spans": [0]}, None), ({"text": " ", "cited_spans": [0]}, ".text must be a text"), ({"text": "a" * 241, "cited_spans": [0]}, ".text too long"), ({"text": "a", "cited_spans": [1.5]}, ".cited_spans must be indices"), ({"text": "a", "cited_spans": []}, ": a score requires a cited span")])
def test_rationale_records(spark, entry, want):
    r = {"essay_id": 1, "purpose": "설득", "rationale": {t: {"text": "x", "cited_spans": [0]} for t in TRAITS} | {"task_1": entry}}
    got = one(spark, A.rationale_violation(A.variant(F.col("x")), A.variant(F.col("y"))), x=json.dumps(r), y=json.dumps(scores()))
    assert got == (want and f"rationale.task_1{want}")


def test_repairs(spark):
    assert one(spark, A.unfenced(F.col("x")), x=' ```json\n{"a": 1}\n``` ') == '{"a": 1}' and one(spark, A.unfenced(F.col("x")), x=" {} ") == "{}"
    broken = '{"text": "그는 "간다"고 \\"했다", "tag": "x"}'
    assert json.loads(A.escaped_quotes(broken))["text"] == '그는 "간다"고 "했다' and A.escaped_quotes(None) is None
    assert A.excerpt_span("가나 다. 라", "나다라") == (1, 7) and A.excerpt_span("가나", "다") is None and A.excerpt_span("가나", ".") is None
    df = spark.createDataFrame([("가나다라", "다라", 0, 1), ("가나다라", "없", 1, 99), ("가나다라", "없", 9, 12), ("", "가", 0, 1)], "t string, e string, a int, b int")
    got = [r[0] for r in df.select(A.repaired_span(F.col("t"), F.col("a"), F.col("b"), A.find_excerpt(F.col("t"), F.col("e")))).collect()]
    assert got == [[2, 4], [1, 4], None, None]
    refs = F.array(F.lit(0), F.lit(5))
    assert one(spark, A.pruned_refs(refs, F.lit(2), F.lit(True))) == [0]
    assert one(spark, A.pruned_refs(F.array(F.lit(7)), F.lit(2), F.lit(True))) == [0] and one(spark, A.pruned_refs(F.array(F.lit(7)), F.lit(0), F.lit(True))) == []


# ------------------------------------------------------------ samples


def test_samples(spark):
    df = spark.createDataFrame([(i, "ab"[i % 7 == 0], "c") for i in range(500)], "k long, s string, draw string").drop("draw")
    draws = sample.ranked(df, ["s"], "k").collect()
    for s in "ab":
        assert sorted(r.draw for r in draws if r.s == s) == list(range(1, 1 + sum(r.s == s for r in draws)))
    folds = sample.stratified_folds(df, "s", "k").groupBy("s", "fold").count().collect()
    for s in "ab":
        n = [r["count"] for r in folds if r.s == s]
        assert len(n) == 5 and max(n) - min(n) <= 1
    got = sample.stratified_sample(df, "s", "k", 50).collect()
    assert len(got) == 50 == len({r.k for r in got}) and {r.s for r in got} == {"a", "b"}
    small = {r.k for r in sample.fixed_per_stratum(df, "s", "k", 3).collect()}
    assert small < {r.k for r in sample.fixed_per_stratum(df, "s", "k", 9).collect()} and len(small) == 6
    with pytest.raises(ValueError):
        sample.stratified_sample(df, "k", "k", 10)
    groups = sample.group_folds(df, "s")
    assert groups.where("fold <> s").count() == 0 and sample.group_folds(df.where("s = 'a'"), "s").count() == 0
    assert sample.ranked(df.where("k < 0"), ["s"], "k").collect() == []


def test_checked_joins_and_pivots(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string")
    b = spark.createDataFrame([(1, "p"), (3, "q")], "k int, b string")
    assert [tuple(r) for r in nulls.one_to_one(a, b, ["k"]).collect()] == [(1, "x", "p")]
    with pytest.raises(ValueError):
        nulls.one_to_one(a.union(a), b, ["k"])
    long = spark.createDataFrame([(1, 1, 5.0), (1, 2, None), (2, 2, 3.0)], "k int, r int, v double")
    assert sorted(tuple(r) for r in nulls.strict_pivot(long, ["k"], "r", [1, 2], "v", "r").collect()) == [(1, 5.0, None), (2, None, 3.0)]
    with pytest.raises(ValueError):
        nulls.strict_pivot(long.union(long), ["k"], "r", [1, 2], "v")


def test_owners_of_planted_duplicates(spark):
    rows = [("a", "x"), ("a", "y"), ("b", "x"), ("b", "x"), (None, "x"), ("c", None), ("c", "z"), ("d", "z"), ("d", "x"), ("d", "y")]
    got = owners(spark.createDataFrame(rows, "k string, o string"), "k", "o").collect()
    assert sorted((r.k, r.n_owners, r.owners) for r in got) == [("a", 2, "x|y"), ("d", 3, "x|y|z")]
    claims = [(" ".join(k), f) for f, ks in FAMILY_KEYWORDS.items() for k in ks]
    assert owners(spark.createDataFrame(claims, "k string, f string"), "k", "f").count() == 0


def test_rubric_blocks(spark, tmp_path):
    analytic = {"content_1": {"name": "n", "rubric_key": "bad", **{f"evaluation_{i}": f"d{i}" for i in range(1, 6)}}, "task_1": {"name": "m", "rubric_key": "A-X-1A-2B", "evaluation_3": "  "}, "organization_1": {"rubric_key": "B-X-1C-2A", "evaluations": {"2": "x  y", "9": "z"}}}
    record = {"essay_question": {"id": "Q"}, "rubric": {"analytic": analytic}}
    spark.createDataFrame([(1, json.dumps(record)), (2, None)], "record_id long, payload string").write.parquet(f"{tmp_path}/essay_records.parquet")
    got = {r.trait: (r.levels, r.complete, r.area, r.purpose_code) for r in joined.rubric_blocks(spark, str(tmp_path)).collect()}
    assert got == {"content_1": ("1|2|3|4|5", True, None, "A"), "task_1": (None, False, "1A", "A"), "organization_1": ("2", False, "1C", "A")}
    text = joined.rubric_texts(spark, str(tmp_path)).first().rubric
    assert text.index("| **5** | d5 |") < text.index("| **1** | d1 |") and "| **2** | x y |" in text


def test_patches_are_made_in_turn(spark):
    df = spark.createDataFrame([("a  bㆍc...",), (None,)], "t string")
    assert [r[0] for r in df.select(joined.patched(df.t)).collect()] == ["a b·c…", None]


def test_vector_sums(spark):
    rows = [(i % 3 if i else None, [float(i), 1.0]) for i in range(50)]
    got = {r.k: r.total for r in vector_sums(spark.createDataFrame(rows, "k int, v array<double>").where("k IS NOT NULL").repartition(3), "k", "v").collect()}
    assert got == {k: [float(sum(i for i in range(1, 50) if i % 3 == k)), float(sum(1 for i in range(1, 50) if i % 3 == k))] for k in range(3)}
