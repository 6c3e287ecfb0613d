from __future__ import annotations

import json

import pytest

from tessera.functions.vocab import TRAITS
from tessera.sources import readers, writers
from tessera.streaming import ingest


def essay(i, purpose="설명", **change):
    traits = {t: {"rubric_key": "A-00A-1A-2A", "score": [3, 4], "feedback": "좋다"} for t in TRAITS}
    traits |= change.pop("traits", {})
    return {
        "essay_question": {"id": "Q", "grade": "중1", "purpose": purpose},
        "essay_answer": {"id": i, "text": "글", "feature": {"동사": 2}},
        "score": {"personal": {"holistic": {"score": [2, 2]}, "analytic": {k: v for k, v in traits.items() if v}}},
        "rubric": {"purpose": "설명"},
    } | change


@pytest.fixture
def root(tmp_path):
    d = tmp_path / "in" / "deep"
    d.mkdir(parents=True)
    put = lambda n, x: (d / n).write_text(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False, indent=1), encoding="utf-8")
    put("14-2-M1-N-0A-K-1.json", essay(1))
    put("14-2-M1-N-0A-K-2.json", essay(2, "친교 및 정서"))
    put("14-2-M1-N-0A-K-3.json", "{broken")
    put("other.json", essay(4, traits={"task_1": None, "content_1": {"score": [1]}}))
    return str(tmp_path / "in")


def test_essay_files(spark, root):
    ids = lambda **k: sorted(r[0] for r in readers.essay_files(spark, root, **k).select("essay_answer.id").collect())
    assert ids() == [1] and ids(purposes=None) == [1, 2] and ids(names=None) == [1, 4]
    with pytest.raises(Exception, match="MALFORMED|malformed|parse"):
        readers.essay_files(spark, root, strict=True).collect()


def test_long_scores_and_problems(spark, root):
    df = readers.essay_files(spark, root, names=None).where("essay_answer.id = 4")
    rows = {r.trait: r for r in readers.long_scores(df).collect()}
    assert len(rows) == 9 and rows["_holistic"].trait_present is None and rows["_holistic"].score_mean == 2
    assert rows["task_1"].trait_present is False and rows["task_1"].score_rater1 is None
    assert rows["expression_1"].score_mean == 3.5 and rows["expression_1"].exact_agreement is False and rows["content_1"].score_rater2 is None
    assert readers.essay_problems(df).first().problem == "task_1: missing"
    assert readers.essay_problems(df, strict_traits=False).first().problem == "content_1: fewer than two scores"


def test_jsonl_and_optional(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"k": 1}\n\n{bad\n{"k": 2}\n')
    assert sorted(r.k for r in readers.jsonl(spark, str(p), "k int").collect()) == [1, 2]
    gone = str(tmp_path / "gone")
    assert readers.jsonl(spark, gone, "k int").collect() == [] and readers.optional_file(spark, gone + ".csv", "k int").columns == ["k"]
    runs = readers.repeated_runs(spark, [str(p), gone, str(p)], "k int")
    assert sorted({r.run_id for r in runs.collect()}) == [1, 3]


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("NA", 1), (None, 2), ('a,"b"\nc', 3)], "code string, k int")
    for kind in ("csv", "parquet"):
        path = str(tmp_path / f"t.{kind}")
        writers.table_file(df, path)
        assert {r.k: r.code for r in readers.table_file(spark, path, "code string, k int").collect()} == {1: "NA", 2: None, 3: 'a,"b"\nc'}
    with pytest.raises(ValueError):
        writers.table_file(df, str(tmp_path / "t.xlsx"))
    with pytest.raises(KeyError):
        readers.required(df, ["k", "z"])


def test_coder_file(spark, tmp_path):
    p = tmp_path / "c.csv"
    p.write_text("essay_id,trait,family,detected\n1,t,f,TRUE\n2,t,f,0\n")
    assert {r.essay_id: r.detected for r in readers.coder_file(spark, str(p), "detected").collect()} == {1: True, 2: False}


def test_ids(spark):
    df = spark.createDataFrame([(7, "a", 2)], "e long, s string, r int")
    c = readers.call_id(df.e, df.s, df.r)
    assert df.select(c).first()[0] == "e7_a_2" and tuple(df.select(readers.call_parts(c)).first()[0]) == (7, "a", 2)
    bad = spark.createDataFrame([("x",)], "c string")
    assert bad.select(readers.call_parts(bad.c)).first()[0] is None
    names = spark.createDataFrame([("a/feature_matrix__설명__robust_1.parquet",), ("b",)], "p string")
    assert [tuple(r) for r in names.select(*readers.partition_keys(names.p)).collect()] == [("설명", "robust_1"), (None, None)]


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("가|나", 1.5), (None, None)], "a string, b double")
    assert "| 가\\|나 | 1.5000 |" in writers.markdown(df, "T") and "| – | – |" in writers.markdown(df, "T")
    p = tmp_path / "s.csv"
    assert writers.sheet(df, str(p)) == 2 and p.read_bytes().startswith(b"\xef\xbb\xbf")
    with pytest.raises(ValueError):
        writers.sheet(df, str(p), most=1)
    r = tmp_path / "r.md"
    for i in range(2):
        writers.registry_row(str(r), ["a"], [i])
    assert r.read_text().count("---") == 1 and r.read_text().count("\n") == 4


def test_append_once(spark, tmp_path):
    log = str(tmp_path / "log")
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    assert writers.append_once(df, log, ["k"]) == 2 and writers.append_once(df, log, ["k"]) == 0
    assert spark.read.json(log).count() == 2


def test_stream(spark, tmp_path):
    src, log, ck = tmp_path / "src", str(tmp_path / "log"), str(tmp_path / "ck")
    src.mkdir()
    (src / "1.json").write_text('{"k": 1, "v": "a"}\n{"k": 1, "v": "b"}\n{bad\n')
    run = lambda: ingest.ingest_once(spark, str(src), "k int, v string", ["k"], log, ck)
    run()
    (src / "2.json").write_text('{"k": 1, "v": "c"}\n{"k": 2, "v": "d"}\n')
    run()
    run()
    assert sorted(r.k for r in spark.read.json(log).collect()) == [1, 2]
