from __future__ import annotations

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from tessera import cli
from tessera.functions import checks

SF = "/root/testdata/sf0.001"


def col(spark, values, c, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(c).collect()]


def test_drift(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    now = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "k string, t string")
    base = spark.createDataFrame([("a", sha("x")), ("b", sha("x")), ("d", sha("x"))], "k string, sha256 string")
    d = checks.drift(now, base, "k", "t")
    assert {r.k: r.status for r in d.collect()} == {"a": "same", "b": "changed", "c": "new", "d": "gone"}
    with pytest.raises(ValueError):
        checks.assert_no_drift(d)
    checks.assert_no_drift(d.where("k = 'a'"))


def test_formats(spark):
    x = F.col("x")
    assert col(spark, ["attempt2_validator", "attempt12_x", "x", None], checks.attempt_number(x)) == [2, 12, 0, 0]
    assert col(spark, ["a_non_json", "a_validator", "a_api_error", "x"], checks.error_kind(x)) == ["schema", "validator", "api", None]
    assert col(spark, ["{{A_B}}", "{{a}}", None], checks.leftover_markers(x)) == [True, False, False]
    assert col(spark, [None, 1e-65, 0.25], checks.format_p(x), "double") == ["–", "1.00e-65", "0.2500"]
    assert col(spark, [None, 0.25], checks.format_rate(x), "double") == ["–", "0.250"]


def test_unresolved(spark):
    kinds = "e int, s string, p string"
    err = spark.createDataFrame([(1, "a", "x"), (1, "a", None), (2, "a", "x"), (3, "a", "x"), (4, "a", None)], kinds)
    done = spark.createDataFrame([(1, "a", "y"), (2, "a", None), (3, "a", "x")], kinds)
    assert sorted((r.e, r.p) for r in checks.unresolved(err, done, ["e", "s"], "p").collect()) == [(1, "x"), (4, None)]
    todo = spark.createDataFrame([(1,), (2,)], "e int")
    assert checks.refuse_partial(todo, done, ["e"]).count() == 2
    with pytest.raises(ValueError):
        checks.refuse_partial(todo, done.where("e = 1"), ["e"])


def test_morpheme_ttr(spark):
    df = spark.createDataFrame([([("가", "NNG"), ("가", "NNG"), (".", "SF"), ("나", "VV")],), ([(".", "SF")],)], "t array<struct<form:string,tag:string>>")
    c = checks.morpheme_ttr(F.col("t"))
    assert [tuple(r) for r in df.select(c["lex_ttr_morph"], c["lex_types_morph"]).collect()] == [(2 / 3, 2.0), (None, None)]
    assert checks.stamp(df, run="r1").first().run == "r1"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_cli(spark, tmp_path, capsys):
    assert cli.main([]) == 0 and "rater_agreement" in capsys.readouterr().out
    assert cli.main(["nope", "--data", SF]) == 2 and cli.main(["rater_agreement"]) == 2
    assert cli.main(["score_distribution", "--data", SF, "--out", str(tmp_path), "--report"]) == 0
    assert "| task_1 |" in capsys.readouterr().out and spark.read.parquet(str(tmp_path / "score_distribution.parquet")).count() == 8
