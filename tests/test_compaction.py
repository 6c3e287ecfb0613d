from __future__ import annotations

import datetime as dt
import json

import pytest

from tessera.plans.raw_files import compacted, records_in
from tessera.sources import compaction

T = dt.datetime(2024, 1, 1)


def record(q, a, text="t"):
    return {"essay_question": {"id": q}, "essay_answer": {"id": a, "text": text}}


def files(spark, rows):
    return spark.createDataFrame(rows, "file_id long, received_at timestamp_ntz, content string, bucket string")


def test_records_in():
    a, b = json.dumps(record("Q", 1)), json.dumps(record("Q", 2))
    assert records_in(None) == records_in(" \n") == records_in("ok") == records_in("[]") == records_in('{"manifest": 1}') == []
    assert len(records_in("﻿" + a)) == 1
    assert len(records_in(f"[{a},{b},3]")) == 2
    assert len(records_in(f"{a}\n{b}\n{a[:20]}")) == 2
    assert records_in(a[:30]) == []


def test_latest_complete_copy_stays(spark, tmp_path):
    rows = [
        (1, T, json.dumps(record("q-1 ", "0007")), "x"),
        (3, T + dt.timedelta(1), json.dumps(record("Q-1", 7, "new")), "x"),
        (4, T + dt.timedelta(1), json.dumps(record("Q-1", 7)), "x"),
        (5, T + dt.timedelta(2), json.dumps(record("Q-1", 7))[:-1], "x"),
        (6, T, json.dumps(record(None, 7)), "x"),
        (7, T, json.dumps(record("Q-1", "no")), "x"),
        (8, None, None, "x"),
    ]
    path = f"file://{tmp_path}/t"
    v = compacted(spark, files(spark, rows).repartition(3), path)
    got = spark.read.parquet(path).select("prompt_id", "essay_id", "file_id").collect()
    assert [tuple(r) for r in got] == [("Q-1", 7, 4)]
    assert v.number == 2 and sum(map(len, v.files.values())) == 1


def test_no_files(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    compacted(spark, files(spark, []), path)
    assert compaction.current(spark, path).files == {}


def table(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    df = spark.createDataFrame([(i % 2, i, i % 5, "x") for i in range(20)], "p int, k long, at int, v string")
    compaction.append(df.repartition(5), path, "p")
    return path


def test_only_crowded_partitions_are_rewritten(spark, tmp_path):
    path = table(spark, tmp_path)
    v1 = compaction.compact(spark, path, "p", ["k"], ["at"])
    compaction.append(spark.createDataFrame([(0, i, 9, "y") for i in range(6)], "p int, k long, at int, v string").repartition(3), path, "p")
    v2 = compaction.compact(spark, path, "p", ["k"], ["at"])
    assert v2.files["p=1"] == v1.files["p=1"] and v2.files["p=0"] != v1.files["p=0"]
    assert len(v2.files["p=0"]) == 1
    got = {(r.p, r.k): r.v for r in spark.read.parquet(path).collect()}
    assert len(got) == 23 and got[0, 0] == "y" and got[1, 1] == "x"
    assert compaction.compact(spark, path, "p", ["k"], ["at"]) == v2


def test_the_count_of_small_files_decides(spark, tmp_path):
    schema = "p int, k long, at int, v string"
    path = f"file://{tmp_path}/t"
    for i in range(4):  # p=0 gets four small files, p=1 and p=2 one each; in p=2 a key is repeated
        rows = [(0, i, 0, "x")] + ([(1, 7, 0, "x"), (2, 8, 0, "x"), (2, 8, 1, "y")] if i == 0 else [])
        v = compaction.append(spark.createDataFrame(rows, schema).coalesce(1), path, "p")
    assert compaction.crowded(v, 1 << 20, 3) == ["p=0"] and compaction.crowded(v, 1 << 20, 4) == []
    assert compaction.repeating(spark, path, v, ["p=1", "p=2"], "p", ["k"]) == ["p=2"]
    w = compaction.compact(spark, path, "p", ["k"], ["at"], max_small=3)
    assert w.files["p=1"] == v.files["p=1"] and len(w.files["p=0"]) == len(w.files["p=2"]) == 1 and w.clean == ("p=0", "p=1", "p=2")
    assert sorted(tuple(r) for r in compaction.read(spark, path).select("p", "k", "v").collect()) == [(0, 0, "x"), (0, 1, "x"), (0, 2, "x"), (0, 3, "x"), (1, 7, "x"), (2, 8, "y")]
    assert compaction.compact(spark, path, "p", ["k"], ["at"], max_small=3) == w


@pytest.mark.parametrize("step", ["read", "_staged", "commit", "_delete"])
def test_a_writer_between_any_two_steps_loses_nothing(spark, tmp_path, monkeypatch, step):
    path = table(spark, tmp_path)
    real = getattr(compaction, step)
    late = spark.createDataFrame([(0, 99, 1, "z"), (1, 98, 1, "z")], "p int, k long, at int, v string")

    def then(*args, **kw):
        monkeypatch.setattr(compaction, step, real)
        compaction.append(late, path, "p")
        return real(*args, **kw)

    monkeypatch.setattr(compaction, step, then)
    compaction.compact(spark, path, "p", ["k"], ["at"])
    assert sorted(r.k for r in compaction.read(spark, path).collect()) == [*range(20), 98, 99]
    compaction.compact(spark, path, "p", ["k"], ["at"])
    v = compaction.current(spark, path)
    assert sorted(r.k for r in compaction.read(spark, path).collect()) == [*range(20), 98, 99] and all(len(f) == 1 for f in v.files.values())


def test_conflicts_are_refused(spark, tmp_path):
    path = table(spark, tmp_path)
    spark.createDataFrame([(0, 99, 1, "z")], "p int, k long, at int, v string").write.mode("append").partitionBy("p").parquet(path)
    with pytest.raises(compaction.ConflictError):
        compaction.compact(spark, path, "p", ["k"], ["at"])
    assert spark.read.parquet(path).count() == 21
    before = compaction.current(spark, path)
    compaction.commit(spark, path, before)
    with pytest.raises(compaction.ConflictError):
        compaction.commit(spark, path, before)


@pytest.mark.parametrize("committed", [True, False])
def test_files_appended_during_the_rewrite_stay(spark, tmp_path, monkeypatch, committed):
    path, listing = table(spark, tmp_path), compaction.listing
    late = spark.createDataFrame([(0, 99, 1, "z")], "p int, k long, at int, v string")

    def then_append(spark, at):
        found = listing(spark, at)
        if at == path:
            monkeypatch.setattr(compaction, "listing", listing)
            if committed:
                compaction.append(late, path, "p")
            else:
                late.write.mode("append").partitionBy("p").parquet(path)
        return found

    monkeypatch.setattr(compaction, "listing", then_append)
    v = compaction.compact(spark, path, "p", ["k"], ["at"])
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == [*range(20), 99]
    assert compaction.read(spark, path).count() == 20 + committed
    assert v.number == 2 + committed and v.clean == (("p=1",) if committed else ("p=0", "p=1"))


def test_a_rewrite_of_replaced_files_is_given_up(spark, tmp_path, monkeypatch):
    path, commit = table(spark, tmp_path), compaction.commit

    def other_first(*args, **kw):
        monkeypatch.setattr(compaction, "commit", commit)
        v = compaction.current(spark, path)
        commit(spark, path, v, files={"p=0": v.files["p=0"]})
        return commit(*args, **kw)

    monkeypatch.setattr(compaction, "commit", other_first)
    before = compaction.listing(spark, path)
    with pytest.raises(compaction.ConflictError):
        compaction.compact(spark, path, "p", ["k"], ["at"])
    assert compaction.listing(spark, path) == before
