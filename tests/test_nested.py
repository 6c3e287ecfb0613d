from __future__ import annotations

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.operators.nested import path_groups, stream
from tessera.plans.essay_records import ANCHORS, QUERIES, TABLES, record_tables

JSON = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=4), x, max_size=3), max_leaves=12)


def rebuilt(events):
    """The document again from its events."""
    root = None
    holders = {}
    for steps, kind, value in events:
        v = {"object": dict, "array": list, "null": lambda: None}.get(kind, lambda: None)()
        if kind == "string":
            v = value
        elif kind in ("number", "bool"):
            v = json.loads(value)
        if steps:
            h = holders[tuple(steps[:-1])]
            if isinstance(h, dict):
                h[steps[-1][1:]] = v
            else:
                assert len(h) == int(steps[-1][1:])
                h.append(v)
        else:
            root = v
        holders[tuple(steps)] = v
    return root


@settings(max_examples=200, deadline=None)
@given(JSON, st.sampled_from([None, 1]))
def test_stream_round_trip(doc, indent):
    assert rebuilt(stream(json.dumps(doc, indent=indent, ensure_ascii=False))) == doc


@pytest.mark.parametrize("bad", ["", "{", '{"a"}', "[1,]", '{"a":1,}', "1 2", "[1", "nul", '{"a" 1}', "]", '"a'])
def test_stream_refuses(bad):
    with pytest.raises(ValueError):
        list(stream(bad))


def test_stream_is_not_bound_by_the_stack():
    assert sum(1 for _ in stream("[" * 20_000 + "]" * 20_000)) == 20_000


RECORD = {
    "essay_question": {"id": "Q1", "prompt": [{"line": 1, "text": "a"}, {"line": 2, "text": "b"}]},
    "essay_answer": [
        {"id": "7", "feature": {"groups": [{"name": "g", "items": [{"tag": "n.o", "count": 1}, {"tag": "x", "count": None}]}]}, "score": {"personal": {"analytic": {"t1": {"score": [3, None], "feedback": ["", "ok"]}, "t2": None}}}},
        {"id": 8, "feature": {"v": 2, "w": None}, "score": {"personal": {"analytic": [{"trait": "t1", "score": [{"rater": 2, "score": 4}], "feedback": " "}]}}},
    ],
    "rubric": {"analytic": {"t1": {"evaluation_2": "x", "evaluation_3": None}, "t2": {"evaluations": {"4": "y"}}}},
}


def rows(spark, payloads, **extra):
    df = spark.createDataFrame([(i, p, "k") for i, p in enumerate(payloads)], "record_id long, payload string, entity string")
    return {(r.record_id, r.entity, r.parent_key, r.child_key) for r in record_tables(df, **extra).collect()}


@pytest.mark.parametrize("presence_only", [False, True])
def test_tables_of_a_record(spark, presence_only):
    got = rows(spark, [json.dumps(RECORD)], presence_only=presence_only)
    assert got == {
        (0, "question", "0", "Q1"), (0, "prompt_line", "Q1", "1"), (0, "prompt_line", "Q1", "2"), (0, "answer", "Q1", "7"), (0, "answer", "Q1", "8"),
        (0, "feature", "7", "n.o"), (0, "feature", "8", "v"), (0, "trait", "7", "t1"), (0, "trait", "8", "t1"), (0, "rating", "7/t1", "1"), (0, "rating", "8/t1", "2"),
        (0, "feedback", "7/t1", "2"), (0, "rubric", "Q1", "t1"), (0, "rubric", "Q1", "t2"), (0, "evaluation", "Q1/t1", "2"), (0, "evaluation", "Q1/t2", "4"),
    }


def test_odd_payloads_give_no_rows(spark):
    assert rows(spark, [None, "", "{", "[]", "null", "3", '{"essay_question": null}']) == set()


def test_no_records(spark):
    assert rows(spark, []) == set()


def test_flat_tables_and_what_they_leave(spark, tmp_path):
    record = RECORD | {"expert": {"career": "9"}}
    payloads = [json.dumps(record), "{", None, json.dumps(record)]
    spark.createDataFrame(list(enumerate(payloads)), "record_id long, payload string").write.parquet(f"{tmp_path}/essay_records.parquet")
    got = {n: [tuple(r) for r in QUERIES[n](spark, str(tmp_path)).where("record_id = 0").collect()] for n in [*TABLES, "p1_untaken"]}
    assert sorted(got["p1_prompt_lines"]) == [(0, "Q1", 1, "a"), (0, "Q1", 2, "b")]
    assert sorted(got["p1_ratings"]) == [(0, "7", "t1", 1, 3), (0, "8", "t1", 2, 4)]
    assert got["p1_feedback"] == [(0, "7", "t1", 2, "ok")]
    assert sorted(got["p1_evaluations"]) == [(0, "Q1", "t1", 2, "x"), (0, "Q1", "t2", 4, "y")]
    assert sorted(got["p1_features"]) == [(0, "7", "n.o", 1), (0, "8", "v", 2)]
    assert got["p1_questions"][0][:2] == (0, "Q1") and sorted(r[2] for r in got["p1_answers"]) == ["7", "8"]
    assert (0, "expert.career", "9") in got["p1_untaken"] and (0, "essay_answer[0].feature.groups[0].name", "g") in got["p1_untaken"]
    assert {(r.record_id, r.error is not None) for r in QUERIES["p1_rejects"](spark, str(tmp_path)).collect()} == {(1, True), (2, True)}


def test_paths_are_grouped_by_repeated_ancestor(spark):
    df = spark.createDataFrame([(1, json.dumps(RECORD)), (2, json.dumps({"new": [{"a": [1, 2]}]})), (3, "{")], "record_id long, payload string")
    got = {(r.ancestor, r.path): (r.entities, r.n_values, r.n_records) for r in path_groups(df, "record_id", "payload", ANCHORS).collect()}
    assert got["new[*].a[*]", "new[*].a[*]"] == (None, 2, 1)
    assert got["essay_answer[*].feature.groups[*].items[*]", "essay_answer[*].feature.groups[*].items[*].tag"] == ("feature", 2, 1)
    assert got["rubric.analytic.*.evaluations.*", "rubric.analytic.*.evaluations.*"] == ("evaluation", 1, 1)
