"""Nested essay records as related tables (problem 1)."""

from __future__ import annotations

import re
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.nested import Anchor, groups, last_key, path_groups, place, rejects, untaken
from tessera.session import table

ANSWER = ("essay_answer", "essay_answer[*]")
PERSONAL = ("score.personal.analytic", "essay_answer.score.personal.analytic", "essay_answer[*].score.personal.analytic")


def _below(places: tuple[str, ...], *rests: str) -> tuple[str, ...]:
    return tuple(p + r for p in places for r in rests)


TRAIT = _below(PERSONAL, ".*", "[*]")
RUBRIC = ("rubric.analytic.*", "rubric.analytic[*]")
LEVELS = tuple(f"evaluation_{i}" for i in range(1, 6))

TO_QUESTION, TO_ANSWER = {"question_id": "question"}, {"question_id": "question", "essay_id": "answer"}
ANCHORS = [
    Anchor("question", ("essay_question",), {"id": "id", "text": "prompt"}, key="id"),
    Anchor("prompt_line", ("essay_question.prompt", "essay_question.prompt[*]"), {"number": "line", "text": "text"}, TO_QUESTION),
    Anchor("answer", ANSWER, {"id": "id"}, TO_QUESTION, key="id"),
    Anchor("feature", _below(ANSWER, ".feature.*", ".feature[*]", ".feature.groups[*].items[*]"), {"name": "tag", "text": "count"}, TO_ANSWER),
    Anchor("trait", TRAIT, {"name": "trait", "rubric_key": "rubric_key"}, TO_ANSWER, key="name"),
    Anchor("rating", _below(TRAIT, ".score[*]"), {"number": "rater", "text": "score"}, TO_ANSWER | {"trait": "trait"}),
    Anchor("feedback", _below(TRAIT, ".feedback", ".feedback[*]"), {"text": "text"}, TO_ANSWER | {"trait": "trait"}),
    Anchor("rubric", RUBRIC, {"name": "trait", "rubric_key": "rubric_key"}, TO_QUESTION, key="name"),
    Anchor("evaluation", _below(RUBRIC, *(f".{x}" for x in LEVELS), ".evaluations.*", ".evaluations[*]"), {"number": "level", "text": "text"}, TO_QUESTION | {"trait": "rubric"}),
]
#: The columns of each flat table besides its keys, as they are called in the records.
EXTRA = {
    "question": ("type", "subject", "topic", "level", "grade", "purpose", "len_syllable", "len_word"),
    "answer": ("region", "gender", "reference", "text", "len_syllable", "len_word"),
    "rubric": ("name",),
}
WIDE = [Anchor(a.name, a.at, a.fields | {f"{a.name}_{c}": c for c in EXTRA.get(a.name, ())}, a.links, a.key) for a in ANCHORS]


def _whole(number: str | None) -> str | None:
    return str(int(number)) if number is not None and re.fullmatch(r"\s*[+-]?\d+\s*", number, re.A) else None


def child(row: dict) -> tuple[str | None, str | None, str | None]:
    """(parent key, child key, text) of an anchor instance; the child key is None where it is no child."""
    node, kind = row["node"], row.get("kind")
    obj = kind == "object"
    text = row.get("value") if kind in ("string", "number", "bool") else row.get("text") if obj else None
    at = place(node)
    number = _whole(row.get("number")) or (str(at) if at else None)
    name = row["name"] if row.get("name") is not None else last_key(node)
    entity, question, essay = row["entity"], row.get("question_id"), row.get("essay_id")
    join = lambda *xs: "/".join(x for x in xs if x is not None)
    if entity == "question":
        return None, row.get("id") if obj else None, text
    if question is None:
        return None, None, None
    if entity == "prompt_line":
        return question, (number or "1") if kind not in (None, "null", "array") else None, text
    if entity == "answer":
        return question, row.get("id") if obj else None, text
    if entity == "feature":
        return essay, name if text is not None else None, text
    if entity == "trait":
        return essay, name if obj else None, text
    if entity == "rating":
        return join(essay, row.get("trait")), number if text is not None else None, text
    if entity == "feedback":
        return join(essay, row.get("trait")), str(at or 1) if text is not None and text.strip() else None, text
    if entity == "rubric":
        return question, name if obj else None, text
    last = last_key(node)
    level = number or (re.search(r"\d*$", last)[0] if last is not None else None)
    return join(question, row.get("trait")), level if text is not None else None, text


def children(rows: list[dict]) -> list[dict]:
    """One record's instances that are children, each key once: of two forms of the same content the first."""
    out: dict[tuple, dict] = {}
    for row in rows:
        parent, key, text = child(row)
        if key is not None:
            out.setdefault((row["entity"], parent, key), row | {"parent_key": parent, "child_key": key, "text": text})
    return list(out.values())


def record_tables(records: DataFrame, key: str = "record_id", payload: str = "payload", presence_only: bool = False, only: str | None = None) -> DataFrame:
    """All tables of the records in one frame: entity, parent_key, child_key, text, rubric_key; of one entity
    also its links and own columns.

    Rows are the children that are present and not null, each once in its record; a row of ``records``
    that is repeated gives them as often.  ``presence_only`` replaces texts by 1 where they hold more
    than blanks.  A null payload, one that is no JSON, and a record without ``essay_question`` object
    give no rows; a child without a key gives none either.
    """
    columns = ["entity", "parent_key", "child_key", "text", "rubric_key"]
    if only is None:
        out = groups(records, key, payload, ANCHORS, children, columns, ("text", "") if presence_only else ())
    else:
        extra = ["question_id", "essay_id", "trait", *(f"{only}_{c}" for c in EXTRA.get(only, ()))]
        out = groups(records, key, payload, WIDE, partial(_of, only), columns + extra)
    question = F.col("entity") == "question"
    return out.withColumn("parent_key", F.when(question, F.col(key).cast("string")).otherwise(F.col("parent_key")))


def _of(entity: str, rows: list[dict]) -> list[dict]:
    return [r for r in children(rows) if r["entity"] == entity]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id, entity, parent_key, child_key of every child in ``essay_records``."""
    out = record_tables(table(spark, sf_dir, "essay_records"), presence_only=True)
    return out.select("record_id", "entity", "parent_key", "child_key")


#: The flat tables: their entity, and by column what it holds (a cast to another type follows a colon).
TABLES = {
    "p1_questions": ("question", {"question_id": "child_key", **{c: f"question_{c}" + (":int" if c.startswith("len") else "") for c in EXTRA["question"]}}),
    "p1_prompt_lines": ("prompt_line", {"question_id": "parent_key", "line_no": "child_key:int", "text": "text"}),
    "p1_answers": ("answer", {"question_id": "parent_key", "essay_id": "child_key", **{c: f"answer_{c}" + (":int" if c.startswith("len") else "") for c in EXTRA["answer"]}}),
    "p1_features": ("feature", {"essay_id": "parent_key", "tag": "child_key", "count": "text:int"}),
    "p1_traits": ("trait", {"essay_id": "parent_key", "trait": "child_key", "rubric_key": "rubric_key"}),
    "p1_ratings": ("rating", {"essay_id": "essay_id", "trait": "trait", "rater_no": "child_key:int", "score": "text:int"}),
    "p1_feedback": ("feedback", {"essay_id": "essay_id", "trait": "trait", "comment_no": "child_key:int", "text": "text"}),
    "p1_rubrics": ("rubric", {"question_id": "parent_key", "trait": "child_key", "name": "rubric_name", "rubric_key": "rubric_key"}),
    "p1_evaluations": ("evaluation", {"question_id": "question_id", "trait": "trait", "level": "child_key:int", "text": "text"}),
}


def flat_table(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of TABLES: record_id, the keys of the parents and the row, its values; what is no number becomes null."""
    entity, columns = TABLES[name]
    out = record_tables(table(spark, sf_dir, "essay_records"), only=entity)
    cast = lambda c: F.expr(f"try_cast({c.split(':')[0]} AS {c.split(':')[1]})") if ":" in c else F.col(c)
    return out.select("record_id", *(cast(c).alias(n) for n, c in columns.items()))


def p1_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths found in ``essay_records`` by repeated ancestor, with the tables that take them."""
    return path_groups(table(spark, sf_dir, "essay_records"), "record_id", "payload", WIDE)


def p1_untaken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id, path, value of all that no flat table takes."""
    return untaken(table(spark, sf_dir, "essay_records"), "record_id", "payload", WIDE)


def p1_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id and error of the records that can't be read."""
    return rejects(table(spark, sf_dir, "essay_records"), "record_id", "payload")


QUERIES = {"p1_found": p1_found, **{n: partial(flat_table, n) for n in TABLES}, "p1_paths": p1_paths, "p1_untaken": p1_untaken, "p1_rejects": p1_rejects}
_Q = "json_extract_string(payload, '$.essay_question.{0}')"
SQL = {
    "p1_questions": "SELECT record_id, "
    + ", ".join(f"{'TRY_CAST(' if c.startswith('len') else ''}{_Q.format(c)}{' AS INT)' if c.startswith('len') else ''} AS {c if c != 'id' else 'question_id'}" for c in ("id", *EXTRA["question"]))
    + f" FROM essay_records WHERE json_valid(payload) AND {_Q.format('id')} IS NOT NULL",
    "p1_answers": """
WITH a AS (SELECT record_id, json_extract_string(payload, '$.essay_question.id') AS question_id, unnest(CASE WHEN json_type(payload, '$.essay_answer') = 'ARRAY' THEN CAST(json_extract(payload, '$.essay_answer[*]') AS VARCHAR[]) ELSE [CAST(json_extract(payload, '$.essay_answer') AS VARCHAR)] END) AS j
  FROM essay_records WHERE json_valid(payload))
SELECT record_id, question_id, json_extract_string(j, '$.id') AS essay_id, """
    + ", ".join(f"{'TRY_CAST(' if c.startswith('len') else ''}json_extract_string(j, '$.{c}'){' AS INT)' if c.startswith('len') else ''} AS {c}" for c in EXTRA["answer"])
    + " FROM a WHERE json_type(j) = 'OBJECT' AND question_id IS NOT NULL AND json_extract_string(j, '$.id') IS NOT NULL",
    "p1_rejects": "SELECT record_id, CASE WHEN payload IS NULL THEN 'null' END AS error FROM essay_records WHERE payload IS NULL OR NOT json_valid(payload)",
}
