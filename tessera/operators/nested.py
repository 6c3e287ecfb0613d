"""Deeply nested records into related flat tables.

Each JSON text is read as a stream of tokens by an explicit stack, without building the
document, and comes out as path-value-ordinal triples.  Paths are grouped by their nearest
repeated ancestor (the *anchor*), and every group is pivoted into one table whose rows carry
the instance path of the anchor and thereby the link to their parent's row.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRIPLES = "steps array<string>, kind string, value string"
_TOKEN = re.compile(r"[ \t\n\r]*(?:([{}\[\],:\"])|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null))")
_KIND = {"t": "bool", "f": "bool", "n": "null"}


def stream(text: str) -> Iterator[tuple[list[str], str, str | None]]:
    """Yield (steps, kind, value) of every node of one JSON text, parents before children.

    A step is ``.key`` below an object and ``[i`` (i from 0) below an array, so a step's first
    character tells its kind whatever the key holds.  Objects and arrays are nodes with a null
    value.  The depth is bounded by memory only.  Raises ValueError where the text is no JSON.
    """
    at, n, match = 0, len(text), _TOKEN.match
    steps: list[str] = []
    stack: list[list] = []  # [is object, next index, awaiting a value after a comma]
    done = False

    def token(pos: int):
        m = match(text, pos)
        if not m:
            raise ValueError(f"no token at {pos}")
        return m[1] or m[2], m.end()

    def opened(pos: int):
        """Enter the next member of the innermost container; the position of its value."""
        top = stack[-1]
        if top[0]:
            key, pos = scanstring(text, pos, True)
            colon, pos = token(pos)
            if colon != ":":
                raise ValueError(f"no colon at {pos}")
            steps.append("." + key)
        else:
            steps.append(f"[{top[1]}")
            top[1] += 1
        return pos

    while not done:
        tok, end = token(at)
        if tok == '"':
            value, end = scanstring(text, end, True)
            yield steps[:], "string", value
        elif tok in ("{", "["):
            yield steps[:], "object" if tok == "{" else "array", None
            close = "}" if tok == "{" else "]"
            nxt, after = token(end)
            if nxt != close:
                stack.append([tok == "{", 0])
                if tok == "{" and nxt != '"':
                    raise ValueError(f"no key at {after}")
                at = opened(after if tok == "{" else end)
                continue
            end = after
        elif tok in ("}", "]", ",", ":"):
            raise ValueError(f"no value at {end}")
        else:
            kind = _KIND.get(tok[0], "number")
            yield steps[:], kind, None if kind == "null" else tok
        while True:  # a value has ended: close what ends with it
            if not stack:
                if text[end:].strip(" \t\n\r"):
                    raise ValueError(f"more text at {end}")
                done = True
                break
            steps.pop()
            tok, after = token(end)
            if tok == ",":
                if stack[-1][0]:
                    tok, after = token(after)
                    if tok != '"':
                        raise ValueError(f"no key at {after}")
                at = opened(after)
                break
            if tok != ("}" if stack[-1][0] else "]"):
                raise ValueError(f"no end at {after}")
            stack.pop()
            end = after


def triples(df: DataFrame, key: str, payload: str) -> DataFrame:
    """``key``, steps, kind, value of every node in the JSON texts of ``payload``.

    The root has no steps.  A text that is no JSON gives one row of kind ``error`` and nothing
    else; a null text gives no row.  Other columns of ``df`` are left behind, so their names
    don't matter.  A repeated key in an object gives its triples as often as it stands there.
    """
    kept = df.select(F.col(key).alias("_key"), F.col(payload).cast("string").alias("_text")).where("_text IS NOT NULL")
    schema = pa.schema([("_key", pa.int64() if dict(df.dtypes)[key] in ("bigint", "int") else pa.string()), ("steps", pa.list_(pa.string())), ("kind", pa.string()), ("value", pa.string())])

    def run(batches):
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            size = 0
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text.lstrip("﻿")
                mine = []
                try:
                    mine.extend(stream(text))
                except (ValueError, json.JSONDecodeError) as e:
                    mine = [([], "error", str(e))]
                for steps, kind, value in mine:
                    out[0].append(rid)
                    out[1].append(steps)
                    out[2].append(kind)
                    out[3].append(value)
                size += len(text)
                if size > 4_000_000:  # keeps batches small when texts are long
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)
                    out, size = ([], [], [], []), 0
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    kind = "bigint" if schema.field("_key").type == pa.int64() else "string"
    return kept.withColumn("_key", F.col("_key").cast(kind)).mapInArrow(run, f"_key {kind}, {TRIPLES}").withColumnRenamed("_key", key)


@dataclass(frozen=True)
class Anchor:
    """A repeated ancestor: where it stands, which paths below it become columns, and its links.

    ``at`` lists alternative places, as paths like ``essay_answer[*].feature.*`` (``.*`` any key,
    ``[*]`` any position).  ``fields`` maps a column to the path relative to the anchor.  ``links``
    maps a column to another anchor, whose ``key`` it takes over: the instance that holds this one,
    or else the record's first.
    """

    name: str
    at: tuple[str, ...]
    fields: dict[str, str] = field(default_factory=dict)
    links: dict[str, str] = field(default_factory=dict)
    #: The field that identifies an instance; without one, or where it is missing, the key it stands under.
    key: str | None = None


def _steps(path: str) -> tuple[str, ...]:
    return tuple(x if x[0] == "." else "[*" for x in re.findall(r"\.[^.\[]+|\[\*\]", path if path[:1] in ("[", "") else "." + path))


class Groups:
    """The anchors' paths, and to which of them a path belongs."""

    def __init__(self, anchors: list[Anchor], flags: tuple[str, ...] = ()) -> None:
        self.anchors, self.flags = anchors, frozenset(flags)
        self.fields = list(dict.fromkeys(f for a in anchors for f in a.fields))
        self.links = list(dict.fromkeys(n for a in anchors for n in a.links))
        self.places = [(a, _steps(p), {_steps(r): f for f, r in a.fields.items()}) for a in anchors for p in a.at]
        self.known: dict[tuple[str, ...], list[tuple[Anchor, int, str]]] = {}

    def of(self, shape: tuple[str, ...]) -> list[tuple[Anchor, int, str]]:
        """(anchor, depth of its node, field) of each anchor that a path of this shape belongs to."""
        hit = self.known.get(shape)
        if hit is None:
            hit = []
            for a, want, fields in self.places:
                n = len(want)
                if len(shape) >= n and all(s == w or (w == ".*" and s[0] == ".") for s, w in zip(shape, want)):
                    f = "" if len(shape) == n else fields.get(shape[n:])
                    if f is not None:
                        hit.append((a, n, f))
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[shape] = hit
        return hit

    def named(self, shape: tuple[str, ...]) -> tuple[str, str, str | None]:
        """(ancestor, path, entities) of a path of this shape."""
        hits = self.of(shape)
        taken = {(a.name, n) for a, n, _ in hits}
        out, end = list(shape), 0
        for a, want, _ in self.places:
            if (not hits or (a.name, len(want)) in taken) and len(want) <= len(shape) and all(s == w or (w == ".*" and s[0] == ".") for s, w in zip(shape, want)):
                out = [w if w == ".*" else s for s, w in zip(out, want)] + out[len(want) :]
        for x, s in enumerate(out):
            if s in ("[*", ".*"):
                end = x + 1
        return written(out[:end]), written(out), "|".join(sorted({a.name for a, _, _ in hits})) or None

    def flagged(self, f: str, value: str | None) -> str | None:
        return value if value is None or f not in self.flags else "1" if value.strip() else ""

    def pivot(self, triples_: Iterator[tuple[list[str], str, str | None]]) -> list[dict]:
        """The instances of all anchors in one record's triples, as rows with their fields and links.

        Of a path that a repeated key gives twice the last value counts.
        """
        rows: dict[tuple[str, tuple[str, ...]], dict] = {}
        for steps, kind, value in triples_:
            for a, n, f in self.of(tuple(s if s[0] == "." else "[*" for s in steps)):
                node = tuple(steps[:n])
                row = rows.get((a.name, node))
                if row is None:
                    row = rows[a.name, node] = {"entity": a.name, "node": node, "_anchor": a}
                if f == "":
                    row["kind"], row["value"] = kind, self.flagged("", value)
                else:
                    row[f] = self.flagged(f, value)
        first: dict[str, dict] = {}
        for row in rows.values():
            first.setdefault(row["entity"], row)
        for row in rows.values():
            for column, other in row["_anchor"].links.items():
                node = row["node"]
                to = next((r for n in range(len(node), -1, -1) if (r := rows.get((other, node[:n])))), None) or first.get(other)
                row[column] = None if to is None else self.key_of(to)
        return list(rows.values())

    @staticmethod
    def key_of(row: dict) -> str | None:
        if row.get("kind") != "object":
            return None
        own = row.get(row["_anchor"].key) if row["_anchor"].key else None
        last = row["node"][-1] if row["node"] else ""
        return own if own is not None else last[1:] if last[:1] == "." else None


def groups(df: DataFrame, key: str, payload: str, anchors: list[Anchor], finish: Callable[[list[dict]], list[dict]], columns: list[str], flags: tuple[str, ...] = ()) -> DataFrame:
    """``key`` and ``columns`` (texts) of the rows into which ``finish`` turns each record's anchor instances.

    The triples of a record are grouped and pivoted where it is parsed, so nothing is shuffled.
    ``finish`` gets one record's instances: dicts with entity, node (its steps), kind, value, fields and
    links.  Fields named in ``flags`` (``""`` names the anchor's own value) come out as ``1`` where their
    text holds more than blanks and else as an empty text.  A path below several anchors counts for
    each.  Null texts and texts that are no JSON have no rows; :func:`rejects` names the latter.
    """
    kept = df.select(F.col(key).alias("_key"), F.col(payload).cast("string").alias("_text")).where("_text IS NOT NULL")
    schema = f"_key {dict(df.dtypes)[key]}, " + ", ".join(f"`{n}` string" for n in columns)

    def run(batches):
        g = Groups(anchors, flags)

        def batch(keys, rows, type_):
            return pa.RecordBatch.from_arrays([pa.array(keys, type_), *(pa.array([r.get(n) for r in rows], pa.string()) for n in columns)], names=["_key", *columns])

        for b in batches:
            keys, rows = [], []
            for rid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    mine = finish(g.pivot(stream(text.lstrip("\ufeff"))))
                except ValueError:
                    continue
                keys += [rid] * len(mine)
                rows += mine
                if len(rows) > 50_000:
                    yield batch(keys, rows, b.schema.field(0).type)
                    keys, rows = [], []
            yield batch(keys, rows, b.schema.field(0).type)

    return kept.mapInArrow(run, schema).withColumnRenamed("_key", key)


def rejects(df: DataFrame, key: str, payload: str) -> DataFrame:
    """``key`` and error of the texts that are no JSON, and of null texts."""
    bad = triples(df, key, payload).where("kind = 'error'").select(key, F.col("value").alias("error"))
    return bad.unionByName(df.where(F.col(payload).isNull()).select(F.col(key), F.lit("null").alias("error")))


def path_groups(df: DataFrame, key: str, payload: str, anchors: list[Anchor]) -> DataFrame:
    """The paths of all records, grouped by repeated ancestor as found in them: ancestor, path, entities, n_values, n_records.

    A path is the record's keys with ``[*]`` for a place in an array and ``*`` for a key below which the
    anchors say that any may stand; its ancestor is its last part that repeats.  ``entities`` names the
    anchors that take its values, so a path without one is seen.  Counts are summed in each batch.
    """
    schema = pa.schema([("ancestor", pa.string()), ("path", pa.string()), ("entities", pa.string()), ("n_values", pa.int64()), ("n_records", pa.int64())])

    def run(batches):
        g = Groups(anchors)
        for b in batches:
            counts: dict[tuple, list[int]] = {}
            for text in b.column(0).to_pylist():
                seen = set()
                try:
                    nodes = list(stream(text.lstrip("\ufeff")))
                except ValueError:
                    continue
                for steps, kind, _ in nodes:
                    if kind in ("object", "array", "null"):
                        continue
                    name = g.named(tuple(s if s[0] == "." else "[*" for s in steps))
                    c = counts.setdefault(name, [0, 0])
                    c[0] += 1
                    c[1] += name not in seen
                    seen.add(name)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*((*k, *v) for k, v in counts.items())), schema)] if counts else [pa.array([], f.type) for f in schema], schema=schema)

    rows = df.select(F.col(payload).cast("string").alias("_text")).where("_text IS NOT NULL").mapInArrow(run, "ancestor string, path string, entities string, n_values bigint, n_records bigint")
    return rows.groupBy("ancestor", "path", "entities").agg(F.sum("n_values").alias("n_values"), F.sum("n_records").alias("n_records"))


def untaken(df: DataFrame, key: str, payload: str, anchors: list[Anchor]) -> DataFrame:
    """``key``, path (with places, as ``a[0].b``) and value of every value that no anchor takes."""
    g = Groups(anchors)
    schema = pa.schema([("path", pa.string()), ("value", pa.string())])
    kept = df.select(F.col(key).alias("_key"), F.col(payload).cast("string").alias("_text")).where("_text IS NOT NULL")

    def run(batches):
        own = Groups(g.anchors)
        for b in batches:
            keys, out = [], []
            for rid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    nodes = list(stream(text.lstrip("\ufeff")))
                except ValueError:
                    continue
                for steps, kind, value in nodes:
                    if kind not in ("object", "array", "null") and not own.of(tuple(s if s[0] == "." else "[*" for s in steps)):
                        keys.append(rid)
                        out.append((written(steps), value))
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), *(pa.array([x[i] for x in out], pa.string()) for i in range(2))], names=["_key", *schema.names])

    return kept.mapInArrow(run, f"_key {dict(df.dtypes)[key]}, path string, value string").withColumnRenamed("_key", key)


def written(steps: tuple[str, ...] | list[str]) -> str:
    return "".join(s if s[0] == "." else s + "]" for s in steps).removeprefix(".")


def last_key(node: tuple[str, ...]) -> str | None:
    """The key under which an anchor instance stands, or None in an array."""
    return node[-1][1:] if node and node[-1][0] == "." else None


def place(node: tuple[str, ...]) -> int | None:
    """The place in its array from 1, or None below an object."""
    return int(node[-1][1:]) + 1 if node and node[-1][0] == "[" else None
