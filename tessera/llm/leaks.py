"""Evaluation texts that leak into a corpus (problem 9).

The items are indexed by the character grams of their letters and digits.  BM25 impacts are
divided, per item, by the least that any passage of the wanted length can score, so that every
passage with a leak reaches 1 and nothing is lost; block-max WAND retrieves all items above that,
and what it retrieves is verified on the text.  Items that fit into one index are broadcast.  More
are divided into shards, each indexed by the tasks that need it, and passages go to the shards with
which they share a winnowed gram; the corpus is read as often for any number of items.
"""

from __future__ import annotations

import math
import unicodedata
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.spans import points, winnow
from tessera.session import cut, table

RUN = 50  # consecutive letters or digits that make a leak
GRAM = 10
K1, B = 1.2, 0.75
BLOCK = 16  # postings in a block
PASSAGE = 2000  # letters and digits in one query
ITEMS = 5_000  # items in one index: the bound of what is broadcast, and about the size of a shard
ITEM_CHARS = 5_000_000  # and their characters together
ROUTED = 10_000  # passages that one task searches in a shard


def bare(text: str | None) -> str:
    """The letters and digits of a text without differences of case, width and composition."""
    if not text:
        return ""
    t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return "".join(filter(str.isalnum, t))


class Index:
    """Postings of items by gram with normalised BM25 impacts and their maxima by block."""

    def __init__(self, items: list[tuple[int, str]], run: int = RUN) -> None:
        self.run = run
        self.items = [(i, t) for i, t in ((i, bare(t)) for i, t in items) if len(t) >= run]
        grams = [[t[x : x + GRAM] for x in range(len(t) - GRAM + 1)] for _, t in self.items]
        df = Counter(g for gs in grams for g in set(gs))
        n, mean = len(grams), sum(map(len, grams)) / max(1, len(grams))
        post: dict[str, list[tuple[int, float]]] = {}
        for d, gs in enumerate(grams):
            tf = Counter(gs)
            norm = K1 * (1 - B + B * len(gs) / mean)
            impact = {g: math.log(1 + (n - df[g] + 0.5) / (df[g] + 0.5)) * c * (K1 + 1) / (c + norm) for g, c in tf.items()}
            span = run - GRAM + 1
            least = min(sum(impact[g] for g in set(gs[x : x + span])) for x in range(len(gs) - span + 1))
            for g, v in impact.items():
                post.setdefault(g, []).append((d, v / least))
        self.docs = {g: [d for d, _ in p] for g, p in post.items()}
        self.impacts = {g: [v for _, v in p] for g, p in post.items()}
        self.blocks = {g: [max(v[x : x + BLOCK]) for x in range(0, len(v), BLOCK)] for g, v in self.impacts.items()}
        self.most = {g: max(v) for g, v in self.impacts.items()}

    def above(self, grams: set[str], least: float = 1 - 1e-9) -> list[int]:
        """The numbers of all items whose score for a query of these grams reaches ``least``."""
        lists = [[g, 0] for g in grams]
        found = []
        docs, end = self.docs, 1 << 60
        at = lambda c: docs[c[0]][c[1]] if c[1] < len(docs[c[0]]) else end
        while True:
            lists = sorted((c for c in lists if at(c) < end), key=at)
            total, pivot = 0.0, -1
            for x, c in enumerate(lists):
                total += self.most[c[0]]
                if total >= least:
                    pivot = x
                    break
            if pivot < 0:
                return found
            doc = at(lists[pivot])
            while pivot + 1 < len(lists) and at(lists[pivot + 1]) == doc:
                pivot += 1
            head = lists[: pivot + 1]
            bound, until = 0.0, end
            for c in head:  # the maxima of the blocks that could hold doc
                ds = docs[c[0]]
                p = bisect_left(ds, doc, c[1])
                if p < len(ds):
                    bound += self.blocks[c[0]][p // BLOCK]
                    last = min(len(ds), (p // BLOCK + 1) * BLOCK) - 1
                    until = min(until, ds[last] + 1)
            if bound >= least:
                score = 0.0
                for c in head:
                    ds = docs[c[0]]
                    p = bisect_left(ds, doc, c[1])
                    if p < len(ds) and ds[p] == doc:
                        score += self.impacts[c[0]][p]
                        p += 1
                    c[1] = p
                if score >= least:
                    found.append(doc)
            else:  # no item before the next block's begin can reach it
                to = max(doc + 1, min(until, at(lists[pivot + 1]) if pivot + 1 < len(lists) else end))
                for c in head:
                    c[1] = bisect_left(docs[c[0]], to, c[1])

    def leaks(self, text: str | None) -> list[tuple[int, int]]:
        """(item id, longest shared run) of the items of which the text holds a run."""
        t = bare(text)
        if len(t) < self.run:
            return []
        known, hits = self.docs.keys(), set()
        for x in range(0, max(1, len(t) - self.run + 1), PASSAGE):
            p = t[x : x + PASSAGE + self.run - 1]
            grams = known & {p[y : y + GRAM] for y in range(len(p) - GRAM + 1)}
            if grams:
                hits.update(self.above(grams))
        out = []
        for d in sorted(hits):
            i, item = self.items[d]
            if n := longest_run(item, t, self.run):
                out.append((i, n))
        return out


def longest_run(item: str, text: str, least: int) -> int:
    """The longest part of ``item`` of at least so many characters that stands in ``text``, or 0."""
    best, x = 0, 0
    want = least
    while x + want <= len(item):
        if item[x : x + want] in text:
            best = want
            want += 1
        else:
            x += 1
    return best


def _found(kind_of_key: str, kind_of_item: str, key: str, item: str) -> str:
    return f"`{key}` {kind_of_key}, `{item}` {kind_of_item}"


def _held(docs: DataFrame, items: DataFrame, run: int) -> DataFrame:
    """_doc, _item, run of all leaks of items (_item, _text) that fit into one index; docs: _doc, _text."""
    part = [(r[0], r[1]) for r in items.orderBy("_item", "_text").collect()]  # at most ITEMS, and ITEM_CHARS
    held = docs.sparkSession.sparkContext.broadcast(Index(part, run))
    kinds = dict(docs.dtypes)["_doc"], dict(items.dtypes)["_item"]

    def find(batches):
        index = held.value
        for b in batches:
            keys, ids, runs = [], [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for i, n in index.leaks(t):
                    keys.append(d)
                    ids.append(i)
                    runs.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), pa.array(ids, pa.int64() if kinds[1] == "bigint" else None), pa.array(runs, pa.int32())], names=["_doc", "_item", "run"])

    return docs.mapInArrow(find, _found(*kinds, "_doc", "_item") + ", run int")


def _seeds(texts: DataFrame, keys: list[str], run: int, text: bool) -> DataFrame:
    """``keys``, no and seeds (winnowed grams) of the passages of each text, with or without the passage itself.

    A passage and an item that share ``run`` letters and digits choose the same gram among them.
    """
    kinds = dict(texts.dtypes)

    def cut_up(batches):
        for b in batches:
            rows, numbers, passages, grams = [], [], [], []
            for x, t in enumerate(map(bare, b.column(len(keys)).to_pylist())):
                for no, at in enumerate(range(0, max(1, len(t) - run + 1), PASSAGE)):
                    p = t[at : at + PASSAGE + run - 1]
                    if len(p) >= run:
                        rows.append(x)
                        numbers.append(no)
                        passages.append(p if text else None)
                        grams.append([] if text else np.unique(winnow(points(p), run, GRAM)[0]).view(np.int64))
            take = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(take) for k in range(len(keys))), pa.array(numbers, pa.int32()), pa.array(passages, pa.string()), pa.array(grams, pa.list_(pa.int64()))], names=[*keys, "no", "passage", "seeds"])

    return texts.select(*keys, "_text").mapInArrow(cut_up, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", no int, passage string, seeds array<bigint>")


def _routed(docs: DataFrame, items: DataFrame, run: int, shards: int) -> DataFrame:
    """What :func:`_held` gives, for any number of items."""
    kinds = dict(docs.dtypes)["_doc"], dict(items.dtypes)["_item"]
    items = cut(items.withColumn("shard", F.pmod(F.xxhash64("_item", "_text"), F.lit(shards)).cast("int")))
    docs = docs.withColumn("_hash", F.xxhash64("_doc", "_text"))
    wanted = _seeds(items, ["shard"], run, False).select("shard", F.explode("seeds").alias("seed")).distinct()
    asked = _seeds(docs, ["_hash"], run, False).select("_hash", "no", F.explode("seeds").alias("seed"))
    hits = cut(asked.join(wanted, "seed").select("_hash", "no", "shard").distinct())
    parts = hits.groupBy("shard").agg(F.ceil(F.count("*") / ROUTED).cast("int").alias("parts"))
    routed = hits.join(parts, "shard").select("_hash", "no", "shard", F.pmod(F.xxhash64("_hash", "no"), "parts").cast("int").alias("part"))
    left = _seeds(docs, ["_hash"], run, True).select("_hash", "no", "passage").join(routed, ["_hash", "no"]).groupBy("shard", "part")
    right = items.join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("shard", "part", "_item", "_text").groupBy("shard", "part")

    def find(passages: pa.Table, own: pa.Table) -> pa.Table:
        index = Index(list(zip(own.column("_item").to_pylist(), own.column("_text").to_pylist())), run)
        found = {(d, i) for d, t in zip(passages.column("_hash").to_pylist(), passages.column("passage").to_pylist()) for i, _ in index.leaks(t)}
        return pa.table([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], own.schema.field("_item").type)], names=["_hash", "_item"])

    found = cut(left.cogroup(right).applyInArrow(find, _found("bigint", kinds[1], "_hash", "_item")).distinct())

    def measure(batches):
        for b in batches:
            t = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([longest_run(bare(i), bare(x), run) for x, i in zip(t, b.column(3).to_pylist())], pa.int32())], names=["_doc", "_item", "run"])

    both = docs.join(found, "_hash").join(items.select("_item", F.col("_text").alias("_own")), "_item").select("_doc", "_text", "_item", "_own")
    return both.mapInArrow(measure, _found(*kinds, "_doc", "_item") + ", run int").where("run > 0")


def leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, run: int = RUN) -> DataFrame:
    """doc key, item key and run (the longest shared run) of every document that holds a leak.

    A leak is at least ``run`` consecutive letters or digits of an item, all other characters and
    differences of case, width and composition left aside.  Items shorter than that, null and
    empty texts leak nothing.  Items with an id that occurs twice count once, by the longest run;
    repeated documents give repeated rows only where their ids differ.  Where both keys have one
    name, the item's column is called ``item_`` and that name.  Up to ITEMS items of together
    ITEM_CHARS characters are broadcast as one index, and the corpus isn't shuffled; more are searched
    in shards, to which only passages go that share a chosen gram.
    """
    named = item_key if item_key != key else f"item_{item_key}"
    own = items.select(F.col(item_key).alias("_item"), F.col(item_text).cast("string").alias("_text")).where("_item IS NOT NULL AND _text IS NOT NULL")
    all_ = docs.select(F.col(key).alias("_doc"), F.col(text).cast("string").alias("_text")).where("_text IS NOT NULL")
    n, size = own.agg(F.count("*"), F.coalesce(F.sum(F.char_length("_text")), F.lit(0))).first()
    shards = max(-(-n // ITEMS), -(-size // ITEM_CHARS))
    if not shards:
        return docs.sparkSession.createDataFrame([], _found(dict(all_.dtypes)["_doc"], dict(own.dtypes)["_item"], key, named) + ", run int")
    found = _held(all_, own, run) if shards == 1 else _routed(all_, own, run, shards)
    return found.select(F.col("_doc").alias(key), F.col("_item").alias(named), "run").groupBy(key, named).agg(F.max("run").alias("run"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and item_id of every document in ``documents`` that holds a passage of an item."""
    return leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text").select("doc_id", "item_id")


def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By leaked item: n_docs that hold a passage of it, and longest_run."""
    out = leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")
    return out.groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("run").alias("longest_run"))
