"""Broken prompt and response pairs (problem 5).

The sentences of all responses are clustered by MinHash over their character trigrams, with the
prompt's topic masked, and every member is verified against its cluster's commonest sentence.  A
cluster that recurs across unrelated prompts, and that makes up much of the responses it stands in
far more often than sentences do, is a template; a response that holds little else is a refusal.
No wording is known beforehand.  Copy, language and termination checks label the rest.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.sentences import keyed_texts, units
from tessera.llm.splits import plain_id
from tessera.llm.truncation import BLANKS, truncated
from tessera.session import cut, table

COVER = 1 / 6  # of a response's letters for a sentence to be a main part of it
BANDS, ROWS = 24, 2  # of a sentence's MinHash signature: of those as alike as SIMILAR, 99.9 % share a band
SIMILAR = 0.5  # Jaccard of trigrams at which a sentence belongs to its cluster
WHOLE_BANDS, WHOLE_ROWS, WHOLE_SIMILAR = 24, 8, 0.8  # of whole responses that have no main sentence: 98.8 % share a band
TOPICS = 3  # topics across which a template recurs
MAIN_SHARE = 0.8  # of a template's occurrences that are main parts
HELD_TOPS = 500_000  # bands of possible templates that may be broadcast (some 130 bytes each in memory)
CHANCE = 0.01  # of a cluster being that concentrated by accident, over all clusters together
LEFT_OVER = 25  # letters and digits that a refusal may hold besides, or else less than half of them
COPY_GRAM = 6  # characters of the prompt that count as its wording
COPIED = 0.6  # of a sentence's characters for it to be the prompt's

# What people write in place of an answer.
FILLERS = "없음 무응답 내용없음 해당없음 답없음 모름 미작성 미응답 na none null nil noanswer blank empty x 無回答 なし 无 没有 无回答".split()
_SEEDS = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1)) & ((1 << 64) - 1) for i in range(1, BANDS * ROWS + 1)], np.uint64)


def bare(text: str) -> str:
    return re.sub(r"[\W_]+", "", unicodedata.normalize("NFKC", text)).lower()


def is_empty(text: str | None) -> bool:
    """Null, blank, only marks, or a filler for no answer."""
    t = bare(text or "")
    return not t or t in FILLERS


def language(text: str) -> Counter:
    """Letters of a text by language, as far as scripts tell them; Han counts as Japanese beside kana."""
    c: Counter = Counter()
    for x in unicodedata.normalize("NFC", text):
        if "가" <= x <= "힣" or "ᄀ" <= x <= "ᇿ":
            c["ko"] += 1
        elif "぀" <= x <= "ヿ":
            c["kana"] += 1
        elif "㐀" <= x <= "鿿" or "豈" <= x <= "﫿":
            c["han"] += 1
        elif x.isalpha():
            c["latin" if x < "ɐ" else unicodedata.name(x, "OTHER").split(" ")[0]] += 1
    kana, han = c.pop("kana", 0), c.pop("han", 0)
    if kana or han:
        c["ja" if kana * 5 >= han else "zh"] += kana + han
    return c


def other_language(text: str, prompt: str) -> bool:
    """Is most of the text in another language than most of the prompt?"""
    mine, theirs = language(text), language(prompt)
    n = sum(mine.values())
    if not n or not theirs:
        return False
    return mine[theirs.most_common(1)[0][0]] * 2 < n


def copied(parts: list[str], prompt: str) -> list[bool]:
    """Which sentences are the prompt's own wording, in any spacing and order of its parts."""
    p = bare(prompt)
    grams = {p[i : i + COPY_GRAM] for i in range(len(p) - COPY_GRAM + 1)}
    out = []
    for s in map(bare, parts):
        hit = np.zeros(len(s), bool)
        for i in range(len(s) - COPY_GRAM + 1):
            if s[i : i + COPY_GRAM] in grams:
                hit[i : i + COPY_GRAM] = True
        out.append(bool(len(s)) and hit.sum() >= COPIED * len(s))
    return out


def is_copy(parts: list[str], flags: list[bool]) -> bool:
    """The prompt's wording with at most one sentence added, which is the smaller part."""
    sizes = [len(bare(p)) for p in parts]
    mine = sum(n for n, f in zip(sizes, flags) if f)
    return any(flags) and sum(not f for f, n in zip(flags, sizes) if n) <= 1 and 2 * mine >= sum(sizes)


def masked(sentence: str, topic: str | None) -> str:
    """A sentence as it is compared: the topic and numbers masked, without case and marks at its ends."""
    return re.sub(r"\d+", "0", sentence.replace(topic, "＊") if topic else sentence).lower().strip(BLANKS + ".!?…。！？")


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the trigrams of all texts, with marks at their ends, and where each text's begin."""
    padded = ["^" + t + "$" + ("" if t else "$") for t in texts]
    cps = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum([len(t) for t in padded])
    keep = np.ones(len(cps), bool)
    keep[ends - 1] = keep[ends - 2] = False  # no trigram begins at a text's last two characters
    begin = np.flatnonzero(keep)
    h = _mix(cps[begin] * np.uint64(0x9E3779B97F4A7C15) + cps[begin + 1] * np.uint64(0xC2B2AE3D27D4EB4F) + cps[begin + 2] * np.uint64(0x165667B19E3779F9))
    return h, np.r_[0, np.cumsum([len(t) - 2 for t in padded])[:-1]].astype(np.int64)


def _bands(values: np.ndarray, rows: int) -> np.ndarray:
    """The keys of the bands of so many neighbouring MinHash values each."""
    n = values.shape[1] // rows
    keys = np.zeros((len(values), n), np.uint64)
    for r in range(rows):
        keys = _mix(keys * np.uint64(0x9E3779B97F4A7C15) + values[:, r::rows])
    return (keys + np.arange(n, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(rows)).view(np.int64)


def sentence_bands(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """MinHash by one permutation for each value."""
    return _bands(np.stack([np.minimum.reduceat(_mix(h * seed), first) for seed in _SEEDS], axis=1), ROWS)


def whole_bands(h: np.ndarray) -> np.ndarray:
    """MinHash of one long text by one permutation cut into bins; an empty bin takes the next one's value."""
    n = WHOLE_BANDS * WHOLE_ROWS
    values = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    h = _mix(h * _SEEDS[0])
    np.minimum.at(values, (h >> np.uint64(32)).astype(np.int64) % n, h)
    filled = np.flatnonzero(values != np.iinfo(np.uint64).max)
    at = filled[np.searchsorted(filled, np.arange(n)) % len(filled)]
    return _bands(values[at][None, :], WHOLE_ROWS)[0]


def sketched(texts: DataFrame) -> DataFrame:
    """text, whole and other columns with the bands of each text's signature and its trigrams' hashes."""
    names = [c for c in texts.columns if c not in ("text", "whole")]

    def run(batches):
        for b in batches:
            values, whole = b.column(0).to_pylist(), b.column(1).to_pylist()
            keys, grams = [], []
            for at in range(0, len(values), 1000):  # keeps the arrays small
                h, first = trigrams(values[at : at + 1000])
                short = sentence_bands(h, first)
                for x, (s, e) in enumerate(zip(first.tolist(), [*first[1:].tolist(), len(h)])):
                    keys.append(whole_bands(h[s:e]) if whole[at + x] else short[x])
                    grams.append(np.unique((h[s:e] >> np.uint64(32)).astype(np.uint32)).view(np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.list_(pa.int64())), pa.array(grams, pa.list_(pa.int32()))], names=["text", "whole", *names, "bands", "grams"])

    kinds = dict(texts.dtypes)
    ddl = ", ".join(f"{c} {kinds[c]}" for c in ("text", "whole", *names)) + ", bands array<bigint>, grams array<int>"
    return texts.select("text", "whole", *names).mapInArrow(run, ddl)


def judged(pairs: DataFrame) -> DataFrame:
    """What each pair shows by itself, in one pass.

    pairs: essay_id, text, prompt, topic.  Gives essay_id, topic, empty, copy, other, rest (the letters
    and digits that are the prompt's) and parts (text, size, main, whole): the other sentences, and of
    a response without a main sentence all of them together.
    """
    part = pa.struct([("text", pa.string()), ("size", pa.int32()), ("main", pa.bool_()), ("whole", pa.bool_())])
    schema = pa.schema([("essay_id", pa.int64()), ("topic", pa.string()), ("empty", pa.bool_()), ("copy", pa.bool_()), ("other", pa.bool_()), ("parts", pa.list_(part)), ("rest", pa.int32())])

    def run(batches):
        for b in batches:
            rows = []
            for key, text, prompt, topic in zip(*(b.column(x).to_pylist() for x in range(4))):
                if is_empty(text):
                    rows.append({"essay_id": key, "topic": topic, "empty": True, "copy": False, "other": False, "parts": [], "rest": 0})
                    continue
                sentences_ = [text[s:e] for s, e in units(text)]
                flags = copied(sentences_, prompt) if prompt else [False] * len(sentences_)
                own = [(masked(p, topic), len(bare(p))) for p, f in zip(sentences_, flags) if not f]
                total = sum(n for _, n in own)
                parts = [{"text": t, "size": n, "main": n >= COVER * total, "whole": False} for t, n in own]
                if parts and not any(x["main"] for x in parts):
                    parts.append({"text": " ".join(t for t, _ in own), "size": total, "main": True, "whole": True})
                rest = sum(len(bare(p)) for p, f in zip(sentences_, flags) if f)
                rows.append({"essay_id": key, "topic": topic, "empty": False, "copy": is_copy(sentences_, flags), "other": bool(prompt) and other_language(text, prompt), "parts": parts, "rest": rest})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    ddl = "essay_id bigint, topic string, empty boolean, copy boolean, other boolean, parts array<struct<text:string,size:int,main:boolean,whole:boolean>>, rest int"
    return pairs.select("essay_id", "text", "prompt", "topic").mapInArrow(run, ddl)


def similar(tops: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """rep, id: of the texts in each band those that are similar to the band's top.

    tops: band, rep, size (of its trigrams); reps: id, whole, grams of the tops among others; texts: id,
    bands, grams.  A text meets one top in each of its bands, so there are never more pairs than bands.

    Arrays are planned as if they held one value, so that the tables of trigrams would seem small enough to
    broadcast, through the driver: they are merged.
    """
    mine = F.size("grams")
    pairs = texts.select("id", mine.alias("_n"), F.explode("bands").alias("band")).join(tops, "band")
    # the share that is common can't exceed that of the smaller in the larger
    pairs = pairs.where(F.least("_n", "size") >= SIMILAR * F.greatest("_n", "size")).select("rep", "id").distinct()
    pairs = pairs.join(texts.select("id", F.col("grams").alias("_a")).hint("merge"), "id").join(reps.select(F.col("id").alias("rep"), "whole", F.col("grams").alias("_b")).hint("merge"), "rep")
    both = F.size(F.array_intersect("_a", "_b"))
    least = F.when(F.col("whole"), WHOLE_SIMILAR).otherwise(SIMILAR)
    return pairs.where(both >= least * (F.size("_a") + F.size("_b") - both)).select("rep", "id")


def concentrated(n_main: Column, n_other: Column, base: float, n_clusters: int) -> Column:
    """Are so many main occurrences of all more than chance gives at the base rate of main parts?

    By the Chernoff bound of the binomial tail, for all clusters together.
    """
    n = n_main + n_other
    s = n_main / n
    rest = F.when(n_other > 0, n_other * F.log((1 - s) / (1 - base))).otherwise(F.lit(0.0))
    return (s > base) & (n_main * F.log(s / base) + rest >= math.log(max(1, n_clusters) / CHANCE))


def templates(each: DataFrame) -> DataFrame:
    """``id`` (hash of text and whole) of the texts that belong to a template; each: topic, text, main, whole by occurrence.

    A cluster is a band's commonest main text and all main texts that share a band with it and have
    similar trigrams.  It is a template if it recurs across TOPICS topics, at least MAIN_SHARE of its
    occurrences, and of those of similar other sentences, are main parts of their responses, and
    that many are beyond chance.  The base rate is that of all sentences, so the test holds at any
    number of responses.
    """
    one = each.where("NOT whole").agg(F.avg(F.col("main").cast("double"))).first()[0]
    base = min(0.5, max(1e-6, one or 0.0))
    key = F.xxhash64("text", "whole").alias("id")
    counts = each.groupBy("text", "whole").agg(F.sum(F.col("main").cast("bigint")).alias("n"), F.sum((~F.col("main")).cast("bigint")).alias("n_other"))
    texts = cut(sketched(counts).withColumn("id", key).drop("text"))
    mains = texts.where("n > 0")
    tops = mains.select("id", "n", F.size("grams").alias("size"), F.explode("bands").alias("band")).groupBy("band").agg(F.max_by(F.struct("id", "size"), F.struct("n", "id")).alias("r"), F.sum("n").alias("n"))
    # what doesn't meet TOPICS occurrences in a band can't recur in as many topics
    tops = cut(tops.where(F.col("n") >= TOPICS).select("band", F.col("r.id").alias("rep"), "r.size"))
    near = cut(similar(tops.hint("merge"), mains, mains))
    by_topic = near.join(each.where("main").groupBy(key, "topic").agg(F.count("*").alias("n")).hint("merge"), "id").groupBy("rep", "topic").agg(F.sum("n").alias("n"))
    seen = cut(by_topic.groupBy("rep").agg(F.sum("n").alias("n_main"), F.count("topic").alias("n_topics")))
    n_clusters = seen.count()
    recur = seen.where((F.col("n_topics") >= TOPICS) & concentrated(F.col("n_main"), F.lit(0), base, n_clusters))
    others = texts.where("n_other > 0")
    held_tops = cut(tops.join(recur.select("rep"), "rep", "left_semi").select("band", "rep", "size"))
    held_tops = F.broadcast(held_tops) if held_tops.count() <= HELD_TOPS else held_tops.hint("merge")  # else all sentences' bands are shuffled
    n_other = similar(held_tops, mains, others).join(others.select("id", "n_other").hint("merge"), "id").groupBy("rep").agg(F.sum("n_other").alias("n_other"))
    weighed = recur.join(n_other, "rep", "left").withColumn("n_other", F.coalesce("n_other", F.lit(0)))
    held = weighed.where((F.col("n_main") >= MAIN_SHARE * (F.col("n_main") + F.col("n_other"))) & concentrated(F.col("n_main"), F.col("n_other"), base, n_clusters))
    return near.join(held.select("rep"), "rep", "left_semi").select("id").distinct()


def refusals(rows: DataFrame) -> DataFrame:
    """essay_id of the responses that consist of templates.

    ``rows`` as :func:`judged` gives them.  What is no template must be at most LEFT_OVER letters, or
    less than half of the response.  Nothing but recurrence tells a refusal: one whose wording no
    other response has stays unfound.
    """
    each = rows.select("essay_id", "topic", "rest", F.explode("parts").alias("o")).select("essay_id", "topic", "rest", "o.*").withColumn("id", F.xxhash64("text", "whole"))
    known = cut(templates(each)).withColumn("known", F.lit(True))
    size = F.when(F.col("whole"), 0).otherwise(F.col("size"))
    told = each.drop("text", "topic").join(known, "id", "left").groupBy("essay_id").agg(
        F.max("known").alias("known"),
        F.max(F.col("known") & F.col("whole")).alias("all"),
        F.sum(F.when(F.col("known"), 0).otherwise(size)).alias("left"),
        F.sum(size).alias("size"),
        F.max("rest").alias("rest"),
    )
    left = F.when(F.col("all"), 0).otherwise(F.col("left")) + F.col("rest")
    return told.where(F.col("known") & ((left <= LEFT_OVER) | (2 * left < F.col("size") + F.col("rest")))).select("essay_id")


def defects(pairs: DataFrame, short_of_end: DataFrame) -> DataFrame:
    """essay_id, defect of every broken pair: the first of empty, refusal, copy, other_language and
    truncated that fits.

    ``pairs`` has one row per essay_id with text, prompt and topic, of which all may be null: a
    pair without a prompt is not judged for copy and language.  ``short_of_end`` has the
    essay_ids of truncated texts.
    """
    rows = cut(judged(pairs))
    declined = refusals(rows).withColumn("refusal", F.lit(True))
    out = rows.where("essay_id IS NOT NULL").select("essay_id", "empty", "copy", "other")
    out = out.join(declined, "essay_id", "left").join(short_of_end.select("essay_id").distinct().withColumn("cut", F.lit(True)), "essay_id", "left")
    defect = F.when(F.col("empty"), "empty").when(F.col("refusal"), "refusal").when(F.col("copy"), "copy").when(F.col("other"), "other_language").when(F.col("cut"), "truncated")
    return out.withColumn("defect", defect).where("defect IS NOT NULL").select("essay_id", "defect")


def essay_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """essay_id, text, prompt, topic of every essay: its longest text and the prompt most of its rows name."""
    essays = table(spark, sf_dir, "essays").select("essay_id", "prompt_id", "text").where("essay_id IS NOT NULL")
    texts = essays.groupBy("essay_id").agg(F.max_by("text", F.struct(F.char_length("text"), "text")).alias("text"))
    prompts = table(spark, sf_dir, "prompts").select(plain_id(F.col("prompt_id")).alias("_p"), "prompt", "topic").where("_p IS NOT NULL").groupBy("_p").agg(F.max_by(F.struct("prompt", "topic"), F.struct(F.char_length("prompt"), "prompt", "topic")).alias("q"))
    named = essays.select("essay_id", plain_id(F.col("prompt_id")).alias("_p")).where("_p IS NOT NULL").groupBy("essay_id", "_p").agg(F.count("*").alias("n")).join(prompts.select("_p"), "_p", "left_semi")
    own = named.groupBy("essay_id").agg(F.max_by("_p", F.struct("n", "_p")).alias("_p"))
    return texts.join(own.join(prompts, "_p").select("essay_id", "q.prompt", "q.topic"), "essay_id", "left").select("essay_id", "text", "prompt", "topic")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """essay_id, defect of every broken pair in ``essays``."""
    ended = truncated(keyed_texts(spark, sf_dir)).where("truncated AND field = 'text'")
    return defects(essay_pairs(spark, sf_dir), ended)


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By defect the number of essays."""
    return p5_found(spark, sf_dir).groupBy("defect").agg(F.count("*").alias("n_essays"))
