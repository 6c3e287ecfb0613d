"""Long exact spans shared between records, and fuzzy passages (problem 10).

Winnowed k-mers of every text are joined as seeds.  Two texts that share a span of the wanted
length choose the same k-mer in it, so no link is lost.  Seeds that many texts hold (a notice, a
template) aren't paired: they are replaced by keys that hold more of their context, at last by all
whole spans around them.  Texts that share a span are a class of that span; only the result expands
it into pairs, and what of a text is shared elsewhere needs no pairs at all.  Candidate pairs are
aligned: matches are merged into segments, and these chained with gap costs through a Fenwick tree.

Fuzzy passages are found with shorter seeds, so dense that every pair with a passage shares some.
All such pairs are looked at; their matches are chained, the chain is cut where it costs more than it
gains, and every piece is aligned and reported.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.session import cut, table

SPAN = 200  # code points that make a shared span
SEED = 100  # length of the k-mers that are joined
#: Texts that may share a key before it is replaced by longer ones: by seed, by context.
HOT, HOT_CONTEXT = 16, 64
STEP = 10  # offsets of a span around a seed that share one context key
LINK = 16  # length of the matches within a pair
GAP_COST = 0.05  # what a chain pays for each code point between two segments
FUZZY_SEED = 24  # length of the matches within a fuzzy passage
FUZZY_KEY, FUZZY_WINDOW = 16, 24  # k-mers that are joined for fuzzy passages, one in each stretch of a match's length
#: Chosen k-mers that two texts with a passage share: of three segments each holds one, two hold four, a single one eight.
FUZZY_SEEDS = 3
CELL = 20_000  # pairs of texts that are aligned in one task
FUZZY, ALIKE = 200, 0.8  # code points of a fuzzy passage, and the part of them that must match
FUZZY_GAP = 0.5  # what a chain of seeds pays for each code point between two: beyond two seeds' length it ends

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def points(text: str) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Hashes:
    """Hashes of all parts of one text in constant time each, as wrapped sums of powers."""

    def __init__(self, cps: np.ndarray, salt: int = 1) -> None:
        n = len(cps)
        powers = np.ones(n + 1, np.uint64)
        inverse = np.ones(n + 1, np.uint64)
        powers[1:] = _BASE
        inverse[1:] = _INVERSE
        powers, self.inverse = np.cumprod(powers), np.cumprod(inverse)
        self.sums = np.zeros(n + 1, np.uint64)
        self.sums[1:] = np.cumsum(_mix(cps.astype(np.uint64) + np.uint64(salt)) * powers[:-1])

    def of(self, begin: np.ndarray, length: int) -> np.ndarray:
        """Hashes of the parts of this length that begin there."""
        return _mix((self.sums[begin + length] - self.sums[begin]) * self.inverse[begin] + np.uint64(length))


def winnow(cps: np.ndarray, span: int = SPAN, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of the chosen k-mers: of every span the least, of equal ones the first.

    Long texts go in overlapping pieces, so that each span lies in one piece whole; what is chosen
    in a span depends on that span alone.
    """
    window = span - seed + 1
    piece = 1 << 20
    hs, ps = [], []
    for at in range(0, max(1, len(cps) - span + 1), piece):
        part = cps[at : at + piece + span - 1]
        n = len(part) - seed + 1
        if n < window:
            continue
        h = Hashes(part).of(np.arange(n), seed)
        ranked = (h & ~np.uint64((1 << 24) - 1)) | np.arange(n, dtype=np.uint64)
        # least of each window: of two blocks that meet in it, the rest of one, the begin of the other
        blocks = -(-n // window)
        full = np.full(blocks * window, np.iinfo(np.uint64).max)
        full[:n] = ranked
        grid = full.reshape(blocks, window)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        starts = np.arange(n - window + 1)
        p = np.unique((np.minimum(behind[starts], ahead[starts + window - 1]) & np.uint64((1 << 24) - 1)).astype(np.int64))
        hs.append(h[p])
        ps.append(p + at)
    if not hs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, p = np.concatenate(hs), np.concatenate(ps)
    _, first = np.unique(p, return_index=True)
    return h[first], p[first]


def contexts(hashes: Hashes, n: int, seeds: np.ndarray, step: int, span: int = SPAN, seed: int = SEED) -> np.ndarray:
    """Keys of the surroundings of the seeds at these positions.

    Each span around a seed contains one key whole, of span - step + 1 code points; with a step of
    1 the keys are the spans themselves.
    """
    length = span - step + 1
    out = []
    for left in range(0, span - seed + 1, step):
        begin = seeds - min(left, span - seed)
        ok = (begin >= 0) & (begin + length <= n)
        out.append(hashes.of(begin[ok], length))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def segments(a: np.ndarray, b: np.ndarray, span: int = SPAN, link: int = LINK) -> list[tuple[int, int, int]]:
    """Exact segments (begin in a, begin in b, length) that two texts share, not extendable.

    They grow from k-mers that occur once in either text, and from all shared spans of the wanted
    length, also repeated ones, so that none of that length is missed.
    """
    found: dict[tuple[int, int], int] = {}

    def grow(i: int, j: int, k: int) -> None:
        left = 0
        while True:
            m = min(i - left, j - left, 256)
            same = a[i - left - m : i - left] == b[j - left - m : j - left]
            back = m if same.all() else int(m - 1 - np.flatnonzero(~same)[-1])
            left += back
            if back < 256:
                break
        right = k
        while True:
            m = min(len(a) - i - right, len(b) - j - right, 256)
            same = a[i + right : i + right + m] == b[j + right : j + right + m]
            on = m if same.all() else int(np.flatnonzero(~same)[0])
            right += on
            if on < 256:
                break
        found[(i - left, j - left)] = left + right
        ends[j - i] = max(ends.get(j - i, 0), i + right)

    ends: dict[int, int] = {}
    for k, once in ((span, False), (link, True)):
        if len(a) < k or len(b) < k:
            continue
        ha, hb = Hashes(a).of(np.arange(len(a) - k + 1), k), Hashes(b).of(np.arange(len(b) - k + 1), k)
        ua, ia, ca = np.unique(ha, return_index=True, return_counts=True)
        ub, ib, cb = np.unique(hb, return_index=True, return_counts=True)
        _, xa, xb = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
        if once:
            single = (ca[xa] == 1) & (cb[xb] == 1)
            xa, xb = xa[single], xb[single]
        i, j = ia[xa], ib[xb]
        order = np.argsort(i, kind="stable")
        for x, y in zip(i[order].tolist(), j[order].tolist()):
            if x >= ends.get(y - x, 0) and np.array_equal(a[x : x + k], b[y : y + k]):
                grow(x, y, k)
    return [(i, j, n) for (i, j), n in sorted(found.items())]


def chain(segs: list[tuple[int, int, int]], cost: float = GAP_COST) -> tuple[float, list[int]]:
    """The best collinear chain: its score and the numbers of its segments in order.

    A segment scores its length; a step between two pays ``cost`` for each code point of either
    text between them.  The best predecessor of a segment is a prefix maximum over the ends in b,
    kept in a Fenwick tree while a sweep goes through a.
    """
    if not segs:
        return 0.0, []
    ends = sorted({j + n for _, j, n in segs})
    place = {e: x + 1 for x, e in enumerate(ends)}
    tree: list[tuple[float, int]] = [(-np.inf, -1)] * (len(ends) + 1)
    score, before = [0.0] * len(segs), [-1] * len(segs)
    events = sorted([(i, 1, x) for x, (i, _, _) in enumerate(segs)] + [(i + n, 0, x) for x, (i, _, n) in enumerate(segs)])
    for _, begins, x in events:
        i, j, n = segs[x]
        if begins:
            lo, hi = 0, len(ends)
            while lo < hi:  # ends at or before j
                mid = (lo + hi) // 2
                lo, hi = (mid + 1, hi) if ends[mid] <= j else (lo, mid)
            best, y = (-np.inf, -1), lo
            while y:
                best = max(best, tree[y])
                y &= y - 1
            gain = best[0] - cost * (i + j)
            score[x], before[x] = (n + gain, best[1]) if gain > 0 else (float(n), -1)
        else:
            y, v = place[j + n], (score[x] + cost * (i + j + 2 * n), x)
            while y < len(tree):
                tree[y] = max(tree[y], v)
                y += y & -y
    x = max(range(len(segs)), key=lambda x: (score[x], -x))
    top, out = score[x], []
    while x >= 0:
        out.append(x)
        x = before[x]
    return top, out[::-1]


def seeds(docs: DataFrame, key: str, text: str, span: int, seed: int) -> DataFrame:
    """``id`` and ``key`` (hash) of the chosen k-mers of every text, each once."""

    def run(batches):
        for b in batches:
            ids, keys = [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = np.unique(winnow(points(t), span, seed)[0])
                ids.append(np.full(len(h), d, np.int64))
                keys.append(h.view(np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(keys))], names=["id", "key"])

    return docs.select(key, text).mapInArrow(run, "id bigint, key bigint")


def _around(docs: DataFrame, hot: DataFrame, span: int, seed: int, step: int) -> DataFrame:
    """``id`` and ``key`` of the surroundings of the hot seeds; hot has id and seeds (array)."""

    def run(batches):
        for b in batches:
            ids, keys = [], []
            for d, t, want in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                cps = points(t)
                h, p = winnow(cps, span, seed)
                k = contexts(Hashes(cps), len(cps), p[np.isin(h.view(np.int64), want)], step, span, seed)
                ids.append(np.full(len(k), d, np.int64))
                keys.append(k.view(np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(keys))], names=["id", "key"])

    return docs.join(hot, "id").select("id", "text", "seeds").mapInArrow(run, "id bigint, key bigint")


def _split(rows: DataFrame, hot: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of the ids that share a key which at most ``hot`` have; the rows of the other keys.

    Lists are collected only of keys whose counted size is within the bound.
    """
    counts = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    some = rows.join(counts, "key")
    lists = some.where(F.col("n") <= hot).groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids")).select("ids").distinct()
    a = lists.select("ids", F.posexplode("ids").alias("at", "a"))
    pairs = a.select("a", F.explode(F.slice("ids", F.col("at") + 2, F.lit(hot))).alias("b"))
    return pairs, some.where(F.col("n") > hot).select("id", "key")


def span_rows(docs: DataFrame, seeded: DataFrame, span: int, seed: int) -> DataFrame:
    """``id``, ``key`` and ``check`` (two hashes), ``pos`` of all spans around the given seeds; seeded: id, seeds."""

    def run(batches):
        for b in batches:
            ids, keys, checks, places = [], [], [], []
            for d, t, want in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                cps = points(t)
                h, p = winnow(cps, span, seed)
                p = p[np.isin(h.view(np.int64), want)]
                near = np.zeros(len(cps) + 1, np.int64)
                np.add.at(near, np.maximum(0, p - (span - seed)), 1)
                np.add.at(near, np.minimum(p, len(cps) - span) + 1, -1)
                at = np.flatnonzero(np.cumsum(near)[: len(cps) - span + 1] > 0)
                ids.append(np.full(len(at), d, np.int64))
                keys.append(Hashes(cps).of(at, span).view(np.int64))
                checks.append(Hashes(cps, 0x5BD1E995).of(at, span).view(np.int64))
                places.append(at.astype(np.int32))
                if sum(map(len, ids)) > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, keys, checks, places)], names=["id", "key", "check", "pos"])
                    ids, keys, checks, places = [], [], [], []
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, keys, checks, places)], names=["id", "key", "check", "pos"])

    return docs.join(seeded, "id").select("id", "text", "seeds").mapInArrow(run, "id bigint, key bigint, check bigint, pos int")


def span_classes(rows: DataFrame) -> DataFrame:
    """``cls``, ``id``, ``n``: the sets of texts that share a span, each set once, and their sizes.

    Spans that the same texts share are one class.
    """
    own = rows.select("id", "key", "check").distinct()
    sets = own.groupBy("key", "check").agg(F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("who")).where("n > 1")
    one = sets.groupBy("n", "who").agg(F.min_by(F.struct("key", "check"), F.struct("key", "check")).alias("k")).select("k.key", "k.check", "n")
    return own.join(one, ["key", "check"]).select(F.xxhash64("key", "check").alias("cls"), "id", "n")


def copies(docs: DataFrame) -> DataFrame:
    """``id`` and ``rep`` (the class's smallest id) of texts that others repeat exactly, reps too."""
    keyed = docs.select("id", F.md5("text").alias("_md5"))
    reps = keyed.groupBy("_md5").agg(F.min("id").alias("rep"), F.max("id").alias("_last")).where("rep < _last")
    return keyed.join(reps, "_md5").select("id", "rep").distinct()


def _seeded(docs: DataFrame, repeated: DataFrame, span: int, seed: int) -> DataFrame:
    """The seeds of the class representatives."""
    return seeds(docs, "id", "text", span, seed).join(repeated.where("id <> rep").select("id"), "id", "left_anti")


def candidates(docs: DataFrame, repeated: DataFrame, span: int = SPAN, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Pairs a < b of class representatives that may share a span, and those that do by a span's key.

    Together these are all that share one.
    """
    level1 = cut(_seeded(docs, repeated, span, seed))
    pairs1, hot1 = _split(level1, HOT)
    hot1 = cut(hot1.groupBy("id").agg(F.collect_list("key").alias("seeds")))
    level2 = cut(_around(docs, hot1, span, seed, STEP))
    pairs2, hot2 = _split(level2, HOT_CONTEXT)
    level3 = span_rows(docs, hot1.join(hot2.select("id").distinct(), "id", "left_semi"), span, seed)
    classes = cut(span_classes(level3))
    sure = classes.select("cls", F.col("id").alias("a")).join(classes.select("cls", F.col("id").alias("b")), "cls").where("a < b").select("a", "b").distinct()
    return pairs1.union(pairs2).distinct(), sure


def align(docs: DataFrame, pairs: DataFrame, span: int = SPAN) -> DataFrame:
    """The pairs a, b that share an exact span: longest, the best chain's score, its begin and end in either text."""
    schema = "a bigint, b bigint, longest int, score double, begin_a int, end_a int, begin_b int, end_b int"
    fields = [("a", pa.int64()), ("b", pa.int64()), ("longest", pa.int32()), ("score", pa.float64()), *((n, pa.int32()) for n in ("begin_a", "end_a", "begin_b", "end_b"))]

    def run(batches):
        for batch in batches:
            out = []
            for a, b, ta, tb in zip(*(batch.column(x).to_pylist() for x in range(4))):
                segs = segments(points(ta), points(tb), span)
                longest = max((n for _, _, n in segs), default=0)
                if longest < span:
                    continue
                score, best = chain(segs)
                first, last = segs[best[0]], segs[best[-1]]
                out.append({"a": a, "b": b, "longest": longest, "score": score, "begin_a": first[0], "end_a": last[0] + last[2], "begin_b": first[1], "end_b": last[1] + last[2]})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(fields))

    ta = docs.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    tb = docs.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(ta, "a").join(tb, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, schema)


def _long(docs: DataFrame, key: str, text: str, span: int) -> DataFrame:
    return docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("text")).where(F.col("id").isNotNull() & (F.char_length("text") >= span))


def shared_pairs(docs: DataFrame, key: str, text: str, span: int = SPAN, seed: int = SEED) -> DataFrame:
    """doc_id_a < doc_id_b: all pairs of documents that share ``span`` consecutive code points.

    Null, empty and shorter texts have no part in it.  Classes of copies, and of texts that share a
    span, are only expanded here, as every pair is a result.  An empty table gives no pairs, a row
    that is repeated as a whole none with itself.
    """
    long = _long(docs, key, text, span)
    repeated = cut(copies(long))
    maybe, sure = candidates(long, repeated, span, seed)
    found = align(long, maybe, span).select("a", "b").union(sure).distinct()
    m = F.coalesce(F.col("id"), F.col("side"))

    def members(df: DataFrame, side: str) -> DataFrame:
        return df.join(repeated.select("id", F.col("rep").alias(side)), side, "left").withColumnRenamed(side, "side").withColumn(f"doc_{side}", m).drop("side", "id")

    other = members(members(found, "a"), "b").select(F.least("doc_a", "doc_b").alias("doc_id_a"), F.greatest("doc_a", "doc_b").alias("doc_id_b"))
    x, y = repeated.select("rep", F.col("id").alias("doc_id_a")), repeated.select("rep", F.col("id").alias("doc_id_b"))
    same = x.join(y, "rep").where("doc_id_a < doc_id_b").select("doc_id_a", "doc_id_b")
    return other.unionByName(same)


def links(classes: DataFrame) -> DataFrame:
    """``id`` and ``n_links``: how many other texts share a span with each; classes: cls, id, n.

    Texts with the same classes have the same links, so they count together as a profile.  All but
    itself in a profile's largest class are links; what else its other classes bring is counted
    profile by profile, and no two texts are paired.
    """
    own = classes.groupBy("id").agg(F.sum(F.xxhash64("cls").cast("decimal(38,0)")).alias("_s"), F.count("*").alias("_n"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("_x"))
    own = cut(own.select("id", F.md5(F.concat_ws(":", "_s", "_n", "_x")).alias("p")))
    sizes = own.groupBy("p").agg(F.count("*").alias("size"), F.min("id").alias("id"))
    held = cut(sizes.join(classes, "id").select("p", "size", "cls", "n"))
    top = held.groupBy("p").agg(F.max_by("cls", F.struct("n", "cls")).alias("top"), F.max("n").alias("base"))
    rest = held.join(top, "p").where("cls <> top").select("p", "top", "cls")
    more = rest.join(held.select(F.col("p").alias("q"), "size", "cls"), "cls").where("p <> q").select("p", "top", "q", "size").distinct()
    more = more.join(held.select(F.col("p").alias("q"), F.col("cls").alias("top")), ["q", "top"], "left_anti").groupBy("p").agg(F.sum("size").alias("more"))
    n = top.join(more, "p", "left").select("p", (F.col("base") - 1 + F.coalesce("more", F.lit(0))).cast("int").alias("n_links"))
    return own.join(n, "p").select("id", "n_links")


def shared_amount(docs: DataFrame, key: str, text: str, span: int = SPAN, seed: int = SEED) -> DataFrame:
    """One row per document: class_id (of its exact copies), n_chars, shared_chars, n_links.

    shared_chars are the code points that lie in spans which another document has too; n_links
    counts the other classes that share one.  Null and short texts share nothing, and are their
    own class.  Spans are counted by their keys; no texts are paired.
    """
    long = _long(docs, key, text, span)
    repeated = cut(copies(long))
    first = cut(_seeded(long, repeated, span, seed))
    common = first.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    rows = cut(span_rows(long, first.join(common, "key").groupBy("id").agg(F.collect_list("key").alias("seeds")), span, seed))
    several = rows.groupBy("key", "check").agg(F.min("id").alias("_a"), F.max("id").alias("_b")).where("_a < _b").select("key", "check")
    gap = F.lead("pos").over(W.partitionBy("id").orderBy("pos")) - F.col("pos")
    amount = rows.join(several, ["key", "check"]).select("id", F.least(F.lit(span), F.coalesce(gap, F.lit(span))).alias("_part")).groupBy("id").agg(F.sum("_part").alias("amount"))
    own = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.char_length(F.col(text).cast("string")), F.lit(0)).cast("bigint").alias("n_chars"))
    out = own.join(repeated.select(F.col("id").alias("doc_id"), "rep"), "doc_id", "left").withColumn("_copy", F.col("rep").isNotNull()).withColumn("id", F.coalesce("rep", "doc_id"))
    out = out.join(links(span_classes(rows)), "id", "left").join(amount, "id", "left")
    shared = F.when(F.col("_copy"), F.col("n_chars")).otherwise(F.coalesce("amount", F.lit(0)))
    return out.select("doc_id", F.col("id").alias("class_id"), "n_chars", shared.cast("bigint").alias("shared_chars"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def pieces(segs: list[tuple[int, int, int]], cost: float = FUZZY_GAP) -> list[list[tuple[int, int, int]]]:
    """The collinear chains that lie in the segments, best first: each is taken out with all it spans."""
    out = []
    while segs:
        _, best = chain(segs, cost)
        held = [segs[x] for x in best]
        out.append(held)
        a, b = held[0][0], held[-1][0] + held[-1][2]
        segs = [s for s in segs if s[0] + s[2] <= a or s[0] >= b]
    return out


def matched(a: np.ndarray, b: np.ndarray, held: list[tuple[int, int, int]]) -> int:
    """Code points of ``a`` that match in the alignment along a chain: the segments and, between two, the
    longest common subsequence."""
    from difflib import SequenceMatcher

    n, ia, ib = 0, held[0][0], held[0][1]
    for i, j, k in held:
        if i > ia and j > ib:
            n += sum(m.size for m in SequenceMatcher(None, a[ia:i].tolist(), b[ib:j].tolist(), autojunk=False).get_matching_blocks())
        skip = max(0, ia - i, ib - j)
        n += max(0, k - skip)
        ia, ib = max(ia, i + k), max(ib, j + k)
    return n


def may_hold(hashes: np.ndarray, other: np.ndarray, least: int, alike: float, seed: int = FUZZY_SEED) -> bool:
    """Can a text with these k-mers hold a passage with one that has the (sorted) others?

    A chain whose gaps cost FUZZY_GAP for each code point of either text is worth more than nothing, so that
    its segments are more than a quarter of both extents together, and ``alike`` bounds the other extent.
    So no passage is lost where no stretch of that length is covered that far by shared k-mers.
    """
    if not len(other) or len(hashes) + seed - 1 < least:
        return False
    at = np.flatnonzero(other[np.minimum(np.searchsorted(other, hashes), len(other) - 1)] == hashes)
    n = len(hashes) + seed - 1
    part = 0.25 * (1 + alike)
    if not len(at):
        return False
    change = np.zeros(n + 1, np.int64)
    change[at] += 1
    change[at + seed] -= 1
    sums = np.r_[0.0, np.cumsum((np.cumsum(change[:-1]) > 0) - part)]
    return bool((sums[least:] - np.minimum.accumulate(sums[: n - least + 1])).max() > 0)


def _counted(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``id`` and ``key`` of all chosen k-mers of fuzzy passages; what a text repeats has a key for each time."""

    def run(batches):
        for b in batches:
            ids, keys = [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = np.sort(winnow(points(t), FUZZY_WINDOW, FUZZY_KEY)[0])
                new = np.flatnonzero(np.r_[True, h[1:] != h[:-1]][: len(h)])
                time = np.arange(len(h)) - np.repeat(new, np.diff(np.r_[new, len(h)]))
                ids.append(np.full(len(h), d, np.int64))
                keys.append(np.where(time > 0, _mix(h + time.astype(np.uint64)), h).view(np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(keys))], names=["id", "key"])

    return docs.select(key, text).mapInArrow(run, "id bigint, key bigint")


def fuzzy_pairs(docs: DataFrame, pairs: DataFrame, least: int, alike: float) -> DataFrame:
    """The passages of the pairs a, b, as :func:`passages` gives them; docs: id, text, each id once or as a copy of its row.

    Texts and pairs go to cells of the square of ids, so that a text is sent once to a cell, not to each of its pairs.
    """
    schema = "doc_id bigint, begin int, end int, other_id bigint, other_begin int, other_end int, matched int"
    fields = pa.schema([(n, pa.int64() if n.endswith("_id") else pa.int32()) for n in ("doc_id", "begin", "end", "other_id", "other_begin", "other_end", "matched")])
    side = max(1, math.ceil((pairs.count() / CELL) ** 0.5))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(side))
    placed = pairs.select("a", "b", (block("a") * side + block("b")).alias("cell"))
    texts = placed.select("cell", F.explode(F.array("a", "b")).alias("id")).distinct().join(docs, "id").select(F.col("cell").alias("of_cell"), "id", "text")

    def run(own: pa.Table, held_texts: pa.Table) -> pa.Table:
        known = dict(zip(held_texts.column("id").to_pylist(), held_texts.column("text").to_pylist()))
        read: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

        def of(d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            if d not in read:
                x = points(known[d])
                h = Hashes(x).of(np.arange(len(x) - FUZZY_SEED + 1), FUZZY_SEED)
                read[d] = x, h, np.unique(h)
            return read[d]

        out = []
        for a, b in zip(own.column("a").to_pylist(), own.column("b").to_pylist()):
            (x, h, _), (y, _, other) = of(a), of(b)
            if not may_hold(h, other, least, alike):
                continue
            for held in pieces(segments(x, y, least, FUZZY_SEED)):
                i, j = held[0][:2]
                ie, je = held[-1][0] + held[-1][2], held[-1][1] + held[-1][2]
                if ie - i >= least and (n := matched(x, y, held)) >= alike * max(ie - i, je - j):
                    out.append({"doc_id": a, "begin": i, "end": ie, "other_id": b, "other_begin": j, "other_end": je, "matched": n})
        return pa.Table.from_pylist(out, schema=fields)

    return placed.groupBy("cell").cogroup(texts.groupBy("of_cell")).applyInArrow(run, schema)


def passages(docs: DataFrame, key: str, text: str, least: int = FUZZY, alike: float = ALIKE) -> DataFrame:
    """doc_id, begin, end, other_id, other_begin, other_end, matched: passages that stand, perhaps altered, in another text too.

    A passage is a chain of segments of at least ``least`` code points of which the part ``alike`` or more
    match.  All pairs doc_id > other_id that hold one are found: its segments hold FUZZY_SEEDS stretches of
    FUZZY_WINDOW, in each of which both texts choose the same k-mer.  Exact copies are compared once and
    stand in the result with all that their text shares, and with each other as a whole.
    Null texts and texts shorter than ``least`` have no passages.
    """
    long = _long(docs, key, text, least)
    repeated = cut(copies(long))
    reps = long.join(repeated.where("id <> rep").select("id"), "id", "left_anti").distinct()
    found = cut(_counted(reps, "id", "text"))
    a, b = found.select("key", F.col("id").alias("a")), found.select("key", F.col("id").alias("b"))
    linked = a.join(b, "key").where("a > b").groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= (FUZZY_SEEDS if least >= FUZZY and alike >= ALIKE else 1)).select("a", "b")
    # a copy of b may have a larger id than a, and then is the one whose passages are asked for
    last = repeated.groupBy("rep").agg(F.max("id").alias("last"))
    linked = linked.join(last.withColumnRenamed("rep", "b"), "b", "left").select("a", "b", (F.col("last") > F.col("a")).alias("_turn"))
    star = cut(linked.select(F.explode(F.when(F.col("_turn"), F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).otherwise(F.array(F.struct("a", "b")))).alias("p")).select("p.*"))
    fuzzy = fuzzy_pairs(reps, star, least, alike)
    for side in ("doc_id", "other_id"):
        fuzzy = fuzzy.join(repeated.select(F.col("id").alias("_id"), F.col("rep").alias(side)), side, "left").withColumn(side, F.coalesce("_id", side)).drop("_id")
    n = F.char_length("text").cast("int")
    first, second = repeated.select("rep", F.col("id").alias("doc_id")), repeated.select("rep", F.col("id").alias("other_id"))
    sizes = long.join(repeated.where("id = rep"), "id").select("rep", n.alias("n")).distinct()
    whole = first.join(second, "rep").where("doc_id > other_id").join(sizes, "rep")
    whole = whole.select("doc_id", F.lit(0).alias("begin"), F.col("n").alias("end"), "other_id", F.lit(0).alias("other_begin"), F.col("n").alias("other_end"), F.col("n").alias("matched"))
    return fuzzy.where("doc_id > other_id").select(*whole.columns).unionByName(whole)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id_a, doc_id_b of all pairs in ``documents`` that share 200 code points."""
    return shared_pairs(table(spark, sf_dir, "documents"), "doc_id", "text")


def p10_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By document, how much of its text stands in others too."""
    return shared_amount(table(spark, sf_dir, "documents"), "doc_id", "text")


def p10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By document its passages that stand, perhaps altered, in another one too, each with one of these."""
    return passages(table(spark, sf_dir, "documents"), "doc_id", "text")


SQL = {
    "p10_found": """
WITH g AS (SELECT DISTINCT doc_id, md5(substring(text, i, 200)) AS s FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200)),
h AS (SELECT s FROM g GROUP BY s HAVING count(*) > 1), k AS (SELECT g.* FROM g SEMI JOIN h USING (s))
SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM k a JOIN k b ON a.s = b.s AND a.doc_id < b.doc_id""",
}
