"""Splits that keep related records together (problem 3).

Records that share an entity, or of which one derives from the other, form components, found by
alternating star contraction.  Grouped iterative stratification then places whole components:
the one with the rarest outstanding label first, into the split that needs that label most.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions.text import plain_id
from tessera.session import cut, table

#: Components larger than 1 / FINE of all records, of which there are fewer than FINE, are placed one
#: by one on the driver; all others in a distributed sweep.
FINE = 4000
#: Components that one task of the sweep should number.
SWEEP = 100_000


def components(edges: DataFrame) -> DataFrame:
    """``id`` and ``group`` (its component's smallest id) of every id in the edges (u, v).

    Alternating large and small stars: the number of rounds grows with the logarithm of the
    component's width, and each leaves at most as many edges as before.  No neighbourhood is
    collected: a hub only has its minimum aggregated and joined back.  Null ends are left out.
    """
    e = edges.select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct()
    nodes = edges.select(F.explode(F.array("u", "v")).alias("id")).where("id IS NOT NULL").distinct()
    e = cut(e)
    mark = None
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = cut(small.where("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return nodes.join(e.select(F.col("u").alias("id"), F.col("v").alias("group")), "id", "left").select("id", F.coalesce("group", "id").alias("group"))


def groups_of_records(rows: DataFrame, key: str, entities: list[str], parent: str | None = None) -> DataFrame:
    """``id`` and ``group`` of every distinct ``key``, regarding all its rows.

    Keys belong together that share a value in one of ``entities`` (ids as :func:`plain_id` makes
    them), or of which one is the ``parent`` of the other, transitively.  A parent that is no key
    of the table joins nothing; null keys are left out.  An entity with a third of all rows adds
    one edge a key, to the entity's smallest key.
    """
    ids = rows.select(F.col(key).alias("u")).where("u IS NOT NULL")
    edges = ids.select("u", F.col("u").alias("v"))
    for c in entities:
        own = rows.select(F.col(key).alias("u"), plain_id(F.col(c)).alias("_e")).where("u IS NOT NULL AND _e IS NOT NULL").distinct()
        first = own.groupBy("_e").agg(F.min("u").alias("v"))
        edges = edges.union(own.join(first, "_e").select("u", "v"))
    if parent:
        to = rows.select(F.col(key).alias("u"), F.col(parent).alias("v")).where("u IS NOT NULL AND v IS NOT NULL").distinct()
        edges = edges.union(to.join(ids.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("u", "v"))
    return components(edges)


def chain_starts(df: DataFrame, key: str, parent: str) -> DataFrame:
    """``id`` and ``start`` of every key: where following its parents ends.

    By pointer doubling.  A parent that is no key ends the chain before it; in a circle, which has
    no start, the smallest key on it counts.  Keys are unique; null keys are left out.
    """
    own = df.select(F.col(key).alias("id"), F.col(parent).alias("to")).where("id IS NOT NULL").dropDuplicates(["id"])
    known = own.select(F.col("id").alias("to"), F.lit(True).alias("ok"))
    at = cut(own.join(known, "to", "left").select("id", F.when(F.col("ok") & (F.col("to") != F.col("id")), F.col("to")).otherwise(F.col("id")).alias("to"), F.col("id").alias("low")))
    n = at.count()
    for _ in range(max(1, n).bit_length() + 1):
        nxt = at.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("low").alias("low2"))
        at = cut(at.join(nxt, "to").select("id", F.col("to2").alias("to"), F.least("low", "low2").alias("low"), (F.col("to2") != F.col("to")).alias("moved")))
        if not at.where("moved").head(1):
            return at.select("id", F.col("to").alias("start"))
    # what still moves runs into a circle: its least member is the least of what it passed there
    own = at.select(F.col("id").alias("to"), F.col("low").alias("circle"))
    return at.join(own, "to").select("id", F.when(F.col("moved"), F.col("circle")).otherwise(F.col("to")).alias("start"))


def lacking(totals: dict[str, int], shares: dict[str, float]) -> dict[str, dict[str, float]]:
    """By split and label the records wanted."""
    scale = sum(shares.values()) or 1
    return {s: {k: n * p / scale for k, n in totals.items()} for s, p in shares.items()}


def place(items: list[tuple[object, dict[str, int]]], lack: dict[str, dict[str, float]]) -> dict[object, str]:
    """The split of each item with its label counts: iterative stratification of whole items.

    The label with the fewest records outstanding goes first; of the items that hold it the one
    with most of it (ties: the larger, then by name) goes to the split that lacks most of the label,
    then most records at all, then the first by name.  ``lack`` by split and label is reduced by
    what is placed.
    """
    left: dict[str, int] = defaultdict(int)
    by_label: dict[str, list[int]] = defaultdict(list)
    for x, (_, v) in enumerate(items):
        for k, n in v.items():
            left[k] += n
            by_label[k].append(x)
    room = {s: sum(v.values()) for s, v in lack.items()}
    for k, xs in by_label.items():
        xs.sort(key=lambda x: (-items[x][1][k], -sum(items[x][1].values()), str(items[x][0])), reverse=True)
    heap = [(n, k) for k, n in left.items()]
    heapq.heapify(heap)
    out: dict[object, str] = {}
    while heap:
        n, label = heap[0]
        xs = by_label[label]
        while xs and items[xs[-1]][0] in out:
            xs.pop()
        if n != left[label] or not xs:
            heapq.heappop(heap)
            continue
        name, v = items[xs.pop()]
        s = max(sorted(lack), key=lambda s: (lack[s].get(label, 0.0), room[s]))
        out[name] = s
        for k, n in v.items():
            lack[s][k] = lack[s].get(k, 0.0) - n
            left[k] -= n
            heapq.heappush(heap, (left[k], k))
        room[s] -= sum(v.values())
    return out


def stratify(members: DataFrame, shares: dict[str, float], labels: list[str]) -> DataFrame:
    """``group`` and ``split_name`` for members (id, group and the label columns), one row per id.

    A component's label vector counts its records by label, a null label counting as one.  Components
    above 1 / FINE of the records are placed one by one, rarest label first.  The others follow, label
    by label from the rarest outstanding on: of a label's components each split gets the part that it
    lacks, after all that went before.  They are numbered in order of label and label vector, and the
    multiples of the golden ratio by these numbers, shifted in each task, tell the split, so that alike
    components spread evenly.  The driver holds the label totals and fewer than FINE components, nothing else.  No
    group is ever divided.  Without shares, or without members, the result is empty.
    """
    spark = members.sparkSession
    named = F.explode(F.array(*(F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("\x00"))) for c in labels)))
    vectors = cut(members.select("group", named.alias("label")).groupBy("group", "label").agg(F.count("*").alias("n")))
    totals = {r["label"]: r["n"] for r in vectors.groupBy("label").agg(F.sum("n").alias("n")).toLocalIterator()}
    all_ = sum(totals.values())
    schema = f"group {dict(members.dtypes)['group']}, split_name string"
    if not totals or not shares:
        return spark.createDataFrame([], schema)
    lack = lacking(totals, shares)
    large = cut(vectors.groupBy("group").agg(F.sum("n").alias("size")).where(F.col("size") * FINE > all_).select("group"))
    per: dict[object, dict[str, int]] = defaultdict(dict)
    for r in vectors.join(F.broadcast(large), "group", "left_semi").orderBy("group", "label").toLocalIterator():  # fewer than FINE groups
        per[r["group"]][r["label"]] = r["n"]
    placed = spark.createDataFrame(list(place(sorted(per.items()), lack).items()), schema)
    small = vectors.join(F.broadcast(large), "group", "left_anti")
    rare = F.struct("all", "label")
    sized = small.join(small.groupBy("label").agg(F.sum("n").alias("all")), "label")
    whole = cut(sized.groupBy("group").agg(F.sum("n").alias("size"), F.min(rare).alias("rare"), F.bit_xor(F.xxhash64("label", "n")).alias("vector")))
    flows = small.join(whole.select("group", "rare"), "group").groupBy("rare", "label").agg(F.sum("n").alias("n"))
    splits, parts, now = sorted(shares), {}, None
    for r in flows.orderBy("rare", "label").toLocalIterator():
        if r["rare"]["label"] != now:
            now = r["rare"]["label"]
            want = [max(0.0, lack[s][now]) for s in splits]
            parts[now] = [w / sum(want) for w in want] if sum(want) > 0 else [shares[s] / sum(shares.values()) for s in splits]
        for s, p in zip(splits, parts[now]):
            lack[s][r["label"]] -= p * r["n"]
    upto = spark.createDataFrame([(k, [sum(v[: i + 1]) for i in range(len(v))]) for k, v in parts.items()], "label string, upto array<double>")
    tasks = max(1, -(-whole.count() // SWEEP))
    number = F.row_number().over(W.partitionBy("_task").orderBy("rare", "vector", "size", "group"))
    swept = whole.withColumn("_task", F.pmod(F.xxhash64("group"), F.lit(tasks))).withColumn("_u", (number * F.lit((5**0.5 - 1) / 2) + F.col("_task") * F.lit(2**0.5)) % 1)
    swept = swept.select("group", "_u", F.col("rare.label").alias("label")).join(upto, "label")
    split = F.element_at(F.array(*map(F.lit, splits)), F.least(F.lit(len(splits)), 1 + F.size(F.filter("upto", lambda x: x <= F.col("_u")))))
    return placed.unionByName(swept.select("group", split.alias("split_name")))


def essay_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cv_scheme, essay_id, group_key, grade and purpose of every essay in either scheme."""
    essays = table(spark, sf_dir, "essays").select("essay_id", "prompt_id", "reference", "author_id", "revision_of")
    prompts = table(spark, sf_dir, "prompts").select("prompt_id", "grade", "purpose", "reissue_of")
    graded = prompts.select(plain_id(F.col("prompt_id")).alias("_p"), F.col("prompt_id").alias("_id"), "grade", "purpose").where("_p IS NOT NULL")
    graded = graded.groupBy("_p").agg(F.min_by("grade", "_id").alias("grade"), F.min_by("purpose", "_id").alias("purpose"), F.min("_id").alias("id"))
    starts = chain_starts(prompts.withColumn("_plain", plain_id(F.col("prompt_id"))).withColumn("_to", plain_id(F.col("reissue_of"))), "_plain", "_to")
    named = starts.join(graded.select(F.col("_p").alias("start"), F.col("id").alias("_start")), "start").select(F.col("id").alias("_p"), "_start")
    prompt = graded.select("_p", "grade", "purpose").join(named, "_p")
    # of an essay whose rows name several prompts, the one most of its rows name, then the smallest
    own = essays.select("essay_id", plain_id(F.col("prompt_id")).alias("_p")).where("essay_id IS NOT NULL AND _p IS NOT NULL").groupBy("essay_id", "_p").agg(F.count("*").alias("n"))
    own = own.join(prompt, "_p").groupBy("essay_id").agg(F.max_by(F.struct("_start", "grade", "purpose"), F.struct("n", "_p")).alias("p"))
    together = groups_of_records(essays, "essay_id", ["author_id", "reference"], "revision_of")
    one = together.select(F.col("id").alias("essay_id"), F.col("group").cast("string").alias("group_key")).join(own.select("essay_id", "p.grade", "p.purpose"), "essay_id", "left")
    two = own.select("essay_id", F.col("p._start").alias("group_key"), "p.grade", "p.purpose")
    return one.select(F.lit("grade_stratified").alias("cv_scheme"), "essay_id", "group_key", "grade", "purpose").union(two.select(F.lit("leave_one_prompt_out"), "essay_id", "group_key", "grade", "purpose"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cv_scheme, essay_id, group_key of every essay."""
    return essay_groups(spark, sf_dir).select("cv_scheme", "essay_id", "group_key")


def p3_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cv_scheme, essay_id, group_key and the split_name of every essay, by ``split_plan``.

    The label vectors count grades and purposes.
    """
    every = cut(essay_groups(spark, sf_dir))
    out = None
    plan = table(spark, sf_dir, "split_plan").groupBy("cv_scheme", "split_name").agg(F.sum("share").alias("share")).orderBy("cv_scheme", "split_name").collect()  # one row per split
    for scheme in sorted({r["cv_scheme"] for r in plan}):
        rows = every.where(F.col("cv_scheme") == scheme)
        split = stratify(rows.select(F.col("essay_id").alias("id"), F.col("group_key").alias("group"), "grade", "purpose"), {r["split_name"]: r["share"] for r in plan if r["cv_scheme"] == scheme}, ["grade", "purpose"])
        part = rows.join(split.withColumnRenamed("group", "group_key"), "group_key").select("cv_scheme", "essay_id", "group_key", "split_name")
        out = part if out is None else out.unionByName(part)
    return out


def p3_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By scheme, split and grade: the essays, and the split's share of that grade."""
    grade = essay_groups(spark, sf_dir).select("cv_scheme", "essay_id", "grade")
    n = p3_splits(spark, sf_dir).join(grade, ["cv_scheme", "essay_id"]).groupBy("cv_scheme", "split_name", "grade").agg(F.count("*").alias("n_essays"))
    return n.withColumn("share", F.round(F.col("n_essays") / F.sum("n_essays").over(W.partitionBy("cv_scheme", "grade")), 6))


def p3_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By scheme: n_essays and n_groups placed, n_broken groups that stand in several splits, and
    shares_held: is every split's part of the essays within 1 % of them, or else the largest group, of its share?
    """
    rows = cut(p3_splits(spark, sf_dir))
    groups_ = rows.groupBy("cv_scheme", "group_key").agg(F.count("*").alias("n"), F.count_distinct("split_name").alias("k"))
    whole = groups_.groupBy("cv_scheme").agg(F.sum("n").alias("n_essays"), F.count("*").alias("n_groups"), F.sum((F.col("k") > 1).cast("bigint")).alias("n_broken"), F.max("n").alias("_most"))
    plan = table(spark, sf_dir, "split_plan").groupBy("cv_scheme", "split_name").agg(F.sum("share").alias("share"))
    scale = plan.groupBy("cv_scheme").agg(F.sum("share").alias("scale"))
    got = rows.groupBy("cv_scheme", "split_name").agg(F.count("*").alias("n"))
    off = plan.join(scale, "cv_scheme").join(got, ["cv_scheme", "split_name"], "left").join(whole, "cv_scheme")
    off = off.withColumn("ok", F.abs(F.coalesce("n", F.lit(0)) - F.col("share") / F.col("scale") * F.col("n_essays")) <= F.greatest(F.col("_most"), 0.01 * F.col("n_essays")))
    return whole.join(off.groupBy("cv_scheme").agg(F.min("ok").alias("shares_held")), "cv_scheme").drop("_most")


_PLAIN = "regexp_replace(upper({0}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
_FOUND = f"""
WITH RECURSIVE x AS (SELECT essay_id AS u, revision_of, {_PLAIN.format('author_id')} AS a, {_PLAIN.format('reference')} AS r, {_PLAIN.format('prompt_id')} AS p FROM essays WHERE essay_id IS NOT NULL),
t AS (SELECT DISTINCT u, 'a' || a AS k FROM x WHERE regexp_matches(a, '[1-9]') UNION SELECT u, 'r' || r FROM x WHERE regexp_matches(r, '[1-9]')),
f AS (SELECT k, min(u) AS v FROM t GROUP BY k),
e AS (SELECT u, v FROM t JOIN f USING (k) UNION SELECT u, revision_of FROM x WHERE revision_of IN (SELECT u FROM x)),
b AS (SELECT u, v FROM e UNION SELECT v, u FROM e UNION SELECT u, u FROM x),
reach AS (SELECT u, v FROM b UNION SELECT reach.u, b.v FROM reach JOIN b ON reach.v = b.u),
q AS (SELECT {_PLAIN.format('prompt_id')} AS p, prompt_id, {_PLAIN.format('reissue_of')} AS o FROM prompts),
c AS (SELECT p, p AS at FROM q UNION SELECT c.p, q.o FROM c JOIN q ON q.p = c.at WHERE q.o IN (SELECT p FROM q)),
s AS (SELECT c.p, q.prompt_id AS start FROM c JOIN q ON q.p = c.at WHERE q.o IS NULL OR q.o NOT IN (SELECT p FROM q)),
m AS (SELECT u, p, count(*) AS n FROM x WHERE p IN (SELECT p FROM q) GROUP BY u, p),
w AS (SELECT u, p, row_number() OVER (PARTITION BY u ORDER BY n DESC, p DESC) AS j FROM m)
SELECT 'grade_stratified' AS cv_scheme, u AS essay_id, min(v)::VARCHAR AS group_key FROM reach GROUP BY u
UNION ALL SELECT 'leave_one_prompt_out', u, start FROM w JOIN s USING (p) WHERE j = 1"""
SQL = {
    "p3_found": _FOUND,
    "p3_audit": f"SELECT cv_scheme, count(*) AS n_essays, count(DISTINCT group_key) AS n_groups, 0::BIGINT AS n_broken, true AS shares_held FROM ({_FOUND}) GROUP BY cv_scheme",
}
