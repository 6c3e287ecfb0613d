"""Consensus of several annotators' labels (problem 4).

A label on an ordered scale depends on the item's true level, the item's difficulty and the
annotator's ability and severity.  Gradient expectation-maximisation learns all of them jointly:
given abilities, each item's posterior and difficulty follow from its own labels; given
posteriors, each annotator takes a scoring step from sums over their labels, until no ability moves.
An ability about 0 tells nothing, one below 0 is contrary; one who always gives the same label gets
the ability at which labels err as much as the levels vary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import cut, table

LEVELS = np.arange(1, 6, dtype=np.float64)
ROUNDS, INNER = 60, 2  # at most, of the annotators' and, in each, of the items' steps
TOLERANCE = 0.01  # the largest move of an ability at which the rounds end
ABILITY_SD, SEVERITY_SD, DIFFICULTY_SD = 1.0, 1.0, 0.5  # of the priors
CHUNK = 50_000  # labels in a numpy batch
#: Annotators whose parameters are broadcast and kept on the driver (some 50 MB); beyond, they are joined by a shuffle.
BROADCAST_RATERS = 500_000
#: A rater is of no use whose ability lies, with this margin of standard errors, below USABLE times that
#: of one who always gives the same label.  Raters of fewer than LEAST labels that others' can be compared with aren't judged.
USABLE, MARGIN, LEAST = 1.5, 2.0, 20


def likelihood(y, ability, severity, easiness):
    """log P(label | level), and moments of the half squared distance under it, by label and level."""
    s = (ability * easiness)[:, None, None]
    half = (LEVELS[None, None, :] - severity[:, None, None] - LEVELS[None, :, None]) ** 2 / 2  # label, level, outcome
    w = -s * half
    w -= w.max(axis=2, keepdims=True)
    p = np.exp(w)
    norm = p.sum(axis=2, keepdims=True)
    p /= norm
    at = (np.arange(len(y)), slice(None), y - 1)
    logp = w[at] - np.log(norm[:, :, 0])
    mean = (p * half).sum(axis=2)
    slope = mean - half[at]  # d log P / d s
    info = (p * half**2).sum(axis=2) - mean**2
    k = (p * LEVELS).sum(axis=2)
    pull = LEVELS[y - 1][:, None] - k  # d log P / d severity, over s
    spread = (p * LEVELS**2).sum(axis=2) - k**2
    return logp, slope, info, pull, spread


def items_step(item: np.ndarray, n: int, y, ability, severity, prior):
    """Posterior and easiness of n items from their labels, and the moments at the end."""
    logeasy = np.zeros(n)
    for step in range(INNER + 1):
        easy = np.exp(logeasy)[item]
        logp, slope, info, pull, spread = likelihood(y, ability, severity, easy)
        post = np.tile(np.log(prior), (n, 1))
        np.add.at(post, item, logp)
        post -= post.max(axis=1, keepdims=True)
        raw = post.copy()
        post = np.exp(post)
        post /= post.sum(axis=1, keepdims=True)
        if step < INNER:
            s = ability * easy
            g = np.bincount(item, s * (post[item] * slope).sum(axis=1), n) - logeasy / DIFFICULTY_SD**2
            h = np.bincount(item, s**2 * (post[item] * info).sum(axis=1), n) + 1 / DIFFICULTY_SD**2
            logeasy = np.clip(logeasy + np.clip(g / h, -1, 1), -2, 2)
    return post, raw, logeasy, (logp, slope, info, pull, spread)


def _chunks(batches):
    """Columns of whole items: rows come sorted by essay_id and trait."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size < CHUNK:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        e, tr = t.column("essay_id"), t.column("trait")
        last = (e[size - 1].as_py(), tr[size - 1].as_py())
        x = size
        while x and (e[x - 1].as_py(), tr[x - 1].as_py()) == last:
            x -= 1
        if x:
            yield t.slice(0, x)
        rest = t.slice(x)
        held, size = rest.to_batches(), rest.num_rows
    if size:
        yield pa.Table.from_batches(held).combine_chunks()


def _items(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Where each item begins, and the item of each label."""
    e = t.column("essay_id").to_numpy()
    tr = t.column("trait").to_numpy(zero_copy_only=False)
    new = np.r_[True, (e[1:] != e[:-1]) | (tr[1:] != tr[:-1])]
    return np.flatnonzero(new), np.cumsum(new) - 1


def _joined(batches):
    """(essay ids, traits, item, raters, who, label, ability, severity) of labels with their raters' parameters."""
    for t in _chunks(batches):
        first, item = _items(t)
        raters, who = np.unique(t.column("rater_id").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
        keys = t.select(["essay_id", "trait"]).take(pa.array(first))
        columns = (t.column(c).to_numpy().astype(float) for c in ("ability", "severity"))
        yield keys.column(0).combine_chunks(), keys.column(1).combine_chunks(), item, raters, who, t.column("score").to_numpy().astype(np.int64), *columns


def _packed(batches):
    """Whole items of sorted labels with numbered raters, CHUNK labels to a row."""
    for t in _chunks(batches):
        first, item = _items(t)
        keys = t.select(["essay_id", "trait"]).take(pa.array(first))
        lists = [keys.column(0), keys.column(1), item.astype(np.int32), t.column("rater"), t.column("score")]
        yield pa.RecordBatch.from_arrays([pa.array([x.to_pylist() if isinstance(x, pa.ChunkedArray) else x], pa.list_(k)) for x, k in zip(lists, (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()))], names=["essay_id", "trait", "item", "rater", "score"])


def _unpacked(batches, ability: np.ndarray, severity: np.ndarray):
    """What :func:`_joined` gives, of packed labels; the parameters are looked up by the raters' numbers."""
    for b in batches:
        for x in range(b.num_rows):
            essay, trait, item, rater, score = (b.column(c)[x].values for c in range(5))
            raters, who = np.unique(rater.to_numpy(), return_inverse=True)
            yield essay, trait, item.to_numpy(), raters, who, score.to_numpy().astype(np.int64), ability[raters][who], severity[raters][who]


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """essay_id, trait (holistic as ``_holistic``), rater_id, score of all valid labels of all rounds.

    Scores off the scale, null scores, and labels without rater or essay are left out; of a
    rater's labels of the same item the last round's, then the last scored, counts.
    """
    cols = ["essay_id", "trait", "rating_round", "scored_at", "score_rater1", "score_rater2", "rater1_id", "rater2_id"]
    t = table(spark, sf_dir, "trait_scores").select(*cols)
    h = table(spark, sf_dir, "holistic_scores").withColumn("trait", F.lit("_holistic")).select(*cols)
    both = t.unionByName(h).select("essay_id", F.coalesce("trait", F.lit("")).alias("trait"), "rating_round", "scored_at", F.inline(F.array(F.struct(F.col("rater1_id").alias("rater_id"), F.col("score_rater1").alias("score")), F.struct(F.col("rater2_id").alias("rater_id"), F.col("score_rater2").alias("score")))))
    return one_each(both.where("essay_id IS NOT NULL AND rater_id IS NOT NULL AND score BETWEEN 1 AND 5"))


def one_each(rows: DataFrame) -> DataFrame:
    return rows.groupBy("essay_id", "trait", "rater_id").agg(F.max_by("score", F.struct("rating_round", "scored_at", "score")).alias("score"))


class Fit:
    """Abilities and severities of the raters of labels (essay_id, trait, rater_id, score).

    An item's labels are at most one by rater; they are partitioned by essay and stay where they
    are from round to round, only sums by rater are shuffled.  ``rounds`` tells how many were taken.
    """

    def __init__(self, rows: DataFrame, rounds: int = ROUNDS) -> None:
        obs = cut(rows.repartition("essay_id").sortWithinPartitions("essay_id", "trait", "rater_id"))
        shares = {r["score"]: r["n"] for r in obs.groupBy("score").agg(F.count("*").alias("n")).collect()}  # five rows
        counts = np.array([shares.get(int(k), 0) + 1.0 for k in LEVELS])
        self.prior = counts / counts.sum()
        self.spark, self.rounds = rows.sparkSession, 0
        raters = obs.select("rater_id").distinct()
        self.many = raters.count() > BROADCAST_RATERS
        if self.many:
            self.obs = obs
            self.raters = cut(raters.withColumn("ability", F.lit(1.0)).withColumn("severity", F.lit(0.0)))
        else:
            self.ids = sorted(r[0] for r in raters.collect())  # at most BROADCAST_RATERS
            self.ability, self.severity = np.ones(len(self.ids)), np.zeros(len(self.ids))
            numbered = self.spark.createDataFrame(list(zip(self.ids, range(len(self.ids)))), "rater_id string, rater int")
            numbered = obs.join(F.broadcast(numbered), "rater_id").select("essay_id", "trait", "rater", "score").sortWithinPartitions("essay_id", "trait", "rater")
            self.obs = cut(numbered.mapInArrow(_packed, "essay_id array<bigint>, trait array<string>, item array<int>, rater array<int>, score array<int>"))
        while self.rounds < rounds:
            self.rounds += 1
            if self._round() < TOLERANCE:
                break

    def _map(self, run, schema: str) -> DataFrame:
        """``run`` on the parts of all labels; ``rater`` in the schema is the raters' key."""
        if self.many:
            rows = self.obs.join(self.raters, "rater_id").repartition("essay_id").sortWithinPartitions("essay_id", "trait", "rater_id").select("essay_id", "trait", "rater_id", "score", "ability", "severity")
            return rows.mapInArrow(lambda batches: run(_joined(batches)), schema.replace("rater key", "rater string"))
        held = self.spark.sparkContext.broadcast((self.ability, self.severity))
        return self.obs.mapInArrow(lambda batches: run(_unpacked(batches, *held.value)), schema.replace("rater key", "rater int"))

    def _round(self) -> float:
        """Take one step of all raters; the largest move of an ability."""
        prior, sums = self.prior, ("ga", "ha", "gb", "hb")

        def run(parts):
            for essay, _, item, raters, who, y, a, b in parts:
                post, _, logeasy, (_, slope, info, pull, spread) = items_step(item, len(essay), y, a, b, prior)
                p, easy = post[item], np.exp(logeasy)[item]
                s = a * easy
                each = (easy * (p * slope).sum(1), easy**2 * (p * info).sum(1), s * (p * pull).sum(1), s**2 * (p * spread).sum(1))
                yield pa.RecordBatch.from_arrays([pa.array(raters), *(pa.array(np.bincount(who, x, len(raters))) for x in each)], names=["rater", *sums])

        total = self._map(run, "rater key, ga double, ha double, gb double, hb double").groupBy("rater").agg(*(F.sum(c).alias(c) for c in sums))
        steps = (("ability", "ga", "ha", 1.0, ABILITY_SD, 6.0), ("severity", "gb", "hb", 0.0, SEVERITY_SD, 2.5))
        if not self.many:
            got = total.toPandas()
            at = got["rater"].to_numpy().astype(np.int64)
            before = self.ability.copy()
            for name, g, h, mean, sd, most in steps:
                x = getattr(self, name)
                move = (got[g].to_numpy() - (x[at] - mean) / sd**2) / (got[h].to_numpy() + 1 / sd**2)
                x[at] = np.clip(x[at] + np.clip(move, -0.7, 0.7), -most, most)
            return float(np.abs(self.ability - before).max(initial=0.0))

        def step(x: str, g: str, h: str, mean: float, sd: float, most: float):
            move = (F.col(g) - (F.col(x) - mean) / sd**2) / (F.col(h) + 1 / sd**2)
            return F.least(F.lit(most), F.greatest(F.lit(-most), F.col(x) + F.least(F.lit(0.7), F.greatest(F.lit(-0.7), move)))).alias(x)

        moved = cut(self.raters.join(total.withColumnRenamed("rater", "rater_id"), "rater_id").select("rater_id", *(step(*x) for x in steps), F.col("ability").alias("_old")))
        self.raters = moved.drop("_old")
        return moved.agg(F.max(F.abs(F.col("ability") - F.col("_old")))).first()[0] or 0.0

    def consensus(self) -> DataFrame:
        """essay_id, trait, n_labels, consensus (the likeliest level), expected, certainty, difficulty."""
        prior = self.prior

        def run(parts):
            for essay, trait, item, _, _, y, a, b in parts:
                post, _, logeasy, _ = items_step(item, len(essay), y, a, b, prior)
                best = post.argmax(axis=1)
                out = [essay, trait, pa.array(np.bincount(item, minlength=len(essay)).astype(np.int32)), pa.array((best + 1).astype(np.int32)), pa.array(post @ LEVELS), pa.array(post[np.arange(len(best)), best]), pa.array(-logeasy)]
                yield pa.RecordBatch.from_arrays(out, names=["essay_id", "trait", "n_labels", "consensus", "expected", "certainty", "difficulty"])

        return self._map(run, "essay_id bigint, trait string, n_labels int, consensus int, expected double, certainty double, difficulty double")

    def reliability(self) -> DataFrame:
        """rater_id, n_labels, n_compared, ability, error, severity, reliability, same_share, usable.

        ``usable`` follows from the learned ability and its standard error alone.  ``error`` is that
        standard error; reliability is the correlation of a rater's labels with the levels expected from
        the others' labels of the same items, null where nothing can be compared, or nothing varies.
        """
        prior = self.prior
        sums = ["n", "x", "y", "xx", "yy", "xy", "ha"]
        hist = [f"l{int(k)}" for k in LEVELS]

        def run(parts):
            for essay, _, item, raters, who, y, a, b in parts:
                post, raw, logeasy, (logp, _, info, *_) = items_step(item, len(essay), y, a, b, prior)
                rest = raw[item] - logp
                rest = np.exp(rest - rest.max(axis=1, keepdims=True))
                e = (rest / rest.sum(axis=1, keepdims=True)) @ LEVELS
                ok = (np.bincount(item)[item] > 1).astype(float)
                v = y.astype(float)
                known = np.exp(logeasy)[item] ** 2 * (post[item] * info).sum(1)
                cols = [np.bincount(who, z, len(raters)) for z in (ok, ok * v, ok * e, ok * v * v, ok * e * e, ok * v * e, known)]
                cols += [np.bincount(who, y == k, len(raters)) for k in LEVELS]
                yield pa.RecordBatch.from_arrays([pa.array(raters), *(pa.array(c.astype(float)) for c in cols)], names=["rater", *sums, *hist])

        g = self._map(run, "rater key, " + ", ".join(f"{c} double" for c in sums + hist)).groupBy("rater").agg(*(F.sum(c).alias(c) for c in sums + hist))
        if self.many:
            g = g.withColumnRenamed("rater", "rater_id").join(self.raters, "rater_id")
        else:  # at most BROADCAST_RATERS
            rows = list(zip(self.ids, range(len(self.ids)), self.ability.tolist(), self.severity.tolist()))
            g = g.join(F.broadcast(self.spark.createDataFrame(rows, "rater_id string, rater int, ability double, severity double")), "rater")
        n = F.col("n")
        cov = n * F.col("xy") - F.col("x") * F.col("y")
        var = (n * F.col("xx") - F.col("x") ** 2) * (n * F.col("yy") - F.col("y") ** 2)
        r = F.when(var > 1e-9, F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cov / F.sqrt(F.greatest(var, F.lit(1e-9))))))
        given = sum((F.col(c) for c in hist), F.lit(0.0))
        error = 1 / F.sqrt(F.col("ha") + 1 / ABILITY_SD**2)
        spread = float((prior * LEVELS**2).sum() - (prior * LEVELS).sum() ** 2)
        usable = (n < LEAST) | (F.col("ability") + MARGIN * error >= USABLE / spread)
        return g.select("rater_id", given.cast("bigint").alias("n_labels"), n.cast("bigint").alias("n_compared"), "ability", error.alias("error"), "severity", r.alias("reliability"), (F.greatest(*hist) / given).alias("same_share"), usable.alias("usable"))


def agreement(rows: DataFrame) -> DataFrame:
    """By trait: n_items with several labels, and Krippendorff's alpha for interval data.

    Both disagreements come from sums and squares, so no labels are paired; null where the labels
    don't vary.
    """
    x = F.col("score").cast("double")
    items = rows.groupBy("trait", "essay_id").agg(F.count("*").alias("m"), F.sum(x).alias("s"), F.sum(x * x).alias("q")).where("m > 1")
    g = items.groupBy("trait").agg(F.count("*").alias("n_items"), F.sum("m").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum((F.col("m") * F.col("q") - F.col("s") ** 2) / (F.col("m") - 1)).alias("within"))
    total = (F.col("n") * F.col("q") - F.col("s") ** 2) / (F.col("n") - 1)
    return g.select("trait", "n_items", F.col("n").alias("n_labels"), F.round(F.when(total > 0, 1 - F.col("within") / total), 6).alias("alpha"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rater_id of the raters whose labels tell nothing usable."""
    return Fit(labels(spark, sf_dir)).reliability().where("NOT usable").select("rater_id")


def p4_raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ability, severity and reliability of every rater."""
    return Fit(labels(spark, sf_dir)).reliability()


def p4_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consensus level of every essay and trait."""
    return Fit(labels(spark, sf_dir)).consensus()


def p4_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chance-corrected agreement by trait, over the labels of all rounds."""
    return agreement(labels(spark, sf_dir))


SQL = {
    "p4_agreement": """
WITH b AS (SELECT essay_id, trait, rating_round, scored_at, score_rater1 AS score, rater1_id AS rater_id FROM trait_scores
  UNION ALL SELECT essay_id, trait, rating_round, scored_at, score_rater2, rater2_id FROM trait_scores
  UNION ALL SELECT essay_id, '_holistic', rating_round, scored_at, score_rater1, rater1_id FROM holistic_scores
  UNION ALL SELECT essay_id, '_holistic', rating_round, scored_at, score_rater2, rater2_id FROM holistic_scores),
r AS (SELECT essay_id, coalesce(trait, '') AS trait, rater_id, score, row_number() OVER (PARTITION BY essay_id, coalesce(trait, ''), rater_id ORDER BY rating_round DESC NULLS LAST, scored_at DESC NULLS LAST, score DESC) AS k
  FROM b WHERE essay_id IS NOT NULL AND rater_id IS NOT NULL AND score BETWEEN 1 AND 5),
i AS (SELECT trait, essay_id, count(*) AS m, sum(score::DOUBLE) AS s, sum(score::DOUBLE * score) AS q FROM r WHERE k = 1 GROUP BY ALL HAVING count(*) > 1),
g AS (SELECT trait, count(*) AS n_items, sum(m)::BIGINT AS n, sum(s) AS s, sum(q) AS q, sum((m * q - s * s) / (m - 1)) AS w FROM i GROUP BY trait)
SELECT trait, n_items, n AS n_labels, round(CASE WHEN n * q - s * s > 0 THEN 1 - w / ((n * q - s * s) / (n - 1)) END, 6) AS alpha FROM g""",
}
