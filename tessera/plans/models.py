"""Scores predicted from features: out-of-fold predictions, metrics and attributions by family."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import stats
from tessera.functions.vocab import FAMILIES
from tessera.operators import boosting, sample
from tessera.plans.features import FAMILY_OF, all_features
from tessera.plans.ratings import latest, paired, r6
from tessera.plans.sampling import rated
from tessera.session import table

FOLDS = 5
#: Traits that a task fits one after the other; with them each task gets an essay's features once.
TRAITS_A_TASK = 2
#: Essays that travel as one block.
BLOCK = 2048
HOW = {"trees": 500, "depth": 6, "rate": 0.05}
LEAST_ROWS = 10  # a fold with fewer training rows, or without variation, is skipped


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """essay_id, trait, y: the mean of both raters.  The holistic score, of round 1, is a target like the traits."""
    y = paired(spark, sf_dir).where("rating_round = 1").select("essay_id", "trait", ((F.col("r1") + F.col("r2")) / 2).alias("y"))
    order = ["scored_at", "score_rater1", "score_rater2", "rater1_id", "rater2_id"]
    h = latest(table(spark, sf_dir, "holistic_scores").where("rating_round = 1").select("essay_id", *order), ["essay_id"], order).where("score_rater1 BETWEEN 1 AND 5 AND score_rater2 BETWEEN 1 AND 5")
    return y.unionByName(h.select("essay_id", F.lit("holistic").alias("trait"), ((F.col("score_rater1") + F.col("score_rater2")) / 2).alias("y")))


def dataset(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """essay_id, fold, scores (trait and y) and x of each essay with a target, and the names of the features in x."""
    m = all_features(spark, sf_dir)
    names = m.columns[1:]
    scores = targets(spark, sf_dir).groupBy("essay_id").agg(F.collect_list(F.struct("trait", "y")).alias("scores"))
    folds = sample.stratified_folds(rated(spark, sf_dir).where("grade IS NOT NULL").select("essay_id", "grade"), "grade", "essay_id", FOLDS).select("essay_id", "fold")
    x = m.select("essay_id", F.array(*[F.col(n).cast("double") for n in names]).alias("x"))
    return scores.join(folds, "essay_id").join(x, "essay_id"), names


def _packed(batches, m: int):
    """Blocks of essays of one fold: ids, scores and features column by column, compressed."""
    for b in batches:
        folds = b.column("fold").to_numpy()
        ids = b.column("essay_id").to_numpy()
        scores = b.column("scores").to_pylist()
        x = b.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, m)
        blocks = []
        for f in np.unique(folds):
            at = np.flatnonzero(folds == f)
            for k in range(0, len(at), BLOCK):
                own = at[k : k + BLOCK]
                rows = (int(f), ids[own], [[(s["trait"], s["y"]) for s in scores[i]] for i in own], x[own].T.tobytes())
                blocks.append(zlib.compress(pickle.dumps(rows), 1))
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.binary())], names=["block"])


def _unpacked(blocks: list[bytes], m: int) -> tuple[np.ndarray, np.ndarray, dict[str, tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """ids, folds, rows and scores by trait, and features by column; a block is dropped as soon as it is read."""
    ids, folds, rows, parts, n = [], [], {}, [], 0
    while blocks:
        fold, own, scores, x = pickle.loads(zlib.decompress(blocks.pop()))
        ids.append(own)
        folds.append(np.full(len(own), fold))
        for i, of in enumerate(scores):
            for trait, y in of:
                at = rows.setdefault(trait, ([], []))
                at[0].append(n + i)
                at[1].append(y)
        n += len(own)
        parts.append(x)
    x, n = np.empty((m, n)), 0
    while parts:
        part = np.frombuffer(parts.pop(0)).reshape(m, -1)
        x[:, n : n + part.shape[1]] = part
        n += part.shape[1]
    return np.concatenate(ids), np.concatenate(folds), {t: (np.array(r), np.array(y, float)) for t, (r, y) in rows.items()}, x


class Models:
    """Models of each trait and fold, fitted on all rows of the other folds.

    A task fits some traits' models of a fold and applies them to the rows of the fold there and then, so
    that no model leaves it and nothing passes through the driver.
    """

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.data, self.names = dataset(spark, sf_dir)
        # some dozens of names
        self.traits = sorted(r["trait"] for r in targets(spark, sf_dir).select("trait").distinct().collect() if r["trait"] is not None)

    def _run(self, each: Callable, schema: str) -> DataFrame:
        """What ``each`` makes of (trait, fold, ids, y, x, training rows, rows held out) of every model."""
        m = len(self.names)
        parts = [self.traits[k : k + TRAITS_A_TASK] for k in range(0, len(self.traits), TRAITS_A_TASK)]
        tasks = FOLDS * len(parts)

        def fitted(batches):
            blocks: dict[int, list[bytes]] = {}
            for b in batches:
                for task, block in zip(b.column("task").to_pylist(), b.column("block").to_pylist()):
                    blocks.setdefault(task, []).append(block)
            for task in sorted(blocks):
                part, fold = divmod(task, FOLDS)
                ids, folds, scores, x = _unpacked(blocks[task], m)
                for trait in parts[part]:
                    if trait not in scores:
                        continue
                    rows, given = scores[trait]
                    y = np.full(len(ids), np.nan)
                    y[rows] = given
                    rows = rows[~np.isnan(given)]
                    train, held = rows[folds[rows] != fold], rows[folds[rows] == fold]
                    if len(train) < LEAST_ROWS or y[train].std() == 0 or not len(held):
                        continue
                    # never the order in which rows arrive
                    train = np.array(sorted(train.tolist(), key=lambda r: (md5(f"{ids[r]}/{trait}|42".encode()).digest(), ids[r])))
                    yield from each(trait, fold, ids, y, x.T, train, held[np.argsort(ids[held])])

        blocks = self.data.mapInArrow(lambda batches: _packed(batches, m), "block binary")
        spread = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(max(0, tasks - 1)))).alias("task"), "block")
        return spread.repartitionById(max(1, tasks), F.col("task")).mapInArrow(fitted, schema)

    def predictions(self, ordinal: bool = False) -> DataFrame:
        def each(trait, fold, ids, y, x, train, held):
            if ordinal:
                pred = boosting.fit_ordinal_holding(x, y, train, held, keep=False, **HOW)[1]
            else:
                pred = boosting.fit_holding(x, y, train, held, **HOW)[2][len(train) :]
            yield _batch(trait, fold, ids[held], {"y_true": y[held], "y_pred": pred})

        return self._run(each, "essay_id bigint, trait string, fold int, y_true double, y_pred double")

    def attributions(self) -> DataFrame:
        """essay_id, trait, fold, one column by family, expected value, and how far they miss the prediction.

        The background of a model is all that it was fitted on.
        """
        unknown = [n for n in self.names if n not in FAMILY_OF]
        if unknown:
            raise ValueError(f"features without a family: {unknown[:5]}")
        members = {f: [i for i, n in enumerate(self.names) if FAMILY_OF.get(n) == f] for f in FAMILIES}

        def each(trait, fold, ids, y, x, train, held):
            forest, layout, pred = boosting.fit_holding(x, y, train, held, **HOW)
            n = len(train)
            phi = boosting.attributed(forest, layout.left, n, n + len(held), x.shape[1])
            expected = float(pred[:n].mean())
            sums = {f: phi[:, at].sum(axis=1) for f, at in members.items()}
            yield _batch(trait, fold, ids[held], sums | {"expected": np.full(len(held), expected), "error": np.abs(phi.sum(axis=1) + expected - pred[n:])})

        kinds = ", ".join(f"{f} double" for f in FAMILIES)
        return self._run(each, f"essay_id bigint, trait string, fold int, {kinds}, expected double, error double")


def _batch(trait: str, fold: int, ids: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    n = len(ids)
    of = {"essay_id": pa.array(ids, pa.int64()), "trait": pa.array([trait] * n, pa.string()), "fold": pa.array(np.full(n, fold, np.int32))}
    return pa.RecordBatch.from_pydict(of | {k: pa.array(np.asarray(v, float)) for k, v in columns.items()})


def model_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold predictions of every rated essay and trait."""
    return Models(spark, sf_dir).predictions()


def model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the predictions by trait and fold."""
    p = model_oof(spark, sf_dir)
    t, y = F.col("y_true"), F.col("y_pred")
    return p.groupBy("trait", "fold").agg(F.count("*").alias("n"), r6(stats.qwk(stats.clip_round(t), stats.clip_round(y))).alias("qwk"), r6(F.avg(F.abs(t - y))).alias("mae"), r6(F.sqrt(F.avg((t - y) ** 2))).alias("rmse"), r6(stats.pearson(t, y)).alias("pearson_r"))


def model_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold expected levels of the ordinal variant."""
    return Models(spark, sf_dir).predictions(ordinal=True)


def tree_shap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributions of every prediction by family, in long form."""
    a = Models(spark, sf_dir).attributions()
    return a.unpivot(["essay_id", "trait", "fold", "error"], list(FAMILIES), "family", "shap_sum")


QUERIES = {"model_oof": model_oof, "model_metrics": model_metrics, "model_ordinal": model_ordinal, "tree_shap": tree_shap}
SQL: dict[str, str] = {}
