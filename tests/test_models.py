from __future__ import annotations

from hashlib import md5
from itertools import combinations
from math import factorial

import numpy as np
import pytest

from tessera.operators import boosting
from tessera.plans import models
from tessera.plans.features import all_features


def data(n=400, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 4))
    x[r.random(x.shape) < 0.1] = np.nan
    y = np.nan_to_num(x[:, 0]) * 2 + (np.nan_to_num(x[:, 1]) > 0) + r.normal(size=n) * 0.1
    return x, y


def test_fit_learns():
    x, y = data()
    f = boosting.fit(x[:300], y[:300], trees=80, depth=4, rate=0.1)
    assert np.mean((f.predict(x[300:]) - y[300:]) ** 2) < 0.25 * y.var()


def test_fit_of_little():
    assert boosting.fit(np.zeros((0, 3)), np.zeros(0)).predict(np.zeros((2, 3))).tolist() == [0, 0]
    assert np.allclose(boosting.fit(np.full((30, 2), np.nan), np.ones(30), trees=3).predict(np.zeros((1, 2))), 1)


def naive(f, x, bg):
    m = x.shape[1]
    out = np.zeros(x.shape)
    for i, row in enumerate(x):
        def v(s, row=row):
            z = bg.copy()
            z[:, list(s)] = row[list(s)]
            return f.predict(z).mean()

        for j in range(m):
            rest = [k for k in range(m) if k != j]
            for size in range(m):
                for s in combinations(rest, size):
                    out[i, j] += factorial(size) * factorial(m - size - 1) / factorial(m) * (v((*s, j)) - v(s))
    return out


def test_shapley_equals_the_definition_and_adds_up():
    x, y = data(200)
    f = boosting.fit(x, y, trees=10, depth=3, rate=0.3)
    phi, expected = boosting.shapley(f, x[:5], x[50:60])
    assert np.allclose(phi, naive(f, x[:5], x[50:60]))
    assert np.abs(phi.sum(axis=1) + expected - f.predict(x[:5])).max() < 1e-9


def test_ordinal():
    x, y = data()
    y = np.clip(np.rint(y + 3), 1, 5)
    e = boosting.expected_level(boosting.fit_ordinal(x, y, trees=30, depth=3, rate=0.2), x)
    assert e.min() >= 1 and e.max() <= 5 and np.corrcoef(e, y)[0, 1] > 0.8


def test_trees_do_not_depend_on_the_order_of_rows():
    x, y = data(300)
    y, order = np.rint(y * 2) / 2, np.random.default_rng(1).permutation(300)
    for fit, models in ((boosting.fit, lambda f: [f]), (boosting.fit_ordinal, lambda f: [m for _, m in f])):
        for a, b in zip(models(fit(x, y, trees=12, depth=5, rows=1)), models(fit(x[order], y[order], trees=12, depth=5, rows=1))):
            assert all(np.array_equal(getattr(s, k), getattr(t, k)) for s, t in zip(a.trees, b.trees) for k in ("feature", "threshold", "nan_left", "value"))


def test_histograms_hold_only_the_bins_of_each_column():
    x = np.stack([np.arange(90.0), np.repeat([0.0, 1.0, np.nan], 30), np.ones(90)], axis=1)
    h = boosting.Layout(*boosting._bins(x, 32), 32)
    assert h.size == sum(len(e) + 2 for e in h.edges) < 3 * 33 and h.missing.tolist() == [False, True, False]
    f = boosting.fit(x, np.nan_to_num(x[:, 1], nan=3.0), trees=60, rate=0.2, rows=1, columns=1)
    assert np.abs(f.predict(x) - np.nan_to_num(x[:, 1], nan=3.0)).max() < 0.1


def test_shapley_walks_each_path_once(monkeypatch):
    x, y = data(200)
    f = boosting.fit(x, y, trees=6, depth=4, rate=0.3)
    monkeypatch.setattr(boosting.Tree, "leaves", None)  # no list of conditions by leaf
    phi, expected = boosting.shapley(f, x[:40], x[50:60])
    assert np.abs(phi.sum(axis=1) + expected - f.predict(x[:40])).max() < 1e-9
    assert np.allclose(boosting.shapley(f, x[:1], x[50:60])[0], phi[:1]) and boosting.shapley(f, x[:0], x[50:60])[0].shape == (0, 4)


def test_rows_held_out_go_down_the_trees_as_they_are_predicted(monkeypatch):
    x, y = data(400)
    x[350:, 3] = np.nan
    train, held = np.arange(300)[::-1], np.arange(300, 400)
    for few in (0, 1500):  # each column alone, all at once
        monkeypatch.setattr(boosting, "FEW", few)
        f, layout, pred = boosting.fit_holding(x, y, train, held, trees=12, depth=5)
        assert np.allclose(pred, f.predict(x[np.r_[train, held]]), atol=1e-12)
        models, e = boosting.fit_ordinal_holding(x, np.clip(np.rint(y + 3), 1, 5), train, held, trees=5)
        assert np.allclose(e, boosting.expected_level(models, x[held]), atol=1e-12)
        phi = boosting.attributed(f, layout.left, 300, 400, 4)
        assert np.allclose(phi, boosting.shapley(f, x[held], x[train])[0], atol=1e-12)


def test_attributions_are_the_same_in_blocks(monkeypatch):
    x, y = data(200)
    f = boosting.fit(x, y, trees=5, depth=4)
    whole = boosting.shapley(f, x[:40], x[40:])[0]
    monkeypatch.setattr(boosting, "BLOCK", 7)
    assert np.allclose(boosting.shapley(f, x[:40], x[40:])[0], whole, atol=1e-12)


@pytest.fixture(scope="module")
def features(spark):
    m = all_features(spark, DATA).toPandas().set_index("essay_id")
    return m.astype(float)


DATA, HOW = "/root/testdata/sf0.001", {"trees": 3, "depth": 3, "rate": 0.3}


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(models, "HOW", HOW)
    # no such bound holds any more
    monkeypatch.setattr(models, "TRAIN_ROWS", 12, raising=False)
    monkeypatch.setattr(models, "BACKGROUND", 5, raising=False)


def fits(p, features):
    """(rows of the other folds in their order, rows held out) of each model in a table of predictions."""
    for (trait, fold), held in p.groupby(["trait", "fold"]):
        train = p[(p["trait"] == trait) & (p["fold"] != fold)]
        train = train.loc[sorted(train.index, key=lambda i: md5(f"{train['essay_id'][i]}/{trait}|42".encode()).digest())]
        yield features.loc[train["essay_id"]].to_numpy(), train["y_true"].to_numpy(), features.loc[held["essay_id"]].to_numpy(), held


def test_model_oof_is_fitted_on_all_rows_of_the_other_folds(spark, small, features):
    p = models.model_oof(spark, DATA).toPandas()
    assert p["trait"].nunique() == 9 and not p.duplicated(["essay_id", "trait"]).any()
    for x, y, z, held in fits(p, features):
        assert len(y) > 12 and np.allclose(boosting.fit(x, y, **HOW).predict(z), held["y_pred"])


def test_model_ordinal_is_fitted_on_all_rows_of_the_other_folds(spark, small, features):
    p = models.model_ordinal(spark, DATA).toPandas()
    assert p["trait"].nunique() == 9 and not p.duplicated(["essay_id", "trait"]).any()
    for x, y, z, held in fits(p, features):
        assert len(y) > 12 and np.allclose(boosting.expected_level(boosting.fit_ordinal(x, y, **HOW), z), held["y_pred"])


def test_tree_shap_has_all_training_rows_as_models_rows_and_background(spark, small, features):
    p = models.model_oof(spark, DATA).toPandas()
    a = models.tree_shap(spark, DATA).toPandas()
    assert a["error"].max() < 1e-9 and len(a) == 8 * len(p)
    sums = a.groupby(["trait", "essay_id"])["shap_sum"].sum()
    for x, y, z, held in fits(p, features):
        f = boosting.fit(x, y, **HOW)
        own = sums.loc[[(t, e) for t, e in zip(held["trait"], held["essay_id"])]]
        assert len(y) > 12 and np.allclose(own, f.predict(z) - f.predict(x).mean())
