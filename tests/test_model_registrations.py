"""The registered model queries run the whole job: own defaults, five folds five times, rejected requests too."""

import pytest

from conftest import SF
from riskbench.catalog import model_queries as Q
from riskbench.catalog.clinical_and_contract import requests


@pytest.mark.parametrize("name", ["logreg", "svm_rbf", "mlp"])
def test_models_run_with_own_defaults_and_all_folds(spark, monkeypatch, name):
    settings, seen = [], []
    monkeypatch.setattr(Q.MD, "build", lambda name, **how: settings.append(how))
    monkeypatch.setattr(Q.H, "evaluate", lambda models, df, target, folds, threshold, about, **how: seen.append((folds, threshold, about)))
    getattr(Q, f"model_{name}")(spark, SF)
    (folds, threshold, about), = seen
    assert all(not s for s in settings) and threshold == "train" and (about["folds"], about["repeats"]) == (5, 5)
    assert folds.select("rep", "fold").distinct().count() == 25


def test_trees_run_with_own_defaults_and_all_folds(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(Q.FT, "evaluate_trees", lambda models, df, target, folds, threshold, about: seen.append((models, folds, threshold, about)))
    Q.model_trees(spark, SF)
    Q.model_boosted_trees(spark, SF)
    assert {n: (how.trees, how.depth) for models, *_ in seen for n, how in models.items()} == {"rf": (400, 6), "xgboost": (400, 3)}
    for _, folds, threshold, about in seen:
        assert threshold == "train" and (about["folds"], about["repeats"]) == (5, 5) and folds.select("rep", "fold").distinct().count() == 25


def test_arm_grid_covers_all_regimes_draws_and_folds(spark):
    cells = {(r["regime"], r["draw"], r["fold"], r["arm"]): r["auc"] for r in Q.experiment_arm_grid(spark, SF).collect()}
    assert len(cells) == 3 * 4 * 5 * 3 and all(0.4 < v <= 1 for v in cells.values())
    mean = lambda regime, arm: sum(v for k, v in cells.items() if (k[0], k[3]) == (regime, arm)) / 20
    assert mean("linear", "raw") > 0.9 and all(mean(k, "raw+products") > mean(k, "raw") - 0.01 for k in ("linear", "pairwise", "mixed"))


def test_ablation_covers_all_blocks(spark):
    out = {r["arm"]: r["increment"] for r in Q.experiment_block_ablation(spark, SF).collect()}
    assert set(out) == {"raw", "raw+singles", "raw+pairs", "raw+triples", "singles", "pairs", "triples"}
    assert out["singles"] is None and out["raw+singles"] is not None


def test_score_batch_returns_every_request(spark, monkeypatch):
    whole = Q.MD.hybrid
    monkeypatch.setattr(Q.MD, "hybrid", lambda **how: whole(**{"trees": 2} | how))
    out = Q.score_batch(spark, SF).collect()
    assert len(out) == requests(spark, SF).count() and {r["reasons"] is None for r in out} == {True, False}
