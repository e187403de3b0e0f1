import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import design as D, ratings as R, ridge as G


@pytest.fixture(scope="module")
def design(spark):
    rng = np.random.default_rng(1)
    effect = {f"{p}_{r}": rng.normal(0, 0.3) for p in range(12) for r in ("off", "def")}
    rows = []
    for i in range(600):
        attack, defend = rng.choice(6, 4, False), rng.choice(6, 4, False) + 6
        tokens = [f"{p}_off" for p in attack] + [f"{p}_def" for p in defend]
        gd = float(rng.integers(-2, 3))
        y = 1.2 + sum(effect[t] for t in tokens) + 0.1 * gd + rng.normal(0, 0.5)
        rows.append((f"s{i}:home", f"s{i}", f"m{i // 6}", float(y), float(rng.uniform(0.1, 0.6)), gd, tokens))
    df = spark.createDataFrame(rows, "row_id string, segment_id string, match_id string, y double, weight double, gd double, tokens array<string>").cache()
    pool = spark.createDataFrame([(str(p), f"Player {p}", 900.0) for p in range(12)], "player_id string, player_name string, total_minutes double")
    return D.Design(df, pool, ["gd"], [])


def closed_form(design, lam, columns, free):
    pdf = design.rows.toPandas()
    x = np.array([[float(c in t) if c != "gd" else g for c in columns] for t, g in zip(pdf.tokens, pdf.gd)])
    w = pdf.weight.to_numpy() / pdf.weight.sum()
    y = pdf.y.to_numpy()
    xc, yc = x - w @ x, y - w @ y
    scale = len(columns) / (len(columns) - len(free))
    penalty = [0.0 if c in free else lam * scale / np.sqrt(w @ yc**2) for c in columns]
    return np.linalg.solve(xc.T @ (xc * w[:, None]) + np.diag(penalty), xc.T @ (w * yc))


def test_closed_form_and_wide_path(design):
    fit = G.fit_ridge(design, n_lambdas=15, n_folds=4)
    want = closed_form(design, fit.lambda_min, fit.columns, fit.covariates)
    assert np.abs(fit.at("min") - want).max() < 1e-10
    assert fit.lambda_1se >= fit.lambda_min
    wide = G.fit_ridge(design, lambdas=[0.05], n_folds=2, solver="l-bfgs")
    narrow_path = G.fit_ridge(design, n_lambdas=3, n_folds=2)
    wide_path = G.fit_ridge(design, n_lambdas=3, n_folds=2, solver="l-bfgs")
    assert np.allclose(narrow_path.lambdas, wide_path.lambdas, rtol=1e-9)
    assert np.abs(wide.at(0.05) - closed_form(design, 0.05, wide.columns, wide.covariates)).max() < 1e-5


def test_ratings_are_offense_minus_defense(design):
    fit = G.fit_ridge(design, n_lambdas=5, n_folds=3)
    rows = R.ridge_ratings(fit, design.player_map).collect()
    assert all(r.offense is None or r.defense is None or abs(r.rapm - (r.offense - r.defense)) < 1e-12 for r in rows)
    assert [c[0] for c in R.covariate_effects(fit).collect()] == ["gd"]


def test_prior_plus_deviation_and_stronger_penalty(spark, design):
    prior = spark.createDataFrame([(f"{p}_off", 0.2) for p in range(6)], "feature string, prior double")
    far = G.fit_ridge_with_prior(design, prior, lambdas=[0.01], n_folds=2)
    near = G.fit_ridge_with_prior(design, prior, lambdas=[10.0], n_folds=2)
    rows = R.prior_ratings(far, design.player_map, 0.01).collect()
    assert all(abs(r.offense - (r.off_prior + r.off_deviation)) < 1e-12 for r in rows if r.offense is not None)
    n = len(far.features)
    assert np.abs(near.at(10.0)[:n]).sum() < np.abs(far.at(0.01)[:n]).sum()


def test_season_filter(spark, design):
    matches = spark.createDataFrame([("m0", "2023-2024"), ("m1", "2024-2025")], "match_id string, season string")
    assert D.filter_seasons(design, matches, ["2024-2025"]).rows.count() == 6


def test_absolute_penalty_silences_features(design):
    some = G.fit_ridge(design, lambdas=[0.05], n_folds=2, alpha=1.0)
    none = G.fit_ridge(design, n_lambdas=2, n_folds=2, alpha=1.0)
    n = len(some.features)
    assert 0 < (np.abs(some.coefficients[0][:n]) > 1e-9).sum() < n
    assert np.abs(none.coefficients[0][:n]).max() < 1e-3 < np.abs(none.coefficients[-1][:n]).max()
