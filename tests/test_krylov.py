"""Ridge by multi-shift conjugate gradients against the cross-product path."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import design as D, krylov as K, ridge as G


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(3)
    effect = {f"{p}_{r}": rng.normal(0, 0.3) for p in range(60) for r in ("off", "def")}
    rows = []
    for i in range(900):
        attack, defend = rng.choice(30, 4, False), rng.choice(30, 4, False) + 30
        tokens = [f"{p}_off" for p in attack] + [f"{p}_def" for p in defend] + ([f"ls_{i % 3}"] if i % 3 else [])
        gd, home = float(rng.integers(-2, 3)), float(i % 2)
        y = 1.2 + sum(effect.get(t, 0.2) for t in tokens) + 0.1 * gd + 0.2 * home + rng.normal(0, 0.5)
        rows.append((f"s{i}", f"m{i // 6}", float(y), float(rng.uniform(0.1, 0.6)), gd, home, tokens))
    rows += [("n", "m0", None, 1.0, 0.0, 0.0, ["0_off"]), ("e", "m1", 2.0, 0.3, 1.0, 0.0, [])]
    df = spark.createDataFrame(rows, "row_id string, match_id string, y double, weight double, gd double, home double, tokens array<string>")
    return D.Design(df.repartition(3).cache(), None, ["gd", "home"], ["ls_"])


@pytest.mark.parametrize("options", [{}, {"penalize_covariates": True}, {"use_weights": False}])
def test_same_path_as_the_cross_products(wide, options):
    a = G.fit_ridge(wide, n_lambdas=12, n_folds=4, **options)
    b = G.fit_ridge(wide, n_lambdas=12, n_folds=4, solver="krylov", **options)
    assert a.columns == b.columns and np.allclose(a.lambdas, b.lambdas, rtol=1e-9)
    assert np.abs(a.coefficients - b.coefficients).max() < 1e-6 and np.abs(a.intercepts - b.intercepts).max() < 1e-6
    assert np.allclose(a.cv_mean, b.cv_mean, rtol=1e-7) and np.allclose(a.cv_sd, b.cv_sd, rtol=1e-5)
    assert a.lambda_min == pytest.approx(b.lambda_min) and a.lambda_1se == pytest.approx(b.lambda_1se)


def test_passes_do_not_grow_with_penalties(wide):
    few = G.fit_ridge(wide, lambdas=[0.5, 0.01], n_folds=3, solver="krylov")
    many = G.fit_ridge(wide, lambdas=np.geomspace(0.5, 0.01, 60).tolist(), n_folds=3, solver="krylov")
    # sums, errors and a step for each dimension that the smallest penalty needs
    assert few.passes == many.passes < 150
    assert np.allclose(few.coefficients, many.coefficients[[0, -1]], atol=1e-8)


def test_shifted_systems_equal_direct_solutions():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(40, 25))
    a, b = a.T @ a, rng.normal(size=25)
    shifts = np.array([0.01, 0.3, 5.0, 1e6])
    system = K.Shifted(b, shifts)
    for _ in range(200):
        if system.done(1e-13):
            break
        system.step(a @ system.p)
    for x, shift in zip(system.x, shifts):
        assert np.allclose(x, np.linalg.solve(a + shift * np.eye(25), b), atol=1e-10)


def test_a_limit_on_steps_is_an_error(wide):
    rows = wide.rows.where("y is not null")
    features = G.used_features(rows)
    data = K.encoded(rows, features, [], 2)
    with pytest.raises(RuntimeError):
        K.solve_paths(data, K.moments(data, []), list(range(len(features))), [], np.array([1e-3]), most_steps=2)
