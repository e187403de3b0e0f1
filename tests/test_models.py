"""Fits on small data: bounded predictions, persistence, whole flows."""

import tempfile

from pyspark.sql import functions as F

from touchline.operators import elastic_net as E, shots as S
from touchline.operators.boosting import BoostedModel
from touchline.queries.sequences import _shot_events


def test_xg_model_round_trip(spark, data):
    shots = S.shot_features(_shot_events(spark, data))
    model = S.fit_xg(shots, n_folds=2, rounds=3, max_depth=2)
    scored = S.predict_xg(model, shots)
    low, high = scored.agg(F.min("xg"), F.max("xg")).first()
    assert 0 <= low <= high <= 1 and 1 <= model.best_rounds <= 3
    path = tempfile.mkdtemp(prefix="touchline-model-")
    model.save(path)
    again = S.predict_xg(BoostedModel.load(path), shots)
    assert abs(scored.agg(F.sum("xg")).first()[0] - again.agg(F.sum("xg")).first()[0]) < 1e-9


def test_elastic_net_finds_the_signal(spark):
    df = spark.range(400).select(
        F.col("id").alias("player_id"), F.lit(900).alias("total_minutes"),
        F.sin(F.col("id").cast("double")).alias("a_p90"), F.cos(F.col("id") * 3.7).alias("b_p90"),
        (2 * F.sin(F.col("id").cast("double")) + 0.01 * F.cos(F.col("id") * 9.1)).alias("rapm"),
    )
    fit = E.fit_elastic_net(df, n_lambdas=30, n_folds=4)
    ml = E.fit_elastic_net(df, n_lambdas=4, n_folds=2, solver="spark-ml")
    sums = E.fit_elastic_net(df, n_lambdas=4, n_folds=2)
    assert abs(ml.lambdas / sums.lambdas - 1).max() < 1e-6 and abs(ml.coefficients - sums.coefficients).max() < 1e-4 and abs(ml.r_squared - sums.r_squared) < 1e-4
    coef = dict(zip(fit.columns, fit.at("min")))
    assert abs(coef["a_p90"] - 2) < 0.1 and abs(coef["b_p90"]) < 0.05 and fit.r_squared > 0.99


def test_elastic_net_of_one_fold_and_constant_predictors(spark):
    df = spark.range(60).select(
        F.lit("p").alias("player_id"), F.lit(900).alias("total_minutes"), F.sin(F.col("id").cast("double")).alias("a_p90"),
        F.lit(3.0).alias("b_p90"), F.when(F.col("id") > 2, 2 * F.sin(F.col("id").cast("double"))).alias("rapm"),
    )
    fit = E.fit_elastic_net(df, lambdas=[0.5, 0.01], n_folds=4)
    assert fit.cv_mean is None and fit.lambda_min == 0.5
    assert fit.coefficients[:, 1].tolist() == [0.0, 0.0] and abs(fit.coefficients[1, 0] - 2) < 0.1


def test_goals_out_of_fold_keep_nothing_and_stay_in_few_partitions(spark):
    from touchline.operators import predict as P

    games = spark.range(0, 200, numPartitions=8).select(
        F.col("id").alias("match_id"), (F.col("id") % 4).alias("home_goals"), (F.col("id") % 3).alias("away_goals"),
        (F.col("id") % 7 / 3.0).alias("a"), F.when(F.col("id") % 5 > 0, F.col("id") % 11).alias("b"),
    )
    kept = spark.sparkContext._jsc.getPersistentRDDs().size()
    out = P.out_of_fold_goals(games, ["a", "b", "missing"])
    assert out.rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert out.where("pred_home_goals > 0").count() == 200 and spark.sparkContext._jsc.getPersistentRDDs().size() == kept


def test_form_means_of_one_pass_equal_means_of_filled_columns(spark):
    from touchline.operators import predict as P, rolling as RO

    rows = [(1, "A", 2.0, None), (2, "A", None, None), (3, "B", None, 7.0), (4, "B", None, None), (5, None, 5.0, 1.0), (6, None, None, None)]
    games = spark.createDataFrame(rows, "match_id int, league string, x_last_5 double, y_last_5 double")
    got = {r.match_id: (r.x_last_5, r.y_last_5) for r in P.impute_form(games).collect()}
    # x: league A has 2, so both rows of A count with it; y: B has 7
    x, y = (2 + 2 + 5) / 3, (7 + 7 + 1) / 3
    assert got == {1: (2, y), 2: (2, y), 3: (x, 7), 4: (x, 7), 5: (5, 1), 6: (x, y)}
    xg = spark.createDataFrame([(1, "A", 1.0, None), (2, "A", None, 2.0), (3, None, None, 4.0), (4, "B", None, None)], "match_id int, league string, home_xg double, away_xg double")
    assert {r.match_id: (r.home_xg, r.away_xg) for r in RO.impute_xg(xg).collect()} == {1: (1, 2), 2: (1, 2), 3: (1, 4), 4: (1, 3)}
