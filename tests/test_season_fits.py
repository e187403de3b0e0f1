"""All seasons in one run against one fit a season."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import design as D, elastic_net as E, ratings as R, ridge as G
from touchline.operators.segments import assign_players
from touchline.plans import impact
from touchline.queries import lineups_and_segments as LS


@pytest.fixture(scope="module")
def inputs(spark, data):
    segments = LS.built(spark, data).where(F.col("season_end_year").isin(1995, 1996, 1997)).persist()
    players = assign_players(segments, LS.lineups(spark, data)).persist()
    ids = players.select("player_id").distinct()
    features = ids.withColumn("season_end_year", F.explode(F.array(*map(F.lit, (1995, 1996, 1997))))).select(
        F.col("player_id").cast("string").alias("player_id"), F.concat(F.lit("Player "), F.col("player_id").cast("string")).alias("player_name"),
        F.lit(900.0).alias("total_minutes"), "season_end_year",
        F.sin(F.col("player_id") * 1.7 + F.col("season_end_year")).alias("a_p90"), F.cos(F.col("player_id") * 2.3).alias("b_p90"),
    )
    model = G.RidgeFit(["a_p90", "b_p90"], [], np.array([0.1]), np.array([[0.3, -0.2]]), np.array([0.05]), None, None)
    return segments, players, features.persist(), model


def one_season(inputs, season, **options):
    segments, players, features, model = inputs
    own = segments.where(F.col("season_end_year") == season)
    design = D.design_rows(own, players.join(own.select("segment_id"), "segment_id", "left_semi"), 100)
    scores = E.score_players(features.where(F.col("season_end_year") == season), model)
    prior = R.build_prior(scores, "spm", design.player_map)
    plain = R.ridge_ratings(G.fit_ridge(design, **options), design.player_map)
    left = R.prior_ratings(G.fit_ridge_with_prior(design, G.prior_table(prior, prior), **options), design.player_map)
    return plain, left


def close(a, b, columns):
    key = lambda rows: {r.player_id: tuple(r[c] for c in columns) for r in rows}
    a, b = key(a), key(b)
    assert a.keys() == b.keys() and len(a) > 0
    for k in a:
        for x, y in zip(a[k], b[k]):
            assert x == y or x == pytest.approx(y, abs=1e-9), (k, a[k], b[k])


def test_three_seasons_equal_three_fits(inputs, monkeypatch):
    segments, players, features, model = inputs
    calls = []
    sums = G.gram_sums
    monkeypatch.setattr(G, "gram_sums", lambda *a, **b: calls.append(b.get("by")) or sums(*a, **b))
    options = {"n_folds": 2, "n_lambdas": 4}
    got = impact.seasonal_ratings(segments, players, features, model, model, min_minutes=100, min_segments=1, min_players=3, **options)
    assert calls == [["season_end_year"]]  # one pass for the sums
    monkeypatch.undo()
    plain, left = got["rapm"].collect(), got["xrapm"].collect()
    assert {r.season_end_year for r in plain} == {1995, 1996, 1997} == {r.season_end_year for r in got["spm"].select("season_end_year").collect()}
    for season in (1996,):
        want_plain, want_left = one_season(inputs, season, **options)
        own = lambda rows: [r for r in rows if r.season_end_year == season]  # noqa: B023
        close(own(plain), want_plain.collect(), ["offense", "defense", "rapm", "player_name", "total_minutes"])
        close(own(left), want_left.collect(), ["offense", "defense", "xrapm", "off_prior", "def_deviation"])


def test_seasons_without_enough_data_are_left_out(inputs):
    segments, players, features, model = inputs
    sizes = {r[0]: r[1] for r in segments.groupBy("season_end_year").count().collect()}
    few = min(sizes, key=sizes.get)
    got = impact.seasonal_ratings(segments, players, features, model, model, min_minutes=100, min_segments=sizes[few] + 1, min_players=3, lambdas=[0.5], n_folds=2)
    assert few not in {r.season_end_year for r in got["rapm"].collect()}
    none = impact.seasonal_ratings(segments, players, features, model, model, min_minutes=100, min_players=10**6, lambdas=[0.5], n_folds=2)
    assert all(df.count() == 0 for df in none.values())


def test_prior_by_name_where_no_id_matches(spark):
    pool = spark.createDataFrame([(1, "1", "A"), (1, "2", "B"), (2, "1", "A")], "s int, player_id string, player_name string")
    scores = spark.createDataFrame([(1, "1", "x", 5.0), (2, "9", "A", 7.0)], "s int, player_id string, player_name string, spm double")
    got = {(r.s, r.player_id): r.prior for r in R.prior_by(scores, "spm", pool, "s").collect()}
    assert got == {(1, "1"): 5.0, (1, "2"): 0.0, (2, "1"): 7.0}
