"""Whole flows on the smallest data."""

from pyspark.sql import functions as F

from touchline.operators import elastic_net as E, value as V
from touchline.operators.segments import assign_players
from touchline.plans import action_value, impact
from touchline.queries import lineups_and_segments as LS
from touchline.queries.roles import match_events


def features(players):
    """Two rates per player and season, any numbers that differ between players."""
    return players.withColumn("season_end_year", F.explode(F.array(F.lit(1996), F.lit(1997)))).select(
        F.col("player_id").cast("string").alias("player_id"),
        F.concat(F.lit("Player "), F.col("player_id").cast("string")).alias("player_name"),
        F.lit(900.0).alias("total_minutes"),
        "season_end_year",
        F.sin(F.col("player_id") * 1.7).alias("a_p90"),
        F.cos(F.col("player_id") * 2.3).alias("b_p90"),
    )


def test_impact_per_season(spark, data):
    segments = LS.built(spark, data).where(F.col("season_end_year").isin(1996, 1997)).persist()
    players = assign_players(segments, LS.lineups(spark, data)).persist()
    table = features(players.select("player_id").distinct()).persist()
    one = table.where("season_end_year = 1996")
    model = impact.fit_impact(segments, players, one, min_minutes=100)
    assert model.ratings.count() > 0 and model.agreement.first().n_players > 0
    seasons = impact.seasonal_ratings(
        segments, players, table, model.box_score, model.box_score, min_minutes=100, min_players=3, n_folds=2, n_lambdas=5
    )
    assert seasons["xrapm"].select("season_end_year").distinct().count() == 2
    row = seasons["spm"].first()
    assert abs(row.spm - (row.offense_spm - row.defense_spm)) < 1e-12


def test_player_action_values(spark, data):
    events = match_events(spark, data)
    stream = action_value.labelled_stream(events).persist()
    model = V.fit_value_model(stream, n_folds=2, rounds=2, max_depth=2)
    shares = V.predict_values(model, stream).agg(
        F.max(F.abs(F.col("p_team_scores") + F.col("p_opponent_scores") + F.col("p_nobody_scores") - 1))
    ).first()[0]
    assert shares < 1e-9
    values = action_value.player_action_values(events, model)
    assert values.count() > 0 and "epv_total" in values.columns
