"""Whole flows: match tables to impact ratings, per season and overall."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from touchline.operators import design as D, elastic_net as E, ratings as R, segments as S
from touchline.operators.boosting import BoostedModel
from touchline.operators.boxscore import regression_data
from touchline.operators.ridge import RidgeFit, fit_ridge, fit_ridge_by, prior_offset, prior_table
from touchline.session import cut_lineage


@dataclass
class ImpactModel:
    """Every stage of an impact fit."""

    design: D.Design
    ridge: RidgeFit
    ridge_ratings: DataFrame
    box_score: RidgeFit
    box_score_ratings: DataFrame
    ratings: DataFrame
    agreement: DataFrame | None


def segments_and_players(tables: dict[str, DataFrame], **options) -> tuple[DataFrame, DataFrame]:
    """Segments and their players out of results, events, shots and lineups."""
    segments = S.build_segments(
        tables["results"], tables.get("events"), tables.get("shots"), tables.get("lineups"), tables.get("stats"), **options
    )
    segments = cut_lineage(segments)
    return segments, S.assign_players(segments, tables["lineups"])


def fit_impact(
    segments: DataFrame, players: DataFrame, features: DataFrame, min_minutes: float = 180, lam: float = 1.0, validate: bool = True
) -> ImpactModel:
    """Design, ridge, box-score model and prior-centred rating in one go."""
    design = D.design_rows(segments, players, min_minutes)
    design.rows = cut_lineage(design.rows)
    ridge = fit_ridge(design)
    # Targets are ridge coefficients by feature name, matched to players by id.
    targets = R.ridge_ratings(ridge, design.player_map)
    data = regression_data(features.withColumn("player_id", F.col("player_id").cast("string")), targets)
    box = E.fit_elastic_net(data)
    scores = E.score_players(features.withColumn("player_id", F.col("player_id").cast("string")), box)
    ratings = R.split_prior_rating(design, scores, lam)
    agreement = R.rating_agreement(ratings, targets, scores) if validate else None
    return ImpactModel(design, ridge, targets, box, scores, ratings, agreement)


def blended_scores(features: DataFrame, linear: RidgeFit, trees: BoostedModel | None, out: str, by: list[str] = []) -> DataFrame:
    """Box-score predictions, half linear and half trees when both are given."""
    scores = E.score_players(features, linear, by=by)
    if trees is not None:
        scores = E.blend_scores(scores, E.score_players_boosted(features, trees, by=by), by=by)
    return scores.withColumnRenamed("spm", out)


def seasonal_ratings(
    segments: DataFrame,
    players: DataFrame,
    season_features: DataFrame,
    offense_model: RidgeFit,
    defense_model: RidgeFit,
    offense_trees: BoostedModel | None = None,
    defense_trees: BoostedModel | None = None,
    min_minutes: float = 200,
    min_segments: int = 100,
    min_players: int = 50,
    lam: str | float = "min",
    **ridge_options,
) -> dict[str, DataFrame]:
    """Box-score, ridge and prior-based ratings of all seasons in one run.

    `season_features` holds one row per player and season (box scores or season-end skills). Seasons with few segments or rated players
    are left out. The design of all seasons is written once; one pass sums the cross products of every season for both targets,
    the plain one and what the priors leave over, and each season is solved from its sums by itself.
    """
    by = "season_end_year"
    counts = segments.groupBy(by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_segments)
    kept = segments.join(counts, by, "left_semi")
    design = D.design_rows(kept, players, min_minutes, by=[by])
    rated = design.player_map.where(F.col("player_id") != D.REPLACEMENT).groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    enough = cut_lineage(rated.where(F.col("n") >= min_players).select(by))
    player_map = design.player_map.join(enough, by, "left_semi")
    features = season_features.join(enough, by, "left_semi")
    offense = blended_scores(features, offense_model, offense_trees, "offense_spm", [by])
    defense = blended_scores(features, defense_model, defense_trees, "defense_spm", [by])
    spm = offense.join(defense.select(by, "player_id", "defense_spm"), [by, "player_id"]).withColumn("spm", F.col("offense_spm") - F.col("defense_spm"))
    prior = prior_table(R.prior_by(offense, "offense_spm", player_map, by), R.prior_by(defense, "defense_spm", player_map, by), [by])
    rows = prior_offset(design.rows.join(enough, by, "left_semi"), prior, [by]).withColumn("y_left", F.col("y") - F.col("offset"))
    fits = fit_ridge_by(D.Design(cut_lineage(rows), player_map, design.covariates, design.dummy_prefixes), by, {"plain": "y", "left": "y_left"}, lam=lam, **ridge_options)
    fits = cut_lineage(fits)
    at = lambda target: fits.where(F.col("target") == target)
    return {"spm": spm, "rapm": R.ratings_by(at("plain"), player_map, by), "xrapm": R.ratings_by(at("left"), player_map, by, prior)}
