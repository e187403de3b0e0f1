"""Rates per 100 team sequences, shrinkage and finishing."""

from pyspark.sql import DataFrame, functions as F

from touchline.constants import (
    FINISHING_PRIOR,
    MIN_GAMES_FOR_PADDING,
    MIN_MINUTES_FEATURES,
    MIN_SEQUENCES_PER_MATCH,
    MIN_SHOTS_FOR_FINISHING,
    TOUCHES_PER_SEQUENCE,
)
from touchline.functions.numeric import safe_divide

# Statistics turned into rates, and the offensive and defensive picks.
RATE_STATS = [
    "gls", "ast", "sh", "so_t", "x_g", "npx_g", "x_ag", "touches", "tkl", "int", "blocks", "sca",
    "gca", "cmp", "prg_p", "carries", "prg_c",
]
OFFENSIVE_RATES = [
    "gls_p100", "x_g_p100", "npx_g_p100", "sh_p100", "so_t_p100", "ast_p100", "x_ag_p100",
    "sca_p100", "gca_p100", "prg_p_p100", "prg_c_p100", "carries_p100",
]
DEFENSIVE_RATES = ["tkl_p100", "int_p100", "blocks_p100", "tkl_won_p100", "clr_p100"]


def team_sequences(stats: DataFrame) -> DataFrame:
    """Touches per match and team, and the sequences they suggest (at least the minimum)."""
    teams = stats.groupBy("match_id", "team", "is_home").agg(
        F.coalesce(F.sum("touches"), F.lit(0)).cast("double").alias("total_touches")
    )
    sequences = F.greatest(F.lit(float(MIN_SEQUENCES_PER_MATCH)), F.col("total_touches") / TOUCHES_PER_SEQUENCE)
    return teams.withColumn("estimated_sequences", sequences)


def per_100_sequences(stats: DataFrame, sequences: DataFrame, columns: list[str] | None = None) -> DataFrame:
    columns = columns or [c for c in RATE_STATS if c in stats.columns]
    joined = stats.join(sequences.select("match_id", "team", "estimated_sequences"), ["match_id", "team"], "left")
    return joined.withColumns({f"{c}_p100": safe_divide(F.col(c) * 100, "estimated_sequences") for c in columns})


def finishing(shots: DataFrame, min_shots: int = MIN_SHOTS_FOR_FINISHING) -> DataFrame:
    """Goals over chances without penalties, for players with enough shots."""
    totals = (
        shots.where(~F.col("is_penalty"))
        .groupBy("player_name")
        .agg(
            F.count(F.lit(1)).alias("total_shots"),
            F.count_if(F.col("is_goal")).alias("total_goals"),
            F.coalesce(F.sum("xg"), F.lit(0.0)).alias("total_xg"),
        )
        .where(F.col("total_shots") >= min_shots)
    )
    return totals.withColumns(
        {
            "goals_minus_xg": F.col("total_goals") - F.col("total_xg"),
            "finishing_modifier": (F.col("total_goals") + FINISHING_PRIOR) / (F.col("total_xg") + FINISHING_PRIOR),
        }
    )


def non_penalty_xg(shots: DataFrame) -> DataFrame:
    """Chances, goals and shots without penalties per match, team and player."""
    return shots.where(~F.col("is_penalty")).groupBy("match_id", "team", "player_name").agg(
        F.coalesce(F.sum("xg"), F.lit(0.0)).alias("npxg"),
        F.count_if(F.col("is_goal")).alias("npg"),
        F.count(F.lit(1)).alias("np_shots"),
    )


def _picked(stats: DataFrame, rates: list[str]) -> DataFrame:
    present = [c for c in rates if c in stats.columns]
    if not present:
        return stats
    return stats.select(*[c for c in ("match_id", "team", "player_name") if c in stats.columns], *present)


def offensive_rates(stats: DataFrame) -> DataFrame:
    return _picked(stats, OFFENSIVE_RATES)


def defensive_rates(stats: DataFrame) -> DataFrame:
    return _picked(stats, DEFENSIVE_RATES)


def pad_to_mean(
    df: DataFrame, columns: list[str], min_games: float = MIN_GAMES_FOR_PADDING, games: str = "n_games"
) -> DataFrame:
    """Blend towards the population mean below `min_games`."""
    present = [c for c in columns if c in df.columns]
    if games not in df.columns or not present:
        return df
    means = df.agg(F.struct(*[F.avg(c).alias(c) for c in present])).scalar()
    weight = F.least(F.col(games) / F.lit(float(min_games)), F.lit(1.0))
    padded = df.withColumn("_means", means)
    blend = {
        c: F.when(
            F.col(f"_means.{c}").isNotNull(), weight * F.col(c) + (1 - weight) * F.col(f"_means.{c}")
        ).otherwise(F.col(c))
        for c in present
    }
    return padded.withColumns(blend).drop("_means")


def season_games(
    stats: DataFrame, rate_columns: list[str] = (), count_columns: list[str] = (), with_totals: bool = False
) -> DataFrame:
    """Games per player and team; totals and means too when asked for."""
    extra = []
    if with_totals:
        extra += [F.sum(c).alias(f"{c}_total") for c in count_columns if c in stats.columns]
        extra += [F.avg(c).alias(f"{c}_avg") for c in rate_columns if c in stats.columns]
    return stats.groupBy("player_name", "team").agg(F.count(F.lit(1)).alias("n_games"), *extra)


def player_rate_matrix(stats: DataFrame, min_minutes: float = MIN_MINUTES_FEATURES) -> DataFrame:
    """Mean rates per player with enough minutes, padded to the population mean."""
    rated = per_100_sequences(stats, team_sequences(stats))
    rates = [c for c in rated.columns if c.endswith("_p100")]
    players = rated.groupBy("player_name").agg(
        F.count(F.lit(1)).alias("n_games"),
        F.coalesce(F.sum("min"), F.lit(0)).alias("total_minutes"),
        *[F.avg(c).alias(c) for c in rates],
    )
    return pad_to_mean(players.where(F.col("total_minutes") >= min_minutes), rates)
