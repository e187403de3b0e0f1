"""Team strength out of line-ups: ratings and skills of the starting eleven."""

from pyspark.sql import Column, DataFrame, functions as F

from touchline.functions.names import player_key
from touchline.operators.ratings import largest_per_key

RATINGS = ["rating", "offense", "defense", "spm"]
# Skills averaged over starters.
ATTACKING_SKILLS = [
    "goals_p90", "shots_p90", "shots_on_target_p90", "key_passes_p90", "assists_p90",
    "big_chance_created_p90", "touches_opp_box_p90", "crosses_p90",
]
DEFENSIVE_SKILLS = [
    "tackles_won_p90", "interceptions_p90", "clearances_p90", "blocks_p90", "aerial_won_p90", "ball_recovery_p90",
]
PLACEHOLDER_POSITIONS = ["Goalkeeper"] + ["Defender"] * 4 + ["Midfielder"] * 4 + ["Forward"] * 2


def _home_away(teams: DataFrame, values: list[str]) -> DataFrame:
    """One row per match with home_ and away_ columns; matches with one side only drop out."""
    side = F.lower("team_position")
    of = lambda c, s: F.max(F.when(side == s, F.col(c)))
    paired = teams.groupBy("match_id").agg(
        F.count_if(side == "home").alias("_h"),
        F.count_if(side == "away").alias("_a"),
        *[of(c, "home").alias(f"home_{c}") for c in values],
        *[of(c, "away").alias(f"away_{c}") for c in values],
    )
    return paired.where((F.col("_h") > 0) & (F.col("_a") > 0)).drop("_h", "_a")


def position_group(position="position") -> Column:
    c = F.lower(position)
    return (
        F.when(c.contains("goalkeeper"), "gk")
        .when(c.contains("defender"), "def")
        .when(c.contains("midfielder"), "mid")
        .when(c.rlike("forward|striker"), "fwd")
        .otherwise("mid")
    )


def _shared_key(lineups: DataFrame, ratings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with `_key`: player id when any id is shared, else the cleaned name."""
    if "player_id" in lineups.columns and "player_id" in ratings.columns:
        ids = lineups.select(F.col("player_id").cast("string").alias("_key"))
        known = ratings.select(F.col("player_id").cast("string").alias("_key"))
        if ids.join(known, "_key", "left_semi").take(1):
            key = lambda df: df.withColumn("_key", F.col("player_id").cast("string"))
            return key(lineups), key(ratings)
    key = lambda df: df.withColumn("_key", player_key("player_name"))
    return key(lineups), key(ratings)


def lineup_ratings(
    lineups: DataFrame, ratings: DataFrame, season: int, previous_share: float = 0.8
) -> DataFrame:
    """Team statistics of the starters' ratings: this season's, else last season's at a discount, else 0.

    Duplicate players in a season keep the row with most minutes.
    """
    starters, rated = _shared_key(lineups.where(F.col("is_starter")), ratings)
    minutes = F.col("total_minutes") if "total_minutes" in rated.columns else F.lit(0)

    def of_season(year: int, suffix: str) -> DataFrame:
        rows = rated.where(F.col("season_end_year") == year).select("_key", minutes.alias("_minutes"), *RATINGS)
        best = largest_per_key(rows, "_key", "_minutes")
        return best.select("_key", *[F.col(c).alias(f"{c}{suffix}") for c in RATINGS])

    joined = starters.join(of_season(season, "_now"), "_key", "left").join(of_season(season - 1, "_old"), "_key", "left")
    joined = joined.withColumns(
        {
            **{
                c: F.coalesce(F.col(f"{c}_now"), F.col(f"{c}_old") * F.lit(previous_share), F.lit(0.0)) for c in RATINGS
            },
            "_pos": position_group(),
        }
    )
    at = lambda group, c: F.coalesce(F.avg(F.when(F.col("_pos") == group, F.col(c))), F.lit(0.0))
    stats = {
        **{f"sum_{c}": F.sum(c) for c in RATINGS},
        "avg_rating": F.avg("rating"),
        "max_rating": F.max("rating"),
        "min_rating": F.min("rating"),
        "stdev_rating": F.coalesce(F.stddev_samp("rating"), F.lit(0.0)),
        "gk_rating": F.coalesce(F.min_by("rating", F.when(F.col("_pos") == "gk", F.col("_key"))), F.lit(0.0)),
        **{f"avg_{g}_rating": at(g, "rating") for g in ("def", "mid", "fwd")},
        **{f"avg_{g}_{c}": at(g, c) for g in ("def", "mid", "fwd") for c in ("offense", "defense")},
        "n_rated_players": F.count_if(F.col("rating") != 0),
    }
    teams = joined.groupBy("match_id", "team_name", "team_position").agg(*[v.alias(n) for n, v in stats.items()])
    paired = _home_away(teams, list(stats))
    return paired.withColumns(
        {f"{c}_diff": F.col(f"home_sum_{c}") - F.col(f"away_sum_{c}") for c in RATINGS}
    )


def lineup_skills(
    lineups: DataFrame,
    skills: DataFrame,
    attacking: list[str] | None = None,
    defensive: list[str] | None = None,
) -> DataFrame:
    """Mean skills of the starters (missing as 0), their composites, home and away, differences."""
    groups = {
        "sk_att": [c for c in (attacking or ATTACKING_SKILLS) if c in skills.columns],
        "sk_def": [c for c in (defensive or DEFENSIVE_SKILLS) if c in skills.columns],
    }
    stats = [c for names in groups.values() for c in names]
    if not stats:
        raise ValueError("no skill columns")
    keyed = skills.withColumn("_key", player_key("player_name"))
    order = F.struct(*[F.col(c) for c in ("player_id",) if c in skills.columns], *[F.col(c) for c in stats])
    one_each = keyed.groupBy("_key").agg(F.min_by(F.struct(*stats), order).alias("_s")).select("_key", "_s.*")
    starters = lineups.where(F.col("is_starter")).withColumn("_key", player_key("player_name"))
    joined = starters.join(one_each, "_key", "left")
    name = lambda prefix, c: f"{prefix}_{c.removesuffix('_p90')}"
    means = {
        name(p, c): F.avg(F.coalesce(F.col(c), F.lit(0.0))) for p, names in groups.items() for c in names
    }
    teams = joined.groupBy("match_id", "team_name", "team_position").agg(*[v.alias(n) for n, v in means.items()])
    composites = {}
    for p, names in groups.items():
        if names:
            total = F.col(name(p, names[0]))
            for c in names[1:]:
                total = total + F.col(name(p, c))
            composites[f"{p}_composite"] = total / len(names)
    teams = teams.withColumns(composites)
    paired = _home_away(teams, [*means, *composites])
    diffs = {
        c.replace("_composite", "_diff"): F.col(f"home_{c}") - F.col(f"away_{c}") for c in composites
    }
    return paired.withColumns(diffs)


def upcoming_lineups(lineups: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Expected starters of upcoming matches: each team's last starting eleven, or a placeholder.

    Fixtures without both team ids are left out.
    """
    starters = lineups.where(F.col("is_starter"))
    last = starters.groupBy("team_id").agg(F.max("match_date").alias("match_date"))
    latest = starters.join(last, ["team_id", "match_date"], "left_semi").select(
        F.col("team_id").cast("string").alias("team_id"), "player_name", "position"
    )
    named = lambda c: F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    open_games = fixtures.where(named("home_team_id") & named("away_team_id"))
    side = lambda s: F.struct(
        F.col(f"{s}_team_id").cast("string").alias("team_id"),
        F.col(f"{s}_team").alias("team_name"),
        F.lit(s).alias("team_position"),
    )
    sides = open_games.select("match_id", F.explode(F.array(side("home"), side("away"))).alias("s")).select("match_id", "s.*")
    known = sides.join(latest, "team_id")
    unknown = sides.join(latest.select("team_id").distinct(), "team_id", "left_anti")
    eleven = F.array(
        *[
            F.struct(F.lit(f"Unknown_{i}").alias("player_name"), F.lit(p).alias("position"))
            for i, p in enumerate(PLACEHOLDER_POSITIONS, start=1)
        ]
    )
    placeholders = unknown.withColumn("_p", F.explode(eleven)).select(*sides.columns, "_p.*")
    return known.select(*placeholders.columns).unionByName(placeholders).withColumn("is_starter", F.lit(True))
