"""Rolling team form before each match."""

from pyspark.sql import DataFrame, functions as F

from touchline.operators.ordering import HotGroups, Ordering, split_hot
from touchline.session import local_rows

TEAM_MATCHES = Ordering(keys=("team",), by=("match_date", "match_id"), position="unix_date(match_date)")
# Metrics averaged, and those also given as home minus away.
METRICS = ["goals_scored", "goals_conceded", "xg_for", "xg_against", "points", "win", "clean_sheet", "npxgd"]
DIFF_METRICS = ["goals_scored", "xg_for", "points", "npxgd"]


def team_matches(results: DataFrame) -> DataFrame:
    """Two rows per match, one per team, with its own and the opponent's goals and chances."""
    side = lambda own, other, home: F.struct(
        F.col(f"{own}_team").alias("team"),
        F.col(f"{own}_goals").cast("double").alias("goals_scored"),
        F.col(f"{other}_goals").cast("double").alias("goals_conceded"),
        F.col(f"{own}_xg").cast("double").alias("xg_for"),
        F.col(f"{other}_xg").cast("double").alias("xg_against"),
        F.lit(home).alias("is_home"),
    )
    long = results.select(
        "match_id",
        F.to_date("match_date").alias("match_date"),
        F.explode(F.array(side("home", "away", True), side("away", "home", False))).alias("s"),
    ).select("match_id", "match_date", "s.*")
    won, level = F.col("goals_scored") > F.col("goals_conceded"), F.col("goals_scored") == F.col("goals_conceded")
    return long.withColumns(
        {
            "points": F.when(won, 3.0).when(level, 1.0).when(~won, 0.0),
            "win": won.cast("double"),
            "clean_sheet": (F.col("goals_conceded") == 0).cast("double"),
            "npxgd": F.col("xg_for") - F.col("xg_against"),
        }
    )


def rolling_form(
    results: DataFrame, windows: tuple[int, ...] = (5, 10, 20), hot: HotGroups | None = None
) -> DataFrame:
    """Means over each team's previous w matches (NULL until there are w), rest days, differences."""

    def sequence(df: DataFrame, order: Ordering) -> DataFrame:
        df = order.previous_mean(df, {f"{m}_last_{w}": (F.col(m), w) for w in windows for m in METRICS})
        df = order.shift(df, {"_last_date": ("match_date", 1)})
        return df.withColumn("days_since_last", F.datediff("match_date", "_last_date").cast("double")).drop("_last_date")

    form = split_hot(team_matches(results), TEAM_MATCHES, sequence, hot=hot)
    columns = [f"{m}_last_{w}" for w in windows for m in METRICS] + ["days_since_last"]
    of = lambda c, home: F.max(F.when(F.col("is_home") == home, F.col(c)))
    paired = form.groupBy("match_id").agg(
        *[of(c, True).alias(f"home_{c}") for c in columns], *[of(c, False).alias(f"away_{c}") for c in columns]
    )
    diffs = {
        f"diff_{m}_last_{w}": F.col(f"home_{m}_last_{w}") - F.col(f"away_{m}_last_{w}")
        for w in windows
        for m in DIFF_METRICS
    }
    return paired.withColumns(
        {**diffs, "rest_diff": F.col("home_days_since_last") - F.col("away_days_since_last")}
    )


def impute_xg(results: DataFrame) -> DataFrame:
    """Missing chances take the league's mean, else the overall mean; both come from one pass, a row a league."""
    chances = {"h": "home_xg", "a": "away_xg"}
    sums = local_rows(results.groupBy("league").agg(*[f(c).alias(f"_{n}{k}") for k, c in chances.items() for n, f in (("s", F.sum), ("n", F.count))]))
    means = sums.select("league", *[F.try_divide(f"_s{k}", f"_n{k}").alias(f"_l{k}") for k in chances])
    overall = sums.agg(F.struct(*[F.try_divide(F.sum(f"_s{k}"), F.sum(f"_n{k}")).alias(k) for k in chances])).scalar()
    joined = results.join(means, "league", "left").withColumn("_m", overall)
    return joined.withColumns(
        {
            "home_xg": F.coalesce("home_xg", "_lh", F.col("_m.h")),
            "away_xg": F.coalesce("away_xg", "_la", F.col("_m.a")),
        }
    ).drop("_lh", "_la", "_m")
