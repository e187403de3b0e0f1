"""Elo ratings before every match, computed in parallel sweeps instead of one long loop.

A rating depends on all earlier matches of both teams. Given any guess of the ratings before
the matches, all rating changes follow at once, and a running sum per team turns the changes
into a better guess. Inside one block of dates every sweep settles at least one more match of
each team's sequence, and small rating changes make it settle far sooner; the loop ends when
no rating moves. Blocks pass on one rating per team.
"""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from touchline.constants import ELO_HOME_ADVANTAGE, ELO_INITIAL, ELO_K
from touchline.operators.ordering import HotGroups, Ordering, hot_groups, split_hot
from touchline.session import cut_lineage

TEAM_ORDER = Ordering(keys=("team",), by=("match_date", "match_id"), position="unix_date(match_date)")


def initial_elos(teams: DataFrame, initial: float = ELO_INITIAL) -> DataFrame:
    """One starting rating per distinct team."""
    return teams.select("team").distinct().withColumn("elo", F.lit(float(initial)))


def home_change(
    home_elo: Column, away_elo: Column, home_goals: Column, away_goals: Column,
    k: float = ELO_K, home_advantage: float = ELO_HOME_ADVANTAGE,
) -> Column:
    """Rating change of the home team (the away team's is its negative); 0 for unplayed matches."""
    expected = 1 / (1 + F.pow(F.lit(10.0), -(home_elo + F.lit(float(home_advantage)) - away_elo) / 400))
    actual = F.when(home_goals > away_goals, 1.0).when(home_goals == away_goals, 0.5).otherwise(0.0)
    margin = F.log(F.abs(home_goals - away_goals) + 1.0) + 1
    change = F.lit(float(k)) * margin * (actual - expected)
    return F.when(home_goals.isNotNull() & away_goals.isNotNull(), change).otherwise(F.lit(0.0))


def update_elos(matches: DataFrame, k: float = ELO_K, home_advantage: float = ELO_HOME_ADVANTAGE) -> DataFrame:
    """Ratings after single matches with given ratings before."""
    change = home_change(
        F.col("home_elo"), F.col("away_elo"), F.col("home_goals"), F.col("away_goals"), k, home_advantage
    )
    return matches.withColumns(
        {"new_home_elo": F.col("home_elo") + change, "new_away_elo": F.col("away_elo") - change}
    )


def _sweep(long: DataFrame, order: Ordering, k: float, home_advantage: float) -> DataFrame:
    """Better pre-match ratings from the changes under the current ones.

    `long` has two rows per match; one exchange by match pairs them, one by team sums changes.
    """
    pair = W.partitionBy("match_id")
    home = F.max(F.when(F.col("is_home"), F.col("pre"))).over(pair)
    away = F.max(F.when(~F.col("is_home"), F.col("pre"))).over(pair)
    change = home_change(home, away, F.col("home_goals"), F.col("away_goals"), k, home_advantage)
    moved = long.withColumn("change", F.when(F.col("is_home"), change).otherwise(-change))
    summed = order.running_sum(moved, {"_upto": F.col("change")})
    return summed.withColumns(
        {"previous": F.col("pre"), "pre": F.col("start") + F.col("_upto") - F.col("change")}
    ).drop("_upto")


def match_elos(
    results: DataFrame,
    k: float = ELO_K,
    home_advantage: float = ELO_HOME_ADVANTAGE,
    initial: float = ELO_INITIAL,
    block: Column | None = None,
    tolerance: float = 1e-6,
    sweeps_per_job: int = 5,
    max_sweeps: int = 400,
    hot: HotGroups | None = None,
) -> DataFrame:
    """Ratings of both teams before each match, in order of date and match id.

    `block` cuts time into spans with few matches per team (such as `year(match_date)`); it must
    not fall as dates rise. Shorter spans need fewer sweeps each. The driver only sees block
    labels and one largest move per job.
    """
    side = lambda team, home: F.struct(F.col(team).alias("team"), F.lit(home).alias("is_home"))
    long = results.select(
        "match_id",
        F.to_date("match_date").alias("match_date"),
        "home_goals",
        "away_goals",
        F.explode(F.array(side("home_team", True), side("away_team", False))).alias("s"),
    ).select("match_id", "match_date", "home_goals", "away_goals", "s.*")
    long = long.withColumn("_block", F.lit(0) if block is None else block)
    if hot is None:
        hot = hot_groups(long, ("team",))
    labels = [0] if block is None else sorted(r[0] for r in long.select("_block").distinct().collect())
    base, done = None, None
    for label in labels:
        part = long if block is None else long.where(F.col("_block") == label)
        if base is None:
            part = part.withColumn("start", F.lit(float(initial)))
        else:
            part = part.join(base, "team", "left").withColumn("start", F.coalesce("elo", F.lit(float(initial)))).drop("elo")
        part = part.withColumn("pre", F.col("start"))
        for done_sweeps in range(0, max_sweeps, sweeps_per_job):
            for _ in range(sweeps_per_job):
                part = split_hot(
                    part.drop("previous", "change"), TEAM_ORDER, lambda d, o: _sweep(d, o, k, home_advantage), hot
                )
            part = cut_lineage(part)
            if part.agg(F.max(F.abs(F.col("pre") - F.col("previous")))).first()[0] <= tolerance:
                break
        else:
            raise RuntimeError(f"ratings of block {label} did not settle; use shorter blocks")
        rated = part.select("match_id", "is_home", "pre")
        done = rated if done is None else done.unionByName(rated)
        if label != labels[-1]:
            after = part.groupBy("team").agg((F.max("start") + F.sum("change")).alias("elo"))
            if base is not None:
                kept = base.join(after, "team", "left_anti")
                after = after.unionByName(kept)
            base = cut_lineage(after)
    ratings = done.groupBy("match_id").agg(
        F.max(F.when(F.col("is_home"), F.col("pre"))).alias("home_elo"),
        F.max(F.when(~F.col("is_home"), F.col("pre"))).alias("away_elo"),
    )
    return ratings.withColumn("elo_diff", F.col("home_elo") - F.col("away_elo"))
