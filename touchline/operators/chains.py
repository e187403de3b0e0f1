"""Possession chains: sessions of one team's consecutive actions."""

from pyspark.sql import Column, DataFrame, functions as F

from touchline.constants import CHAIN_TIME_GAP_SECONDS
from touchline.operators.actions import ACTION_ORDER
from touchline.operators.ordering import HotGroups, Ordering, split_hot


def order_key() -> Column:
    return F.struct("period_id", "time_seconds", "action_id")


def is_shot() -> Column:
    return F.col("action_type") == "shot"


def is_goal() -> Column:
    return is_shot() & (F.col("result") == "success")


def possession_chains(
    actions: DataFrame, gap_seconds: int = CHAIN_TIME_GAP_SECONDS, hot: HotGroups | None = None
) -> DataFrame:
    """Number the chains of each match.

    A chain breaks at the first action, on a change of team or period, after a goal or foul,
    and after more than `gap_seconds` without an action; an unknown comparison breaks too.
    """

    def sequence(df: DataFrame, order: Ordering) -> DataFrame:
        before = ("team_id", "period_id", "time_seconds", "action_type", "result")
        df = order.shift(df, {f"_p_{c}": (c, 1) for c in before})
        prev = lambda c: F.col(f"_p_{c}")
        breaks = (
            prev("team_id").isNull()
            | (F.col("team_id") != prev("team_id"))
            | (prev("period_id").isNotNull() & (F.col("period_id") != prev("period_id")))
            | ((prev("action_type") == "shot") & (prev("result") == "success"))
            | (prev("action_type") == "foul")
            | (prev("time_seconds").isNotNull() & (F.col("time_seconds") - prev("time_seconds") > gap_seconds))
        )
        df = df.withColumn("_break", F.coalesce(breaks, F.lit(True)))
        df = order.running_sum(
            df, {"chain_id": F.col("_break").cast("long"), "_row": F.lit(1).cast("long")}
        )
        df = order.last_known(
            df,
            {
                "_first_row": F.when(F.col("_break"), F.col("_row")),
                "chain_start_time": F.when(F.col("_break"), F.col("time_seconds")),
            },
        )
        return df.withColumns(
            {
                "chain_team_id": F.col("team_id"),
                "action_in_chain": F.col("_row") - F.col("_first_row") + 1,
            }
        ).drop("_break", "_row", "_first_row", *[f"_p_{c}" for c in before])

    return split_hot(actions, ACTION_ORDER, sequence, hot=hot)


def chain_outcomes(chained: DataFrame) -> DataFrame:
    """One row per chain with its length, clock, shots and outcome."""
    xg = F.sum("xg") if "xg" in chained.columns else F.lit(None).cast("double")
    chains = chained.groupBy("match_id", "chain_id").agg(
        F.min_by("team_id", order_key()).alias("team_id"),
        F.min_by("time_seconds", order_key()).alias("chain_start_time"),
        F.max_by("time_seconds", order_key()).alias("chain_end_time"),
        F.count(F.lit(1)).alias("n_actions"),
        F.max_by("action_type", order_key()).alias("_last"),
        F.max_by("result", order_key()).alias("_last_result"),
        F.count_if(is_shot()).alias("shots_in_chain"),
        xg.alias("chain_xg"),
    )
    ended = (
        F.when(F.col("_last") == "clearance", "out_of_play")
        .when(F.col("_last") == "foul", "foul")
        .when((F.col("_last") == "shot") & (F.col("_last_result") == "success"), "goal")
        .when(F.col("shots_in_chain") > 0, "shot")
        .otherwise("turnover")
    )
    return chains.withColumn("outcome", ended).withColumn(
        "ends_in_goal", (F.col("outcome") == "goal").cast("int")
    ).drop("_last", "_last_result")


def with_next_chain_goal(outcomes: DataFrame, hot: HotGroups | None = None) -> DataFrame:
    """Flag chains after which the opponent's next chain ends in a goal (order: start clock)."""
    order = Ordering(("match_id",), ("chain_start_time", "chain_id"), "chain_start_time")

    def sequence(df: DataFrame, o: Ordering) -> DataFrame:
        df = o.shift(df, {"_team": ("team_id", -1), "_goal": ("ends_in_goal", -1)})
        conceded = (F.col("_team") != F.col("team_id")) & (F.col("_goal") == 1)
        return df.withColumn(
            "next_opponent_chain_goal", F.coalesce(conceded, F.lit(False)).cast("int")
        ).drop("_team", "_goal")

    return split_hot(outcomes, order, sequence, hot=hot)


def label_actions(chained: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Attach chain outcomes to the chain's actions."""
    names = {
        "ends_in_goal": "chain_ends_in_goal",
        "chain_xg": "chain_xg",
        "next_opponent_chain_goal": "opponent_scores_next",
        "outcome": "chain_outcome",
    }
    labels = outcomes.select(
        "match_id", "chain_id", *[F.col(c).alias(n) for c, n in names.items() if c in outcomes.columns]
    )
    labelled = chained.join(labels, ["match_id", "chain_id"], "left")
    shot_end = F.col("chain_outcome").isin("goal", "shot")
    return labelled.withColumn("chain_ends_in_shot", F.coalesce(shot_end, F.lit(False)).cast("int"))


def chain_stats(outcomes: DataFrame) -> DataFrame:
    """Totals, mean and median length, duration and rates over all chains (one row)."""
    shot = F.col("shots_in_chain") > 0
    return outcomes.agg(
        F.count(F.lit(1)).alias("total_chains"),
        F.count_if(shot).alias("chains_with_shots"),
        F.sum("ends_in_goal").cast("long").alias("chains_with_goals"),
        F.avg("n_actions").alias("mean_actions_per_chain"),
        F.median("n_actions").alias("median_actions_per_chain"),
        F.avg(F.col("chain_end_time") - F.col("chain_start_time")).alias("mean_duration"),
        F.avg("ends_in_goal").alias("goal_rate"),
        F.avg(shot.cast("int")).alias("shot_rate"),
    )


def outcome_shares(outcomes: DataFrame) -> DataFrame:
    """Share of chains per outcome."""
    counted = outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n_chains"))
    total = outcomes.agg(F.count(F.lit(1))).scalar()
    return counted.withColumn("share", F.col("n_chains") / total)


def with_possession_velocity(chained: DataFrame) -> DataFrame:
    """Progress towards goal per second of each chain, attached to its actions."""
    chains = chained.groupBy("match_id", "chain_id").agg(
        (F.max_by("start_x", order_key()) - F.min_by("start_x", order_key())).alias("x_progression"),
        (F.max_by("time_seconds", order_key()) - F.min_by("time_seconds", order_key())).alias("chain_duration"),
    )
    speed = F.when(
        F.col("chain_duration") > 0, F.try_divide(F.col("x_progression"), F.col("chain_duration"))
    ).otherwise(F.lit(0.0))
    return chained.join(chains.withColumn("possession_velocity", speed), ["match_id", "chain_id"], "left")
