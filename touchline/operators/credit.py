"""Sharing action values between players, and rolling them up."""

from pyspark.sql import Column, DataFrame, functions as F

from touchline.constants import (
    BACKWARD_PASS_PENALTY,
    BASE_PASSER_SHARE,
    DEFENSIVE_BOOST,
    FAILED_PASS_SCALE_MIN,
    MINUTES_PER_MATCH,
    PASS_DIFFICULTY_ADJUSTMENT,
    POSITION_RAMP_X,
    POSITION_SCALE_MIN,
    TURNOVER_BLAME_SHARE,
)
from touchline.functions.numeric import clamp, col
from touchline.operators.actions import ACTION_ID_ORDER
from touchline.operators.chains import is_goal, is_shot
from touchline.operators.ordering import HotGroups, Ordering, split_hot

# Action groups with their own credit rules.
DEEP_ACTIONS = ["keeper_pick_up", "keeper_punch", "other", "ball_touch", "take_on"]
DEFENSIVE_ACTIONS = ["clearance", "interception", "tackle", "ball_recovery"]


def split_pass_credit(value, xpass) -> tuple[Column, Column]:
    """Passer and receiver share of a pass; harder passes leave more to the passer."""
    p = clamp(xpass, 0.05, 0.95)
    return col(value) * (1 - p), col(value) * p


def _ramp(floor: float) -> Column:
    """Scale falling from 1 towards `floor` in the last POSITION_RAMP_X of the pitch."""
    return F.least(F.lit(1.0), F.lit(floor) + F.lit(1 - floor) * (100 - F.col("start_x")) / F.lit(POSITION_RAMP_X))


def _override(df: DataFrame, where: Column, **values: Column) -> DataFrame:
    return df.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def assign_credit(valued: DataFrame, hot: HotGroups | None = None) -> DataFrame:
    """Split each action's value between actor, receiver and duel opponent.

    Later rules overwrite earlier ones: full credit to the actor, turnovers, saved shots,
    missed shots, completed and failed passes (when `xpass` is present), scaling deep in the
    opponent's half, the defensive boost, and zero-sum duels.
    """

    def boundaries(df: DataFrame, order: Ordering) -> DataFrame:
        df = order.shift(df, {"_n_period": ("period_id", -1)})
        return df.withColumn("_same_period", F.coalesce(F.col("_n_period") == F.col("period_id"), F.lit(True)))

    df = split_hot(valued, ACTION_ID_ORDER, boundaries, hot=hot)
    delta, half, changed = F.col("epv_delta"), F.lit(TURNOVER_BLAME_SHARE), F.col("possession_change")
    lost = delta < 0
    share = lambda if_lost, otherwise: F.when(lost, if_lost).when(~lost, otherwise)
    has_xpass = "xpass" in df.columns
    df = df.withColumns(
        {
            "player_credit": delta,
            "receiver_credit": F.lit(0.0),
            "opponent_credit": F.lit(None).cast("double"),
            "xpass": F.col("xpass") if has_xpass else F.lit(None).cast("double"),
        }
    )
    df = _override(
        df,
        changed & delta.isNotNull() & ~is_goal() & F.col("_same_period"),
        player_credit=share(delta * half, delta),
        receiver_credit=share(-delta * half, F.lit(0.0)),
    )
    if "type_id" in df.columns:
        failed_shot = is_shot() & (F.col("result") == "fail")
        gained = F.col("receiver_player_id").isNotNull() & (F.col("team_id") != F.col("receiver_team_id"))
        df = _override(
            df,
            failed_shot & (F.col("type_id") == 13) & gained,
            player_credit=delta * half,
            receiver_credit=-delta * half,
        )
        df = _override(
            df, failed_shot & F.col("type_id").isin(14, 15), player_credit=delta, receiver_credit=F.lit(0.0)
        )
    if has_xpass:
        is_pass = F.col("action_type") == "pass"
        scale, passer = _ramp(POSITION_SCALE_MIN), F.lit(BASE_PASSER_SHARE) + F.lit(
            PASS_DIFFICULTY_ADJUSTMENT
        ) * (1 - F.col("xpass"))
        df = _override(
            df,
            is_pass & (F.col("result") == "success") & ~changed,
            player_credit=share(delta * scale * F.lit(BACKWARD_PASS_PENALTY), delta * passer * scale),
            receiver_credit=share(F.lit(0.0), delta * (1 - passer) * scale),
        )
        blame = F.lit(BASE_PASSER_SHARE) + F.lit(PASS_DIFFICULTY_ADJUSTMENT) * F.col("xpass")
        harm = delta * _ramp(FAILED_PASS_SCALE_MIN) * F.when(F.col("start_x") > 80, 0.5).otherwise(1.0)
        df = _override(
            df,
            is_pass & ((F.col("result") == "fail") | changed) & F.col("_same_period"),
            player_credit=share(harm * blame, delta),
            receiver_credit=share(-harm * (1 - blame), F.lit(0.0)),
        )
    deep = F.col("action_type").isin(DEEP_ACTIONS) & (F.col("start_x") > 60)
    df = _override(df, deep, player_credit=F.col("player_credit") * _ramp(POSITION_SCALE_MIN))
    defending = F.col("action_type").isin(DEFENSIVE_ACTIONS)
    df = _override(df, defending, player_credit=F.col("player_credit") * F.lit(DEFENSIVE_BOOST))
    if "opponent_player_id" in df.columns:
        df = _override(
            df,
            F.col("opponent_player_id").isNotNull() & delta.isNotNull(),
            player_credit=delta * half,
            opponent_credit=-delta * half,
        )
    return df.drop("_n_period", "_same_period")


def action_type_values(credited: DataFrame) -> DataFrame:
    """Credit per player by passing, shooting, dribbling and defending; NULL without such actions."""
    credit = next(c for c in ("player_credit", "epv_delta", "epv") if c in credited.columns)
    kinds = {
        "epv_passing": ["pass"],
        "epv_shooting": ["shot"],
        "epv_dribbling": ["take_on"],
        "epv_defending": ["tackle", "interception", "clearance", "ball_recovery"],
    }
    counted = [t for types in kinds.values() for t in types]
    of_kind = lambda types: F.col("action_type").isin(types)
    total = lambda types: F.when(
        F.count_if(of_kind(types)) > 0, F.coalesce(F.sum(F.when(of_kind(types), F.col(credit))), F.lit(0.0))
    )
    return (
        credited.where(of_kind(counted))
        .groupBy("player_id", "player_name")
        .agg(*[total(types).alias(out) for out, types in kinds.items()])
    )


def _renamed(df: DataFrame, role: str, credit: str, out: str) -> DataFrame:
    return (
        df.where(F.col(f"{role}_player_id").isNotNull() & F.col(credit).isNotNull())
        .groupBy(F.col(f"{role}_player_id").alias("player_id"), F.col(f"{role}_player_name").alias("player_name"))
        .agg(F.sum(credit).alias(out))
    )


def player_values(
    credited: DataFrame, lineups: DataFrame | None = None, min_minutes: float = 450
) -> DataFrame:
    """Value per player as actor, receiver and beaten opponent, per 90 minutes with line-ups.

    Players that only received or only lost duels stay in (full outer joins); receiver and
    duel credit of a player is attached to each of the player's teams.
    """
    player = ["player_id", "player_name"]
    totals = credited.groupBy(*player, "team_id").agg(
        F.coalesce(F.sum("player_credit"), F.lit(0.0)).alias("epv_as_actor"),
        F.count(F.lit(1)).alias("n_actions"),
    )
    if {"receiver_player_id", "receiver_credit"} <= set(credited.columns):
        totals = totals.join(_renamed(credited, "receiver", "receiver_credit", "epv_as_receiver"), player, "full")
    else:
        totals = totals.withColumn("epv_as_receiver", F.lit(0.0))
    if {"opponent_player_id", "opponent_credit"} <= set(credited.columns):
        totals = totals.join(_renamed(credited, "opponent", "opponent_credit", "epv_duel_blame"), player, "full")
    else:
        totals = totals.withColumn("epv_duel_blame", F.lit(0.0))
    parts = ["epv_as_actor", "epv_as_receiver", "epv_duel_blame"]
    totals = totals.na.fill(0, parts + ["n_actions"])
    totals = totals.withColumn("epv_total", F.col(parts[0]) + F.col(parts[1]) + F.col(parts[2]))
    totals = totals.join(action_type_values(credited), player, "left")
    if lineups is not None:
        minutes = lineups.groupBy(*player).agg(F.sum("minutes_played").alias("total_minutes"))
        totals = totals.join(minutes, player, "left").where(F.col("total_minutes") >= min_minutes)
        played = F.col("total_minutes") / F.lit(MINUTES_PER_MATCH)
        rates = {f"{c}_p90": F.try_divide(F.col(c), played) for c in totals.columns if c.startswith("epv_")}
        totals = totals.withColumns(rates)
    numbers = [c for c, t in totals.dtypes if t in ("double", "bigint", "int") and c not in player + ["team_id"]]
    return totals.na.fill(0, numbers).orderBy(F.desc("epv_total"))
