"""Action features, scoring labels and action values."""

from pyspark.sql import DataFrame, functions as F

from touchline.functions.geometry import distance, distance_to_goal, location_features, simple_xg
from touchline.operators.actions import ACTION_ID_ORDER, ACTION_ORDER
from touchline.operators.boosting import BoostedModel, fit_boosted
from touchline.operators.chains import is_goal, is_shot
from touchline.operators.ordering import HotGroups, Ordering, split_hot

# Feature names by group, and codes of lagged action types.
LOCATION_FEATURES = [
    "x", "y", "distance_to_goal", "angle_to_goal", "zone_id", "in_penalty_area", "in_final_third",
    "in_own_third", "in_mid_third", "y_left", "y_center", "y_right",
]
MOVEMENT_FEATURES = ["dx", "dy", "move_distance", "dist_delta"]
ACTION_BASE_FEATURES = ["result_success", "is_foot", "is_head"]
ACTION_TYPES = [
    "pass", "shot", "take_on", "tackle", "interception", "clearance", "aerial", "foul", "ball_recovery",
]
SEQUENCE_ACTION_TYPES = ["pass", "shot", "take_on", "tackle", "interception"]
CHAIN_FEATURES = ["seconds_since_chain_start", "action_in_chain"]
CONTEXT_FEATURES = ["time_normalized", "period_id"]


def action_feature_names(include_sequence: bool = True, n_prev: int = 3) -> list[str]:
    names = (
        LOCATION_FEATURES
        + MOVEMENT_FEATURES
        + ACTION_BASE_FEATURES
        + [f"is_{t}" for t in ACTION_TYPES]
        + CHAIN_FEATURES
        + CONTEXT_FEATURES
    )
    if include_sequence:
        for k in range(1, n_prev + 1):
            names += [f"{c}_prev{k}" for c in ("result_success", "dx", "dy", "same_team")]
            names += [f"is_{t}_prev{k}" for t in SEQUENCE_ACTION_TYPES]
    return names


def numeric_nulls_to_zero(df: DataFrame) -> DataFrame:
    return df.na.fill(0)


def action_features(actions: DataFrame, n_prev: int = 3, hot: HotGroups | None = None) -> DataFrame:
    """Location, movement, type, sequence and context features; numeric NULL becomes 0."""
    start_goal = distance_to_goal("start_x", "start_y")
    base = actions.withColumns(location_features("start_x", "start_y")).withColumns(
        {
            "result_success": (F.col("result") == "success").cast("int"),
            "is_foot": (F.col("bodypart") == "foot").cast("int"),
            "is_head": (F.col("bodypart") == "head").cast("int"),
            **{f"is_{t}": (F.col("action_type") == t).cast("int") for t in ACTION_TYPES},
            "dx": F.col("end_x") - F.col("start_x"),
            "dy": F.col("end_y") - F.col("start_y"),
            "move_distance": distance("start_x", "start_y", "end_x", "end_y"),
            "dist_delta": distance_to_goal("end_x", "end_y") - start_goal,
            "time_normalized": F.least(F.col("time_seconds") / F.lit(45 * 60), F.lit(1.0)),
        }
    )
    if "chain_start_time" in actions.columns:
        base = base.withColumn("seconds_since_chain_start", F.col("time_seconds") - F.col("chain_start_time"))

    def sequence(df: DataFrame, order: Ordering) -> DataFrame:
        moves, flags = {}, {}
        for k in range(1, n_prev + 1):
            for c in ("result_success", "dx", "dy"):
                moves[f"{c}_prev{k}"] = (c, k)
            moves |= {f"_team{k}": ("team_id", k), f"_type{k}": ("action_type", k)}
            flags[f"same_team_prev{k}"] = (F.col("team_id") == F.col(f"_team{k}")).cast("int")
            for t in SEQUENCE_ACTION_TYPES:
                flags[f"is_{t}_prev{k}"] = (F.col(f"_type{k}") == t).cast("int")
        shifted = order.shift(df, moves).withColumns(flags)
        return shifted.drop(*[c for c in moves if c.startswith("_")])

    return numeric_nulls_to_zero(split_hot(base, ACTION_ORDER, sequence, hot=hot))


def feature_moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and SD per feature (SD 0 becomes 1), one row."""
    mean = [F.avg(c).alias(f"{c}_mean") for c in columns]
    sd = [F.when(F.stddev_samp(c) == 0, 1.0).otherwise(F.stddev_samp(c)).alias(f"{c}_sd") for c in columns]
    return df.agg(*mean, *sd)


def standardize(
    df: DataFrame, columns: list[str], means: dict[str, float] | None = None, sds: dict[str, float] | None = None
) -> DataFrame:
    """z-scores by the given moments, or by those of the data."""
    if means is None or sds is None:
        moments = feature_moments(df, columns)
        row = moments.agg(F.first(F.struct(*moments.columns))).scalar()
        df = df.withColumn("_m", row)
    mean = lambda c: F.lit(float(means[c])) if means is not None else F.col(f"_m.{c}_mean")
    sd = lambda c: F.lit(float(sds[c])) if sds is not None else F.col(f"_m.{c}_sd")
    return df.withColumns({c: (F.col(c) - mean(c)) / sd(c) for c in columns}).drop("_m")


def possession_labels(labelled: DataFrame) -> DataFrame:
    """Chain-level labels: this possession scores, the opponent's next one scores."""
    present = labelled.columns
    pick = lambda c: F.col(c).cast("int") if c in present else F.lit(0)
    return labelled.select(
        "match_id",
        "action_id",
        pick("chain_ends_in_goal").alias("scores_this_possession"),
        pick("opponent_scores_next").alias("concedes_next_possession"),
    )


def _next_in_period(actions: DataFrame, value, when, hot: HotGroups | None) -> DataFrame:
    def sequence(df: DataFrame, order: Ordering) -> DataFrame:
        return order.within("period_id").first_later(df, "_next", value, when, "time_seconds")

    return split_hot(actions, ACTION_ORDER, sequence, hot=hot)


def next_goal_labels(actions: DataFrame, hot: HotGroups | None = None) -> DataFrame:
    """Who scores next in the period, strictly later: own team 0, opponent 1, nobody 2."""
    df = _next_in_period(actions, F.col("team_id"), is_goal(), hot)
    label = F.when(F.col("_next").isNull(), 2).when(F.col("_next") == F.col("team_id"), 0).otherwise(1)
    return df.withColumn("next_goal_label", label).drop("_next")


def next_xg_labels(actions: DataFrame, xg_values: DataFrame | None = None, hot: HotGroups | None = None) -> DataFrame:
    """Scoring chance of the next shot in the period: positive for the own team, 0 without a shot.

    Chances come from `xg_values` (match_id, action_id, xg), else `chain_xg`, else the closed form.
    """
    if xg_values is not None:
        df = actions.join(
            xg_values.select("match_id", "action_id", F.col("xg").alias("_xg")), ["match_id", "action_id"], "left"
        )
    elif "chain_xg" in actions.columns:
        df = actions.withColumn("_xg", F.when(is_shot(), F.col("chain_xg")))
    else:
        df = actions.withColumn("_xg", F.when(is_shot(), simple_xg("start_x", "start_y")))
    chance = F.coalesce(F.col("_xg"), F.lit(0.0))
    df = _next_in_period(df, F.struct(F.col("team_id").alias("team"), chance.alias("xg")), is_shot(), hot)
    signed = F.when(F.col("_next.team") == F.col("team_id"), F.col("_next.xg")).otherwise(-F.col("_next.xg"))
    return df.withColumn(
        "next_xg_label", F.when(F.col("_next").isNull(), F.lit(0.0)).otherwise(signed)
    ).drop("_next", "_xg")


def action_values(predicted: DataFrame, method: str = "goal", hot: HotGroups | None = None) -> DataFrame:
    """Value of each state (`epv`) and of each action (`epv_delta`).

    Expects p_team_scores and p_opponent_scores (method "goal") or expected_xg (method "xg").
    Shots take their own scoring chance as value, are settled by their result, and pull the
    action before a shot to that chance. A change of team flips the sign of the next value.
    """
    if method == "goal":
        state = F.col("p_team_scores") - F.col("p_opponent_scores")
    else:
        state = F.col("expected_xg")
    chance = simple_xg("start_x", "start_y")
    if "xg" in predicted.columns:
        chance = F.coalesce(F.col("xg"), chance)
    df = predicted.withColumns(
        {
            "_state": state,
            "epv_model": F.when(is_shot(), state),
            "epv": F.when(is_shot(), chance).otherwise(state),
        }
    )
    own_goal = F.coalesce(F.col("is_own_goal"), F.lit(False)) if "is_own_goal" in predicted.columns else F.lit(False)

    def sequence(df: DataFrame, order: Ordering) -> DataFrame:
        ahead = {"_state": "_n_state", "epv": "_n_epv", "team_id": "_n_team", "action_type": "_n_type"}
        df = order.shift(df, {out: (c, -1) for c, out in ahead.items()})
        same = F.col("team_id") == F.col("_n_team")
        step = lambda nxt, here: F.when(same, F.col(nxt) - F.col(here)).otherwise(-F.col(nxt) - F.col(here))
        delta = F.when(F.col("_n_team").isNull(), F.lit(0.0)).otherwise(step("_n_state", "_state"))
        delta = (
            F.when((F.col("_n_type") == "shot") & F.col("_n_epv").isNotNull(), step("_n_epv", "epv"))
            .when(is_shot() & (F.col("result") == "fail"), -F.col("epv"))
            .when(is_goal() & own_goal, F.lit(-1.0) - F.col("epv"))
            .when(is_goal(), F.lit(1.0) - F.col("epv"))
            .otherwise(delta)
        )
        changed = F.coalesce(F.col("_n_team") != F.col("team_id"), F.lit(False))
        return df.withColumns({"epv_delta": delta, "possession_change": changed}).drop("_state", *ahead.values())

    return split_hot(df, ACTION_ID_ORDER, sequence, hot=hot)


def value_summary(valued: DataFrame) -> DataFrame:
    """Range, bounds, totals and spread of the action values (one row)."""
    summary = valued.agg(
        F.count(F.lit(1)).alias("total_actions"),
        F.min("epv").alias("epv_min"),
        F.max("epv").alias("epv_max"),
        F.sum("epv_delta").alias("total_epv_delta"),
        F.count_if(is_goal()).alias("actual_goals"),
        F.avg("epv").alias("mean_epv"),
        F.avg("epv_delta").alias("mean_epv_delta"),
        F.stddev_samp("epv_delta").alias("sd_epv_delta"),
        F.count_distinct("match_id").alias("n_matches"),
    )
    bounded = (F.col("epv_min") >= -1.01) & (F.col("epv_max") <= 1.01)
    return summary.withColumn("epv_bounded", bounded)


def fit_value_model(features: DataFrame, method: str = "goal", **options) -> BoostedModel:
    """State value model: three scoring classes ("goal") or the next shot's signed chance ("xg")."""
    names = [c for c in action_feature_names() if c in features.columns]
    if len(names) < 5:
        raise ValueError("too few action features")
    label, kind = ("next_goal_label", "classes") if method == "goal" else ("next_xg_label", "squared")
    return fit_boosted(features, names, label, kind, metadata={"method": method}, **options)


def predict_values(model: BoostedModel, features: DataFrame) -> DataFrame:
    """Class probabilities, or the expected chance, per action."""
    if model.metadata.get("method", "goal") == "goal":
        return model.predict(features, ["p_team_scores", "p_opponent_scores", "p_nobody_scores"])
    return model.predict(features, ["expected_xg"])
