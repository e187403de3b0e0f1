"""Pass features and the expected-completion model."""

from pyspark.sql import Column, DataFrame, functions as F

from touchline.functions.geometry import distance, distance_to_goal, in_penalty_area, zone_id
from touchline.functions.numeric import filled, flag
from touchline.operators.boosting import BoostedModel, fit_boosted

# Features of the expected-pass model.
XPASS_FEATURES = [
    "start_x", "start_y", "end_x", "end_y", "pass_distance", "pass_angle", "is_forward",
    "is_backward", "is_lateral", "is_progressive", "start_zone", "end_zone", "crosses_midfield",
    "into_penalty_area", "into_final_third", "ends_in_box", "start_in_own_third",
    "start_in_mid_third", "start_in_final_third", "end_dist_to_goal", "end_angle_to_goal",
    "is_short_pass", "is_medium_pass", "is_long_pass", "is_headed_pass",
]


def pass_feature_columns(has_bodypart: bool = True) -> dict[str, Column]:
    x, y, ex, ey = (F.col(c) for c in ("start_x", "start_y", "end_x", "end_y"))
    dx = ex - x
    length = distance(x, y, ex, ey)
    before, after = distance_to_goal(x, y), distance_to_goal(ex, ey)
    box_start, box_end = in_penalty_area(x, y), in_penalty_area(ex, ey)
    return {
        "pass_distance": length,
        "pass_angle": F.atan2(ey - y, dx),
        "is_forward": flag(dx > 0),
        "is_backward": flag(dx < -5),
        "is_lateral": flag(F.abs(dx) < 5),
        "is_progressive": flag(after < before * 0.75),
        "start_zone": zone_id(x, y),
        "end_zone": zone_id(ex, ey),
        "crosses_midfield": flag(((x < 50) & (ex >= 50)) | ((x >= 50) & (ex < 50))),
        "into_penalty_area": flag(~box_start & box_end),
        "into_final_third": flag((x <= 67) & (ex > 67)),
        "ends_in_box": flag(box_end),
        "start_in_own_third": flag(x < 33),
        "start_in_mid_third": flag((x >= 33) & (x < 67)),
        "start_in_final_third": flag(x >= 67),
        "end_dist_to_goal": after,
        "end_angle_to_goal": F.abs(F.atan2(ey - 44, 100 - ex) - F.atan2(ey - 56, 100 - ex)),
        "is_short_pass": flag(length < 15),
        "is_medium_pass": flag((length >= 15) & (length < 30)),
        "is_long_pass": flag(length >= 30),
        "is_headed_pass": flag(F.col("bodypart") == "head") if has_bodypart else F.lit(0),
    }


def pass_features(actions: DataFrame) -> DataFrame:
    """Passes of the stream with their features and whether they were completed."""
    columns = pass_feature_columns("bodypart" in actions.columns)
    passes = actions.where(F.col("action_type") == "pass")
    ids = ["match_id", "action_id", "player_id", "player_name", "team_id"]
    spots = ["start_x", "start_y", "end_x", "end_y"]
    return passes.select(
        *ids,
        *[filled(c).alias(c) for c in spots],
        *[(filled(v) if n in ("pass_distance", "pass_angle", "end_dist_to_goal", "end_angle_to_goal") else F.coalesce(v, F.lit(0))).alias(n) for n, v in columns.items()],
        flag(F.col("result") == "success").alias("completed"),
    )


def fit_xpass(features: DataFrame, **options) -> BoostedModel:
    names = [c for c in XPASS_FEATURES if c in features.columns]
    options = {"eta": 0.1, "rounds": 100, "min_child": 5, **options}
    return fit_boosted(features, names, "completed", "binary", **options)


def predict_xpass(model: BoostedModel, features: DataFrame, out: str = "xpass") -> DataFrame:
    return model.predict(features, [out])


def add_xpass(actions: DataFrame, model: BoostedModel) -> DataFrame:
    """Completion probability of the stream's passes, NULL for other actions."""
    columns = pass_feature_columns("bodypart" in actions.columns)
    spots = {c: F.col(c) for c in ("start_x", "start_y", "end_x", "end_y")}
    nested = actions.select(
        F.struct("*").alias("_a"), *[v.alias(n) for n, v in {**spots, **columns}.items()]
    )
    scored = model.predict(nested, ["_xpass"])
    kept = [F.col(f"_a.{c}").alias(c) for c in actions.columns if c != "xpass"]
    chance = F.when(F.col("_a.action_type") == "pass", F.col("_xpass"))
    return scored.select(*kept, chance.alias("xpass"))
