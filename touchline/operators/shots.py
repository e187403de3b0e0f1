"""Shot features, expected goals, expected assists and player shooting totals."""

from pyspark.sql import DataFrame, functions as F

from touchline.constants import MINUTES_PER_MATCH, PENALTY_XG, SIX_YARD_X_MIN, SIX_YARD_Y_MAX, SIX_YARD_Y_MIN
from touchline.functions.geometry import angle_to_goal, distance_to_goal, in_penalty_area
from touchline.functions.numeric import bin_index, clamp, filled, flag
from touchline.operators.actions import ACTION_ORDER, PENALTY_QUALIFIER, SHOT_CODES, has_qualifier
from touchline.operators.boosting import BoostedModel, fit_boosted
from touchline.operators.chains import is_shot
from touchline.operators.ordering import HotGroups, Ordering, split_hot

# Features of the expected-goal model.
XG_FEATURES = [
    "x", "y", "distance_to_goal", "angle_to_goal", "in_penalty_area", "in_six_yard_box",
    "is_header", "is_right_foot", "is_left_foot", "is_open_play", "is_set_piece", "is_corner",
    "is_direct_freekick", "is_big_chance",
]

# Text fragments behind body-part and situation flags.
BODY_PART_FLAGS = {"is_header": "head", "is_right_foot": "right", "is_left_foot": "left"}
SITUATION_FLAGS = {
    "is_open_play": "open", "is_set_piece": "set", "is_corner": "corner",
    "is_penalty": "penalty", "is_direct_freekick": "free",
}


def in_six_yard_box(x, y):
    x, y = F.col(x), F.col(y)
    return (x > SIX_YARD_X_MIN) & (y > SIX_YARD_Y_MIN) & (y < SIX_YARD_Y_MAX)


def coordinate_warnings(shots: DataFrame) -> DataFrame:
    """How many shots lie outside the 0-100 grid (one row)."""
    outside = (F.col("x") < 0) | (F.col("x") > 100) | (F.col("y") < 0) | (F.col("y") > 100)
    return shots.agg(F.count(F.lit(1)).alias("n_shots"), F.count_if(outside).alias("n_outside"))


def shot_features(shots: DataFrame) -> DataFrame:
    """Model features of shot events; flags without a source column take their default."""
    columns = shots.columns
    contains = lambda c, text: flag(F.contains(F.lower(F.col(c)), F.lit(text)))
    optional = {}
    for source, flags, defaults in (
        ("body_part", BODY_PART_FLAGS, {}),
        ("situation", SITUATION_FLAGS, {"is_open_play": 1}),
    ):
        for out, text in flags.items():
            optional[out] = contains(source, text) if source in columns else F.lit(defaults.get(out, 0))
    optional["is_big_chance"] = (
        F.coalesce(F.col("big_chance").cast("int"), F.lit(0)) if "big_chance" in columns else F.lit(0)
    )
    if "type_id" in columns:
        for out, code in (("shot_saved", 13), ("shot_post", 14), ("shot_miss", 15)):
            optional[out] = flag(F.col("type_id") == code)
    return shots.select(
        *[c for c in ("match_id", "event_id", "player_id", "player_name") if c in columns],
        filled("x").alias("x"),
        filled("y").alias("y"),
        filled(distance_to_goal("x", "y")).alias("distance_to_goal"),
        filled(angle_to_goal("x", "y")).alias("angle_to_goal"),
        flag(in_penalty_area("x", "y")).alias("in_penalty_area"),
        flag(in_six_yard_box("x", "y")).alias("in_six_yard_box"),
        *[c.alias(n) for n, c in optional.items()],
        F.coalesce(F.col("is_goal").cast("int"), F.lit(0)).alias("is_goal"),
    )


def fit_xg(features: DataFrame, exclude_penalties: bool = True, **options) -> BoostedModel:
    """Boosted scoring-chance model, by default without penalties."""
    if exclude_penalties and "is_penalty" in features.columns:
        features = features.where(F.col("is_penalty") == 0)
    names = [c for c in XG_FEATURES if c in features.columns]
    if len(names) < 3:
        raise ValueError("too few shot features")
    options = {"eta": 0.05, "rounds": 100, "min_child": 10, **options}
    return fit_boosted(features, names, "is_goal", "binary", **options)


def predict_xg(model: BoostedModel, features: DataFrame, out: str = "xg") -> DataFrame:
    return model.predict(features, [out])


def add_xg(actions: DataFrame, model: BoostedModel) -> DataFrame:
    """Scoring chance of the stream's shots, 0 for other actions."""
    big = F.coalesce(F.col("is_big_chance").cast("int"), F.lit(0)) if "is_big_chance" in actions.columns else F.lit(0)
    inputs = {
        "x": F.col("start_x"),
        "y": F.col("start_y"),
        "distance_to_goal": distance_to_goal("start_x", "start_y"),
        "angle_to_goal": angle_to_goal("start_x", "start_y"),
        "in_penalty_area": flag(in_penalty_area("start_x", "start_y")),
        "in_six_yard_box": flag(in_six_yard_box("start_x", "start_y")),
        "is_header": flag(F.col("bodypart") == "head"),
        "is_open_play": F.lit(1),
        "is_big_chance": big,
    }
    zero = {c: F.lit(0) for c in model.features if c not in inputs}
    nested = actions.select(F.struct("*").alias("_a"), *[v.alias(n) for n, v in {**inputs, **zero}.items()])
    scored = model.predict(nested, ["_xg"])
    chance = F.when(F.col("_a.action_type") == "shot", F.col("_xg")).otherwise(F.lit(0.0))
    kept = [F.col(f"_a.{c}").alias(c) for c in actions.columns if c != "xg"]
    return scored.select(*kept, chance.alias("xg"))


def calibration(predicted: DataFrame, actual: str, probability: str, n_bins: int = 10) -> DataFrame:
    """Mean prediction and observed rate per equal-width bin."""
    return (
        predicted.groupBy(bin_index(probability, n_bins).alias("bin"))
        .agg(
            F.avg(actual).alias("actual_rate"),
            F.avg(probability).alias("predicted_rate"),
            F.count(F.lit(1)).alias("n_shots"),
        )
    )


def calibration_error(bins: DataFrame) -> DataFrame:
    """Shot-weighted mean gap between observed and predicted rate (one row)."""
    gap = F.abs(F.col("actual_rate") - F.col("predicted_rate"))
    return bins.agg((F.sum(F.col("n_shots") * gap) / F.sum("n_shots")).alias("calibration_error"))


def auc(predicted: DataFrame, actual: str, probability: str) -> DataFrame:
    """Area under the ROC curve from rank sums over distinct scores (ties count half), one row."""
    from touchline.operators.ranking import with_ranks

    ranked = with_ranks(predicted.select(actual, probability), probability, rank_avg="_rank")
    sums = ranked.agg(
        F.sum(F.when(F.col(actual) == 1, F.col("_rank"))).alias("_ranks"),
        F.sum(F.col(actual)).cast("double").alias("_pos"),
        F.count(F.lit(1)).cast("double").alias("_n"),
    )
    pos = F.col("_pos")
    area = F.try_divide(F.col("_ranks") - pos * (pos + 1) / 2, pos * (F.col("_n") - pos))
    return sums.select(area.alias("auc"))


def binary_scores(predicted: DataFrame, actual: str, probability: str, eps: float = 1e-15) -> DataFrame:
    """Counts, log loss, Brier score and mean prediction (one row)."""
    p = clamp(probability, eps, 1 - eps)
    y = F.col(actual).cast("double")
    return predicted.agg(
        F.count(F.lit(1)).alias("n_shots"),
        F.sum(F.col(actual)).cast("long").alias("n_goals"),
        F.avg(y).alias("goal_rate"),
        F.avg(probability).alias("mean_xg"),
        (-F.avg(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("logloss"),
        F.avg((F.col(probability) - y) * (F.col(probability) - y)).alias("brier_score"),
    )


def validate_xg(predicted: DataFrame, actual: str = "is_goal", probability: str = "xg", n_bins: int = 10) -> DataFrame:
    """All scores of a scoring-chance model on held-out shots (one row)."""
    scores = binary_scores(predicted, actual, probability)
    error = calibration_error(calibration(predicted, actual, probability, n_bins))
    return scores.withColumns({"calibration_error": error.scalar(), "auc": auc(predicted, actual, probability).scalar()})


def flag_penalties(actions: DataFrame, events: DataFrame, with_second: bool = True) -> DataFrame:
    """Mark shots whose raw event carries the penalty qualifier (same match, player and clock)."""
    keys = F.json_object_keys("qualifier_json")
    marked = events.where(F.col("type_id").isin(SHOT_CODES) & has_qualifier(keys, PENALTY_QUALIFIER))
    clock = ["_minute"] + (["_second"] if with_second else [])
    penalties = marked.select(
        "match_id",
        "player_id",
        F.col("minute").cast("long").alias("_minute"),
        *([F.col("second").cast("long").alias("_second")] if with_second else []),
        F.lit(1).alias("_penalty"),
    ).distinct()
    timed = actions.withColumns(
        {
            "_minute": F.floor(F.col("time_seconds") / 60).cast("long"),
            "_second": (F.col("time_seconds") % 60).cast("long"),
        }
    )
    joined = timed.join(penalties, ["match_id", "player_id", *clock], "left")
    is_penalty = flag(is_shot() & (F.col("_penalty") == 1))
    return joined.withColumn("is_penalty", is_penalty).drop("_minute", "_second", "_penalty")


def with_penalty_xg(actions: DataFrame) -> DataFrame:
    """Fixed chance for penalties."""
    hit = is_shot() & (F.col("is_penalty") == 1)
    return actions.withColumn("xg", F.when(hit, F.lit(PENALTY_XG)).otherwise(F.col("xg")))


def derive_assists(actions: DataFrame, hot: HotGroups | None = None) -> DataFrame:
    """Expected assists: a completed pass right before a team-mate's shot carries its chance."""

    def sequence(df: DataFrame, order: Ordering) -> DataFrame:
        ahead = ("action_type", "team_id", "player_id", "xg", "result")
        df = order.within("period_id").shift(df, {f"_n_{c}": (c, -1) for c in ahead})
        key_pass = F.coalesce(
            (F.col("_n_action_type") == "shot")
            & (F.col("action_type") == "pass")
            & (F.col("result") == "success")
            & (F.col("_n_team_id") == F.col("team_id"))
            & (F.col("_n_player_id") != F.col("player_id")),
            F.lit(False),
        )
        return df.withColumns(
            {
                "xa": F.when(key_pass, F.col("_n_xg")).otherwise(F.lit(0.0)),
                "is_key_pass": key_pass.cast("int"),
                "is_assist": flag(key_pass & (F.col("_n_result") == "success")),
            }
        ).drop(*[f"_n_{c}" for c in ahead])

    return split_hot(actions, ACTION_ORDER, sequence, hot=hot)


def player_shooting(actions: DataFrame, lineups: DataFrame, min_minutes: float = 0) -> DataFrame:
    """Shots, chances, assists and passing over expectation per player and team.

    Only actions in matches where the player has minutes count; players without actions keep
    a row of zeros.
    """
    appeared = lineups.where(F.col("minutes_played") > 0).select("match_id", "player_id").distinct()
    kept = actions.join(appeared, ["match_id", "player_id"], "left_semi")
    if "is_penalty" not in kept.columns:
        kept = kept.withColumn("is_penalty", F.lit(0))
    if "xpass" not in kept.columns:
        kept = kept.withColumn("xpass", F.lit(0.0))
    success = F.col("result") == "success"
    is_pass = F.col("action_type") == "pass"
    penalty = F.coalesce(F.col("is_penalty"), F.lit(0)) == 1
    total = lambda where, value: F.coalesce(F.sum(F.when(where, value)), F.lit(0.0))
    player = ["player_id", "player_name", "team_id"]
    sums = kept.groupBy(*player).agg(
        F.count_if(is_shot()).alias("shots"),
        F.count_if(is_shot() & F.col("type_id").isin(13, 16)).alias("shots_on_target"),
        F.count_if(is_shot() & success).alias("goals"),
        F.count_if(is_shot() & success & penalty).alias("penalty_goals"),
        total(is_shot(), F.col("xg")).alias("xg"),
        total(is_shot() & ~penalty, F.col("xg")).alias("npxg"),
        F.count_if(is_pass & (F.col("is_key_pass") == 1)).alias("key_passes"),
        F.count_if(is_pass & (F.col("is_assist") == 1)).alias("assists"),
        total(is_pass, F.col("xa")).alias("xa"),
        F.count_if(is_pass).alias("passes_attempted"),
        F.count_if(is_pass & success).alias("passes_completed"),
        total(is_pass, F.col("xpass")).alias("sum_xpass"),
    )
    minutes = lineups.groupBy(*player).agg(
        F.coalesce(F.sum("minutes_played"), F.lit(0)).alias("minutes"),
        F.min_by("team_name", "match_id").alias("team_name"),
    )
    joined = minutes.join(sums, player, "left").na.fill(0, [c for c in sums.columns if c not in player])
    joined = joined.withColumns(
        {
            "npgoals": F.col("goals") - F.col("penalty_goals"),
            "xpass_overperformance": F.col("passes_completed") - F.col("sum_xpass"),
            "xpass_avg": F.coalesce(F.try_divide("sum_xpass", "passes_attempted"), F.lit(0.0)),
            "goals_minus_xg": F.col("goals") - F.col("xg"),
        }
    )
    rate = lambda c: F.coalesce(
        F.round(F.try_divide(F.col(c), F.col("minutes")) * F.lit(MINUTES_PER_MATCH), 2), F.lit(0.0)
    )
    joined = joined.withColumns(
        {
            "xg_per90": rate("xg"),
            "xa_per90": rate("xa"),
            "xpass_overperformance_per90": rate("xpass_overperformance"),
        }
    )
    if min_minutes > 0:
        joined = joined.where(F.col("minutes") >= min_minutes)
    return joined.orderBy(F.desc("minutes"))


def stream_shots(actions: DataFrame, lineups: DataFrame | None = None) -> DataFrame:
    """Shots of the stream as rows for the segment operators, with the team's name."""
    shots = actions.where(is_shot())
    if lineups is not None and {"team_id", "team_name"} <= set(lineups.columns):
        # One name per team; the larger of duplicates.
        names = lineups.groupBy("team_id").agg(F.max("team_name").alias("team"))
        shots = shots.join(names, "team_id", "left")
    else:
        shots = shots.withColumn("team", F.col("team_id").cast("string"))
    is_penalty = F.col("is_penalty").cast("boolean") if "is_penalty" in shots.columns else F.lit(False)
    return shots.select(
        "match_id",
        F.floor(F.col("time_seconds") / 60).cast("double").alias("minute"),
        "team",
        "player_id",
        "player_name",
        "xg",
        (F.col("result") == "success").alias("is_goal"),
        is_penalty.alias("is_penalty"),
    )


def match_xg(shots: DataFrame, home_teams: DataFrame) -> DataFrame:
    """Total and non-penalty chance per match for home and away.

    `home_teams` has match_id and home_team. Matches with shots of one side only stay in,
    the other side at 0; a team without a non-penalty shot does not count as a side.
    """
    teams = shots.groupBy("match_id", "team").agg(
        F.sum("xg").alias("xg"),
        F.sum(F.when(~F.col("is_penalty"), F.col("xg"))).alias("npxg"),
        F.count_if(~F.col("is_penalty")).alias("_np"),
    ).where(F.col("_np") > 0)
    sided = teams.join(home_teams, "match_id").withColumn("_home", F.col("team") == F.col("home_team"))
    side = lambda c, home: F.coalesce(F.sum(F.when(F.col("_home") == home, F.col(c))), F.lit(0.0))
    return sided.where(F.col("_home").isNotNull()).groupBy("match_id").agg(
        side("xg", True).alias("home_xg"),
        side("npxg", True).alias("home_npxg"),
        side("xg", False).alias("away_xg"),
        side("npxg", False).alias("away_npxg"),
    )
