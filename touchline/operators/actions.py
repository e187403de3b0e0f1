"""Raw match events to a canonical action stream."""

from pyspark.sql import Column, DataFrame, functions as F

from touchline.functions.numeric import col
from touchline.functions.names import lookup
from touchline.operators.ordering import HotGroups, Ordering, split_hot

# Event type names by code.
TYPE_NAMES = {
    1: "Pass", 2: "Offside Pass", 3: "Take On", 4: "Foul", 5: "Ball Out", 6: "Corner Awarded",
    7: "Tackle", 8: "Interception", 9: "Turnover", 10: "Save", 11: "Claim", 12: "Clearance",
    13: "Miss", 14: "Post", 15: "Attempt Saved", 16: "Goal", 17: "Card", 18: "Player Off",
    19: "Player On", 27: "Start", 28: "End", 30: "End 1H", 32: "Start 2H", 34: "Team Set Up",
    35: "Position Change", 36: "Jersey Change", 37: "Collection End", 40: "Formation Change",
    41: "Punch", 42: "Good Skill", 43: "Deleted Event", 44: "Aerial", 45: "Challenge",
    49: "Ball Recovery", 50: "Blocked Pass", 51: "Delay of Play", 52: "Keeper Pick-up",
    53: "Chance Missed", 54: "Ball Touch", 55: "Temp Goal", 56: "Resume Play",
    57: "Contentious Decision", 61: "Ball Touch", 67: "Offside", 68: "Offside Provoked",
    70: "Shield Ball", 74: "Injury Clearance", 77: "Keeper Sweeper", 80: "Chance Missed",
    83: "Att One on One", 84: "Unknown",
}

# Codes that are no play on the ball.
NON_GAMEPLAY_TYPES = [
    2, 5, 6, 17, 18, 19, 20, 27, 28, 30, 32, 34, 35, 36, 37, 40, 43, 45, 51, 53, 55, 56, 57,
    58, 59, 60, 65, 67, 68, 74, 80, 84,
]

# Action name by code; every other code is "other".
ACTION_TYPES = {
    1: "pass", 3: "take_on", 4: "foul", 7: "tackle", 8: "interception", 10: "keeper_save",
    11: "keeper_claim", 12: "clearance", 13: "shot", 14: "shot", 15: "shot", 16: "shot",
    41: "keeper_punch", 42: "take_on", 44: "aerial", 49: "ball_recovery", 50: "dispossessed",
    52: "keeper_pick_up", 54: "ball_touch", 61: "ball_touch", 83: "take_on",
}
SHOT_CODES = [13, 14, 15, 16]
GOAL_CODE = 16

# Actions that leave the ball where they happen.
STATIONARY_ACTIONS = [
    "tackle", "interception", "ball_recovery", "ball_touch", "take_on", "foul", "dispossessed",
    "keeper_save", "keeper_pick_up", "keeper_claim", "keeper_punch", "aerial", "clearance",
]

# Qualifier key behind each flag.
QUALIFIER_FLAGS = {
    "is_cross": "2", "is_through_ball": "4", "is_long_ball": "1", "is_corner": "6",
    "is_freekick": "5", "is_throw_in": "107", "is_goal_kick": "124", "is_headed": "15",
    "is_right_foot": "72", "is_left_foot": "36", "is_big_chance": "214", "is_own_goal": "28",
}
PENALTY_QUALIFIER = "9"

EVENT_ORDER = Ordering(
    keys=("match_id",),
    by=("period_id", "time_seconds", "event_id"),
    position="period_id * 10000000 + time_seconds",
)
ACTION_ORDER = Ordering(
    keys=("match_id",),
    by=("period_id", "time_seconds", "action_id"),
    position="period_id * 10000000 + time_seconds",
)
ACTION_ID_ORDER = Ordering(keys=("match_id",), by=("action_id",), position="action_id")


def has_qualifier(keys: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(keys, key), F.lit(False))


def with_qualifier_flags(
    events: DataFrame, json: str = "qualifier_json", flags: dict[str, str] = QUALIFIER_FLAGS
) -> DataFrame:
    """One boolean per qualifier, true when the JSON object has its key (even with a null value)."""
    parsed = events.withColumn("_keys", F.json_object_keys(json))
    return parsed.withColumns({out: has_qualifier(F.col("_keys"), key) for out, key in flags.items()}).drop("_keys")


def action_type(type_id="type_id") -> Column:
    return F.coalesce(lookup(col(type_id).cast("int"), ACTION_TYPES), F.lit("other"))


def body_part(type_id="type_id") -> Column:
    code = col(type_id)
    return F.when(code == 44, "head").when(code.isin(10, 52, 53), "other").otherwise("foot")


def action_result(type_id="type_id", outcome="outcome") -> Column:
    ok = F.when(col(type_id).isin(SHOT_CODES), col(type_id) == GOAL_CODE).otherwise(col(outcome) == 1)
    return F.when(ok, "success").when(~ok, "fail")


def _typed_actions(events: DataFrame) -> DataFrame:
    """Row-wise part of the conversion: filters, clock, action name, coordinates, result."""
    columns = events.columns
    if "qualifier_json" in columns:
        events = with_qualifier_flags(events)
    kept = events.where(
        F.col("player_name").isNotNull()
        & (F.col("player_name") != "")
        & ~F.col("type_id").isin(NON_GAMEPLAY_TYPES)
    )
    typed = kept.withColumns(
        {
            "time_seconds": (F.col("minute") * 60 + F.col("second")).cast("long"),
            "start_x": F.col("x").cast("double"),
            "start_y": F.col("y").cast("double"),
            "end_x": F.col("end_x" if "end_x" in columns else "x").cast("double"),
            "end_y": F.col("end_y" if "end_y" in columns else "y").cast("double"),
            "type_name": lookup(F.col("type_id").cast("int"), TYPE_NAMES),
            "action_type": action_type(),
            "result": action_result(),
            "bodypart": body_part(),
        }
    )
    stays = F.col("action_type").isin(STATIONARY_ACTIONS) & (F.col("end_x") == 0)
    return typed.withColumns(
        {
            "end_y": F.when(stays, F.col("start_y")).otherwise(F.col("end_y")),
            "end_x": F.when(stays, F.col("start_x")).otherwise(F.col("end_x")),
        }
    )


def normalize_direction(actions: DataFrame) -> DataFrame:
    """Mirror team-periods whose mean start_x is 50 or less, so every team attacks to the right."""
    keys = ["match_id", "period_id", "team_id"]
    facing = actions.groupBy(*keys).agg((F.avg("start_x") <= 50).alias("_flip"))
    joined = actions.join(facing, keys, "left")
    flip = F.coalesce(F.col("_flip"), F.lit(False))
    coordinates = ["start_x", "start_y", "end_x", "end_y"]
    return joined.withColumns({c: F.when(flip, 100 - F.col(c)).otherwise(F.col(c)) for c in coordinates}).drop("_flip")


def merge_duels(actions: DataFrame, order: Ordering) -> DataFrame:
    """Fold the two rows of a duel into the winner's row, which then names the opponent.

    A pair is two neighbouring rows of opposing teams: the same kind (aerial, tackle) in the
    same second, or dribble against tackle and foul against foul within a second at mirrored
    spots. A row can win one pair and lose the next; the later decision on a row holds.
    """
    seen = ["period_id", "time_seconds", "action_type", "team_id", "result", "start_x"]
    df = order.shift(actions, {f"_n_{c}": (c, -1) for c in seen})
    now, nxt = F.col, lambda c: F.col(f"_n_{c}")
    true = lambda c: F.coalesce(c, F.lit(False))
    rivals = (now("period_id") == nxt("period_id")) & (now("team_id") != nxt("team_id"))
    gap = F.abs(now("time_seconds") - nxt("time_seconds"))
    same_kind = (
        rivals & now("action_type").isin("aerial", "tackle") & (now("action_type") == nxt("action_type")) & (gap == 0)
    )
    tackled = now("action_type").isin("take_on", "dispossessed") & (nxt("action_type") == "tackle")
    fouls = (now("action_type") == "foul") & (nxt("action_type") == "foul")
    mirrored = F.abs(now("start_x") + nxt("start_x") - 100) < 2
    cross_kind = rivals & (gap <= 1) & mirrored & (tackled | fouls)
    pair = true(same_kind) | true(cross_kind)
    df = df.withColumns(
        {
            "_first_wins": true(pair & ((now("result") == "success") | (nxt("result") != "success"))),
            "_second_wins": true(
                (pair & (now("result") == "fail") & (nxt("result") == "success"))
                | (cross_kind & tackled & (now("result") == nxt("result")))
            ),
        }
    )
    df = order.shift(df, {"_p_first": ("_first_wins", 1), "_p_second": ("_second_wins", 1)})
    won_back = true(F.col("_p_second"))
    df = df.withColumns(
        {
            "_wins": won_back | (~F.col("_second_wins") & F.col("_first_wins")),
            "_loses": ~won_back & (F.col("_second_wins") | true(F.col("_p_first"))),
        }
    )
    around = {}
    for c in ("_loses", "player_id", "player_name"):
        around |= {f"_b_{c}": (c, 1), f"_a_{c}": (c, -1)}
    df = order.shift(df, around)
    beat_before = F.col("_wins") & true(F.col("_b__loses"))
    beat_after = F.col("_wins") & true(F.col("_a__loses"))
    rival = lambda c: F.when(beat_before, F.col(f"_b_{c}")).when(beat_after, F.col(f"_a_{c}"))
    merged = df.withColumns(
        {"opponent_player_id": rival("player_id"), "opponent_player_name": rival("player_name")}
    ).where(~F.col("_loses"))
    return merged.drop(*[c for c in merged.columns if c.startswith("_") and c != "_chunk"])


ACTION_COLUMNS = [
    "match_id", "action_id", "period_id", "time_seconds", "team_id", "player_id", "player_name",
    "start_x", "start_y", "end_x", "end_y", "action_type", "action_type_id", "type_id", "type_name",
    "result", "bodypart", "receiver_player_id", "receiver_player_name", "receiver_team_id",
    "possession_change", "opponent_player_id", "opponent_player_name",
]


def to_actions(events: DataFrame, normalize: bool = False, hot: HotGroups | None = None) -> DataFrame:
    """Convert raw events to actions: typed, ordered, duels merged, receiver = next actor.

    Expects match_id, event_id, type_id, team_id, player_id, player_name, minute, second, x, y,
    outcome, period_id; end_x, end_y and qualifier_json are used when present. Ties inside a
    second follow event_id.
    """
    typed = _typed_actions(events)
    if normalize:
        typed = normalize_direction(typed)
    at_goal = F.col("action_type") == "shot"
    typed = typed.withColumns(
        {
            "end_x": F.when(at_goal, F.lit(100.0)).otherwise(F.col("end_x")),
            "end_y": F.when(at_goal, F.lit(50.0)).otherwise(F.col("end_y")),
        }
    )
    # At most one level per action name: sixteen.
    levels = typed.agg(F.sort_array(F.collect_set("action_type"))).scalar()
    optional = [c for c in ("is_own_goal", "is_big_chance") if c in typed.columns]

    def sequence(df: DataFrame, order: Ordering) -> DataFrame:
        df = merge_duels(df, order)
        df = order.running_sum(df, {"action_id": F.lit(1).cast("long")})
        df = order.shift(
            df,
            {
                "receiver_player_id": ("player_id", -1),
                "receiver_player_name": ("player_name", -1),
                "receiver_team_id": ("team_id", -1),
            },
        )
        changed = F.col("receiver_team_id") != F.col("team_id")
        return df.withColumn("possession_change", F.coalesce(changed, F.lit(False)))

    sequenced = split_hot(typed, EVENT_ORDER, sequence, hot=hot)
    sequenced = sequenced.withColumn("action_type_id", F.array_position(levels, F.col("action_type")).cast("int"))
    return sequenced.select(*ACTION_COLUMNS, *optional)


def physical_discontinuity(actions: DataFrame, hot: HotGroups | None = None) -> DataFrame:
    """Gap between where an action ends and where the next starts, in one fixed frame.

    The frame is that of the match's first acting team; the other team is mirrored.
    """
    first = actions.groupBy("match_id").agg(
        F.min_by("team_id", F.struct("period_id", "time_seconds", "action_id")).alias("_frame")
    )

    def sequence(df: DataFrame, order: Ordering) -> DataFrame:
        return order.shift(df, {"_team": ("team_id", -1), "_x": ("start_x", -1), "_y": ("start_y", -1)})

    df = split_hot(actions, ACTION_ORDER, sequence, hot=hot).join(first, "match_id", "left")
    frame = lambda team, v: F.when(F.col(team) == F.col("_frame"), F.col(v)).otherwise(100 - F.col(v))
    df = df.withColumns(
        {
            "phys_end_x": frame("team_id", "end_x"),
            "phys_end_y": frame("team_id", "end_y"),
            "phys_next_x": F.when(F.col("_team").isNotNull(), frame("_team", "_x")),
            "phys_next_y": F.when(F.col("_team").isNotNull(), frame("_team", "_y")),
        }
    )
    dx, dy = F.col("phys_end_x") - F.col("phys_next_x"), F.col("phys_end_y") - F.col("phys_next_y")
    return df.withColumn("phys_disc", F.sqrt(dx * dx + dy * dy)).drop("_frame", "_team", "_x", "_y")
