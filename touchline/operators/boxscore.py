"""Player totals, per-90 rates and ratios out of box scores."""

from pyspark.sql import Column, DataFrame, functions as F

from touchline.constants import MIN_MINUTES_BOXSCORE, MINUTES_PER_MATCH
from touchline.functions.names import player_key
from touchline.operators.ranking import modal_value

# Source A column behind each total, by table.
SUMMARY_COLUMNS = {
    "total_minutes": "min", "goals": "gls", "assists": "ast", "pens": "pk", "pen_att": "p_katt",
    "shots": "sh", "shots_on_target": "so_t", "yellow_cards": "crd_y", "red_cards": "crd_r",
    "touches": "touches", "tackles": "tkl", "interceptions": "int", "blocks": "blocks", "xg": "x_g",
    "npxg": "npx_g", "xa": "x_ag", "sca": "sca", "gca": "gca", "passes_completed": "cmp",
    "passes_attempted": "att", "pass_completion_pct": "cmp_percent", "progressive_passes": "prg_p",
    "carries": "carries", "progressive_carries": "prg_c", "take_ons_att": "att_2", "take_ons_succ": "succ",
}
PASSING_COLUMNS = {
    "pass_cmp": "cmp", "pass_att": "att", "pass_pct": "cmp_percent", "pass_tot_dist": "tot_dist",
    "pass_prg_dist": "prg_dist", "pass_short_cmp": "cmp_2", "pass_short_att": "att_2",
    "pass_short_pct": "cmp_percent_2", "pass_med_cmp": "cmp_3", "pass_med_att": "att_3",
    "pass_med_pct": "cmp_percent_3", "pass_long_cmp": "cmp_4", "pass_long_att": "att_4",
    "pass_long_pct": "cmp_percent_4", "key_passes": "kp", "final_third_passes": "x1_3",
    "passes_into_box": "ppa", "crosses_into_box": "crs_pa", "pass_xa": "x_ag", "pass_xa2": "x_a",
    "progressive_passes_p": "prg_p",
}
DEFENSE_COLUMNS = {
    "tackles_def": "tkl", "tackles_won": "tkl_w", "tackles_def_3rd": "def_3rd",
    "tackles_mid_3rd": "mid_3rd", "tackles_att_3rd": "att_3rd", "challenges_tkl": "tkl_2",
    "challenges_att": "att", "challenges_pct": "tkl_percent", "challenges_lost": "lost",
    "blocks_def": "blocks", "blocks_shots": "sh", "blocks_pass": "pass", "interceptions_def": "int",
    "tkl_plus_int": "tkl_int", "clearances": "clr", "errors": "err",
}
POSSESSION_COLUMNS = {
    "touches_poss": "touches", "touches_def_pen": "def_pen", "touches_def_3rd": "def_3rd",
    "touches_mid_3rd": "mid_3rd", "touches_att_3rd": "att_3rd", "touches_att_pen": "att_pen",
    "touches_live": "live", "take_ons_att_poss": "att", "take_ons_succ_poss": "succ",
    "take_ons_pct": "succ_percent", "take_ons_tkld": "tkld", "carries_poss": "carries",
    "carry_dist_total": "tot_dist", "carry_dist_prg": "prg_dist", "carries_prg": "prg_c",
    "carries_final_3rd": "x1_3", "carries_into_box": "cpa", "miscontrols": "mis", "dispossessed": "dis",
    "passes_received": "rec", "prg_passes_received": "prg_r",
}
MISC_COLUMNS = {
    "yellow_cards_misc": "crd_y", "red_cards_misc": "crd_r", "second_yellows": "x2crd_y",
    "fouls_committed": "fls", "fouls_drawn": "fld", "offsides": "off", "crosses_misc": "crs",
    "tackles_won_misc": "tklw", "penalties_won": "pkwon", "penalties_conceded": "pkcon",
    "own_goals": "og", "recoveries": "recov", "aerials_won": "won_aerial", "aerials_lost": "lost_aerial",
    "aerials_pct": "won_percent_aerial",
}
PASSING_TYPES_COLUMNS = {
    "passes_live": "live_pass_types", "passes_dead": "dead_pass_types", "passes_fk": "fk_pass_types",
    "through_balls": "tb_pass_types", "switches": "sw_pass_types", "crosses_pt": "crs_pass_types",
    "throw_ins": "ti_pass_types", "corner_kicks": "ck_pass_types", "corners_inswing": "in_corner_kicks",
    "corners_outswing": "out_corner_kicks", "corners_straight": "str_corner_kicks",
    "passes_offside": "off_outcomes", "passes_blocked": "blocks_outcomes",
}
KEEPER_COLUMNS = {
    "shots_on_target_against": "so_ta", "goals_against": "ga", "saves": "saves", "save_pct": "save_percent",
    "psxg": "ps_xg", "gk_launch_pct": "launch_percent_launched", "gk_launch_avg_len": "avg_len_launched",
    "gk_opp_passes": "opp_opp", "gk_passes_stopped": "stp_opp", "gk_stop_pct": "stp_percent_opp",
    "gk_sweeper_actions": "att_sweeper", "gk_sweeper_dist": "avg_dist_sweeper",
}

# Totals turned into `<name>_p90`, where the source name differs from the rate's.
RATES_A = [
    "goals", "assists", "shots", "shots_on_target", "xg", "npxg", "xa", "sca", "gca", "tackles",
    "interceptions", "blocks", "clearances", "tackles_won", "tackles_def_3rd", "tackles_mid_3rd",
    "tackles_att_3rd", "blocks_shots", "blocks_pass", "errors", "touches", "progressive_passes",
    "key_passes", "final_third_passes", "passes_into_box", "crosses_into_box", "pass_long_cmp",
    "pass_short_cmp", "pass_med_cmp", "pass_tot_dist", "pass_prg_dist", "carries", "progressive_carries",
    "carries_final_3rd", "carries_into_box", "take_ons_att", "take_ons_succ", "miscontrols",
    "dispossessed", "prg_passes_received", "touches_def_3rd", "touches_mid_3rd", "touches_att_3rd",
    "touches_att_pen", "fouls_committed", "fouls_drawn", "offsides", "recoveries", "aerials_won",
    "aerials_lost", "penalties_won", "penalties_conceded", "through_balls", "switches", "corner_kicks",
    "passes_dead", "saves", "goals_against", "gk_sweeper_actions",
]
RATE_SOURCES_A = {"crosses": "crosses_pt"}

# Source C column behind each total.
FEED_COLUMNS = {
    "total_minutes": "minsPlayed", "goals": "goals", "goals_openplay": "goalsOpenplay",
    "shots": "totalScoringAtt", "shots_ibox": "attemptsIbox", "shots_obox": "attemptsObox",
    "shots_on_target": "ontargetScoringAtt", "shot_off_target": "shotOffTarget",
    "shots_blocked": "blockedScoringAtt", "big_chance_created": "bigChanceCreated",
    "big_chance_scored": "bigChanceScored", "big_chance_missed": "bigChanceMissed",
    "assists": "goalAssist", "assists_openplay": "goalAssistOpenplay",
    "assists_setplay": "goalAssistSetplay", "second_assists": "secondGoalAssist",
    "total_att_assist": "totalAttAssist", "on_target_att_assist": "ontargetAttAssist",
    "passes": "totalPass", "passes_accurate": "accuratePass",
    "final_third_passes": "totalFinalThirdPasses", "final_third_passes_acc": "successfulFinalThirdPasses",
    "long_balls": "totalLongBalls", "long_balls_acc": "accurateLongBalls",
    "through_balls": "totalThroughBall", "through_balls_acc": "accurateThroughBall",
    "crosses": "totalCross", "crosses_acc": "accurateCross", "key_passes": "putThrough",
    "key_passes_success": "successfulPutThrough", "backward_pass": "backwardPass",
    "forward_pass": "fwdPass", "layoffs": "totalLayoffs", "layoffs_acc": "accurateLayoffs",
    "tackles": "totalTackle", "tackles_won": "wonTackle", "interceptions": "interception",
    "interceptions_won": "interceptionWon", "interceptions_ibox": "interceptionsInBox",
    "clearances": "totalClearance", "clearances_effective": "effectiveClearance",
    "head_clearances": "headClearance", "head_clearances_effective": "effectiveHeadClearance",
    "blocks": "outfielderBlock", "blocked_passes": "blockedPass", "blocked_crosses": "blockedCross",
    "duel_won": "duelWon", "duel_lost": "duelLost", "aerial_won": "aerialWon", "aerial_lost": "aerialLost",
    "contest_won": "wonContest", "contest_total": "totalContest", "challenge_lost": "challengeLost",
    "touches": "touches", "touches_opp_box": "touchesInOppBox", "poss_won_def3rd": "possWonDef3rd",
    "poss_won_mid3rd": "possWonMid3rd", "poss_won_att3rd": "possWonAtt3rd",
    "ball_recovery": "ballRecovery", "dispossessed": "dispossessed", "turnover": "turnover",
    "poss_lost_all": "possLostAll", "times_tackled": "timesTackled", "fouls": "fouls",
    "was_fouled": "wasFouled", "fouled_final_third": "fouledFinalThird", "yellow_cards": "yellowCard",
    "red_cards": "redCard", "second_yellows": "secondYellow", "corners_taken": "cornerTaken",
    "corners_won": "wonCorners", "corners_lost": "lostCorners", "corners_intobox": "totalCornersIntobox",
    "corners_intobox_acc": "accurateCornersIntobox", "freekick_crosses": "freekickCross",
    "saves": "saves", "saves_ibox": "savedIbox", "saves_obox": "savedObox",
    "goals_conceded": "goalsConceded", "goals_conceded_ibox": "goalsConcededIbox",
    "high_claim": "totalHighClaim", "good_high_claim": "goodHighClaim", "punches": "punches",
    "keeper_throws": "keeperThrows", "keeper_throws_acc": "accurateKeeperThrows",
    "fwd_zone_pass": "totalFwdZonePass", "fwd_zone_pass_acc": "accurateFwdZonePass",
    "open_play_pass": "openPlayPass", "open_play_pass_acc": "successfulOpenPlayPass",
    "error_lead_to_shot": "errorLeadToShot", "error_lead_to_goal": "errorLeadToGoal",
    "att_fastbreak": "attFastbreak", "shot_fastbreak": "shotFastbreak", "att_openplay": "attOpenplay",
    "att_setpiece": "attSetpiece", "att_headed": "attHdTotal", "att_headed_goal": "attHdGoal",
    "att_one_on_one": "attOneOnOne", "crosses_open_play": "totalCrossNocorner",
    "crosses_open_play_acc": "accurateCrossNocorner", "penalty_won": "penaltyWon",
    "penalty_conceded": "penaltyConceded", "offtarget_att_assist": "offtargetAttAssist",
    "last_man_tackle": "lastManTackle", "six_yard_block": "sixYardBlock",
    "clearance_off_line": "clearanceOffLine", "keeper_sweeper": "totalKeeperSweeper",
    "keeper_sweeper_acc": "accurateKeeperSweeper", "attempts_conceded_ibox": "attemptsConcededIbox",
    "attempts_conceded_obox": "attemptsConcededObox", "gk_smother": "gkSmother",
    "unsuccessful_touch": "unsuccessfulTouch", "overrun": "overrun", "flick_on": "totalFlickOn",
    "flick_on_acc": "accurateFlickOn", "offsides": "totalOffside", "offside_provoked": "offsideProvoked",
    "pen_area_entries": "penAreaEntries", "final_third_entries": "finalThirdEntries",
    "pull_backs": "totalPullBack", "pull_backs_acc": "accuratePullBack",
    "back_zone_pass": "totalBackZonePass", "back_zone_pass_acc": "accurateBackZonePass",
    "chipped_pass": "totalChippedPass", "chipped_pass_acc": "accurateChippedPass",
    "att_rf_total": "attRfTotal", "att_lf_total": "attLfTotal", "att_ibox_goal": "attIboxGoal",
    "att_obox_goal": "attOboxGoal", "att_ibox_target": "attIboxTarget", "att_obox_target": "attOboxTarget",
    "hit_woodwork": "hitWoodwork", "att_pen_goal": "attPenGoal", "att_pen_miss": "attPenMiss",
    "pen_goals_conceded": "penGoalsConceded", "keeper_pickup": "keeperPickUp",
    "poss_lost_ctrl": "possLostCtrl", "long_pass_own_to_opp": "longPassOwnToOpp",
    "long_pass_own_to_opp_acc": "longPassOwnToOppSuccess", "fifty_fifty": "fiftyFifty",
    "fifty_fifty_won": "successfulFiftyFifty",
}

# Source C totals turned into `<name>_p90`.
RATES_C = [
    "goals", "shots", "shots_on_target", "shots_ibox", "shots_obox", "big_chance_scored",
    "big_chance_missed", "assists", "big_chance_created", "total_att_assist", "key_passes",
    "through_balls", "passes", "passes_accurate", "final_third_passes", "long_balls", "crosses",
    "forward_pass", "tackles", "tackles_won", "interceptions", "interceptions_won", "clearances",
    "clearances_effective", "blocks", "blocked_passes", "duel_won", "duel_lost", "aerial_won",
    "aerial_lost", "touches", "touches_opp_box", "poss_won_def3rd", "poss_won_mid3rd",
    "poss_won_att3rd", "ball_recovery", "dispossessed", "turnover", "times_tackled", "corners_taken",
    "corners_won", "pen_area_entries", "final_third_entries", "fouls", "was_fouled", "saves",
    "goals_conceded", "fwd_zone_pass", "open_play_pass", "error_lead_to_shot", "error_lead_to_goal",
    "att_fastbreak", "shot_fastbreak", "att_openplay", "att_setpiece", "att_headed", "att_one_on_one",
    "crosses_open_play", "penalty_won", "penalty_conceded", "offtarget_att_assist", "last_man_tackle",
    "six_yard_block", "clearance_off_line", "keeper_sweeper", "attempts_conceded_ibox",
    "attempts_conceded_obox", "gk_smother", "unsuccessful_touch", "overrun", "flick_on",
    "back_zone_pass", "chipped_pass", "att_rf_total", "att_lf_total", "att_ibox_goal", "att_obox_goal",
    "att_ibox_target", "att_obox_target", "hit_woodwork", "att_pen_goal", "att_pen_miss",
    "pen_goals_conceded", "keeper_pickup", "poss_lost_ctrl", "long_pass_own_to_opp", "fifty_fifty",
    "fifty_fifty_won",
]

# Ratios as (numerator totals, denominator totals), summed on each side.
RATIOS_A = {
    "shot_accuracy": (["shots_on_target"], ["shots"]),
    "goals_per_shot": (["goals"], ["shots"]),
    "xg_per_shot": (["xg"], ["shots"]),
    "pass_completion": (["passes_completed"], ["passes_attempted"]),
    "pass_short_success": (["pass_short_cmp"], ["pass_short_att"]),
    "pass_med_success": (["pass_med_cmp"], ["pass_med_att"]),
    "pass_long_success": (["pass_long_cmp"], ["pass_long_att"]),
    "long_pass_ratio": (["pass_long_att"], ["pass_att"]),
    "take_on_success": (["take_ons_succ"], ["take_ons_att"]),
    "tackle_success": (["tackles_won"], ["tackles"]),
    "challenge_success": (["challenges_tkl"], ["challenges_att"]),
    "aerial_success": (["aerials_won"], ["aerials_won", "aerials_lost"]),
    "gk_save_pct": (["saves"], ["shots_on_target_against"]),
}
RATIOS_C = {
    "shot_accuracy": (["shots_on_target"], ["shots"]),
    "goals_per_shot": (["goals"], ["shots"]),
    "ibox_shot_ratio": (["shots_ibox"], ["shots"]),
    "big_chance_conversion": (["big_chance_scored"], ["big_chance_scored", "big_chance_missed"]),
    "pass_accuracy": (["passes_accurate"], ["passes"]),
    "final_third_pass_acc": (["final_third_passes_acc"], ["final_third_passes"]),
    "long_ball_accuracy": (["long_balls_acc"], ["long_balls"]),
    "through_ball_accuracy": (["through_balls_acc"], ["through_balls"]),
    "cross_accuracy": (["crosses_acc"], ["crosses"]),
    "tackle_success": (["tackles_won"], ["tackles"]),
    "interception_success": (["interceptions_won"], ["interceptions"]),
    "clearance_effectiveness": (["clearances_effective"], ["clearances"]),
    "duel_success": (["duel_won"], ["duel_won", "duel_lost"]),
    "aerial_success": (["aerial_won"], ["aerial_won", "aerial_lost"]),
    "poss_won_att_ratio": (["poss_won_att3rd"], ["poss_won_def3rd", "poss_won_mid3rd", "poss_won_att3rd"]),
    "fwd_zone_pass_accuracy": (["fwd_zone_pass_acc"], ["fwd_zone_pass"]),
    "open_play_pass_accuracy": (["open_play_pass_acc"], ["open_play_pass"]),
    "crosses_open_play_accuracy": (["crosses_open_play_acc"], ["crosses_open_play"]),
    "bad_touch_rate": (["unsuccessful_touch", "overrun"], ["touches"]),
    "headed_goal_rate": (["att_headed_goal"], ["att_headed"]),
    "flick_on_accuracy": (["flick_on_acc"], ["flick_on"]),
    "keeper_sweeper_accuracy": (["keeper_sweeper_acc"], ["keeper_sweeper"]),
    "back_zone_pass_accuracy": (["back_zone_pass_acc"], ["back_zone_pass"]),
    "chipped_pass_accuracy": (["chipped_pass_acc"], ["chipped_pass"]),
    "ibox_goal_rate": (["att_ibox_goal"], ["shots_ibox"]),
    "obox_goal_rate": (["att_obox_goal"], ["shots_obox"]),
    "penalty_conversion": (["att_pen_goal"], ["att_pen_goal", "att_pen_miss"]),
    "long_pass_own_to_opp_accuracy": (["long_pass_own_to_opp_acc"], ["long_pass_own_to_opp"]),
    "fifty_fifty_success": (["fifty_fifty_won"], ["fifty_fifty"]),
    "poss_lost_ctrl_per_touch": (["poss_lost_ctrl"], ["touches"]),
    "save_percentage": (["saves"], ["saves", "goals_conceded"]),
}

# Position patterns behind the dummies.
POSITIONS_A = {"is_gk": "GK", "is_df": "DF|CB|LB|RB|WB", "is_mf": "MF|CM|DM|AM", "is_fw": "FW|ST|CF|LW|RW"}
POSITIONS_C = {"is_gk": "Goalkeeper", "is_df": "Defender", "is_mf": "Midfielder", "is_fw": "Forward|Striker"}


def _value(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(0.0)
    return F.coalesce(F.col(name).try_cast("double"), F.lit(0.0))


def _total(df: DataFrame, names: list[str]) -> Column:
    total = _value(df, names[0])
    for n in names[1:]:
        total = total + _value(df, n)
    return total


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def position_dummies(df: DataFrame, patterns: dict[str, str], position: Column) -> DataFrame:
    return df.withColumns(
        {out: F.coalesce(position.rlike(f"(?i){p}"), F.lit(False)).cast("int") for out, p in patterns.items()}
    )


def numbers_filled(df: DataFrame) -> DataFrame:
    """Numeric NULL and NaN as 0."""
    return df.na.fill(0)


def rates_and_ratios_a(df: DataFrame) -> DataFrame:
    """Source A per-90 rates, ratios, differences and position dummies."""
    played = F.col("total_minutes") / MINUTES_PER_MATCH
    per90 = lambda c: F.try_divide(c, F.col("mins_per_90"))
    df = df.withColumn("mins_per_90", played)
    df = df.withColumns(
        {
            **{f"{c}_p90": per90(_value(df, c)) for c in RATES_A},
            **{f"{c}_p90": per90(_value(df, s)) for c, s in RATE_SOURCES_A.items()},
        }
    )
    ratios = {out: _ratio(_total(df, a), _total(df, b)) for out, (a, b) in RATIOS_A.items()}
    touches = _value(df, "touches_poss")
    touches = F.when(touches == 0, _value(df, "touches")).otherwise(touches)
    carries = _value(df, "carries_poss")
    carries = F.when(carries == 0, _value(df, "carries")).otherwise(carries)
    turnovers = _total(df, ["miscontrols", "dispossessed"])
    prevented = _value(df, "psxg") - _value(df, "goals_against")
    df = df.withColumns(
        {
            **ratios,
            "goals_minus_xg": F.col("goals_p90") - F.col("xg_p90"),
            "npxg_plus_xa_p90": F.col("npxg_p90") + F.col("xa_p90"),
            "touch_def_3rd_pct": _ratio(_value(df, "touches_def_3rd"), touches),
            "touch_mid_3rd_pct": _ratio(_value(df, "touches_mid_3rd"), touches),
            "touch_att_3rd_pct": _ratio(_value(df, "touches_att_3rd"), touches),
            "touch_att_pen_pct": _ratio(_value(df, "touches_att_pen"), touches),
            "turnovers_p90": per90(turnovers),
            "carry_retention": F.when(carries > 0, 1 - F.try_divide(turnovers, carries)),
            "prg_actions_per_touch": _ratio(_total(df, ["progressive_carries", "progressive_passes"]), touches),
            "aerials_total_p90": per90(_total(df, ["aerials_won", "aerials_lost"])),
            "foul_differential_p90": F.col("fouls_drawn_p90") - F.col("fouls_committed_p90"),
            "gk_goals_prevented": prevented,
            "gk_goals_prevented_p90": per90(prevented),
        }
    )
    if "primary_position" in df.columns:
        df = position_dummies(df, POSITIONS_A, F.split(F.col("primary_position"), ",")[0])
    return df


def rates_and_ratios_c(df: DataFrame) -> DataFrame:
    """Source C per-90 rates, ratios and position dummies."""
    per90 = lambda c: F.try_divide(c, F.col("mins_per_90"))
    df = df.withColumn("mins_per_90", F.col("total_minutes") / MINUTES_PER_MATCH)
    df = df.withColumns({f"{c}_p90": per90(_value(df, c)) for c in RATES_C})
    df = df.withColumns(
        {
            **{out: _ratio(_total(df, a), _total(df, b)) for out, (a, b) in RATIOS_C.items()},
            "poss_won_total_p90": per90(_total(df, ["poss_won_def3rd", "poss_won_mid3rd", "poss_won_att3rd"])),
            "turnovers_p90": per90(_total(df, ["dispossessed", "turnover"])),
            "foul_differential_p90": F.col("was_fouled_p90") - F.col("fouls_p90"),
            "errors_total_p90": per90(_total(df, ["error_lead_to_shot", "error_lead_to_goal"])),
        }
    )
    if "primary_position" in df.columns:
        df = position_dummies(df, POSITIONS_C, F.col("primary_position"))
    return df


def _sums(df: DataFrame, mapping: dict[str, str]) -> list[Column]:
    return [
        F.coalesce(F.sum(F.col(c).try_cast("double")), F.lit(0.0)).alias(out)
        for out, c in mapping.items()
        if c in df.columns
    ]


def cleaned_name(c="player_name") -> Column:
    return F.trim(F.regexp_replace(F.col(c), "\u00a0", " "))


def player_totals_a(
    summary: DataFrame,
    passing: DataFrame | None = None,
    defense: DataFrame | None = None,
    possession: DataFrame | None = None,
    misc: DataFrame | None = None,
    passing_types: DataFrame | None = None,
    keeper: DataFrame | None = None,
    min_minutes: float = MIN_MINUTES_BOXSCORE,
) -> DataFrame:
    """Source A player features: totals of up to seven tables by name key, rates and ratios."""
    keyed = summary.withColumn("player_id", player_key("player_name"))
    totals = keyed.groupBy("player_id").agg(*_sums(summary, SUMMARY_COLUMNS), F.count(F.lit(1)).alias("n_matches"))
    totals = totals.where(F.col("total_minutes") >= min_minutes)
    names = modal_value(keyed.withColumn("_name", cleaned_name()), ["player_id"], "_name", "player_name")
    totals = totals.join(names.withColumn("player_name", F.initcap(F.lower("player_name"))), "player_id", "left")
    if "pos" in summary.columns:
        positions = modal_value(keyed.where(F.col("pos") != ""), ["player_id"], "pos", "primary_position")
        totals = totals.join(positions, "player_id", "left")
    tables = [
        (passing, PASSING_COLUMNS),
        (defense, DEFENSE_COLUMNS),
        (possession, POSSESSION_COLUMNS),
        (misc, MISC_COLUMNS),
        (passing_types, PASSING_TYPES_COLUMNS),
        (keeper, KEEPER_COLUMNS),
    ]
    for df, mapping in tables:
        if df is not None and _sums(df, mapping):
            sums = df.groupBy(player_key("player_name").alias("player_id")).agg(*_sums(df, mapping))
            totals = totals.join(sums, "player_id", "left")
    return numbers_filled(rates_and_ratios_a(totals))


NO_PLAYER = "\uffff"


def _with_player_id(df: DataFrame) -> DataFrame:
    key = player_key("player_name")
    if "player_id" not in df.columns:
        return df.withColumn("player_id", key)
    return df.withColumn("player_id", F.coalesce(F.col("player_id").cast("string"), key))


def player_totals_c(stats: DataFrame, min_minutes: float = MIN_MINUTES_BOXSCORE) -> DataFrame:
    """Source C player features: totals, distinct matches, modal name and position, rates, ratios.

    Matches are counted apart from the sums: a distinct count beside them would shuffle all sums by player and match.
    """
    # rows without a player are a group too; by a key that is never NULL, totals and counts meet where they lie
    keyed = _with_player_id(stats).withColumn("_key", F.coalesce("player_id", F.lit(NO_PLAYER)))
    totals = keyed.groupBy("_key").agg(F.max("player_id").alias("player_id"), *_sums(stats, FEED_COLUMNS))
    totals = totals.where(F.col("total_minutes") >= min_minutes)
    pairs = keyed.where(F.col("match_id").isNotNull()).select("_key", "match_id").distinct()
    totals = totals.join(pairs.groupBy("_key").agg(F.count(F.lit(1)).alias("n_matches")), "_key", "left").na.fill(0, ["n_matches"])
    known = keyed.where(F.col("player_id").isNotNull())
    names = modal_value(known.withColumn("_name", cleaned_name()), ["_key"], "_name", "player_name")
    totals = totals.join(names, "_key", "left")
    if "position" in stats.columns:
        positions = modal_value(known.where(F.col("position") != ""), ["_key"], "position", "primary_position")
        totals = totals.join(positions, "_key", "left")
    totals = totals.drop("_key")
    return numbers_filled(rates_and_ratios_c(totals))


def opponents(stats: DataFrame, team: str = "team_name") -> DataFrame:
    """(match_id, team, opponent_team): the match's other team, the first in sort order."""
    teams = stats.select("match_id", team).where(F.col(team).isNotNull()).distinct()
    first = teams.groupBy("match_id").agg(F.min(team).alias("_first"))
    paired = teams.join(first, "match_id")
    second = paired.where(F.col(team) != F.col("_first")).groupBy("match_id").agg(F.min(team).alias("_second"))
    other = F.when(F.col(team) == F.col("_first"), F.col("_second")).otherwise(F.col("_first"))
    return paired.join(second, "match_id", "left").select("match_id", team, other.alias("opponent_team"))


def match_level_stats(stats: DataFrame, min_minutes: float = 10) -> DataFrame:
    """Source C rates and ratios per player and match, with venue and opponent."""
    df = _with_player_id(stats)
    renames = {c: out for out, c in FEED_COLUMNS.items() if c in df.columns and c != out}
    df = df.withColumnsRenamed(renames).withColumn("total_minutes", F.col("total_minutes").try_cast("double"))
    df = df.where(F.col("total_minutes") >= min_minutes)
    if "team_position" in df.columns:
        df = df.withColumn("is_home", (F.lower("team_position") == "home").cast("int"))
    if {"match_id", "team_name"} <= set(df.columns):
        df = df.join(opponents(df), ["match_id", "team_name"], "left")
    if "competition" not in df.columns and "league" in df.columns:
        df = df.withColumnRenamed("league", "competition")
    return numbers_filled(rates_and_ratios_c(df))


def sum_by_player(
    df: DataFrame, sums: dict[str, str], by_team: bool = False, player: str = "player", team: str = "team"
) -> DataFrame:
    """Totals per player (with the most frequent team) or per player and team; "1" counts rows."""
    keys = [player, team] if by_team else [player]

    def total(out: str, c: str) -> Column:
        if c == "1":
            return F.count(F.lit(1)).cast("double").alias(out)
        if c not in df.columns:
            return F.lit(0.0).alias(out)
        return F.coalesce(F.sum(F.col(c).try_cast("double")), F.lit(0.0)).alias(out)

    rows = df
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    totals = rows.groupBy(*keys).agg(*[total(out, c) for out, c in sums.items()])
    if not by_team and team in df.columns:
        totals = totals.join(modal_value(rows, [player], team, team), player, "left")
    return totals


def regression_data(features: DataFrame, targets: DataFrame) -> DataFrame:
    """Features with the target `rapm`, joined by player id, else by name."""
    for key in ("player_id", "player_name"):
        if key in features.columns and key in targets.columns:
            return features.join(targets.select(key, "rapm"), key)
    raise ValueError("no common player column")


def add_expected_metrics(features: DataFrame, metrics: DataFrame) -> DataFrame:
    """Attach per-90 chances, assists and passing over expectation; missing players get 0."""
    sums = metrics.groupBy("player_id").agg(
        *[F.sum(c).alias(f"_{c}") for c in ("xg", "npxg", "xa", "xpass_overperformance", "minutes")]
    ).where(F.col("_minutes") > 0)
    rate = lambda c: F.col(f"_{c}") / F.col("_minutes") * MINUTES_PER_MATCH
    outputs = {
        "xg_per90": rate("xg"),
        "npxg_per90": rate("npxg"),
        "xa_per90_xmetrics": rate("xa"),
        "xpass_overperformance_per90_xmetrics": rate("xpass_overperformance"),
    }
    rates = sums.select("player_id", *[v.alias(n) for n, v in outputs.items()])
    return features.join(rates, "player_id", "left").na.fill(0, list(outputs))
