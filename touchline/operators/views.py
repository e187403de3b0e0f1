"""Player statistic views: totals and rates by player, or by player and team."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from touchline.constants import MIN_MINUTES_BOXSCORE
from touchline.functions.names import initial_form_column, matches_text
from touchline.functions.numeric import per_90, safe_divide
from touchline.operators.boxscore import sum_by_player


@dataclass(frozen=True)
class View:
    """Totals (output: raw column), then derived columns in order, then the sort order."""

    totals: dict[str, str]
    derived: dict[str, tuple]
    order: tuple[str, ...] = ("minutes",)
    counts_matches: bool = True


def _rate(stat, digits=2):
    return ("per90", stat, digits)


def _share(top, bottom, digits=1, scale=100):
    return ("share", top, bottom, digits, scale)


# Raw columns, rates and order of every view.
SUMMARY_A = View(
    {"minutes": "min", "goals": "gls", "assists": "ast", "shots": "sh", "shots_on_target": "so_t", "xg": "x_g",
     "npxg": "npx_g", "xag": "x_ag", "sca": "sca", "gca": "gca"},
    {"goals_minus_xg": ("minus", "goals", "xg", 2), "goals_per90": _rate("goals"), "xg_per90": _rate("xg"),
     "npxg_per90": _rate("npxg"), "xag_per90": _rate("xag")},
)
PASSING_A = View(
    {"passes_completed": "cmp", "passes_attempted": "att", "progressive_passes": "prg_p", "key_passes": "kp",
     "passes_into_final_third": "x1_3", "passes_into_penalty_area": "ppa", "crosses": "crs_pa"},
    {"pass_pct": _share("passes_completed", "passes_attempted"), "passes_per90": _rate("passes_completed", 1),
     "progressive_passes_per90": _rate("progressive_passes"), "key_passes_per90": _rate("key_passes")},
)
DEFENSE_A = View(
    {"tackles": "tkl", "tackles_won": "tkl_w", "interceptions": "int", "blocks": "blocks", "clearances": "clr",
     "errors": "err"},
    {"tackles_per90": _rate("tackles"), "interceptions_per90": _rate("interceptions"), "blocks_per90": _rate("blocks"),
     "tackle_win_pct": _share("tackles_won", "tackles")},
)
KEEPER_A = View(
    {"shots_on_target_against": "so_ta", "saves": "saves", "goals_against": "ga", "clean_sheets": "clean_sheet"},
    {"save_pct": _share("saves", "shots_on_target_against"), "goals_against_per90": _rate("goals_against"),
     "clean_sheet_pct": _share("clean_sheets", "matches")},
)
SUMMARY_B = View(
    {"minutes": "time", "goals": "goals", "assists": "assists", "shots": "shots", "key_passes": "key_passes",
     "xg": "x_g", "xa": "x_a", "xg_chain": "x_g_chain", "xg_buildup": "x_g_buildup"},
    {"goals_minus_xg": ("minus", "goals", "xg", 2), "goals_per90": _rate("goals"), "xg_per90": _rate("xg"),
     "xa_per90": _rate("xa")},
)
SUMMARY_C = View(
    {"minutes": "minsPlayed", "goals": "goals", "assists": "goalAssist", "shots": "totalScoringAtt",
     "shots_on_target": "ontargetScoringAtt", "big_chances_created": "bigChanceCreated",
     "big_chances_scored": "bigChanceScored", "big_chances_missed": "bigChanceMissed"},
    {"goals_per90": _rate("goals"), "assists_per90": _rate("assists"), "shots_per90": _rate("shots")},
)
PASSING_C = View(
    {"minutes": "minsPlayed", "passes_completed": "accuratePass", "passes_attempted": "totalPass",
     "long_balls_completed": "accurateLongBalls", "long_balls_attempted": "totalLongBalls",
     "crosses_completed": "accurateCross", "crosses_attempted": "totalCross",
     "through_balls_completed": "accurateThroughBall", "through_balls_attempted": "totalThroughBall",
     "key_passes": "totalAttAssist", "final_third_passes": "successfulFinalThirdPasses"},
    {"pass_pct": _share("passes_completed", "passes_attempted"), "passes_per90": _rate("passes_completed", 1),
     "key_passes_per90": _rate("key_passes")},
)
DEFENSE_C = View(
    {"minutes": "minsPlayed", "tackles": "totalTackle", "tackles_won": "wonTackle", "interceptions": "interception",
     "blocks": "outfielderBlock", "clearances": "totalClearance", "ball_recoveries": "ballRecovery",
     "duels_won": "duelWon", "duels_lost": "duelLost", "aerials_won": "aerialWon", "aerials_lost": "aerialLost",
     "poss_won_def3rd": "possWonDef3rd", "poss_won_mid3rd": "possWonMid3rd"},
    {"tackles_per90": _rate("tackles"), "interceptions_per90": _rate("interceptions"),
     "tackle_win_pct": _share("tackles_won", "tackles"), "aerial_win_pct": _share("aerials_won", ("aerials_won", "aerials_lost"))},
)
POSSESSION_C = View(
    {"minutes": "minsPlayed", "touches": "touches", "touches_final_third": "touchesInFinalThird",
     "touches_opp_box": "touchesInOppBox", "carries": "carries", "progressive_carries": "progressiveCarries",
     "final_third_entries": "finalThirdEntries", "pen_area_entries": "penAreaEntries", "dispossessed": "dispossessed",
     "turnovers": "turnover", "times_tackled": "timesTackled"},
    {"touches_per90": _rate("touches", 1), "progressive_carries_per90": _rate("progressive_carries")},
)
KEEPER_C = View(
    {"minutes": "minsPlayed", "saves": "saves", "saves_ibox": "savedIbox", "saves_obox": "savedObox",
     "goals_conceded": "goalsConceded", "goals_conceded_ibox": "goalsConcededIbox",
     "shots_conceded_ibox": "attemptsConcededIbox", "shots_conceded_obox": "attemptsConcededObox",
     "clean_sheets": "cleanSheet", "diving_saves": "divingSave", "high_claims": "goodHighClaim", "punches": "punches",
     "big_chance_saves": "bigChanceSaves"},
    {"shots_conceded": ("sum", "shots_conceded_ibox", "shots_conceded_obox"),
     "save_pct": _share("saves", ("saves", "goals_conceded")), "goals_against_per90": _rate("goals_conceded"),
     "shots_conceded_per90": _rate("shots_conceded"), "clean_sheet_pct": _share("clean_sheets", "matches")},
)
SHOTS_C = View(
    {"minutes": "minsPlayed", "shots_inside_box": "attemptsIbox", "shots_outside_box": "attemptsObox",
     "shots_on_target": "ontargetScoringAtt", "shots_off_target": "shotOffTarget", "shots_blocked": "blockedScoringAtt",
     "goals": "goals", "goals_inside_box": "attIboxGoal", "goals_outside_box": "attOboxGoal",
     "headed_goals": "attHdGoal", "left_foot_goals": "attLfGoal", "right_foot_goals": "attRfGoal",
     "penalty_goals": "attPenGoal", "big_chances_scored": "bigChanceScored", "big_chances_missed": "bigChanceMissed",
     "hit_woodwork": "hitWoodwork"},
    {"total_shots": ("sum", "shots_inside_box", "shots_outside_box"), "conversion_rate": _share("goals", "total_shots"),
     "shot_accuracy": _share("shots_on_target", "total_shots"), "goals_per90": _rate("goals"),
     "shots_per90": _rate("total_shots")},
    order=("goals", "total_shots"),
)
XG_C = View(
    {"minutes": "minutes", "shots": "shots", "shots_on_target": "shots_on_target", "goals": "goals",
     "npgoals": "npgoals", "xg": "xg", "npxg": "npxg", "key_passes": "key_passes", "assists": "assists", "xa": "xa"},
    {"goals_minus_xg": ("minus", "goals", "xg", 2), "xg_per90": _rate("xg"), "npxg_per90": _rate("npxg"),
     "xa_per90": _rate("xa")},
    order=("xg",),
    counts_matches=False,
)
XPASS_C = View(
    {"minutes": "minutes", "passes_attempted": "passes_attempted", "passes_completed": "passes_completed",
     "sum_xpass": "sum_xpass", "xpass_overperformance": "xpass_overperformance"},
    {"pass_pct": _share("passes_completed", "passes_attempted"),
     "xpass_overperformance_per90": _rate("xpass_overperformance"),
     "xpass_avg": _share("sum_xpass", "passes_attempted", 3, 1)},
    order=("xpass_overperformance",),
    counts_matches=False,
)
SETPIECE_C = View(
    {"minutes": "minsPlayed", "corners_taken": "cornerTaken", "corners_accurate": "accurateCornersIntobox",
     "corners_won": "wonCorners", "freekicks_taken": "attFreekickTotal", "freekick_goals": "attFreekickGoal",
     "freekick_on_target": "attFreekickTarget", "freekick_crosses": "freekickCross",
     "freekick_crosses_accurate": "accurateFreekickCross", "penalties_won": "penaltyWon",
     "penalties_conceded": "penaltyConceded", "setpiece_goals": "attSetpiece", "setpiece_assists": "goalAssistSetplay",
     "deadball_assists": "goalAssistDeadball", "throws_total": "totalThrows", "throws_accurate": "accurateThrows"},
    {"corner_accuracy": _share("corners_accurate", "corners_taken"),
     "throw_accuracy": _share("throws_accurate", "throws_total"), "corners_per90": _rate("corners_taken")},
    order=("corners_taken", "freekicks_taken"),
)


def _derived(spec: tuple) -> Column:
    kind, *args = spec
    total = lambda c: F.col(c) if isinstance(c, str) else F.col(c[0]) + F.col(c[1])
    if kind == "per90":
        return F.round(per_90(args[0], "minutes"), args[1])
    if kind == "share":
        top, bottom, digits, scale = args
        return F.round(safe_divide(F.col(top) * scale, total(bottom)), digits)
    if kind == "minus":
        return F.round(F.col(args[0]) - F.col(args[1]), args[2])
    return F.col(args[0]) + F.col(args[1])


def player_view(
    df: DataFrame,
    view: View,
    name: str | None = None,
    min_minutes: float = MIN_MINUTES_BOXSCORE,
    by_team: bool = False,
    player: str = "player",
    team: str = "team",
    minutes: DataFrame | None = None,
) -> DataFrame:
    """Evaluate a view.

    `name` keeps players whose name matches it (any case) and drops the minutes limit.
    `minutes` (player[, team], minutes) replaces minutes from the table itself.
    """
    if name is not None:
        df = df.where(matches_text(player, name))
    sums = ({"matches": "1"} if view.counts_matches else {}) | view.totals
    totals = sum_by_player(df, sums, by_team, player, team)
    totals = totals.withColumnsRenamed({player: "player", team: "team"})
    if minutes is not None:
        totals = totals.join(minutes, ["player", "team"] if by_team else ["player"], "left")
    for out, spec in view.derived.items():
        totals = totals.withColumn(out, _derived(spec))
    if name is None:
        totals = totals.where(F.col("minutes") >= min_minutes)
    return totals.orderBy(*[F.desc(c) for c in view.order], "player")


def _summary_minutes(summary: DataFrame, by_team: bool) -> DataFrame:
    return sum_by_player(summary, {"minutes": "min"}, by_team).select(
        *(["player", "team"] if by_team else ["player"]), "minutes"
    )


def summary_a(summary: DataFrame, **options) -> DataFrame:
    return player_view(summary, SUMMARY_A, **options)


def passing_a(passing: DataFrame, summary: DataFrame, by_team: bool = False, **options) -> DataFrame:
    return player_view(passing, PASSING_A, by_team=by_team, minutes=_summary_minutes(summary, by_team), **options)


def defense_a(defense: DataFrame, summary: DataFrame, by_team: bool = False, **options) -> DataFrame:
    return player_view(defense, DEFENSE_A, by_team=by_team, minutes=_summary_minutes(summary, by_team), **options)


def keeper_a(keeper: DataFrame, summary: DataFrame, by_team: bool = False, **options) -> DataFrame:
    """Keeping; a clean sheet is a match without a goal against."""
    keepers = summary.where(matches_text("pos", "GK"))
    rows = keeper.withColumn("clean_sheet", (F.col("ga").try_cast("double") == 0).cast("int"))
    return player_view(rows, KEEPER_A, by_team=by_team, minutes=_summary_minutes(keepers, by_team), **options)


def summary_b(roster: DataFrame, **options) -> DataFrame:
    return player_view(roster, SUMMARY_B, team="team" if "team" in roster.columns else "team_id", **options)


def _feed_view(stats: DataFrame, view: View, **options) -> DataFrame:
    return player_view(stats, view, player="player_name", team="team_name", **options)


def summary_c(stats: DataFrame, **options) -> DataFrame:
    return _feed_view(stats, SUMMARY_C, **options)


def passing_c(stats: DataFrame, **options) -> DataFrame:
    return _feed_view(stats, PASSING_C, **options)


def defense_c(stats: DataFrame, **options) -> DataFrame:
    return _feed_view(stats, DEFENSE_C, **options)


def possession_c(stats: DataFrame, **options) -> DataFrame:
    return _feed_view(stats, POSSESSION_C, **options)


def keeper_c(stats: DataFrame, **options) -> DataFrame:
    return _feed_view(stats.where(matches_text("position", "Goalkeeper")), KEEPER_C, **options)


def shots_c(stats: DataFrame, **options) -> DataFrame:
    return _feed_view(stats, SHOTS_C, **options)


def xg_c(metrics: DataFrame, **options) -> DataFrame:
    return _feed_view(metrics, XG_C, **options)


def xpass_c(metrics: DataFrame, **options) -> DataFrame:
    return _feed_view(metrics, XPASS_C, **options)


def setpiece_c(stats: DataFrame, **options) -> DataFrame:
    return _feed_view(stats, SETPIECE_C, **options)


def player_profile(
    name: str,
    summary: DataFrame,
    passing: DataFrame | None = None,
    feed: DataFrame | None = None,
    roster: DataFrame | None = None,
    min_minutes: float = MIN_MINUTES_BOXSCORE,
) -> DataFrame:
    """One player's lines of all sources side by side.

    Source C writes first names as initials, so its rows are joined on that form of the name.
    """
    from touchline.functions.names import initial_form

    profile = summary_a(summary, name=name).drop("shots", "shots_on_target", "goals_minus_xg")
    if passing is not None:
        passes = passing_a(passing, summary, name=name).drop("team", "matches", "minutes", "passes_attempted", "crosses", "passes_per90")
        profile = profile.join(passes, "player", "left")
    if feed is not None:
        short = initial_form(name)
        pattern = short.replace(".", r"\.")
        carries = possession_c(feed, name=pattern).select(
            F.col("player").alias("_short"), "progressive_carries", "final_third_entries", "pen_area_entries",
            "progressive_carries_per90",
        )
        chances = summary_c(feed, name=pattern).select(
            F.col("player").alias("_short"), "big_chances_created", "big_chances_scored"
        )
        profile = profile.withColumn("_short", initial_form_column("player"))
        profile = profile.join(carries, "_short", "left").join(chances, "_short", "left").drop("_short")
    if roster is not None:
        involvement = summary_b(roster, name=name).select("player", "xg_chain", "xg_buildup")
        profile = profile.join(involvement, "player", "left")
    return profile.where(F.col("minutes") >= min_minutes).orderBy(F.desc("minutes"))
