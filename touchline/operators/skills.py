"""Time-decayed Bayesian player skills, their back-test and context adjustment."""

from dataclasses import dataclass, field
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from touchline.constants import MINUTES_PER_MATCH
from touchline.functions.numeric import clamp
from touchline.functions.seasons import season_end_year, season_end_year_of_date
from touchline.operators.boxscore import numbers_filled, position_dummies
from touchline.operators.ordering import HotGroups, Ordering, split_hot
from touchline.operators.ranking import exact_quantiles, modal_value
from touchline.session import cut_lineage, free_shuffles, local_rows

# Ratio statistics and the attempts behind them.
EFFICIENCY_STATS = {
    "shot_accuracy": ["shots"], "goals_per_shot": ["shots"], "ibox_shot_ratio": ["shots"],
    "big_chance_conversion": ["big_chance_scored", "big_chance_missed"], "pass_accuracy": ["passes"],
    "final_third_pass_acc": ["final_third_passes"], "long_ball_accuracy": ["long_balls"],
    "through_ball_accuracy": ["through_balls"], "cross_accuracy": ["crosses"], "tackle_success": ["tackles"],
    "interception_success": ["interceptions"], "clearance_effectiveness": ["clearances"],
    "duel_success": ["duel_won", "duel_lost"], "aerial_success": ["aerial_won", "aerial_lost"],
    "fwd_zone_pass_accuracy": ["fwd_zone_pass"], "open_play_pass_accuracy": ["open_play_pass"],
    "crosses_open_play_accuracy": ["crosses_open_play"], "bad_touch_rate": ["touches"],
    "headed_goal_rate": ["att_headed"], "flick_on_accuracy": ["flick_on"],
    "keeper_sweeper_accuracy": ["keeper_sweeper"], "back_zone_pass_accuracy": ["back_zone_pass"],
    "chipped_pass_accuracy": ["chipped_pass"], "ibox_goal_rate": ["shots_ibox"], "obox_goal_rate": ["shots_obox"],
    "penalty_conversion": ["att_pen_goal", "att_pen_miss"],
    "long_pass_own_to_opp_accuracy": ["long_pass_own_to_opp"], "fifty_fifty_success": ["fifty_fifty"],
    "poss_lost_ctrl_per_touch": ["touches"], "save_percentage": ["saves", "goals_conceded"],
}

# Statistics by importance for the parameter search.
STAT_TIERS = {
    "tier1": [
        "goals_p90", "shots_p90", "shots_on_target_p90", "big_chance_scored_p90", "big_chance_created_p90",
        "assists_p90", "key_passes_p90", "total_att_assist_p90", "through_balls_p90", "touches_opp_box_p90",
        "pen_area_entries_p90", "final_third_entries_p90", "final_third_passes_p90", "tackles_p90",
        "tackles_won_p90", "interceptions_p90", "interceptions_won_p90", "clearances_p90", "ball_recovery_p90",
        "aerial_won_p90", "duel_won_p90", "saves_p90", "goals_conceded_p90", "fwd_zone_pass_p90",
        "open_play_pass_p90",
    ],
    "tier2": [
        "shots_ibox_p90", "shots_obox_p90", "passes_p90", "passes_accurate_p90", "long_balls_p90", "crosses_p90",
        "forward_pass_p90", "blocks_p90", "blocked_passes_p90", "touches_p90", "poss_won_def3rd_p90",
        "poss_won_mid3rd_p90", "poss_won_att3rd_p90", "dispossessed_p90", "turnover_p90", "fouls_p90",
        "was_fouled_p90", "corners_taken_p90", "error_lead_to_shot_p90", "error_lead_to_goal_p90",
        "att_fastbreak_p90", "att_openplay_p90", "crosses_open_play_p90", "last_man_tackle_p90",
        "six_yard_block_p90", "unsuccessful_touch_p90", "overrun_p90",
    ],
    "efficiency": [
        "shot_accuracy", "goals_per_shot", "pass_accuracy", "tackle_success", "duel_success", "aerial_success",
        "big_chance_conversion", "final_third_pass_acc", "long_ball_accuracy", "cross_accuracy",
        "fwd_zone_pass_accuracy", "open_play_pass_accuracy", "crosses_open_play_accuracy", "bad_touch_rate",
        "keeper_sweeper_accuracy", "save_percentage",
    ],
    "xmetrics": ["xg_per90", "npxg_per90", "xa_per90_xmetrics", "xpass_overperformance_per90_xmetrics"],
}

# Position names by group, and leagues of reference strength.
POSITION_GROUPS = {
    "GK": ["Goalkeeper"], "DEF": ["Defender", "Wing Back"],
    "MID": ["Midfielder", "Defensive Midfielder", "Attacking Midfielder"], "FWD": ["Striker"],
}
REFERENCE_LEAGUES = ["EPL", "La_Liga", "Bundesliga", "Serie_A", "Ligue_1", "ENG", "ESP", "GER", "ITA", "FRA"]
XMETRIC_PREFIX = "^(xg|npxg|xa|xpass)"

HISTORY = Ordering(keys=("player_id",), by=("match_date", "match_id"), position="unix_date(match_date)")


@dataclass(frozen=True)
class DecayParams:
    """Decay per day and prior strengths; per-statistic values override the defaults."""

    rate: float = 0.003
    efficiency: float = 0.002
    xmetrics: float = 0.003
    prior_90s: float = 2.0
    prior_attempts: float = 50.0
    stat_lambdas: dict[str, float] = field(default_factory=dict)
    stat_priors: dict[str, float] = field(default_factory=dict)
    prior_centers: dict[str, float] = field(default_factory=dict)
    prior_quantiles: dict[str, float] = field(default_factory=dict)
    position_multipliers: dict[str, dict[str, float]] = field(default_factory=dict)

    def decay(self, stat: str) -> float:
        import re

        if stat in self.stat_lambdas:
            return self.stat_lambdas[stat]
        if stat in EFFICIENCY_STATS:
            return self.efficiency
        return self.xmetrics if re.match(XMETRIC_PREFIX, stat) else self.rate

    def prior(self, stat: str) -> float:
        default = self.prior_attempts if stat in EFFICIENCY_STATS else self.prior_90s
        return self.stat_priors.get(stat, default)


def skill_columns(columns: list[str]) -> list[str]:
    """Per-90 rates, then ratio statistics."""
    return [c for c in columns if c.endswith("_p90")] + [c for c in EFFICIENCY_STATS if c in columns]


def position_group(position="position") -> Column:
    c = F.col(position) if isinstance(position, str) else position
    out = None
    for group, names in POSITION_GROUPS.items():
        hit = c.isin(names)
        out = F.when(hit, group) if out is None else out.when(hit, group)
    return out


def with_position_groups(stats: DataFrame) -> DataFrame:
    """Add `pos_group`; unknown positions take the player's most frequent one."""
    grouped = stats.withColumn("pos_group", position_group())
    modal = modal_value(grouped, ["player_id"], "pos_group", "_modal")
    return grouped.join(modal, "player_id", "left").withColumn(
        "pos_group", F.coalesce("pos_group", "_modal")
    ).drop("_modal")


def _known(c: str) -> Column:
    return F.coalesce(F.col(c).cast("double"), F.lit(0.0))


def attempts(columns: list[str], stat: str) -> Column:
    """Attempts behind a ratio statistic: the sum of the columns that exist."""
    present = [c for c in EFFICIENCY_STATS[stat] if c in columns]
    if not present:
        raise ValueError(f"no attempt column for {stat}")
    total = _known(present[0])
    for c in present[1:]:
        total = total + _known(c)
    return total


def exposure(columns: list[str], stat: str) -> Column:
    """What a statistic's value refers to: attempts for ratios, played 90s for rates."""
    if stat in EFFICIENCY_STATS:
        return attempts(columns, stat)
    return _known("total_minutes") / MINUTES_PER_MATCH


def group_sums(stats: DataFrame, columns: list[str]) -> DataFrame:
    """Per position group: minutes and minutes-weighted sums of the statistics, and the first match day.

    Sums by player and own position come first, so that rows without a position need no join with the player's most frequent one.
    """
    w = _known("total_minutes")
    first = F.to_date("match_date") if "match_date" in stats.columns else F.lit(None).cast("date")
    parts = stats.withColumn("_pos", position_group()).groupBy("player_id", "_pos").agg(
        F.count(F.lit(1)).alias("_rows"), F.sum(w).alias("_w"), F.min(first).alias("_first"),
        *[F.sum(_known(c) * w).alias(f"_s_{c}") for c in columns],
    )
    group = F.coalesce("_pos", _most_frequent().over(W.partitionBy("player_id")).getField("_pos"))
    return parts.withColumn("pos_group", F.when(F.col("player_id").isNotNull(), group).otherwise(F.col("_pos"))).groupBy("pos_group").agg(
        F.sum("_w").alias("_w"), F.min("_first").alias("_first"), *[F.sum(f"_s_{c}").alias(f"_s_{c}") for c in columns]
    )


def _most_frequent() -> Column:
    """The position with most rows, of those with one; ties go to the first in order."""
    return F.min(F.when(F.col("_pos").isNotNull(), F.struct((-F.col("_rows")).alias("_less"), "_pos")))


def position_multipliers(stats: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(stat, pos_group, multiplier): minutes-weighted position mean over the overall mean, 1 if undefined."""
    columns = [c for c in (columns or skill_columns(stats.columns)) if c in stats.columns]
    return _multipliers(group_sums(stats, columns), columns)


def _multipliers(sums: DataFrame, columns: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("stat"), F.col(f"_s_{c}").alias("s")) for c in columns])
    long = sums.select("pos_group", "_w", F.explode(pairs).alias("p")).select("pos_group", "_w", "p.*")
    overall = long.groupBy("stat").agg((F.try_divide(F.sum("s"), F.sum("_w"))).alias("_mean"))
    grid = overall.withColumn("pos_group", F.explode(F.array(*[F.lit(g) for g in POSITION_GROUPS])))
    joined = grid.join(long, ["stat", "pos_group"], "left")
    own = F.coalesce(F.try_divide(F.col("s"), F.col("_w")), F.lit(0.0))
    multiplier = F.when((F.col("_mean") > 0) & F.col("_w").isNotNull(), own / F.col("_mean")).otherwise(F.lit(1.0))
    return joined.select("stat", "pos_group", multiplier.alias("multiplier"))


@dataclass(frozen=True)
class Population:
    """What all players together say: factors by statistic and position group, prior means, the first match day."""

    ratios: dict[str, dict[str, float]]
    means: dict[str, float]
    first_day: date | None


def population(df: DataFrame, stats: list[str], params: "DecayParams") -> Population:
    """All of it in one pass over the matches; quantiles of player means take one more each."""
    sums = local_rows(group_sums(df, stats))
    ratios: dict[str, dict[str, float]] = {}
    for r in _multipliers(sums, stats).collect():  # statistics x four groups
        ratios.setdefault(r["stat"], {})[r["pos_group"]] = r["multiplier"]
    total = sums.agg(F.min("_first"), *[F.coalesce(F.try_divide(F.sum(f"_s_{c}"), F.sum("_w")), F.lit(0.0)) for c in stats]).first()
    means = {s: population_mean(df, s, params) if s in params.prior_centers or s in params.prior_quantiles else m for s, m in zip(stats, total[1:])}
    return Population(ratios, means, total[0])


def _sum_names(stats: list[str]) -> dict[str, tuple[str, str, str]]:
    return {s: (f"_n{i}", f"_d{i}", f"_c{i}") for i, s in enumerate(stats)}


def _partial_sums(
    df: DataFrame, stats: list[str], params: DecayParams, target: Column, lag_days: int
) -> DataFrame:
    """Decayed numerators and exposures per player, position and target date; prior sums beside them."""
    names = _sum_names(stats)
    days = F.datediff(target, F.col("match_date")) - lag_days
    weight = lambda lam: F.exp(F.lit(-lam) * days)
    minutes, played = _known("total_minutes"), _known("total_minutes") / MINUTES_PER_MATCH
    sums = [
        F.count(F.lit(1)).alias("_rows"),
        F.sum(minutes).alias("_minutes"),
        F.sum(weight(params.rate) * played).alias("_w90"),
        F.min_by("player_name", F.struct("match_date", "match_id")).alias("_name"),
        F.min("match_date").alias("_first"),
    ]
    for s in stats:
        num, den, centre = names[s]
        e, w = exposure(df.columns, s), weight(params.decay(s))
        sums += [
            F.sum(w * _known(s) * e).alias(num),
            F.sum(w * e).alias(den),
            F.sum(_known(s) * minutes).alias(centre),
        ]
    # one exchange, by player, serves this and all later sums by player
    placed = df.withColumn("_pos", position_group()).repartition("player_id")
    return placed.groupBy("player_id", "_pos", target.alias("_target")).agg(*sums)


def skills_at(
    match_stats: DataFrame,
    targets: list[date],
    params: DecayParams = DecayParams(),
    stats: list[str] | None = None,
    lag_days: int = 0,
) -> DataFrame:
    """Skills of every player as of each target date, from matches strictly before it.

    Matches are summed once per player, position and the first target after them; older
    sums then decay to later targets, so several dates cost one pass over the matches.
    A rate skill is (prior mean x strength + decayed events) / (strength + decayed 90s),
    a ratio skill the same with attempts and its prior mean kept inside (0, 1). The prior
    mean is the minutes-weighted mean of the player's position group.
    """
    stats = [c for c in (stats or skill_columns(match_stats.columns)) if c in match_stats.columns]
    if not stats:
        raise ValueError("no statistic columns")
    names = _sum_names(stats)
    days = sorted(targets)
    dated = match_stats.withColumn("match_date", F.to_date("match_date"))
    dates = F.array(*[F.lit(d).cast("date") for d in days])
    first_after = F.array_min(F.filter(dates, lambda d: d > F.col("match_date")))
    dated = dated.withColumn("_bucket", first_after).where(F.col("_bucket").isNotNull())
    partial = _partial_sums(dated, stats, params, F.col("_bucket"), lag_days)

    spread = partial.withColumn("date", F.explode(F.filter(dates, lambda d: d >= F.col("_target"))))
    gap = F.datediff(F.col("date"), F.col("_target"))
    fade = lambda lam: F.exp(F.lit(-lam) * gap)
    decayed = {"_w90": F.col("_w90") * fade(params.rate)}
    for s in stats:
        num, den, _ = names[s]
        decayed |= {num: F.col(num) * fade(params.decay(s)), den: F.col(den) * fade(params.decay(s))}
    spread = spread.withColumns(decayed)

    # Most frequent position per player and date; rows without one count for it.
    totals = ["_rows", "_minutes", "_w90", *[c for s in stats for c in names[s]]]
    parts = spread.groupBy("date", "player_id", "_pos").agg(
        F.min_by("_name", "_first").alias("_name"), F.min("_first").alias("_first"), *[F.sum(c).alias(c) for c in totals]
    )
    part = F.struct("_pos", "_minutes", *[names[s][2] for s in stats])
    players = parts.groupBy("date", "player_id").agg(
        F.min_by("_name", "_first").alias("player_name"),
        F.when(F.col("player_id").isNotNull(), _most_frequent().getField("_pos")).alias("primary_position"),
        F.sum("_w90").alias("weighted_90s"),
        *[F.sum(c).alias(c) for s in stats for c in names[s][:2]],
        F.collect_list(part).alias("_parts"),
    )
    placed = players.select("date", "primary_position", F.explode("_parts").alias("_part")).select(
        "date", "_part.*", F.coalesce("_part._pos", "primary_position").alias("_group")
    )
    centres = _prior_centres(placed, stats, names, params)
    joined = players.join(centres, ["date"], "left").withColumn(
        "_centre", F.coalesce(F.try_element_at("_by_group", F.coalesce("primary_position", F.lit("?"))), F.col("_overall"))
    )

    def skill(s: str) -> Column:
        num, den, _ = names[s]
        centre, k = F.col(f"_centre.{names[s][2]}"), F.lit(float(params.prior(s)))
        if s in EFFICIENCY_STATS:
            centre = clamp(centre, 1e-6, 1 - 1e-6)
        return ((centre * k + F.col(num)) / (k + F.col(den))).alias(s)

    return joined.select(
        "player_id",
        "player_name",
        "primary_position",
        F.date_sub("date", lag_days).alias("date"),
        "weighted_90s",
        *[skill(s) for s in stats],
    )


def _prior_centres(placed: DataFrame, stats: list[str], names: dict, params: DecayParams) -> DataFrame:
    """Per date: prior means by position group as a map, and overall; four groups at most.

    Their sums are a few rows a date. They are computed first, so that their shuffle files are gone when the skills are.
    """
    sums = local_rows(
        placed.groupBy("date", "_group").agg(
            F.sum("_minutes").alias("_minutes"), *[F.sum(names[s][2]).alias(names[s][2]) for s in stats]
        )
    )
    totals = sums.groupBy("date").agg(
        F.sum("_minutes").alias("_tm"), *[F.sum(names[s][2]).alias(f"_t{names[s][2]}") for s in stats]
    )
    both = sums.join(totals, "date")

    def overall(s: str) -> Column:
        if s in params.prior_centers:
            return F.lit(float(params.prior_centers[s]))
        return F.coalesce(F.try_divide(F.col(f"_t{names[s][2]}"), F.col("_tm")), F.lit(0.0))

    def grouped(s: str) -> Column:
        c = names[s][2]
        plain = F.coalesce(F.try_divide(F.col(f"_t{c}"), F.col("_tm")), F.lit(0.0))
        if s in params.position_multipliers:
            ratio = F.lit(1.0)
            for g, m in params.position_multipliers[s].items():
                ratio = F.when(F.col("_group") == g, F.lit(float(m))).otherwise(ratio)
        else:
            own = F.coalesce(F.try_divide(F.col(c), F.col("_minutes")), F.lit(0.0))
            ratio = F.when(plain > 0, own / plain).otherwise(F.lit(1.0))
        return overall(s) * F.when(F.col("_group").isNull(), F.lit(1.0)).otherwise(ratio)

    both = both.select(
        "date",
        F.coalesce("_group", F.lit("?")).alias("_group"),
        F.struct(*[grouped(s).alias(names[s][2]) for s in stats]).alias("_values"),
        F.struct(*[overall(s).alias(names[s][2]) for s in stats]).alias("_overall"),
    )
    return both.groupBy("date").agg(
        F.map_from_entries(F.collect_list(F.struct("_group", "_values"))).alias("_by_group"),
        F.first("_overall").alias("_overall"),
    )


def player_skills(
    match_stats: DataFrame,
    target: date | None = None,
    params: DecayParams = DecayParams(),
    stats: list[str] | None = None,
    player_ids: list | None = None,
) -> DataFrame:
    """Skills as of a date, by default as of the last match date (that day's matches included)."""
    df = match_stats if player_ids is None else match_stats.where(F.col("player_id").isin(player_ids))
    if target is None:
        last = df.agg(F.max(F.to_date("match_date"))).first()[0]
        # A day later keeps the last day's matches before the target; decay still runs to the last day.
        return skills_at(df, [last + timedelta(days=1)], params, stats, lag_days=1)
    return skills_at(df, [target], params, stats)


def inspect_skill(
    stat: str, match_stats: DataFrame, target: date, params: DecayParams = DecayParams()
) -> DataFrame:
    """Every step of one skill per player: raw totals, prior, decay, decayed sums, skill."""
    from math import log

    ratio = stat in EFFICIENCY_STATS
    lam, strength = params.decay(stat), float(params.prior(stat))
    df = match_stats.withColumn("match_date", F.to_date("match_date")).where(F.col("match_date") < F.lit(target))
    skills = skills_at(match_stats, [target], params, [stat])
    e, w = exposure(df.columns, stat), F.exp(F.lit(-lam) * F.datediff(F.lit(target), F.col("match_date")))
    played = _known("total_minutes") / MINUTES_PER_MATCH
    raw = ("raw_successes", "raw_attempts", "raw_rate", "decay_successes", "decay_attempts") if ratio else (
        "raw_total", "total_90s", "raw_p90", "decay_events", "decay_exposure"
    )
    sums = df.groupBy("player_id").agg(
        F.sum("total_minutes").alias("total_minutes"),
        F.count(F.lit(1)).alias("matches"),
        F.sum(_known(stat) * e).alias(raw[0]),
        F.sum(e).alias(raw[1]),
        F.sum(w * _known(stat) * e).alias(raw[3]),
        F.sum(w * e).alias(raw[4]),
        F.sum(w * played).alias("_w90"),
    )
    joined = sums.join(skills.drop("weighted_90s"), "player_id")
    k = F.lit(strength)
    return joined.select(
        "player_id",
        "player_name",
        F.col("primary_position").alias("pos_group"),
        "total_minutes",
        "matches",
        raw[0],
        raw[1],
        F.coalesce(F.try_divide(F.col(raw[0]), F.col(raw[1])), F.lit(0.0)).alias(raw[2]),
        ((F.col(stat) * (k + F.col(raw[4])) - F.col(raw[3])) / k).alias("prior_center"),
        k.alias("prior_strength"),
        F.lit(lam).alias("lambda"),
        F.lit(log(2) / lam if lam > 0 else float("inf")).alias("half_life_days"),
        raw[3],
        raw[4],
        F.col("_w90").alias("weighted_90s"),
        F.col(stat).alias("skill"),
    ).orderBy(F.desc("skill"))


def season_skills(
    match_stats: DataFrame,
    params: DecayParams = DecayParams(),
    end_dates: dict[int, date] | None = None,
    min_minutes: float = 450,
    stats: list[str] | None = None,
) -> DataFrame:
    """Skills at each season's end (30 June) for players with enough minutes in that season."""
    df = match_stats.withColumn("match_date", F.to_date("match_date"))
    if "season_end_year" not in df.columns:
        year = season_end_year("season") if "season" in df.columns else season_end_year_of_date("match_date")
        df = df.withColumn("season_end_year", year)
    seasons = sorted(r[0] for r in local_rows(df.select("season_end_year").where("season_end_year is not null").distinct()).collect())
    ends = {int(s): (end_dates or {}).get(int(s), date(int(s), 6, 30)) for s in seasons}
    spans = F.array(
        *[
            F.struct(
                F.lit(s).alias("season_end_year"),
                F.lit(date(s - 1, 7, 1)).alias("from"),
                F.lit(d).cast("date").alias("to"),
            )
            for s, d in ends.items()
        ]
    )
    inside = F.filter(spans, lambda x: (F.col("match_date") >= x["from"]) & (F.col("match_date") < x["to"]))
    seasonal = df.drop("season_end_year").select("*", F.explode(inside).alias("_season")).groupBy(
        "player_id", F.col("_season.season_end_year").alias("season_end_year"), F.col("_season.to").alias("date")
    ).agg(F.sum("total_minutes").alias("total_minutes"), F.count_distinct("match_id").alias("n_matches"))
    # a row a player and season; its shuffle files go before the skills write theirs
    seasonal = cut_lineage(seasonal.where(F.col("total_minutes") >= min_minutes))
    free_shuffles(df.sparkSession)
    skills = skills_at(df, sorted(set(ends.values())), params, stats)
    joined = seasonal.join(skills, ["player_id", "date"])
    patterns = {"is_gk": "GK", "is_df": "DEF", "is_mf": "MID", "is_fw": "FWD"}
    return numbers_filled(position_dummies(joined, patterns, F.col("primary_position")))


# Statistics of the back-test.
BACKTEST_STATS = [
    "goals_p90", "shots_p90", "shots_on_target_p90", "assists_p90", "key_passes_p90", "big_chance_created_p90",
    "touches_opp_box_p90", "passes_p90", "final_third_passes_p90", "fwd_zone_pass_p90", "tackles_won_p90",
    "interceptions_p90", "clearances_p90", "ball_recovery_p90", "aerial_won_p90", "duel_won_p90", "fouls_p90",
    "was_fouled_p90", "dispossessed_p90", "saves_p90", "goals_conceded_p90", "shot_accuracy", "pass_accuracy",
    "tackle_success", "duel_success", "aerial_success", "save_percentage",
]


def _player_means(df: DataFrame, stat: str) -> DataFrame:
    w = _known("total_minutes")
    mean = F.coalesce(F.try_divide(F.sum(_known(stat) * w), F.sum(w)), F.lit(0.0))
    return df.groupBy("player_id").agg(mean.alias("_mean"))


def population_mean(df: DataFrame, stat: str, params: DecayParams = DecayParams()) -> float:
    """Prior mean of a statistic: given, a quantile of player means, or the minutes-weighted mean."""
    if stat in params.prior_centers:
        return params.prior_centers[stat]
    if stat in params.prior_quantiles:
        means = _player_means(df, stat)
        return exact_quantiles(means, "_mean", {"q": params.prior_quantiles[stat]}).first()[0]
    w = _known("total_minutes")
    return df.agg(F.coalesce(F.try_divide(F.sum(_known(stat) * w), F.sum(w)), F.lit(0.0))).first()[0]


def _history(
    df: DataFrame, stats: list[str], lambdas: dict[str, list[float]], hot: HotGroups | None, first_day: date | None, dealt: bool = False
) -> DataFrame:
    """Per row: decayed and plain sums over the player's earlier matches, per statistic and decay.

    `dealt`: rows lie by player already.

    A sum with weights e^(-lam * age) is e^(-lam * t) times a running sum with weights
    e^(lam * t), so one ordered pass serves every row.
    """
    age = F.datediff(F.col("match_date"), F.lit(first_day).cast("date")).cast("double")
    sums = {"_seen": F.lit(1).cast("long")}
    for i, s in enumerate(stats):
        e = exposure(df.columns, s)
        sums |= {f"_x{i}": _known(s) * e, f"_e{i}": e, f"_v{i}": _known(s)}
        for j, lam in enumerate(lambdas[s]):
            grow = F.exp(F.lit(lam) * F.col("_t"))
            sums |= {f"_x{i}_{j}": grow * _known(s) * e, f"_e{i}_{j}": grow * e}

    def sequence(d: DataFrame, order: Ordering) -> DataFrame:
        if not order.chunked and not dealt:  # the columns are dealt out, not the sums made of them
            d = d.repartition(*order.keys)
        d = order.running_sum(d.withColumn("_t", age), sums)
        before = {f"p{c}": (c, 1) for c in sums}
        last = {f"_last{i}": (_known(s), 1) for i, s in enumerate(stats)}
        return order.shift(d, before | last).drop(*sums)

    return split_hot(df, HISTORY, sequence, hot=hot)


def backtest(
    match_stats: DataFrame,
    params: DecayParams = DecayParams(),
    stats: list[str] | None = None,
    min_history: int = 5,
    sample_share: float | None = None,
    hot: HotGroups | None = None,
) -> DataFrame:
    """Predict every match from the matches before it: Bayesian skill, weighted mean, last value.

    `sample_share` keeps a hash sample of players (a choice of the caller, off by default).
    """
    df = match_stats.withColumn("match_date", F.to_date("match_date"))
    stats = [s for s in (stats or BACKTEST_STATS) if s in df.columns]
    known = population(df, stats, params)
    ratios, means = known.ratios, known.means
    modal = modal_value(df.withColumn("pos_group", position_group()), ["player_id"], "pos_group", "_group")
    if sample_share is not None:
        df = df.where(F.pmod(F.xxhash64("player_id"), F.lit(10_000)) < int(sample_share * 10_000))
    past = _history(df, stats, {s: [params.decay(s)] for s in stats}, hot, known.first_day).join(modal, "player_id", "left")
    minutes = _known("total_minutes")
    rows = past.where((F.col("p_seen") >= min_history) & (minutes > 0))

    def prediction(i: int, s: str) -> Column:
        ratio = F.lit(1.0)
        for g, m in ratios.get(s, {}).items():
            ratio = F.when(F.col("_group") == g, F.lit(float(m))).otherwise(ratio)
        centre, k = F.lit(float(means[s])) * ratio, F.lit(float(params.prior(s)))
        fade = F.exp(F.lit(-params.decay(s)) * F.col("_t"))
        events, seen = F.col(f"p_x{i}_0") * fade, F.col(f"p_e{i}_0") * fade
        is_ratio = s in EFFICIENCY_STATS
        if is_ratio:
            centre = clamp(centre, 1e-6, 1 - 1e-6)
        plain_mean = F.try_divide(F.col(f"p_v{i}"), F.col("p_seen"))
        return F.struct(
            F.lit(s).alias("stat"),
            F.lit(is_ratio).alias("is_ratio"),
            ((centre * k + events) / (k + seen)).alias("predicted"),
            F.coalesce(
                F.when(F.col(f"p_e{i}") > 0, F.try_divide(F.col(f"p_x{i}"), F.col(f"p_e{i}"))), plain_mean
            ).alias("avg_predicted"),
            F.col(f"_last{i}").alias("last_predicted"),
            _known(s).alias("actual"),
            exposure(df.columns, s).alias("weight"),
            (F.lit(not is_ratio) | (seen > 0)).alias("usable"),
        )

    long = rows.select(
        "player_id", "match_id", "match_date", minutes.alias("minutes"),
        F.explode(F.array(*[prediction(i, s) for i, s in enumerate(stats)])).alias("p"),
    ).select("player_id", "match_id", "match_date", "minutes", "p.*")
    return long.where("usable").drop("usable")


def log_loss(actual: Column, predicted: Column, eps: float = 1e-8) -> Column:
    y, p = clamp(actual, eps, 1 - eps), clamp(predicted, eps, 1 - eps)
    return -(y * F.log(p) + (1 - y) * F.log(1 - p))


def backtest_accuracy(predictions: DataFrame) -> DataFrame:
    """Weighted log loss (ratios) or RMSE (rates) per statistic, and gains over both baselines."""
    def loss(c: str) -> Column:
        miss = F.col(c) - F.col("actual")
        per_row = F.when(F.col("is_ratio"), log_loss(F.col("actual"), F.col(c))).otherwise(miss * miss)
        return F.sum(F.col("weight") * per_row)

    sums = predictions.groupBy("stat", "is_ratio").agg(
        loss("predicted").alias("_b"), loss("avg_predicted").alias("_a"), loss("last_predicted").alias("_l"),
        F.sum("weight").alias("_w"), F.count(F.lit(1)).alias("n_predictions"),
    )
    mean = lambda c: F.try_divide(F.col(c), F.col("_w"))
    value = lambda c: F.when(F.col("is_ratio"), mean(c)).otherwise(F.sqrt(mean(c)))
    gain = lambda c: F.when(F.col(c) > 0, F.round((1 - F.try_divide(F.col("_b"), F.col(c))) * 100, 1))
    return sums.select(
        "stat",
        F.when(F.col("is_ratio"), "logloss").otherwise("rmse").alias("metric"),
        value("_b").alias("value"),
        value("_a").alias("avg_value"),
        value("_l").alias("last_value"),
        gain("_a").alias("pct_vs_avg"),
        gain("_l").alias("pct_vs_last"),
        "n_predictions",
    ).orderBy(F.desc("pct_vs_avg"), "stat")


def adjust_for_context(
    match_stats: DataFrame,
    elo: DataFrame | None = None,
    adjust_opponent: bool = True,
    adjust_venue: bool = True,
    adjust_league: bool = True,
    reference_leagues: list[str] = REFERENCE_LEAGUES,
) -> DataFrame:
    """Scale per-90 rates for opponent strength, venue and league, each factor kept in [0.67, 1.5].

    Venue and league factors both follow from sums by league and venue, so one small
    aggregate serves the two stages.
    """
    rates = [c for c in match_stats.columns if c.endswith("_p90")]
    if not rates:
        return match_stats
    df = match_stats
    bounded = lambda c: clamp(c, 0.67, 1.5)
    if adjust_opponent and elo is not None and "opponent_team" in df.columns:
        mean = elo.agg(F.avg("elo")).scalar()
        ratings = elo.groupBy(F.col("team").alias("opponent_team")).agg(F.max("elo").alias("_elo"))
        df = df.join(ratings, "opponent_team", "left")
        factor = bounded(mean / F.coalesce(F.col("_elo"), mean))
        df = df.withColumns({c: F.col(c) * factor for c in rates}).drop("_elo")
    venue = adjust_venue and "is_home" in df.columns
    league = adjust_league and "competition" in df.columns
    if not venue and not league:
        return df
    keys = (["competition"] if league else []) + (["is_home"] if venue else [])
    parts = df.groupBy(*keys).agg(
        *[F.sum(c).alias(f"_s_{c}") for c in rates], *[F.count(c).alias(f"_n_{c}") for c in rates]
    )
    home = (F.col("is_home").cast("int") == 1) if venue else F.lit(True)
    away = (F.col("is_home").cast("int") == 0) if venue else F.lit(False)
    if venue:
        mean = lambda c, at: F.try_divide(F.sum(F.when(at, F.col(f"_s_{c}"))), F.sum(F.when(at, F.col(f"_n_{c}"))))
        ratio = lambda c: bounded(mean(c, home) / F.greatest(mean(c, away), F.lit(1e-6)))
        factors = parts.agg(F.struct(*[F.coalesce(ratio(c), F.lit(1.0)).alias(c) for c in rates])).scalar()
        df = df.withColumn("_venue", factors)
        parts = parts.withColumn("_venue", factors)
        scaled = lambda c: F.when(away, F.col(c) * F.col(f"_venue.{c}")).otherwise(F.col(c))
        df = df.withColumns({c: scaled(c) for c in rates}).drop("_venue")
        at_venue = {f"_s_{c}": F.when(away, F.col(f"_s_{c}") * F.col(f"_venue.{c}")).otherwise(F.col(f"_s_{c}")) for c in rates}
        parts = parts.withColumns(at_venue).drop("_venue")
    if league:
        is_reference = F.col("competition").isin(reference_leagues)
        mean = lambda c: F.try_divide(F.sum(f"_s_{c}"), F.sum(f"_n_{c}"))
        reference = parts.where(is_reference).agg(F.struct(*[mean(c).alias(c) for c in rates])).scalar()
        per_league = parts.where(~is_reference).groupBy("competition").agg(
            F.struct(*[mean(c).alias(c) for c in rates]).alias("_own")
        ).withColumn("_ref", reference)
        factor = lambda c: F.coalesce(
            bounded(F.col(f"_ref.{c}") / F.greatest(F.col(f"_own.{c}"), F.lit(1e-6))), F.lit(1.0)
        )
        table = per_league.select("competition", F.struct(*[factor(c).alias(c) for c in rates]).alias("_league"))
        df = df.join(table, "competition", "left")
        df = df.withColumns({c: F.col(c) * F.coalesce(F.col(f"_league.{c}"), F.lit(1.0)) for c in rates}).drop("_league")
    return df
