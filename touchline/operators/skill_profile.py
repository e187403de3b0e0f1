"""Skill profile of one player: tolerant name search, percentiles, raw and decayed exposure."""

from datetime import date

from pyspark.sql import DataFrame, functions as F

from touchline.constants import MINUTES_PER_MATCH
from touchline.functions.names import player_key, strip_accents
from touchline.operators.skills import EFFICIENCY_STATS, DecayParams, _known, exposure

# Profile categories in display order.
CATEGORIES = {
    "Attacking": [
        "goals_p90", "shots_p90", "shots_on_target_p90", "shots_ibox_p90", "big_chance_scored_p90", "assists_p90",
        "key_passes_p90", "big_chance_created_p90", "through_balls_p90", "shot_accuracy", "goals_per_shot",
        "big_chance_conversion",
    ],
    "Passing": [
        "total_passes_p90", "open_play_pass_p90", "final_third_passes_p90", "fwd_zone_pass_p90", "crosses_p90",
        "crosses_open_play_p90", "forward_pass_p90", "chipped_pass_p90", "pass_accuracy", "fwd_zone_pass_accuracy",
        "open_play_pass_accuracy",
    ],
    "Defending": [
        "tackles_p90", "tackles_won_p90", "interceptions_p90", "clearances_p90", "blocks_p90", "aerial_won_p90",
        "ball_recovery_p90", "poss_won_def3rd_p90", "tackle_success", "aerial_success",
    ],
    "Possession": [
        "touches_p90", "touches_opp_box_p90", "pen_area_entries_p90", "final_third_entries_p90",
        "successful_dribbles_p90", "poss_lost_ctrl_p90",
    ],
}
CATEGORY_ORDER = ["Attacking", "Passing", "Defending", "Possession", "xMetrics", "Other"]
META_COLUMNS = {
    "player_id", "player_name", "primary_position", "date", "weighted_90s", "season_end_year", "total_minutes",
    "n_matches", "is_gk", "is_df", "is_mf", "is_fw", "competition", "league",
}


def category_of(stat: str) -> str:
    import re

    for name, stats in CATEGORIES.items():
        if stat in stats:
            return name
    return "xMetrics" if re.match("^(xg|npxg|xa|xpass)", stat) else "Other"


def find_player(skills: DataFrame, name: str) -> DataFrame:
    """The best match for a name: same key, part of it, the same without accents, or the surname.

    Of several players on the best level, the one with most weighted minutes (one row, or none).
    """
    key = player_key("player_name")
    plain = strip_accents(key)
    want = player_key(F.lit(name))
    want_plain = strip_accents(want)
    surname = name.replace(".", " ").split()[-1] if name.split() else ""
    ends = F.endswith(plain, strip_accents(player_key(F.lit(surname)))) if len(surname) >= 3 else F.lit(False)
    level = (
        F.when(key == want, 1)
        .when(F.contains(key, want), 2)
        .when(plain == want_plain, 3)
        .when(F.contains(plain, want_plain), 4)
        .when(ends, 5)
    )
    found = skills.withColumn("_level", level).where(F.col("_level").isNotNull())
    return found.orderBy("_level", F.desc("weighted_90s"), "player_id").limit(1).drop("_level")


def suggest_names(skills: DataFrame, name: str, n: int = 5) -> DataFrame:
    """Closest player names by edit distance."""
    gap = F.levenshtein(F.lower(F.lit(name)), F.lower("player_name"))
    return skills.select("player_name", gap.alias("distance")).distinct().orderBy("distance", "player_name").limit(n)


def skill_profile(
    skills: DataFrame,
    name: str,
    match_stats: DataFrame | None = None,
    params: DecayParams = DecayParams(),
    as_of: date | None = None,
) -> DataFrame:
    """One row per statistic: skill, league and position means and percentiles, raw and decayed exposure."""
    numeric = [c for c, t in skills.dtypes if t in ("double", "float", "int", "bigint") and c not in META_COLUMNS]
    hit = find_player(skills, name)
    row = hit.first()
    if row is None:
        near = [r[0] for r in suggest_names(skills, name).collect()]
        raise ValueError(f"no player {name!r}; did you mean {', '.join(near)}?")
    same_position = F.col("primary_position") == F.lit(row["primary_position"])
    peers = []
    for i, c in enumerate(numeric):
        mine = F.lit(None if row[c] is None else float(row[c])).cast("double")
        at_most = (F.col(c) <= mine).cast("int")
        peers += [
            F.avg(c).alias(f"la{i}"),
            F.round(100 * F.avg(at_most), 1).alias(f"lp{i}"),
            F.avg(F.when(same_position, F.col(c))).alias(f"pa{i}"),
            F.round(100 * F.avg(F.when(same_position, at_most)), 1).alias(f"pp{i}"),
        ]
    summary = skills.agg(*peers)
    if match_stats is not None:
        own = match_stats.withColumn("match_date", F.to_date("match_date")).where(F.col("player_id") == row["player_id"])
        if as_of is None:
            as_of = own.agg(F.max("match_date")).first()[0]
        age = F.datediff(F.lit(as_of), F.col("match_date"))
        sums = [F.sum(_known("total_minutes") / MINUTES_PER_MATCH).alias("n90")]
        for i, c in enumerate(numeric):
            w = F.exp(F.lit(-params.decay(c)) * age)
            sums.append((F.avg(c) if c in own.columns else F.lit(None).cast("double")).alias(f"ra{i}"))
            if c in EFFICIENCY_STATS:
                known = any(d in own.columns for d in EFFICIENCY_STATS[c])
                e = exposure(own.columns, c) if known else F.lit(None).cast("double")
                sums += [F.round(F.sum(e), 0).alias(f"at{i}"), F.round(F.sum(w * e), 0).alias(f"wt{i}")]
            else:
                sums.append(F.round(F.sum(w * exposure(own.columns, c)), 1).alias(f"w9{i}"))
        totals = own.agg(*sums)
        # Both sides are aggregates of one row.
        summary = summary.withColumn("_k", F.lit(1)).join(totals.withColumn("_k", F.lit(1)), "_k")
    present = set(summary.columns)
    value = lambda c: F.col(c).cast("double") if c in present else F.lit(None).cast("double")

    def line(i: int, c: str):
        ratio = c in EFFICIENCY_STATS
        order = CATEGORY_ORDER.index(category_of(c))
        return F.struct(
            F.lit(order).alias("_order"),
            F.lit(category_of(c)).alias("category"),
            F.lit(c).alias("stat"),
            F.lit("efficiency" if ratio else "rate").alias("type"),
            F.round(F.lit(None if row[c] is None else float(row[c])).cast("double"), 4).alias("skill"),
            F.round(value(f"ra{i}"), 4).alias("raw_avg"),
            F.round(value(f"la{i}"), 4).alias("league_avg"),
            value(f"lp{i}").alias("league_pct"),
            F.round(value(f"pa{i}"), 4).alias("pos_avg"),
            value(f"pp{i}").alias("pos_pct"),
            (F.lit(None).cast("double") if ratio else F.round(value("n90"), 1)).alias("n90"),
            value(f"w9{i}").alias("w90"),
            value(f"at{i}").alias("attempts"),
            value(f"wt{i}").alias("w_attempts"),
        )

    lines = summary.select(F.explode(F.array(*[line(i, c) for i, c in enumerate(numeric)])).alias("l")).select("l.*")
    return lines.orderBy("_order", F.desc("pos_pct"), "stat").drop("_order")
