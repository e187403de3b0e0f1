"""Standard match tables out of raw ones: columns, names, ids, clocks and flags (source A)."""

from pyspark.sql import Column, DataFrame, functions as F

from touchline.functions import names as N
from touchline.functions.seasons import clock_parts, season_of_url
from touchline.operators.ordering import HotGroups, Ordering, split_hot
from touchline.sources.payloads import snake_case

# Canonical columns and the names they go by.
COLUMN_NAMES = {
    "team": ["squad", "team_name"], "player_name": ["player"], "minutes": ["min", "mins_played", "minsPlayed"],
    "position": ["pos"], "player_id": ["playerId"], "team_id": ["teamId"], "match_id": ["matchId"],
}

# Statistic columns kept per table.
STAT_COLUMNS = {
    "summary": [
        "min", "gls", "ast", "pk", "p_katt", "sh", "so_t", "crd_y", "crd_r", "touches", "tkl", "int", "blocks", "x_g",
        "npx_g", "x_ag", "sca", "gca", "cmp", "att", "cmp_percent", "prg_p", "carries", "prg_c", "att_2", "succ", "pos",
    ],
    "passing": [
        "cmp", "att", "cmp_percent", "tot_dist", "prg_dist", "cmp_2", "att_2", "cmp_percent_2", "cmp_3", "att_3",
        "cmp_percent_3", "cmp_4", "att_4", "cmp_percent_4", "ast", "x_ag", "x_a", "kp", "x1_3", "ppa", "crs_pa", "prg_p",
    ],
    "defense": [
        "tkl", "tkl_w", "def_3rd", "mid_3rd", "att_3rd", "tkl_2", "att", "tkl_percent", "lost", "blocks", "sh", "pass",
        "int", "tkl_int", "clr", "err",
    ],
    "possession": [
        "touches", "def_pen", "def_3rd", "mid_3rd", "att_3rd", "att_pen", "live", "att", "succ", "succ_percent", "tkld",
        "tkld_percent", "carries", "tot_dist", "prg_dist", "prg_c", "x1_3", "cpa", "mis", "dis", "rec", "prg_r",
    ],
}


def clean_column_names(df: DataFrame) -> DataFrame:
    """Snake-case names; repeats get a number."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        name = snake_case(c) or "x"
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return df.toDF(*names)


def find_column(df: DataFrame, candidates: list[str]) -> str | None:
    return next((c for c in candidates if c in df.columns), None)


def canonical_columns(df: DataFrame, names: dict[str, list[str]] = COLUMN_NAMES) -> DataFrame:
    """Rename the first alternative present to its canonical name; canonical columns stay."""
    renames = {}
    for canonical, alternatives in names.items():
        found = find_column(df, [a for a in alternatives if a not in renames])
        if canonical not in df.columns and found is not None:
            renames[found] = canonical
    return df.withColumnsRenamed(renames)


def ensure_column(df: DataFrame, name: str, default=False, source: str | None = None, pattern: str | None = None) -> DataFrame:
    """Add a missing column: a case-insensitive pattern test on a source column, else a constant."""
    if name in df.columns:
        return df
    if source is not None and pattern is not None and source in df.columns:
        return df.withColumn(name, F.coalesce(N.matches_text(source, pattern), F.lit(False)))
    return df.withColumn(name, F.lit(default))


def clean_results(results: DataFrame) -> DataFrame:
    """Match results with standard team names, key and differences."""
    df = results.withColumnsRenamed(
        {f"{s}_x_g": f"{s}_xg" for s in ("home", "away") if f"{s}_xg" not in results.columns}
    )
    number = lambda c: F.col(c).try_cast("double")
    df = df.withColumns(
        {
            "home_team": N.team_name("home"), "away_team": N.team_name("away"),
            **{c: number(c) for c in ("home_goals", "away_goals", "home_xg", "away_xg")},
            "date": F.to_date("date"), "season": F.col("season_end_year"),
        }
    )
    label = F.concat_ws("-", (F.col("season").cast("int") - 1), F.col("season").cast("int"))
    extra = [c for c in ("league", "country", "season_end_year") if c in results.columns]
    return df.withColumns(
        {
            "match_id": N.match_key(label, "date", "home_team", "away_team"),
            "goal_diff": F.col("home_goals") - F.col("away_goals"),
            "xg_diff": F.col("home_xg") - F.col("away_xg"),
        }
    ).select(
        "match_id", "season", "date", "match_url", "home_team", "away_team", "home_goals", "away_goals", "goal_diff",
        "home_xg", "away_xg", "xg_diff", *extra,
    )


def _match_ids(results: DataFrame, *columns: str) -> DataFrame:
    return results.select("match_url", "match_id", *columns).distinct()


def _home_flag(df: DataFrame) -> Column:
    if "is_home" in df.columns:
        return F.col("is_home").cast("boolean")
    if "home_away" in df.columns:
        return F.lower("home_away") == "home"
    return F.lit(None).cast("boolean")


def clean_lineups(lineups: DataFrame, results: DataFrame) -> DataFrame:
    """Line-ups with match key, standard names, ids (link id, else name key) and on/off minutes."""
    df = lineups.join(_match_ids(results), "match_url", "left")
    df = canonical_columns(df, {k: COLUMN_NAMES[k][:2] for k in ("team", "player_name", "minutes")})
    df = df.withColumns(
        {
            "is_home": _home_flag(df), "player_name": N.player_display_name("player_name"),
            "team": N.team_name("team"), "minutes": F.col("minutes").try_cast("double"),
        }
    )
    key = N.player_key("player_name")
    link = find_column(df, ["player_href", "player_url"])
    if link:
        player_id = F.coalesce(N.player_id_from_href(link), key)
    else:
        player_id = F.col("player_id") if "player_id" in df.columns else key
    optional = lambda c: F.col(c).try_cast("double") if c in df.columns else F.lit(None).cast("double")
    position = find_column(df, ["pos", "position"])
    return df.select(
        "match_id", "team", "is_home", "player_name", player_id.alias("player_id"),
        (F.col("is_starter") if "is_starter" in df.columns else F.lit(True)).alias("is_starter"),
        (F.col(position) if position else F.lit(None).cast("string")).alias("position"),
        "minutes", optional("on_minute").alias("on_minute"), optional("off_minute").alias("off_minute"),
    )


def clean_events(events: DataFrame, results: DataFrame) -> DataFrame:
    """Goals, substitutions and red cards of known matches; a goal outranks the other flags."""
    team, player = find_column(events, ["team", "squad", "home_team"]), find_column(events, ["player", "player_name"])
    df = events
    for name, pattern in (("is_goal", "Goal"), ("is_sub", "Sub"), ("is_red_card", "Red Card|Sent Off|Second Yellow")):
        df = ensure_column(df, name, source="event_type", pattern=pattern)
    df = ensure_column(df, "is_penalty", source=player, pattern="pen")
    df = ensure_column(df, "is_own_goal")
    own_team = F.col(team) if team else F.lit(None).cast("string")
    df = df.withColumn("_team", N.team_name(own_team))
    lookup = _match_ids(results, "home_team").withColumnRenamed("home_team", "_home")
    df = df.join(lookup, "match_url")
    at_home = (F.col("_team") == F.col("_home")) if team else _home_flag(events)
    kind = F.when(F.col("is_goal"), "goal").when(F.col("is_sub"), "substitution").when(F.col("is_red_card"), "red_card")
    return df.where(kind.isNotNull()).select(
        "match_id", F.col("_team").alias("team"), at_home.alias("is_home"), kind.alias("event_type"),
        F.col("minute").try_cast("double").alias("minute"),
        (F.col(player) if player else F.lit(None).cast("string")).alias("player_name"),
        "is_penalty", "is_own_goal", "is_red_card",
    )


def clean_shots(shots: DataFrame, results: DataFrame) -> DataFrame:
    """Shots with match key, minute and added time, chance and flags."""
    minute, added = clock_parts("minute")
    df = shots.join(_match_ids(results), "match_url", "left")
    return df.select(
        "match_id", N.team_name("squad").alias("team"), N.player_display_name("player").alias("player_name"),
        minute.alias("minute"), added.alias("added_time"), F.col("x_g").try_cast("double").alias("xg"),
        (F.col("outcome") == "Goal").alias("is_goal"),
        F.coalesce(N.matches_text("notes", "Penalty"), F.lit(False)).alias("is_penalty"),
        "body_part", F.col("notes").alias("shot_type"),
    )


def clean_stats(stats: DataFrame, results: DataFrame, kind: str = "summary") -> DataFrame:
    """Statistic columns of a table as numbers with match key and standard names."""
    df = canonical_columns(stats.join(_match_ids(results), "match_url", "left"), {k: COLUMN_NAMES[k] for k in ("player_name", "team")})
    kept = [c for c in STAT_COLUMNS.get(kind, []) if c in df.columns]
    value = lambda c: F.col(c) if c == "pos" else F.col(c).try_cast("double")
    return df.select(
        "match_id", N.team_name("team").alias("team"), _home_flag(df).alias("is_home"),
        N.player_display_name("player_name").alias("player_name"), *[value(c).alias(c) for c in kept],
    )


def clean_all(raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All standard tables of a raw set; tables that are absent are left out."""
    results = clean_results(raw["results"])
    out = {"results": results}
    for name, build in (("lineups", clean_lineups), ("events", clean_events), ("shots", clean_shots)):
        if raw.get(name) is not None:
            out[name] = build(raw[name], results)
    for name, df in raw.items():
        if name.startswith("stats_") and df is not None:
            out[name] = clean_stats(df, results, name.removeprefix("stats_"))
    return out


def merged_tables(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables under the names of the match model."""
    names = {"matches": "results", "lineups": "lineups", "events": "events", "shots": "shots", "player_stats": "stats_summary"}
    return {out: tables[name] for out, name in names.items() if name in tables}


def events_from_shots(shots: DataFrame) -> DataFrame:
    """Goal events out of shots."""
    outcome = find_column(shots, ["outcome", "Outcome"])
    note = lambda text: F.coalesce(N.matches_text("notes", text), F.lit(False))
    return shots.where(F.col(outcome) == "Goal").select(
        "match_url", F.col("squad").alias("team"), F.lit("Goal").alias("event_type"),
        F.col("minute").try_cast("double").alias("minute"), "player", F.lit(True).alias("is_goal"),
        F.lit(False).alias("is_sub"), note("Penalty").alias("is_penalty"), note("Own Goal").alias("is_own_goal"),
    ).orderBy("match_url", "minute")


def lineups_from_stats(stats: DataFrame) -> DataFrame:
    """Line-up rows out of player statistics; a starter played at least 45 minutes."""
    kept = [c for c in ("match_url", "team", "player_href", "nation", "pos", "age", "min", "home_away", "season_end_year") if c in stats.columns]
    minutes = F.col("min").try_cast("double")
    return stats.select(
        *kept, F.col("player").alias("player_name"), (minutes >= 45).alias("is_starter"), minutes.alias("minutes"),
        (F.col("home_away") == "Home").alias("is_home"),
    )


def with_season(df: DataFrame, seasons: DataFrame) -> DataFrame:
    """Attach season_end_year by match_url where it is missing."""
    if "season_end_year" in df.columns or "match_url" not in df.columns:
        return df
    return df.join(seasons.select("match_url", "season_end_year").distinct(), "match_url", "left")


def match_xg_from_stats(stats: DataFrame, metadata: DataFrame) -> DataFrame:
    """Metadata with the sum of players' chances per side; matches need home players to get any."""
    side = lambda c, home: F.sum(F.when(F.col("is_home") == home, F.col(c).try_cast("double")))
    sums = stats.groupBy("match_url").agg(
        F.count_if(F.col("is_home")).alias("_home"),
        side("x_g", True).alias("home_xg"), side("npx_g", True).alias("home_npxg"),
        side("x_g", False).alias("away_xg"), side("npx_g", False).alias("away_npxg"),
    ).where(F.col("_home") > 0).drop("_home")
    year = F.substring("season", 6, 4).try_cast("double")
    return metadata.join(sums, "match_url", "left").withColumn("season_end_year", year)


SHEET_ORDER = Ordering(keys=("match_url", "team"), by=("sheet_order",), position="sheet_order")


def substitution_chains(summary: DataFrame, hot: HotGroups | None = None) -> DataFrame:
    """On and off minutes from the order of the team sheet.

    A leading no-break space marks a substitute, listed under the player replaced; each starter
    opens a slot, and minutes add up inside it. Needs `sheet_order`.
    """
    df = summary.withColumns(
        {
            "is_starter": ~F.startswith(F.col("player"), F.lit("\u00a0")),
            "player_name": F.trim(F.regexp_replace("player", "\u00a0", " ")),
            "minutes": F.col("min").try_cast("double"),
        }
    )

    def slots(d: DataFrame, order: Ordering) -> DataFrame:
        d = order.running_sum(d, {"_slot": F.col("is_starter").cast("int"), "_upto": F.col("minutes")})
        opens = F.when(F.col("is_starter"), F.col("_upto") - F.coalesce("minutes", F.lit(0.0)))
        return order.last_known(d, {"_before": opens})

    placed = split_hot(df, SHEET_ORDER, slots, hot=hot)
    off = F.col("_upto") - F.coalesce(F.col("_before"), F.lit(0.0))
    return placed.withColumns(
        {
            "off_minute": off,
            "on_minute": F.when(F.col("is_starter"), F.lit(0.0)).otherwise(off - F.coalesce("minutes", F.lit(0.0))),
        }
    ).drop("_slot", "_upto", "_before")


def seasons_from_urls(df: DataFrame, url: str = "match_url") -> DataFrame:
    return df.withColumn("season", season_of_url(url))
