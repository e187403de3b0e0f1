"""Constant-lineup segments: spans of a match between substitutions, goals and red cards."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from touchline.constants import HALFTIME_MINUTE, MINUTES_PER_MATCH, PLAYERS_PER_TEAM
from touchline.functions.numeric import flag
from touchline.functions.seasons import clock_parts, season_of_date

# Event type spellings by role.
GOAL_TYPES = ["goal", "Goal", "penalty_goal", "own_goal"]
SUB_TYPES = ["sub_on", "substitution", "Substitution"]
RED_TYPES = ["red_card", "Red Card", "yellow_red_card"]

STATE = ["goals_home", "goals_away", "reds_home", "reds_away"]


def flagged_events(events: DataFrame) -> DataFrame:
    """Add is_goal, is_sub and is_red_card from the event type; given flags stay."""
    kinds = {"is_goal": GOAL_TYPES, "is_sub": SUB_TYPES, "is_red_card": RED_TYPES}
    missing = {c: F.col("event_type").isin(types) for c, types in kinds.items() if c not in events.columns}
    return events.withColumns(missing) if missing else events


def effective_minute(minute, added, stoppage) -> Column:
    """Minutes since kick-off: added time counts, and the second half starts after stoppage."""
    minute = F.col(minute) if isinstance(minute, str) else minute
    added = F.coalesce(F.col(added) if isinstance(added, str) else added, F.lit(0)).cast("int")
    stoppage = F.col(stoppage) if isinstance(stoppage, str) else stoppage
    return minute + added + F.when(minute >= HALFTIME_MINUTE + 1, stoppage).otherwise(F.lit(0))


def _clock_rows(events: DataFrame | None, shots: DataFrame | None) -> DataFrame:
    """(match_id, minute, added) of events and shots; shots carry added time only in texts like 45+2."""
    parts = []
    if events is not None:
        added = F.col("added_time") if "added_time" in events.columns else F.lit(0)
        parts.append(events.select("match_id", F.col("minute").cast("double"), added.cast("double").alias("added")))
    if shots is not None:
        if dict(shots.dtypes)["minute"] == "string":
            minute, added = clock_parts("minute")
        else:
            minute, added = F.col("minute").cast("double"), F.lit(0.0)
        parts.append(shots.select("match_id", minute.alias("minute"), added.alias("added")))
    return reduce(DataFrame.unionByName, parts)


def match_clock(
    matches: DataFrame,
    events: DataFrame | None = None,
    shots: DataFrame | None = None,
    default_end: float = 91,
    default_half_end: float = 46,
) -> DataFrame:
    """First-half stoppage, match end and first-half end per match.

    The match ends half a minute after its last event or shot, and never before minute 91
    plus stoppage; the first half ends half a minute after its stoppage, 46 without any.
    """
    stop = F.col("first_half_stoppage")
    if events is None and shots is None:
        clock = matches.select("match_id").withColumns(
            {"first_half_stoppage": F.lit(0), "_end": F.lit(None).cast("double")}
        )
    else:
        rows = _clock_rows(events, shots)
        whole = F.col("minute") + F.coalesce(F.col("added"), F.lit(0.0)).cast("int")
        late = F.col("minute") >= HALFTIME_MINUTE + 1
        at_half = (F.col("minute") == HALFTIME_MINUTE) & (F.col("added") > 0)
        seen = rows.groupBy("match_id").agg(
            F.coalesce(F.max(F.when(at_half, F.col("added"))), F.lit(0)).cast("int").alias("first_half_stoppage"),
            F.max(F.when(~late, whole)).alias("_first"),
            F.max(F.when(late, whole)).alias("_second"),
        )
        seen = seen.withColumn("_end", F.greatest(F.col("_first"), F.col("_second") + stop) + 0.5)
        clock = matches.select("match_id").join(seen.drop("_first", "_second"), "match_id", "left")
        clock = clock.na.fill(0, ["first_half_stoppage"])
    return clock.select(
        "match_id",
        "first_half_stoppage",
        F.greatest(F.coalesce("_end", F.lit(float(default_end))), F.lit(91.0) + stop).alias("match_end"),
        F.when(stop > 0, F.lit(HALFTIME_MINUTE + 0.5) + stop)
        .otherwise(F.lit(float(default_half_end)))
        .alias("first_half_end"),
    )


def _substitutions(lineups: DataFrame) -> DataFrame:
    columns = lineups.columns
    if "on_minute" in columns:
        subs = lineups.where(~F.col("is_starter")) if "is_starter" in columns else lineups
        minute = F.col("on_minute").cast("double")
    else:
        subs = lineups.where(~F.col("is_starter") & (F.col("minutes") > 0))
        minute = F.greatest(F.lit(0.0), F.least(F.lit(90.0), 90 - F.col("minutes").cast("double")))
    return subs.select("match_id", minute.alias("minute")).where(F.col("minute") > 0)


def substitution_minutes(lineups: DataFrame) -> DataFrame:
    """Distinct (match_id, minute) at which substitutes came on.

    From on_minute when present, else 90 minus the minutes played, kept inside 0-90.
    """
    return _substitutions(lineups).distinct()


# Goals and reds come from a first source, and from a second one for matches the first is silent about.
_SOURCES = {"goals": ("event_goals", "shot_goals"), "reds": ("event_reds", "card_reds")}


def _counts(kind: str, hit: Column, is_home: Column) -> dict[str, Column]:
    """Number of hits, and those of either side."""
    return {kind: flag(hit), f"{kind}_home": flag(hit & is_home), f"{kind}_away": flag(hit & ~is_home)}


def _marks(
    results: DataFrame,
    clock: DataFrame,
    events: DataFrame | None,
    shots: DataFrame | None,
    lineups: DataFrame | None,
    stats: DataFrame | None,
    include_goals: bool,
    include_halftime: bool,
) -> DataFrame:
    """One row per match and minute: whether it is a boundary, goals and reds by source, chances.

    Every input is read once; rows combine map-side before the shuffle.
    """
    ends = [F.lit(0.0), F.col("match_end")] + ([F.col("first_half_end")] if include_halftime else [])
    parts = [clock.select("match_id", F.explode(F.array(*ends)).alias("minute"), F.lit(1).alias("boundary"))]
    homes = results.select("match_id", "home_team")
    minute = lambda c: F.col(c).try_cast("double").alias("minute")
    if events is not None:
        events = flagged_events(events)
        goal = F.coalesce(F.col("is_goal"), F.lit(False)) if include_goals else F.lit(False)
        red, sub = (F.coalesce(F.col(c), F.lit(False)) for c in ("is_red_card", "is_sub"))
        counts = {**_counts("event_goals", goal, F.col("is_home")), **_counts("event_reds", red, F.col("is_home"))}
        rows = events.where(goal | red | sub)
        parts.append(
            rows.select("match_id", minute("minute"), F.lit(1).alias("boundary"), *[v.alias(c) for c, v in counts.items()])
        )
    if shots is not None:
        sided = shots.join(homes, "match_id")
        at_home = F.col("team") == F.col("home_team")
        goal = F.coalesce(F.col("is_goal"), F.lit(False)) if include_goals else F.lit(False)
        chance = lambda side: F.when(~F.col("is_penalty") & side, F.col("xg"))
        parts.append(
            sided.select(
                "match_id",
                minute("minute"),
                F.lit(0).alias("boundary"),
                *[v.alias(c) for c, v in _counts("shot_goals", goal, at_home).items()],
                chance(at_home).alias("npxg_home"),
                chance(~at_home).alias("npxg_away"),
            )
        )
    cards = next((t for t in (lineups, stats) if t is not None and "crd_r" in t.columns), None)
    if cards is not None:
        when = next(c for c in ("off_minute", "minutes", "min") if c in cards.columns)
        booked = cards.where((F.col("crd_r").try_cast("double") > 0) & (F.col(when).try_cast("double") > 0))
        counts = _counts("card_reds", F.lit(True), F.col("team") == F.col("home_team"))
        parts.append(
            booked.join(homes, "match_id").select(
                "match_id", minute(when), F.lit(0).alias("boundary"), *[v.alias(c) for c, v in counts.items()]
            )
        )
    if lineups is not None:
        parts.append(_substitutions(lineups).withColumn("boundary", F.lit(1)))
    marks = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    names = [f"{k}{side}" for pair in _SOURCES.values() for k in pair for side in ("", "_home", "_away")]
    sums = [
        F.coalesce(F.sum(c) if c in marks.columns else F.lit(None).cast("bigint"), F.lit(0)).alias(c)
        for c in names + ["npxg_home", "npxg_away"]
    ]
    per_minute = (
        marks.where(F.col("minute").isNotNull())
        .groupBy("match_id", "minute")
        .agg(F.max("boundary").alias("boundary"), *sums)
        .join(results.select("match_id"), "match_id", "left_semi")
    )
    # Settle the source per match; the window holds one row per clock value.
    whole = W.partitionBy("match_id")
    settled, bounds = {}, F.col("boundary") == 1
    for kind, (first, second) in _SOURCES.items():
        told = F.sum(first).over(whole) > 0
        for side in ("home", "away"):
            settled[f"{kind}_{side}"] = F.when(told, F.col(f"{first}_{side}")).otherwise(F.col(f"{second}_{side}"))
        bounds = bounds | (F.col(first) > 0) | (~told & (F.col(second) > 0))
    return per_minute.withColumns({**settled, "boundary": bounds.cast("int")}).drop(*names)


def build_segments(
    results: DataFrame,
    events: DataFrame | None = None,
    shots: DataFrame | None = None,
    lineups: DataFrame | None = None,
    stats: DataFrame | None = None,
    include_goals: bool = True,
    include_halftime: bool = True,
    effective: bool = False,
) -> DataFrame:
    """Cut every match at its boundaries and attach score, reds and open-play chances.

    A segment starts with the state after the events on its start minute; starts up to minute
    2 count earlier events only. Penalties are left out of the chances; shots before the first
    or after the last start fall into the first or last segment. Goals come from events, else
    shots; reds from events, else cards. `effective` puts events on the stoppage-aware clock.

    Marks are summed per match and minute first, so the window below sees at most one row per
    clock value of a match.
    """
    clock = match_clock(results, events, shots)
    if effective and events is not None:
        events = flagged_events(events).join(clock.select("match_id", "first_half_stoppage"), "match_id")
        added = F.col("added_time") if "added_time" in events.columns else F.lit(0)
        events = events.withColumn("minute", effective_minute("minute", added, "first_half_stoppage"))
    marks = _marks(results, clock, events, shots, lineups, stats, include_goals, include_halftime)
    order = W.partitionBy("match_id").orderBy("minute")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy("match_id")
    running = {f"_{c}": F.sum(c).over(upto) for c in STATE}
    numbered = marks.withColumns(
        {**running, "_num": F.sum("boundary").over(upto), "_n": F.sum("boundary").over(whole) - 1}
    )
    inside = numbered.withColumn(
        "segment_num", F.greatest(F.lit(1), F.least(F.col("_n"), F.col("_num"))).cast("int")
    )
    opens = F.col("boundary") == 1
    here = opens & (F.col("_num") == F.col("segment_num"))
    state = lambda c: F.when(F.col("minute") > 2, F.col(f"_{c}")).otherwise(F.col(f"_{c}") - F.col(c))
    at_start = lambda e: F.max(F.when(here, e))
    segments = inside.groupBy("match_id", "segment_num").agg(
        at_start(F.col("minute")).alias("start_minute"),
        at_start(state("goals_home")).cast("long").alias("gf_home"),
        at_start(state("goals_away")).cast("long").alias("ga_home"),
        at_start(F.col("goals_home")).cast("long").alias("goals_home"),
        at_start(F.col("goals_away")).cast("long").alias("goals_away"),
        at_start(state("reds_home")).cast("long").alias("red_home"),
        at_start(state("reds_away")).cast("long").alias("red_away"),
        F.sum("npxg_home").cast("double").alias("npxg_home"),
        F.sum("npxg_away").cast("double").alias("npxg_away"),
        F.max(F.when(opens & (F.col("_num") > F.col("_n")), F.col("minute"))).alias("_last_end"),
    )
    next_start = F.lead("start_minute").over(W.partitionBy("match_id").orderBy("segment_num"))
    segments = segments.withColumn("end_minute", F.coalesce(next_start, F.col("_last_end")))
    duration = F.col("end_minute") - F.col("start_minute")
    npxgd = F.col("npxg_home") - F.col("npxg_away")
    segments = segments.withColumns(
        {
            "duration": duration,
            "avg_min": (F.col("start_minute") + F.col("end_minute")) / 2,
            "n_players_home": PLAYERS_PER_TEAM - F.col("red_home"),
            "n_players_away": PLAYERS_PER_TEAM - F.col("red_away"),
            "npxgd": npxgd,
            "npxgd_per_90": F.when(duration > 0, npxgd * MINUTES_PER_MATCH / duration).otherwise(F.lit(0.0)),
            "segment_id": F.concat_ws("_", "match_id", "segment_num"),
        }
    ).drop("_last_end")
    extra = [c for c in ("league", "season_end_year", "country") if c in results.columns]
    if extra:
        # results hold one row per match
        segments = segments.join(results.select("match_id", *extra), "match_id", "left")
    return segments.where(F.col("duration") > 0)


def assign_players(segments: DataFrame, lineups: DataFrame) -> DataFrame:
    """Players on the pitch per segment: on at or before its start and off after it.

    Without on and off minutes, starters begin at 0 and others end with the match. The match
    is the join key; a match has few segments, so the range test never multiplies players by
    more than its number of clock values.
    """
    played = lineups.where(F.col("minutes") > 0)
    if not {"on_minute", "off_minute"} <= set(lineups.columns):
        ends = segments.groupBy("match_id").agg(F.max("end_minute").alias("_end"))
        starter = F.col("is_starter") if "is_starter" in lineups.columns else F.lit(True)
        on = F.when(starter, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.col("_end") - F.col("minutes")))
        played = played.join(ends, "match_id").withColumn("on_minute", on)
        played = played.withColumn("off_minute", F.least("_end", F.col("on_minute") + F.col("minutes")))
    p = played.select(
        "match_id", "team", "is_home", "player_name", "player_id", "on_minute", "off_minute"
    ).alias("p")
    s = segments.select("match_id", "segment_id", "segment_num", "start_minute", "end_minute").alias("s")
    on_pitch = (
        (F.col("p.match_id") == F.col("s.match_id"))
        & (F.col("p.on_minute") <= F.col("s.start_minute"))
        & (F.col("p.off_minute") > F.col("s.start_minute"))
    )
    return p.join(s, on_pitch).select(
        "s.match_id", "s.segment_id", "s.segment_num", "s.start_minute", "s.end_minute",
        "p.team", "p.is_home", "p.player_name", "p.player_id",
    )


def events_by_segment(events: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Home and away event counts before each segment start and within each half-open segment.

    `boundaries` has match_id and minute; the last boundary of a match closes its last segment.
    """
    counted = events.groupBy("match_id", F.col("minute").cast("double").alias("minute")).agg(
        F.count_if(F.col("is_home")).alias("_home"), F.count_if(~F.col("is_home")).alias("_away")
    )
    cuts = boundaries.select("match_id", F.col("minute").cast("double").alias("minute"), F.lit(1).alias("_cut"))
    marks = counted.unionByName(cuts, allowMissingColumns=True).groupBy("match_id", "minute").agg(
        F.coalesce(F.sum("_home"), F.lit(0)).alias("_home"),
        F.coalesce(F.sum("_away"), F.lit(0)).alias("_away"),
        F.coalesce(F.max("_cut"), F.lit(0)).alias("_cut"),
    )
    upto = W.partitionBy("match_id").orderBy("minute").rowsBetween(W.unboundedPreceding, 0)
    seen = marks.withColumns(
        {
            "_num": F.sum("_cut").over(upto),
            "_home_upto": F.sum("_home").over(upto),
            "_away_upto": F.sum("_away").over(upto),
        }
    )
    before = lambda side: F.when(F.col("minute") > 2, F.col(f"{side}_upto")).otherwise(F.col(f"{side}_upto") - F.col(side))
    cut = F.col("_cut") == 1
    per_segment = seen.where(F.col("_num") > 0).groupBy("match_id", F.col("_num").alias("segment_num")).agg(
        F.max(F.when(cut, F.col("minute"))).alias("start_minute"),
        F.max(F.when(cut, before("_home"))).alias("home_before"),
        F.max(F.when(cut, before("_away"))).alias("away_before"),
        F.sum("_home").alias("home_within"),
        F.sum("_away").alias("away_within"),
    )
    last = F.max("segment_num").over(W.partitionBy("match_id"))
    return per_segment.withColumn("_last", last).where(F.col("segment_num") < F.col("_last")).drop("_last")


def segment_players(players: DataFrame, segment_id: str) -> DataFrame:
    """Players of one segment by side."""
    return players.where(F.col("segment_id") == segment_id).select("is_home", "player_id")


def events_from_feed(events: DataFrame, home_ids: DataFrame | None = None) -> DataFrame:
    """Feed events as segment inputs: seconds become added time, a second yellow is a red card."""
    columns = events.columns
    if "team_position" in columns:
        at_home = F.lower("team_position") == "home"
    elif home_ids is not None and "home_team_id" in home_ids.columns:
        events = events.join(home_ids.select("match_id", "home_team_id").distinct(), "match_id", "left")
        at_home = F.col("team_id") == F.col("home_team_id")
    else:
        at_home = F.lit(None).cast("boolean")
    added = F.col("second").cast("double") / 60 if "second" in columns else F.lit(0.0)
    kind = F.col("event_type")
    return events.select(
        "match_id",
        F.col("minute").cast("double").alias("minute"),
        added.alias("added_time"),
        "event_type",
        (kind == "goal").alias("is_goal"),
        (kind == "substitution").alias("is_sub"),
        kind.isin("red_card", "second_yellow").alias("is_red_card"),
        at_home.alias("is_home"),
        "player_id",
        "player_name",
    )


def lineups_from_feed(lineups: DataFrame) -> DataFrame:
    """Feed line-ups with on and off minutes; no off minute means 90, never before on + minutes."""
    columns = lineups.columns
    minutes = F.col("minutes_played").cast("double") if "minutes_played" in columns else F.lit(0.0)
    sub_on = F.col("sub_on_minute").cast("double") if "sub_on_minute" in columns else F.lit(None).cast("double")
    on = F.when(F.col("is_starter"), F.lit(0.0)).when(~F.col("is_starter"), sub_on)
    sub_off = F.col("sub_off_minute").cast("double") if "sub_off_minute" in columns else F.lit(None).cast("double")
    off = F.coalesce(F.nullif(sub_off, F.lit(0.0)), F.lit(90.0))
    played_to = on + minutes
    at_home = F.lower("team_position") == "home" if "team_position" in columns else F.lit(None).cast("boolean")
    return lineups.select(
        "match_id",
        "player_id",
        "player_name",
        F.col("team_name" if "team_name" in columns else "team_id").alias("team"),
        at_home.alias("is_home"),
        "is_starter",
        minutes.alias("minutes"),
        on.alias("on_minute"),
        F.when(played_to.isNotNull(), F.greatest(off, played_to)).alias("off_minute"),
    )


def shots_from_feed(shots: DataFrame, goals_as_xg: bool = False) -> DataFrame:
    """Feed shots as segment inputs; the chance is given, or 1 per goal, or NULL."""
    columns = shots.columns
    if "xg" in columns:
        xg = F.col("xg").cast("double")
    elif goals_as_xg:
        xg = F.col("is_goal").cast("double")
    else:
        xg = F.lit(None).cast("double")
    penalty = F.lower("situation") == "penalty" if "situation" in columns else F.lit(False)
    return shots.select(
        "match_id",
        F.col("minute").cast("double").alias("minute"),
        F.col("team_name" if "team_name" in columns else "team_id").alias("team"),
        "player_id",
        "player_name",
        xg.alias("xg"),
        "is_goal",
        penalty.alias("is_penalty"),
    )


def results_from_lineups(lineups: DataFrame) -> DataFrame:
    """One row per match from its starters: teams, date and season."""
    starters = lineups.where(F.col("is_starter"))
    of = lambda side, c: F.min(F.when(F.lower("team_position") == side, F.col(c)))
    results = starters.groupBy("match_id").agg(
        of("home", "team_name").alias("home_team"),
        of("away", "team_name").alias("away_team"),
        of("home", "team_id").alias("home_team_id"),
        of("away", "team_id").alias("away_team_id"),
        F.min(F.to_date("match_date")).alias("match_date"),
    )
    return results.withColumn("season", season_of_date("match_date"))


def feed_tables(
    lineups: DataFrame,
    events: DataFrame | None = None,
    shots: DataFrame | None = None,
    stats: DataFrame | None = None,
    goals_as_xg: bool = False,
) -> dict[str, DataFrame | None]:
    """All segment inputs of a feed."""
    results = results_from_lineups(lineups)
    return {
        "results": results,
        "lineups": lineups_from_feed(lineups),
        "events": events_from_feed(events, results) if events is not None else None,
        "shots": shots_from_feed(shots, goals_as_xg) if shots is not None else None,
        "stats": stats,
    }


def segment_counts(segments: DataFrame, by: list[str]) -> DataFrame:
    """Segments and matches per group (match, league, season)."""
    return segments.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_segments"), F.count_distinct("match_id").alias("n_matches")
    )


def duration_summary(segments: DataFrame) -> DataFrame:
    """Spread of segment durations and the number without length (one row)."""
    q = F.percentile("duration", [0.25, 0.5, 0.75])
    return segments.agg(
        F.min("duration").alias("min"),
        q[0].alias("q25"),
        q[1].alias("median"),
        F.avg("duration").alias("mean"),
        q[2].alias("q75"),
        F.max("duration").alias("max"),
        F.count_if(F.col("duration") <= 0).alias("n_without_length"),
    )


def full_strength_share(players: DataFrame) -> DataFrame:
    """Segments with all 22 players, and the spread of players per segment (one row)."""
    per_segment = players.groupBy("segment_id").agg(F.count(F.lit(1)).alias("n_players"))
    full = F.col("n_players") == 2 * PLAYERS_PER_TEAM
    return per_segment.agg(
        F.count(F.lit(1)).alias("n_segments"),
        F.min("n_players").alias("min_players"),
        F.avg("n_players").alias("mean_players"),
        F.max("n_players").alias("max_players"),
        F.count_if(full).alias("n_full"),
        F.avg(full.cast("double")).alias("full_share"),
    )


def lineup_changes(players: DataFrame) -> DataFrame:
    """Players coming in and going out between consecutive segments of a match."""
    stays = W.partitionBy("match_id", "player_id").orderBy("segment_num")
    seen = players.select("match_id", "player_id", "segment_num").withColumns(
        {"_prev": F.lag("segment_num").over(stays), "_next": F.lead("segment_num").over(stays)}
    )
    num = F.col("segment_num")
    moves = seen.select(
        "match_id",
        F.explode(
            F.array(
                F.struct(num.alias("segment_num"), flag(F.col("_prev") == num - 1).alias("kept"), F.lit(1).alias("here")),
                F.struct((num + 1).alias("segment_num"), flag(F.col("_next") == num + 1).alias("kept"), F.lit(0).alias("here")),
            )
        ).alias("m"),
    ).select("match_id", "m.*")
    changed = F.col("kept") == 0
    counts = moves.groupBy("match_id", "segment_num").agg(
        F.count_if((F.col("here") == 1) & changed).alias("n_in"),
        F.count_if((F.col("here") == 0) & changed).alias("n_out"),
    )
    spans = players.groupBy("match_id").agg(F.min("segment_num").alias("_lo"), F.max("segment_num").alias("_hi"))
    inside = (F.col("segment_num") > F.col("_lo")) & (F.col("segment_num") <= F.col("_hi"))
    return counts.join(spans, "match_id").where(inside).drop("_lo", "_hi")


def xg_quality(segments: DataFrame, threshold: float = 20) -> DataFrame:
    """Per league and season: share of segments without any chance, flagged at the threshold."""
    groups = [c for c in ("league", "season_end_year") if c in segments.columns]
    quality = segments.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_segments"),
        F.count_distinct("match_id").alias("n_matches"),
        F.count_if((F.col("npxg_home") == 0) & (F.col("npxg_away") == 0)).alias("zero_xg_count"),
        F.avg(F.col("npxg_home") + F.col("npxg_away")).alias("avg_npxg"),
    )
    share = F.col("zero_xg_count") / F.col("n_segments") * 100
    return quality.withColumn("zero_xg_pct", share).withColumn("is_bad", F.col("zero_xg_pct") >= threshold)


def drop_bad_xg(
    segments: DataFrame, players: DataFrame, matches: DataFrame, threshold: float = 20
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Remove leagues and seasons with poor chance data from all three tables; also the report.

    Each match lies in one league and season, so the bad groups turn into bad matches.
    """
    report = xg_quality(segments, threshold)
    groups = [c for c in ("league", "season_end_year") if c in segments.columns]
    if not groups:
        return segments, players, matches, report
    bad = report.where("is_bad").select(*[F.col(g).alias(f"_b_{g}") for g in groups])
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_b_{g}")) for g in groups])
    kept = segments.join(bad, same, "left_anti")
    kept_matches = kept.select("match_id").distinct()
    kept_players = players.join(kept.select("segment_id"), "segment_id", "left_semi")
    return kept, kept_players, matches.join(kept_matches, "match_id", "left_semi"), report
