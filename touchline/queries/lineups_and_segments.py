"""Queries over constant-lineup segments; orders are matches, line items their events."""

from pyspark.sql import functions as F

from touchline.operators import segments as S
from touchline.queries.roles import rounded, table


def results(spark, folder):
    o = table(spark, folder, "orders")
    return o.select(
        F.col("o_orderkey").alias("match_id"),
        F.lit("O").alias("home_team"),
        F.lit("F").alias("away_team"),
        F.year("o_orderdate").alias("season_end_year"),
        F.col("o_orderstatus").alias("league"),
    )


RESULTS = "SELECT o_orderkey AS match_id, 'O' AS home_team, 'F' AS away_team, year(o_orderdate) AS season_end_year, o_orderstatus AS league FROM orders"


def _lines(spark, folder):
    return table(spark, folder, "lineitem").withColumn("match_id", F.col("l_orderkey"))


def events(spark, folder):
    li = _lines(spark, folder)
    kind = (
        F.when(F.col("l_returnflag") == "A", "goal")
        .when(F.col("l_returnflag") == "R", "substitution")
        .when(F.col("l_discount") < 0.03, "red_card")
        .otherwise("other")
    )
    return li.select(
        "match_id",
        (F.col("l_linenumber") * 12 + F.floor(F.col("l_quantity") / 5) - 11).cast("double").alias("minute"),
        (F.col("l_suppkey") % 4).cast("double").alias("added_time"),
        kind.alias("event_type"),
        (F.col("l_partkey") % 2 == 0).alias("is_home"),
    )


EVENTS = """SELECT l_orderkey AS match_id, CAST(l_linenumber * 12 + floor(l_quantity / 5) - 11 AS DOUBLE) AS minute,
  l_suppkey % 4 AS added, CASE WHEN l_returnflag = 'A' THEN 'goal' WHEN l_returnflag = 'R' THEN 'substitution'
  WHEN l_discount < 0.03 THEN 'red_card' ELSE 'other' END AS event_type, l_partkey % 2 = 0 AS is_home FROM lineitem"""


def shots(spark, folder):
    li = _lines(spark, folder)
    return li.select(
        "match_id",
        F.floor(F.col("l_extendedprice") / 1000).cast("double").alias("minute"),
        F.col("l_linestatus").alias("team"),
        ((F.col("l_suppkey") % 10) * F.col("l_tax") + F.col("l_discount") / 3).alias("xg"),
        F.lit(False).alias("is_goal"),
        (F.col("l_tax") >= 0.08).alias("is_penalty"),
    )


SHOTS = """SELECT l_orderkey AS match_id, floor(l_extendedprice / 1000) AS minute, l_linestatus AS team,
  (l_suppkey % 10) * l_tax + l_discount / 3 AS xg, l_tax >= 0.08 AS is_penalty FROM lineitem"""


def lineups(spark, folder):
    li = _lines(spark, folder)
    starts = F.col("l_linenumber") <= 4
    on = F.when(starts, 0.0).otherwise(F.col("l_linenumber") * 9.0)
    return li.select(
        "match_id",
        F.col("l_suppkey").alias("player_id"),
        F.concat(F.lit("player "), F.col("l_suppkey")).alias("player_name"),
        F.col("l_linestatus").alias("team"),
        (F.col("l_linestatus") == "O").alias("is_home"),
        starts.alias("is_starter"),
        (F.col("l_quantity") + 20).alias("minutes"),
        on.alias("on_minute"),
        (on + F.col("l_quantity") + 20).alias("off_minute"),
    )


LINEUPS = """SELECT l_orderkey AS match_id, l_suppkey AS player_id, 'player ' || l_suppkey AS player_name, l_linestatus AS team,
  l_linestatus = 'O' AS is_home, l_linenumber <= 4 AS is_starter, l_quantity + 20 AS minutes,
  CASE WHEN l_linenumber <= 4 THEN 0 ELSE l_linenumber * 9.0 END AS on_minute,
  CASE WHEN l_linenumber <= 4 THEN 0 ELSE l_linenumber * 9.0 END + l_quantity + 20 AS off_minute FROM lineitem"""


def built(spark, folder, **options):
    return S.build_segments(
        results(spark, folder),
        events(spark, folder),
        shots(spark, folder),
        lineups(spark, folder),
        **options,
    )


def match_clock(spark, folder):
    return rounded(S.match_clock(results(spark, folder), events(spark, folder), shots(spark, folder)))


def segments(spark, folder):
    out = built(spark, folder)
    return rounded(out.drop("home_team"))


def segments_without_goals(spark, folder):
    out = built(spark, folder, include_goals=False, include_halftime=False)
    return out.select("match_id", "segment_num", "start_minute", "end_minute", "gf_home", "red_home")


def segments_effective_clock(spark, folder):
    out = S.build_segments(results(spark, folder), events(spark, folder), shots(spark, folder), effective=True)
    return out.select("match_id", "segment_num", "start_minute", "end_minute", "gf_home", "ga_home")


def players(spark, folder):
    return S.assign_players(built(spark, folder), lineups(spark, folder))


def segment_lineups(spark, folder):
    return players(spark, folder).drop("player_name")


def one_segment_players(spark, folder):
    return S.segment_players(players(spark, folder), "5_2")


def lineups_without_clock(spark, folder):
    lu = lineups(spark, folder).drop("on_minute", "off_minute")
    out = S.assign_players(built(spark, folder), lu)
    return out.groupBy("match_id", "segment_num").agg(F.count(F.lit(1)).alias("n_players"))


def substitution_minutes(spark, folder):
    return S.substitution_minutes(lineups(spark, folder))


def substitution_minutes_estimated(spark, folder):
    return S.substitution_minutes(lineups(spark, folder).drop("on_minute", "off_minute"))


def flagged_events(spark, folder):
    out = S.flagged_events(events(spark, folder))
    counts = [F.count_if(F.col(c)).alias(c) for c in ("is_goal", "is_sub", "is_red_card")]
    return out.groupBy("match_id").agg(*counts)


def events_by_segment(spark, folder):
    goals = events(spark, folder).where(F.col("event_type") == "goal")
    cuts = _lines(spark, folder).select("match_id", (F.col("l_linenumber") * 12 - 10).alias("minute")).distinct()
    return S.events_by_segment(goals, cuts)


def segment_audit(spark, folder):
    return S.segment_counts(built(spark, folder), ["league", "season_end_year"])


def segment_durations(spark, folder):
    return rounded(S.duration_summary(built(spark, folder)))


def full_strength(spark, folder):
    return rounded(S.full_strength_share(players(spark, folder)))


def lineup_changes(spark, folder):
    one_each = players(spark, folder).select("match_id", "segment_num", "player_id").distinct()
    return S.lineup_changes(one_each)


def xg_quality(spark, folder):
    return rounded(S.xg_quality(built(spark, folder), threshold=20))


def segments_after_xg_filter(spark, folder):
    kept, _, _, _ = S.drop_bad_xg(built(spark, folder), players(spark, folder), results(spark, folder), threshold=62)
    return kept.groupBy("league", "season_end_year").agg(F.count(F.lit(1)).alias("n_segments"))


def _feed_lineups(spark, folder):
    li = _lines(spark, folder)
    return li.select(
        "match_id",
        F.col("l_suppkey").alias("player_id"),
        F.concat(F.lit("player "), F.col("l_suppkey")).alias("player_name"),
        (F.col("l_linestatus") == "O").cast("int").alias("team_id"),
        F.col("l_linestatus").alias("team_name"),
        F.when(F.col("l_linestatus") == "O", "Home").otherwise("away").alias("team_position"),
        (F.col("l_linenumber") <= 4).alias("is_starter"),
        F.col("l_quantity").cast("int").alias("minutes_played"),
        (F.col("l_linenumber") * 9).alias("sub_on_minute"),
        F.when(F.col("l_suppkey") % 3 == 0, 0).otherwise(70).alias("sub_off_minute"),
        F.col("l_shipdate").alias("match_date"),
    )


def feed_lineups(spark, folder):
    out = S.lineups_from_feed(_feed_lineups(spark, folder))
    return out.groupBy("match_id", "team", "is_home").agg(
        F.count(F.lit(1)).alias("n"), F.sum("on_minute").alias("sum_on"), F.sum("off_minute").alias("sum_off")
    )


def feed_results(spark, folder):
    out = S.results_from_lineups(_feed_lineups(spark, folder))
    return out.withColumn("match_date", F.date_format("match_date", "yyyy-MM-dd"))


def feed_events(spark, folder):
    e = events(spark, folder).withColumns(
        {
            "second": (F.col("added_time") * 15).cast("int"),
            "team_position": F.when(F.col("is_home"), "HOME").otherwise("away"),
            "event_type": F.when(F.col("event_type") == "other", "second_yellow").otherwise(F.col("event_type")),
            "player_id": F.lit(1),
            "player_name": F.lit("p"),
        }
    )
    out = S.events_from_feed(e)
    return rounded(
        out.groupBy("match_id", "is_home").agg(
            F.round(F.sum("added_time"), 6).alias("added"),
            F.count_if("is_goal").alias("goals"),
            F.count_if("is_sub").alias("subs"),
            F.count_if("is_red_card").alias("reds"),
        )
    )


def feed_shots(spark, folder):
    s = shots(spark, folder).withColumns(
        {
            "is_goal": F.col("xg") > 0.3,
            "team_id": F.col("team"),
            "player_id": F.lit(1),
            "player_name": F.lit("p"),
            "situation": F.when(F.col("is_penalty"), "Penalty").otherwise("OpenPlay"),
        }
    ).drop("xg", "is_penalty", "team")
    out = S.shots_from_feed(s, goals_as_xg=True)
    return out.groupBy("match_id", "team").agg(F.sum("xg").alias("xg"), F.count_if("is_penalty").alias("penalties"))


CLOCK = f"""
  SELECT match_id, CAST(coalesce(stop, 0) AS INT) AS first_half_stoppage,
    greatest(coalesce(greatest(e1, e2 + coalesce(stop, 0)) + 0.5, 91), 91 + coalesce(stop, 0)) AS match_end,
    CASE WHEN coalesce(stop, 0) > 0 THEN 45.5 + stop ELSE 46 END AS first_half_end
  FROM ({RESULTS}) LEFT JOIN (
    SELECT match_id, max(added) FILTER (minute = 45 AND added > 0) AS stop, max(minute + added) FILTER (minute < 46) AS e1,
      max(minute + added) FILTER (minute >= 46) AS e2
    FROM (SELECT match_id, minute, added FROM ({EVENTS}) UNION ALL SELECT match_id, minute, 0 FROM ({SHOTS})) GROUP BY match_id) USING (match_id)
"""


def _segments_sql(goals=True, half=True, with_lineups=True, effective=False) -> str:
    ev = f"({EVENTS})"
    if effective:
        ev = f"""(SELECT e.match_id, e.minute + e.added + CASE WHEN e.minute >= 46 THEN c.first_half_stoppage ELSE 0 END AS minute,
                  e.event_type, e.is_home FROM ({EVENTS}) e JOIN ({CLOCK}) c USING (match_id))"""
    kinds = "('goal', 'substitution', 'red_card')" if goals else "('substitution', 'red_card')"
    bounds = f"SELECT match_id, 0.0 AS m FROM ({RESULTS}) UNION SELECT match_id, match_end FROM ({CLOCK})"
    if half:
        bounds += f" UNION SELECT match_id, first_half_end FROM ({CLOCK})"
    bounds += f" UNION SELECT match_id, minute FROM {ev} WHERE event_type IN {kinds}"
    if with_lineups:
        bounds += f" UNION SELECT match_id, on_minute FROM ({LINEUPS}) WHERE NOT is_starter"
    before = "(ev.minute < s.start_minute OR (ev.minute = s.start_minute AND s.start_minute > 2))"
    within = "(ev.minute >= s.start_minute AND ev.minute < s.end_minute)"
    count = lambda kind, home, op: (
        f"count(*) FILTER (ev.event_type = '{kind}' AND {'' if home else 'NOT '}ev.is_home AND {op})"
    )
    goal = (lambda home, op: count("goal", home, op)) if goals else (lambda home, op: "0")
    return f"""
      WITH ev AS MATERIALIZED (SELECT e.* FROM {ev} e), b AS (SELECT DISTINCT match_id, m FROM ({bounds}) JOIN (SELECT match_id AS k FROM ({RESULTS})) ON k = match_id),
      s AS MATERIALIZED (SELECT * FROM (SELECT match_id, CAST(row_number() OVER w AS INT) AS segment_num, m AS start_minute, lead(m) OVER w AS end_minute
              FROM b WINDOW w AS (PARTITION BY match_id ORDER BY m)) WHERE end_minute IS NOT NULL),
      x AS (SELECT s.match_id, s.segment_num, sum(xg) FILTER (team = 'O') AS xh, sum(xg) FILTER (team <> 'O') AS xa
            FROM (SELECT *, max(segment_num) OVER (PARTITION BY match_id) AS n FROM s) s JOIN ({SHOTS}) h ON h.match_id = s.match_id AND NOT h.is_penalty
              AND (h.minute >= s.start_minute OR segment_num = 1) AND (h.minute < s.end_minute OR segment_num = n) GROUP BY ALL),
      g AS (SELECT s.match_id, s.segment_num, s.start_minute, s.end_minute, {goal(True, before)} AS gf_home, {goal(False, before)} AS ga_home, {goal(True, within)} AS goals_home,
              {goal(False, within)} AS goals_away, {count('red_card', True, before)} AS red_home, {count('red_card', False, before)} AS red_away
            FROM s LEFT JOIN ev ON ev.match_id = s.match_id GROUP BY s.match_id, s.segment_num, s.start_minute, s.end_minute),
      c AS (SELECT g.*, coalesce(xh, 0) AS npxg_home, coalesce(xa, 0) AS npxg_away FROM g LEFT JOIN x USING (match_id, segment_num))
      SELECT c.*, end_minute - start_minute AS duration, (start_minute + end_minute) / 2 AS avg_min, 11 - red_home AS n_players_home,
        11 - red_away AS n_players_away, match_id || '_' || segment_num AS segment_id, r.league, r.season_end_year
      FROM c JOIN ({RESULTS}) r USING (match_id)"""


SEGMENTS = _segments_sql()
PLAYERS = f"""
  SELECT s.match_id, s.segment_id, s.segment_num, s.start_minute, s.end_minute, p.team, p.is_home, p.player_name, p.player_id
  FROM ({SEGMENTS}) s JOIN ({LINEUPS}) p ON p.match_id = s.match_id AND p.on_minute <= s.start_minute AND p.off_minute > s.start_minute
"""
_QUALITY = f"""
  SELECT league, season_end_year, count(*) AS n_segments, count(DISTINCT match_id) AS n_matches,
    count(*) FILTER (npxg_home = 0 AND npxg_away = 0) AS zero_xg_count, round(avg(npxg_home + npxg_away), 6) AS avg_npxg,
    round(count(*) FILTER (npxg_home = 0 AND npxg_away = 0) / count(*) * 100, 6) AS zero_xg_pct FROM ({SEGMENTS}) GROUP BY ALL
"""
_FEED = """SELECT l_orderkey AS match_id, l_linestatus AS team, CASE WHEN l_linenumber <= 4 THEN 0 ELSE l_linenumber * 9 END AS o,
  l_quantity AS m, CASE WHEN l_suppkey % 3 = 0 THEN 90 ELSE 70 END AS f, l_linenumber <= 4 AS st, l_shipdate FROM lineitem"""

ORACLES = {
    "match_clock": CLOCK,
    "segments": f"""
      SELECT * REPLACE (round(npxg_home, 6) AS npxg_home, round(npxg_away, 6) AS npxg_away),
        round(npxg_home - npxg_away, 6) + 0.0 AS npxgd, round((npxg_home - npxg_away) * 90 / duration, 6) + 0.0 AS npxgd_per_90 FROM ({SEGMENTS})""",
    "segments_without_goals": f"""
      SELECT match_id, segment_num, start_minute, end_minute, gf_home, red_home FROM ({_segments_sql(goals=False, half=False)})""",
    "segments_effective_clock": f"""
      SELECT match_id, segment_num, start_minute, end_minute, gf_home, ga_home FROM ({_segments_sql(with_lineups=False, effective=True)})""",
    "segment_lineups": f"SELECT * EXCLUDE (player_name) FROM ({PLAYERS})",
    "one_segment_players": f"SELECT is_home, player_id FROM ({PLAYERS}) WHERE segment_id = '5_2'",
    "lineups_without_clock": f"""
      WITH e AS (SELECT match_id, max(end_minute) AS me FROM ({SEGMENTS}) GROUP BY match_id),
      p AS (SELECT l.match_id, minutes, CASE WHEN is_starter THEN 0 ELSE greatest(0, me - minutes) END AS o, me FROM ({LINEUPS}) l JOIN e USING (match_id))
      SELECT s.match_id, s.segment_num, count(*) AS n_players FROM ({SEGMENTS}) s JOIN p ON p.match_id = s.match_id AND o <= start_minute AND least(me, o + minutes) > start_minute
      GROUP BY ALL""",
    "substitution_minutes": f"SELECT DISTINCT match_id, CAST(on_minute AS DOUBLE) AS minute FROM ({LINEUPS}) WHERE NOT is_starter AND on_minute > 0",
    "substitution_minutes_estimated": f"""
      SELECT DISTINCT match_id, greatest(0, least(90, 90 - minutes)) AS minute FROM ({LINEUPS}) WHERE NOT is_starter AND greatest(0, least(90, 90 - minutes)) > 0""",
    "flagged_events": f"""
      SELECT match_id, count(*) FILTER (event_type = 'goal') AS is_goal, count(*) FILTER (event_type = 'substitution') AS is_sub,
        count(*) FILTER (event_type = 'red_card') AS is_red_card FROM ({EVENTS}) GROUP BY match_id""",
    "events_by_segment": f"""
      WITH g AS (SELECT * FROM ({EVENTS}) WHERE event_type = 'goal'), c AS (SELECT DISTINCT l_orderkey AS match_id, CAST(l_linenumber * 12 - 10 AS DOUBLE) AS m FROM lineitem),
      s AS (SELECT * FROM (SELECT match_id, row_number() OVER w AS segment_num, m AS start_minute, lead(m) OVER w AS e FROM c WINDOW w AS (PARTITION BY match_id ORDER BY m)) WHERE e IS NOT NULL)
      SELECT s.match_id, segment_num, start_minute,
        count(*) FILTER (is_home AND (minute < start_minute OR minute = start_minute AND start_minute > 2)) AS home_before,
        count(*) FILTER (NOT is_home AND (minute < start_minute OR minute = start_minute AND start_minute > 2)) AS away_before,
        count(*) FILTER (is_home AND minute >= start_minute AND minute < e) AS home_within,
        count(*) FILTER (NOT is_home AND minute >= start_minute AND minute < e) AS away_within
      FROM s LEFT JOIN g ON g.match_id = s.match_id GROUP BY ALL""",
    "segment_audit": f"SELECT league, season_end_year, count(*) AS n_segments, count(DISTINCT match_id) AS n_matches FROM ({SEGMENTS}) GROUP BY ALL",
    "segment_durations": f"""
      SELECT min(duration) AS min, round(quantile_cont(duration, 0.25), 6) AS q25, round(quantile_cont(duration, 0.5), 6) AS median, round(avg(duration), 6) AS mean,
        round(quantile_cont(duration, 0.75), 6) AS q75, max(duration) AS max, count(*) FILTER (duration <= 0) AS n_without_length FROM ({SEGMENTS})""",
    "full_strength": f"""
      WITH n AS (SELECT segment_id, count(*) AS n FROM ({PLAYERS}) GROUP BY segment_id)
      SELECT count(*) AS n_segments, min(n) AS min_players, round(avg(n), 6) AS mean_players, max(n) AS max_players, count(*) FILTER (n = 22) AS n_full,
        round(avg(CAST(n = 22 AS INT)), 6) AS full_share FROM n""",
    "lineup_changes": f"""
      WITH p AS (SELECT DISTINCT match_id, segment_num, player_id FROM ({PLAYERS})),
      h AS (SELECT match_id, min(segment_num) AS lo, max(segment_num) AS hi FROM p GROUP BY match_id),
      i AS (SELECT match_id, segment_num, player_id FROM p WHERE (match_id, segment_num - 1, player_id) NOT IN (SELECT (match_id, segment_num, player_id) FROM p)),
      o AS (SELECT match_id, segment_num + 1 AS segment_num, player_id FROM p WHERE (match_id, segment_num + 1, player_id) NOT IN (SELECT (match_id, segment_num, player_id) FROM p)),
      k AS (SELECT DISTINCT match_id, segment_num FROM p UNION SELECT DISTINCT match_id, segment_num + 1 FROM p)
      SELECT k.match_id, k.segment_num, (SELECT count(*) FROM i WHERE i.match_id = k.match_id AND i.segment_num = k.segment_num) AS n_in,
        (SELECT count(*) FROM o WHERE o.match_id = k.match_id AND o.segment_num = k.segment_num) AS n_out
      FROM k JOIN h USING (match_id) WHERE k.segment_num > lo AND k.segment_num <= hi""",
    "xg_quality": f"SELECT *, zero_xg_pct >= 20 AS is_bad FROM ({_QUALITY})",
    "segments_after_xg_filter": f"""
      SELECT league, season_end_year, n_segments FROM ({_QUALITY}) WHERE zero_xg_pct < 62""",
    "feed_lineups": f"""
      SELECT match_id, team, team = 'O' AS is_home, count(*) AS n, CAST(sum(o) AS DOUBLE) AS sum_on, sum(greatest(f, o + m)) AS sum_off FROM ({_FEED}) GROUP BY ALL""",
    "feed_results": f"""
      WITH r AS (SELECT match_id, min(team) FILTER (team = 'O') AS home_team, min(team) FILTER (team <> 'O') AS away_team,
        CAST(min(CAST(l_shipdate AS DATE)) AS VARCHAR) AS match_date, min(CAST(l_shipdate AS DATE)) AS d FROM ({_FEED}) WHERE st GROUP BY match_id)
      SELECT match_id, home_team, away_team, CASE WHEN home_team IS NOT NULL THEN 1 END AS home_team_id, CASE WHEN away_team IS NOT NULL THEN 0 END AS away_team_id, match_date,
        CASE WHEN month(d) <= 7 THEN (year(d) - 1) || '-' || year(d) ELSE year(d) || '-' || (year(d) + 1) END AS season FROM r""",
    "feed_events": f"""
      SELECT match_id, is_home, round(sum(added * 15 / 60), 6) AS added, count(*) FILTER (event_type = 'goal') AS goals, count(*) FILTER (event_type = 'substitution') AS subs,
        count(*) FILTER (event_type IN ('red_card', 'other')) AS reds FROM ({EVENTS}) GROUP BY ALL""",
    "feed_shots": f"""
      SELECT match_id, team, CAST(sum(CAST(xg > 0.3 AS INT)) AS DOUBLE) AS xg, count(*) FILTER (is_penalty) AS penalties FROM ({SHOTS}) GROUP BY ALL""",
}

QUERIES = {name: globals()[name] for name in ORACLES}
