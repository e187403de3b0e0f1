"""Queries over event streams: actions, chains, labels, values and credit."""

from pyspark.sql import functions as F

from touchline.operators import actions as A, chains as C, credit as K, passes as P, shots as S, value as V
from touchline.operators.ordering import hot_groups
from touchline.queries.roles import ACTIONS, MATCH_EVENTS, actions, match_events, rounded, table

GAP = 3  # the test clock ticks in quarter days
KEY = ("match_id",)


def _hot(df):
    return hot_groups(df, KEY)


def _hot_users(spark, folder):
    """Hot matches found on the source's key column alone."""
    return hot_groups(table(spark, folder, "events").select(F.col("user_id").alias("match_id")), KEY)


def _chained(spark, folder, hot):
    return C.possession_chains(actions(spark, folder), gap_seconds=GAP, hot=hot)


def possession_chains(spark, folder):
    df = _chained(spark, folder, _hot_users(spark, folder))
    return df.select(
        "match_id", "action_id", "chain_id", "chain_team_id", "action_in_chain", "chain_start_time"
    )


def chain_outcomes(spark, folder):
    return rounded(C.chain_outcomes(_chained(spark, folder, _hot_users(spark, folder))))


def next_chain_goals(spark, folder):
    hot = _hot_users(spark, folder)
    out = C.with_next_chain_goal(C.chain_outcomes(_chained(spark, folder, hot)), hot=hot)
    return out.select("match_id", "chain_id", "outcome", "ends_in_goal", "next_opponent_chain_goal")


def labelled_actions(spark, folder):
    hot = _hot_users(spark, folder)
    chained = _chained(spark, folder, hot)
    out = C.label_actions(chained, C.with_next_chain_goal(C.chain_outcomes(chained), hot=hot))
    return rounded(
        out.select(
            "match_id", "action_id", "chain_id", "chain_ends_in_goal", "chain_xg",
            "opponent_scores_next", "chain_outcome", "chain_ends_in_shot",
        )
    )


def possession_labels(spark, folder):
    hot = _hot_users(spark, folder)
    chained = _chained(spark, folder, hot)
    out = C.label_actions(chained, C.with_next_chain_goal(C.chain_outcomes(chained), hot=hot))
    return V.possession_labels(out)


def chain_stats(spark, folder):
    return rounded(C.chain_stats(C.chain_outcomes(_chained(spark, folder, _hot_users(spark, folder)))))


def chain_outcome_shares(spark, folder):
    return rounded(C.outcome_shares(C.chain_outcomes(_chained(spark, folder, _hot_users(spark, folder)))))


def possession_velocity(spark, folder):
    out = C.with_possession_velocity(_chained(spark, folder, _hot_users(spark, folder)))
    return rounded(
        out.select("match_id", "action_id", "x_progression", "chain_duration", "possession_velocity")
    )


def action_conversion(spark, folder):
    out = A.to_actions(match_events(spark, folder), hot=_hot_users(spark, folder))
    return rounded(
        out.select(
            "match_id", "action_id", "period_id", "time_seconds", "team_id", "player_id", "start_x",
            "start_y", "end_x", "end_y", "action_type", "action_type_id", "type_id", "type_name", "result",
            "bodypart", "receiver_player_id", "possession_change", "opponent_player_id", "is_own_goal",
        )
    )


def action_conversion_mirrored(spark, folder):
    out = A.to_actions(match_events(spark, folder), normalize=True, hot=_hot_users(spark, folder))
    return out.groupBy("match_id", "period_id", "team_id").agg(
        F.count(F.lit(1)).alias("n_actions"),
        F.round(F.sum("start_x"), 6).alias("sum_x"),
        F.round(F.sum("end_y"), 6).alias("sum_end_y"),
    )


def qualifier_flags(spark, folder):
    out = A.with_qualifier_flags(match_events(spark, folder))
    flags = [F.count_if(F.col(c)).alias(c) for c in A.QUALIFIER_FLAGS]
    return out.groupBy("type_id").agg(F.count(F.lit(1)).alias("n_events"), *flags)


def code_names(spark, folder):
    e = match_events(spark, folder)
    out = e.select("type_id", A.action_type().alias("action_type"), A.body_part().alias("bodypart"))
    return out.groupBy("type_id", "action_type", "bodypart").agg(F.count(F.lit(1)).alias("n_events"))


def discontinuity(spark, folder):
    out = A.physical_discontinuity(actions(spark, folder), hot=_hot_users(spark, folder))
    return rounded(out.select("match_id", "action_id", "phys_end_x", "phys_next_y", "phys_disc"))


def location_features(spark, folder):
    from touchline.functions import geometry as G

    a = actions(spark, folder)
    out = a.select("action_id", "start_x", "start_y").withColumns(G.location_features("start_x", "start_y"))
    out = out.withColumns(
        {
            "pitch_zone": G.pitch_zone("start_x", "start_y"),
            "own_box": G.in_penalty_area("start_x", "start_y", attacking=False),
            "own_third": G.in_final_third("start_x", attacking=False),
            "simple_xg": G.simple_xg("start_x", "start_y"),
        }
    )
    return rounded(out.drop("start_x", "start_y"))


def action_features(spark, folder):
    hot = _hot_users(spark, folder)
    out = V.action_features(_chained(spark, folder, hot), n_prev=3, hot=hot)
    return rounded(
        out.select(
            "match_id", "action_id", "distance_to_goal", "angle_to_goal", "zone_id", "dx", "dist_delta",
            "is_shot", "is_head", "seconds_since_chain_start", "time_normalized", "result_success_prev1",
            "dx_prev1", "dy_prev2", "dx_prev3", "same_team_prev1", "same_team_prev3", "is_pass_prev1",
            "is_shot_prev2", "is_tackle_prev3",
        )
    )


def standardized_features(spark, folder):
    out = V.standardize(actions(spark, folder), ["start_x", "start_y", "xg"])
    return rounded(out.select("match_id", "action_id", "start_x", "start_y", "xg"))


def next_goal_labels(spark, folder):
    out = V.next_goal_labels(actions(spark, folder), hot=_hot_users(spark, folder))
    return out.select("match_id", "action_id", "next_goal_label")


def next_xg_labels(spark, folder):
    a = actions(spark, folder)
    xg = a.where(F.col("action_type") == "shot").select("match_id", "action_id", "xg")
    out = V.next_xg_labels(a.drop("xg"), xg, hot=_hot_users(spark, folder))
    return rounded(out.select("match_id", "action_id", "next_xg_label"))


def _valued(spark, folder, hot):
    a = actions(spark, folder).withColumns(
        {
            "p_team_scores": F.col("start_x") / 253.0,
            "p_opponent_scores": (100.0 - F.col("start_x")) / 407.0,
            "is_own_goal": F.col("player_id") % 11 == 0,
        }
    )
    return V.action_values(a, hot=hot)


def action_values(spark, folder):
    out = _valued(spark, folder, _hot_users(spark, folder))
    return rounded(out.select("match_id", "action_id", "epv", "epv_model", "epv_delta", "possession_change"))


def value_summary(spark, folder):
    return rounded(V.value_summary(_valued(spark, folder, _hot_users(spark, folder))))


def _credited(spark, folder):
    hot = _hot_users(spark, folder)
    a = _valued(spark, folder, hot)

    def receivers(df, order):
        return order.shift(
            df,
            {
                "receiver_player_id": ("player_id", -1),
                "receiver_player_name": ("player_name", -1),
                "receiver_team_id": ("team_id", -1),
            },
        )

    from touchline.operators.ordering import split_hot

    a = split_hot(a, A.ACTION_ID_ORDER, receivers, hot=hot)
    duel = F.col("action_type") == "aerial"
    a = a.withColumns(
        {
            "xpass": F.when(F.col("action_type") == "pass", F.col("end_x") / 200.0 + 0.3),
            "opponent_player_id": F.when(duel, (F.col("player_id") + 1) % 100),
            "opponent_player_name": F.when(duel, F.concat(F.lit("P"), (F.col("player_id") + 1) % 100)),
        }
    )
    return K.assign_credit(a, hot=hot)


def credit_assignment(spark, folder):
    out = _credited(spark, folder)
    return rounded(
        out.select("match_id", "action_id", "player_credit", "receiver_credit", "opponent_credit")
    )


def _lineups(spark, folder):
    """Appearances: every player seen in a match, minutes from the first event's value."""
    a = actions(spark, folder)
    return a.groupBy("match_id", "player_id", "player_name", "team_id").agg(
        (F.min("action_id") % 91).alias("minutes_played"),
        F.concat(F.lit("T"), F.col("team_id")).alias("team_name"),
    )


LINEUPS = f"""
  SELECT match_id, player_id, player_name, team_id, min(action_id) % 91 AS minutes_played,
    'T' || team_id AS team_name
  FROM ({ACTIONS}) GROUP BY ALL
"""


def player_values(spark, folder):
    out = K.player_values(_credited(spark, folder), _lineups(spark, folder), min_minutes=450)
    return rounded(
        out.select(
            "player_id", "player_name", "team_id", "n_actions", "epv_as_actor", "epv_as_receiver",
            "epv_duel_blame", "epv_total", "epv_passing", "epv_defending", "total_minutes", "epv_total_p90",
        ),
        4,
    )


def action_type_values(spark, folder):
    return rounded(K.action_type_values(_credited(spark, folder)), 4)


def pass_credit_split(spark, folder):
    a = actions(spark, folder).where(F.col("action_type") == "pass")
    passer, receiver = K.split_pass_credit(F.col("start_x") / 100.0, F.col("end_x") / 100.0)
    return rounded(a.select("action_id", passer.alias("passer_credit"), receiver.alias("receiver_credit")))


def pass_features(spark, folder):
    out = P.pass_features(actions(spark, folder))
    return rounded(out.drop("player_name", "team_id", "player_id", "start_x", "start_y", "end_x", "end_y"))


def _shot_events(spark, folder):
    e = match_events(spark, folder).where(F.col("type_id").between(13, 16))
    return e.withColumns(
        {
            "is_goal": F.col("type_id") == 16,
            "body_part": F.when(F.col("player_id") % 3 == 0, "Head").when(F.col("player_id") % 3 == 1, "RightFoot").otherwise("LeftFoot"),
            "situation": F.when(F.col("player_id") % 5 == 0, "Penalty").when(F.col("player_id") % 5 == 1, "SetPiece").otherwise("OpenPlay"),
            "big_chance": F.col("player_id") % 9 == 0,
        }
    )


def shot_features(spark, folder):
    out = S.shot_features(_shot_events(spark, folder))
    return rounded(
        out.select(
            "match_id", "event_id", "distance_to_goal", "angle_to_goal", "in_penalty_area", "in_six_yard_box",
            "is_header", "is_right_foot", "is_left_foot", "is_open_play", "is_set_piece", "is_corner",
            "is_penalty", "is_direct_freekick", "is_big_chance", "shot_saved", "shot_post", "shot_miss", "is_goal",
        )
    )


def shot_coordinate_check(spark, folder):
    return S.coordinate_warnings(_shot_events(spark, folder).withColumn("x", F.col("x") * 1.05))


def _scored_shots(spark, folder):
    a = actions(spark, folder).where(F.col("action_type") == "shot")
    return a.select("xg", (F.col("result") == "success").cast("int").alias("is_goal"))


def xg_calibration(spark, folder):
    return rounded(S.calibration(_scored_shots(spark, folder), "is_goal", "xg", 10))


def xg_validation(spark, folder):
    return rounded(S.validate_xg(_scored_shots(spark, folder)))


def penalty_flags(spark, folder):
    e = match_events(spark, folder).withColumn(
        "qualifier_json", F.when(F.col("player_id") % 4 == 0, '{"9": null, "28": "x"}').otherwise('{"19": null}')
    )
    out = S.with_penalty_xg(S.flag_penalties(actions(spark, folder), e))
    return rounded(out.select("match_id", "action_id", "is_penalty", "xg"))


def expected_assists(spark, folder):
    out = S.derive_assists(actions(spark, folder), hot=_hot_users(spark, folder))
    return rounded(out.select("match_id", "action_id", "xa", "is_key_pass", "is_assist"))


def player_shooting(spark, folder):
    hot = _hot_users(spark, folder)
    a = S.derive_assists(actions(spark, folder), hot=hot)
    a = a.withColumn("xpass", F.when(F.col("action_type") == "pass", F.col("end_x") / 200.0 + 0.3))
    a = a.withColumn("is_penalty", F.when(F.col("player_id") % 5 == 0, 1).otherwise(0))
    out = S.player_shooting(a, _lineups(spark, folder), min_minutes=100)
    return rounded(
        out.select(
            "player_id", "team_id", "minutes", "shots", "shots_on_target", "goals", "penalty_goals", "npgoals",
            "xg", "npxg", "key_passes", "assists", "xa", "passes_attempted", "passes_completed", "sum_xpass",
            "xpass_overperformance", "goals_minus_xg",
        ),
        4,
    )


def _named_shots(spark, folder):
    a = actions(spark, folder).withColumn("is_penalty", F.col("player_id") % 5 == 0)
    return S.stream_shots(a, _lineups(spark, folder))


def stream_shots(spark, folder):
    return rounded(_named_shots(spark, folder))


def match_xg(spark, folder):
    home = (
        _lineups(spark, folder).where(F.col("team_id") == 0).select("match_id", F.col("team_name").alias("home_team"))
    ).distinct()
    return rounded(S.match_xg(_named_shots(spark, folder), home))


_W = "OVER (PARTITION BY match_id ORDER BY period_id, time_seconds, action_id)"
CHAINED = f"""
  SELECT * EXCLUDE (brk, pt, pp, ptime, ptype, pres), team_id AS chain_team_id,
    row_number() OVER (PARTITION BY match_id, chain_id ORDER BY period_id, time_seconds, action_id) AS action_in_chain,
    first_value(time_seconds) OVER (PARTITION BY match_id, chain_id ORDER BY period_id, time_seconds, action_id) AS chain_start_time
  FROM (SELECT *, CAST(sum(brk) OVER (PARTITION BY match_id ORDER BY period_id, time_seconds, action_id
                       ROWS UNBOUNDED PRECEDING) AS BIGINT) AS chain_id
    FROM (SELECT *, CASE WHEN pt IS NULL OR team_id <> pt OR period_id <> pp OR (ptype = 'shot' AND pres = 'success')
                          OR ptype = 'foul' OR time_seconds - ptime > {GAP} THEN 1 ELSE 0 END AS brk
      FROM (SELECT *, lag(team_id) {_W} AS pt, lag(period_id) {_W} AS pp, lag(time_seconds) {_W} AS ptime,
              lag(action_type) {_W} AS ptype, lag(result) {_W} AS pres FROM ({ACTIONS}))))
"""
OUTCOMES = f"""
  SELECT * EXCLUDE (lt, lr), CAST(outcome = 'goal' AS INT) AS ends_in_goal
  FROM (SELECT *, CASE WHEN lt = 'clearance' THEN 'out_of_play' WHEN lt = 'foul' THEN 'foul'
          WHEN lt = 'shot' AND lr = 'success' THEN 'goal' WHEN shots_in_chain > 0 THEN 'shot' ELSE 'turnover' END AS outcome
    FROM (SELECT match_id, chain_id, any_value(team_id) AS team_id, min(time_seconds) AS chain_start_time,
            arg_max(time_seconds, action_in_chain) AS chain_end_time, count(*) AS n_actions,
            arg_max(action_type, action_in_chain) AS lt, arg_max(result, action_in_chain) AS lr,
            count(*) FILTER (action_type = 'shot') AS shots_in_chain, sum(xg) AS chain_xg
          FROM ({CHAINED}) GROUP BY match_id, chain_id))
"""
_NC = "OVER (PARTITION BY match_id ORDER BY chain_start_time, chain_id)"
NEXT = f"""
  SELECT *, CASE WHEN lead(team_id) {_NC} <> team_id AND lead(ends_in_goal) {_NC} = 1 THEN 1 ELSE 0 END AS next_opponent_chain_goal
  FROM ({OUTCOMES})
"""
_AW = "OVER (PARTITION BY match_id ORDER BY action_id)"
_TYPES = "13 THEN 'Miss' WHEN 14 THEN 'Post' WHEN 15 THEN 'Attempt Saved' WHEN 16 THEN 'Goal' WHEN 1 THEN 'Pass' WHEN 4 THEN 'Foul' WHEN 3 THEN 'Take On' WHEN 44 THEN 'Aerial' WHEN 12 THEN 'Clearance' WHEN 7 THEN 'Tackle'"
_NAME = "CASE WHEN type_id = 1 THEN 'pass' WHEN type_id = 44 THEN 'aerial' WHEN type_id BETWEEN 13 AND 16 THEN 'shot' WHEN type_id = 4 THEN 'foul' WHEN type_id = 3 THEN 'take_on' WHEN type_id = 12 THEN 'clearance' WHEN type_id = 7 THEN 'tackle' ELSE 'other' END"


def _converted(mirrored: bool) -> str:
    typed = f"""
      SELECT match_id, event_id, period_id, CAST(minute * 60 + second AS BIGINT) AS time_seconds, team_id, player_id,
        x AS start_x, y AS start_y, type_id, {_NAME} AS action_type,
        CASE WHEN type_id NOT IN (1, 13, 14, 15, 16) AND end_x = 0 THEN x ELSE end_x END AS end_x,
        CASE WHEN type_id NOT IN (1, 13, 14, 15, 16) AND end_x = 0 THEN y ELSE end_y END AS end_y,
        CASE WHEN type_id IN (13, 14, 15) THEN 'fail' WHEN type_id = 16 THEN 'success'
             WHEN outcome = 1 THEN 'success' ELSE 'fail' END AS result,
        CASE WHEN type_id = 44 THEN 'head' ELSE 'foot' END AS bodypart, player_id = 28 AS is_own_goal
      FROM ({MATCH_EVENTS}) WHERE player_name <> '' AND type_id <> 5"""
    if mirrored:
        flip = "avg(start_x) OVER (PARTITION BY match_id, period_id, team_id) <= 50"
        typed = f"""SELECT * EXCLUDE (start_x, start_y, end_x, end_y, f),
            CASE WHEN f THEN 100 - start_x ELSE start_x END AS start_x, CASE WHEN f THEN 100 - start_y ELSE start_y END AS start_y,
            CASE WHEN f THEN 100 - end_x ELSE end_x END AS end_x, CASE WHEN f THEN 100 - end_y ELSE end_y END AS end_y
          FROM (SELECT *, {flip} AS f FROM ({typed}))"""
    o = "PARTITION BY match_id ORDER BY period_id, time_seconds, event_id"
    n = lambda c: f"lead({c}) OVER ({o})"
    return f"""
      WITH t AS (SELECT * EXCLUDE (end_x, end_y), CASE WHEN action_type = 'shot' THEN 100.0 ELSE end_x END AS end_x,
                   CASE WHEN action_type = 'shot' THEN 50.0 ELSE end_y END AS end_y FROM ({typed})),
      p AS (SELECT *, {n('period_id')} = period_id AND {n('team_id')} <> team_id AS rival, {n('action_type')} AS na,
              {n('result')} AS nr, abs({n('time_seconds')} - time_seconds) AS gap, abs(start_x + {n('start_x')} - 100) AS mir FROM t),
      q AS (SELECT *, coalesce(rival AND action_type IN ('aerial', 'tackle') AND action_type = na AND gap = 0, false) AS same_kind,
              coalesce(rival AND gap <= 1 AND mir < 2 AND (action_type = 'take_on' AND na = 'tackle' OR action_type = 'foul' AND na = 'foul'), false) AS cross_kind FROM p),
      r AS (SELECT *, (same_kind OR cross_kind) AND (result = 'success' OR nr <> 'success') AS fw,
              ((same_kind OR cross_kind) AND result = 'fail' AND nr = 'success')
              OR (cross_kind AND action_type = 'take_on' AND result = nr) AS sw FROM q),
      s AS (SELECT *, coalesce(lag(fw) OVER ({o}), false) AS pf, coalesce(lag(sw) OVER ({o}), false) AS ps FROM r),
      u AS (SELECT *, ps OR (NOT sw AND fw) AS wins, NOT ps AND (sw OR pf) AS loses FROM s),
      v AS (SELECT *, CASE WHEN wins AND coalesce(lag(loses) OVER ({o}), false) THEN lag(player_id) OVER ({o})
                           WHEN wins AND coalesce({n('loses')}, false) THEN {n('player_id')} END AS opponent_player_id FROM u),
      w AS (SELECT * FROM v WHERE NOT loses),
      l AS (SELECT list_sort(list(DISTINCT action_type)) AS levels FROM t)
      SELECT match_id, row_number() OVER ({o}) AS action_id, period_id, time_seconds, team_id, player_id, start_x, start_y,
        end_x, end_y, action_type, list_position(levels, action_type) AS action_type_id, type_id,
        CASE type_id WHEN {_TYPES} END AS type_name, result, bodypart, {n('player_id')} AS receiver_player_id,
        coalesce({n('team_id')} <> team_id, false) AS possession_change, opponent_player_id, is_own_goal
      FROM w, l"""


_VALUED_IN = f"""
  SELECT *, start_x / 253.0 - (100.0 - start_x) / 407.0 AS st, CASE WHEN action_type = 'shot' THEN xg
    ELSE start_x / 253.0 - (100.0 - start_x) / 407.0 END AS epv FROM ({ACTIONS})
"""
VALUED = f"""
  SELECT * EXCLUDE (nt, ns, ne, na), coalesce(nt <> team_id, false) AS possession_change,
    CASE WHEN action_type = 'shot' THEN st END AS epv_model,
    CASE WHEN na = 'shot' THEN CASE WHEN nt = team_id THEN ne - epv ELSE -ne - epv END
         WHEN action_type = 'shot' AND result = 'fail' THEN -epv
         WHEN action_type = 'shot' AND result = 'success' AND player_id % 11 = 0 THEN -1 - epv
         WHEN action_type = 'shot' AND result = 'success' THEN 1 - epv
         WHEN nt IS NULL THEN 0 WHEN nt = team_id THEN ns - st ELSE -ns - st END AS epv_delta
  FROM (SELECT *, lead(team_id) {_AW} AS nt, lead(st) {_AW} AS ns, lead(epv) {_AW} AS ne, lead(action_type) {_AW} AS na
        FROM ({_VALUED_IN}))
"""
CREDITED = f"""
  WITH a AS (SELECT *, lead(player_id) {_AW} AS rp, 'P' || lead(player_id) {_AW} AS rn0, lead(player_name) {_AW} AS rn,
               lead(team_id) {_AW} AS rt, coalesce(lead(period_id) {_AW} = period_id, true) AS same_period,
               end_x / 200.0 + 0.3 AS xp, least(1.0, 0.3 + 0.7 * (100 - start_x) / 40) AS ramp,
               least(1.0, 0.6 + 0.4 * (100 - start_x) / 40) AS framp,
               CASE WHEN start_x > 80 THEN 0.5 ELSE 1 END AS deep, epv_delta AS d FROM ({VALUED})),
  b AS (SELECT *, CASE
        WHEN action_type = 'pass' AND (result = 'fail' OR possession_change) AND same_period THEN
          CASE WHEN d < 0 THEN d * (0.5 + 0.3 * xp) * framp * deep ELSE d END
        WHEN action_type = 'pass' AND result = 'success' AND NOT possession_change THEN
          CASE WHEN d >= 0 THEN d * (0.5 + 0.3 * (1 - xp)) * ramp ELSE d * ramp * 0.2 END
        WHEN action_type = 'shot' AND type_id IN (14, 15) THEN d
        WHEN action_type = 'shot' AND type_id = 13 AND rt <> team_id THEN d * 0.5
        WHEN possession_change AND NOT (action_type = 'shot' AND result = 'success') AND same_period AND d < 0 THEN d * 0.5
        ELSE d END AS pc,
      CASE
        WHEN action_type = 'pass' AND (result = 'fail' OR possession_change) AND same_period THEN
          CASE WHEN d < 0 THEN -d * (0.5 - 0.3 * xp) * framp * deep ELSE 0 END
        WHEN action_type = 'pass' AND result = 'success' AND NOT possession_change THEN
          CASE WHEN d >= 0 THEN d * (0.2 + 0.3 * xp) * ramp ELSE 0 END
        WHEN action_type = 'shot' AND type_id IN (14, 15) THEN 0
        WHEN action_type = 'shot' AND type_id = 13 AND rt <> team_id THEN -d * 0.5
        WHEN possession_change AND NOT (action_type = 'shot' AND result = 'success') AND same_period AND d < 0 THEN -d * 0.5
        ELSE 0 END AS receiver_credit FROM a)
  SELECT *, CASE WHEN action_type = 'aerial' THEN d * 0.5
      WHEN action_type IN ('clearance', 'interception', 'tackle') THEN pc * 1.5
      WHEN action_type = 'take_on' AND start_x > 60 THEN pc * ramp ELSE pc END AS player_credit,
    CASE WHEN action_type = 'aerial' THEN -d * 0.5 END AS opponent_credit,
    CASE WHEN action_type = 'aerial' THEN (player_id + 1) % 100 END AS op,
    CASE WHEN action_type = 'aerial' THEN 'P' || ((player_id + 1) % 100) END AS opn
  FROM b
"""
_SHOTS = f"""SELECT xg, CAST(result = 'success' AS INT) AS is_goal FROM ({ACTIONS}) WHERE action_type = 'shot'"""
_ASSISTS = f"""
  SELECT *, CASE WHEN kp THEN nx ELSE 0 END AS xa, CAST(kp AS INT) AS is_key_pass, CAST(kp AND nr = 'success' AS INT) AS is_assist
  FROM (SELECT *, coalesce(lead(action_type) {_W.replace('PARTITION BY match_id', 'PARTITION BY match_id, period_id')} = 'shot'
            AND action_type = 'pass' AND result = 'success'
            AND lead(team_id) {_W.replace('PARTITION BY match_id', 'PARTITION BY match_id, period_id')} = team_id
            AND lead(player_id) {_W.replace('PARTITION BY match_id', 'PARTITION BY match_id, period_id')} <> player_id, false) AS kp,
          lead(xg) {_W.replace('PARTITION BY match_id', 'PARTITION BY match_id, period_id')} AS nx,
          lead(result) {_W.replace('PARTITION BY match_id', 'PARTITION BY match_id, period_id')} AS nr FROM ({ACTIONS}))
"""
_STREAM_SHOTS = f"""
  SELECT match_id, CAST(time_seconds // 60 AS DOUBLE) AS minute, 'T' || team_id AS team, player_id, player_name,
    round(xg, 6) AS xg, result = 'success' AS is_goal, player_id % 5 = 0 AS is_penalty
  FROM ({ACTIONS}) WHERE action_type = 'shot'
"""
_GX = "sqrt((100 - start_x) ** 2 + (50 - start_y) ** 2)"
_ANGLE = lambda x, y: f"abs(atan2(56 - {y}, greatest(100 - {x}, 0.1)) - atan2(44 - {y}, greatest(100 - {x}, 0.1)))"
_ZONE = lambda x, y: f"CAST(greatest(least(floor({x} / 33.34), 2), 0) * 3 + greatest(least(floor({y} / 33.34), 2), 0) + 1 AS INT)"

ORACLES = {
    "possession_chains": f"SELECT match_id, action_id, chain_id, chain_team_id, action_in_chain, chain_start_time FROM ({CHAINED})",
    "chain_outcomes": f"SELECT * REPLACE (round(chain_xg, 6) AS chain_xg) FROM ({OUTCOMES})",
    "next_chain_goals": f"SELECT match_id, chain_id, outcome, ends_in_goal, next_opponent_chain_goal FROM ({NEXT})",
    "labelled_actions": f"""
      SELECT c.match_id, c.action_id, c.chain_id, n.ends_in_goal AS chain_ends_in_goal, round(n.chain_xg, 6) AS chain_xg,
        n.next_opponent_chain_goal AS opponent_scores_next, n.outcome AS chain_outcome,
        CAST(n.outcome IN ('goal', 'shot') AS INT) AS chain_ends_in_shot
      FROM ({CHAINED}) c JOIN ({NEXT}) n USING (match_id, chain_id)""",
    "possession_labels": f"""
      SELECT c.match_id, c.action_id, n.ends_in_goal AS scores_this_possession,
        n.next_opponent_chain_goal AS concedes_next_possession
      FROM ({CHAINED}) c JOIN ({NEXT}) n USING (match_id, chain_id)""",
    "chain_stats": f"""
      SELECT count(*) AS total_chains, count(*) FILTER (shots_in_chain > 0) AS chains_with_shots,
        CAST(sum(ends_in_goal) AS BIGINT) AS chains_with_goals, round(avg(n_actions), 6) AS mean_actions_per_chain,
        round(median(n_actions), 6) AS median_actions_per_chain, round(avg(chain_end_time - chain_start_time), 6) AS mean_duration,
        round(avg(ends_in_goal), 6) AS goal_rate, round(avg(CAST(shots_in_chain > 0 AS INT)), 6) AS shot_rate FROM ({OUTCOMES})""",
    "chain_outcome_shares": f"""
      SELECT outcome, count(*) AS n_chains, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM ({OUTCOMES}) GROUP BY outcome""",
    "possession_velocity": f"""
      WITH v AS (SELECT match_id, chain_id, arg_max(start_x, action_in_chain) - arg_min(start_x, action_in_chain) AS x_progression,
                   arg_max(time_seconds, action_in_chain) - arg_min(time_seconds, action_in_chain) AS chain_duration
                 FROM ({CHAINED}) GROUP BY match_id, chain_id)
      SELECT c.match_id, c.action_id, round(v.x_progression, 6) AS x_progression, v.chain_duration,
        CASE WHEN v.chain_duration > 0 THEN round(v.x_progression / v.chain_duration, 6) ELSE 0 END AS possession_velocity
      FROM ({CHAINED}) c JOIN v USING (match_id, chain_id)""",
    "action_conversion": _converted(False),
    "action_conversion_mirrored": f"""
      SELECT match_id, period_id, team_id, count(*) AS n_actions, round(sum(start_x), 6) AS sum_x, round(sum(end_y), 6) AS sum_end_y
      FROM ({_converted(True)}) GROUP BY match_id, period_id, team_id""",
    "qualifier_flags": "SELECT type_id, count(*) AS n_events, "
    + ", ".join(f"count(*) FILTER (player_id = {key}) AS {name}" for name, key in A.QUALIFIER_FLAGS.items())
    + f" FROM ({MATCH_EVENTS}) GROUP BY type_id",
    "code_names": f"""
      SELECT type_id, {_NAME} AS action_type, CASE WHEN type_id = 44 THEN 'head' ELSE 'foot' END AS bodypart, count(*) AS n_events
      FROM ({MATCH_EVENTS}) GROUP BY ALL""",
    "discontinuity": f"""
      WITH f AS (SELECT match_id, first(team_id ORDER BY period_id, time_seconds, action_id) AS frame FROM ({ACTIONS}) GROUP BY match_id),
      n AS (SELECT *, lead(team_id) {_W} AS nt, lead(start_x) {_W} AS nx, lead(start_y) {_W} AS ny FROM ({ACTIONS})),
      p AS (SELECT match_id, action_id, CASE WHEN team_id = frame THEN end_x ELSE 100 - end_x END AS ex,
              CASE WHEN team_id = frame THEN end_y ELSE 100 - end_y END AS ey,
              CASE WHEN nt = frame THEN nx ELSE 100 - nx END AS px, CASE WHEN nt = frame THEN ny ELSE 100 - ny END AS py FROM n JOIN f USING (match_id))
      SELECT match_id, action_id, ex AS phys_end_x, py AS phys_next_y, round(sqrt((ex - px) ** 2 + (ey - py) ** 2), 6) AS phys_disc FROM p""",
    "location_features": f"""
      SELECT action_id, start_x AS x, start_y AS y, round({_GX}, 6) AS distance_to_goal, round({_ANGLE('start_x', 'start_y')}, 6) AS angle_to_goal,
        {_ZONE('start_x', 'start_y')} AS zone_id, CAST(start_x > 83 AND start_y > 21 AND start_y < 79 AS INT) AS in_penalty_area,
        CAST(start_x > 67 AS INT) AS in_final_third, CAST(start_x < 33 AS INT) AS in_own_third,
        CAST(start_x >= 33 AND start_x < 67 AS INT) AS in_mid_third, CAST(start_y < 33 AS INT) AS y_left,
        CAST(start_y >= 33 AND start_y < 67 AS INT) AS y_center, CAST(start_y >= 67 AS INT) AS y_right,
        (CASE WHEN start_x <= 33 THEN 0 WHEN start_x <= 67 THEN 1 ELSE 2 END) * 3 + (CASE WHEN start_y <= 33 THEN 0 WHEN start_y <= 67 THEN 1 ELSE 2 END) + 1 AS pitch_zone,
        start_x < 17 AND start_y > 21 AND start_y < 79 AS own_box, start_x < 33 AS own_third,
        round(greatest(least(1 / (1 + exp(2.8 + 0.12 * {_GX} - 3.0 * abs(atan2(start_y - 44, 100 - start_x) - atan2(start_y - 56, 100 - start_x)))), 0.75), 0.01), 6) AS simple_xg
      FROM ({ACTIONS})""",
    "action_features": f"""
      WITH b AS (SELECT *, end_x - start_x AS dx, end_y - start_y AS dy, CAST(result = 'success' AS INT) AS ok FROM ({CHAINED}))
      SELECT match_id, action_id, round({_GX}, 6) AS distance_to_goal, round({_ANGLE('start_x', 'start_y')}, 6) AS angle_to_goal,
        {_ZONE('start_x', 'start_y')} AS zone_id, dx, round(sqrt((100 - end_x) ** 2 + (50 - end_y) ** 2) - {_GX}, 6) AS dist_delta,
        CAST(action_type = 'shot' AS INT) AS is_shot, CAST(bodypart = 'head' AS INT) AS is_head,
        time_seconds - chain_start_time AS seconds_since_chain_start, round(least(time_seconds / 2700.0, 1), 6) AS time_normalized,
        coalesce(lag(ok) {_W}, 0) AS result_success_prev1, coalesce(lag(dx) {_W}, 0) AS dx_prev1, coalesce(lag(dy, 2) {_W}, 0) AS dy_prev2,
        coalesce(lag(dx, 3) {_W}, 0) AS dx_prev3, coalesce(CAST(lag(team_id) {_W} = team_id AS INT), 0) AS same_team_prev1,
        coalesce(CAST(lag(team_id, 3) {_W} = team_id AS INT), 0) AS same_team_prev3,
        coalesce(CAST(lag(action_type) {_W} = 'pass' AS INT), 0) AS is_pass_prev1,
        coalesce(CAST(lag(action_type, 2) {_W} = 'shot' AS INT), 0) AS is_shot_prev2,
        coalesce(CAST(lag(action_type, 3) {_W} = 'tackle' AS INT), 0) AS is_tackle_prev3 FROM b""",
    "standardized_features": f"""
      SELECT match_id, action_id, round((start_x - avg(start_x) OVER ()) / stddev_samp(start_x) OVER (), 6) AS start_x,
        round((start_y - avg(start_y) OVER ()) / stddev_samp(start_y) OVER (), 6) AS start_y,
        round((xg - avg(xg) OVER ()) / stddev_samp(xg) OVER (), 6) AS xg FROM ({ACTIONS})""",
    "next_goal_labels": f"""
      WITH a AS ({ACTIONS}), g AS (SELECT * FROM a WHERE action_type = 'shot' AND result = 'success'),
      f AS (SELECT a.action_id, arg_min(g.team_id, g.time_seconds * 100000000 + g.action_id) AS nt
            FROM a JOIN g ON a.match_id = g.match_id AND a.period_id = g.period_id AND g.time_seconds > a.time_seconds GROUP BY a.action_id)
      SELECT a.match_id, a.action_id, CASE WHEN nt IS NULL THEN 2 WHEN nt = a.team_id THEN 0 ELSE 1 END AS next_goal_label
      FROM a LEFT JOIN f USING (action_id)""",
    "next_xg_labels": f"""
      WITH a AS ({ACTIONS}), g AS (SELECT * FROM a WHERE action_type = 'shot'),
      f AS (SELECT a.action_id, arg_min(g.team_id, g.time_seconds * 100000000 + g.action_id) AS nt,
              arg_min(g.xg, g.time_seconds * 100000000 + g.action_id) AS nx
            FROM a JOIN g ON a.match_id = g.match_id AND a.period_id = g.period_id AND g.time_seconds > a.time_seconds GROUP BY a.action_id)
      SELECT a.match_id, a.action_id, round(CASE WHEN nt IS NULL THEN 0 WHEN nt = a.team_id THEN nx ELSE -nx END, 6) AS next_xg_label
      FROM a LEFT JOIN f USING (action_id)""",
    "action_values": f"""
      SELECT match_id, action_id, round(epv, 6) AS epv, round(epv_model, 6) AS epv_model, round(epv_delta, 6) AS epv_delta, possession_change
      FROM ({VALUED})""",
    "value_summary": f"""
      SELECT count(*) AS total_actions, round(min(epv), 6) AS epv_min, round(max(epv), 6) AS epv_max, round(sum(epv_delta), 6) AS total_epv_delta,
        count(*) FILTER (action_type = 'shot' AND result = 'success') AS actual_goals, round(avg(epv), 6) AS mean_epv,
        round(avg(epv_delta), 6) AS mean_epv_delta, round(stddev_samp(epv_delta), 6) AS sd_epv_delta,
        count(DISTINCT match_id) AS n_matches, min(epv) >= -1.01 AND max(epv) <= 1.01 AS epv_bounded FROM ({VALUED})""",
    "credit_assignment": f"""
      SELECT match_id, action_id, round(player_credit, 6) + 0.0 AS player_credit, round(receiver_credit, 6) + 0.0 AS receiver_credit,
        round(opponent_credit, 6) + 0.0 AS opponent_credit FROM ({CREDITED})""",
    "player_values": f"""
      WITH c AS ({CREDITED}), act AS (SELECT player_id, player_name, team_id, sum(player_credit) AS a, count(*) AS n,
          sum(player_credit) FILTER (action_type = 'pass') AS ps,
          sum(player_credit) FILTER (action_type IN ('tackle', 'interception', 'clearance')) AS df FROM c GROUP BY ALL),
      rec AS (SELECT rp AS player_id, rn AS player_name, sum(receiver_credit) AS r FROM c WHERE rp IS NOT NULL GROUP BY ALL),
      opp AS (SELECT op AS player_id, opn AS player_name, sum(opponent_credit) AS o FROM c WHERE op IS NOT NULL GROUP BY ALL),
      j AS (SELECT player_id, player_name, team_id, coalesce(a, 0) AS a, coalesce(r, 0) AS r, coalesce(o, 0) AS o, coalesce(n, 0) AS n, coalesce(ps, 0) AS ps, coalesce(df, 0) AS df
            FROM act FULL JOIN rec USING (player_id, player_name) FULL JOIN opp USING (player_id, player_name)),
      m AS (SELECT player_id, player_name, CAST(sum(minutes_played) AS BIGINT) AS total_minutes FROM ({LINEUPS}) GROUP BY ALL)
      SELECT player_id, player_name, team_id, n AS n_actions, round(a, 4) AS epv_as_actor, round(r, 4) AS epv_as_receiver,
        round(o, 4) AS epv_duel_blame, round(a + r + o, 4) AS epv_total, round(ps, 4) AS epv_passing, round(df, 4) AS epv_defending,
        total_minutes, round((a + r + o) / (total_minutes / 90), 4) AS epv_total_p90
      FROM j JOIN m USING (player_id, player_name) WHERE total_minutes >= 450""",
    "action_type_values": f"""
      SELECT player_id, player_name, round(sum(player_credit) FILTER (action_type = 'pass'), 4) + 0.0 AS epv_passing,
        round(sum(player_credit) FILTER (action_type = 'shot'), 4) + 0.0 AS epv_shooting,
        round(sum(player_credit) FILTER (action_type = 'take_on'), 4) + 0.0 AS epv_dribbling,
        round(sum(player_credit) FILTER (action_type IN ('tackle', 'interception', 'clearance')), 4) + 0.0 AS epv_defending
      FROM ({CREDITED}) WHERE action_type IN ('pass', 'shot', 'take_on', 'tackle', 'interception', 'clearance') GROUP BY ALL""",
    "pass_credit_split": f"""
      SELECT action_id, round(start_x / 100 * (1 - greatest(least(end_x / 100, 0.95), 0.05)), 6) AS passer_credit,
        round(start_x / 100 * greatest(least(end_x / 100, 0.95), 0.05), 6) AS receiver_credit FROM ({ACTIONS}) WHERE action_type = 'pass'""",
    "pass_features": f"""
      WITH p AS (SELECT *, sqrt((end_x - start_x) ** 2 + (end_y - start_y) ** 2) AS len, end_x - start_x AS dx,
          start_x > 83 AND start_y > 21 AND start_y < 79 AS bs, end_x > 83 AND end_y > 21 AND end_y < 79 AS be,
          sqrt((100 - end_x) ** 2 + (50 - end_y) ** 2) AS da, {_GX} AS db FROM ({ACTIONS}) WHERE action_type = 'pass')
      SELECT match_id, action_id, round(len, 6) AS pass_distance, round(atan2(end_y - start_y, dx), 6) AS pass_angle,
        CAST(dx > 0 AS INT) AS is_forward, CAST(dx < -5 AS INT) AS is_backward, CAST(abs(dx) < 5 AS INT) AS is_lateral,
        CAST(da < db * 0.75 AS INT) AS is_progressive, {_ZONE('start_x', 'start_y')} AS start_zone, {_ZONE('end_x', 'end_y')} AS end_zone,
        CAST((start_x < 50) <> (end_x < 50) AS INT) AS crosses_midfield, CAST(NOT bs AND be AS INT) AS into_penalty_area,
        CAST(start_x <= 67 AND end_x > 67 AS INT) AS into_final_third, CAST(be AS INT) AS ends_in_box,
        CAST(start_x < 33 AS INT) AS start_in_own_third, CAST(start_x >= 33 AND start_x < 67 AS INT) AS start_in_mid_third,
        CAST(start_x >= 67 AS INT) AS start_in_final_third, round(da, 6) AS end_dist_to_goal,
        round(abs(atan2(end_y - 44, 100 - end_x) - atan2(end_y - 56, 100 - end_x)), 6) AS end_angle_to_goal,
        CAST(len < 15 AS INT) AS is_short_pass, CAST(len >= 15 AND len < 30 AS INT) AS is_medium_pass, CAST(len >= 30 AS INT) AS is_long_pass,
        CAST(bodypart = 'head' AS INT) AS is_headed_pass, CAST(result = 'success' AS INT) AS completed FROM p""",
    "shot_features": f"""
      SELECT match_id, event_id, round(sqrt((100 - x) ** 2 + (50 - y) ** 2), 6) AS distance_to_goal, round({_ANGLE('x', 'y')}, 6) AS angle_to_goal,
        CAST(x > 83 AND y > 21 AND y < 79 AS INT) AS in_penalty_area, CAST(x > 94 AND y > 37 AND y < 63 AS INT) AS in_six_yard_box,
        CAST(player_id % 3 = 0 AS INT) AS is_header, CAST(player_id % 3 = 1 AS INT) AS is_right_foot, CAST(player_id % 3 = 2 AS INT) AS is_left_foot,
        CAST(player_id % 5 > 1 AS INT) AS is_open_play, CAST(player_id % 5 = 1 AS INT) AS is_set_piece, 0 AS is_corner,
        CAST(player_id % 5 = 0 AS INT) AS is_penalty, 0 AS is_direct_freekick, CAST(player_id % 9 = 0 AS INT) AS is_big_chance,
        CAST(type_id = 13 AS INT) AS shot_saved, CAST(type_id = 14 AS INT) AS shot_post, CAST(type_id = 15 AS INT) AS shot_miss,
        CAST(type_id = 16 AS INT) AS is_goal FROM ({MATCH_EVENTS}) WHERE type_id BETWEEN 13 AND 16""",
    "shot_coordinate_check": f"""
      SELECT count(*) AS n_shots, count(*) FILTER (x * 1.05 > 100 OR x < 0 OR y < 0 OR y > 100) AS n_outside
      FROM ({MATCH_EVENTS}) WHERE type_id BETWEEN 13 AND 16""",
    "xg_calibration": f"""
      SELECT CAST(greatest(ceil(xg * 10), 1) AS INT) AS bin, round(avg(is_goal), 6) AS actual_rate, round(avg(xg), 6) AS predicted_rate, count(*) AS n_shots
      FROM ({_SHOTS}) GROUP BY 1""",
    "xg_validation": f"""
      WITH s AS ({_SHOTS}), b AS (SELECT greatest(ceil(xg * 10), 1) AS bin, avg(is_goal) AS ar, avg(xg) AS pr, count(*) AS n FROM s GROUP BY 1),
      r AS (SELECT *, rank() OVER (ORDER BY xg) + (count(*) OVER (PARTITION BY xg) - 1) / 2 AS rk FROM s)
      SELECT count(*) AS n_shots, CAST(sum(is_goal) AS BIGINT) AS n_goals, round(avg(is_goal), 6) AS goal_rate, round(avg(xg), 6) AS mean_xg,
        round(-avg(is_goal * ln(greatest(xg, 1e-15)) + (1 - is_goal) * ln(1 - xg)), 6) AS logloss, round(avg((xg - is_goal) ** 2), 6) AS brier_score,
        (SELECT round(sum(n * abs(ar - pr)) / sum(n), 6) FROM b) AS calibration_error,
        (SELECT round((sum(rk) FILTER (is_goal = 1) - sum(is_goal) * (sum(is_goal) + 1) / 2) / (sum(is_goal) * (count(*) - sum(is_goal))), 6) FROM r) AS auc
      FROM s""",
    "penalty_flags": f"""
      WITH p AS (SELECT DISTINCT match_id, player_id, CAST(minute * 60 + second AS BIGINT) AS t FROM ({MATCH_EVENTS}) WHERE type_id BETWEEN 13 AND 16 AND player_id % 4 = 0),
      a AS (SELECT a.*, a.action_type = 'shot' AND p.t IS NOT NULL AS pen FROM ({ACTIONS}) a LEFT JOIN p
            ON p.match_id = a.match_id AND p.player_id = a.player_id AND p.t = a.time_seconds)
      SELECT match_id, action_id, CAST(pen AS INT) AS is_penalty, round(CASE WHEN pen THEN 0.76 ELSE xg END, 6) AS xg FROM a""",
    "expected_assists": f"SELECT match_id, action_id, round(xa, 6) AS xa, is_key_pass, is_assist FROM ({_ASSISTS})",
    "player_shooting": f"""
      WITH l AS ({LINEUPS}), a AS (SELECT * FROM ({_ASSISTS}) WHERE (match_id, player_id) IN (SELECT (match_id, player_id) FROM l WHERE minutes_played > 0)),
      s AS (SELECT player_id, player_name, team_id, count(*) FILTER (action_type = 'shot') AS shots,
          count(*) FILTER (type_id IN (13, 16)) AS sot, count(*) FILTER (type_id = 16) AS goals,
          count(*) FILTER (type_id = 16 AND player_id % 5 = 0) AS pg, sum(xg) FILTER (action_type = 'shot') AS xg,
          sum(xg) FILTER (action_type = 'shot' AND player_id % 5 <> 0) AS npxg, sum(is_key_pass) AS kp, sum(is_assist) AS ast, sum(xa) AS xa,
          count(*) FILTER (action_type = 'pass') AS pa, count(*) FILTER (action_type = 'pass' AND result = 'success') AS pc,
          sum(end_x / 200.0 + 0.3) FILTER (action_type = 'pass') AS sx FROM a GROUP BY ALL),
      m AS (SELECT player_id, player_name, team_id, CAST(sum(minutes_played) AS BIGINT) AS minutes FROM l GROUP BY ALL)
      SELECT player_id, team_id, minutes, coalesce(shots, 0) AS shots, coalesce(sot, 0) AS shots_on_target, coalesce(goals, 0) AS goals,
        coalesce(pg, 0) AS penalty_goals, coalesce(goals - pg, 0) AS npgoals, round(coalesce(xg, 0), 4) AS xg, round(coalesce(npxg, 0), 4) AS npxg,
        CAST(coalesce(kp, 0) AS BIGINT) AS key_passes, CAST(coalesce(ast, 0) AS BIGINT) AS assists, round(coalesce(xa, 0), 4) AS xa,
        coalesce(pa, 0) AS passes_attempted, coalesce(pc, 0) AS passes_completed, round(coalesce(sx, 0), 4) AS sum_xpass,
        round(coalesce(pc, 0) - coalesce(sx, 0), 4) AS xpass_overperformance, round(coalesce(goals, 0) - coalesce(xg, 0), 4) AS goals_minus_xg
      FROM m LEFT JOIN s USING (player_id, player_name, team_id) WHERE minutes >= 100""",
    "stream_shots": _STREAM_SHOTS,
    "match_xg": f"""
      WITH s AS (SELECT match_id, 'T' || team_id AS team, xg, player_id % 5 = 0 AS pen FROM ({ACTIONS}) WHERE action_type = 'shot'),
      t AS (SELECT match_id, team, sum(xg) AS x, sum(xg) FILTER (NOT pen) AS nx FROM s GROUP BY ALL HAVING count(*) FILTER (NOT pen) > 0),
      h AS (SELECT DISTINCT match_id FROM ({ACTIONS}) WHERE team_id = 0)
      SELECT match_id, round(coalesce(sum(x) FILTER (team = 'T0'), 0), 6) AS home_xg, round(coalesce(sum(nx) FILTER (team = 'T0'), 0), 6) AS home_npxg,
        round(coalesce(sum(x) FILTER (team <> 'T0'), 0), 6) AS away_xg, round(coalesce(sum(nx) FILTER (team <> 'T0'), 0), 6) AS away_npxg
      FROM t JOIN h USING (match_id) GROUP BY match_id""",
}

QUERIES = {name: globals()[name] for name in ORACLES}
