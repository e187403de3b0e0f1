"""Queries over player box scores; parts are players, line items their match lines."""

from pyspark.sql import functions as F

from touchline.functions import names as N
from touchline.operators import boxscore as B, elastic_net as E, rates as R, views as V
from touchline.queries.roles import rounded, table
from touchline.session import cut_lineage, free_shuffles

# raw column of a source, by the expression over a line item that stands in for it
LINE_A = {
    "min": "l_quantity * 1.0137", "gls": "l_linenumber", "ast": "l_linenumber % 3", "sh": "l_suppkey % 6 + l_linenumber",
    "so_t": "l_suppkey % 4", "x_g": "sqrt(l_discount) * 2.1", "npx_g": "l_discount * 6.0171", "x_ag": "l_tax * 3.0119",
    "sca": "l_suppkey % 5", "gca": "l_suppkey % 3", "touches": "l_quantity * 2", "tkl": "l_suppkey % 8",
    "int": "l_linenumber % 4", "blocks": "l_suppkey % 2", "cmp": "l_suppkey % 30", "att": "l_suppkey % 30 + l_linenumber",
    "prg_p": "l_suppkey % 9", "carries": "l_linenumber * 2", "prg_c": "l_linenumber % 2", "kp": "l_suppkey % 3",
    "x1_3": "l_linenumber", "ppa": "l_linenumber % 5", "crs_pa": "l_suppkey % 2", "tkl_w": "l_suppkey % 4",
    "clr": "l_linenumber", "err": "l_suppkey % 2", "so_ta": "l_suppkey % 7", "saves": "l_suppkey % 5",
    "ga": "l_linenumber % 3", "mis": "l_linenumber % 3", "dis": "l_suppkey % 2", "won_aerial": "l_suppkey % 4",
    "lost_aerial": "l_linenumber % 4", "fls": "l_suppkey % 3", "fld": "l_linenumber % 2", "ps_xg": "l_tax * 5",
}
LINE_C = {
    "minsPlayed": "l_quantity * 1.0137", "goals": "l_linenumber % 3", "goalAssist": "l_linenumber % 2",
    "totalScoringAtt": "l_suppkey % 6", "ontargetScoringAtt": "l_suppkey % 3", "attemptsIbox": "l_suppkey % 4",
    "attemptsObox": "l_suppkey % 2", "bigChanceCreated": "l_suppkey % 2", "bigChanceScored": "l_linenumber % 2",
    "bigChanceMissed": "l_suppkey % 3", "totalPass": "l_suppkey % 40 + 5", "accuratePass": "l_suppkey % 40",
    "totalLongBalls": "l_suppkey % 7", "accurateLongBalls": "l_suppkey % 5", "totalCross": "l_linenumber",
    "accurateCross": "l_linenumber % 2", "totalThroughBall": "l_suppkey % 3", "accurateThroughBall": "l_suppkey % 2",
    "totalAttAssist": "l_linenumber % 4", "successfulFinalThirdPasses": "l_suppkey % 11", "totalTackle": "l_suppkey % 5",
    "wonTackle": "l_suppkey % 3", "interception": "l_linenumber % 4", "outfielderBlock": "l_suppkey % 2",
    "totalClearance": "l_linenumber", "ballRecovery": "l_suppkey % 6", "duelWon": "l_suppkey % 7",
    "duelLost": "l_linenumber % 5", "aerialWon": "l_suppkey % 4", "aerialLost": "l_linenumber % 3",
    "possWonDef3rd": "l_suppkey % 3", "possWonMid3rd": "l_linenumber % 3", "possWonAtt3rd": "l_suppkey % 2",
    "touches": "l_quantity * 2", "touchesInFinalThird": "l_suppkey % 13", "touchesInOppBox": "l_suppkey % 4",
    "carries": "l_linenumber * 3", "progressiveCarries": "l_linenumber % 3", "finalThirdEntries": "l_suppkey % 5",
    "penAreaEntries": "l_suppkey % 3", "dispossessed": "l_linenumber % 2", "turnover": "l_suppkey % 3",
    "timesTackled": "l_suppkey % 2", "saves": "l_suppkey % 6", "savedIbox": "l_suppkey % 4", "savedObox": "l_suppkey % 2",
    "goalsConceded": "l_linenumber % 4", "goalsConcededIbox": "l_linenumber % 2", "attemptsConcededIbox": "l_suppkey % 5",
    "attemptsConcededObox": "l_suppkey % 3", "cleanSheet": "l_suppkey % 2", "divingSave": "l_suppkey % 2",
    "goodHighClaim": "l_linenumber % 2", "punches": "l_suppkey % 2", "bigChanceSaves": "l_linenumber % 3",
    "shotOffTarget": "l_suppkey % 2", "blockedScoringAtt": "l_linenumber % 2", "attIboxGoal": "l_linenumber % 2",
    "attOboxGoal": "l_suppkey % 2", "attHdGoal": "l_suppkey % 2", "attLfGoal": "l_linenumber % 2",
    "attRfGoal": "l_suppkey % 3", "attPenGoal": "l_linenumber % 2", "hitWoodwork": "l_suppkey % 2",
    "cornerTaken": "l_suppkey % 6", "accurateCornersIntobox": "l_suppkey % 3", "wonCorners": "l_linenumber % 3",
    "attFreekickTotal": "l_linenumber % 4", "attFreekickGoal": "l_linenumber % 2", "attFreekickTarget": "l_suppkey % 2",
    "freekickCross": "l_suppkey % 2", "accurateFreekickCross": "l_suppkey % 2", "penaltyWon": "l_linenumber % 2",
    "penaltyConceded": "l_suppkey % 2", "attSetpiece": "l_suppkey % 2", "goalAssistSetplay": "l_linenumber % 2",
    "goalAssistDeadball": "l_suppkey % 2", "totalThrows": "l_suppkey % 5", "accurateThrows": "l_suppkey % 4",
    "fouls": "l_suppkey % 3", "wasFouled": "l_linenumber % 3",
}
LINE_X = {
    "minutes": "l_quantity * 1.0137", "shots": "l_suppkey % 6", "shots_on_target": "l_suppkey % 3", "goals": "l_linenumber % 3",
    "npgoals": "l_linenumber % 2", "xg": "sqrt(l_discount) * 2.1", "npxg": "l_discount * 6.0171", "key_passes": "l_suppkey % 2",
    "assists": "l_linenumber % 2", "xa": "l_tax * 3.0119", "passes_attempted": "l_suppkey % 40 + 5",
    "passes_completed": "l_suppkey % 40", "sum_xpass": "l_suppkey % 40 * 0.9137", "xpass_overperformance": "l_suppkey % 40 * 0.0863",
}
LINE_B = {
    "time": "l_quantity * 1.0137", "goals": "l_linenumber % 3", "assists": "l_linenumber % 2", "shots": "l_suppkey % 6",
    "key_passes": "l_suppkey % 2", "x_g": "sqrt(l_discount) * 2.1", "x_a": "l_tax * 3.0119", "x_g_chain": "l_discount * 9.0193",
    "x_g_buildup": "l_tax * 4",
}
_TEAM = "CASE WHEN l_suppkey % 3 = 0 THEN 'T0' WHEN l_suppkey % 3 = 1 THEN 'T1' ELSE 'T2' END"
_POS_A = "CASE l_partkey % 4 WHEN 0 THEN 'GK' WHEN 1 THEN 'DF,MF' WHEN 2 THEN 'MF' ELSE 'FW' END"
_POS_C = "CASE l_suppkey % 5 WHEN 0 THEN 'Goalkeeper' WHEN 1 THEN 'Defender' WHEN 2 THEN 'Midfielder' WHEN 3 THEN 'Striker' ELSE '' END"
_NAME = "concat('p', l_partkey)"


def _columns(lines: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {c}" for c, e in lines.items())


_A_SQL = f"l_orderkey AS match_id, {_NAME} AS player, {_NAME} AS player_name, {_TEAM} AS team, {_POS_A} AS pos, l_linestatus = 'O' AS is_home, {_columns(LINE_A)}"
_B_SQL = f"{_NAME} AS player, {_TEAM} AS team, {_columns(LINE_B)}"
_C_SQL = f"l_orderkey AS match_id, l_partkey AS player_id, {_NAME} AS player_name, {_TEAM} AS team_name, {_POS_C} AS position, l_linestatus AS side, {_columns(LINE_C)}"
_X_SQL = f"l_partkey AS player_id, {_NAME} AS player_name, {_TEAM} AS team_name, {_columns(LINE_X)}"


def _read(spark, folder, expressions: str, by: str | None = None):
    """Lines with the expressions; `by` deals out the table's own columns first, so that wide sums by it are small before they are shuffled."""
    lines = table(spark, folder, "lineitem")
    lines = lines if by is None else lines.repartition(by)
    lines.createOrReplaceTempView("touchline_lines")
    return spark.sql(f"SELECT {expressions} FROM touchline_lines")


def box_a(spark, folder):
    return _read(spark, folder, _A_SQL)


def box_c(spark, folder, by: str | None = None):
    return _read(spark, folder, _C_SQL, by)


def metrics(spark, folder):
    return _read(spark, folder, _X_SQL)


def roster(spark, folder):
    return _read(spark, folder, _B_SQL)


def player_totals_a(spark, folder):
    a = box_a(spark, folder)
    out = B.player_totals_a(a, passing=a, defense=a, possession=a, misc=a, keeper=a, min_minutes=700)
    return rounded(
        out.select(
            "player_id", "player_name", "primary_position", "n_matches", "total_minutes", "goals", "shots", "npxg",
            "key_passes", "goals_p90", "xg_p90", "tackles_won_p90", "crosses_p90", "shot_accuracy", "xg_per_shot",
            "goals_minus_xg", "npxg_plus_xa_p90", "pass_completion", "turnovers_p90", "carry_retention",
            "prg_actions_per_touch", "aerial_success", "aerials_total_p90", "foul_differential_p90", "gk_save_pct",
            "gk_goals_prevented_p90", "is_gk", "is_df", "is_mf", "is_fw",
        )
    )


def player_totals_c(spark, folder):
    out = B.player_totals_c(box_c(spark, folder), min_minutes=700)
    return rounded(
        out.select(
            "player_id", "player_name", "primary_position", "n_matches", "total_minutes", "goals", "passes",
            "goals_p90", "shots_on_target_p90", "forward_pass_p90", "shot_accuracy", "big_chance_conversion",
            "pass_accuracy", "tackle_success", "duel_success", "poss_won_total_p90", "poss_won_att_ratio",
            "turnovers_p90", "foul_differential_p90", "penalty_conversion", "save_percentage", "is_gk", "is_df", "is_fw",
        )
    )


def match_level_stats(spark, folder):
    c = box_c(spark, folder).withColumn("team_position", F.when(F.col("side") == "O", "home").otherwise("away"))
    out = B.match_level_stats(c, min_minutes=10)
    return rounded(
        out.select(
            "match_id", "player_id", "team_name", "opponent_team", "is_home", "total_minutes", "goals_p90",
            "passes_p90", "shot_accuracy", "pass_accuracy", "save_percentage",
        )
    )


def sum_by_player(spark, folder):
    return B.sum_by_player(box_a(spark, folder), {"matches": "1", "goals": "gls", "unknown": "no_such_column"})


def sum_by_player_and_team(spark, folder):
    return B.sum_by_player(box_a(spark, folder), {"matches": "1", "goals": "gls"}, by_team=True)


def expected_metrics(spark, folder):
    features = table(spark, folder, "part").select(F.col("p_partkey").alias("player_id"))
    return rounded(B.add_expected_metrics(features, metrics(spark, folder)))


def _targets(spark, folder):
    p = table(spark, folder, "part")
    return p.select(
        F.col("p_partkey").cast("string").alias("player_id"),
        (F.sin(F.col("p_retailprice")) + F.col("p_size") / 25.0).alias("rapm"),
    )


def regression_data(spark, folder):
    f = B.player_totals_c(box_c(spark, folder), min_minutes=450)
    out = B.regression_data(f, _targets(spark, folder))
    return rounded(out.select("player_id", "goals_p90", "rapm"))


def _fit_data(spark, folder):
    f = B.player_totals_c(box_c(spark, folder, by="l_partkey"), min_minutes=450)
    target = F.col("goals_p90") * 0.4 + F.col("pass_accuracy") * 2 - F.col("tackles_p90") * 0.1 + F.sin(F.col("total_minutes")) * 0.05
    return f.withColumn("rapm", target)


def _fit_rows(spark, folder):
    """The fit's rows, written once; what was shuffled for them is freed."""
    data = cut_lineage(_fit_data(spark, folder))
    free_shuffles(spark)
    return data


def box_score_model(spark, folder):
    data = _fit_rows(spark, folder)
    fit = E.fit_feed_model(data)
    return E.feature_importance(fit, n=10)


def box_score_scores(spark, folder):
    data = _fit_rows(spark, folder)
    fit = E.fit_elastic_net(data)
    return E.score_players(data, fit)


def box_score_blend(spark, folder):
    data = _fit_rows(spark, folder)
    columns = ["goals_p90", "pass_accuracy", "tackles_p90"]
    linear = E.score_players(data, E.fit_elastic_net(data))
    trees = E.fit_boosted_boxscore(data, columns, n_folds=2, rounds=5, max_depth=3)
    return E.blend_scores(linear, E.score_players_boosted(data, trees))


def box_score_validation(spark, folder):
    t = table(spark, folder, "part")
    scores = t.select(
        F.col("p_partkey").alias("player_id"), (F.col("p_size") / 20.0).alias("spm"), F.col("p_retailprice").alias("total_minutes")
    )
    targets = t.select(F.col("p_partkey").alias("player_id"), (F.sin("p_retailprice") + F.col("p_size") / 25.0).alias("rapm"))
    return rounded(E.validate_scores(scores, targets))


def team_sequences(spark, folder):
    return rounded(R.team_sequences(box_a(spark, folder)))


def per_100_sequences(spark, folder):
    a = box_a(spark, folder).withColumn("is_home", F.lit(True))
    out = R.per_100_sequences(a, R.team_sequences(a), ["gls", "x_g", "tkl"])
    return rounded(
        out.groupBy("player_name").agg(
            F.avg("gls_p100").alias("gls_p100"), F.avg("x_g_p100").alias("x_g_p100"), F.avg("tkl_p100").alias("tkl_p100")
        )
    )


def rate_picks(spark, folder):
    a = box_a(spark, folder).withColumn("is_home", F.lit(True))
    rated = R.per_100_sequences(a, R.team_sequences(a))
    offense = R.offensive_rates(rated).groupBy("team").agg(F.sum("gls_p100").alias("gls"), F.sum("carries_p100").alias("carries"))
    defense = R.defensive_rates(rated).groupBy("team").agg(F.sum("tkl_p100").alias("tkl"), F.sum("blocks_p100").alias("blocks"))
    return rounded(offense.join(defense, "team"), 4)


def _shots(spark, folder):
    lines = table(spark, folder, "lineitem")
    return lines.select(
        F.col("l_orderkey").alias("match_id"),
        F.col("l_linestatus").alias("team"),
        F.concat(F.lit("p"), "l_partkey").alias("player_name"),
        (F.col("l_discount") * 7).alias("xg"),
        (F.col("l_suppkey") % 5 == 0).alias("is_goal"),
        (F.col("l_tax") >= 0.08).alias("is_penalty"),
    )


def finishing(spark, folder):
    return rounded(R.finishing(_shots(spark, folder), min_shots=20))


def non_penalty_xg(spark, folder):
    return rounded(R.non_penalty_xg(_shots(spark, folder)))


def padded_means(spark, folder):
    a = box_a(spark, folder)
    games = a.groupBy("player_name").agg(F.count(F.lit(1)).alias("n_games"), F.avg("x_g").alias("x_g"), F.avg("gls").alias("gls"))
    return rounded(R.pad_to_mean(games, ["x_g", "gls"], min_games=37))


def season_games(spark, folder):
    return rounded(R.season_games(box_a(spark, folder), ["x_g"], ["gls"], with_totals=True))


def player_rate_matrix(spark, folder):
    a = box_a(spark, folder).withColumn("is_home", F.lit(True))
    out = R.player_rate_matrix(a, min_minutes=700)
    return rounded(out.select("player_name", "n_games", "total_minutes", "gls_p100", "x_ag_p100"))


def view_summary_a(spark, folder):
    return rounded(V.summary_a(box_a(spark, folder), min_minutes=700))


def view_summary_a_by_team(spark, folder):
    return rounded(V.summary_a(box_a(spark, folder), min_minutes=300, by_team=True))


def view_summary_a_named(spark, folder):
    return rounded(V.summary_a(box_a(spark, folder), name="P1[0-9]$"))


def view_passing_a(spark, folder):
    a = box_a(spark, folder)
    return rounded(V.passing_a(a, a, min_minutes=700))


def view_defense_a(spark, folder):
    a = box_a(spark, folder)
    return rounded(V.defense_a(a, a, min_minutes=700))


def view_keeper_a(spark, folder):
    a = box_a(spark, folder)
    return rounded(V.keeper_a(a, a, min_minutes=700))


def view_summary_b(spark, folder):
    return rounded(V.summary_b(roster(spark, folder), min_minutes=700))


def _view_c(build):
    minutes = 100 if build is V.keeper_c else 700
    return lambda spark, folder: rounded(build(box_c(spark, folder), min_minutes=minutes))


def view_xg_c(spark, folder):
    return rounded(V.xg_c(metrics(spark, folder), min_minutes=700))


def view_xpass_c(spark, folder):
    return rounded(V.xpass_c(metrics(spark, folder), min_minutes=700))


def player_profile(spark, folder):
    a = box_a(spark, folder).withColumns({"player": F.concat(F.lit("Ann "), "player")})
    c = box_c(spark, folder).withColumn("player_name", F.concat(F.lit("A. "), "player_name"))
    b = roster(spark, folder).withColumn("player", F.concat(F.lit("Ann "), "player"))
    out = V.player_profile("Ann p17$", a, passing=a, feed=c, roster=b, min_minutes=100)
    return rounded(
        out.select(
            "player", "team", "matches", "minutes", "goals", "xg_per90", "passes_completed", "pass_pct",
            "progressive_carries", "big_chances_scored", "xg_chain",
        )
    )


VIEWS_C = {
    "view_summary_c": V.summary_c,
    "view_passing_c": V.passing_c,
    "view_defense_c": V.defense_c,
    "view_possession_c": V.possession_c,
    "view_keeper_c": V.keeper_c,
    "view_shots_c": V.shots_c,
    "view_setpiece_c": V.setpiece_c,
}

A = f"(SELECT {_A_SQL} FROM lineitem)"
C = f"(SELECT {_C_SQL} FROM lineitem)"
X = f"(SELECT {_X_SQL} FROM lineitem)"
RB = f"(SELECT {_B_SQL} FROM lineitem)"


def _mode(source: str, key: str, value: str, where: str = "true") -> str:
    return f"""(SELECT {key}, arg_min({value}, (-n, {value})) AS {value} FROM (SELECT {key}, {value}, count(*) AS n
      FROM {source} WHERE {where} GROUP BY ALL) GROUP BY {key})"""


def _div(a: str, b: str) -> str:
    return f"coalesce(({a}) / nullif({b}, 0), 0)"


def _view_sql(source, totals, derived, player="player", team="team", matches=True, minutes=700, where="true", by_team=False, have=None):
    """Totals and rounded rates of a view, from (output, raw) pairs and rate expressions."""
    keys = f"{player} AS player, {team} AS team" if by_team else f"{player} AS player"
    sums = ", ".join(f"CAST(sum({raw}) AS DOUBLE) AS {out}" for out, raw in totals.items())
    count = "CAST(count(*) AS DOUBLE) AS matches, " if matches else ""
    rates = ", ".join(f"round({e}, {d}) AS {out}" for out, (e, d) in derived.items())
    mode = "" if by_team else f" JOIN {_mode(source, player, team, where)} m ON m.{player} = t.player"
    teams = "" if by_team else f", m.{team} AS team"
    base = f"(SELECT {keys}, {count}{sums} FROM {source} WHERE {where} GROUP BY ALL)"
    return f"""SELECT t.* REPLACE ({', '.join(f'round(t.{o}, 6) AS {o}' for o in totals)}){teams}, {rates} FROM {base} t{mode} WHERE {have or f'minutes >= {minutes}'}"""


def _p90(c, d=2):
    return (_div(f"{c} * 90", "minutes"), d)


def _pct(a, b, d=1):
    return (_div(f"{a} * 100", b), d)


_SUMMARY_A = dict(V.SUMMARY_A.totals)
_SA_RATES = {"goals_minus_xg": ("goals - xg", 2), "goals_per90": _p90("goals"), "xg_per90": _p90("xg"), "npxg_per90": _p90("npxg"), "xag_per90": _p90("xag")}
_WITH_MIN = lambda v: {"minutes": "min", **v.totals}

ORACLES = {
    "player_totals_a": f"""
      WITH t AS (SELECT lower(player) AS player_id, any_value(pos) AS pos, count(*) AS n_matches, {', '.join(f'CAST(sum({c}) AS DOUBLE) AS {c}' for c in LINE_A)} FROM {A} GROUP BY 1)
      SELECT player_id, 'P' || substr(player_id, 2) AS player_name, pos AS primary_position, n_matches, min AS total_minutes, gls AS goals, sh AS shots, round(npx_g, 6) AS npxg, kp AS key_passes,
        round(gls / (min / 90), 6) AS goals_p90, round(x_g / (min / 90), 6) AS xg_p90, round(tkl_w / (min / 90), 6) AS tackles_won_p90, 0.0 AS crosses_p90,
        round({_div('so_t', 'sh')}, 6) AS shot_accuracy, round({_div('x_g', 'sh')}, 6) AS xg_per_shot, round((gls - x_g) / (min / 90), 6) AS goals_minus_xg,
        round((npx_g + x_ag) / (min / 90), 6) AS npxg_plus_xa_p90, round({_div('cmp', 'att')}, 6) AS pass_completion, round((mis + dis) / (min / 90), 6) AS turnovers_p90,
        round(CASE WHEN carries > 0 THEN 1 - (mis + dis) / carries ELSE 0 END, 6) AS carry_retention, round({_div('prg_c + prg_p', 'touches')}, 6) AS prg_actions_per_touch,
        round({_div('won_aerial', 'won_aerial + lost_aerial')}, 6) AS aerial_success, round((won_aerial + lost_aerial) / (min / 90), 6) AS aerials_total_p90,
        round((fld - fls) / (min / 90), 6) AS foul_differential_p90, round({_div('saves', 'so_ta')}, 6) AS gk_save_pct, round((ps_xg - ga) / (min / 90), 6) AS gk_goals_prevented_p90,
        CAST(pos = 'GK' AS INT) AS is_gk, CAST(pos = 'DF,MF' AS INT) AS is_df, CAST(pos = 'MF' AS INT) AS is_mf, CAST(pos = 'FW' AS INT) AS is_fw FROM t WHERE min >= 700""",
    "player_totals_c": f"""
      WITH t AS (SELECT player_id, any_value(player_name) AS player_name, count(DISTINCT match_id) AS n_matches, {', '.join(f'CAST(sum({c}) AS DOUBLE) AS {c}' for c in LINE_C)} FROM {C} GROUP BY 1),
      p AS {_mode(C, 'player_id', 'position', "position <> ''")}
      SELECT CAST(player_id AS VARCHAR) AS player_id, player_name, position AS primary_position, n_matches, minsPlayed AS total_minutes, goals, totalPass AS passes, round(goals / (minsPlayed / 90), 6) AS goals_p90,
        round(ontargetScoringAtt / (minsPlayed / 90), 6) AS shots_on_target_p90, 0.0 AS forward_pass_p90, round({_div('ontargetScoringAtt', 'totalScoringAtt')}, 6) AS shot_accuracy,
        round({_div('bigChanceScored', 'bigChanceScored + bigChanceMissed')}, 6) AS big_chance_conversion, round({_div('accuratePass', 'totalPass')}, 6) AS pass_accuracy,
        round({_div('wonTackle', 'totalTackle')}, 6) AS tackle_success, round({_div('duelWon', 'duelWon + duelLost')}, 6) AS duel_success,
        round((possWonDef3rd + possWonMid3rd + possWonAtt3rd) / (minsPlayed / 90), 6) AS poss_won_total_p90, round({_div('possWonAtt3rd', 'possWonDef3rd + possWonMid3rd + possWonAtt3rd')}, 6) AS poss_won_att_ratio,
        round((dispossessed + turnover) / (minsPlayed / 90), 6) AS turnovers_p90, round((wasFouled - fouls) / (minsPlayed / 90), 6) AS foul_differential_p90,
        round({_div('attPenGoal', 'attPenGoal + 0')}, 6) AS penalty_conversion, round({_div('saves', 'saves + goalsConceded')}, 6) AS save_percentage,
        CAST(coalesce(position = 'Goalkeeper', false) AS INT) AS is_gk, CAST(coalesce(position = 'Defender', false) AS INT) AS is_df, CAST(coalesce(position = 'Striker', false) AS INT) AS is_fw
      FROM t LEFT JOIN p USING (player_id) WHERE minsPlayed >= 700""",
    "match_level_stats": f"""
      WITH c AS (SELECT * FROM {C} WHERE minsPlayed >= 10)
      SELECT match_id, CAST(player_id AS VARCHAR) AS player_id, team_name, (SELECT min(o.team_name) FROM c o WHERE o.match_id = c.match_id AND o.team_name <> c.team_name) AS opponent_team,
        CAST(side = 'O' AS INT) AS is_home, minsPlayed AS total_minutes, round(goals / (minsPlayed / 90), 6) AS goals_p90, round(totalPass / (minsPlayed / 90), 6) AS passes_p90,
        round({_div('ontargetScoringAtt', 'totalScoringAtt')}, 6) AS shot_accuracy, round({_div('accuratePass', 'totalPass')}, 6) AS pass_accuracy,
        round({_div('saves', 'saves + goalsConceded')}, 6) AS save_percentage FROM c""",
    "sum_by_player": f"SELECT t.*, team FROM (SELECT player, CAST(count(*) AS DOUBLE) AS matches, CAST(sum(gls) AS DOUBLE) AS goals, 0.0 AS unknown FROM {A} GROUP BY player) t JOIN {_mode(A, 'player', 'team')} USING (player)",
    "sum_by_player_and_team": f"SELECT player, team, CAST(count(*) AS DOUBLE) AS matches, CAST(sum(gls) AS DOUBLE) AS goals FROM {A} GROUP BY ALL",
    "expected_metrics": f"""
      WITH s AS (SELECT player_id, sum(xg) / sum(minutes) * 90 AS a, sum(npxg) / sum(minutes) * 90 AS b, sum(xa) / sum(minutes) * 90 AS c, sum(xpass_overperformance) / sum(minutes) * 90 AS d FROM {X} GROUP BY 1)
      SELECT p_partkey AS player_id, round(coalesce(a, 0), 6) AS xg_per90, round(coalesce(b, 0), 6) AS npxg_per90, round(coalesce(c, 0), 6) AS xa_per90_xmetrics,
        round(coalesce(d, 0), 6) AS xpass_overperformance_per90_xmetrics FROM part LEFT JOIN s ON player_id = p_partkey""",
    "regression_data": f"""
      SELECT CAST(player_id AS VARCHAR) AS player_id, round(sum(goals) / (sum(minsPlayed) / 90), 6) AS goals_p90, round(any_value(sin(p_retailprice) + p_size / 25.0), 6) AS rapm
      FROM {C} JOIN part ON p_partkey = player_id GROUP BY player_id HAVING sum(minsPlayed) >= 450""",
    "box_score_validation": """
      WITH d AS (SELECT p_size / 20.0 AS p, sin(p_retailprice) + p_size / 25.0 AS y, sqrt(p_retailprice) AS w FROM part),
      m AS (SELECT avg(y) AS my, avg(p) AS mp, sum(w * y) / sum(w) AS mw FROM d)
      SELECT count(*) AS n_players, round(1 - sum((y - p) ** 2) / sum((y - my) ** 2), 6) AS r_squared, round(sqrt(avg((y - p) ** 2)), 6) AS rmse, round(avg(abs(y - p)), 6) AS mae,
        round(corr(p, y), 6) AS correlation, round(1 - sum(w * (y - p) ** 2) / sum(w * (y - mw) ** 2), 6) AS r_squared_weighted, round(sqrt(sum(w * (y - p) ** 2) / sum(w)), 6) AS rmse_weighted,
        round(sum(w * abs(y - p)) / sum(w), 6) AS mae_weighted, round(sum(w * (p - mp) * (y - mw)) / sqrt(sum(w * (p - mp) ** 2) * sum(w * (y - mw) ** 2)), 6) AS correlation_weighted FROM d, m""",
    "team_sequences": f"SELECT match_id, team, is_home, sum(touches) AS total_touches, round(greatest(20, sum(touches) / 5), 6) AS estimated_sequences FROM {A} GROUP BY ALL",
    "per_100_sequences": f"""
      WITH s AS (SELECT match_id, team, greatest(20, sum(touches) / 5) AS e FROM {A} GROUP BY ALL)
      SELECT player_name, round(avg(gls * 100 / e), 6) AS gls_p100, round(avg(x_g * 100 / e), 6) AS x_g_p100, round(avg(tkl * 100 / e), 6) AS tkl_p100 FROM {A} JOIN s USING (match_id, team) GROUP BY 1""",
    "rate_picks": f"""
      WITH s AS (SELECT match_id, team, greatest(20, sum(touches) / 5) AS e FROM {A} GROUP BY ALL)
      SELECT team, round(sum(gls * 100 / e), 4) AS gls, round(sum(carries * 100 / e), 4) AS carries, round(sum(tkl * 100 / e), 4) AS tkl, round(sum(blocks * 100 / e), 4) AS blocks FROM {A} JOIN s USING (match_id, team) GROUP BY 1""",
    "finishing": """
      SELECT 'p' || l_partkey AS player_name, count(*) AS total_shots, count(*) FILTER (l_suppkey % 5 = 0) AS total_goals, round(sum(l_discount * 7), 6) AS total_xg,
        round(count(*) FILTER (l_suppkey % 5 = 0) - sum(l_discount * 7), 6) AS goals_minus_xg, round((count(*) FILTER (l_suppkey % 5 = 0) + 5) / (sum(l_discount * 7) + 5), 6) AS finishing_modifier
      FROM lineitem WHERE l_tax < 0.08 GROUP BY l_partkey HAVING count(*) >= 20""",
    "non_penalty_xg": """
      SELECT l_orderkey AS match_id, l_linestatus AS team, 'p' || l_partkey AS player_name, round(sum(l_discount * 7), 6) AS npxg, count(*) FILTER (l_suppkey % 5 = 0) AS npg, count(*) AS np_shots
      FROM lineitem WHERE l_tax < 0.08 GROUP BY ALL""",
    "padded_means": f"""
      WITH g AS (SELECT player_name, count(*) AS n_games, avg(x_g) AS x_g, avg(gls) AS gls FROM {A} GROUP BY 1), m AS (SELECT avg(x_g) AS mx, avg(gls) AS mg FROM g)
      SELECT player_name, n_games, round(least(n_games / 37, 1) * x_g + (1 - least(n_games / 37, 1)) * mx, 6) AS x_g, round(least(n_games / 37, 1) * gls + (1 - least(n_games / 37, 1)) * mg, 6) AS gls FROM g, m""",
    "season_games": f"SELECT player_name, team, count(*) AS n_games, CAST(sum(gls) AS BIGINT) AS gls_total, round(avg(x_g), 6) AS x_g_avg FROM {A} GROUP BY ALL",
    "player_rate_matrix": f"""
      WITH s AS (SELECT match_id, team, greatest(20, sum(touches) / 5) AS e FROM {A} GROUP BY ALL),
      g AS (SELECT player_name, count(*) AS n, sum(min) AS mins, avg(gls * 100 / e) AS a, avg(x_ag * 100 / e) AS b FROM {A} JOIN s USING (match_id, team) GROUP BY 1 HAVING sum(min) >= 700), m AS (SELECT avg(a) AS ma, avg(b) AS mb FROM g)
      SELECT player_name, n AS n_games, mins AS total_minutes, round(least(n / 10, 1) * a + (1 - least(n / 10, 1)) * ma, 6) AS gls_p100, round(least(n / 10, 1) * b + (1 - least(n / 10, 1)) * mb, 6) AS x_ag_p100 FROM g, m""",
    "view_summary_a": _view_sql(A, _SUMMARY_A, _SA_RATES),
    "view_summary_a_by_team": _view_sql(A, _SUMMARY_A, _SA_RATES, minutes=300, by_team=True),
    "view_summary_a_named": _view_sql(A, _SUMMARY_A, _SA_RATES, where="regexp_matches(player, '(?i)P1[0-9]$')", have="true"),
    "view_passing_a": _view_sql(A, _WITH_MIN(V.PASSING_A), {"pass_pct": _pct("passes_completed", "passes_attempted"), "passes_per90": _p90("passes_completed", 1), "progressive_passes_per90": _p90("progressive_passes"), "key_passes_per90": _p90("key_passes")}),
    "view_defense_a": _view_sql(A, _WITH_MIN(V.DEFENSE_A), {"tackles_per90": _p90("tackles"), "interceptions_per90": _p90("interceptions"), "blocks_per90": _p90("blocks"), "tackle_win_pct": _pct("tackles_won", "tackles")}),
    "view_keeper_a": _view_sql(
        A,
        {"minutes": "CASE WHEN pos = 'GK' THEN min END", "shots_on_target_against": "so_ta", "saves": "saves", "goals_against": "ga", "clean_sheets": "CAST(ga = 0 AS INT)"},
        {"save_pct": _pct("saves", "shots_on_target_against"), "goals_against_per90": _p90("goals_against"), "clean_sheet_pct": _pct("clean_sheets", "matches")},
    ),
    "view_summary_b": _view_sql(RB, V.SUMMARY_B.totals, {"goals_minus_xg": ("goals - xg", 2), "goals_per90": _p90("goals"), "xg_per90": _p90("xg"), "xa_per90": _p90("xa")}),
    "view_xg_c": _view_sql(X, V.XG_C.totals, {"goals_minus_xg": ("goals - xg", 2), "xg_per90": _p90("xg"), "npxg_per90": _p90("npxg"), "xa_per90": _p90("xa")}, "player_name", "team_name", False).replace("m.team_name AS team", "m.team_name AS team"),
    "view_xpass_c": _view_sql(X, V.XPASS_C.totals, {"pass_pct": _pct("passes_completed", "passes_attempted"), "xpass_overperformance_per90": _p90("xpass_overperformance"), "xpass_avg": (_div("sum_xpass", "passes_attempted"), 3)}, "player_name", "team_name", False),
    "view_summary_c": _view_sql(C, V.SUMMARY_C.totals, {"goals_per90": _p90("goals"), "assists_per90": _p90("assists"), "shots_per90": _p90("shots")}, "player_name", "team_name"),
    "view_passing_c": _view_sql(C, V.PASSING_C.totals, {"pass_pct": _pct("passes_completed", "passes_attempted"), "passes_per90": _p90("passes_completed", 1), "key_passes_per90": _p90("key_passes")}, "player_name", "team_name"),
    "view_defense_c": _view_sql(C, V.DEFENSE_C.totals, {"tackles_per90": _p90("tackles"), "interceptions_per90": _p90("interceptions"), "tackle_win_pct": _pct("tackles_won", "tackles"), "aerial_win_pct": _pct("aerials_won", "aerials_won + aerials_lost")}, "player_name", "team_name"),
    "view_possession_c": _view_sql(C, V.POSSESSION_C.totals, {"touches_per90": _p90("touches", 1), "progressive_carries_per90": _p90("progressive_carries")}, "player_name", "team_name"),
    "view_keeper_c": _view_sql(C, V.KEEPER_C.totals, {"shots_conceded": ("shots_conceded_ibox + shots_conceded_obox", 6), "save_pct": _pct("saves", "saves + goals_conceded"), "goals_against_per90": _p90("goals_conceded"), "shots_conceded_per90": _p90("(shots_conceded_ibox + shots_conceded_obox)"), "clean_sheet_pct": _pct("clean_sheets", "matches")}, "player_name", "team_name", where="position = 'Goalkeeper'", minutes=100),
    "view_shots_c": _view_sql(C, V.SHOTS_C.totals, {"total_shots": ("shots_inside_box + shots_outside_box", 6), "conversion_rate": _pct("goals", "shots_inside_box + shots_outside_box"), "shot_accuracy": _pct("shots_on_target", "shots_inside_box + shots_outside_box"), "goals_per90": _p90("goals"), "shots_per90": _p90("(shots_inside_box + shots_outside_box)")}, "player_name", "team_name"),
    "view_setpiece_c": _view_sql(C, V.SETPIECE_C.totals, {"corner_accuracy": _pct("corners_accurate", "corners_taken"), "throw_accuracy": _pct("throws_accurate", "throws_total"), "corners_per90": _p90("corners_taken")}, "player_name", "team_name"),
    "player_profile": f"""
      WITH s AS (SELECT CAST(count(*) AS DOUBLE) AS matches, sum(min) AS minutes, CAST(sum(gls) AS DOUBLE) AS goals, sum(x_g) AS xg, CAST(sum(cmp) AS DOUBLE) AS pc, sum(att) AS pa FROM {A} WHERE player = 'p17'),
      c AS (SELECT CAST(sum(progressiveCarries) AS DOUBLE) AS prog, CAST(sum(bigChanceScored) AS DOUBLE) AS big FROM {C} WHERE player_name = 'p17'),
      b AS (SELECT sum(x_g_chain) AS ch FROM {RB} WHERE player = 'p17')
      SELECT 'Ann p17' AS player, (SELECT team FROM {_mode(A, 'player', 'team')} WHERE player = 'p17') AS team, matches, minutes, goals, round(xg * 90 / minutes, 2) AS xg_per90, pc AS passes_completed,
        round(pc * 100 / pa, 1) AS pass_pct, prog AS progressive_carries, big AS big_chances_scored, round(ch, 6) AS xg_chain FROM s, c, b""",
}

ROWS_ONLY = ["box_score_model", "box_score_scores", "box_score_blend"]
QUERIES = {
    name: globals()[name] if name in globals() else _view_c(VIEWS_C[name]) for name in [*ORACLES, *ROWS_ONLY]
}
