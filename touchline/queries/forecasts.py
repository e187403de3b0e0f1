"""Queries over skills, Elo, form, line-ups and predictions."""

from datetime import date

from pyspark.sql import functions as F

from touchline.operators import elo as EL, evaluate as EV, lineups as LU, predict as P, rolling as RO, skill_search as SS, skills as SK
from touchline.operators.ordering import hot_groups
from touchline.operators.skill_profile import find_player, skill_profile, suggest_names
from touchline.queries.roles import rounded, table
from touchline.session import cut_lineage, free_shuffles


def player_matches(spark, folder):
    """Player-match rows: part = player, order = match. Lines are dealt out once, by order, for the sums and the join."""
    lines = table(spark, folder, "lineitem").repartition("l_orderkey").groupBy("l_partkey", "l_orderkey").agg(
        F.sum("l_quantity").alias("q"),
        F.sum("l_discount").alias("d"),
        F.avg("l_tax").alias("t"),
        F.sum("l_linenumber").alias("n"),
        F.min("l_suppkey").alias("s"),
    )
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    position = (
        F.when(F.col("l_orderkey") % 7 == 0, "Substitute")
        .when(F.col("l_partkey") % 4 == 0, "Goalkeeper")
        .when(F.col("l_partkey") % 4 == 1, "Defender")
        .when(F.col("l_partkey") % 4 == 2, "Midfielder")
        .otherwise("Striker")
    )
    return joined.select(
        F.col("l_partkey").alias("player_id"),
        F.concat(F.lit("p"), "l_partkey").alias("player_name"),
        F.col("l_orderkey").alias("match_id"),
        F.to_date("o_orderdate").alias("match_date"),
        position.alias("position"),
        F.least(F.col("q"), F.lit(90.0)).alias("total_minutes"),
        (F.sqrt("d") * 3.017).alias("goals_p90"),
        F.sqrt(F.col("n")).alias("tackles_won_p90"),
        F.col("n").cast("double").alias("passes"),
        (F.sqrt("t") * 2.3 + 0.1).alias("pass_accuracy"),
        (F.col("s") % 2).cast("int").alias("is_home"),
        F.concat(F.lit("T"), F.col("s") % 10).alias("opponent_team"),
        F.when(F.col("o_orderstatus") == "O", "ENG").when(F.col("o_orderstatus") == "F", "NED").otherwise("POR").alias("competition"),
    )


PM = """SELECT l_partkey AS player_id, 'p' || l_partkey AS player_name, l_orderkey AS match_id, CAST(o_orderdate AS DATE) AS match_date,
  CASE WHEN l_orderkey % 7 = 0 THEN NULL WHEN l_partkey % 4 = 0 THEN 'GK' WHEN l_partkey % 4 = 1 THEN 'DEF' WHEN l_partkey % 4 = 2 THEN 'MID' ELSE 'FWD' END AS pos,
  least(q, 90) AS mins, sqrt(d) * 3.017 AS goals, sqrt(n) AS tackles, CAST(n AS DOUBLE) AS passes, sqrt(t) * 2.3 + 0.1 AS acc, s % 2 AS is_home, 'T' || (s % 10) AS opponent_team,
  CASE o_orderstatus WHEN 'O' THEN 'ENG' WHEN 'F' THEN 'NED' ELSE 'POR' END AS competition
  FROM (SELECT l_partkey, l_orderkey, sum(l_quantity) AS q, sum(l_discount) AS d, avg(l_tax) AS t, sum(l_linenumber) AS n, min(l_suppkey) AS s FROM lineitem GROUP BY ALL)
  JOIN orders ON o_orderkey = l_orderkey"""
STATS = ["goals_p90", "tackles_won_p90", "pass_accuracy"]
DAY = date(1999, 6, 30)


def position_groups(spark, folder):
    out = SK.with_position_groups(player_matches(spark, folder))
    return out.groupBy("pos_group").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("player_id").alias("players"))


def position_multipliers(spark, folder):
    return rounded(SK.position_multipliers(player_matches(spark, folder), STATS))


def player_skills(spark, folder):
    out = SK.player_skills(player_matches(spark, folder), DAY, stats=STATS)
    return rounded(out.drop("date", "player_name"))


def player_skills_latest(spark, folder):
    out = SK.player_skills(player_matches(spark, folder), stats=["goals_p90"])
    return rounded(out.select("player_id", "weighted_90s", "goals_p90"))


def skill_breakdown_rate(spark, folder):
    return rounded(SK.inspect_skill("goals_p90", player_matches(spark, folder), DAY).drop("player_name"), 5)


def skill_breakdown_ratio(spark, folder):
    return rounded(SK.inspect_skill("pass_accuracy", player_matches(spark, folder), DAY).drop("player_name"), 5)


def season_skills(spark, folder):
    out = SK.season_skills(player_matches(spark, folder), min_minutes=150, stats=STATS)
    return rounded(out.drop("player_name", "date", "primary_position"))


def _backtest(spark, folder):
    pm = player_matches(spark, folder)
    hot = hot_groups(table(spark, folder, "lineitem").select(F.col("l_partkey").alias("player_id")), ("player_id",))
    return SK.backtest(pm, stats=["goals_p90", "pass_accuracy"], hot=hot)


def skill_backtest(spark, folder):
    out = _backtest(spark, folder)
    return rounded(out.select("player_id", "match_id", "stat", "predicted", "avg_predicted", "last_predicted", "actual", "weight"))


def skill_backtest_accuracy(spark, folder):
    out = SK.backtest_accuracy(_backtest(spark, folder))
    return rounded(out.select("stat", "metric", "value", "avg_value", "last_value", "n_predictions"))


def context_adjustment(spark, folder):
    pm = player_matches(spark, folder)
    elo = table(spark, folder, "supplier").select(
        F.concat(F.lit("T"), "s_suppkey").alias("team"), (F.col("s_acctbal") / 7 + 1200).alias("elo")
    )
    out = SK.adjust_for_context(pm, elo)
    return rounded(out.select("player_id", "match_id", "goals_p90", "tackles_won_p90"))


def skill_parameters(spark, folder):
    pm = player_matches(spark, folder)
    _, found = SS.search_all(pm, stats=["goals_p90", "pass_accuracy"], rounds=2, points=4)
    return found


def skill_parameter_losses(spark, folder):
    """Losses of fixed parameters against the loss formula itself."""
    pm = player_matches(spark, folder)
    grid = [(2.0, 0.003, 0.5), (10.0, 0.001, 0.4)]
    losses = SS.walk_forward_losses(pm, "goals_p90", grid)
    rows = [(k, lam, loss) for (k, lam, _), loss in zip(grid, losses)]
    return rounded(spark.createDataFrame(rows, "prior double, lambda double, loss double"))


def _skill_table(spark, folder):
    return SK.player_skills(player_matches(spark, folder), DAY, stats=STATS)


def skill_percentiles(spark, folder):
    out = skill_profile(_skill_table(spark, folder), "P17", player_matches(spark, folder), as_of=DAY)
    return out


def player_search(spark, folder):
    names = table(spark, folder, "customer").select(
        F.regexp_replace("c_name", "Customer#0*", "Ána Üser").alias("player_name"), F.col("c_acctbal").alias("weighted_90s"),
        F.col("c_custkey").alias("player_id"),
    )
    found = [find_player(names, n) for n in ("ána üser12", "üser99", "ana user77", "X. User5")]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def player_suggestions(spark, folder):
    names = table(spark, folder, "customer").select(F.col("c_name").alias("player_name"))
    return suggest_names(names, "customer#00000123x", 5)


def results(spark, folder):
    """Matches: order = match, lowest and highest supplier = home and away."""
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.min("l_suppkey").alias("home_team"),
        F.max("l_suppkey").alias("away_team"),
        (F.count_if(F.col("l_returnflag") == "A") % 4).cast("int").alias("home_goals"),
        (F.count_if(F.col("l_returnflag") == "R") % 4).cast("int").alias("away_goals"),
        (F.sqrt(F.sum("l_discount")) * 5.013).alias("home_xg"),
        (F.sqrt(F.sum("l_tax")) * 6.007).alias("away_xg"),
    )
    orders = table(spark, folder, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("match_date"), "o_orderstatus")
    joined = lines.where(F.col("home_team") != F.col("away_team")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        F.col("l_orderkey").alias("match_id"), "match_date", "home_team", "away_team", "home_goals", "away_goals",
        F.when(F.col("l_orderkey") % 5 > 0, F.col("home_xg")).alias("home_xg"), "away_xg",
        F.col("o_orderstatus").alias("league"), F.year("match_date").alias("season_end_year"),
        F.when(F.col("home_goals") > F.col("away_goals"), "H").when(F.col("home_goals") == F.col("away_goals"), "D").otherwise("A").alias("result"),
        F.when(F.year("match_date") > 2000, "Fixture").otherwise("Played").alias("match_status"),
    )


RES = """SELECT *, CASE WHEN home_goals > away_goals THEN 'H' WHEN home_goals = away_goals THEN 'D' ELSE 'A' END AS result,
    CASE WHEN season_end_year > 2000 THEN 'Fixture' ELSE 'Played' END AS match_status
  FROM (SELECT l_orderkey AS match_id, CAST(o_orderdate AS DATE) AS match_date, home_team, away_team, home_goals, away_goals, CASE WHEN l_orderkey % 5 > 0 THEN hx END AS home_xg, away_xg, o_orderstatus AS league,
    year(o_orderdate) AS season_end_year
  FROM (SELECT l_orderkey, min(l_suppkey) AS home_team, max(l_suppkey) AS away_team, count(*) FILTER (l_returnflag = 'A') % 4 AS home_goals, count(*) FILTER (l_returnflag = 'R') % 4 AS away_goals,
      sqrt(sum(l_discount)) * 5.013 AS hx, sqrt(sum(l_tax)) * 6.007 AS away_xg FROM lineitem GROUP BY l_orderkey) JOIN orders ON o_orderkey = l_orderkey WHERE home_team <> away_team)"""


def elo_update(spark, folder):
    games = results(spark, folder).withColumns(
        {"home_elo": F.col("home_team") * 3.7 + 1400, "away_elo": F.col("away_team") * 2.9 + 1450}
    )
    return rounded(EL.update_elos(games).select("match_id", "new_home_elo", "new_away_elo"))


def _customer_games(spark, folder):
    """Matches between the customers of neighbouring orders: few per team, as many as orders allow."""
    o = table(spark, folder, "orders").withColumn("match_id", F.floor(F.col("o_orderkey") / 2))
    first, last = F.min_by("o_custkey", "o_orderkey"), F.max_by("o_custkey", "o_orderkey")
    goals = lambda pick: F.floor(pick("o_totalprice", "o_orderkey") % 4).cast("int")
    games = o.groupBy("match_id").agg(
        first.alias("home_team"), last.alias("away_team"), F.max(F.to_date("o_orderdate")).alias("match_date"),
        goals(F.min_by).alias("home_goals"), goals(F.max_by).alias("away_goals"),
    )
    return games.where(F.col("home_team") != F.col("away_team"))


def match_elos(spark, folder):
    return rounded(EL.match_elos(_customer_games(spark, folder)), 4)


def _hot_teams(spark, folder):
    return hot_groups(table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("team")), ("team",))


def rolling_form(spark, folder):
    out = RO.rolling_form(results(spark, folder), windows=(5, 10), hot=_hot_teams(spark, folder))
    return rounded(
        out.select(
            "match_id", "home_goals_scored_last_5", "away_points_last_5", "home_xg_for_last_10", "away_npxgd_last_10",
            "home_clean_sheet_last_5", "away_win_last_10", "diff_xg_for_last_5", "home_days_since_last", "rest_diff",
        )
    )


def imputed_xg(spark, folder):
    out = RO.impute_xg(results(spark, folder))
    return rounded(out.select("match_id", "home_xg", "away_xg"))


def imputed_form(spark, folder):
    form = RO.rolling_form(results(spark, folder), windows=(5,), hot=_hot_teams(spark, folder))
    joined = results(spark, folder).join(form.select("match_id", "home_goals_scored_last_5", "away_days_since_last"), "match_id")
    out = P.impute_form(joined)
    return rounded(out.select("match_id", "home_goals_scored_last_5", "away_days_since_last", "is_early_season"))


def temporal_split(spark, folder):
    return P.temporal_split(results(spark, folder)).select("match_id", "split")


def temporal_split_one_season(spark, folder):
    one = results(spark, folder).withColumn("season_end_year", F.lit(2000))
    return P.temporal_split(one).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def structural_features(spark, folder):
    out = P.structural_features(results(spark, folder), ["F", "O", "P"])
    return out.select("match_id", "match_month", "outcome_label", "league_F", "league_O", "league_P")


def _lineups(spark, folder):
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("match_id"),
        F.concat(F.lit("P"), "l_partkey").alias("player_name"),
        F.col("l_linestatus").alias("team_name"),
        F.when(F.col("l_linestatus") == "O", "Home").otherwise("Away").alias("team_position"),
        (F.col("l_linenumber") <= 5).alias("is_starter"),
        F.when(F.col("l_suppkey") % 4 == 0, "Goalkeeper").when(F.col("l_suppkey") % 4 == 1, "Wing Defender")
        .when(F.col("l_suppkey") % 4 == 2, "Midfielder").otherwise("Striker").alias("position"),
    )


def lineup_ratings(spark, folder):
    parts = table(spark, folder, "part")
    ratings = parts.where(F.col("p_partkey") % 10 > 0).select(
        F.concat(F.lit("p"), "p_partkey").alias("player_name"),
        (F.col("p_size") / 25.0 - 0.9).alias("rating"),
        (F.col("p_size") / 50.0).alias("offense"),
        (F.col("p_retailprice") / 3000.0).alias("defense"),
        (F.col("p_size") / 33.0).alias("spm"),
        F.when(F.col("p_partkey") % 3 == 0, 1999).otherwise(2000).alias("season_end_year"),
    )
    out = LU.lineup_ratings(_lineups(spark, folder), ratings, 2000)
    return rounded(
        out.select(
            "match_id", "home_sum_rating", "away_avg_rating", "home_max_rating", "home_min_rating", "away_stdev_rating",
            "home_avg_def_offense", "away_avg_mid_rating", "home_avg_fwd_defense", "home_n_rated_players", "rating_diff", "spm_diff",
        )
    )


def lineup_skills(spark, folder):
    parts = table(spark, folder, "part")
    skills = parts.select(
        F.col("p_partkey").alias("player_id"), F.concat(F.lit("p"), "p_partkey").alias("player_name"),
        (F.col("p_size") / 30.0).alias("goals_p90"), F.when(F.col("p_partkey") % 5 > 0, F.col("p_retailprice") / 700.0).alias("tackles_won_p90"),
        (F.col("p_size") / 70.0).alias("assists_p90"),
    )
    return rounded(LU.lineup_skills(_lineups(spark, folder), skills))


def upcoming_lineups(spark, folder):
    lu = _lineups(spark, folder).withColumns(
        {"team_id": F.regexp_extract("player_name", "([0-9])$", 1), "match_date": F.to_date(F.lit("2000-01-01"))}
    )
    dates = table(spark, folder, "orders").select(F.col("o_orderkey").alias("match_id"), F.to_date("o_orderdate").alias("match_date"))
    lu = lu.drop("match_date").join(dates, "match_id")
    fixtures = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("match_id"),
        (F.col("s_suppkey") % 12).cast("string").alias("home_team_id"),
        F.when(F.col("s_suppkey") % 9 > 0, (F.col("s_suppkey") % 11).cast("string")).otherwise("").alias("away_team_id"),
        F.col("s_name").alias("home_team"), F.col("s_name").alias("away_team"),
    )
    out = LU.upcoming_lineups(lu, fixtures)
    return out.groupBy("match_id", "team_id", "team_position").agg(F.count(F.lit(1)).alias("n"), F.min("player_name").alias("first_name"))


def played_results(spark, folder):
    lines = table(spark, folder, "lineitem")
    lineups = lines.select(
        F.col("l_orderkey").alias("match_id"), F.col("l_linestatus").alias("team_name"), F.col("l_linestatus").alias("team_id"),
        F.when(F.col("l_linestatus") == "O", "home").otherwise("away").alias("team_position"),
        (F.col("l_linenumber") <= 5).alias("is_starter"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("match_date"),
        F.col("l_returnflag").alias("league"), F.lit("1999-2000").alias("season"),
    )
    events = lines.select(
        F.col("l_orderkey").alias("match_id"), F.col("l_linestatus").alias("team_id"),
        F.when(F.col("l_discount") > 0.06, "goal").otherwise("card").alias("event_type"),
    )
    played = P.played_results(lineups, events, tournaments=["A"])
    fixtures = played.where(F.col("match_id") % 10 == 0).withColumn("match_status", F.lit("Fixture"))
    out = P.fixture_results(played, fixtures)
    return out.select("match_id", "match_date", "match_status", "league", "season_end_year", "home_team", "away_team", "home_goals", "away_goals", "result", "is_neutral_venue")


def _predictions(spark, folder):
    docs = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id")
    h = F.col("n_chars") % 97 / 150.0 + 0.05
    d = F.col("n_chars") % 31 / 200.0 + 0.05
    return docs.select(
        "doc_id", F.col("lang").alias("league"), (F.col("quality") + F.col("toxic")).alias("outcome_label"),
        h.alias("prob_H"), d.alias("prob_D"), (1 - h - d).alias("prob_A"), (F.col("n_chars") % 400 - 200).cast("double").alias("elo_diff"),
        F.col("quality").cast("double").alias("home_goals"), F.col("toxic").cast("double").alias("away_goals"),
        (F.col("n_chars") % 7 / 3.0).alias("pred_home_goals"), (F.col("n_chars") % 5 / 3.0).alias("pred_away_goals"),
    )


PRED = """SELECT doc_id, lang AS league, quality + toxic AS y, n_chars % 97 / 150.0 + 0.05 AS h, n_chars % 31 / 200.0 + 0.05 AS d,
  1 - (n_chars % 97 / 150.0 + 0.05) - (n_chars % 31 / 200.0 + 0.05) AS a, n_chars % 400 - 200 AS elo, quality, toxic, n_chars FROM documents JOIN labels USING (doc_id)"""


def multiclass_logloss(spark, folder):
    return rounded(EV.multiclass_logloss(_predictions(spark, folder)))


def outcome_calibration(spark, folder):
    return rounded(EV.outcome_calibration(_predictions(spark, folder), n_bins=10))


def goal_errors(spark, folder):
    p = _predictions(spark, folder)
    return rounded(EV.goal_errors(p, p.where(F.col("doc_id") % 2 == 0)))


def outcome_scores(spark, folder):
    p = _predictions(spark, folder)
    return rounded(EV.outcome_scores(p, p.where(F.col("doc_id") % 2 == 0)))


def league_scores(spark, folder):
    return rounded(EV.league_scores(_predictions(spark, folder)))


def fixture_scores(spark, folder):
    return P.score_fixtures(_predictions(spark, folder).withColumn("match_id", F.col("doc_id"))).drop("league")


_FEATURES = [f"{side}_{m}_last_5" for side in ("home", "away") for m in ("goals_scored", "goals_conceded", "xg_for", "points")] + ["is_early_season"]


def match_forecast(spark, folder):
    """Forecast from form before kick-off."""
    played = RO.impute_xg(results(spark, folder))
    games = cut_lineage(P.impute_form(P.structural_features(played.join(RO.rolling_form(played, windows=(5,), hot=_hot_teams(spark, folder)), "match_id", "left"), [])))
    free_shuffles(spark)
    played = games.where("match_status = 'Played'")
    home, away = P.fit_goals(played, _FEATURES, "home_goals"), P.fit_goals(played, _FEATURES, "away_goals")
    stacked = P.out_of_fold_goals(played, _FEATURES)
    outcome = P.fit_outcome(stacked, _FEATURES + P.GOAL_FEATURES)
    fixtures = games.where("match_status = 'Fixture'")
    return P.score_fixtures(P.predict_matches(fixtures, home, away, outcome))


_W = "exp(-{l} * date_diff('day', match_date, DATE '1999-06-30'))"
_HIST = f"(SELECT * FROM ({PM}) WHERE match_date < DATE '1999-06-30')"
_MODE = lambda src: f"(SELECT player_id, arg_min(pos, (-n, pos)) AS mp FROM (SELECT player_id, pos, count(*) AS n FROM {src} WHERE pos IS NOT NULL GROUP BY ALL) GROUP BY player_id)"
_FILLED = lambda src: f"(SELECT s.*, coalesce(pos, mp) AS grp, mp FROM {src} s LEFT JOIN {_MODE(src)} m USING (player_id))"


def _centres(src):
    return f"(SELECT grp, sum(goals * mins) / sum(mins) AS cg, sum(tackles * mins) / sum(mins) AS ct, sum(acc * mins) / sum(mins) AS ca FROM {_FILLED(src)} GROUP BY grp)"


_WR, _WE = _W.format(l=0.003), _W.format(l=0.002)
_SKILLS = f"""
  SELECT player_id, any_value(mp) AS grp, sum({_WR} * mins / 90) AS w90, sum({_WR} * goals * mins / 90) AS xg, sum({_WR} * tackles * mins / 90) AS xt,
    sum({_WE} * acc * passes) AS xa, sum({_WE} * passes) AS wa, sum({_WE} * mins / 90) AS we90, sum(mins) AS total_minutes, count(*) AS matches, sum(goals * mins / 90) AS rg, sum(mins / 90) AS r90,
    sum(acc * passes) AS ra, sum(passes) AS rp FROM {_FILLED(_HIST)} GROUP BY player_id
"""
_TOTAL = f"(SELECT sum(goals * mins) / sum(mins) AS tg, sum(tackles * mins) / sum(mins) AS tt, sum(acc * mins) / sum(mins) AS ta FROM {_HIST})"
_SK = f"""
  SELECT s.*, coalesce(cg, tg) AS cg, coalesce(ct, tt) AS ct, greatest(least(coalesce(ca, ta), 1 - 1e-6), 1e-6) AS ca, coalesce(ca, ta) AS raw_ca FROM ({_SKILLS}) s LEFT JOIN {_centres(_HIST)} c USING (grp), {_TOTAL}
"""
_BT = f"""
  WITH f AS {_FILLED(f'({PM})')}, c AS {_centres(f'({PM})')},
  h AS (SELECT a.player_id, a.match_id, any_value(a.goals) AS ag, any_value(a.acc) AS aa, any_value(a.mins) AS am, any_value(a.passes) AS ap, any_value(a.mp) AS mp, count(*) AS seen,
      sum(exp(-0.003 * date_diff('day', b.match_date, a.match_date)) * b.goals * b.mins / 90) AS xg, sum(exp(-0.003 * date_diff('day', b.match_date, a.match_date)) * b.mins / 90) AS wg,
      sum(exp(-0.002 * date_diff('day', b.match_date, a.match_date)) * b.acc * b.passes) AS xa, sum(exp(-0.002 * date_diff('day', b.match_date, a.match_date)) * b.passes) AS wa,
      sum(b.goals * b.mins) / sum(b.mins) AS avg_g, sum(b.acc * b.passes) / sum(b.passes) AS avg_a, arg_max(b.goals, (b.match_date, b.match_id)) AS lg, arg_max(b.acc, (b.match_date, b.match_id)) AS la
    FROM f a JOIN f b ON a.player_id = b.player_id AND (b.match_date, b.match_id) < (a.match_date, a.match_id) GROUP BY a.player_id, a.match_id HAVING count(*) >= 5)
  SELECT player_id, match_id, 'goals_p90' AS stat, (cg * 2 + xg) / (2 + wg) AS predicted, avg_g AS avg_predicted, lg AS last_predicted, ag AS actual, am / 90 AS weight FROM h JOIN c ON grp = mp WHERE am > 0
  UNION ALL
  SELECT player_id, match_id, 'pass_accuracy', (greatest(least(ca, 1 - 1e-6), 1e-6) * 50 + xa) / (50 + wa), avg_a, la, aa, ap FROM h JOIN c ON grp = mp WHERE am > 0 AND wa > 0
"""
_LL = lambda p: f"sum(weight * -(greatest(least(actual, 1 - 1e-8), 1e-8) * ln(greatest(least({p}, 1 - 1e-8), 1e-8)) + (1 - greatest(least(actual, 1 - 1e-8), 1e-8)) * ln(1 - greatest(least({p}, 1 - 1e-8), 1e-8)))) / sum(weight)"
_SE = lambda p: f"sqrt(sum(weight * ({p} - actual) ** 2) / sum(weight))"
_ACC = lambda p: f"round(CASE WHEN stat = 'goals_p90' THEN {_SE(p)} ELSE {_LL(p)} END, 6)"
_LOSS_SUMS = lambda n, lam: f"sum(exp(-{lam} * date_diff('day', b.match_date, a.match_date)) * b.goals * b.mins / 90) AS x{n}, sum(exp(-{lam} * date_diff('day', b.match_date, a.match_date)) * b.mins / 90) AS w{n}"
_LOSS = lambda n, k, lam, mean: f"SELECT CAST({k} AS DOUBLE) AS prior, CAST({lam} AS DOUBLE) AS lambda, round(sum(am * ((x{n} + {k} * {mean}) / ({k} + w{n}) - ag) ** 2) / sum(am), 6) AS loss FROM h"


def _profile_line(stat, category, col, ratio):
    """One line of the profile of player 17."""
    fade = f"exp(-{0.002 if ratio else 0.003} * date_diff('day', match_date, DATE '{DAY}'))"
    number = lambda e, on: e if on else "CAST(NULL AS DOUBLE)"
    return f"""
      SELECT '{category}' AS category, '{stat}' AS stat, '{'efficiency' if ratio else 'rate'}' AS type, round(any_value(me.{stat}), 4) AS skill, (SELECT round(avg({col}), 4) FROM own) AS raw_avg,
        round(avg(k.{stat}), 4) AS league_avg, round(100 * avg(CAST(k.{stat} <= me.{stat} AS INT)), 1) AS league_pct,
        round(avg(k.{stat}) FILTER (k.grp = me.grp), 4) AS pos_avg, round(100 * avg(CAST(k.{stat} <= me.{stat} AS INT)) FILTER (k.grp = me.grp), 1) AS pos_pct,
        {number("(SELECT round(sum(mins / 90), 1) FROM own)", not ratio)} AS n90, {number(f"(SELECT round(sum({fade} * mins / 90), 1) FROM own)", not ratio)} AS w90,
        {number("(SELECT round(sum(passes), 0) FROM own)", ratio)} AS attempts, {number(f"(SELECT round(sum({fade} * passes), 0) FROM own)", ratio)} AS w_attempts
      FROM k, me"""


_PROFILE = f"""
  WITH k AS (SELECT player_id, grp, (cg * 2 + xg) / (2 + w90) AS goals_p90, (ct * 2 + xt) / (2 + w90) AS tackles_won_p90, (ca * 50 + xa) / (50 + wa) AS pass_accuracy FROM ({_SK})),
  me AS (SELECT * FROM k WHERE player_id = 17), own AS (SELECT * FROM ({PM}) WHERE player_id = 17)
  {_profile_line("goals_p90", "Attacking", "goals", False)} UNION ALL {_profile_line("tackles_won_p90", "Defending", "tackles", False)} UNION ALL {_profile_line("pass_accuracy", "Passing", "acc", True)}
"""
# Games in the order their teams allow: each step plays all games that are the next one of both teams.
_ELOS = """
  WITH RECURSIVE g AS (
    SELECT o_orderkey // 2 AS match_id, min_by(o_custkey, o_orderkey) AS home, max_by(o_custkey, o_orderkey) AS away, max(CAST(o_orderdate AS DATE)) AS match_date,
      CAST(floor(min_by(o_totalprice, o_orderkey) % 4) AS INT) AS hg, CAST(floor(max_by(o_totalprice, o_orderkey) % 4) AS INT) AS ag
    FROM orders GROUP BY 1 HAVING min_by(o_custkey, o_orderkey) <> max_by(o_custkey, o_orderkey)
  ), l AS (
    SELECT match_id, team, row_number() OVER (PARTITION BY team ORDER BY match_date, match_id) AS k
    FROM (SELECT match_id, match_date, home AS team FROM g UNION ALL SELECT match_id, match_date, away FROM g)
  ), m AS (
    SELECT g.*, h.k AS hk, a.k AS ak FROM g JOIN l h ON h.match_id = g.match_id AND h.team = home JOIN l a ON a.match_id = g.match_id AND a.team = away
  ), r AS (
    SELECT DISTINCT team, CAST(1 AS BIGINT) AS k, CAST(1500 AS DOUBLE) AS elo FROM l
    UNION ALL
    SELECT * FROM (
      WITH p AS (
        SELECT home, away, 20 * (ln(abs(hg - ag) + 1) + 1) * (CASE WHEN hg > ag THEN 1 WHEN hg = ag THEN 0.5 ELSE 0 END - 1 / (1 + 10 ** (-(x.elo + 65 - y.elo) / 400))) AS ch
        FROM m JOIN r x ON x.team = home AND x.k = hk JOIN r y ON y.team = away AND y.k = ak
      ), q AS (SELECT home AS team, ch FROM p UNION ALL SELECT away, -ch FROM p)
      SELECT r.team, r.k + CASE WHEN ch IS NULL THEN 0 ELSE 1 END, r.elo + coalesce(ch, 0) FROM r LEFT JOIN q ON q.team = r.team WHERE EXISTS (SELECT 1 FROM q)
    )
  ), e AS (SELECT DISTINCT team, k, elo FROM r)
  SELECT match_id, round(x.elo, 4) AS home_elo, round(y.elo, 4) AS away_elo, round(x.elo - y.elo, 4) + 0.0 AS elo_diff
  FROM m JOIN e x ON x.team = home AND x.k = hk JOIN e y ON y.team = away AND y.k = ak
"""
_LONG = f"""(SELECT match_id, match_date, home_team AS team, true AS is_home, home_goals AS gs, away_goals AS gc, home_xg AS xf, away_xg AS xa FROM ({RES})
  UNION ALL SELECT match_id, match_date, away_team, false, away_goals, home_goals, away_xg, home_xg FROM ({RES}))"""


def _mean(e, w):
    return f"CASE WHEN count(*) OVER (PARTITION BY team ORDER BY match_date, match_id ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING) = {w} THEN avg({e}) OVER (PARTITION BY team ORDER BY match_date, match_id ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING) END"


_FORM = f"""
  SELECT *, {_mean('gs', 5)} AS gs5, {_mean('CASE WHEN gs > gc THEN 3.0 WHEN gs = gc THEN 1.0 ELSE 0.0 END', 5)} AS pt5, {_mean('xf', 10)} AS xf10, {_mean('xf - xa', 10)} AS nx10,
    {_mean('CAST(gc = 0 AS INT)', 5)} AS cs5, {_mean('CAST(gs > gc AS INT)', 10)} AS w10, {_mean('xf', 5)} AS xf5,
    CAST(date_diff('day', lag(match_date) OVER (PARTITION BY team ORDER BY match_date, match_id), match_date) AS DOUBLE) AS rest FROM {_LONG}
"""
_LU = """SELECT l_orderkey AS match_id, 'p' || l_partkey AS player_name, l_partkey, l_linestatus AS side, l_suppkey % 4 AS pos FROM lineitem WHERE l_linenumber <= 5"""
_LR = f"""
  SELECT match_id, side, sum(r) AS sr, avg(r) AS ar, max(r) AS xr, min(r) AS nr, coalesce(stddev_samp(r), 0) AS sd, coalesce(avg(o) FILTER (pos = 1), 0) AS defo,
    coalesce(avg(r) FILTER (pos = 2), 0) AS midr, coalesce(avg(de) FILTER (pos = 3), 0) AS fwdd, count(*) FILTER (r <> 0) AS nn, sum(s) AS ss
  FROM (SELECT match_id, side, pos, CASE WHEN p_partkey % 10 = 0 THEN 0 ELSE f * (p_size / 25.0 - 0.9) END AS r, CASE WHEN p_partkey % 10 = 0 THEN 0 ELSE f * p_size / 50.0 END AS o,
      CASE WHEN p_partkey % 10 = 0 THEN 0 ELSE f * p_retailprice / 3000.0 END AS de, CASE WHEN p_partkey % 10 = 0 THEN 0 ELSE f * p_size / 33.0 END AS s
    FROM ({_LU}) JOIN (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN 0.8 ELSE 1.0 END AS f FROM part) ON p_partkey = l_partkey) GROUP BY ALL
"""
_SIDE = lambda c, s: f"max({c}) FILTER (side = '{s}')"
_CTX = f"""
  WITH e AS (SELECT 'T' || s_suppkey AS team, s_acctbal / 7 + 1200 AS elo FROM supplier), m AS (SELECT avg(elo) AS me FROM e),
  o AS (SELECT p.*, greatest(least(me / coalesce(elo, me), 1.5), 0.67) AS f FROM ({PM}) p LEFT JOIN e ON team = opponent_team, m),
  a AS (SELECT * REPLACE (goals * f AS goals, tackles * f AS tackles) FROM o),
  v AS (SELECT greatest(least(avg(goals) FILTER (is_home = 1) / avg(goals) FILTER (is_home = 0), 1.5), 0.67) AS vg, greatest(least(avg(tackles) FILTER (is_home = 1) / avg(tackles) FILTER (is_home = 0), 1.5), 0.67) AS vt FROM a),
  b AS (SELECT a.* REPLACE (CASE WHEN is_home = 0 THEN goals * vg ELSE goals END AS goals, CASE WHEN is_home = 0 THEN tackles * vt ELSE tackles END AS tackles) FROM a, v),
  r AS (SELECT avg(goals) AS rg, avg(tackles) AS rt FROM b WHERE competition = 'ENG'),
  l AS (SELECT competition, greatest(least(rg / avg(goals), 1.5), 0.67) AS lg, greatest(least(rt / avg(tackles), 1.5), 0.67) AS lt FROM b, r WHERE competition <> 'ENG' GROUP BY competition, rg, rt)
  SELECT player_id, match_id, round(goals * coalesce(lg, 1), 6) AS goals_p90, round(tackles * coalesce(lt, 1), 6) AS tackles_won_p90 FROM b LEFT JOIN l USING (competition)
"""
_SEASON = f"""
  WITH t AS (SELECT DISTINCT CASE WHEN month(match_date) >= 7 THEN year(match_date) + 1 ELSE year(match_date) END AS s FROM ({PM})),
  q AS (SELECT s, make_date(s, 6, 30) AS d FROM t),
  h AS (SELECT q.s, q.d, p.* FROM q JOIN ({PM}) p ON p.match_date < q.d),
  mo AS (SELECT s, player_id, arg_min(pos, (-n, pos)) AS mp FROM (SELECT s, player_id, pos, count(*) AS n FROM h WHERE pos IS NOT NULL GROUP BY ALL) GROUP BY ALL),
  f AS (SELECT h.*, mp, coalesce(pos, mp) AS grp FROM h LEFT JOIN mo USING (s, player_id)),
  c AS (SELECT s, grp, sum(goals * mins) / sum(mins) AS cg, sum(tackles * mins) / sum(mins) AS ct, sum(acc * mins) / sum(mins) AS ca FROM f GROUP BY ALL),
  tot AS (SELECT s, sum(goals * mins) / sum(mins) AS cg, sum(tackles * mins) / sum(mins) AS ct, sum(acc * mins) / sum(mins) AS ca FROM f GROUP BY ALL),
  k AS (SELECT s, player_id, any_value(mp) AS grp, sum(exp(-0.003 * date_diff('day', match_date, d)) * mins / 90) AS w90, sum(exp(-0.003 * date_diff('day', match_date, d)) * goals * mins / 90) AS xg,
      sum(exp(-0.003 * date_diff('day', match_date, d)) * tackles * mins / 90) AS xt, sum(exp(-0.002 * date_diff('day', match_date, d)) * acc * passes) AS xa,
      sum(exp(-0.002 * date_diff('day', match_date, d)) * passes) AS wa, sum(mins) FILTER (match_date >= make_date(s - 1, 7, 1)) AS sm, count(DISTINCT match_id) FILTER (match_date >= make_date(s - 1, 7, 1)) AS nm
    FROM f GROUP BY s, player_id)
  SELECT k.s AS season_end_year, player_id, sm AS total_minutes, nm AS n_matches, round(w90, 6) AS weighted_90s, round((coalesce(c.cg, tot.cg) * 2 + xg) / (2 + w90), 6) AS goals_p90,
    round((coalesce(c.ct, tot.ct) * 2 + xt) / (2 + w90), 6) AS tackles_won_p90, round((greatest(least(coalesce(c.ca, tot.ca), 1 - 1e-6), 1e-6) * 50 + xa) / (50 + wa), 6) AS pass_accuracy,
    CAST(coalesce(k.grp = 'GK', false) AS INT) AS is_gk, CAST(coalesce(k.grp = 'DEF', false) AS INT) AS is_df, CAST(coalesce(k.grp = 'MID', false) AS INT) AS is_mf, CAST(coalesce(k.grp = 'FWD', false) AS INT) AS is_fw
  FROM k JOIN tot USING (s) LEFT JOIN c ON c.s = k.s AND c.grp = k.grp WHERE sm >= 150
"""
_EDIT = "levenshtein(lower('customer#00000123x'), lower(c_name))"

ORACLES = {
    "position_groups": f"SELECT grp AS pos_group, count(*) AS n, count(DISTINCT player_id) AS players FROM {_FILLED(f'({PM})')} GROUP BY grp",
    "position_multipliers": f"""
      WITH c AS {_centres(f'({PM})')}, t AS (SELECT sum(goals * mins) / sum(mins) AS tg, sum(tackles * mins) / sum(mins) AS tt, sum(acc * mins) / sum(mins) AS ta FROM ({PM})),
      g AS (SELECT * FROM c, t WHERE grp IS NOT NULL)
      SELECT 'goals_p90' AS stat, grp AS pos_group, round(cg / tg, 6) AS multiplier FROM g UNION ALL SELECT 'tackles_won_p90', grp, round(ct / tt, 6) FROM g
      UNION ALL SELECT 'pass_accuracy', grp, round(ca / ta, 6) FROM g""",
    "player_skills": f"""
      SELECT player_id, grp AS primary_position, round(w90, 6) AS weighted_90s, round((cg * 2 + xg) / (2 + w90), 6) AS goals_p90, round((ct * 2 + xt) / (2 + w90), 6) AS tackles_won_p90,
        round((ca * 50 + xa) / (50 + wa), 6) AS pass_accuracy FROM ({_SK})""",
    "player_skills_latest": f"""
      WITH p AS ({PM}), m AS (SELECT max(match_date) AS d FROM p), f AS {_FILLED(f'({PM})')}, c AS {_centres(f'({PM})')}, t AS (SELECT sum(goals * mins) / sum(mins) AS tg FROM p),
      s AS (SELECT player_id, any_value(mp) AS grp, sum(exp(-0.003 * date_diff('day', match_date, d)) * mins / 90) AS w, sum(exp(-0.003 * date_diff('day', match_date, d)) * goals * mins / 90) AS x FROM f, m GROUP BY player_id)
      SELECT player_id, round(w, 6) AS weighted_90s, round((coalesce(cg, tg) * 2 + x) / (2 + w), 6) AS goals_p90 FROM s LEFT JOIN c USING (grp), t""",
    "skill_breakdown_rate": f"""
      SELECT player_id, grp AS pos_group, total_minutes, matches, round(rg, 5) AS raw_total, round(r90, 5) AS total_90s, round(rg / r90, 5) AS raw_p90, round(cg, 5) AS prior_center, 2.0 AS prior_strength,
        0.003 AS lambda, round(ln(2) / 0.003, 5) AS half_life_days, round(xg, 5) AS decay_events, round(w90, 5) AS decay_exposure, round(w90, 5) AS weighted_90s, round((cg * 2 + xg) / (2 + w90), 5) AS skill FROM ({_SK})""",
    "skill_breakdown_ratio": f"""
      SELECT player_id, grp AS pos_group, total_minutes, matches, round(ra, 5) AS raw_successes, round(rp, 5) AS raw_attempts, round(ra / rp, 5) AS raw_rate, round(ca, 5) AS prior_center, 50.0 AS prior_strength,
        0.002 AS lambda, round(ln(2) / 0.002, 5) AS half_life_days, round(xa, 5) AS decay_successes, round(wa, 5) AS decay_attempts, round(we90, 5) AS weighted_90s, round((ca * 50 + xa) / (50 + wa), 5) AS skill FROM ({_SK})""",
    "season_skills": _SEASON,
    "skill_backtest": f"SELECT player_id, match_id, stat, round(predicted, 6) AS predicted, round(avg_predicted, 6) AS avg_predicted, round(last_predicted, 6) AS last_predicted, round(actual, 6) AS actual, round(weight, 6) AS weight FROM ({_BT})",
    "skill_backtest_accuracy": f"""
      SELECT stat, CASE WHEN stat = 'goals_p90' THEN 'rmse' ELSE 'logloss' END AS metric, {_ACC('predicted')} AS value, {_ACC('avg_predicted')} AS avg_value, {_ACC('last_predicted')} AS last_value,
        count(*) AS n_predictions FROM ({_BT}) GROUP BY stat""",
    "match_elos": _ELOS,
    "skill_percentiles": _PROFILE,
    "skill_parameter_losses": f"""
      WITH p AS ({PM}), h AS (SELECT a.player_id, a.match_id, any_value(a.goals) AS ag, any_value(a.mins) AS am, {_LOSS_SUMS(0, 0.003)}, {_LOSS_SUMS(1, 0.001)}
        FROM p a JOIN p b ON a.player_id = b.player_id AND (b.match_date, b.match_id) < (a.match_date, a.match_id) WHERE a.mins > 0 GROUP BY a.player_id, a.match_id HAVING count(*) >= 5)
      {_LOSS(0, 2.0, 0.003, 0.5)} UNION ALL {_LOSS(1, 10.0, 0.001, 0.4)}""",
    "context_adjustment": _CTX,
    "player_search": """
      SELECT 'Ána Üser' || c_custkey AS player_name, c_acctbal AS weighted_90s, c_custkey AS player_id FROM customer WHERE c_custkey IN (12, 77)
      UNION ALL (SELECT 'Ána Üser' || c_custkey, c_acctbal, c_custkey FROM customer WHERE contains(CAST(c_custkey AS VARCHAR), '99') AND starts_with(CAST(c_custkey AS VARCHAR), '99') ORDER BY c_acctbal DESC LIMIT 1)
      UNION ALL SELECT 'Ána Üser' || c_custkey, c_acctbal, c_custkey FROM customer WHERE c_custkey = 5""",
    "player_suggestions": f"SELECT c_name AS player_name, {_EDIT} AS distance FROM customer ORDER BY distance, player_name LIMIT 5",
    "elo_update": f"""
      WITH g AS (SELECT *, home_team * 3.7 + 1400 AS h, away_team * 2.9 + 1450 AS a FROM ({RES})),
      c AS (SELECT *, 20 * (ln(abs(home_goals - away_goals) + 1) + 1) * (CASE result WHEN 'H' THEN 1 WHEN 'D' THEN 0.5 ELSE 0 END - 1 / (1 + 10 ** (-(h + 65 - a) / 400))) AS ch FROM g)
      SELECT match_id, round(h + ch, 6) AS new_home_elo, round(a - ch, 6) AS new_away_elo FROM c""",
    "rolling_form": f"""
      WITH f AS ({_FORM}), h AS (SELECT * FROM f WHERE is_home), a AS (SELECT * FROM f WHERE NOT is_home)
      SELECT h.match_id, round(h.gs5, 6) AS home_goals_scored_last_5, round(a.pt5, 6) AS away_points_last_5, round(h.xf10, 6) AS home_xg_for_last_10, round(a.nx10, 6) + 0.0 AS away_npxgd_last_10,
        round(h.cs5, 6) AS home_clean_sheet_last_5, round(a.w10, 6) AS away_win_last_10, round(h.xf5 - a.xf5, 6) + 0.0 AS diff_xg_for_last_5, h.rest AS home_days_since_last, h.rest - a.rest AS rest_diff
      FROM h JOIN a USING (match_id)""",
    "imputed_xg": f"""
      WITH r AS ({RES}) SELECT match_id, round(coalesce(home_xg, avg(home_xg) OVER (PARTITION BY league), avg(home_xg) OVER ()), 6) AS home_xg, round(away_xg, 6) AS away_xg FROM r""",
    "imputed_form": f"""
      WITH f AS ({_FORM}), j AS (SELECT r.match_id, league, h.gs5 AS g, a.rest AS d FROM ({RES}) r JOIN f h ON h.match_id = r.match_id AND h.is_home JOIN f a ON a.match_id = r.match_id AND NOT a.is_home)
      SELECT match_id, round(coalesce(g, avg(g) OVER (PARTITION BY league)), 6) AS home_goals_scored_last_5, round(coalesce(d, avg(d) OVER (PARTITION BY league)), 6) AS away_days_since_last,
        CAST(g IS NULL OR d IS NULL AS INT) AS is_early_season FROM j""",
    "temporal_split": f"""
      SELECT match_id, CASE WHEN match_status <> 'Played' THEN 'fixture' WHEN season_end_year = 2000 THEN 'test' WHEN season_end_year = 1999 THEN 'val' ELSE 'train' END AS split FROM ({RES})""",
    "temporal_split_one_season": f"""
      WITH c AS (SELECT match_status = 'Played' AS p, count(*) AS n FROM ({RES}) GROUP BY 1), n AS (SELECT n FROM c WHERE p)
      SELECT 'fixture' AS split, n FROM c WHERE NOT p UNION ALL SELECT 'train', CAST(floor(n * 0.6) AS BIGINT) FROM n UNION ALL SELECT 'val', CAST(floor(n * 0.8) - floor(n * 0.6) AS BIGINT) FROM n
      UNION ALL SELECT 'test', CAST(n - floor(n * 0.8) AS BIGINT) FROM n""",
    "structural_features": f"""
      SELECT match_id, month(match_date) AS match_month, CASE result WHEN 'H' THEN 0 WHEN 'D' THEN 1 ELSE 2 END AS outcome_label, CAST(league = 'F' AS INT) AS league_F, CAST(league = 'O' AS INT) AS league_O,
        CAST(league = 'P' AS INT) AS league_P FROM ({RES})""",
    "lineup_ratings": f"""
      SELECT match_id, round({_SIDE('sr', 'O')}, 6) + 0.0 AS home_sum_rating, round({_SIDE('ar', 'F')}, 6) + 0.0 AS away_avg_rating, round({_SIDE('xr', 'O')}, 6) + 0.0 AS home_max_rating, round({_SIDE('nr', 'O')}, 6) + 0.0 AS home_min_rating,
        round({_SIDE('sd', 'F')}, 6) AS away_stdev_rating, round({_SIDE('defo', 'O')}, 6) AS home_avg_def_offense, round({_SIDE('midr', 'F')}, 6) + 0.0 AS away_avg_mid_rating, round({_SIDE('fwdd', 'O')}, 6) AS home_avg_fwd_defense,
        {_SIDE('nn', 'O')} AS home_n_rated_players, round({_SIDE('sr', 'O')} - {_SIDE('sr', 'F')}, 6) + 0.0 AS rating_diff, round({_SIDE('ss', 'O')} - {_SIDE('ss', 'F')}, 6) + 0.0 AS spm_diff
      FROM ({_LR}) GROUP BY match_id HAVING count(*) = 2""",
    "lineup_skills": f"""
      WITH t AS (SELECT match_id, side, avg(p_size / 30.0) AS sg, avg(p_size / 70.0) AS sa, avg(CASE WHEN p_partkey % 5 > 0 THEN p_retailprice / 700.0 ELSE 0 END) AS sd FROM ({_LU}) JOIN part ON p_partkey = l_partkey GROUP BY ALL),
      w AS (SELECT match_id, {', '.join(f"{_SIDE(c, s)} AS {c}{s}" for c in ('sg', 'sa', 'sd') for s in 'OF')} FROM t GROUP BY match_id HAVING count(*) = 2)
      SELECT match_id, round(sgO, 6) AS home_sk_att_goals, round(saO, 6) AS home_sk_att_assists, round(sdO, 6) AS home_sk_def_tackles_won, round((sgO + saO) / 2, 6) AS home_sk_att_composite, round(sdO, 6) AS home_sk_def_composite,
        round(sgF, 6) AS away_sk_att_goals, round(saF, 6) AS away_sk_att_assists, round(sdF, 6) AS away_sk_def_tackles_won, round((sgF + saF) / 2, 6) AS away_sk_att_composite, round(sdF, 6) AS away_sk_def_composite,
        round((sgO + saO) / 2 - (sgF + saF) / 2, 6) + 0.0 AS sk_att_diff, round(sdO - sdF, 6) + 0.0 AS sk_def_diff FROM w""",
    "upcoming_lineups": f"""
      WITH l AS (SELECT CAST(l_partkey % 10 AS VARCHAR) AS team_id, 'P' || l_partkey AS player_name, CAST(o_orderdate AS DATE) AS d FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber <= 5),
      k AS (SELECT * FROM l WHERE (team_id, d) IN (SELECT (team_id, max(d)) FROM l GROUP BY team_id)),
      f AS (SELECT s_suppkey AS match_id, CAST(s_suppkey % 12 AS VARCHAR) AS team_id, 'home' AS team_position FROM supplier WHERE s_suppkey % 9 > 0
            UNION ALL SELECT s_suppkey, CAST(s_suppkey % 11 AS VARCHAR), 'away' FROM supplier WHERE s_suppkey % 9 > 0)
      SELECT match_id, team_id, team_position, CASE WHEN count(k.player_name) = 0 THEN 11 ELSE count(k.player_name) END AS n, coalesce(min(k.player_name), 'Unknown_1') AS first_name
      FROM f LEFT JOIN k USING (team_id) GROUP BY ALL""",
    "played_results": """
      WITH s AS (SELECT l_orderkey AS match_id, max(CASE WHEN l_linestatus = 'O' THEN 'O' END) AS home_team, max(CASE WHEN l_linestatus = 'F' THEN 'F' END) AS away_team,
          CAST(min(CAST(l_shipdate AS DATE)) AS VARCHAR) AS match_date, min(l_returnflag) AS league FROM lineitem WHERE l_linenumber <= 5 GROUP BY 1),
      g AS (SELECT l_orderkey AS match_id, count(*) FILTER (l_linestatus = 'O' AND l_discount > 0.06) AS gh, count(*) FILTER (l_linestatus = 'F' AND l_discount > 0.06) AS ga FROM lineitem GROUP BY 1),
      p AS (SELECT match_id, match_date, league, home_team, away_team, CASE WHEN home_team IS NULL THEN 0 ELSE gh END AS home_goals, CASE WHEN away_team IS NULL THEN 0 ELSE ga END AS away_goals FROM s JOIN g USING (match_id))
      SELECT match_id, match_date, 'Played' AS match_status, league, 2000 AS season_end_year, home_team, away_team, home_goals, away_goals,
        CASE WHEN home_goals > away_goals THEN 'H' WHEN home_goals = away_goals THEN 'D' ELSE 'A' END AS result, CAST(league = 'A' AS INT) AS is_neutral_venue FROM p
      UNION ALL SELECT match_id, match_date, 'Fixture', league, 2000, home_team, away_team, NULL, NULL, NULL, CAST(league = 'A' AS INT) FROM p WHERE match_id % 10 = 0""",
    "multiclass_logloss": f"SELECT round(-avg(ln(greatest(least([h, d, a][y + 1], 1 - 1e-15), 1e-15))), 6) AS logloss FROM ({PRED})",
    "outcome_calibration": f"""
      WITH l AS (SELECT 'Home' AS outcome, h AS p, CAST(y = 0 AS INT) AS t FROM ({PRED}) UNION ALL SELECT 'Draw', d, CAST(y = 1 AS INT) FROM ({PRED}) UNION ALL SELECT 'Away', a, CAST(y = 2 AS INT) FROM ({PRED}))
      SELECT outcome, CAST(greatest(ceil(p * 10), 1) AS INT) AS bin, round(avg(p), 6) AS pred_mean, round(avg(t), 6) AS actual_mean, count(*) AS n FROM l GROUP BY ALL""",
    "goal_errors": f"""
      WITH m AS (SELECT avg(quality) AS mh, avg(toxic) AS ma FROM ({PRED}) WHERE doc_id % 2 = 0)
      SELECT round(sqrt(avg((quality - n_chars % 7 / 3.0) ** 2)), 6) AS home_rmse, round(sqrt(avg((toxic - n_chars % 5 / 3.0) ** 2)), 6) AS away_rmse,
        round(sqrt(avg((quality - mh) ** 2)), 6) AS baseline_home_rmse, round(sqrt(avg((toxic - ma) ** 2)), 6) AS baseline_away_rmse FROM ({PRED}), m""",
    "outcome_scores": f"""
      WITH p AS ({PRED}), s AS (SELECT [count(*) FILTER (y = 0) / count(*), count(*) FILTER (y = 1) / count(*), count(*) FILTER (y = 2) / count(*)] AS q FROM p WHERE doc_id % 2 = 0),
      z AS (SELECT *, [h, d, a] AS v, 1 / (1 + 10 ** (-elo / 400)) AS eh FROM p, s)
      SELECT count(*) AS n_test, round(-avg(ln(v[y + 1])), 6) AS logloss, round(avg(CAST(list_position(v, list_max(v)) - 1 = y AS INT)), 6) AS accuracy,
        round(avg((h - CAST(y = 0 AS INT)) ** 2 + (d - CAST(y = 1 AS INT)) ** 2 + (a - CAST(y = 2 AS INT)) ** 2), 6) AS brier, round(-avg(ln(greatest(q[y + 1], 1e-15))), 6) AS naive_logloss,
        round(avg(CAST(list_position(q, list_max(q)) - 1 = y AS INT)), 6) AS naive_accuracy,
        round(-avg(ln([eh * 0.72, 0.26, (1 - eh) * 0.72][y + 1] / (0.72 + 0.26))), 6) AS elo_logloss FROM z""",
    "league_scores": f"""
      SELECT league, count(*) AS n, round(avg(CAST(list_position([h, d, a], list_max([h, d, a])) - 1 = y AS INT)), 6) AS accuracy, round(-avg(ln([h, d, a][y + 1])), 6) AS logloss
      FROM ({PRED}) GROUP BY league HAVING count(*) >= 10""",
    "fixture_scores": f"""
      SELECT doc_id AS match_id, round(n_chars % 7 / 3.0, 2) AS pred_home_goals, round(n_chars % 5 / 3.0, 2) AS pred_away_goals, round(h, 3) AS prob_H, round(d, 3) AS prob_D, round(a, 3) AS prob_A,
        ['H', 'D', 'A'][list_position([h, d, a], list_max([h, d, a]))] AS predicted_result FROM ({PRED})""",
}
ROWS_ONLY = ["skill_parameters", "match_forecast"]
QUERIES = {name: globals()[name] for name in [*ORACLES, *ROWS_ONLY]}
