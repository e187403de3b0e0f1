"""Queries over the linear fits, each with SQL that solves the same equations by plain iteration."""

from pyspark.sql import functions as F

from touchline.operators import elastic_net as E, ridge as RG
from touchline.operators.design import Design
from touchline.queries.roles import rounded, table

LAMBDA = 0.2


def _player_rows(spark, folder):
    """Order lines as ridge rows: an attacker, a defender, a league dummy, one covariate, three seasons, matches of four lines or so."""
    li = table(spark, folder, "lineitem")
    tokens = F.array_compact(F.array(
        F.concat(F.lit("s"), F.col("l_suppkey") % 12, F.lit("_off")), F.concat(F.lit("p"), F.col("l_partkey") % 15, F.lit("_def")),
        F.when(F.col("l_returnflag") == "R", F.lit("league_R")),
    ))
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("row_id"), F.col("l_orderkey").alias("match_id"), (F.col("l_orderkey") % 3).cast("int").alias("season"),
        (F.col("l_extendedprice") / 1e4 + F.col("l_suppkey") % 12 / 4.0 - F.col("l_partkey") % 15 / 6.0).alias("y"),
        F.col("l_quantity").cast("double").alias("weight"), F.col("l_linenumber").cast("double").alias("gd"), tokens.alias("tokens"),
    )


def _prior(spark, folder):
    """A prior for every attacker, as many as there are numbers of suppliers modulo twelve."""
    k = (F.col("s_suppkey") % 12).cast("int")
    return table(spark, folder, "supplier").select(F.concat(F.lit("s"), k, F.lit("_off")).alias("feature"), (k / 10.0).alias("prior")).distinct()


def _coefficients(fit, lam: float = LAMBDA):
    out = fit.table(lam).select("feature", "coefficient")
    return out.unionByName(out.sparkSession.createDataFrame([("(intercept)", float(fit.intercepts[0]))], "feature string, coefficient double"))


def ridge_player_columns(spark, folder):
    """All columns of a sparse ridge, players, league and covariate, by conjugate gradients over the rows."""
    design = Design(_player_rows(spark, folder), None, ["gd"], ["league_"])
    return rounded(_coefficients(RG.fit_ridge(design, lambdas=[LAMBDA], n_folds=2, solver="krylov")))


def ridge_with_prior(spark, folder):
    """Prior plus deviation of every attacker."""
    design = Design(_player_rows(spark, folder), None, ["gd"], ["league_"])
    prior = _prior(spark, folder)
    table_ = _coefficients(RG.fit_ridge_with_prior(design, prior, lambdas=[LAMBDA], n_folds=2))
    out = table_.join(prior, "feature", "left").na.fill(0.0, ["prior"])
    return rounded(out.select("feature", "prior", F.col("coefficient").alias("deviation"), (F.col("prior") + F.col("coefficient")).alias("final")))


def season_fits(spark, folder):
    """Three seasons and two targets, what the priors leave over included, from one pass over the rows."""
    rows = RG.prior_offset(_player_rows(spark, folder), _prior(spark, folder)).withColumn("y_left", F.col("y") - F.col("offset"))
    fits = RG.fit_ridge_by(Design(rows, None, ["gd"], ["league_"]), "season", {"plain": "y", "left": "y_left"}, lambdas=[LAMBDA], n_folds=2, lam=LAMBDA)
    return rounded(fits.select("season", "target", "feature", "coefficient", "is_covariate"))


def ridge_paths(spark, folder):
    """The whole path's choice of penalty per season: the error of every point, on five folds."""
    design = Design(_player_rows(spark, folder), None, ["gd"], ["league_"])
    fit = RG.fit_ridge(design, n_lambdas=20, n_folds=5, solver="krylov")
    return rounded(fit.cv_table().select("lambda", "mean_error", "error_sd"))


def elastic_net_two_predictors(spark, folder):
    """Both coefficients and the intercept of an elastic net at one penalty, weighted by the root of minutes."""
    data = table(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("player_id"), F.col("p_retailprice").alias("total_minutes"),
        F.sin("p_retailprice").alias("a_p90"), (F.col("p_size") / 50.0 + F.sin("p_retailprice") / 4.0).alias("b_p90"),
        (F.sin("p_retailprice") + F.col("p_size") / 25.0 + F.cos(F.col("p_partkey").cast("double"))).alias("rapm"),
    )
    fit = E.fit_elastic_net(data, ["a_p90", "b_p90"], lambdas=[0.3], n_folds=2)
    return rounded(_coefficients(fit, 0.3), 5)


QUERIES = {"elastic_net_two_predictors": elastic_net_two_predictors, "ridge_player_columns": ridge_player_columns, "ridge_with_prior": ridge_with_prior, "season_fits": season_fits, "ridge_paths": ridge_paths}

_ROWS = """
  SELECT row_number() OVER () AS id, l_orderkey % 3 AS season, l_quantity * 1.0 AS w, l_linenumber * 1.0 AS gd,
    l_extendedprice / 1e4 + l_suppkey % 12 / 4.0 - l_partkey % 15 / 6.0 AS y, (l_suppkey % 12) / 10.0 AS off,
    list_filter([concat('s', l_suppkey % 12, '_off'), concat('p', l_partkey % 15, '_def'), CASE WHEN l_returnflag = 'R' THEN 'league_R' END], lambda x: x IS NOT NULL) AS tokens
  FROM lineitem"""


def _solved(rows: str) -> str:
    """CTEs ending in `solved(k, f, free, beta)`: ridge per key k with free columns projected out, by 120 steps of Richardson's iteration.

    `rows` gives k, id, w, y, gd, tokens. The penalised part's largest eigenvalue is below its largest row sum.
    """
    return f"""
  r AS ({rows}),
  t AS (SELECT k, sum(w) AS n, sum(w * y) / sum(w) AS my, sum(w * y * y) / sum(w) - (sum(w * y) / sum(w)) ** 2 AS vy FROM r GROUP BY k),
  x AS (SELECT k, id, w, y, unnest(tokens) AS f, 1.0 AS v FROM r UNION ALL SELECT k, id, w, y, 'gd', gd FROM r),
  m AS (SELECT x.k, f, sum(w * v) / any_value(n) AS mean, sum(w * v * y) / any_value(n) - sum(w * v) / any_value(n) * any_value(my) AS xy, f IN ('gd', 'league_R') AS free FROM x JOIN t ON t.k = x.k GROUP BY x.k, f),
  p AS (SELECT a.k, a.f AS i, b.f AS j, sum(a.w * a.v * b.v) AS s FROM x a JOIN x b ON a.k = b.k AND a.id = b.id GROUP BY ALL),
  g AS (SELECT a.k, a.f AS i, b.f AS j, a.free AS ifree, b.free AS jfree, coalesce(p.s, 0) / t.n - a.mean * b.mean AS c FROM m a JOIN m b ON a.k = b.k JOIN t ON t.k = a.k LEFT JOIN p ON p.k = a.k AND p.i = a.f AND p.j = b.f),
  z AS (SELECT a.k, a.c AS aa, b.c AS bb, d.c AS ab, a.c * b.c - d.c * d.c AS det FROM g a JOIN g b ON a.k = b.k AND b.i = 'league_R' AND b.j = 'league_R' JOIN g d ON d.k = a.k AND d.i = 'gd' AND d.j = 'league_R' WHERE a.i = 'gd' AND a.j = 'gd'),
  u AS (SELECT z.k, i, j, v FROM z, LATERAL (VALUES ('gd', 'gd', bb / det), ('gd', 'league_R', -ab / det), ('league_R', 'gd', -ab / det), ('league_R', 'league_R', aa / det)) q(i, j, v)),
  h AS (SELECT g.k, g.i, g.j, g.c - (SELECT sum(a.c * u.v * b.c) FROM u JOIN g a ON a.k = u.k AND a.j = u.i AND a.i = g.i JOIN g b ON b.k = u.k AND b.i = u.j AND b.j = g.j WHERE u.k = g.k) AS c FROM g WHERE NOT ifree AND NOT jfree),
  b AS (SELECT m.k, m.f, m.xy - (SELECT sum(a.c * u.v * q.xy) FROM u JOIN g a ON a.k = u.k AND a.j = u.i AND a.i = m.f JOIN m q ON q.k = u.k AND q.f = u.j WHERE u.k = m.k) AS b FROM m WHERE NOT free),
  o AS (SELECT m.k, {LAMBDA} * count(*) / count(*) FILTER (WHERE NOT free) / sqrt(any_value(vy)) AS o FROM m JOIN t ON t.k = m.k GROUP BY m.k),
  e AS (SELECT h.k, 2 / (max(row) + 2 * any_value(o)) AS tau FROM (SELECT k, i, sum(abs(c)) AS row FROM h GROUP BY k, i) h JOIN o ON o.k = h.k GROUP BY h.k),
  it AS (
    SELECT k, f, 0::DOUBLE AS beta, 0 AS step FROM b
    UNION ALL
    SELECT k, f, beta, step FROM (
      SELECT h.k, h.i AS f, any_value(b.b) * any_value(tau) + sum(CASE WHEN h.i = h.j THEN it.beta ELSE 0 END) * (1 - any_value(tau) * any_value(o)) - any_value(tau) * sum(h.c * it.beta) AS beta, any_value(it.step) + 1 AS step
      FROM it JOIN h ON h.k = it.k AND h.j = it.f JOIN b ON b.k = h.k AND b.f = h.i JOIN o ON o.k = h.k JOIN e ON e.k = h.k GROUP BY h.k, h.i
    ) WHERE step <= 120
  ),
  held AS (SELECT k, f, beta FROM it WHERE step = 120),
  loose AS (SELECT u.k, u.i AS f, sum(u.v * (m.xy - c.s)) AS beta FROM u JOIN m ON m.k = u.k AND m.f = u.j JOIN (SELECT g.k, g.i, sum(g.c * held.beta) AS s FROM g JOIN held ON held.k = g.k AND held.f = g.j GROUP BY g.k, g.i) c ON c.k = u.k AND c.i = u.j GROUP BY u.k, u.i),
  every AS (SELECT k, f, false AS free, beta FROM held UNION ALL SELECT k, f, true, beta FROM loose),
  solved AS (SELECT * FROM every UNION ALL SELECT t.k, '(intercept)', true, any_value(my) - sum(m.mean * every.beta) FROM t JOIN every ON every.k = t.k JOIN m ON m.k = t.k AND m.f = every.f GROUP BY t.k)"""


ORACLES = {
    "ridge_player_columns": f"WITH RECURSIVE {_solved('SELECT 0 AS k, id, w, y, gd, tokens FROM (' + _ROWS + ')')} SELECT f AS feature, round(beta, 6) + 0 AS coefficient FROM solved",
    "ridge_with_prior": f"""WITH RECURSIVE {_solved('SELECT 0 AS k, id, w, y - off AS y, gd, tokens FROM (' + _ROWS + ')')}
      SELECT f AS feature, round(p, 6) AS prior, round(beta, 6) + 0 AS deviation, round(p + beta, 6) + 0 AS final
      FROM (SELECT *, CASE WHEN f LIKE 's%_off' THEN CAST(regexp_extract(f, '[0-9]+') AS INT) / 10.0 ELSE 0 END AS p FROM solved)""",
    "season_fits": f"""WITH RECURSIVE {_solved("SELECT concat(season, ':', q.target) AS k, id, w, y - CASE WHEN q.target = 'left' THEN off ELSE 0 END AS y, gd, tokens FROM (" + _ROWS + ") CROSS JOIN (VALUES ('plain'), ('left')) q(target)")}
      SELECT CAST(split_part(k, ':', 1) AS INT) AS season, split_part(k, ':', 2) AS target, f AS feature, round(beta, 6) + 0 AS coefficient, free AS is_covariate FROM solved""",
    # each coefficient in turn, given the other, on the scale of unit variances
    "elastic_net_two_predictors": """WITH RECURSIVE
      d AS (SELECT sqrt(p_retailprice) AS w, sin(p_retailprice) AS a, p_size / 50.0 + sin(p_retailprice) / 4.0 AS b, sin(p_retailprice) + p_size / 25.0 + cos(p_partkey) AS y FROM part),
      m AS (SELECT sum(w * a) / sum(w) AS a, sum(w * b) / sum(w) AS b, sum(w * y) / sum(w) AS y FROM d),
      v AS (SELECT sum(w * (d.a - m.a) ** 2) / sum(w) AS aa, sum(w * (d.b - m.b) ** 2) / sum(w) AS bb, sum(w * (d.y - m.y) ** 2) / sum(w) AS yy, sum(w * (d.a - m.a) * (d.b - m.b)) / sum(w) AS ab,
        sum(w * (d.a - m.a) * (d.y - m.y)) / sum(w) AS ay, sum(w * (d.b - m.b) * (d.y - m.y)) / sum(w) AS uy FROM d, m),
      r AS (SELECT ab / sqrt(aa * bb) AS c, ay / sqrt(aa * yy) AS ra, uy / sqrt(bb * yy) AS rb, 0.3 / sqrt(yy) AS l, sqrt(yy / aa) AS sa, sqrt(yy / bb) AS sb FROM v),
      it AS (SELECT 0 AS step, 0::DOUBLE AS x, 0::DOUBLE AS z UNION ALL
        SELECT step + 1, x, sign(rb - c * x) * greatest(abs(rb - c * x) - l / 2, 0) / (1 + l / 2) FROM (
          SELECT step, sign(ra - c * z) * greatest(abs(ra - c * z) - l / 2, 0) / (1 + l / 2) AS x, c, rb, l FROM it, r WHERE step < 200)),
      s AS (SELECT x * sa AS x, z * sb AS z FROM it, r WHERE step = 200)
      SELECT 'a_p90' AS feature, round(x, 5) AS coefficient FROM s UNION ALL SELECT 'b_p90', round(z, 5) FROM s UNION ALL SELECT '(intercept)', round(m.y - x * m.a - z * m.b, 5) FROM s, m""",
}
