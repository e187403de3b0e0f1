"""The given tables in football roles, as Spark frames and as the same SQL for the check."""

from pyspark.sql import DataFrame, SparkSession, functions as F

D = "double"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of summation does not show."""
    return df.select(
        *[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == D else F.col(c) for c, t in df.dtypes]
    )


def match_events(spark: SparkSession, folder: str) -> DataFrame:
    """Raw match events: match = user, clock = quarter days, code and coordinates from ids."""
    e = table(spark, folder, "events")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    clock = F.datediff(F.to_date("ts"), F.lit("2024-01-01")) * 4 + F.floor(F.hour("ts") / 6).cast("int")
    e = e.select("*", k.alias("k"), clock.alias("clock"))
    code = (
        F.when(F.col("event_type") == "click", 1)
        .when(F.col("event_type") == "purchase", 13 + F.col("k") % 4)
        .when(F.col("event_type") == "error", 4)
        .when(F.col("event_type") == "signup", F.when(F.col("k") % 2 == 0, 3).otherwise(44))
        .when(F.col("k") % 5 == 0, 5)
        .when(F.col("k") % 3 == 0, 12)
        .otherwise(7)
    )
    spot = lambda factor: (F.col("event_id") * factor % 100).cast("double")
    return e.select(
        F.col("user_id").alias("match_id"),
        "event_id",
        F.when(F.col("clock") < 60, 1).otherwise(2).alias("period_id"),
        F.floor(F.col("clock") / 60).cast("int").alias("minute"),
        (F.col("clock") % 60).alias("second"),
        code.alias("type_id"),
        F.when(F.col("event_id") % 3 > 0, 1).otherwise(0).alias("outcome"),
        (F.col("k") % 2).cast("int").alias("team_id"),
        F.col("k").alias("player_id"),
        F.when(F.col("k") == 13, "").otherwise(F.concat(F.lit("P"), F.col("k"))).alias("player_name"),
        F.col("k").cast("double").alias("x"),
        spot(7).alias("y"),
        F.when(F.col("event_id") % 4 == 0, 0.0).otherwise(spot(13)).alias("end_x"),
        spot(29).alias("end_y"),
        F.concat(F.lit('{"'), F.col("k"), F.lit('": null}')).alias("qualifier_json"),
        "value",
    )


MATCH_EVENTS = """
  SELECT user_id AS match_id, event_id,
    CASE WHEN clock < 60 THEN 1 ELSE 2 END AS period_id,
    clock // 60 AS minute, clock % 60 AS second,
    CASE WHEN event_type = 'click' THEN 1
         WHEN event_type = 'purchase' THEN 13 + k % 4
         WHEN event_type = 'error' THEN 4
         WHEN event_type = 'signup' THEN CASE WHEN k % 2 = 0 THEN 3 ELSE 44 END
         WHEN k % 5 = 0 THEN 5 WHEN k % 3 = 0 THEN 12 ELSE 7 END AS type_id,
    CASE WHEN event_id % 3 > 0 THEN 1 ELSE 0 END AS outcome,
    k % 2 AS team_id, k AS player_id,
    CASE WHEN k = 13 THEN '' ELSE 'P' || k END AS player_name,
    CAST(k AS DOUBLE) AS x, CAST(event_id * 7 % 100 AS DOUBLE) AS y,
    CASE WHEN event_id % 4 = 0 THEN 0.0 ELSE CAST(event_id * 13 % 100 AS DOUBLE) END AS end_x,
    CAST(event_id * 29 % 100 AS DOUBLE) AS end_y,
    '{"' || k || '": null}' AS qualifier_json, value
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
          date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 4 + hour(ts) // 6 AS clock
        FROM events)
"""


def actions(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical actions straight from the events table, with a scoring chance for shots."""
    e = match_events(spark, folder)
    name = (
        F.when(F.col("type_id") == 1, "pass")
        .when(F.col("type_id") >= 44, "aerial")
        .when(F.col("type_id") >= 13, "shot")
        .when(F.col("type_id") == 4, "foul")
        .when(F.col("type_id") == 3, "take_on")
        .when(F.col("type_id") == 12, "clearance")
        .when(F.col("type_id") == 7, "tackle")
        .otherwise("interception")
    )
    ok = F.when(F.col("type_id").between(13, 16), F.col("type_id") == 16).otherwise(F.col("outcome") == 1)
    return e.select(
        "match_id",
        F.col("event_id").alias("action_id"),
        "period_id",
        (F.col("minute") * 60 + F.col("second")).cast("long").alias("time_seconds"),
        "team_id",
        "player_id",
        "player_name",
        F.col("x").alias("start_x"),
        F.col("y").alias("start_y"),
        "end_x",
        "end_y",
        name.alias("action_type"),
        "type_id",
        F.when(ok, "success").otherwise("fail").alias("result"),
        F.when(F.col("player_id") % 7 == 0, "head").otherwise("foot").alias("bodypart"),
        F.when(F.col("type_id").between(13, 16), F.col("value") / (F.col("value") + 100.0))
        .otherwise(0.0)
        .alias("xg"),
    )


ACTIONS = f"""
  SELECT match_id, event_id AS action_id, period_id,
    CAST(minute * 60 + second AS BIGINT) AS time_seconds, team_id, player_id, player_name,
    x AS start_x, y AS start_y, end_x, end_y,
    CASE WHEN type_id = 1 THEN 'pass' WHEN type_id >= 44 THEN 'aerial' WHEN type_id >= 13 THEN 'shot'
         WHEN type_id = 4 THEN 'foul' WHEN type_id = 3 THEN 'take_on' WHEN type_id = 12 THEN 'clearance'
         WHEN type_id = 7 THEN 'tackle' ELSE 'interception' END AS action_type,
    type_id,
    CASE WHEN CASE WHEN type_id BETWEEN 13 AND 16 THEN type_id = 16 ELSE outcome = 1 END
         THEN 'success' ELSE 'fail' END AS result,
    CASE WHEN player_id % 7 = 0 THEN 'head' ELSE 'foot' END AS bodypart,
    CASE WHEN type_id BETWEEN 13 AND 16 THEN value / (value + 100.0) ELSE 0.0 END AS xg
  FROM ({MATCH_EVENTS})
"""
