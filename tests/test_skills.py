from datetime import date, timedelta

import pytest

from touchline.operators import skills as K

SCHEMA = (
    "player_id int, player_name string, match_id string, match_date date, total_minutes int, position string, "
    "goals_p90 double, pass_accuracy double, passes int"
)


def stats(spark, values, player=1, start=date(2024, 1, 1), acc=0.8, passes=40):
    return [
        (player, f"P{player}", f"{player}-{i}", start + timedelta(days=7 * i), 90, "Striker", float(v), acc, passes)
        for i, v in enumerate(values)
    ]


def test_much_data_beats_the_prior(spark):
    rows = stats(spark, [1.0] * 150) + stats(spark, [0.0] * 150, player=2)
    params = K.DecayParams(rate=0.0)
    out = {r.player_id: r.goals_p90 for r in K.player_skills(spark.createDataFrame(rows, SCHEMA), date(2030, 1, 1), params).collect()}
    assert abs(out[1] - 1) < 0.02 and abs(out[2]) < 0.02


def test_few_matches_stay_near_the_prior(spark):
    rows = stats(spark, [5.0]) + [r for p in range(2, 30) for r in stats(spark, [0.2] * 20, player=p)]
    out = {r.player_id: r.goals_p90 for r in K.player_skills(spark.createDataFrame(rows, SCHEMA), date(2024, 1, 3)).collect()}
    assert 0.2 < out[1] < 3


def test_recent_matches_count_more(spark):
    up, down = [0.0] * 20 + [1.0] * 20, [1.0] * 20 + [0.0] * 20
    df = spark.createDataFrame(stats(spark, up) + stats(spark, down, player=2), SCHEMA)
    out = {r.player_id: r.goals_p90 for r in K.player_skills(df, date(2024, 12, 1), K.DecayParams(rate=0.01)).collect()}
    assert out[1] > out[2]


def test_history_is_strictly_before(spark):
    df = spark.createDataFrame(stats(spark, [1.0, 9.0]), SCHEMA)
    row = K.player_skills(df, date(2024, 1, 8)).first()
    assert abs(row.goals_p90 - 1.0) < 1e-9


def test_ratio_skill_stays_inside(spark):
    df = spark.createDataFrame(stats(spark, [0.0] * 5, acc=1.0), SCHEMA)
    assert K.player_skills(df, date(2025, 1, 1)).first().pass_accuracy < 1


def test_search_computes_its_matches_once(spark):
    from pyspark.sql import functions as F

    from touchline.operators import skill_search as SS

    n = 400
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def minutes(i):
        seen.add(1)
        return 30.0 + i % 60

    matches = spark.range(n).select(
        (F.col("id") % 9).alias("player_id"), F.lit("p").alias("player_name"), F.col("id").alias("match_id"),
        F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("match_date"), F.lit("Striker").alias("position"),
        minutes("id").alias("total_minutes"), (F.col("id") % 5 / 3.0).alias("goals_p90"), (F.col("id") % 4 / 2.0).alias("shots_p90"),
    )
    kept = spark.sparkContext._jsc.getPersistentRDDs().size()
    _, found = SS.search_all(matches, stats=["goals_p90", "shots_p90"], rounds=3, points=3)
    assert found.count() == 2 and seen.value <= 3 * n
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == kept


def _exchanges(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.split("== Initial Plan ==")[-1].splitlines() if " Exchange " in line and "player_id" in line]


def test_skills_of_many_dates_shuffle_matches_by_player_once(spark):
    from datetime import date

    from pyspark.sql import functions as F

    from touchline.operators import skills as SK

    matches = spark.range(200).select(
        (F.col("id") % 9).alias("player_id"), F.lit("p").alias("player_name"), F.col("id").alias("match_id"),
        F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("match_date"),
        F.when(F.col("id") % 3 > 0, "Striker").alias("position"), F.lit(90.0).alias("total_minutes"), (F.col("id") % 5 / 3.0).alias("goals_p90"),
    )
    out = SK.skills_at(matches, [date(2020, 3, 1), date(2020, 6, 1)], stats=["goals_p90"])
    assert len(_exchanges(out.drop("player_name"))) == 1 and out.count() == 18


@pytest.mark.parametrize("name", ["skill_backtest", "skill_backtest_accuracy"])
def test_backtest_deals_out_columns_not_sums(spark, data, name):
    from touchline.queries import all_queries

    plan = all_queries()[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    at = next(i for i, line in enumerate(lines) if "RepartitionByExpression [player_id" in line)
    assert "AS _x0_0" in "".join(lines[:at]) and "_x0_0" not in "".join(lines[at:]) and "scalar-subquery" not in plan
