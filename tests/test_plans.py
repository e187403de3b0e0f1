"""The plans are the ones intended."""

import pytest

from touchline.operators import chains as C, value as V
from touchline.operators.ordering import HotGroups
from touchline.queries.roles import actions


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning")


def test_chains_and_labels_share_one_shuffle(spark, data):
    none = HotGroups([])
    df = C.possession_chains(actions(spark, data), hot=none)
    df = V.action_features(V.next_goal_labels(df, hot=none), hot=none)
    assert exchanges(df) == 1


def test_chain_summary_needs_no_second_shuffle(spark, data):
    df = C.chain_outcomes(C.possession_chains(actions(spark, data), hot=HotGroups([])))
    assert exchanges(df) == 1


def test_player_totals_shuffle_wide_sums_once(spark):
    from pyspark.sql import functions as F

    from touchline.operators import boxscore as B

    lines = spark.range(60).select(
        F.when(F.col("id") % 7 > 0, (F.col("id") % 7).cast("string")).alias("player_id"), F.when(F.col("id") % 5 > 0, F.col("id") % 5).alias("match_id"),
        F.when(F.col("id") % 7 > 0, F.lit("Ann")).alias("player_name"), F.lit("Striker").alias("position"), F.lit(30.0).alias("minsPlayed"), F.col("id").alias("goals"),
    )
    out = B.player_totals_c(lines, min_minutes=0)
    plan = out._jdf.queryExecution().executedPlan().toString().splitlines()
    assert not [line for line in plan if "Aggregate" in line and "match_id" in line.split("functions=")[0] and "sum(" in line]
    assert sum("Exchange hashpartitioning(_key" in line for line in plan) == exchanges(out) and exchanges(out) == 7
    rows = {r.player_id: r for r in out.collect()}
    assert len(rows) == 7 and rows["1"].n_matches == 4 and rows[None].n_matches == 4 and rows["1"].player_name == "Ann"
    assert rows[None].total_minutes == 270 and rows[None].is_fw == 0 and rows["3"].is_fw == 1


@pytest.mark.parametrize("name", ["box_score_scores", "box_score_blend", "box_score_model"])
def test_box_score_fits_free_what_their_rows_shuffled(spark, data, name, monkeypatch):
    from touchline.queries import all_queries, players

    class Freed(Exception):
        pass

    def freed(session):
        raise Freed

    monkeypatch.setattr(players, "free_shuffles", freed)
    with pytest.raises(Freed):
        all_queries()[name](spark, data)
