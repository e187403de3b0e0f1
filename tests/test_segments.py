from pyspark.sql import functions as F

from touchline.operators import segments as S

RESULTS = [("m1", "A", "B", 2024, "ENG")]


def tables(spark):
    results = spark.createDataFrame(RESULTS, "match_id string, home_team string, away_team string, season_end_year int, league string")
    events = spark.createDataFrame(
        [("m1", 10.0, "goal", True), ("m1", 30.0, "goal", False), ("m1", 60.0, "red_card", True), ("m1", 80.0, "substitution", False)],
        "match_id string, minute double, event_type string, is_home boolean",
    )
    shots = spark.createDataFrame(
        [("m1", 5.0, "A", 0.2, False, False), ("m1", 30.0, "B", 0.4, True, False), ("m1", 95.0, "A", 0.1, False, False), ("m1", 50.0, "A", 0.76, False, True)],
        "match_id string, minute double, team string, xg double, is_goal boolean, is_penalty boolean",
    )
    return results, events, shots


def test_boundaries_state_and_chances(spark):
    segs = S.build_segments(*tables(spark)).orderBy("segment_num").collect()
    assert [s.start_minute for s in segs] == [0, 10, 30, 46, 60, 80]
    assert segs[-1].end_minute == 95.5
    assert [s.gf_home for s in segs] == [0, 1, 1, 1, 1, 1]
    assert [s.ga_home for s in segs] == [0, 0, 1, 1, 1, 1]
    assert [s.goals_home for s in segs] == [0, 1, 0, 0, 0, 0]
    assert [s.n_players_home for s in segs] == [11, 11, 11, 11, 10, 10]
    assert round(sum(s.npxg_home for s in segs), 9) == 0.3
    assert segs[-1].npxg_home == 0.1


def test_event_counts(spark):
    events = spark.createDataFrame(
        [("m", 10, True), ("m", 30, False), ("m", 60, True), ("m", 80, False)], "match_id string, minute int, is_home boolean"
    )
    cuts = spark.createDataFrame([("m", m) for m in (0, 25, 50, 75, 91)], "match_id string, minute int")
    got = S.events_by_segment(events, cuts).orderBy("segment_num").collect()
    assert [r.home_before for r in got] == [0, 1, 1, 2]
    assert [r.away_before for r in got] == [0, 0, 1, 1]
    assert [r.home_within for r in got] == [1, 0, 1, 0]
    assert [r.away_within for r in got] == [0, 1, 0, 1]


def test_effective_clock(spark):
    df = spark.createDataFrame([(45.0, 2.0), (46.0, 0.0), (90.0, 4.0)], "minute double, added double")
    got = df.select(S.effective_minute("minute", "added", F.lit(3)).alias("e")).collect()
    assert [r.e for r in got] == [47, 49, 97]


def test_segment_join_is_keyed(spark):
    results, events, shots = tables(spark)
    lineups = spark.createDataFrame(
        [("m1", "A", True, "x", "1", 0.0, 90.0, 90.0, True)],
        "match_id string, team string, is_home boolean, player_name string, player_id string, on_minute double, off_minute double, minutes double, is_starter boolean",
    )
    players = S.assign_players(S.build_segments(results, events, shots), lineups)
    plan = players._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    assert players.count() == 6


def test_goals_and_reds_fall_back_per_match(spark):
    results = spark.createDataFrame(
        [("m1", "A", "B"), ("m2", "A", "B")], "match_id string, home_team string, away_team string"
    )
    events = spark.createDataFrame([("m1", 10.0, "goal", True)], "match_id string, minute double, event_type string, is_home boolean")
    shots = spark.createDataFrame(
        [("m1", 20.0, "B", 0.1, True, False), ("m2", 20.0, "B", 0.1, True, False)],
        "match_id string, minute double, team string, xg double, is_goal boolean, is_penalty boolean",
    )
    lineups = spark.createDataFrame(
        [("m2", "A", 1, 55.0, 0.0, True, 55.0)],
        "match_id string, team string, crd_r int, off_minute double, on_minute double, is_starter boolean, minutes double",
    )
    segs = S.build_segments(results, events, shots, lineups).orderBy("match_id", "segment_num").collect()
    starts = lambda m: [s.start_minute for s in segs if s.match_id == m]
    assert starts("m1") == [0, 10, 46]
    assert starts("m2") == [0, 20, 46, 55]
    assert [s.ga_home for s in segs if s.match_id == "m2"] == [0, 1, 1, 1]
    assert [s.red_home for s in segs if s.match_id == "m2"] == [0, 0, 0, 1]
