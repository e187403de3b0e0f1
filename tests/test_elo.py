import math
from datetime import date, timedelta

from pyspark.sql import functions as F

from touchline.operators import elo as E


def games():
    out = []
    for i in range(60):
        home, away = f"t{i % 5}", f"t{(i * 2 + 1) % 5}"
        if home != away:
            goals = (None, None) if i == 20 else (i % 4, (i * 7) % 3)
            out.append((f"m{i:02d}", date(2023, 11, 1) + timedelta(days=3 * i), home, away, *goals))
    return out


def one_by_one(rows):
    rating, before = {}, {}
    for m, _, home, away, hg, ag in rows:
        h, a = rating.get(home, 1500.0), rating.get(away, 1500.0)
        before[m] = (h, a)
        if hg is None:
            continue
        expected = 1 / (1 + 10 ** (-(h + 65 - a) / 400))
        actual = 1.0 if hg > ag else 0.5 if hg == ag else 0.0
        change = 20 * (math.log(abs(hg - ag) + 1) + 1) * (actual - expected)
        rating[home], rating[away] = h + change, a - change
    return before


def test_sweeps_equal_the_loop(spark):
    rows = games()
    schema = "match_id string, match_date date, home_team string, away_team string, home_goals int, away_goals int"
    df = spark.createDataFrame(rows, schema)
    want = one_by_one(rows)
    got = {r.match_id: (r.home_elo, r.away_elo) for r in E.match_elos(df, block=F.year("match_date"), tolerance=1e-9).collect()}
    assert got.keys() == want.keys()
    assert got["m00"] == (1500.0, 1500.0)
    assert max(abs(a - b) for m in want for a, b in zip(got[m], want[m])) < 1e-6


def test_points_are_conserved(spark):
    df = spark.createDataFrame([(1600.0, 1450.0, 3, 1), (1500.0, 1500.0, None, None)], "home_elo double, away_elo double, home_goals int, away_goals int")
    for r in E.update_elos(df).collect():
        assert abs(r.new_home_elo + r.new_away_elo - r.home_elo - r.away_elo) < 1e-10
