"""Chunked work on hot groups gives the same rows as whole-group windows."""

from pyspark.sql import functions as F

from touchline.operators import actions as A, chains as C
from touchline.operators.ordering import HotGroups, Ordering, hot_groups, split_hot
from touchline.operators.ranking import exact_quantiles, ranged_counts, with_ranks
from touchline.queries.roles import actions, match_events


def skewed(df, key="match_id"):
    """A third of all rows under one key."""
    return df.withColumn(key, F.when(F.col("_n") % 3 == 0, 7).otherwise(F.col(key))).drop("_n")


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_primitives(spark, data):
    df = skewed(actions(spark, data).withColumn("_n", F.col("action_id")))
    order = Ordering(("match_id",), ("time_seconds", "action_id"), "time_seconds")

    def build(d, o):
        d = o.shift(d, {"l1": ("action_type", 1), "l3": ("xg", 3), "n2": ("xg", -2)})
        d = o.running_sum(d, {"n": F.lit(1).cast("long")})
        d = o.last_known(d, {"shot_x": F.when(F.col("action_type") == "shot", F.col("start_x"))})
        d = o.first_later(d, "next", F.col("action_id"), F.col("action_type") == "shot", "time_seconds")
        return o.previous_mean(d, {"m5": (F.col("start_x"), 5)}).select(
            "action_id", "l1", F.round("l3", 9), F.round("n2", 9), "n", "shot_x", "next", F.round("m5", 6)
        )

    plain = split_hot(df, order, build, hot=HotGroups([]))
    hot = hot_groups(df, ("match_id",), min_rows=40)
    assert any(r["match_id"] == 7 for r in hot.rows)
    assert rows(plain, "action_id") == rows(split_hot(df, order, build, hot=hot), "action_id")


def test_no_hot_groups_by_default(spark, data):
    assert hot_groups(actions(spark, data), ("match_id",)).rows == []


def test_conversion_and_chains(spark, data):
    df = skewed(match_events(spark, data).withColumn("_n", F.col("event_id")))
    hot = hot_groups(df, ("match_id",), min_rows=40)
    for h in (hot,):
        plain = A.to_actions(df, hot=HotGroups([]))
        chunked = A.to_actions(df, hot=h)
        assert rows(plain, "match_id", "action_id") == rows(chunked, "match_id", "action_id")
        one = C.possession_chains(plain, gap_seconds=3, hot=HotGroups([]))
        two = C.possession_chains(plain, gap_seconds=3, hot=h).select(*one.columns)
        assert rows(one, "match_id", "action_id") == rows(two, "match_id", "action_id")


def test_ranks_with_heavy_ties(spark):
    df = spark.range(300).select("id", F.when(F.col("id") < 100, 5.0).otherwise(F.col("id") % 17).alias("v"))
    pdf = df.toPandas()
    got = with_ranks(df, "v", rank_avg="r", share_at_most="s").toPandas().sort_values("id")
    assert (got["r"].to_numpy() == pdf["v"].rank().to_numpy()).all()
    assert (got["s"].to_numpy() == pdf["v"].rank(method="max", pct=True).to_numpy()).all()


def test_quantiles_interpolate(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "v double")
    row = exact_quantiles(df, "v", {"a": 0.4, "m": 0.5, "top": 1.0}).first()
    assert (round(row.a, 9), row.m, row.top) == (2.2, 2.5, 10.0)


def test_a_large_group_is_cut_into_ranges(spark):
    """One of three groups has nine tenths of the rows, all distinct: its ranges are as large as the others'."""
    key = F.when(F.col("id") < 54_000, "big").when(F.col("id") < 57_000, "b").otherwise("c")
    df = spark.range(60_000).select(key.alias("k"), F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("v"))
    ranges = ranged_counts(df, "v", ["k"])
    sizes = {r[0]: r[1] for r in ranges.groupBy("_range").count().collect()}
    assert len(sizes) >= 4 and max(sizes.values()) < 2 * sum(sizes.values()) / len(sizes)
    got = with_ranks(df, "v", ["k"], rank_min="r", rank_min_desc="d", share_at_most="s").toPandas()
    for _, own in got.groupby("k"):
        assert (own.sort_values("v").r.to_numpy() == range(1, len(own) + 1)).all()
        assert (own.r + own.d == len(own) + 1).all() and abs(own.s.max() - 1) < 1e-12
