"""Match data set, goal and outcome models, and fixture scoring."""

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame, functions as F

from touchline.functions.seasons import season_end_year
from touchline.operators.boosting import BoostedModel, fit_boosted
from touchline.session import local_rows

GOAL_FEATURES = ["pred_home_goals", "pred_away_goals", "pred_goal_diff", "pred_total_goals"]
# Columns of the fixture table, and competitions on neutral grounds.
FIXTURE_COLUMNS = [
    "match_id", "match_date", "match_status", "league", "season", "season_end_year", "home_team", "away_team",
    "home_team_id", "away_team_id", "home_goals", "away_goals", "home_xg", "away_xg", "result", "is_neutral_venue",
]


def played_results(lineups: DataFrame, events: DataFrame, tournaments: list[str] = ()) -> DataFrame:
    """Results from starters and goal events: teams, goals (0 without any), label H, D or A."""
    of = lambda side, c: F.min(F.when(F.lower("team_position") == side, F.col(c)))
    info = lineups.where(F.col("is_starter")).groupBy("match_id").agg(
        of("home", "team_name").alias("home_team"),
        of("away", "team_name").alias("away_team"),
        of("home", "team_id").alias("home_team_id"),
        of("away", "team_id").alias("away_team_id"),
        F.min("match_date").alias("match_date"),
        F.min("league").alias("league"),
        F.min("season").alias("season"),
    )
    goals = events.where(F.col("event_type") == "goal").groupBy("match_id", "team_id").agg(
        F.count(F.lit(1)).alias("goals")
    )
    for side in ("home", "away"):
        own = goals.select("match_id", F.col("team_id").alias(f"{side}_team_id"), F.col("goals").alias(f"{side}_goals"))
        info = info.join(own, ["match_id", f"{side}_team_id"], "left")
    info = info.na.fill(0, ["home_goals", "away_goals"])
    won, level = F.col("home_goals") > F.col("away_goals"), F.col("home_goals") == F.col("away_goals")
    return info.withColumns(
        {
            "season_end_year": season_end_year("season"),
            "home_xg": F.lit(None).cast("double"),
            "away_xg": F.lit(None).cast("double"),
            "result": F.when(won, "H").when(level, "D").otherwise("A"),
            "match_status": F.lit("Played"),
            "is_neutral_venue": F.col("league").isin(list(tournaments)).cast("int"),
        }
    )


def fixture_results(played: DataFrame, fixtures: DataFrame | None) -> DataFrame:
    """Played and upcoming matches in one table with one set of columns."""
    union = played
    if fixtures is not None:
        union = played.unionByName(fixtures.drop("home_goals", "away_goals", "result"), allowMissingColumns=True)
    present = union.columns
    return union.select(*[F.col(c) if c in present else F.lit(None).alias(c) for c in FIXTURE_COLUMNS])


def form_columns(columns: list[str]) -> list[str]:
    import re

    return [c for c in columns if re.search(r"_last_\d+$|days_since_last", c)]


def impute_form(df: DataFrame) -> DataFrame:
    """Flag matches with missing form, fill it with league means, overall means, then 0. All means come from one pass, a row a league."""
    columns = form_columns(df.columns)
    if not columns:
        return df.withColumn("is_early_season", F.lit(0)).na.fill(0)
    missing = F.col(columns[0]).isNull()
    for c in columns[1:]:
        missing = missing | F.col(c).isNull()
    sums = local_rows(
        df.groupBy("league").agg(F.count(F.lit(1)).alias("_rows"), *[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("s", F.sum), ("n", F.count))])
    )
    mean = lambda c: F.try_divide(f"_s_{c}", f"_n_{c}")
    leagues = sums.select("league", F.struct(*[mean(c).alias(c) for c in columns]).alias("_league"))
    joined = df.withColumn("is_early_season", missing.cast("int")).join(leagues, "league", "left")
    filled = joined.withColumns({c: F.coalesce(F.col(c), F.col(f"_league.{c}")) for c in columns}).drop("_league")
    # The overall mean is taken after the league means have been filled in: a league with a mean counts with all its rows.
    full = lambda c: F.col("league").isNotNull() & (F.col(f"_n_{c}") > 0)
    total = lambda c: F.sum(F.when(full(c), F.col("_rows") * mean(c)).otherwise(F.col(f"_s_{c}")))
    n = lambda c: F.sum(F.when(full(c), F.col("_rows")).otherwise(F.col(f"_n_{c}")))
    overall = sums.agg(F.struct(*[F.try_divide(total(c), n(c)).alias(c) for c in columns])).scalar()
    filled = filled.withColumn("_all", overall)
    filled = filled.withColumns({c: F.coalesce(F.col(c), F.col(f"_all.{c}")) for c in columns}).drop("_all")
    numeric = [c for c, t in filled.dtypes if t in ("double", "int", "bigint") and c not in ("home_goals", "away_goals")]
    return filled.na.fill(0, numeric)


def temporal_split(df: DataFrame) -> DataFrame:
    """Train, val and test by season: last season test, the one before val; fixtures apart.

    Two seasons: the last one halves into val and test by date. One season: 60, 20 and 20 percent.
    """
    played = F.col("match_status") == "Played"
    seasons = sorted(r[0] for r in df.where(played).select("season_end_year").distinct().collect())
    fixture = F.when(~played, "fixture")
    year = F.col("season_end_year")
    if len(seasons) >= 3:
        split = fixture.when(year == seasons[-1], "test").when(year == seasons[-2], "val").otherwise("train")
        return df.withColumn("split", split)
    from touchline.operators.ranking import with_ranks

    last = df.where(played & (year == seasons[-1])).select(
        "match_id",
        F.datediff(F.to_date("match_date"), F.lit("1970-01-01")).cast("double").alias("_day"),
        F.xxhash64("match_id").alias("_tie"),
    )
    by_day = with_ranks(last, "_day", rank_min="_rank")
    placed = with_ranks(by_day, "_tie", ["_day"], rank_min="_in_day").select(
        "match_id", (F.col("_rank") + F.col("_in_day") - 1).alias("_pos")
    )
    total = last.agg(F.count(F.lit(1))).scalar()
    joined = df.join(placed, "match_id", "left")
    position = F.col("_pos")
    if len(seasons) == 2:
        split = (
            fixture.when(year == seasons[0], "train").when(position <= F.ceil(total / 2), "val").otherwise("test")
        )
    else:
        split = (
            fixture.when(position <= F.floor(total * 0.6), "train")
            .when(position <= F.floor(total * 0.8), "val")
            .otherwise("test")
        )
    return joined.withColumn("split", split).drop("_pos")


def structural_features(df: DataFrame, leagues: list[str]) -> DataFrame:
    """Month, one 0/1 column per league, and the outcome label 0 (home), 1 (draw), 2 (away)."""
    label = F.when(F.col("result") == "H", 0).when(F.col("result") == "D", 1).when(F.col("result") == "A", 2)
    return df.withColumns(
        {
            "match_month": F.month(F.to_date("match_date")),
            "outcome_label": label,
            **{f"league_{name}": (F.col("league") == name).cast("int") for name in leagues},
        }
    )


def match_dataset(results: DataFrame, *features: DataFrame) -> DataFrame:
    """All matches with their features, form filled in, structural columns and split."""
    joined = results
    for f in features:
        joined = joined.join(f, "match_id", "left")
    leagues = sorted(r[0] for r in results.select("league").where("league is not null").distinct().collect())
    return temporal_split(impute_form(structural_features(joined, leagues)))


@dataclass
class GoalModel:
    model: PipelineModel
    features: list[str]

    def predict(self, df: DataFrame, out: str) -> DataFrame:
        filled = _filled(df, self.features)
        scored = self.model.transform(filled).withColumn(out, F.col("prediction"))
        return scored.drop("_x", "prediction", *[f"_f_{c}" for c in self.features])


@dataclass
class OutcomeModel:
    model: PipelineModel
    features: list[str]

    def predict(self, df: DataFrame, outputs: tuple[str, str, str] = ("prob_H", "prob_D", "prob_A")) -> DataFrame:
        scored = self.model.transform(_filled(df, self.features)).withColumn("_p", vector_to_array("probability"))
        named = scored.withColumns({o: F.col("_p")[i] for i, o in enumerate(outputs)})
        return named.drop("_x", "_p", "rawPrediction", "probability", "prediction", *[f"_f_{c}" for c in self.features])


def _filled(df: DataFrame, features: list[str]) -> DataFrame:
    present = df.columns
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in present else F.lit(0.0)
    return df.withColumns({f"_f_{c}": value(c) for c in features})


def fit_goals(df: DataFrame, features: list[str], goals: str, penalty: float = 0.01) -> GoalModel:
    """Poisson regression with log link for one side's goals. A fit reads its rows at every step, so their columns are kept while it runs."""
    kept = _fit_columns(df, features, [goals]).persist(StorageLevel.DISK_ONLY)
    try:
        return _fit_goals(kept, features, goals, penalty)
    finally:
        kept.unpersist()


def _fit_columns(df: DataFrame, features: list[str], others: list[str]) -> DataFrame:
    return df.select(*dict.fromkeys([*others, *[c for c in features if c in df.columns]]))


def _fit_goals(df: DataFrame, features: list[str], goals: str, penalty: float = 0.01) -> GoalModel:
    stages = [
        VectorAssembler(inputCols=[f"_f_{c}" for c in features], outputCol="_x"),
        GeneralizedLinearRegression(
            family="poisson", link="log", featuresCol="_x", labelCol=goals, regParam=penalty, maxIter=50
        ),
    ]
    known = _filled(df.where(F.col(goals).isNotNull()).withColumn(goals, F.col(goals).cast("double")), features)
    return GoalModel(Pipeline(stages=stages).fit(known), features)


def fit_goals_boosted(df: DataFrame, features: list[str], goals: str, **options) -> BoostedModel:
    options = {"max_depth": 5, "eta": 0.05, "rounds": 100, "early_stopping_rounds": 30, **options}
    return fit_boosted(df, features, goals, "squared", fold_key=["match_id"], **options)


def fit_outcome(df: DataFrame, features: list[str], label: str = "outcome_label", penalty: float = 0.001) -> OutcomeModel:
    """Multinomial model of home win, draw and away win."""
    stages = [
        VectorAssembler(inputCols=[f"_f_{c}" for c in features], outputCol="_x"),
        LogisticRegression(family="multinomial", featuresCol="_x", labelCol=label, regParam=penalty, maxIter=100),
    ]
    known = _filled(df.where(F.col(label).isNotNull()).withColumn(label, F.col(label).cast("double")), features)
    return OutcomeModel(Pipeline(stages=stages).fit(known), features)


def fit_outcome_boosted(df: DataFrame, features: list[str], label: str = "outcome_label", **options) -> BoostedModel:
    options = {"max_depth": 5, "eta": 0.05, "rounds": 100, "early_stopping_rounds": 30, **options}
    return fit_boosted(df, features, label, "classes", fold_key=["match_id"], **options)


def with_goal_predictions(df: DataFrame, home: GoalModel, away: GoalModel) -> DataFrame:
    scored = away.predict(home.predict(df, "pred_home_goals"), "pred_away_goals")
    return scored.withColumns(
        {
            "pred_goal_diff": F.col("pred_home_goals") - F.col("pred_away_goals"),
            "pred_total_goals": F.col("pred_home_goals") + F.col("pred_away_goals"),
        }
    )


def out_of_fold_goals(df: DataFrame, features: list[str], n_folds: int = 5) -> DataFrame:
    """Goal predictions for each row from models that never saw its fold."""
    folded = df.withColumn("_fold", F.pmod(F.xxhash64("match_id"), F.lit(n_folds)))
    kept = _fit_columns(folded, features, ["_fold", "home_goals", "away_goals"]).persist(StorageLevel.DISK_ONLY)
    try:
        models = []
        for k in range(n_folds):
            rest = kept.where(F.col("_fold") != k)
            models.append((_fit_goals(rest, features, "home_goals"), _fit_goals(rest, features, "away_goals")))
    finally:
        kept.unpersist()
    result = None
    for k, (home, away) in enumerate(models):
        part = with_goal_predictions(folded.where(F.col("_fold") == k), home, away)
        result = part if result is None else result.unionByName(part)
    # every part has all partitions of the rows; a model fitted on them would start a task for each at every step
    return result.drop("_fold").coalesce(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def predict_matches(df: DataFrame, home: GoalModel, away: GoalModel, outcome: OutcomeModel) -> DataFrame:
    """Goals and outcome probabilities per match."""
    return outcome.predict(with_goal_predictions(df, home, away))


def score_fixtures(predicted: DataFrame) -> DataFrame:
    """Published predictions: rounded values and the likeliest result, by date and league."""
    names = F.array(F.lit("H"), F.lit("D"), F.lit("A"))
    chances = F.array("prob_H", "prob_D", "prob_A")
    label = F.element_at(names, F.array_position(chances, F.array_max(chances)).cast("int"))
    kept = [c for c in ("match_id", "match_date", "league", "season", "home_team", "away_team") if c in predicted.columns]
    return predicted.select(
        *kept,
        *[F.round(c, 2).alias(c) for c in ("pred_home_goals", "pred_away_goals")],
        *[F.round(c, 3).alias(c) for c in ("prob_H", "prob_D", "prob_A")],
        label.alias("predicted_result"),
    ).orderBy(*[c for c in ("match_date", "league", "match_id") if c in kept])


def upcoming(predictions: DataFrame) -> DataFrame:
    """Predictions from today on."""
    return predictions.where(F.to_date("match_date") >= F.current_date())
