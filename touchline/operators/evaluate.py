"""Scores of goal and outcome predictions against results and simple baselines."""

from pyspark.sql import Column, DataFrame, functions as F

from touchline.functions.numeric import bin_index, clamp

PROBABILITIES = ("prob_H", "prob_D", "prob_A")
OUTCOMES = ("Home", "Draw", "Away")
# Fixed values of the rating-only baseline: share left for wins, draw chance.
ELO_WIN_SHARE = 0.72
ELO_DRAW = 0.26


def true_probability(label: str = "outcome_label", probabilities=PROBABILITIES) -> Column:
    """Probability given to what happened."""
    return F.element_at(F.array(*[F.col(p) if isinstance(p, str) else p for p in probabilities]), (F.col(label) + 1).cast("int"))


def multiclass_logloss(
    df: DataFrame, label: str = "outcome_label", probabilities=PROBABILITIES, eps: float = 1e-15
) -> DataFrame:
    """Mean negative log of the true class's probability, clipped (one row)."""
    p = clamp(true_probability(label, probabilities), eps, 1 - eps)
    return df.agg((-F.avg(F.log(p))).alias("logloss"))


def outcome_calibration(
    df: DataFrame, label: str = "outcome_label", probabilities=PROBABILITIES, n_bins: int = 10
) -> DataFrame:
    """Mean probability and observed rate per class and equal-width bin."""
    classes = F.array(
        *[
            F.struct(
                F.lit(name).alias("outcome"),
                F.col(p).alias("prob"),
                (F.col(label) == i).cast("int").alias("actual"),
            )
            for i, (name, p) in enumerate(zip(OUTCOMES, probabilities))
        ]
    )
    long = df.select(F.explode(classes).alias("c")).select("c.*")
    return long.groupBy("outcome", bin_index("prob", n_bins).alias("bin")).agg(
        F.avg("prob").alias("pred_mean"), F.avg("actual").alias("actual_mean"), F.count(F.lit(1)).alias("n")
    )


def predicted_class(probabilities=PROBABILITIES) -> Column:
    """0-based index of the largest probability, the first of equals."""
    chances = F.array(*probabilities)
    return (F.array_position(chances, F.array_max(chances)) - 1).cast("int")


def brier(label: str = "outcome_label", probabilities=PROBABILITIES) -> Column:
    total = F.lit(0.0)
    for i, p in enumerate(probabilities):
        miss = F.col(p) - (F.col(label) == i).cast("double")
        total = total + miss * miss
    return total


def goal_errors(test: DataFrame, train: DataFrame) -> DataFrame:
    """RMSE of goal predictions against always guessing the training mean (one row)."""
    means = train.agg(F.struct(F.avg("home_goals").alias("h"), F.avg("away_goals").alias("a"))).scalar()
    rmse = lambda miss: F.sqrt(F.avg(miss * miss))
    joined = test.withColumn("_m", means)
    return joined.agg(
        rmse(F.col("home_goals") - F.col("pred_home_goals")).alias("home_rmse"),
        rmse(F.col("away_goals") - F.col("pred_away_goals")).alias("away_rmse"),
        rmse(F.col("home_goals") - F.col("_m.h")).alias("baseline_home_rmse"),
        rmse(F.col("away_goals") - F.col("_m.a")).alias("baseline_away_rmse"),
    )


def elo_probabilities(elo_diff="elo_diff") -> list[Column]:
    """Outcome chances from the rating gap alone, with a fixed draw chance."""
    home = 1 / (1 + F.pow(F.lit(10.0), -F.col(elo_diff) / 400))
    raw = [home * ELO_WIN_SHARE, F.lit(ELO_DRAW), (1 - home) * ELO_WIN_SHARE]
    total = raw[0] + raw[1] + raw[2]
    return [r / total for r in raw]


def outcome_scores(test: DataFrame, train: DataFrame, label: str = "outcome_label") -> DataFrame:
    """Log loss, accuracy and Brier score with class-share and rating-only baselines (one row)."""
    known = F.count(label)
    shares = train.agg(
        F.struct(*[(F.count_if(F.col(label) == i) / known).alias(f"p{i}") for i in range(3)])
    ).scalar()
    joined = test.withColumn("_s", shares)
    naive = [F.col(f"_s.p{i}") for i in range(3)]
    clipped = lambda p: clamp(p, 1e-15, 1 - 1e-15)
    loss = lambda probabilities: -F.avg(F.log(clipped(true_probability(label, probabilities))))
    naive_array = F.array(*naive)
    naive_class = F.array_position(naive_array, F.array_max(naive_array)) - 1
    scores = [
        F.count(F.lit(1)).alias("n_test"),
        loss(PROBABILITIES).alias("logloss"),
        F.avg((predicted_class() == F.col(label)).cast("double")).alias("accuracy"),
        F.avg(brier(label)).alias("brier"),
        loss(naive).alias("naive_logloss"),
        F.avg((naive_class == F.col(label)).cast("double")).alias("naive_accuracy"),
    ]
    if "elo_diff" in test.columns:
        scores.append(loss(elo_probabilities()).alias("elo_logloss"))
    return joined.agg(*scores)


def league_scores(test: DataFrame, label: str = "outcome_label", min_rows: int = 10) -> DataFrame:
    """Accuracy and log loss per league with enough matches."""
    p = clamp(true_probability(label), 1e-15, 1 - 1e-15)
    return (
        test.groupBy("league")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg((predicted_class() == F.col(label)).cast("double")).alias("accuracy"),
            (-F.avg(F.log(p))).alias("logloss"),
        )
        .where(F.col("n") >= min_rows)
    )
