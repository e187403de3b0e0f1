"""Player ratings out of ridge fits: extraction, priors, comparison, ranking and roll-ups."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from touchline.functions.names import matches_text
from touchline.functions.numeric import correlation, safe_divide
from touchline.operators.design import Design
from touchline.operators.ranking import with_ranks
from touchline.operators.ridge import RidgeFit, fit_ridge, fit_ridge_with_prior, prior_table


def _by_side(coefficients: DataFrame, value: str, by: list[str] = []) -> DataFrame:
    """(player_id, offense, defense), per `by`, out of `<id>_off` and `<id>_def` features."""
    role = F.regexp_extract("feature", "_(off|def)$", 1)
    sided = coefficients.where(role != "").select(
        *by, F.regexp_replace("feature", "_(off|def)$", "").alias("player_id"), role.alias("_role"), F.col(value).alias("_v")
    )
    return sided.groupBy(*by, "player_id").agg(
        F.sum(F.when(F.col("_role") == "off", F.col("_v"))).alias("offense"),
        F.sum(F.when(F.col("_role") == "def", F.col("_v"))).alias("defense"),
    )


def ridge_ratings(fit: RidgeFit, player_map: DataFrame, lam: str | float = "min") -> DataFrame:
    """Offense, defense (negative is good) and overall = offense - defense per player."""
    sides = _by_side(fit.table(lam).where(~F.col("is_covariate")), "coefficient")
    return (
        sides.withColumn("rapm", F.col("offense") - F.col("defense"))
        .join(player_map, "player_id", "left")
        .orderBy(F.desc("rapm"), "player_id")
    )


def feature_coefficients(fit: RidgeFit, lam: str | float = "min") -> DataFrame:
    """All coefficients but the intercept, largest first."""
    return fit.table(lam).select("feature", "coefficient").orderBy(F.desc("coefficient"), "feature")


def covariate_effects(fit: RidgeFit, lam: str | float = "min") -> DataFrame:
    return fit.table(lam).where("is_covariate").select("feature", "coefficient")


def ratings_by(coefficients: DataFrame, player_map: DataFrame, by: str, prior: DataFrame | None = None) -> DataFrame:
    """The tables of `ridge_ratings`, or with a prior of `prior_ratings`, for all values of `by` at once.

    `coefficients` has `by, feature, coefficient, is_covariate`, `prior` has `by, feature, prior`.
    """
    keys = [by, "player_id"]
    own = coefficients.where(~F.col("is_covariate"))
    if prior is None:
        sides = _by_side(own, "coefficient", [by])
        return sides.withColumn("rapm", F.col("offense") - F.col("defense")).join(player_map, keys, "left").orderBy(by, F.desc("rapm"), "player_id")
    joined = own.join(prior, [by, "feature"], "left").na.fill(0, ["prior"])
    final = _by_side(joined.withColumn("_f", F.col("coefficient") + F.col("prior")), "_f", [by])
    deviation = _by_side(joined, "coefficient", [by]).withColumnsRenamed({"offense": "off_deviation", "defense": "def_deviation"})
    priors = _by_side(joined, "prior", [by]).withColumnsRenamed({"offense": "off_prior", "defense": "def_prior"})
    rated = final.withColumn("xrapm", F.col("offense") - F.col("defense")).join(deviation, keys).join(priors, keys)
    return rated.join(player_map, keys, "left").orderBy(by, F.desc("xrapm"), "player_id")


def prior_by(predictions: DataFrame, column: str, player_map: DataFrame, by: str, default: float = 0.0) -> DataFrame:
    """`build_prior` for all values of `by` at once: by id in those where any id matches, else by name."""
    ids = player_map.select(by, F.col("player_id").cast("string").alias("player_id"), "player_name")
    by_name = predictions.groupBy(by, "player_name").agg(F.max(column).alias("_by_name"))
    joined = ids.join(by_name, [by, "player_name"], "left")
    if "player_id" not in predictions.columns:
        return joined.select(by, "player_id", F.coalesce("_by_name", F.lit(default)).alias("prior"))
    by_id = predictions.groupBy(by, F.col("player_id").cast("string").alias("player_id")).agg(F.max(column).alias("_by_id"), F.lit(True).alias("_known"))
    joined = joined.join(by_id, [by, "player_id"], "left")
    matched = joined.groupBy(by).agg(F.max(F.coalesce("_known", F.lit(False))).alias("_any"))
    prior = F.coalesce(F.when(F.col("_any"), F.col("_by_id")).otherwise(F.col("_by_name")), F.lit(default))
    return joined.join(matched, by).select(by, "player_id", prior.alias("prior"))


def prior_ratings(fit: RidgeFit, player_map: DataFrame, lam: str | float = "min") -> DataFrame:
    """Ratings of a fit with priors: final value, deviation and prior per side."""
    table = fit.table(lam).where(~F.col("is_covariate"))
    spark = table.sparkSession
    prior = spark.createDataFrame(list((fit.prior or {}).items()) or [("", 0.0)], "feature string, prior double")
    joined = table.join(prior, "feature", "left").na.fill(0, ["prior"])
    final = _by_side(joined.withColumn("_f", F.col("coefficient") + F.col("prior")), "_f")
    deviation = _by_side(joined, "coefficient").withColumnsRenamed({"offense": "off_deviation", "defense": "def_deviation"})
    priors = _by_side(joined, "prior").withColumnsRenamed({"offense": "off_prior", "defense": "def_prior"})
    return (
        final.withColumn("xrapm", F.col("offense") - F.col("defense"))
        .join(deviation, "player_id")
        .join(priors, "player_id")
        .join(player_map, "player_id", "left")
        .orderBy(F.desc("xrapm"), "player_id")
    )


def build_prior(predictions: DataFrame, column: str, player_map: DataFrame, default: float = 0.0) -> DataFrame:
    """(player_id, prior) for every mapped player, joined by id when any id matches, else by name."""
    ids = player_map.select(F.col("player_id").cast("string").alias("player_id"), "player_name")
    if "player_id" in predictions.columns:
        by_id = predictions.select(F.col("player_id").cast("string").alias("player_id"), F.col(column).alias("prior"))
        by_id = by_id.groupBy("player_id").agg(F.max("prior").alias("prior"))
        if ids.join(by_id, "player_id", "left_semi").take(1):
            joined = ids.select("player_id").join(by_id, "player_id", "left")
            return joined.na.fill(default, ["prior"])
    by_name = predictions.groupBy("player_name").agg(F.max(column).alias("prior"))
    return ids.join(by_name, "player_name", "left").select("player_id", "prior").na.fill(default, ["prior"])


def overall_prior_rating(design: Design, predictions: DataFrame, lam: float = 1.0) -> DataFrame:
    """Fixed-penalty ridge around one overall prior per feature name; rating = prior + deviation.

    Features are matched to predictions by name first, then through the player table.
    """
    prior = predictions.select(F.col("player_id").cast("string").alias("feature"), F.col("spm").alias("prior"))
    fit = fit_ridge_with_prior(
        design, prior, lambdas=[lam], n_folds=2, use_weights=False, penalize_covariates=True
    )
    table = fit.table(lam)
    spark = table.sparkSession
    known = spark.createDataFrame(list((fit.prior or {}).items()) or [("", 0.0)], "feature string, spm_prior double")
    rated = table.select(F.col("feature").alias("player_id"), F.col("coefficient").alias("deviation"))
    rated = rated.join(known.withColumnRenamed("feature", "player_id"), "player_id", "left").na.fill(0, ["spm_prior"])
    return rated.withColumn("rating", F.col("deviation") + F.col("spm_prior")).orderBy(F.desc("rating"), "player_id")


def split_prior_rating(design: Design, predictions: DataFrame, lam: float = 1.0) -> DataFrame:
    """Fixed-penalty ridge with separate offense and defense priors; total = offense + defense.

    `predictions` has o_spm and d_spm, or spm alone, which is split in halves.
    """
    if "o_spm" in predictions.columns:
        sides = predictions.select("player_id", "o_spm", "d_spm")
    else:
        half = F.col("spm") / 2
        sides = predictions.select("player_id", half.alias("o_spm"), half.alias("d_spm"))
    prior = prior_table(
        sides.select("player_id", F.col("o_spm").alias("prior")), sides.select("player_id", F.col("d_spm").alias("prior"))
    )
    bare = Design(design.rows, design.player_map, [], design.dummy_prefixes)
    fit = fit_ridge_with_prior(bare, prior, lambdas=[lam], n_folds=2, use_weights=False, penalize_covariates=True)
    rated = prior_ratings(fit, design.player_map, lam)
    return rated.select(
        "player_id", "player_name",
        F.col("offense").alias("o_rating"), F.col("defense").alias("d_rating"),
        (F.col("offense") + F.col("defense")).alias("rating"),
    ).orderBy(F.desc("rating"), "player_id")


def mean_z(df: DataFrame, columns: list[str]) -> Column:
    """Mean z-score of the columns with a value; needs moments joined as `<c>_mean`, `<c>_sd`."""
    z = [F.try_divide(F.col(c) - F.col(f"{c}_mean"), F.col(f"{c}_sd")) for c in columns]
    known = reduce(lambda a, b: a + b, [F.when(v.isNotNull(), 1).otherwise(0) for v in z])
    total = reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(0.0)) for v in z])
    return F.try_divide(total, known)


# Name fragments of offensive and defensive features.
OFFENSIVE_FRAGMENTS = "xG|Sh|Ast|SCA|GCA|PrgP|PrgC"
DEFENSIVE_FRAGMENTS = "Tkl|Int|Block|Clr"


def split_contributions(
    ratings: DataFrame,
    features: DataFrame,
    offensive: list[str] | None = None,
    defensive: list[str] | None = None,
    key: str = "player_id",
    rating: str = "rating",
) -> DataFrame:
    """Split ratings by the size of each player's mean offensive and defensive z-score."""
    import re

    named = lambda pattern: [c for c in features.columns if re.search(pattern, c)]
    offensive = offensive or named(OFFENSIVE_FRAGMENTS)
    defensive = defensive or named(DEFENSIVE_FRAGMENTS)
    if not offensive or not defensive:
        return ratings
    columns = offensive + defensive
    moments = features.agg(
        F.struct(
            *[F.avg(c).alias(f"{c}_mean") for c in columns], *[F.stddev_samp(c).alias(f"{c}_sd") for c in columns]
        )
    ).scalar()
    flat = features.withColumn("_m", moments).select("*", "_m.*")
    scored = flat.select(
        key, F.abs(mean_z(flat, offensive)).alias("_off"), F.abs(mean_z(flat, defensive)).alias("_def")
    )
    both = F.col("_off") + F.col("_def")
    weights = scored.select(
        key, safe_divide("_off", both).alias("_ow"), safe_divide("_def", both).alias("_dw")
    )
    joined = ratings.join(weights, key, "left")
    half = F.lit(0.5)
    return joined.withColumns(
        {
            "o_rating": F.col(rating) * F.coalesce(F.col("_ow"), half),
            "d_rating": F.col(rating) * F.coalesce(F.col("_dw"), half),
        }
    ).drop("_ow", "_dw")


def profile_bucket(offense="o_rating", defense="d_rating") -> Column:
    """Five profiles by the offensive share of the total."""
    o = F.col(offense) if isinstance(offense, str) else offense
    d = F.col(defense) if isinstance(defense, str) else defense
    share = safe_divide(o, o + d + F.lit(0.001))
    return (
        F.when(share > 0.7, "Offensive")
        .when(share > 0.55, "Balanced-Offensive")
        .when(share > 0.45, "Balanced")
        .when(share > 0.3, "Balanced-Defensive")
        .otherwise("Defensive")
    )


def top_by(ratings: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The n highest rows of a column."""
    ties = [c for c in ("player_id", "player_name") if c in ratings.columns]
    return ratings.orderBy(F.desc(column), *ties).limit(n)


def bottom_by(ratings: DataFrame, column: str, n: int = 10) -> DataFrame:
    ties = [c for c in ("player_id", "player_name") if c in ratings.columns]
    return ratings.orderBy(F.asc(column), *ties).limit(n)


def top_offensive(ratings: DataFrame, n: int = 10) -> DataFrame:
    return top_by(ratings, "o_rating", n)


def top_defensive(ratings: DataFrame, n: int = 10) -> DataFrame:
    return top_by(ratings, "d_rating", n)


def ranked_players(
    ratings: DataFrame, rating: str = "rating", top_n: int | None = None, position: str | None = None
) -> DataFrame:
    """Rank by rating over all players, then keep a position and the first n; ties share a rank."""
    result = with_ranks(ratings, rating, rank_min_desc="rank")
    if position is not None and "position" in result.columns:
        result = result.where(matches_text("position", position))
    if top_n is not None:
        ties = [c for c in ("player_id", "player_name") if c in result.columns]
        result = result.orderBy("rank", *ties).limit(top_n)
    return result


def scatter_data(ratings: DataFrame) -> DataFrame:
    """Profile and label columns for plotting offense against defense."""
    label = "player_name" if "player_name" in ratings.columns else "player_id"
    return ratings.withColumns({"profile": profile_bucket(), "label": F.col(label).cast("string")})


def rating_report(ratings: DataFrame, rating: str = "rating", top_n: int = 10) -> DataFrame:
    """Top and bottom players with their rank."""
    ranked = with_ranks(ratings, rating, rank_min_desc="rank")
    top = top_by(ranked, rating, top_n).withColumn("part", F.lit("top"))
    return top.unionByName(bottom_by(ranked, rating, top_n).withColumn("part", F.lit("bottom")))


def compare_ratings(
    ratings: DataFrame, rapm: DataFrame, spm: DataFrame, key: str = "player_id", rating: str = "rating"
) -> DataFrame:
    """Three rating sets side by side with their differences."""
    keep = [c for c in dict.fromkeys([key, "player_name", rating]) if c in ratings.columns]
    joined = ratings.select(*keep).join(rapm.select(key, "rapm"), key, "left").join(spm.select(key, "spm"), key, "left")
    return joined.withColumns(
        {
            "rating_vs_rapm": F.col(rating) - F.col("rapm"),
            "rating_vs_spm": F.col(rating) - F.col("spm"),
            "rapm_vs_spm": F.col("rapm") - F.col("spm"),
        }
    )


def rating_agreement(
    ratings: DataFrame, rapm: DataFrame, spm: DataFrame, key: str = "player_id", rating: str = "rating"
) -> DataFrame:
    """Correlations, means and SDs of the three sets over complete cases (one row)."""
    complete = compare_ratings(ratings, rapm, spm, key, rating).na.drop()
    spread = lambda c, out: [F.avg(c).alias(f"{out}_mean"), F.stddev_samp(c).alias(f"{out}_sd")]
    return complete.agg(
        F.count(F.lit(1)).alias("n_players"),
        correlation(rating, "rapm").alias("rating_rapm_cor"),
        correlation(rating, "spm").alias("rating_spm_cor"),
        correlation("rapm", "spm").alias("rapm_spm_cor"),
        *spread(rating, "rating"),
        *spread("rapm", "rapm"),
        *spread("spm", "spm"),
    )


def predictive_power(
    ratings: DataFrame, next_season: DataFrame, key: str = "player_id", rating: str = "rating", min_players: int = 10
) -> DataFrame:
    """How well ratings foresee the next season: n, correlation, RMSE; no row below `min_players`."""
    joined = ratings.select(key, F.col(rating).alias("_r")).join(
        next_season.select(key, F.col("rapm").alias("_next")), key
    )
    miss = F.col("_r") - F.col("_next")
    return joined.agg(
        F.count(F.lit(1)).alias("n_matched"),
        correlation("_r", "_next").alias("correlation"),
        F.sqrt(F.avg(miss * miss)).alias("rmse"),
    ).where(F.col("n_matched") >= min_players)


def team_ratings(ratings: DataFrame, player_teams: DataFrame, rating: str = "rapm") -> DataFrame:
    """Number, mean, sum and best rating per team."""
    joined = ratings.join(player_teams.select("player_id", "team"), "player_id", "left")
    return joined.groupBy("team").agg(
        F.count(F.lit(1)).alias("n_players"),
        F.avg(rating).alias(f"mean_{rating}"),
        F.sum(rating).alias(f"total_{rating}"),
        F.max(rating).alias(f"top_player_{rating}"),
    )


def largest_per_key(df: DataFrame, key: str, by: str) -> DataFrame:
    """One row per key: the one with the most of `by`, ties by the row's own values."""
    rest = [c for c in df.columns if c not in (key,)]
    best = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(F.col(by), *sorted(rest))).alias("_r"))
    return best.select(key, "_r.*")


def final_ratings(prior: DataFrame, base: DataFrame, boxscore: DataFrame) -> DataFrame:
    """Published table: prior-based rating with base ridge and box-score values by name.

    Duplicate names keep the entry with most minutes; percentile and rank average ties.
    """
    base_best = largest_per_key(base.select("player_name", "total_minutes", "rapm", "offense", "defense"), "player_name", "total_minutes")
    spm_best = largest_per_key(boxscore.select("player_name", "total_minutes", "spm"), "player_name", "total_minutes")
    rated = (
        prior.withColumnRenamed("xrapm", "rating")
        .join(
            base_best.select(
                "player_name",
                F.col("rapm").alias("base_rapm"),
                F.col("offense").alias("base_offense"),
                F.col("defense").alias("base_defense"),
            ),
            "player_name",
            "left",
        )
        .join(spm_best.select("player_name", F.col("spm").alias("spm_overall")), "player_name", "left")
    )
    ranked = with_ranks(rated, "rating", percentile_avg="rating_percentile", rank_avg_desc="rating_rank")
    return ranked.orderBy(F.desc("rating"))


def primary_teams(lineups: DataFrame) -> DataFrame:
    """Team(s) with most appearances per player; ties are kept."""
    counts = lineups.groupBy("player_name", "team").agg(F.count(F.lit(1)).alias("appearances"))
    most = counts.groupBy("player_name").agg(F.max("appearances").alias("appearances"))
    return counts.join(most, ["player_name", "appearances"], "left_semi").select(
        "player_name", F.col("team").alias("primary_team")
    )


def team_strength(ratings: DataFrame, teams: DataFrame, rating: str = "rating") -> DataFrame:
    """Sum of player ratings per primary team, with its best player."""
    joined = ratings.join(teams, "player_name").where(F.col("primary_team").isNotNull())
    return joined.groupBy("primary_team").agg(
        F.count(F.lit(1)).alias("n_players"),
        F.sum("total_minutes").alias("total_minutes"),
        F.sum(rating).alias(f"sum_{rating}"),
        F.avg(rating).alias(f"mean_{rating}"),
        F.sum("offense").alias("sum_offense"),
        F.sum("defense").alias("sum_defense"),
        F.max_by("player_name", F.struct(F.col(rating), F.col("player_name"))).alias("top_player"),
        F.max(rating).alias(f"top_{rating}"),
    )


def team_xg_difference(results: DataFrame) -> DataFrame:
    """Home and away chance difference per team; teams with one side only stay in."""
    known = results.where(F.col("home_xg").isNotNull() & F.col("away_xg").isNotNull())
    diff = F.col("home_xg") - F.col("away_xg")
    home = known.groupBy(F.col("home_team").alias("team")).agg(F.sum(diff).alias("_home"))
    away = known.groupBy(F.col("away_team").alias("team")).agg(F.sum(-diff).alias("_away"))
    zero = F.lit(0.0)
    total = F.coalesce(F.col("_home"), zero) + F.coalesce(F.col("_away"), zero)
    return home.join(away, "team", "full").select("team", total.alias("total_npxgd"))


def team_validation(results: DataFrame, strength: DataFrame, rating: str = "rating") -> DataFrame:
    """Teams ranked by chance difference and by player ratings, and the rank gap."""
    joined = team_xg_difference(results).join(
        strength.select(F.col("primary_team").alias("team"), f"sum_{rating}", "sum_offense", "sum_defense"), "team"
    )
    ranked = with_ranks(joined, "total_npxgd", rank_avg_desc="npxgd_rank")
    ranked = with_ranks(ranked, f"sum_{rating}", rank_avg_desc="rating_rank")
    return ranked.withColumn("rank_diff", F.col("npxgd_rank") - F.col("rating_rank"))


def export_ratings(seasonal: DataFrame, seasonal_spm: DataFrame, key: str = "player_id") -> DataFrame:
    """Latest season, one row per player, minimum-tie rank and percentile, rounded values."""
    latest = seasonal.agg(F.max("season_end_year")).scalar()
    best = largest_per_key(seasonal.where(F.col("season_end_year") == latest), key, "total_minutes")
    spm = largest_per_key(
        seasonal_spm.where(F.col("season_end_year") == latest).select(key, "total_minutes", "spm"), key, "total_minutes"
    )
    joined = best.join(spm.select(key, F.col("spm").alias("spm_overall")), key, "left")
    ranked = with_ranks(joined, "xrapm", rank_min_desc="rating_rank", percentile_min="rating_percentile")
    four = lambda c: F.round(c, 4)
    return ranked.select(
        "rating_rank",
        "player_name",
        four("xrapm").alias("rating"),
        four("offense").alias("offense"),
        four("defense").alias("defense"),
        four("spm_overall").alias("spm_overall"),
        "total_minutes",
        F.round("rating_percentile", 1).alias("rating_percentile"),
    ).orderBy("rating_rank")


def compare_runs(first: DataFrame, second: DataFrame, key: str = "player_id", rating: str = "rapm") -> DataFrame:
    """Two rating runs by player with the difference, largest gap first."""
    keep = [c for c in (key, "player_name") if c in first.columns]
    joined = first.select(*keep, F.col(rating).alias("first")).join(
        second.select(key, F.col(rating).alias("second")), key
    )
    return joined.withColumn("diff", F.col("first") - F.col("second")).orderBy(F.desc(F.abs("diff")), key)


def run_correlation(first: DataFrame, second: DataFrame, key: str = "player_id", rating: str = "rapm") -> DataFrame:
    compared = compare_runs(first, second, key, rating)
    return compared.agg(F.count(F.lit(1)).alias("n_players"), correlation("first", "second").alias("correlation"))


def season_consistency(seasonal: DataFrame, rating: str = "xrapm", min_seasons: int = 1) -> DataFrame:
    """Seasons, mean and spread of each player's seasonal ratings."""
    seasons = F.array_join(F.sort_array(F.collect_set(F.col("season_end_year").cast("string"))), ", ")
    return (
        seasonal.groupBy("player_name")
        .agg(
            F.count(F.lit(1)).alias("n_seasons"),
            seasons.alias("seasons"),
            F.avg(rating).alias(f"mean_{rating}"),
            F.stddev_samp(rating).alias(f"sd_{rating}"),
            F.sum("total_minutes").alias("total_minutes"),
        )
        .where(F.col("n_seasons") >= min_seasons)
    )


def seasonal_vs_overall(seasonal: DataFrame, overall: DataFrame, rating: str = "xrapm") -> DataFrame:
    """Mean seasonal rating against the all-seasons rating."""
    means = seasonal.groupBy("player_name").agg(
        F.avg(rating).alias("mean_seasonal"), F.count(F.lit(1)).alias("n_seasons")
    )
    joined = means.join(overall.select("player_name", F.col(rating).alias("overall")), "player_name")
    return joined.withColumn("diff", F.col("mean_seasonal") - F.col("overall"))


def stat_agreement(first: DataFrame, second: DataFrame, stats: list[str], key: str = "player_id") -> DataFrame:
    """Correlation per statistic between two player tables (long form)."""
    joined = first.select(key, *[F.col(c).alias(f"a_{c}") for c in stats]).join(
        second.select(key, *[F.col(c).alias(f"b_{c}") for c in stats]), key
    )
    pairs = F.array(
        *[F.struct(F.lit(c).alias("stat"), F.col(f"a_{c}").cast("double").alias("a"), F.col(f"b_{c}").cast("double").alias("b")) for c in stats]
    )
    return (
        joined.select(F.explode(pairs).alias("p"))
        .select("p.*")
        .groupBy("stat")
        .agg(F.count(F.lit(1)).alias("n_players"), correlation("a", "b").alias("correlation"))
    )


def latest_season(df: DataFrame, key: str = "player_id") -> DataFrame:
    """Each player's last season."""
    return largest_per_key(df, key, "season_end_year")
