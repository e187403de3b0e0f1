"""Checks of arguments, columns, completeness and season coverage."""

import re
from functools import reduce

from pyspark.sql import DataFrame, functions as F


def validate_seasons(seasons: list[str], min_year: int = 2017) -> None:
    """Labels must be YYYY-YYYY, one year apart, not before `min_year`."""
    for s in seasons:
        if not re.match(r"^\d{4}-\d{4}$", s):
            raise ValueError(f"season {s!r} is not YYYY-YYYY")
        start, end = int(s[:4]), int(s[5:])
        if end != start + 1:
            raise ValueError(f"season {s!r} does not span one year")
        if start < min_year:
            raise ValueError(f"season {s!r} starts before {min_year}")


def validate_min_minutes(minutes: float) -> None:
    if isinstance(minutes, bool) or not isinstance(minutes, (int, float)) or minutes < 0:
        raise ValueError("min_minutes must be a number of at least 0")


def validate_table(df: DataFrame, required: list[str] = (), min_rows: int = 1, name: str = "table") -> DataFrame:
    """Required columns from the schema, minimum rows from at most that many rows."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{name} lacks columns: {', '.join(missing)}")
    if min_rows and len(df.take(min_rows)) < min_rows:
        raise ValueError(f"{name} needs at least {min_rows} rows")
    return df


def completeness(df: DataFrame, required: list[str] = ()) -> DataFrame:
    """NULL count and percent per column, with a flag above 20 percent; absent required columns too."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(f"c{i}") for i, c in enumerate(df.columns)]
    )
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("na_count")) for i, c in enumerate(df.columns)],
        *[
            F.struct(F.lit(c).alias("column"), F.lit(None).cast("bigint").alias("na_count"))
            for c in required
            if c not in df.columns
        ],
    )
    long = counts.select("_n", F.explode(cells).alias("c")).select("_n", "c.*")
    percent = F.round(F.try_divide(F.col("na_count"), F.col("_n")) * 100, 1)
    return long.select(
        "column", "na_count", percent.alias("na_pct"), (percent > 20).alias("is_high"),
        F.col("na_count").isNull().alias("is_missing"),
    )


def season_coverage(tables: dict[str, DataFrame], season: str = "season_end_year") -> DataFrame:
    """Rows, first and last season and number of seasons per table."""
    parts = [
        df.agg(
            F.count(F.lit(1)).alias("n_rows"), F.min(season).alias("min_season"), F.max(season).alias("max_season"),
            F.count_distinct(season).alias("n_seasons"),
        ).withColumn("table", F.lit(name))
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)
