"""Reading the three data families: projection, partition filters and union by name."""

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from touchline.functions.seasons import start_year_label
from touchline.sources.catalog import FEED_LEAGUES, feed_league
from touchline.sources.ingest import stored

# Tables per data family.
TABLES_A = ["summary", "events", "shots", "metadata", "passing", "defense", "possession", "keeper"]
TABLES_B = ["roster", "shots", "metadata"]
TABLES_C = ["player_stats", "shots", "shot_events", "events", "match_events", "lineups", "fixtures"]
TOP_LEAGUES = ["ENG", "ESP", "GER", "ITA", "FRA"]

# Partition columns whose values are labels, not numbers.
SEASON_LABELS = ["season", "season_input"]

_IDENTIFIER = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


def check_columns(columns: list[str]) -> list[str]:
    """Plain identifiers only."""
    bad = [c for c in columns if not _IDENTIFIER.match(c)]
    if bad:
        raise ValueError(f"not column names: {', '.join(bad)}")
    return columns


def equal_to(filters: dict) -> Column | None:
    """Conjunction of equalities; None entries are left out, nothing left means no condition."""
    kept = {k: v for k, v in filters.items() if v is not None}
    check_columns(list(kept))
    conditions = [F.col(k) == F.lit(v) for k, v in kept.items()]
    return reduce(lambda a, b: a & b, conditions) if conditions else None


def table_path(root: str, source: str, table: str) -> str:
    return f"{root.rstrip('/')}/{source}/{table}"


def read_table(
    spark: SparkSession,
    root: str,
    source: str,
    table: str,
    columns: list[str] | None = None,
    schema: StructType | None = None,
    filters: dict | None = None,
    merge: bool = True,
) -> DataFrame:
    """One table, laid out as `<root>/<source>/<table>/league=<l>/season=<s>` or as one dataset.

    Filters on league and season prune directories, others reach the parquet scan. Columns
    missing from some files are NULL there. A given schema is applied without reading footers, and an
    absent table then reads as empty; without one, `merge` reads the footers of all files. Season labels
    such as 2024 stay text.
    """
    path = table_path(root, source, table)
    if schema is not None:
        df = spark.read.schema(schema).parquet(path) if stored(spark, path) else spark.createDataFrame([], schema)
    else:
        df = spark.read.option("mergeSchema", str(merge).lower()).parquet(path)
    for c in SEASON_LABELS:
        if c in df.columns and (schema is None or c not in schema.fieldNames()):
            df = df.withColumn(c, F.col(c).cast("string"))
    condition = equal_to({k: v for k, v in (filters or {}).items()})
    if condition is not None:
        df = df.where(condition)
    return df.select(*check_columns(columns)) if columns else df


def query_table(spark: SparkSession, root: str, source: str, table: str, sql: str, **filters) -> DataFrame:
    """Run a SQL text whose `{table}` stands for the filtered table."""
    return spark.sql(sql, table=read_table(spark, root, source, table, filters=filters))


def load_a(spark: SparkSession, root: str, table: str, league: str | None = None, season: str | None = None) -> DataFrame:
    """A table of source A."""
    if table not in TABLES_A:
        raise ValueError(f"unknown table {table!r}; known: {', '.join(TABLES_A)}")
    return read_table(spark, root, "a", table, filters={"league": league, "season": season})


def load_b(spark: SparkSession, root: str, table: str, league: str | None = None, season: str | None = None) -> DataFrame:
    """A table of source B; season labels shorten to their start year."""
    if table not in TABLES_B:
        raise ValueError(f"unknown table {table!r}; known: {', '.join(TABLES_B)}")
    short = season.split("-")[0] if season else None
    return read_table(spark, root, "b", table, filters={"league_code": league, "season_input": short})


def load_c(
    spark: SparkSession,
    root: str,
    table: str,
    league: str | None = None,
    season: str | None = None,
    columns: list[str] | None = None,
    catalog: DataFrame | None = None,
) -> DataFrame:
    """A table of source C by league code in any spelling; an unknown season names those there are."""
    if table not in TABLES_C:
        raise ValueError(f"unknown table {table!r}; known: {', '.join(TABLES_C)}")
    competition = feed_league(league, catalog) if league else None
    df = read_table(spark, root, "c", table, columns, filters={"competition": competition, "season": season})
    if season is not None and df.isEmpty():
        known = available_seasons(spark, root, table, competition)
        raise ValueError(f"no {table} for {competition} {season}; seasons: {', '.join(known) or 'none'}")
    return df


def load_fixtures(
    spark: SparkSession, root: str, league: str, season: str | None = None, status: list[str] | None = None
) -> DataFrame:
    df = load_c(spark, root, "fixtures", league, season)
    return df.where(F.col("match_status").isin(status)) if status else df


def load_top_leagues(
    spark: SparkSession, root: str, season: str | None = None, columns: list[str] | None = None
) -> DataFrame:
    """Player statistics of the five top leagues with their short code; absent leagues are left out."""
    codes = {FEED_LEAGUES[lg]: lg for lg in TOP_LEAGUES}
    df = read_table(spark, root, "c", "player_stats", filters={"season": season})
    df = df.where(F.col("competition").isin(list(codes)))
    if df.isEmpty():
        raise ValueError("no data for any top league")
    from touchline.functions.names import lookup

    df = df.withColumn("league", lookup("competition", codes))
    return df.select(*check_columns(columns), "league") if columns else df


def load_metrics(spark: SparkSession, root: str, league: str, season: str | None = None) -> DataFrame:
    """Expected-metric table per player."""
    return read_table(spark, root, "c", "xmetrics", filters={"competition": feed_league(league), "season": season})


def load_precomputed(
    spark: SparkSession, root: str, table: str, season_end_year: int | None = None, columns: list[str] | None = None
) -> DataFrame:
    """Stored skills or match statistics."""
    return read_table(spark, root, "c", table, columns, filters={"season_end_year": season_end_year})


def load_predictions(spark: SparkSession, path: str, future_only: bool = False) -> DataFrame:
    df = spark.read.parquet(path)
    return df.where(F.to_date("match_date") >= F.current_date()) if future_only else df


def table_columns(df: DataFrame) -> list[str]:
    """Column names, from metadata alone."""
    return df.columns


def available_seasons(spark: SparkSession, root: str, table: str, competition: str | None = None) -> list[str]:
    """Seasons of a table, newest first: partition values only."""
    df = read_table(spark, root, "c", table, filters={"competition": competition})
    return [str(r[0]) for r in df.select("season").distinct().orderBy(F.desc("season")).collect()]


def seasons_of(df: DataFrame, **filters) -> DataFrame:
    """Distinct seasons under equality filters, newest first."""
    condition = equal_to(filters)
    kept = df.where(condition) if condition is not None else df
    return kept.select("season").distinct().orderBy(F.desc("season"))


def with_start_year(df: DataFrame, season: str = "season") -> DataFrame:
    return df.withColumn("season_input", start_year_label(season))
