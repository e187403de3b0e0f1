"""Season labels and match clock expressions."""

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from touchline.functions.numeric import col


def season_of_match_key(c) -> Column:
    """`YYYY-YYYY` prefix of a match key; the text itself when there is none."""
    found = F.regexp_extract(col(c), r"^([0-9]{4}-[0-9]{4})_", 1)
    return F.when(found != "", found).otherwise(col(c))


def season_end_year_of_match_key(c) -> Column:
    text = F.substring(season_of_match_key(c), 6, 4)
    return F.when(text.rlike("^[0-9]{4}$"), text).cast("double")


def season_end_year(c) -> Column:
    """End year of `YYYY-YYYY`, else a leading four-digit year, else NULL."""
    c = col(c).cast("string")
    full = F.regexp_extract(c, r"^\d{4}-(\d{4})$", 1)
    lead = F.regexp_extract(c, r"^(\d{4})", 1)
    return F.when(full != "", full).when(lead != "", lead).cast("int")


def season_of_date(c, start_month: int = 8) -> Column:
    """`YYYY-YYYY` label; months before `start_month` belong to the season begun last year."""
    start = F.when(F.month(col(c)) < start_month, F.year(col(c)) - 1).otherwise(F.year(col(c)))
    return F.concat_ws("-", start, start + 1)


def season_end_year_of_date(c, start_month: int = 7) -> Column:
    return F.when(F.month(col(c)) >= start_month, F.year(col(c)) + 1).otherwise(F.year(col(c)))


def season_of_url(c) -> Column:
    return F.nullif(F.regexp_extract(col(c), r"(\d{4}-\d{4})", 1), F.lit(""))


def start_year_label(c) -> Column:
    """`2023-2024` -> `2023`; labels without a dash pass through."""
    c = col(c)
    return F.when(F.contains(c, F.lit("-")), F.substring(c, 1, 4)).otherwise(c)


def full_season_label(c) -> Column:
    """`2023` -> `2023-2024`."""
    year = col(c).cast("int")
    return F.concat_ws("-", year, year + 1)


def seasons_since(spark: SparkSession, start_year: int, today: date | None = None) -> DataFrame:
    """One row per season from `start_year` to the running one; a season begins in July."""
    today = today or date.today()
    last = today.year if today.month >= 7 else today.year - 1
    year = F.col("id").cast("int")
    return spark.range(start_year, last + 1).select(
        F.concat_ws("-", year, year + 1).alias("season"), year.cast("string").alias("start_year")
    )


# Years in which tournaments were held.
TOURNAMENT_YEARS = {
    "WC": ["2018", "2022", "2026"],
    "EURO": ["2020", "2024"],
    "COPA_AMERICA": ["2019", "2021", "2024"],
    "AFCON": ["2019", "2021", "2023"],
    "GOLD_CUP": ["2019", "2021", "2023"],
    "ASIAN_CUP": ["2019", "2023"],
}


def tournament_years(code: str) -> list[str]:
    if code not in TOURNAMENT_YEARS:
        raise ValueError(f"unknown tournament {code!r}; known: {', '.join(TOURNAMENT_YEARS)}")
    return TOURNAMENT_YEARS[code]


def clock_parts(c) -> tuple[Column, Column]:
    """Minute and added time out of texts like `90+4`."""
    text = F.split(col(c).cast("string"), r"\+")
    base = F.try_element_at(text, F.lit(1))
    added = F.try_element_at(text, F.lit(2))
    as_number = lambda t: F.when(F.trim(t).rlike(r"^-?[0-9.]+$"), F.trim(t)).cast("double")
    return as_number(base), F.coalesce(as_number(added), F.lit(0.0))


def clock_decimal(c) -> Column:
    """`45+2` -> 45.2: stoppage encoded as tenths; NULL for empty text."""
    text = col(c).cast("string")
    parts = F.split(text, r"\+")
    digits = lambda t: F.nullif(F.regexp_replace(t, "[^0-9]", ""), F.lit("")).cast("double")
    added = digits(F.try_element_at(parts, F.lit(2)))
    base = digits(F.try_element_at(parts, F.lit(1)))
    return F.when(F.contains(text, F.lit("+")), base + added / 10).otherwise(base)
