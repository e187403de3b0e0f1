"""Competition dimensions and the catalog of leagues and seasons."""

from pyspark.sql import DataFrame, SparkSession, functions as F

# Source A competitions as (code, id, name, type, season format).
COMPETITIONS = [
    ("ENG", 9, "Premier League", "league", "YYYY-YYYY"),
    ("ESP", 12, "La Liga", "league", "YYYY-YYYY"),
    ("GER", 20, "Bundesliga", "league", "YYYY-YYYY"),
    ("ITA", 11, "Serie A", "league", "YYYY-YYYY"),
    ("FRA", 13, "Ligue 1", "league", "YYYY-YYYY"),
    ("UCL", 8, "UEFA Champions League", "european", "YYYY-YYYY"),
    ("UEL", 19, "UEFA Europa League", "european", "YYYY-YYYY"),
    ("FA_CUP", 514, "FA Cup", "cup", "YYYY-YYYY"),
    ("EFL_CUP", 690, "EFL Cup", "cup", "YYYY-YYYY"),
    ("COPA_DEL_REY", 569, "Copa del Rey", "cup", "YYYY-YYYY"),
    ("DFB_POKAL", 521, "DFB-Pokal", "cup", "YYYY-YYYY"),
    ("COPPA_ITALIA", 529, "Coppa Italia", "cup", "YYYY-YYYY"),
    ("COUPE_DE_FRANCE", 518, "Coupe de France", "cup", "YYYY-YYYY"),
    ("WC", 1, "FIFA World Cup", "national_team", "YYYY"),
    ("EURO", 676, "UEFA European Championship", "national_team", "YYYY"),
    ("COPA_AMERICA", 685, "Copa America", "national_team", "YYYY"),
    ("AFCON", 656, "Africa Cup of Nations", "national_team", "YYYY"),
    ("NATIONS_LEAGUE", 677, "UEFA Nations League", "national_team", "YYYY-YYYY"),
    ("GOLD_CUP", 681, "CONCACAF Gold Cup", "national_team", "YYYY"),
    ("ASIAN_CUP", 664, "AFC Asian Cup", "national_team", "YYYY"),
]

# Source B leagues as (code, name, slug, label).
COMPETITIONS_B = [
    ("ENG", "Premier League", "EPL", "EPL"),
    ("ESP", "La Liga", "La_liga", "La liga"),
    ("GER", "Bundesliga", "Bundesliga", "Bundesliga"),
    ("ITA", "Serie A", "Serie_A", "Serie A"),
    ("FRA", "Ligue 1", "Ligue_1", "Ligue 1"),
    ("RUS", "Russian Premier League", "RFPL", "RFPL"),
]

# Source C competition by short code.
FEED_LEAGUES = {
    "ENG": "EPL", "ESP": "La_Liga", "GER": "Bundesliga", "ITA": "Serie_A", "FRA": "Ligue_1", "NED": "Eredivisie",
    "POR": "Primeira_Liga", "TUR": "Super_Lig", "ENG2": "Championship", "SCO": "Scottish_Premiership", "UCL": "UCL",
    "UEL": "UEL", "UECL": "Conference_League", "WC": "World_Cup", "EURO": "UEFA_Euros",
}


def competitions(spark: SparkSession, kind: str = "all") -> DataFrame:
    rows = [c for c in COMPETITIONS if kind in ("all", c[3])]
    return spark.createDataFrame(rows, "code string, id int, name string, type string, season_format string")


def competitions_b(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(COMPETITIONS_B, "code string, name string, slug string, label string")


def is_tournament(code: str) -> bool:
    """Played within one calendar year."""
    found = [c for c in COMPETITIONS if c[0] == code]
    if not found:
        raise ValueError(f"unknown competition {code!r}")
    return found[0][4] == "YYYY"


def has_source_b(code: str) -> bool:
    return code in {c[0] for c in COMPETITIONS_B}


def code_of_label_b(label: str) -> str | None:
    return {c[3]: c[0] for c in COMPETITIONS_B}.get(label)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Catalog JSON as one row per competition.

    The file holds `competitions`, a map from code to name, country, type, tier, n_matches and
    seasons, and `aliases`, a map from short names to codes.
    """
    raw = spark.read.schema(
        "competitions map<string, struct<name:string, country:string, type:string, tier:int, n_matches:long, "
        "seasons:array<string>>>, aliases map<string, string>"
    ).json(path, multiLine=True)
    rows = raw.select(F.explode(F.map_entries("competitions")).alias("e"), "aliases")
    alias = F.map_keys(F.map_filter("aliases", lambda k, v: v == F.col("e.key")))
    return rows.select(
        F.col("e.key").alias("code"),
        "e.value.*",
        F.size("e.value.seasons").alias("n_seasons"),
        F.try_element_at(F.sort_array(alias), F.lit(1)).alias("alias"),
    )


def list_leagues(catalog: DataFrame, types: list[str] | None = None, tier: int | None = None) -> DataFrame:
    """Competitions of the given types, up to a tier, sorted by tier and name."""
    kept = catalog
    if types is not None:
        kept = kept.where(F.col("type").isin(types))
    if tier is not None:
        kept = kept.where(F.col("tier") <= tier)
    return kept.drop("seasons").orderBy("tier", "name")


def list_seasons(catalog: DataFrame, code: str) -> DataFrame:
    return catalog.where(F.col("code") == code).select(F.explode("seasons").alias("season")).orderBy(F.desc("season"))


def feed_league(league: str, catalog: DataFrame | None = None) -> str:
    """Source C code of a league given by short code, code or alias in any case."""
    upper = league.upper()
    if upper in FEED_LEAGUES:
        return FEED_LEAGUES[upper]
    known = {c.upper(): c for c in FEED_LEAGUES.values()}
    if upper in known:
        return known[upper]
    if catalog is not None:
        hit = catalog.where((F.upper("code") == upper) | (F.upper("alias") == upper)).select("code").first()
        if hit is not None:
            return hit[0]
    raise ValueError(f"unknown league {league!r}")


def feed_codes(df: DataFrame, league: str = "league") -> DataFrame:
    """Add `competition` to rows with short codes or codes of any case; unknown leagues raise."""
    spark = df.sparkSession
    names = {**{k.upper(): v for k, v in FEED_LEAGUES.items()}, **{v.upper(): v for v in FEED_LEAGUES.values()}}
    table = spark.createDataFrame(list(names.items()), "_name string, competition string")
    coded = df.join(F.broadcast(table), F.upper(league) == F.col("_name"), "left").drop("_name")
    bad = coded.where(F.col("competition").isNull()).select(league).distinct().take(5)
    if bad:
        raise ValueError(f"unknown leagues: {', '.join(str(r[0]) for r in bad)}")
    return coded
