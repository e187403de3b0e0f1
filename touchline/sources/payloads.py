"""Match tables out of JSON embedded in pages and of JSON match payloads (source B)."""

import re

from pyspark.sql import Column, DataFrame, functions as F

# Match fields by output column, with their type.
MATCH_FIELDS = {
    "home_team": ("team_h", "string"), "away_team": ("team_a", "string"), "home_team_id": ("h", "string"),
    "away_team_id": ("a", "string"), "home_score": ("h_goals", "int"), "away_score": ("a_goals", "int"),
    "home_xg": ("h_xg", "double"), "away_xg": ("a_xg", "double"), "match_date": ("date", "string"),
    "league": ("league", "string"), "season": ("season", "string"), "home_shots": ("h_shot", "int"),
    "away_shots": ("a_shot", "int"), "home_shots_on_target": ("h_shotOnTarget", "int"),
    "away_shots_on_target": ("a_shotOnTarget", "int"), "home_deep": ("h_deep", "int"), "away_deep": ("a_deep", "int"),
    "home_ppda": ("h_ppda", "double"), "away_ppda": ("a_ppda", "double"),
}


def snake_case(name: str) -> str:
    """Lower snake case: xGChain -> x_g_chain, player_id -> player_id."""
    text = re.sub(r"[^A-Za-z0-9]+", "_", name)
    text = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", text)
    text = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", text)
    return text.strip("_").lower()


def embedded_json(html, variable: str) -> Column:
    """Text of `var <variable> = JSON.parse('...')` in a page with its \\xNN escapes undone."""
    html = F.col(html) if isinstance(html, str) else html
    raw = F.regexp_extract(html, variable + r"\s*=\s*JSON\.parse\('([^']*)'\)", 1)
    # \xNN is \u00NN, which a JSON string reader undoes.
    quoted = F.concat(F.lit('{"t":"'), F.regexp_replace(F.regexp_replace(raw, '"', r'\\\\"'), r"\\x([0-9A-Fa-f]{2})", r"\\u00$1"), F.lit('"}'))
    return F.when(raw != "", F.get_json_object(quoted, "$.t"))


def match_metadata(pages: DataFrame, html: str = "html", variable: str = "match_info") -> DataFrame:
    """One row per page with the fields of its embedded match object, NULL where absent."""
    parsed = pages.withColumn("_m", F.from_json(embedded_json(html, variable), "map<string,string>"))
    fields = [
        F.try_element_at("_m", F.lit(name)).try_cast(kind).alias(out) for out, (name, kind) in MATCH_FIELDS.items()
    ]
    keep = [F.col(c) for c in pages.columns if c != html]
    return parsed.where(F.col("_m").isNotNull()).select(*keep, *fields)


def _records(payloads: DataFrame, key: str, part: str, json: str, fields: list[str], as_list: bool) -> DataFrame:
    """Records of both sides of one payload part as rows."""
    record = "map<string,string>"
    shape = f"array<{record}>" if as_list else f"map<string,{record}>"
    sides = payloads.withColumn("_p", F.from_json(F.get_json_object(json, f"$.{part}"), f"struct<h:{shape},a:{shape}>"))
    values = lambda side: F.coalesce(
        F.col(f"_p.{side}") if as_list else F.map_values(f"_p.{side}"), F.expr(f"cast(array() as array<{record}>)")
    )
    tagged = lambda side, home: F.transform(values(side), lambda r: F.struct(F.lit(home).alias("is_home"), r.alias("r")))
    rows = sides.select(key, F.explode(F.concat(tagged("h", True), tagged("a", False))).alias("x"))
    return rows.select(
        key, F.col("x.is_home").alias("is_home"),
        *[F.try_element_at(F.col("x.r"), F.lit(f)).alias(snake_case(f)) for f in fields if snake_case(f) != key],
    )


# Record fields of rosters and shots.
ROSTER_FIELDS = [
    "id", "goals", "own_goals", "shots", "xG", "time", "player_id", "team_id", "position", "player", "h_a",
    "yellow_card", "red_card", "roster_in", "roster_out", "key_passes", "assists", "xA", "xGChain", "xGBuildup",
    "positionOrder",
]
SHOT_FIELDS = [
    "id", "minute", "result", "X", "Y", "xG", "player", "h_a", "player_id", "situation", "season", "shotType",
    "match_id", "h_team", "a_team", "h_goals", "a_goals", "date", "player_assisted", "lastAction",
]


def rosters(payloads: DataFrame, key: str = "match_id", json: str = "payload") -> DataFrame:
    """Player rows out of `{"rosters": {"h": {id: {...}}, "a": {...}}}`."""
    return _records(payloads, key, "rosters", json, ROSTER_FIELDS, as_list=False)


def shots(payloads: DataFrame, key: str = "payload_id", json: str = "payload") -> DataFrame:
    """Shot rows out of `{"shots": {"h": [{...}], "a": [...]}}`."""
    return _records(payloads, key, "shots", json, SHOT_FIELDS, as_list=True)
