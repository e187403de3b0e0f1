"""Player, team and match naming expressions."""

from itertools import chain

from pyspark.sql import Column, functions as F

from touchline.functions.numeric import col

# Team name variants and their canonical names.
TEAM_ALIASES = {
    "Manchester Utd": "Manchester United",
    "Man Utd": "Manchester United",
    "Man United": "Manchester United",
    "Man City": "Manchester City",
    "Tottenham": "Tottenham Hotspur",
    "Spurs": "Tottenham Hotspur",
    "Wolves": "Wolverhampton Wanderers",
    "Wolverhampton": "Wolverhampton Wanderers",
    "Brighton": "Brighton & Hove Albion",
    "Brighton and Hove Albion": "Brighton & Hove Albion",
    "West Ham": "West Ham United",
    "Newcastle": "Newcastle United",
    "Nott'ham Forest": "Nottingham Forest",
    "Nottingham": "Nottingham Forest",
    "Sheffield Utd": "Sheffield United",
    "Leeds": "Leeds United",
    "Leicester": "Leicester City",
}

_ACCENTED = "àáâãäåāăąçćčďđèéêëēėęěğìíîïīıłñńňòóôõöøōőřśšşťţùúûüūůűýÿžźż"
_PLAIN = "aaaaaaaaacccddeeeeeeeegiiiiiilnnnoooooooorsssttuuuuuuuyyzzz"


def lookup(c, mapping: dict) -> Column:
    """Value of a small fixed dictionary, NULL for unknown keys."""
    pairs = chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items())
    return F.try_element_at(F.create_map(*pairs), col(c))


def player_display_name(c) -> Column:
    """Trimmed, single-spaced, generational suffix dropped, one capital per word."""
    text = F.regexp_replace(F.trim(col(c)), r"\s+", " ")
    text = F.regexp_replace(text, r"\s+(Jr\.|Sr\.|II|III|IV)$", "")
    return F.initcap(F.lower(text))


def player_key(c) -> Column:
    """Join key for player names: lower case without any whitespace."""
    text = F.lower(F.trim(F.regexp_replace(col(c), "\u00a0", " ")))
    return F.regexp_replace(text, r"\s+", "")


def strip_accents(c) -> Column:
    return F.translate(col(c), _ACCENTED, _PLAIN)


def player_id_from_href(c) -> Column:
    """Eight hex digits out of `/players/<id>/...`, else NULL."""
    return F.nullif(F.regexp_extract(col(c), r"/players/([a-f0-9]{8})/", 1), F.lit(""))


def team_name(c) -> Column:
    trimmed = F.trim(col(c))
    return F.coalesce(lookup(trimmed, TEAM_ALIASES), trimmed)


def match_key(season, date, home, away) -> Column:
    return F.concat_ws("_", col(season), F.date_format(col(date), "yyyyMMdd"), col(home), col(away))


def player_slug(name, external_id=None) -> Column:
    """External id when present, else the name as a lower-case slug."""
    slug = F.regexp_replace(F.lower(col(name)), "[^a-z0-9]+", "_")
    slug = F.regexp_replace(F.regexp_replace(slug, "_+", "_"), "^_|_$", "")
    if external_id is None:
        return slug
    return F.coalesce(F.nullif(col(external_id), F.lit("")), slug)


def initial_form(name: str) -> str:
    """'Bukayo Saka' -> 'B. Saka'; single words stay as they are."""
    parts = name.split()
    return f"{parts[0][0]}. {' '.join(parts[1:])}" if len(parts) > 1 else name


def initial_form_column(c) -> Column:
    words = F.split(F.trim(col(c)), r"\s+")
    rest = F.concat_ws(" ", F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(1))))
    return F.when(
        F.size(words) > 1, F.concat(F.substring(words[0], 1, 1), F.lit(". "), rest)
    ).otherwise(col(c))


def matches_text(c, pattern: str) -> Column:
    """Case-insensitive regex test."""
    return col(c).rlike("(?i)" + pattern)
