"""Registered queries over the given tables, each with its SQL where SQL can state it."""

from touchline.queries import fits, forecasts, lineups_and_segments, players, sequences, tables_and_pages

MODULES = (sequences, lineups_and_segments, players, forecasts, tables_and_pages, fits)


def all_queries() -> dict:
    return {name: run for m in MODULES for name, run in m.QUERIES.items()}


def all_oracles() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
