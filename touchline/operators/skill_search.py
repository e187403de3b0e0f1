"""Search of prior strength, decay and prior centre per statistic by walk-forward loss."""

import itertools
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from touchline.functions.numeric import clamp
from touchline.operators.ordering import HotGroups, hot_groups
from touchline.operators.ranking import exact_quantiles, modal_value
from touchline.operators.skills import (
    EFFICIENCY_STATS,
    HISTORY,
    STAT_TIERS,
    DecayParams,
    Population,
    _history,
    _known,
    _player_means,
    exposure,
    log_loss,
    population,
    position_group,
)
from touchline.session import free_shuffles

PRIOR_BOUNDS = {True: (0.1, 500.0), False: (0.1, 100.0)}
LAMBDA_BOUNDS = (0.0, 0.02)
QUANTILE_BOUNDS = (0.05, 0.95)


def _grid(low: float, high: float, n: int, log: bool) -> list[float]:
    if low == high or n == 1:
        return [low]
    if log:
        return [float(v) for v in np.geomspace(max(low, 1e-3), high, n)]
    return [float(v) for v in np.linspace(low, high, n)]


@dataclass(frozen=True)
class Held:
    """Matches of the search, kept on disk in order by player with the player's position, and what is known of all players."""

    rows: DataFrame
    known: Population
    hot: HotGroups
    dealt: bool


@contextmanager
def _held(match_stats: DataFrame, stats: list[str], hot: HotGroups | None) -> Iterator[Held]:
    """The matches once, in the columns the search needs; every pass over them reads these."""
    df = match_stats.withColumn("match_date", F.to_date("match_date"))
    hot = hot_groups(df, HISTORY.keys) if hot is None else hot
    known = population(df, stats, DecayParams())
    needed = {*HISTORY.keys, *HISTORY.by, "total_minutes", *stats, *(c for s in stats for c in EFFICIENCY_STATS.get(s, []))}
    modal = modal_value(df.withColumn("pos_group", position_group()), ["player_id"], "pos_group", "_group")
    rows = df.select(*[c for c in df.columns if c in needed])
    rows = (rows if hot.rows else rows.repartition(*HISTORY.keys)).join(modal, "player_id", "left")
    rows = rows if hot.rows else rows.sortWithinPartitions(*HISTORY.keys, *HISTORY.by)
    rows.persist(StorageLevel.DISK_ONLY)
    try:
        rows.count()
        free_shuffles(df.sparkSession)
        yield Held(rows, known, hot, not hot.rows)
    finally:
        rows.unpersist()


def _losses(held: Held, stat: str, grid: list[tuple[float, float, float]], multipliers: dict[str, float] | None, min_history: int) -> list[float]:
    df = held.rows
    lambdas = sorted({lam for _, lam, _ in grid})
    past = _history(df, [stat], {stat: lambdas}, held.hot, held.known.first_day, held.dealt)
    ratio = F.lit(1.0)
    for g, m in (multipliers or {}).items():
        ratio = F.when(F.col("_group") == g, F.lit(float(m))).otherwise(ratio)
    is_ratio = stat in EFFICIENCY_STATS
    weight = exposure(df.columns, stat)
    rows = past.where((F.col("p_seen") >= min_history) & (_known("total_minutes") > 0)).withColumns(
        {"_ratio": ratio, "_weight": weight, "_actual": _known(stat)}
    )
    losses = []
    for n, (k, lam, mean) in enumerate(grid):
        j = lambdas.index(lam)
        fade = F.exp(F.lit(-lam) * F.col("_t"))
        centre = F.lit(float(mean)) * F.col("_ratio")
        if is_ratio:
            centre = clamp(centre, 1e-6, 1 - 1e-6)
        predicted = (centre * F.lit(k) + F.col(f"p_x0_{j}") * fade) / (F.lit(k) + F.col(f"p_e0_{j}") * fade)
        miss = predicted - F.col("_actual")
        loss = log_loss(F.col("_actual"), predicted) if is_ratio else miss * miss
        losses.append(F.try_divide(F.sum(F.col("_weight") * loss), F.sum("_weight")).alias(f"l{n}"))
    values = rows.agg(*losses).first()
    return [1e6 if v is None else float(v) for v in values]


def walk_forward_losses(
    match_stats: DataFrame,
    stat: str,
    grid: list[tuple[float, float, float]],
    multipliers: dict[str, float] | None = None,
    min_history: int = 5,
    hot: HotGroups | None = None,
) -> list[float]:
    """Mean loss per (prior strength, decay, prior mean), all in one pass over the matches."""
    with _held(match_stats, [stat], hot) as held:
        return _losses(held, stat, grid, multipliers, min_history)


def search_stat(match_stats: DataFrame, stat: str, hot: HotGroups | None = None, **options) -> dict:
    """Coarse-to-fine grid search; every round is one job over the matches. Options are those of `_search`."""
    with _held(match_stats, [stat], hot) as held:
        return _search(held, stat, **options)


def _search(
    held: Held,
    stat: str,
    lam: float = 0.003,
    prior_bounds: tuple[float, float] | None = None,
    lambda_bounds: tuple[float, float] = LAMBDA_BOUNDS,
    quantile_bounds: tuple[float, float] = QUANTILE_BOUNDS,
    search_lambda: bool = False,
    search_quantile: bool = False,
    min_history: int = 5,
    rounds: int = 3,
    points: int = 6,
) -> dict:
    is_ratio = stat in EFFICIENCY_STATS
    low, high = prior_bounds or PRIOR_BOUNDS[is_ratio]
    mean, multipliers = held.known.means[stat], held.known.ratios[stat]
    player_means = _player_means(held.rows, stat) if search_quantile else None
    box = {
        "prior": (low, high),
        "lambda": lambda_bounds if search_lambda else (lam, lam),
        "quantile": quantile_bounds if search_quantile else (0.5, 0.5),
    }
    best = None
    for _ in range(rounds):
        priors = _grid(*box["prior"], points, log=True)
        lambdas = _grid(*box["lambda"], points if search_lambda else 1, log=False)
        quantiles = _grid(*box["quantile"], points if search_quantile else 1, log=False)
        if search_quantile:
            row = exact_quantiles(player_means, "_mean", {f"q{i}": q for i, q in enumerate(quantiles)}).first()
            centres = dict(zip(quantiles, row))
        else:
            centres = {quantiles[0]: mean}
        cells = list(itertools.product(priors, lambdas, quantiles))
        losses = _losses(held, stat, [(k, l, centres[q]) for k, l, q in cells], multipliers, min_history)
        at = int(np.argmin(losses))
        if best is None or losses[at] < best["loss"]:
            k, l, q = cells[at]
            best = {
                "stat": stat, "loss": losses[at], "optimal_prior": k, "optimal_lambda": l,
                "optimal_quantile": q if search_quantile else None,
                "prior_center": centres[q], "loss_type": "logloss" if is_ratio else "mse", "is_efficiency": is_ratio,
            }
        box["prior"] = _around(priors, best["optimal_prior"], box["prior"])
        if search_lambda:
            box["lambda"] = _around(lambdas, best["optimal_lambda"], box["lambda"])
        if search_quantile:
            box["quantile"] = _around(quantiles, best["optimal_quantile"], box["quantile"])
    return best


def _around(points: list[float], value: float, bounds: tuple[float, float]) -> tuple[float, float]:
    """Neighbouring grid points of the best value."""
    below = [p for p in points if p < value]
    above = [p for p in points if p > value]
    return (max(below) if below else min(value, bounds[0]), min(above) if above else max(value, bounds[1]))


def search_all(
    match_stats: DataFrame,
    params: DecayParams = DecayParams(),
    stats: list[str] | None = None,
    search_lambda: bool = True,
    search_quantile: bool = False,
    hot: HotGroups | None = None,
    **options,
) -> tuple[DecayParams, DataFrame]:
    """Search every statistic of the tiers that is present; new parameters and the search table."""
    wanted = stats or [s for tier in ("tier1", "tier2", "xmetrics", "efficiency") for s in STAT_TIERS[tier]]
    present = [s for s in wanted if s in match_stats.columns]
    found = []
    if present:
        with _held(match_stats, present, hot) as held:
            found = [_search(held, s, lam=params.decay(s), search_lambda=search_lambda, search_quantile=search_quantile, **options) for s in present]
    tuned = DecayParams(
        params.rate, params.efficiency, params.xmetrics, params.prior_90s, params.prior_attempts,
        {r["stat"]: r["optimal_lambda"] for r in found},
        {r["stat"]: r["optimal_prior"] for r in found},
        {r["stat"]: r["prior_center"] for r in found},
        {r["stat"]: r["optimal_quantile"] for r in found if r["optimal_quantile"] is not None},
    )
    schema = (
        "stat string, loss double, optimal_prior double, optimal_lambda double, optimal_quantile double, "
        "prior_center double, loss_type string, is_efficiency boolean"
    )
    names = [c.split()[0] for c in schema.split(", ")]
    table = SparkSession.active().createDataFrame([tuple(r[c] for c in names) for r in found], schema)
    return tuned, table
