"""Ridge of wide sparse designs: one Krylov space per training set serves every penalty.

The system of a penalty is the same matrix with another number on its diagonal, so conjugate gradients for all penalties share
their matrix products (multi-shift). A product is one pass over the sparse rows, and a pass serves all training sets at once: those of
the folds and the whole. Partitions add up their own rows; Spark adds the partitions; the driver keeps vectors, never a matrix of
features by features. Unpenalised columns are few and are projected out by their own cross products.
"""

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from touchline.session import cut_lineage

#: Largest piece of vectors, in numbers, that is sent along with one pass of the held-out errors.
SENT_NUMBERS = 8_000_000


@dataclass
class SparseRows:
    """Encoded rows `idx, num, y, w, fold`: places of the 0/1 features, values of the numeric columns behind them."""

    rows: DataFrame
    n_features: int
    n_numeric: int
    n_folds: int
    #: Passes over the rows so far.
    passes: int = 0

    @property
    def columns(self) -> int:
        return self.n_features + self.n_numeric

    def summed(self, width: int, partial) -> np.ndarray:
        """One pass: `partial(idx, offsets, num, y, w, fold)` gives columns x width numbers a batch; their sum over all rows."""
        self.passes += 1
        size = self.columns

        def run(batches):
            total = np.zeros((size, width))
            for b in batches:
                if b.num_rows:
                    total += partial(*_arrays(b))
            used = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *[pa.array(total[used, k]) for k in range(width)]], ["idx", *[f"s{k}" for k in range(width)]])

        schema = "idx int, " + ", ".join(f"s{k} double" for k in range(width))
        sums = self.rows.mapInArrow(run, schema).groupBy("idx").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(width)]).toArrow()
        out = np.zeros((size, width))
        if sums.num_rows:
            out[sums["idx"].to_numpy()] = np.column_stack([sums[f"s{k}"].to_numpy() for k in range(width)])
        return out

    def products(self, vectors: np.ndarray) -> np.ndarray:
        """Weighted cross-product matrix of each training set times its own column of `vectors` (columns x sets); the last set is all rows."""
        n_features, n_folds = self.n_features, self.n_folds

        def partial(idx, offsets, num, y, w, fold):
            part = _row_sums(vectors[idx], offsets) + num @ vectors[n_features:]
            part *= w[:, None]
            part[np.arange(len(w)), fold] = 0.0  # a fold's rows are not in its training set
            return _spread(part, idx, offsets, num, len(vectors))

        return self.summed(n_folds + 1, partial)

    def held_out(self, coefs: np.ndarray, intercepts: np.ndarray) -> np.ndarray:
        """Weighted squared error sums on each fold of its path's points: coefs is folds x points x columns."""
        n_features, n_folds, n_points = self.n_features, self.n_folds, coefs.shape[1]
        errors = np.zeros((n_folds, n_points))
        step = max(1, SENT_NUMBERS // max(1, n_folds * coefs.shape[2]))
        for at in range(0, n_points, step):
            self.passes += 1
            table = np.ascontiguousarray(np.transpose(coefs[:, at : at + step], (0, 2, 1)))
            level = intercepts[:, at : at + step]

            def run(batches, table=table, level=level):
                total = np.zeros(level.shape)
                for b in batches:
                    if b.num_rows:
                        idx, offsets, num, y, w, fold = _arrays(b)
                        owner = np.repeat(fold, np.diff(offsets))
                        fit = _row_sums(table[owner, idx], offsets) + level[fold] + np.einsum("ij,ijk->ik", num, table[fold][:, n_features:])
                        np.add.at(total, fold, w[:, None] * (y[:, None] - fit) ** 2)
                fold, point = np.nonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(fold, pa.int32()), pa.array(point, pa.int32()), pa.array(total[fold, point])], ["fold", "point", "s"])

            got = self.rows.mapInArrow(run, "fold int, point int, s double").groupBy("fold", "point").agg(F.sum("s").alias("s")).collect()
            for r in got:
                errors[r.fold, at + r.point] = r.s
        return errors


def _arrays(batch: pa.RecordBatch):
    lists, numbers = batch["idx"], batch["num"]
    offsets = lists.offsets.to_numpy()
    idx = lists.values.to_numpy()[offsets[0] : offsets[-1]]
    num = numbers.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    return idx, offsets - offsets[0], num, batch["y"].to_numpy(), batch["w"].to_numpy(), batch["fold"].to_numpy()


def _row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of each row's entries; rows may have none."""
    total = np.vstack([np.zeros((1, values.shape[1])), np.cumsum(values, axis=0)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _spread(part: np.ndarray, idx: np.ndarray, offsets: np.ndarray, num: np.ndarray, size: int) -> np.ndarray:
    """Transposed rows times `part`: each row's numbers go to all its columns."""
    out = np.zeros((size, part.shape[1]))
    entries = part[np.repeat(np.arange(len(part)), np.diff(offsets))]
    n_features = size - num.shape[1]
    for k in range(part.shape[1]):
        out[:n_features, k] = np.bincount(idx, weights=entries[:, k], minlength=n_features)
    out[n_features:] = num.T @ part
    return out


def encoded(rows: DataFrame, features: list[str], numeric: list[str], n_folds: int, fold_key: str = "match_id") -> SparseRows:
    """Rows with a finite target, their features as places; written once, so that passes read numbers only."""
    place = {f: k for k, f in enumerate(features)}
    used = rows.where(F.col("y").isNotNull() & (F.abs("y") < float("inf"))).select(
        "tokens", F.array(*[F.col(c).cast("double") for c in numeric]).cast("array<double>").alias("num"),
        F.col("y").cast("double").alias("y"), F.col("weight").cast("double").alias("w"),
        F.pmod(F.xxhash64(fold_key), F.lit(n_folds)).cast("int").alias("fold"),
    )

    def run(batches):
        for b in batches:
            tokens = b["tokens"]
            idx = pa.array([[place[t] for t in own if t in place] for own in tokens.to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([idx, b["num"], b["y"], b["w"], b["fold"]], ["idx", "num", "y", "w", "fold"])

    return SparseRows(cut_lineage(used.mapInArrow(run, "idx array<int>, num array<double>, y double, w double, fold int")), len(features), len(numeric), n_folds)


@dataclass
class Moments:
    """Sums of the training sets, one of each per set: the folds' complements, then all rows."""

    n: np.ndarray
    mean: np.ndarray  # sets x columns
    y_mean: np.ndarray
    y_var: np.ndarray
    xy: np.ndarray  # sets x columns, centred
    free: np.ndarray  # sets x free columns x columns, centred
    fold_weight: np.ndarray


def moments(data: SparseRows, free: list[int]) -> Moments:
    """All sums that need no vector, in one pass: per column and fold its weight, its product with the target and with the free columns."""
    n_folds, n_features, size = data.n_folds, data.n_features, data.columns
    width = 2 + len(free)
    spots = {c: k for k, c in enumerate(free)}

    def partial(idx, offsets, num, y, w, fold):
        out = np.zeros((size, n_folds * width))
        owner = np.repeat(np.arange(len(w)), np.diff(offsets))
        values = np.zeros((len(w), width))
        values[:, 0], values[:, 1] = 1.0, y
        for c, k in spots.items():
            values[:, 2 + k] = num[:, c - n_features] if c >= n_features else np.bincount(owner[idx == c], minlength=len(w))
        for f in np.unique(fold):
            own = fold == f
            part = np.where(own[:, None], values * w[:, None], 0.0)
            out[:, f * width : (f + 1) * width] += _spread(part, idx, offsets, num, size)
        return out

    # the target's own sums come from a plain aggregate
    own = data.rows.groupBy("fold").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("wy"), F.sum(F.col("w") * F.col("y") * F.col("y")).alias("wyy")).collect()
    data.passes += 1
    plain = np.zeros((n_folds, 3))
    for r in own:
        plain[r.fold] = r.w, r.wy, r.wyy
    by_fold = data.summed(n_folds * width, partial).reshape(size, n_folds, width)
    total = by_fold.sum(axis=1)
    sets = np.concatenate([total[:, None] - by_fold, total[:, None]], axis=1)  # columns x sets x width
    target = np.concatenate([plain.sum(axis=0) - plain, plain.sum(axis=0)[None]])
    n = np.maximum(target[:, 0], 1e-300)
    mean, y_mean = (sets[:, :, 0] / n).T, target[:, 1] / n
    xy = (sets[:, :, 1] / n).T - mean * y_mean[:, None]
    cross = np.transpose(sets[:, :, 2:] / n[None, :, None], (1, 2, 0)) - mean[:, free][:, :, None] * mean[:, None, :]
    return Moments(target[:, 0], mean, y_mean, np.maximum(target[:, 2] / n - y_mean**2, 0), xy, cross, plain[:, 0])


@dataclass
class Shifted:
    """Conjugate gradients on `A + shift` for many shifts, of one training set."""

    b: np.ndarray
    shifts: np.ndarray  # the first is the smallest; its residual is the largest
    x: np.ndarray = field(init=False)

    def __post_init__(self):
        k = len(self.shifts)
        self.x = np.zeros((k, len(self.b)))
        self.r, self.p = self.b.copy(), self.b.copy()
        self.ps = np.repeat(self.b[None], k, axis=0)
        self.zeta, self.zeta_before = np.ones(k), np.ones(k)
        self.alpha_before, self.beta = 1.0, 0.0
        self.rr = float(self.b @ self.b)
        self.goal = self.rr

    def done(self, tolerance: float) -> bool:
        return self.rr <= tolerance**2 * self.goal or self.rr == 0

    def step(self, ap: np.ndarray) -> None:
        """`ap` is A times the direction `p`, without a shift."""
        ap = ap + self.shifts[0] * self.p
        alpha = self.rr / float(self.p @ ap)
        extra = self.shifts - self.shifts[0]
        bottom = alpha * self.beta * (self.zeta_before - self.zeta) + self.zeta_before * self.alpha_before * (1 + alpha * extra)
        # a shift whose residual has vanished keeps its solution
        live = np.abs(self.zeta) > 1e-150
        now = np.where(live, self.zeta * self.zeta_before * self.alpha_before / np.where(live, bottom, 1.0), 0.0)
        ratio = np.where(live, now / np.where(live, self.zeta, 1.0), 0.0)
        self.x += (alpha * ratio)[:, None] * self.ps
        self.r = self.r - alpha * ap
        rr = float(self.r @ self.r)
        self.beta = rr / self.rr
        self.p = self.r + self.beta * self.p
        self.ps = now[:, None] * self.r[None] + (self.beta * ratio**2)[:, None] * self.ps
        self.zeta_before, self.zeta, self.alpha_before, self.rr = self.zeta, now, alpha, rr


def solve_paths(data: SparseRows, m: Moments, held: list[int], free: list[int], lambdas: np.ndarray, folds: bool = True, tolerance: float = 1e-10, most_steps: int = 2000):
    """Coefficients (sets x penalties x columns) and intercepts of every training set; the last set is all rows.

    Sets without weight have zeros. Each step of all sets and penalties is one pass. A system that is not solved after `most_steps`
    is an error.
    """
    sets = range(data.n_folds + 1) if folds else [data.n_folds]
    order = np.argsort(lambdas)
    scale = (len(held) + len(free)) / max(len(held), 1)
    tables, systems = {}, {}
    for s in sets:
        if m.n[s] <= 0 or m.y_var[s] <= 0 or not held:
            continue
        inverse = np.linalg.pinv(m.free[s][:, free]) if free else np.zeros((0, 0))
        side = m.free[s][:, held] if free else np.zeros((0, len(held)))
        tables[s] = inverse, side
        b = m.xy[s][held] - side.T @ (inverse @ m.xy[s][free])
        systems[s] = Shifted(b, lambdas[order] * scale / np.sqrt(m.y_var[s]))
    for _ in range(most_steps):
        going = [s for s, system in systems.items() if not system.done(tolerance)]
        if not going:
            break
        vectors = np.zeros((data.columns, data.n_folds + 1))
        for s in going:
            vectors[held, s] = systems[s].p
        sums = data.products(vectors)
        for s in going:
            p, (inverse, side) = systems[s].p, tables[s]
            ap = sums[held, s] / m.n[s] - m.mean[s][held] * (m.mean[s][held] @ p)
            systems[s].step(ap - side.T @ (inverse @ (side @ p)))
    else:
        raise RuntimeError(f"not solved after {most_steps} steps; largest residual {max(np.sqrt(s.rr / s.goal) for s in systems.values() if s.goal):.1e}")
    coefs, intercepts = np.zeros((data.n_folds + 1, len(lambdas), data.columns)), np.repeat(m.y_mean[:, None], len(lambdas), axis=1)
    for s in sets:
        if s in systems:
            beta = np.empty_like(systems[s].x)
            beta[order] = systems[s].x
            coefs[s][:, held] = beta
            if free:
                inverse, side = tables[s]
                coefs[s][:, free] = (inverse @ (m.xy[s][free][:, None] - side @ beta.T)).T
            intercepts[s] = m.y_mean[s] - coefs[s] @ m.mean[s]
    return coefs, intercepts
