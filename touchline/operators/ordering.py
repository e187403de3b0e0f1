"""Ordered-group operators that stay parallel when one group holds much of the data.

`lag`, running sums and look-ahead over `partitionBy(match)` put one group in one task.
That is right for real matches (a few thousand rows), so cold groups use plain windows
and share one shuffle and sort. Groups above a row limit are cut into chunks of their
order, worked on chunk by chunk, and joined by a small per-chunk summary.
"""

from collections.abc import Callable
from dataclasses import dataclass, replace
from math import ceil

from pyspark.sql import Column, DataFrame, Window as W, WindowSpec, functions as F, types as T

from touchline.functions.numeric import col
from touchline.session import cut_lineage

CHUNK = "_chunk"
HOT_ROWS = 2_000_000


@dataclass(frozen=True)
class Ordering:
    """Groups (`keys`) with a total order (`by`) and a number that never falls along it (`position`)."""

    keys: tuple[str, ...]
    by: tuple[str, ...]
    position: str
    chunked: bool = False

    def within(self, *extra: str) -> "Ordering":
        """The same order inside finer groups."""
        return replace(self, keys=self.keys + extra)

    @property
    def parts(self) -> list[str]:
        return [*self.keys, CHUNK] if self.chunked else list(self.keys)

    def window(self) -> WindowSpec:
        return W.partitionBy(*self.parts).orderBy(*self.by)

    def _chunks(self) -> WindowSpec:
        return W.partitionBy(*self.keys).orderBy(CHUNK)

    def _join_summary(self, df: DataFrame, summary: DataFrame) -> DataFrame:
        renamed = summary.withColumnsRenamed({k: f"_s_{k}" for k in self.parts})
        same = [F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in self.parts]
        joined = df.join(renamed, on=_all(same), how="left")
        return joined.drop(*[f"_s_{k}" for k in self.parts])

    def shift(self, df: DataFrame, columns: dict[str, tuple[str | Column, int]]) -> DataFrame:
        """Neighbour values: offset k > 0 looks k rows back, k < 0 looks |k| rows ahead."""
        w = self.window()
        near = {
            out: F.lag(col(c), k).over(w) if k > 0 else F.lead(col(c), -k).over(w)
            for out, (c, k) in columns.items()
        }
        if not self.chunked:
            return df.withColumns(near)

        reach = max(abs(k) for _, k in columns.values())
        names = {out: f"_v{i}" for i, out in enumerate(columns)}
        held = cut_lineage(df).withColumns({names[o]: col(c) for o, (c, _) in columns.items()})
        held = held.withColumns(
            {
                "_rn": F.row_number().over(w),
                "_left": F.count(F.lit(1)).over(W.partitionBy(*self.parts)),
            }
        ).withColumn("_left", F.col("_left") - F.col("_rn") + 1)
        held = held.withColumns(
            {
                out: F.lag(names[out], k).over(w) if k > 0 else F.lead(names[out], -k).over(w)
                for out, (_, k) in columns.items()
            }
        )
        edge_value = F.struct("_rn", *names.values())
        edges = (
            held.where((F.col("_rn") <= reach) | (F.col("_left") <= reach))
            .groupBy(*self.parts)
            .agg(
                F.sort_array(F.collect_list(F.when(F.col("_rn") <= reach, edge_value))).alias("_head"),
                F.sort_array(F.collect_list(F.when(F.col("_left") <= reach, edge_value))).alias("_tail"),
            )
        )
        wc = self._chunks()
        steps = range(1, reach + 1)
        before = F.flatten(F.filter(F.array(*[F.lag("_tail", i).over(wc) for i in reversed(steps)]), lambda a: a.isNotNull()))
        after = F.flatten(F.filter(F.array(*[F.lead("_head", i).over(wc) for i in steps]), lambda a: a.isNotNull()))
        summary = edges.select(*self.parts, before.alias("_before"), after.alias("_after"))
        joined = self._join_summary(held, summary)

        def far(out: str, k: int) -> Column:
            name = names[out]
            if k > 0:
                at = F.size("_before") - (F.lit(k) - F.col("_rn"))
                value = F.when(at >= 1, F.try_element_at("_before", at.cast("int")))
                return F.when(F.col("_rn") > k, F.col(out)).otherwise(value.getField(name))
            at = (F.lit(-k) - F.col("_left") + 1).cast("int")
            value = F.when(at >= 1, F.try_element_at("_after", at))
            return F.when(F.col("_left") > -k, F.col(out)).otherwise(value.getField(name))

        result = joined.withColumns({out: far(out, k) for out, (_, k) in columns.items()})
        return result.drop("_rn", "_left", "_before", "_after", *names.values())

    def running_sum(self, df: DataFrame, columns: dict[str, Column]) -> DataFrame:
        """Sum of each expression from the group's first row up to and with this one."""
        w = self.window().rowsBetween(W.unboundedPreceding, 0)
        if not self.chunked:
            return df.withColumns({out: F.sum(e).over(w) for out, e in columns.items()})
        held = cut_lineage(df)
        totals = held.groupBy(*self.parts).agg(*[F.sum(e).alias(f"_t_{out}") for out, e in columns.items()])
        earlier = self._chunks().rowsBetween(W.unboundedPreceding, -1)
        summary = totals.select(
            *self.parts, *[F.sum(f"_t_{out}").over(earlier).alias(f"_t_{out}") for out in columns]
        )
        joined = self._join_summary(held.withColumns({o: F.sum(e).over(w) for o, e in columns.items()}), summary)
        added = {
            o: F.when(
                F.col(o).isNotNull() | F.col(f"_t_{o}").isNotNull(),
                F.coalesce(F.col(o), F.lit(0)) + F.coalesce(F.col(f"_t_{o}"), F.lit(0)),
            )
            for o in columns
        }
        return joined.withColumns(added).drop(*[f"_t_{o}" for o in columns])

    def last_known(self, df: DataFrame, columns: dict[str, Column]) -> DataFrame:
        """Latest non-NULL value of each expression at or before the row."""
        w = self.window().rowsBetween(W.unboundedPreceding, 0)
        near = {out: F.last(e, ignorenulls=True).over(w) for out, e in columns.items()}
        if not self.chunked:
            return df.withColumns(near)
        held = cut_lineage(df)
        order = F.struct(*self.by)
        ends = held.groupBy(*self.parts).agg(
            *[F.max_by(e, F.when(e.isNotNull(), order)).alias(f"_t_{o}") for o, e in columns.items()]
        )
        earlier = self._chunks().rowsBetween(W.unboundedPreceding, -1)
        summary = ends.select(
            *self.parts,
            *[F.last(f"_t_{o}", ignorenulls=True).over(earlier).alias(f"_t_{o}") for o in columns],
        )
        joined = self._join_summary(held.withColumns(near), summary)
        filled = {o: F.coalesce(F.col(o), F.col(f"_t_{o}")) for o in columns}
        return joined.withColumns(filled).drop(*[f"_t_{o}" for o in columns])

    def first_later(self, df: DataFrame, out: str, value: Column, when: Column, clock: str) -> DataFrame:
        """`value` of the first row with `when` true at a strictly greater `clock` (whole numbers)."""
        hit = F.when(when, F.struct(*self.by, value.alias("_value")))
        # Descending order keeps a growing frame, so the cost stays linear in the group.
        later = W.partitionBy(*self.parts).orderBy(F.col(clock).desc()).rangeBetween(W.unboundedPreceding, -1)
        if not self.chunked:
            return df.withColumn(out, F.min(hit).over(later).getField("_value"))
        held = cut_lineage(df)
        firsts = held.groupBy(*self.parts).agg(F.min(hit).alias("_first"))
        ahead = W.partitionBy(*self.keys).orderBy(F.col(CHUNK).desc()).rowsBetween(W.unboundedPreceding, -1)
        summary = firsts.select(*self.parts, F.min("_first").over(ahead).alias("_first"))
        joined = self._join_summary(held.withColumn("_near", F.min(hit).over(later)), summary)
        found = F.coalesce(F.col("_near"), F.col("_first")).getField("_value")
        return joined.withColumn(out, found).drop("_near", "_first")

    def previous_mean(self, df: DataFrame, columns: dict[str, tuple[Column, int]]) -> DataFrame:
        """Mean of the w rows before this one, NULL until there are w of them."""
        if not self.chunked:
            w = self.window()
            mean = lambda e, n: F.when(
                F.count(F.lit(1)).over(w.rowsBetween(-n, -1)) == n, F.avg(e).over(w.rowsBetween(-n, -1))
            )
            return df.withColumns({out: mean(e, n) for out, (e, n) in columns.items()})
        sums, moves = {"_rows": F.lit(1).cast("long")}, {}
        for i, (_, (e, n)) in enumerate(columns.items()):
            sums |= {f"_s{i}": F.coalesce(e.cast("double"), F.lit(0.0)), f"_n{i}": F.when(e.isNotNull(), 1).otherwise(0)}
            for part in ("_s", "_n"):
                moves |= {f"{part}{i}_a": (f"{part}{i}", 1), f"{part}{i}_b": (f"{part}{i}", n + 1)}
        moved = self.shift(self.running_sum(df, sums), moves)
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        means = {
            out: F.when(
                F.col("_rows") > n,
                F.try_divide(zero(f"_s{i}_a") - zero(f"_s{i}_b"), zero(f"_n{i}_a") - zero(f"_n{i}_b")),
            )
            for i, (out, (_, n)) in enumerate(columns.items())
        }
        return moved.withColumns(means).drop(*sums, *moves)


def _all(conditions: list[Column]) -> Column:
    result = conditions[0]
    for c in conditions[1:]:
        result = result & c
    return result


@dataclass(frozen=True)
class HotGroups:
    """Groups too large for one task: rows of key values with `count`, fewer than one per `chunk_rows` rows of the table."""

    rows: list
    chunk_rows: int = HOT_ROWS


def hot_groups(
    df: DataFrame, keys: tuple[str, ...], min_rows: int = HOT_ROWS
) -> HotGroups:
    """Groups with more than `min_rows` rows, whatever their share of the table.

    One count by key, combined map-side. Find them once on the source and hand the result to
    every operator of a plan, so the check is not repeated on derived tables.
    """
    big = df.groupBy(*keys).count().where(F.col("count") > min_rows)
    return HotGroups(big.collect(), min_rows)


def split_hot(
    df: DataFrame,
    ordering: Ordering,
    build: Callable[[DataFrame, Ordering], DataFrame],
    hot: HotGroups | None = None,
) -> DataFrame:
    """Run `build` with whole-group windows on cold groups and chunked ones on hot groups.

    A group gets as many chunks as its rows need. Hot keys and bounds are one number per `chunk_rows` rows; their joins
    carry no broadcast hint, so adaptive execution sends them only while they are small. Rows with
    equal position share a chunk.
    """
    if hot is None:
        hot = hot_groups(df, ordering.keys)
    if not hot.rows:
        return build(df, ordering)

    spark = df.sparkSession
    keys = ordering.keys
    key_fields = df.select(*keys).schema.fields
    hot_keys = spark.createDataFrame([tuple(r[k] for k in keys) for r in hot.rows], T.StructType(key_fields))
    hot_keys = hot_keys.withColumnsRenamed({k: f"_h_{k}" for k in keys})
    same = _all([F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in keys])
    cold_rows = df.join(hot_keys, on=same, how="left_anti")
    hot_rows = df.join(hot_keys, on=same, how="left_semi")

    pieces = ceil(max(r["count"] for r in hot.rows) / hot.chunk_rows) + 1
    cuts = [i / pieces for i in range(1, pieces)]
    position = F.expr(ordering.position).cast("double")
    bounds = hot_rows.groupBy(*keys).agg(F.percentile_approx(position, cuts).alias("_cuts")).collect()
    bound_table = spark.createDataFrame(
        [(*[r[k] for k in keys], r["_cuts"]) for r in bounds],
        T.StructType([*key_fields, T.StructField("_cuts", T.ArrayType(T.DoubleType()))]),
    ).withColumnsRenamed({k: f"_h_{k}" for k in keys})
    chunked = (
        hot_rows.withColumn("_position", position)
        .join(bound_table, on=same, how="inner")
        .withColumn(CHUNK, F.size(F.filter("_cuts", lambda b: b < F.col("_position"))))
        .drop("_cuts", "_position", *[f"_h_{k}" for k in keys])
    )
    hot_result = build(cut_lineage(chunked), replace(ordering, chunked=True))
    return build(cold_rows, ordering).unionByName(hot_result.drop(CHUNK))
