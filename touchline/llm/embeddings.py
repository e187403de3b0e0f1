"""Near copies among vectors by a pivot-permutation index.

Every distinct vector is described by its `near` nearest pivots in order; inverted pivot lists bring together vectors that share
pivots, shared-pivot counts pick the candidates, and the cosine in double precision verifies them. A list is cut into blocks of
bounded size and each pair of blocks is one group, so a popular pivot costs tasks, not memory. Groups return link counts and a
spanning forest of their links, never the pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import cut
from touchline.llm.components import components

LINKS = "node long, n long, a long, b long"


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one. Powers of two are taken out first, so squares neither overflow nor vanish."""
    vectors = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def sample_pivots(distinct: DataFrame, sizes: dict[int, int], most: int, apart: float = 0.8) -> dict[int, np.ndarray]:
    """By length about 4 sqrt(n) of its n vectors, none with a cosine over `apart` to another; `most` in all, so they may be sent to all tasks.

    They come from the vectors with the smallest hash. Pivots close together would share out one dense group at random, so that its
    members met in few lists. Vectors that all lie close together have one pivot. Lengths too rare for a share of `most` have none.
    """
    want = {k: min(most, max(64, int(4 * n**0.5))) for k, n in sizes.items()}
    total = sum(want.values())
    if total > most:
        want = {k: w * most // total for k, w in want.items()}
    chance = F.map_from_arrays(F.lit([0, *want]), F.lit([0.0, *(min(1.0, (2 * w + 64) / sizes[k]) if w else 0.0 for k, w in want.items())]))
    drawn = F.xxhash64("rep", F.lit(7))
    few = F.pmod(drawn, F.lit(1 << 30)) / F.lit(float(1 << 30)) < F.element_at(chance, F.col("length"))
    rows = distinct.filter(few).select("length", (F.pmod(drawn, F.lit(1 << 30))).alias("place"), "rep", "vec").collect()
    by: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r.length, r.place, r.rep)):
        by.setdefault(r.length, []).append(r.vec)
    pivots = {}
    for length, vectors in by.items():
        sample, kept = unit(np.array(vectors, np.float64)), []
        for k in range(len(sample)):
            if len(kept) < want[length] and (not kept or (sample[kept] @ sample[k]).max() <= apart):
                kept.append(k)
        pivots[length] = sample[kept]
    return pivots


def permutations(distinct: DataFrame, pivots: dict[int, np.ndarray], near: int) -> DataFrame:
    """Each vector with the nearest pivots of its length, nearest first; ties go to the lower pivot.

    Vectors of a length without pivots are all in one list, that of pivot -1.
    """

    def run(batches):
        for pdf in batches:
            for length, own in pdf.groupby("length"):
                vectors, known = unit(np.array(own.vec.tolist(), np.float64)), pivots.get(length)
                if known is None:
                    order = [np.full((len(own), 1), -1)]
                else:
                    order = [np.argsort(-np.round(vectors[at : at + 512] @ known.T, 12), axis=1, kind="stable")[:, :near] for at in range(0, len(vectors), 512)]
                yield own.assign(pivots=np.concatenate(order).astype(np.int32).tolist())

    return distinct.select("length", "rep", "copies", "vec").mapInPandas(run, "length int, rep long, copies long, vec array<double>, pivots array<int>")


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links that keep what the pairs a, b connect: a spanning forest by union-find."""
    top: dict[int, int] = {}

    def find(x):
        while (up := top.get(x, x)) != x:
            top[x] = top.get(up, up)
            x = up
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            top[max(p, q)] = min(p, q)
            kept.append((x, y))
    return kept


def block_links(pivot: int, left: pd.DataFrame, right: pd.DataFrame, same: bool, cosine: float, shared: int) -> pd.DataFrame:
    """Link counts and forest of the pairs between two blocks of a pivot's list whose smallest common pivot it is."""
    lists = [np.array(x.pivots.tolist(), np.int64) for x in (left, right)]
    known, spots = np.unique(np.concatenate([x.ravel() for x in lists]), return_inverse=True)
    spots = spots.ravel()
    marks = []
    for x, own in zip(lists, np.split(spots, [lists[0].size]), strict=True):
        mark = np.zeros((len(x), len(known)), np.float32)
        mark[np.repeat(np.arange(len(x)), x.shape[1]), own] = 1
        marks.append(mark)
    ids = [x.rep.to_numpy() for x in (left, right)]
    ok = marks[0] @ marks[1].T >= shared
    before = int(np.searchsorted(known, pivot))
    if before:  # a pair with a smaller common pivot belongs to that pivot's list
        ok &= marks[0][:, :before] @ marks[1][:, :before].T == 0
    if same:
        ok &= ids[0][:, None] < ids[1][None, :]
    i, j = np.nonzero(ok)
    vectors = [unit(np.array(x.vec.tolist(), np.float64)) for x in (left, right)]
    good = np.concatenate([np.einsum("ij,ij->i", vectors[0][i[k : k + 65536]], vectors[1][j[k : k + 65536]]) >= cosine for k in range(0, len(i), 65536)] or [np.zeros(0, bool)])
    i, j = i[good], j[good]
    copies = [x.copies.to_numpy() for x in (left, right)]
    nodes = np.concatenate([ids[0][i], ids[1][j]])
    uniq, where = np.unique(nodes, return_inverse=True)
    counts = np.bincount(where.ravel(), weights=np.concatenate([copies[1][j], copies[0][i]]), minlength=len(uniq)).astype(np.int64)
    edges = forest(ids[0][i], ids[1][j])
    out = pd.DataFrame({"node": pd.array(uniq, "Int64"), "n": pd.array(counts, "Int64"), "a": pd.array([None] * len(uniq), "Int64"), "b": pd.array([None] * len(uniq), "Int64")})
    tree = pd.DataFrame({"node": pd.array([None] * len(edges), "Int64"), "n": pd.array([None] * len(edges), "Int64"), "a": pd.array([e[0] for e in edges], "Int64"), "b": pd.array([e[1] for e in edges], "Int64")})
    return pd.concat([out, tree], ignore_index=True)


def list_links(described: DataFrame, known: dict[int, int], cosine: float, shared: int, block: int) -> DataFrame:
    """Counts (`node, n`) and forest edges (`a, b`) of all links, from the inverted lists in pairs of blocks."""
    lists = described.select("length", F.explode("pivots").alias("pivot"), "rep")
    # at most as many rows as pivots, whose number is bounded, and lengths without any
    blocks = lists.groupBy("length", "pivot").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / block)).cast("int").alias("blocks"))
    rows = (
        described.select("length", F.explode("pivots").alias("pivot"), "rep", "copies", "vec", "pivots")
        .join(cut(blocks, "blocks"), ["length", "pivot"])
        .withColumn("own", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("i", F.least("own", "other"))
        .withColumn("j", F.greatest("own", "other"))
        .drop("blocks", "other")
    )

    def run(key, pdf):
        length, pivot, i, j = key
        left, right = pdf[pdf.own == i], pdf[pdf.own == j]
        # with few pivots every vector lists them all, and no pair can share more than there are
        return block_links(pivot, left, right, i == j, cosine, min(shared, known.get(length, 1)))

    return rows.groupBy("length", "pivot", "i", "j").applyInPandas(run, LINKS)


def near_vectors(vectors: DataFrame, cosine: float = 0.95, near: int = 10, shared: int = 2, block: int = 1024, most_pivots: int = 4096) -> DataFrame:
    """`vec_id, n_links, component_id, kept` per row: linked are different rows with cosine >= `cosine`.

    Equal vectors are one class: its rows link with each other and share their links. Null, empty or zero vectors and those with
    null or non-finite components link with nothing. A row with a null id is its own component (null). The length of a vector is a
    key of the index: vectors of different lengths never link, and any number of lengths may occur. Repeated ids stay as rows.
    """
    valid = F.coalesce(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0) & F.col("vec_id").isNotNull(), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
    rows = rows.withColumn("ok", valid)
    distinct = cut(rows.filter("ok").groupBy("vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "distinct")
    distinct = distinct.withColumn("length", F.size("vec"))
    sizes = {r.length: r["count"] for r in distinct.groupBy("length").count().filter("count > 1").collect()}
    pivots = sample_pivots(distinct, sizes, most_pivots)
    described = cut(permutations(distinct, pivots, near), "described")
    found = cut(list_links(described, {k: len(p) for k, p in pivots.items()}, cosine, shared, block), "links")
    counts = found.filter("node is not null").groupBy("node").agg(F.sum("n").alias("n")).withColumnRenamed("node", "rep")
    parts = components(found.filter("a is not null").select("a", "b")).withColumnRenamed("node", "rep")
    known = distinct.join(counts, "rep", "left").join(parts, "rep", "left").select(
        "vec", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")
    )
    out = rows.withColumn("key", F.when(F.col("ok"), F.col("vec"))).join(cut(known, "known").withColumnRenamed("vec", "key"), "key", "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
