"""Exact top-k by integer inner product: MaxScore over postings of vector components.

Terms are (dimension, sign); the postings of a term list the rows of a shard whose component has that sign, with its size. A term
of the query can add at most its own size times the largest size in the list, and rows outside the list add nothing or less. Terms
are taken by falling bound. While the bounds of the remaining terms reach the query's threshold, a row seen in none of the lists so
far may still win: these terms are essential and their postings are traversed. From there on only rows whose score so far plus the
remaining bounds is competitive are probed, term by term. Shards are runs of rows of a scan task, so candidates are never shuffled;
the shards' best rows are merged by a limit per query that Spark applies before its shuffle as well.

The threshold of a query starts at its (k + 1)-th best score among a bounded sample, its own row included: never above the true one,
so it saves work and drops nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import cut, open_in

LIMIT = (1 << 63) - 1
FOUND = "query long, query_id long, own boolean, vec_id long, score long"


def matrix(vectors, width: int) -> np.ndarray:
    """Rows of integers, missing components zero."""
    out = np.zeros((len(vectors), width), np.int64)
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


class Shard:
    """The inverted lists of up to some ten thousand rows."""

    def __init__(self, ids: list, vectors: list):
        self.ids = np.array([LIMIT if i is None else i for i in ids], np.int64)
        self.nulls = np.array([i is None for i in ids], bool)
        self.width = max(map(len, vectors), default=0)
        self.rows = matrix(vectors, self.width)
        self.largest = int(max(abs(int(self.rows.max(initial=0))), abs(int(self.rows.min(initial=0)))))
        self.postings = {}
        for d in range(self.width):
            column = self.rows[:, d]
            for sign in (1, -1):
                where = np.nonzero(column > 0 if sign > 0 else column < 0)[0].astype(np.int32)
                if len(where):
                    sizes = column[where]
                    self.postings[d, sign] = (where, sizes, max(abs(int(sizes.max())), abs(int(sizes.min()))))

    def best(self, query: np.ndarray, k: int, floor: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best rows with a score of `floor` or more, by score, then by id (null last)."""
        query = query[: self.width]
        # 64-bit sums are exact below this bound; beyond it Python's integers are
        wide = int(np.abs(query.astype(object)).sum()) * self.largest >= LIMIT if len(query) else False
        kind = object if wide else np.int64
        terms = []
        for d in np.nonzero(query)[0].tolist():
            q = int(query[d])
            terms.append((abs(q) * self.postings.get((d, 1 if q > 0 else -1), (0, 0, 0))[2], d, q))
        terms.sort(reverse=True)
        rest = [0]
        for bound, _, _ in reversed(terms):
            rest.append(rest[-1] + bound)
        rest.reverse()  # rest[i]: most that the terms from i on can add
        score = np.zeros(len(self.ids), kind)
        done = 0
        # a row in none of the lists before `done` has a score of 0 at most so far
        while done < len(terms) and (floor is None or rest[done] >= floor):
            _, d, q = terms[done]
            for sign in (1, -1):
                where, sizes, _ = self.postings.get((d, sign), (None, None, 0))
                if where is not None:
                    score[where] += q * sizes.astype(kind)
            done += 1
        alive = np.arange(len(score)) if floor is None else np.nonzero(score >= floor - rest[done])[0]
        score = score[alive]
        for i in range(done, len(terms)):
            if not len(alive):
                break
            _, d, q = terms[i]
            score = score + q * self.rows[alive, d].astype(kind)
            keep = score >= floor - rest[i + 1]
            if not keep.all():
                alive, score = alive[keep], score[keep]
        if wide:
            score = np.array([min(LIMIT, max(-LIMIT - 1, s)) for s in score], np.int64)
        if len(alive) > 4 * k:  # only rows that reach the k-th score can be among the k best
            least = np.partition(score, len(score) - k)[len(score) - k]
            keep = score >= least
            alive, score = alive[keep], score[keep]
        order = np.lexsort((self.nulls[alive], self.ids[alive], ~score))[:k]
        return alive[order], score[order]


def read_queries(files: list[str], rows: int = 1024):
    for uri in files:
        with open_in(uri) as f:
            for b in pq.ParquetFile(f).iter_batches(rows):
                yield from zip(b["query"].to_pylist(), b["vec_id"].to_pylist(), b["vec"].to_pylist(), b["floor"].to_pylist(), strict=True)


def with_floors(queries: DataFrame, sample: list, k: int) -> DataFrame:
    """Queries with the (k + 1)-th best score in the sample, if it has that many rows."""

    def run(batches):
        shard = Shard([0] * len(sample), sample)
        for b in batches:
            floors = []
            for v in b["vec"].to_pylist():
                got = shard.best(np.asarray(v, np.int64), k + 1, None)[1]
                floors.append(int(got[k]) if len(got) > k else None)
            yield pa.RecordBatch.from_arrays([b["query"], b["vec_id"], b["vec"], pa.array(floors, pa.int64())], ["query", "vec_id", "vec", "floor"])

    return queries.mapInArrow(run, "query long, vec_id long, vec array<long>, floor long")


def top_products(
    vectors: DataFrame, query: str = "vec_id % 50 = 0", k: int = 5, scale: float = 256.0, shard_rows: int = 65536, sample_rows: int = 4096
) -> DataFrame:
    """`query_id, rank, vec_id, score`: for each row that the condition `query` (on `vec_id`) takes, the k other rows of the highest
    integer inner product of floor(scale * component), ties to the smaller id.

    Null vectors and those with null or non-finite components take no part. Rows, not ids, are compared: rows that repeat an id are
    candidates of each other and queries of their own. A row with a null id is never a query, and as a candidate comes after others
    of its score. Where lengths differ, missing components count as zero; an empty vector scores 0. Components and scores beyond 64
    bits end at the largest long. Without queries or candidates there are no rows. Other columns are not read.

    One task holds a shard of `shard_rows` rows, however many a partition has, and reads the queries from shared files in batches.
    The sample for thresholds has at most `sample_rows` rows.
    """
    parts = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(F.lit(scale) * x).cast("long"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.filter(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), parts.alias("vec"))
    sample = [r.vec for r in rows.orderBy(F.xxhash64("vec_id", "vec")).limit(sample_rows).collect()]
    asked = cut(rows.filter(query).withColumn("query", F.monotonically_increasing_id()).select("query", "vec_id", "vec"), "asked")
    floors = cut(with_floors(asked, sample, k), "queries")
    files = sorted(floors.inputFiles())

    def search(batches):
        def close():
            shard = Shard(ids, vecs)
            found = []
            for number, query_id, vec, floor in read_queries(files):
                q = np.asarray(vec, np.int64)
                for at, score in zip(*shard.best(q, k + 1, floor), strict=True):
                    own = not shard.nulls[at] and int(shard.ids[at]) == query_id and np.array_equal(trimmed(shard.rows[at]), trimmed(q))
                    found.append((number, query_id, own, None if shard.nulls[at] else int(shard.ids[at]), int(score)))
                if len(found) >= 50_000:
                    yield frame(found)
                    found = []
            yield frame(found)

        ids, vecs = [], []
        for b in batches:
            for i, v in zip(b["vec_id"].to_pylist(), b["vec"].to_pylist(), strict=True):
                ids.append(i)
                vecs.append(v)
                if len(ids) >= shard_rows:
                    yield from close()
                    ids, vecs = [], []
        if ids:
            yield from close()

    best_first = [F.desc("score"), F.col("vec_id").asc_nulls_last()]
    found = rows.mapInArrow(search, FOUND)
    # one row more than asked for, as the query's own may be among them; the limit works before the shuffle too
    near = found.withColumn("place", F.row_number().over(Window.partitionBy("query", "query_id").orderBy(*best_first))).filter(F.col("place") <= k + 1)
    mine = Window.partitionBy("query", "query_id").orderBy("place")
    passed = F.max("own").over(mine)  # from the first row equal to the query on, places move up by one
    place = F.col("place") - F.when(passed, 1).otherwise(0)
    first_own = F.col("own") & (F.sum(F.col("own").cast("int")).over(mine) == 1)
    out = near.withColumn("rank", place.cast("int")).withColumn("gone", first_own).filter(~F.col("gone") & (F.col("rank") <= k))
    return out.select("query_id", "rank", "vec_id", "score")


def trimmed(row: np.ndarray) -> np.ndarray:
    """Without zeros at the end, which missing components stand for."""
    used = np.nonzero(row)[0]
    return row[: used[-1] + 1] if len(used) else row[:0]


def frame(found: list) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) if found else [[]] * 5
    kinds = {"query": pa.int64(), "query_id": pa.int64(), "own": pa.bool_(), "vec_id": pa.int64(), "score": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], list(kinds))
