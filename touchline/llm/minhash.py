"""MinHash near copies: minima of many universal hash functions, banding, signature check, full check, star components.

Documents with equal shingle sets are one class, so exact copies cost one row. Bands of class representatives form buckets. A bucket
is handled in pairs of bounded blocks: the first pass compares signatures and gives back only the members that have a
promising pair in it; the second gets those members' texts, confirms pairs on the full sets and gives back a spanning forest. A
pair belongs to the first band that it shares, so it is judged once, and no pass emits a bucket's pairs.
"""

from __future__ import annotations

import math
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import cut, slices, tasks, text_or_empty
from touchline.llm.components import components
from touchline.llm.shingles import minima, overlap, shingle_set

BANDS, ROWS = 25, 6
SKETCH = "doc_id long, n_shingles long, digest binary, bands array<long>, signature binary"
KEYS = ["band", "key", "i", "j"]


def bands_for(percent: int, most: int = 150, by_bands: float = 1e-5) -> tuple[int, int]:
    """Bands and rows that miss a pair at the threshold with a probability of at most `by_bands`: the most rows a band whose bands need `most` minima at most."""
    found = None
    for rows in range(1, most + 1):
        hit = (percent / 100) ** rows
        bands = 1 if hit >= 1 else math.ceil(math.log(by_bands) / math.log1p(-hit))
        if bands * rows <= most or found is None:
            found = bands, rows
    return found


def least_for(percent: int, minima: int, by_signature: float = 1e-4) -> float:
    """The share of minima to agree that a pair at the threshold falls short of with a probability of at most `by_signature`."""
    share, short, need = percent / 100, 0.0, 0
    while need < minima and (short := short + math.comb(minima, need) * share**need * (1 - share) ** (minima - need)) <= by_signature:
        need += 1
    return max(0.0, need - 0.5) / minima  # halfway, so that rounding up gives `need`


def band_keys(low: np.ndarray, bands: int, rows: int) -> np.ndarray:
    table = low.reshape(bands, rows)
    return np.array([xxhash.xxh3_64_intdigest(r.tobytes(), k) for k, r in enumerate(table)], np.uint64).astype(np.int64)


def sketches(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row the set's size and digest, its band keys and a byte of each minimum; the last three are null for an empty set."""

    def one(text):
        own = shingle_set(text)
        if not len(own):
            return 0, None, None, None
        low = minima(own, bands * rows)
        return len(own), xxhash.xxh3_128_digest(own.tobytes()), band_keys(low, bands, rows), low.astype(np.uint8).tobytes()

    def run(batches):
        for b in slices(batches):
            n, digest, keys, signature = zip(*map(one, b["t"].to_pylist()), strict=True) if b.num_rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(signature, pa.binary())],
                ["doc_id", "n_shingles", "digest", "bands", "signature"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("t")).mapInArrow(run, SKETCH)


def in_blocks(members: DataFrame, size: int) -> DataFrame:
    """Deals each bucket's members (`band, key, node, ...`) to pairs of blocks of about `size`, sorted group by group."""
    counts = cut(members.groupBy("band", "key").agg(F.ceil(F.count("*") / size).cast("int").alias("blocks")), "blocks")
    rows = (
        members.join(counts.hint("merge"), ["band", "key"])
        .withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("i", F.least("own", "other"))
        .withColumn("j", F.greatest("own", "other"))
        .drop("blocks", "other")
    )
    return rows.repartition(tasks(members.sparkSession), *KEYS).sortWithinPartitions(*KEYS, "node")


def groups(batches, columns: list[str]):
    """Consecutive rows with the same bucket and pair of blocks."""
    def rows():
        for b in batches:
            yield from zip(*(b[c].to_pylist() for c in [*KEYS, *columns]), strict=True)

    for key, own in groupby(rows(), key=lambda r: r[:4]):
        yield key, [r[4:] for r in own]


def promising(keys: np.ndarray, signs: np.ndarray, blocks: np.ndarray, band: int, i: int, j: int, least: float):
    """Pairs of rows (x, y) of the two blocks whose first shared band is this one and whose signatures agree enough."""
    left = np.flatnonzero(blocks == i)
    right = left if i == j else np.flatnonzero(blocks == j)
    need = int(np.ceil(least * signs.shape[1]))
    for at, x in enumerate(left):
        y = right[at + 1 :] if i == j else right
        y = y[(signs[y] == signs[x]).sum(axis=1) >= need]
        if band and len(y):
            y = y[~(keys[y, :band] == keys[x, :band]).any(axis=1)]
        if len(y):
            yield x, y


def hopeful_members(members: DataFrame, least: float) -> DataFrame:
    """`band, key, node` of the members with a promising pair in the bucket."""

    def run(batches):
        out = []
        for (band, key, i, j), rows in groups(batches, ["node", "own", "bands", "signature"]):
            nodes, own, keys, signs = zip(*rows, strict=True)
            hit = np.zeros(len(rows), bool)
            keys, signs = np.array(keys, np.int64), np.frombuffer(b"".join(signs), np.uint8).reshape(len(rows), -1)
            for x, y in promising(keys, signs, np.array(own), band, i, j, least):
                hit[x] = True
                hit[y] = True
            out.extend((band, key, nodes[k]) for k in np.flatnonzero(hit))
            if len(out) > 5000:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    def batch(rows):
        a, b, c = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int64()), pa.array(c, pa.int64())], ["band", "key", "node"])

    return members.mapInArrow(run, "band int, key long, node long")


def confirmed_links(members: DataFrame, percent: int, least: float, bands: int, rows_a_band: int) -> DataFrame:
    """`a, b`: a spanning forest of each group's links, each confirmed on the full sets."""

    def run(batches):
        for (band, _, i, j), rows in groups(batches, ["node", "own", "t"]):
            nodes, own, texts = zip(*rows, strict=True)
            sets = [shingle_set(t) for t in texts]
            lows = [minima(s, bands * rows_a_band) for s in sets]
            keys = np.array([band_keys(v, bands, rows_a_band) for v in lows])
            signs = np.array([v.astype(np.uint8) for v in lows])
            top = list(range(len(rows)))

            def find(x, top=top):
                while top[x] != x:
                    top[x] = x = top[top[x]]
                return x

            out = []
            for x, ys in promising(keys, signs, np.array(own), band, i, j, least):
                for y in ys.tolist():
                    p, q = find(x), find(y)
                    if p != q:
                        both = overlap(sets[x], sets[y])
                        if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                            top[max(p, q)] = min(p, q)
                            out.append((nodes[x], nodes[y]))
            if out:
                a, b = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return members.mapInArrow(run, "a long, b long")


def near_copies(docs: DataFrame, percent: int = 85, least: float | None = None, bands: int | None = None, rows: int | None = None, block: int = 1024, text_block: int = 256) -> DataFrame:
    """`doc_id, n_shingles, component_id, kept` per row; linked are documents with 100 * common >= percent * all shingles.

    A link at exactly `percent` is missed with a probability below 1e-5 by the bands and below 1e-4 by the signature, whose sizes
    follow from it where not given (85: 25 bands of 6 minima, 110 of 150 must agree); more alike pairs far less. Documents without words link with nothing. Null text is
    empty, a null id is a component of its own (null, kept), rows that repeat an id count as one document with several texts.

    The joins are merged at every size: no side has a bound, and small tables take the plan that large ones need.
    """
    if bands is None or rows is None:
        bands, rows = bands_for(percent)
    least = least_for(percent, bands * rows) if least is None else least
    drawn = cut(sketches(docs, bands, rows), "sketches")
    full = drawn.filter("n_shingles > 0 and doc_id is not null")
    classes = cut(full.groupBy("digest").agg(F.min("doc_id").alias("node")), "classes")
    reps = cut(full.join(classes, (full.digest == classes.digest) & (full.doc_id == classes.node)).select("node", "bands", "signature"), "representatives")
    spread = reps.select("node", F.posexplode("bands").alias("band", "key"))
    buckets = cut(spread.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1").drop("n"), "buckets")
    members = cut(spread.join(buckets.hint("merge"), ["band", "key"]), "members")
    hopeful = cut(hopeful_members(in_blocks(members.hint("merge").join(reps, "node"), block), least).distinct(), "hopeful")
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), text_or_empty().alias("t"))
    links = cut(confirmed_links(in_blocks(hopeful.hint("merge").join(texts, "node"), text_block), percent, least, bands, rows), "links")
    known = classes.join(components(links), "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    out = drawn.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
    component = F.coalesce("component", "doc_id")
    return out.join(cut(known, "known").hint("merge"), "digest", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )
