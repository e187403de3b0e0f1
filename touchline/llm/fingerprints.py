"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text's items are its paragraphs (lines), cut after sentence ends and after the word that passes 48 characters; equal items are told apart by
their number. Each item's 64-bit digest goes to three cells (one in each third) of a count, a sum of digests and a sum of
checks. Two texts' cells subtract; cells that hold one digest are peeled off until none is left, which gives the digests
that differ. Where peeling gets stuck, both sketches are built again eight times as large. Texts of one batch are sketched and
peeled together.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import cut, tasks, text_or_empty
from touchline.llm.shingles import mixed

ITEM = re.compile(r"[^\n.!?]{1,48}[^\s.!?]{0,400}[.!?]*|[.!?]+")
CELLS = 24
SALTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def items(text: str) -> np.ndarray:
    """Distinct digests of the paragraph pieces, white space about them left out; the k-th equal piece has a digest of its own."""
    seen: dict[str, int] = {}
    out, digest = [], xxhash.xxh3_64_intdigest
    for piece in ITEM.findall(text):
        piece = piece.strip()
        if piece:
            k = seen[piece] = seen.get(piece, -1) + 1
            out.append(digest(piece.encode("utf-8", "replace"), k))
    return np.array(list(set(out)), np.uint64)


def checks(keys: np.ndarray) -> np.ndarray:
    return mixed(keys ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(0xFFFFFFFF)


def spots(keys: np.ndarray, cells: int) -> np.ndarray:
    """Three cells of each key, one in each third of the sketch."""
    third = np.uint64(cells // 3)
    return np.stack([mixed(keys ^ salt) % third + np.uint64(j) * third for j, salt in enumerate(SALTS)]).astype(np.int64)


class Sketches:
    """Sketches of many texts with as many cells each: counts, xor of digests, xor of checks."""

    def __init__(self, n: int, cells: int):
        self.n, self.cells = n, cells
        self.count = np.zeros(n * cells, np.int64)
        self.key = np.zeros(n * cells, np.uint64)
        self.check = np.zeros(n * cells, np.uint64)

    def add(self, owner: np.ndarray, keys: np.ndarray, signs: np.ndarray) -> None:
        at = (spots(keys, self.cells) + owner * self.cells).ravel()
        np.add.at(self.count, at, np.tile(signs, 3))
        np.bitwise_xor.at(self.key, at, np.tile(keys, 3))
        np.bitwise_xor.at(self.check, at, np.tile(checks(keys), 3))

    def minus(self, other: "Sketches") -> "Sketches":
        out = Sketches(self.n, self.cells)
        out.count, out.key, out.check = self.count - other.count, self.key ^ other.key, self.check ^ other.check
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Owner, digest and sign (1: only in the first) of what differs, and which owners were peeled to the end."""
        found = []
        for _ in range(64 + self.cells):
            at = np.flatnonzero((np.abs(self.count) == 1) & (checks(self.key) == self.check))
            if not len(at):
                break
            # a digest may lie alone in more than one of its cells
            _, once = np.unique(mixed(self.key[at] ^ ((at // self.cells).astype(np.uint64) << np.uint64(20))), return_index=True)
            at = at[once]
            owner, keys, signs = at // self.cells, self.key[at], self.count[at]
            found.append((owner, keys, signs))
            self.add(owner, keys, -signs)
        left = (self.count != 0) | (self.key != 0) | (self.check != 0)
        done = ~left.reshape(self.n, self.cells).any(axis=1)
        owner, keys, signs = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found, strict=True) if found else ((), (), ())))
        return owner, keys, signs, done


def sketch(sets: list[np.ndarray], cells: int) -> Sketches:
    out = Sketches(len(sets), cells)
    if sets:
        keys = np.concatenate(sets)
        out.add(np.repeat(np.arange(len(sets)), [len(s) for s in sets]), keys, np.ones(len(keys), np.int64))
    return out


def written(sketches: Sketches, texts: list[str], sizes: list[int]) -> list[str]:
    """`items:text digest:cells`, the cells as base64 of counts (16 bits), digests (64) and checks (32)."""
    n, c = sketches.n, sketches.cells
    counts = (sketches.count & 0xFFFF).astype("<u2").reshape(n, c)
    keys, sums = sketches.key.astype("<u8").reshape(n, c), sketches.check.astype("<u4").reshape(n, c)
    return [
        f"{size}:{hashlib.sha1(t.encode('utf-8', 'replace')).hexdigest()[:16]}:"
        + base64.b64encode(counts[k].tobytes() + keys[k].tobytes() + sums[k].tobytes()).decode()
        for k, (t, size) in enumerate(zip(texts, sizes, strict=True))
    ]


def differing(a: list[np.ndarray], b: list[np.ndarray], cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """How many digests each pair has only in the first and only in the second, recovered from subtracted sketches."""
    only = np.zeros((2, len(a)), np.int64)
    open_ = np.arange(len(a))
    while len(open_):
        step = max(1, (1 << 22) // cells)  # bounds the cells held at a time
        failed = []
        for at in range(0, len(open_), step):
            own = open_[at : at + step]
            owner, _, signs, done = sketch([a[k] for k in own], cells).minus(sketch([b[k] for k in own], cells)).peel()
            for side, sign in enumerate((1, -1)):
                only[side, own] = np.where(done, np.bincount(owner[signs == sign], minlength=len(own)), only[side, own])
            failed.append(own[~done])
        open_ = np.concatenate(failed)
        cells *= 8
    return only[0], only[1]


def likeness(a: list[np.ndarray], b: list[np.ndarray], cells: int = CELLS) -> np.ndarray:
    """Twice the common digests over all digests of the two texts; 1 for two texts without any."""
    only_a, only_b = differing(a, b, cells)
    sizes = np.array([len(x) for x in a]) + np.array([len(x) for x in b])
    return np.where(sizes > 0, (sizes - only_a - only_b) / np.maximum(1, sizes), 1.0)


def bounds_above(value, bounds: list[float]):
    """How many of the falling bounds lie above the value: first among every root-th of them, then inside one stretch."""
    if not bounds:
        return F.lit(0)
    step = max(1, round(len(bounds) ** 0.5))
    whole = F.size(F.filter(F.lit(bounds[::step]), lambda b: value < b))
    inside = F.size(F.filter(F.slice(F.lit(bounds), (whole - 1) * step + 1, F.lit(step)), lambda b: value < b))
    return F.when(whole == 0, 0).otherwise((whole - 1) * step + inside)


def with_next(docs: DataFrame, spread: int | None = None):
    """Rows dealt by descending id, in order, each range followed by a copy of the first row after it (`tail`).

    Bounds come from a quantile sketch of the ids; a range's first row is known from a maximum per range, so only
    one row a range is sent twice and no window runs over the whole table. After the last row comes the first.
    """
    n = spread or tasks(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("t"))
    # a null id stands after all others; rows with equal ids stand by their text's hash
    ids = rows.select(F.coalesce("doc_id", F.lit(-1 << 63)).alias("place"), F.xxhash64("t").alias("tie"))
    bounds = sorted({float(x) for x in ids.approxQuantile("place", [k / n for k in range(1, n)], 0.1 / n)}, reverse=True) if n > 1 else []
    part = bounds_above(F.col("place").cast("double"), bounds)
    firsts = {r.part: (r.first.place, r.first.tie) for r in ids.withColumn("part", part).groupBy("part").agg(F.max(F.struct("place", "tie")).alias("first")).collect()}
    order = sorted(firsts)
    before = {own: order[k - 1] for k, own in enumerate(order)}
    known = [k in firsts for k in range(len(bounds) + 1)]
    at = lambda values: F.get(F.lit(values), part)
    is_first = (F.col("place") == at([firsts[k][0] if ok else 0 for k, ok in enumerate(known)])) & (F.col("tie") == at([firsts[k][1] if ok else 0 for k, ok in enumerate(known)]))
    goes = F.when(is_first, at([before.get(k, 0) for k in range(len(known))]))  # at most a row a range
    placed = rows.withColumns({"place": F.coalesce("doc_id", F.lit(-1 << 63)), "tie": F.xxhash64("t")}).withColumn("part", part)
    copies = F.array_compact(F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("tail")), F.when(goes.isNotNull(), F.struct(goes.alias("part"), F.lit(True).alias("tail")))))
    out = placed.withColumn("to", F.explode(copies)).select("doc_id", "t", "place", "tie", F.col("to.part").alias("part"), F.col("to.tail").alias("tail"))
    return out.repartitionById(n, "part").sortWithinPartitions("part", "tail", F.desc("place"), F.desc("tie"))


def fingerprints(docs: DataFrame, cells: int = CELLS, batch: int = 256, spread: int | None = None) -> DataFrame:
    """`doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next` per row.

    The edited text has its last floor(n/2) code points replaced by the first as many of the next document by descending id. A
    null text is empty, a null id stands last, rows with equal ids by their text's hash; a single row is its own next.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def judged(triples):
        """Triples of id, text, next text."""
        ids, texts, after = zip(*triples, strict=True)
        edited = [t[: len(t) - len(t) // 2] + x[: len(t) // 2] for t, x in zip(texts, after, strict=True)]
        sets, edited_sets = ([items(t) for t in x] for x in (texts, edited))
        next_sets = [sets[k + 1] if k + 1 < len(texts) and texts[k + 1] is t else items(t) for k, t in enumerate(after)]
        columns = [
            ids, [len(t) for t in texts], [hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in edited],
            written(sketch(sets, cells), texts, [len(s) for s in sets]), written(sketch(edited_sets, cells), edited, [len(s) for s in edited_sets]),
            likeness(sets, edited_sets, cells), likeness(sets, next_sets, cells),
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def run(batches):
        waiting, part, closed, out, size = None, None, False, [], 0
        for b in batches:
            for doc_id, text, own, tail in zip(*(b[c].to_pylist() for c in ("doc_id", "t", "part", "tail")), strict=True):
                if own != part:
                    waiting, part, closed = None, own, False
                if waiting is not None and not closed:
                    out.append((*waiting, text))
                    size += len(waiting[1])
                    if len(out) >= batch or size > 4_000_000:
                        yield judged(out)
                        out, size = [], 0
                waiting, closed = (doc_id, text), tail
        if out:
            yield judged(out)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, spread).select("doc_id", "t", "part", "tail").mapInArrow(run, schema)
