"""A wavelet matrix over token ids: one bit-plane per id bit, each with sampled ranks, in one compressed file.

File: magic, length of the JSON header, header, then zstd frames (planes, ranks, document ids, lengths) at
the offsets the header names. A reader loads planes as it needs them; `access`, `count`, `locate` and `ids` never
hold more than the planes.
"""

from __future__ import annotations

import json
import struct

import numpy as np
import zstandard

MAGIC = b"TWM1"
BLOCK = 512  # bits between two rank samples


def build_planes(ids: np.ndarray, bits: int) -> tuple[list[np.ndarray], list[int]]:
    """Packed planes from the highest bit down, and the zeros of each; the order is split stably after each plane."""
    planes, zeros = [], []
    now, then = ids.copy(), np.empty_like(ids)
    for shift in range(bits - 1, -1, -1):
        plane = (now & ids.dtype.type(1 << shift)) != 0
        ones = int(np.count_nonzero(plane))
        planes.append(np.packbits(plane, bitorder="little"))
        zeros.append(len(plane) - ones)
        if shift:  # two buffers take turns
            np.compress(plane, now, out=then[len(plane) - ones :])
            np.logical_not(plane, out=plane)
            np.compress(plane, now, out=then[: len(plane) - ones])
            now, then = then, now
    return planes, zeros


def ranks_of(packed: np.ndarray) -> np.ndarray:
    """Ones before each block."""
    step = BLOCK // 8
    padded = np.zeros(-(-max(1, len(packed)) // step) * step, np.uint8)
    padded[: len(packed)] = packed
    ones = np.bitwise_count(padded.reshape(-1, step)).sum(axis=1, dtype=np.uint64)
    return np.concatenate([[0], np.cumsum(ones)]).astype(np.uint64)


def write(stream, ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray, extra: dict, bits: int = 16) -> None:
    planes, zeros = build_planes(ids, bits)
    frames = [*planes, *map(ranks_of, planes), doc_ids.astype(np.int64), lengths.astype(np.int64)]
    packer = zstandard.ZstdCompressor(level=1)
    packed = [packer.compress(np.ascontiguousarray(f).tobytes()) for f in frames]
    head = json.dumps({"n": len(ids), "bits": bits, "zeros": zeros, "sizes": [len(p) for p in packed], **extra}).encode()
    stream.write(MAGIC + struct.pack("<I", len(head)) + head)
    for p in packed:
        stream.write(p)


class WaveletFile:
    def __init__(self, file):
        self.file = file
        file.seek(0)
        if bytes(file.read(4)) != MAGIC:
            raise ValueError("not a token file")
        (size,) = struct.unpack("<I", file.read(4))
        self.head = json.loads(bytes(file.read(size)))
        self.n, self.bits, self.zeros = self.head["n"], self.head["bits"], self.head["zeros"]
        starts = np.concatenate([[0], np.cumsum(self.head["sizes"])]) + 8 + size
        self.at = list(zip(starts[:-1].tolist(), self.head["sizes"], strict=True))
        self.kept: dict[int, np.ndarray] = {}

    def frame(self, k: int, kind) -> np.ndarray:
        start, size = self.at[k]
        self.file.seek(start)
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(self.file.read(size))), kind)

    def plane(self, level: int) -> np.ndarray:
        if level not in self.kept:
            self.kept[level] = self.frame(level, np.uint8)
        return self.kept[level]

    def ranks(self, level: int) -> np.ndarray:
        if self.bits + level not in self.kept:
            self.kept[self.bits + level] = self.frame(self.bits + level, np.uint64)
        return self.kept[self.bits + level]

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        return self.frame(2 * self.bits, np.int64), self.frame(2 * self.bits + 1, np.int64)

    def bit(self, level: int, i: int) -> int:
        return int(self.plane(level)[i >> 3] >> (i & 7)) & 1

    def rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits."""
        block, step = i // BLOCK, BLOCK // 8
        ones = int(self.ranks(level)[block])
        tail = self.plane(level)[block * step : (i >> 3) + 1]
        whole = (i >> 3) - block * step
        ones += int(np.bitwise_count(tail[:whole]).sum())
        if i & 7:
            ones += int(tail[whole] & ((1 << (i & 7)) - 1)).bit_count()
        return ones

    def select(self, level: int, value: int, k: int) -> int:
        """Place of the k-th (from 0) bit with this value: bisection over the ranks."""
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            got = self.rank1(level, mid + 1)
            if (got if value else mid + 1 - got) > k:
                high = mid
            else:
                low = mid + 1
        return low

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.bits):
            b, ones = self.bit(level, i), self.rank1(level, i)
            value = value << 1 | b
            i = self.zeros[level] + ones if b else i - ones
        return value

    def span(self, token: int, low: int, high: int) -> tuple[int, int]:
        for level in range(self.bits):
            a, b = self.rank1(level, low), self.rank1(level, high)
            if token >> (self.bits - 1 - level) & 1:
                low, high = self.zeros[level] + a, self.zeros[level] + b
            else:
                low, high = low - a, high - b
        return low, high

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        a, b = self.span(token, low, self.n if high is None else high)
        return b - a

    def locate(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence."""
        a, b = self.span(token, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for level in range(self.bits - 1, -1, -1):
            one = token >> (self.bits - 1 - level) & 1
            i = self.select(level, one, i - self.zeros[level] if one else i)
        return i

    def ids(self) -> np.ndarray:
        """All ids in order, from the lowest plane up: each plane says which places its two halves go back to."""
        out = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            plane = np.unpackbits(self.plane(level), count=self.n, bitorder="little").astype(bool)
            above = np.empty_like(out)
            zeros = self.zeros[level]
            above[~plane] = out[:zeros]
            above[plane] = out[zeros:] | out.dtype.type(1 << (self.bits - 1 - level))
            out = above
        return out
