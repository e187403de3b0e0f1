"""Prefix trie of conversations as balanced parentheses, shard by shard.

A conversation becomes one byte string, a fixed number of bytes a turn: a digest of role and text, and the text's words. Byte order
is then the order in which a walk of the trie meets the conversations, so one range shuffle by (string, id) deals the walk out into
shards, and equal conversations, however many, are dealt out by id. A shard writes its part of the walk as parentheses, two a
node; blocks of excess minima (a range min-max tree) answer `findclose`, which delimits a subtree; rank over "()" counts its
leaves, and cumulative arrays over the opening order give members and savings.

Only nodes on the way to a shard's first or last conversation can go on in other shards. What such a spine node has of its own in
the shard (ends, and the closed subtrees that hang on it) is written as a row per spine; the spines of all shards, two a shard, make
a small trie of the same kind, whose sums join the shared nodes. Identifiers of equal conversations are hashed in a stream, from
pieces of text that the shards prepared.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import cut, tasks, text_or_empty

UNIT = 20  # bytes a turn: 16 of a digest, 4 of the number of words
BLOCK = 256  # parentheses to a block of the range min-max tree
NOTHING = hashlib.sha256(b"").hexdigest()
FAR = np.iinfo(np.int64).max
WORD = r"[^\x20\x09-\x0D]+"
LONGS = pa.list_(pa.int64())
CLOSED = [
    *[pa.field(name, pa.int64()) for name in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")],
    pa.field("ends_sha256", pa.string()), pa.field("number", pa.int64()), pa.field("side", pa.int32()),
]
SPINE = [
    pa.field("s_number", pa.int64()), pa.field("s_side", pa.int32()), pa.field("seq", pa.binary()),
    *[pa.field(f"s_{name}", LONGS) for name in ("members", "low", "leaves", "saved", "children")],
    pa.field("s_digests", pa.list_(pa.string())), pa.field("ids", pa.string()),
]


class Parentheses:
    """Balanced parentheses with a range min-max tree of excess."""

    def __init__(self, opens: np.ndarray):
        self.opens = opens
        self.excess = np.cumsum(np.where(opens, 1, -1), dtype=np.int32)
        n = len(opens)
        size = -(-max(n, 1) // BLOCK)
        padded = np.full(size * BLOCK, np.iinfo(np.int32).max, np.int32)
        padded[:n] = self.excess
        self.blocks = padded.reshape(size, BLOCK)
        self.levels = [self.blocks.min(axis=1)]
        while len(self.levels[-1]) > 1:
            low = self.levels[-1]
            if len(low) % 2:
                low = np.append(low, np.iinfo(np.int32).max)
                self.levels[-1] = low
            self.levels.append(np.minimum(low[::2], low[1::2]))
        leaves = np.zeros(n, bool)
        if n:
            leaves[:-1] = opens[:-1] & ~opens[1:]
        self.leaf_rank = np.concatenate([[0], np.cumsum(leaves)])

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """Places of the parentheses that close those opened at `at`: the next place whose excess is below theirs."""
        goal = self.excess[at]
        out = np.full(len(at), -1, np.int64)
        block = at // BLOCK
        flat = self.blocks.ravel()
        # the rest of the own block
        open_now = np.arange(len(at))
        place = at + 1
        while len(open_now):
            place_now = place[open_now]
            inside = (place_now // BLOCK == block[open_now]) & (place_now < len(self.opens))
            open_now, place_now = open_now[inside], place_now[inside]
            hit = flat[place_now] < goal[open_now]
            out[open_now[hit]] = place_now[hit]
            open_now = open_now[~hit]
            place[open_now] += 1
        # up to the first later block with a lower excess, then down to it
        left = np.nonzero(out < 0)[0]
        node, level = block[left], np.zeros(len(left), np.int64)
        found = np.zeros(len(left), bool)
        for depth, low in enumerate(self.levels[:-1]):
            going = np.nonzero(~found)[0]
            right = node[going] % 2 == 0
            hit = np.zeros(len(going), bool)
            hit[right] = low[node[going][right] + 1] < goal[left[going[right]]]
            node[going[hit]] += 1
            level[going[hit]] = depth
            found[going[hit]] = True
            node[going[~hit]] //= 2
        for depth in range(len(self.levels) - 2, -1, -1):
            down = np.nonzero(level > depth)[0]
            child = node[down] * 2
            first = self.levels[depth][child] < goal[left[down]]
            node[down] = np.where(first, child, child + 1)
        for chunk in np.array_split(np.arange(len(left)), max(1, len(left) // 4096)):
            own = left[chunk]
            out[own] = node[chunk] * BLOCK + (self.blocks[node[chunk]] < goal[own][:, None]).argmax(axis=1)
        return out

    def leaves(self, at: np.ndarray, close: np.ndarray) -> np.ndarray:
        """Pairs "()" between each opening and its closing."""
        return self.leaf_rank[close] - self.leaf_rank[at]


def shared_units(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // UNIT
    low, high = 0, n
    while high - low > 1:  # a[:low] equals b[:low], a[:high] differs
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low // UNIT


class Trie:
    """The nodes that strings given in byte order pass, in opening order, with their parentheses."""

    def __init__(self):
        self.parts: list[tuple[int, int]] = []  # nodes closed before, nodes opened by each string
        self.parent, self.depth, self.words = [-1], [0], [0]
        self.path, self.last, self.first = [0], b"", None

    def add(self, seq: bytes) -> int:
        """The node of this string, which is not below the one before."""
        self.first = seq if self.first is None else self.first
        keep, size = shared_units(self.last, seq), len(seq) // UNIT
        self.parts.append((len(self.path) - 1 - keep, size - keep))
        del self.path[keep + 1 :]
        for d in range(keep, size):
            self.parent.append(self.path[-1])
            self.depth.append(d + 1)
            self.words.append(int.from_bytes(seq[UNIT * d + 16 : UNIT * d + UNIT], "big"))
            self.path.append(len(self.parent) - 1)
        self.last = seq
        return self.path[-1]

    def close(self) -> None:
        """Subtree spans of all nodes: `places`, `closes`, and `ends`, the first node in opening order behind each subtree."""
        runs = [[1]]
        for closed, opened in self.parts:
            runs += [np.zeros(closed, bool), np.ones(opened, bool)]
        opens = np.concatenate([*runs, np.zeros(len(self.path), bool)]).astype(bool)
        self.par = Parentheses(opens)
        self.places = np.nonzero(opens)[0]
        self.closes = self.par.findclose(self.places)
        self.ends = np.arange(len(self.places)) + (self.closes - self.places + 1) // 2
        self.parents = np.array(self.parent, np.int64)
        self.depths = np.array(self.depth, np.int64)
        self.sizes = np.array(self.words, np.int64)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum over each subtree, from one cumulative array."""
        total = np.concatenate([[0], np.cumsum(values)])
        return total[self.ends] - total[:-1]

    def least(self, values: np.ndarray) -> np.ndarray:
        """Least value of each subtree: two overlapping windows of a power of two, one power at a time."""
        starts, n = np.arange(len(values)), self.ends - np.arange(len(values))
        power = np.floor(np.log2(n)).astype(int)
        out, table, width = np.empty_like(values), values.copy(), 1
        for p in range(int(power.max()) + 1):
            own = power == p
            out[own] = np.minimum(table[starts[own]], table[self.ends[own] - width])
            table = np.minimum(table[: len(table) - width], table[width:]) if len(table) > width else table
            width *= 2
        return out


class Shard:
    """One run of the walk: conversations in order of their string, then of their id."""

    def __init__(self, number: int, most: int):
        self.number, self.most, self.trie, self.rows = number, most, Trie(), 0
        # of each distinct string: its node, conversations, smallest id, digest of the ids
        self.at, self.counts, self.lows, self.digests = [], [], [], []
        self.last, self.ids, self.first_ids = None, [], None

    @property
    def full(self) -> bool:
        return self.rows + len(self.trie.parent) >= self.most

    def add(self, conv_id: int, seq: bytes) -> None:
        if seq != self.last:
            self.finish()
            self.at.append(self.trie.add(seq))
            self.counts.append(0)
            self.lows.append(conv_id)
            self.last = seq
        self.counts[-1] += 1
        self.ids.append(str(conv_id))
        self.rows += 1

    def finish(self) -> None:
        """Ids of a string between the first and the last are all here: only the digest stays."""
        if self.last is not None:
            text = ",".join(self.ids)
            self.digests.append(hashlib.sha256(text.encode()).hexdigest())
            if self.first_ids is None:
                self.first_ids = text
            self.ids = []

    def close(self) -> tuple[list, list]:
        """Closed nodes as columns, and the two spines as rows."""
        last_ids = ",".join(self.ids)
        self.finish()
        t = self.trie
        t.close()
        n = len(t.parent)
        counts, lows, digests = np.zeros(n, np.int64), np.full(n, FAR), np.full(n, NOTHING, object)
        counts[self.at], lows[self.at], digests[self.at] = self.counts, self.lows, self.digests
        first = list(range(t.depth[self.at[0]] + 1))  # the first string opens the first nodes
        spine = np.zeros(n, bool)
        spine[first] = spine[t.path] = True
        members, least = t.sums(counts), t.least(lows)
        saved = t.sums(np.where(spine, 0, (members - 1) * t.sizes))
        leaves = t.par.leaves(t.places, t.closes)
        children = np.bincount(t.parents[1:], minlength=n)
        inner = np.nonzero(~spine)[0]
        up = t.parents[inner]
        loose = spine[up]
        nodes = [
            least[inner], t.depths[inner], pa.array(least[up], pa.int64(), mask=loose), members[inner], children[inner], leaves[inner],
            saved[inner], pa.array(digests[inner], pa.string()), np.full(len(inner), self.number), np.where(up < len(first), 0, 1).astype(np.int32),
        ]
        # what a spine node has of its own here: ends, and closed subtrees
        top = inner[loose]
        own = {"members": counts.copy(), "leaves": np.zeros(n, np.int64), "saved": np.zeros(n, np.int64), "children": np.zeros(n, np.int64)}
        for k, values in (("members", members), ("leaves", leaves), ("saved", saved), ("children", np.ones(n, np.int64))):
            np.add.at(own[k], t.parents[top], values[top])
        np.minimum.at(lows, t.parents[top], least[top])
        spines = []
        for side, path in ((0, first), (1, t.path)):
            mine = [x if side == 0 or x >= len(first) else None for x in path]  # nodes on both count for the first
            take = lambda values, rest, mine=mine: [rest if x is None else int(values[x]) for x in mine]
            digest = [None if x is None or not counts[x] or x in (self.at[0], self.at[-1]) else digests[x] for x in mine]
            ids = self.first_ids if side == 0 else last_ids if len(self.at) > 1 else None
            seq = t.first if side == 0 else t.last
            spines.append((self.number, side, seq, take(own["members"], 0), take(lows, FAR), take(own["leaves"], 0), take(own["saved"], 0), take(own["children"], 0), digest, ids))
        return nodes, spines


def shard_rows(batches, most: int):
    """The closed nodes and the spines of the shards of a task."""
    number, shard = TaskContext.get().partitionId() << 32, None
    for b in batches:
        for conv_id, seq in zip(b["conv_id"].to_pylist(), b["seq"].to_pylist(), strict=True):
            shard = shard or Shard(number, most)
            shard.add(conv_id, seq)
            if shard.full:
                yield shard_batch(shard)
                number, shard = number + 1, None
    if shard:
        yield shard_batch(shard)


def shard_batch(shard: Shard) -> pa.RecordBatch:
    nodes, spines = shard.close()
    m, k = len(nodes[0]), len(spines)
    columns = [pa.concat_arrays([pa.array(c, f.type), pa.nulls(k, f.type)]) for c, f in zip(nodes, CLOSED, strict=True)]
    columns += [pa.concat_arrays([pa.nulls(m, f.type), pa.array(c, f.type)]) for c, f in zip(zip(*spines, strict=True), SPINE, strict=True)]
    return pa.RecordBatch.from_arrays(columns, [f.name for f in [*CLOSED, *SPINE]])


class Spines:
    """The spines of all shards, in the order of the walk: the nodes they share are joined."""

    def __init__(self):
        self.trie = Trie()
        self.own = {"members": [0], "low": [FAR], "leaves": [0], "saved": [0], "children": [0]}
        self.digests: dict[int, str] = {}
        self.places: list[tuple[int, int, list[int]]] = []
        self.run, self.sha = None, None

    def add(self, r: dict) -> None:
        t, own = self.trie, self.own
        t.add(r["seq"])
        for name, values in own.items():
            values.extend([FAR if name == "low" else 0] * (len(t.parent) - len(values)))
        for d, node in enumerate(t.path):
            for name in ("members", "leaves", "saved", "children"):
                own[name][node] += r[f"s_{name}"][d]
            own["low"][node] = min(own["low"][node], r["s_low"][d])
            if r["s_digests"][d]:
                self.digests[node] = r["s_digests"][d]
        if r["ids"] is not None:  # a string's ids may go on from shard to shard
            if self.run == t.path[-1]:
                self.sha.update(b",")
            else:
                self.finish()
                self.run, self.sha = t.path[-1], hashlib.sha256()
            self.sha.update(r["ids"].encode())
        self.places.append((r["number"], r["side"], list(t.path)))

    def finish(self) -> None:
        if self.run is not None:
            self.digests[self.run] = self.sha.hexdigest()

    def batches(self):
        self.finish()
        t = self.trie
        t.close()
        n = len(t.parent)
        own = {k: np.array(v, np.int64) for k, v in self.own.items()}
        members, low = t.sums(own["members"]), t.least(own["low"])
        children = own["children"] + np.bincount(t.parents[1:], minlength=n)
        leaves = t.sums(own["leaves"] + (children == 0))
        saved = t.sums(own["saved"] + (members - 1) * t.sizes)
        up = pa.array(low[t.parents], pa.int64(), mask=t.parents < 0)
        digest = pa.array([self.digests.get(k, NOTHING) for k in range(n)], pa.string())
        yield joined_batch([low, t.depths, up, members, children, leaves, saved, digest, None, None], n)
        for number, side, path in self.places:
            k = len(path)
            yield joined_batch([low[path], np.arange(k), None, None, None, None, None, None, np.full(k, number), np.full(k, side)], k)


def joined_batch(columns: list, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.nulls(n, f.type) if c is None else pa.array(c, f.type) for c, f in zip(columns, CLOSED, strict=True)], [f.name for f in CLOSED])


def join_spines(batches):
    spines = Spines()
    for b in batches:
        for r in b.to_pylist():
            spines.add(r)
    if spines.places:
        yield from spines.batches()


def sequences(talks: DataFrame, group: int = 20, keep: int = 4) -> DataFrame:
    """`conv_id, seq` of the rebuilt conversations, one row an id."""
    role, text = text_or_empty("role"), text_or_empty("text")
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)
    words = F.lpad(F.hex(F.regexp_count(text, F.lit(WORD)).cast("long")), 8, "0")
    turns = talks.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.concat(digest, words).alias("unit")
    )
    # a null turn comes first in a sorted array of structs
    said = F.transform(F.sort_array(F.collect_list(F.struct("turn", "unit"))), lambda x: x["unit"])
    convs = cut(turns.groupBy("conv_id").agg(said.alias("units")), "conversations")
    heads = convs.filter(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("units", 1, keep - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % keep).cast("int")
    own = convs.select("conv_id", "units", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), h.alias("h"))
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.array().cast("array<string>"))
    rest = F.slice("units", F.col("h") + 1, F.greatest(F.size("units"), F.lit(1)))
    return own.join(heads, "base", "left").select("conv_id", F.unhex(F.array_join(F.concat(head, rest), "")).alias("seq"))


def prefix_trie(talks: DataFrame, most: int = 1 << 18) -> DataFrame:
    """One row a node of the trie of rebuilt conversations: `conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256`.

    Turns of a conversation go by `turn`, null first; equal turn numbers (repeated rows too, which stay) by the digest of role and
    text. Null role or text is empty. Rows without a conversation id belong to none and are left out; an empty table has no nodes,
    not even the root. A conversation whose rebuilt turns are none is a member of the root. Other columns are not read.

    Texts are digested before the first shuffle. Of one conversation 20 bytes a turn are held at once, of a shard `most` nodes and
    conversations. The spines, two a shard, meet in one task.
    """
    placed = sequences(talks).repartitionByRange(tasks(talks.sparkSession), "seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    written = cut(placed.mapInArrow(lambda batches: shard_rows(batches, most), schema_of([*CLOSED, *SPINE])), "shards")
    closed = written.filter("s_side is null").select(*[f.name for f in CLOSED])
    spines = written.filter("s_side is not null").select(*[f.name for f in SPINE])
    spines = spines.select("seq", "s_members", "s_low", "s_leaves", "s_saved", "s_children", "s_digests", "ids", F.col("s_number").alias("number"), F.col("s_side").alias("side"))
    met = cut(spines.coalesce(1).sortWithinPartitions("number", "side").mapInArrow(join_spines, schema_of(CLOSED)), "spines")
    places = met.filter("number is not null").select("number", "side", (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("above"))
    # closed nodes that hang on a spine take their parent from it
    hung = closed.filter("parent_conv_id is null").join(places, ["number", "side", "depth"]).withColumn("parent_conv_id", F.col("above"))
    names = [f.name for f in CLOSED[:8]]
    return closed.filter("parent_conv_id is not null").select(names).unionByName(hung.select(names)).unionByName(met.filter("number is null").select(names))


def schema_of(fields) -> str:
    kinds = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>", pa.list_(pa.string()): "array<string>"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in fields)
