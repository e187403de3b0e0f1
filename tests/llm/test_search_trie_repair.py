"""Top products, prefix trie and conversation repair against brute force, and their defined results for odd rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.llm import prefix_trie, repair, top_products

VECTORS = "vec_id long, embedding array<double>"


def brute_products(rows, k=5):
    fine = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, (i, v) in enumerate(fine):
        if i is not None and i % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j is None, j or 0, j) for n, (j, w) in enumerate(fine) if n != at)  # noqa: B905
            out += [(i, r + 1, s[3], -s[0]) for r, s in enumerate(scores[:k])]
    return sorted(out, key=str)


def products(spark, rows, **settings):
    frame = spark.createDataFrame(rows, VECTORS).withColumns({"query": F.lit("q"), "score": F.lit(1), "rank": F.lit("r")})
    return sorted(map(tuple, top_products.top_products(frame.repartition(3), **settings).collect()), key=str)


@pytest.mark.parametrize("settings", [{}, {"shard_rows": 7, "sample_rows": 20}, {"sample_rows": 3}])
def test_top_products_equal_brute_force(spark, settings):
    rng = np.random.default_rng(4)
    rows = [(k, (rng.normal(size=12) * (rng.random(12) < 0.7)).round(2).tolist()) for k in range(160)]
    rows += [(200 + k, rows[50][1]) for k in range(12)]  # ties, with a query's vector
    rows += [(50, rows[50][1]), (50, rows[3][1]), (3, rows[3][1]), (None, rows[50][1]), (None, rows[3][1])]  # repeated rows and ids
    rows += [(400, None), (450, [None, 1.0]), (500, [float("nan")]), (550, [float("inf")]), (600, []), (650, [0.0] * 12), (700, [1.0, -2.0]), (701, [0.5] * 20)]
    assert products(spark, rows, **settings) == brute_products(rows)


def test_top_products_of_few_and_large(spark):
    assert products(spark, [(0, [1.0])]) == []
    assert products(spark, [(1, [1.0]), (2, [1.0])]) == []
    assert top_products.top_products(spark.createDataFrame([], VECTORS)).count() == 0
    assert products(spark, [(0, [1.0]), (7, [-1.0]), (8, [0.0])]) == [(0, 1, 8, 0), (0, 2, 7, -65536)]
    big = [(0, [1e30, 1.0]), (1, [1e30, 0.0]), (2, [-1e30, 0.0]), (3, [2.0**40, 2.0**40])]
    assert products(spark, big) == [(0, 1, 1, 2**63 - 1), (0, 2, 3, 2**63 - 1), (0, 3, 2, -(2**63))]


def test_postings_skip_rows_that_cannot_win():
    rng = np.random.default_rng(8)
    rows = np.floor(256 * rng.normal(size=(300, 16)) / 4).astype(np.int64)
    shard = top_products.Shard(list(range(300)), rows.tolist())
    for q in rows[:20]:
        scores = rows @ q
        order = sorted(range(300), key=lambda j: (-scores[j], j))
        for floor in (None, int(scores[order[5]]), int(scores[order[0]])):
            at, got = shard.best(q, 6, floor)
            want = [j for j in order[:6] if floor is None or scores[j] >= floor]
            assert at.tolist() == want and got.tolist() == [scores[j] for j in want]


TALKS = "conv_id long, turn long, role string, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_trie(rows):
    talks = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            talks.setdefault(c, []).append((t is not None, t or 0, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).hexdigest(), (r, x)))
    talks = {c: [z[3] for z in sorted(v, key=lambda z: z[:3])] for c, v in talks.items()}
    seqs = {}
    for c, v in talks.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(math.fmod(c, 20))  # SQL's remainder
        seqs[c] = tuple(talks.get(base, [])[:h] + v[h:])
    nodes, kids = {}, {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes.setdefault(s[:d], []).append(c)
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = []
    for p, m in nodes.items():
        sub = [q for q in nodes if q[: len(p)] == p]
        ends = ",".join(str(c) for c in sorted(m) if len(seqs[c]) == len(p))
        saved = sum((len(nodes[q]) - 1) * len(WORD.findall(q[-1][1])) for q in sub if q)
        out.append((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), sum(q not in kids for q in sub), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def talks(spark, rows):
    return spark.createDataFrame(rows, TALKS).withColumns({"seq": F.lit(1), "number": F.lit("n"), "units": F.lit("u"), "kind": F.lit(0), "digest": F.lit("d"), "copy": F.lit("c")})


@pytest.mark.parametrize("most", [1 << 18, 40, 1])
def test_trie_equals_brute_force_at_any_shard_size(spark, most):
    rnd = random.Random(1)
    rows = []
    for c in range(160):
        for t in range(rnd.randrange(0, 7)):
            rows.append((c, t, rnd.choice("us"), rnd.choice(["a b", "c", "", " x y z ", None])))
    for c in range(1000, 1300):  # a hot conversation, below a hot first turn
        rows += [(c, 0, "u", "same words here"), (c, 1, "a", "again")] + ([(c, 2, "u", str(c))] if c % 3 else [])
    rows += [(5000, None, "u", "n"), (5000, 1, "u", "n"), (5000, 1, "u", "n"), (5000, 1, None, None), (None, 1, "u", "x"), (13, 0, "u", "k"), (-7, 0, "u", "same words here")]
    rows += [(6000, t, "u", f"{t} " * 3) for t in range(700)]  # a long one
    got = sorted(map(tuple, prefix_trie.prefix_trie(talks(spark, rows), most=most).collect()), key=str)
    assert got == brute_trie(rows)


def test_trie_of_no_rows(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TALKS)).count() == 0
    alone = prefix_trie.prefix_trie(spark.createDataFrame([(13, 0, "u", "x")], TALKS)).collect()  # its first turns are another's
    assert [tuple(r)[:7] for r in alone] == brute_small([(13, 0, "u", "x")])


def brute_small(rows):
    return [r[:7] for r in brute_trie(rows)]


def test_findclose_and_leaf_ranks():
    rnd = random.Random(2)
    for size in (1, 2, 50, 900, 5000):
        opens, depth = [], 0
        for _ in range(size):
            up = depth == 0 or rnd.random() < 0.53
            opens.append(up)
            depth += 1 if up else -1
        opens = np.array([True, *opens, *[False] * (depth + 1)])
        stack, close = [], {}
        for k, up in enumerate(opens):
            if up:
                stack.append(k)
            else:
                close[stack.pop()] = k
        par = prefix_trie.Parentheses(opens)
        at = np.nonzero(opens)[0]
        got = par.findclose(at)
        assert got.tolist() == [close[k] for k in at.tolist()]
        leaves = par.leaves(at, got)
        assert leaves.tolist() == [sum(opens[j] and not opens[j + 1] for j in range(k, close[k])) for k in at.tolist()]


NEXT = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}


def cheapest(rows):
    """All ways to edit rows of (initial, fault): the cheapest, then the first in ASCII order."""
    best = (float("inf"), "")

    def go(i, s, cost, audit, spare):
        nonlocal best
        if cost > best[0]:
            return
        if i == len(rows) and s in (0, 3):
            best = min(best, (cost, audit))
        if spare:
            go(i, 3 if s == 2 else 2, cost + 2, audit + "I", spare - 1)
        if i < len(rows):
            initial, fault = rows[i]
            go(i + 1, s, cost + 3, audit + "D", 3)
            if fault < 2:
                if (initial, s) in NEXT:
                    go(i + 1, NEXT[initial, s], cost + fault, audit + "K", 3)
                go(i + 1, 3 if s == 2 else 2, cost + 2 + fault, audit + "R", 3)

    go(0, 0, 0, "", 3)
    return best


def test_edits_equal_all_ways():
    rnd = random.Random(5)
    for _ in range(3000):
        codes = bytes(rnd.randrange(12) for _ in range(rnd.randrange(0, 6)))
        assert repair.repair(codes) == cheapest([repair.CODES[c] for c in codes])


def test_long_conversation_has_the_cost_of_the_forward_vector():
    rnd = random.Random(6)
    codes = bytes(rnd.randrange(12) for _ in range(20_000))
    cost, audit = repair.repair(codes)
    ends, _ = repair.forward(codes, 0, len(codes), repair.NONE)
    assert cost == min(c + 2 * repair.OWED[s] for s, c in enumerate(ends))
    spent = sum({"K": 0, "R": 2, "D": 3, "I": 2}[e] for e in audit)
    rows = [e for e in audit if e != "I"]
    assert len(rows) == len(codes) and spent + sum(c % 3 == 1 and e != "D" for c, e in zip(codes, rows, strict=True)) == cost


def brute_repair(rows):
    after = {}
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        after.setdefault(c, [])
        if k:
            x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
            after[c] += [(t, "user" if k == 4 else r, x)] * (2 if k == 3 else 1)
    out = []
    for c, own in after.items():
        own.sort(key=lambda z: (z[0] is not None, z[0] or 0, z[1][:1], hashlib.sha256(f"{len(z[1])}:{z[1]}{z[2]}".encode()).hexdigest()))
        seen, faults = set(), []
        for _, r, x in own:
            core = x.strip("\x20\x09\x0a\x0b\x0c\x0d")
            faults.append("blank" if not core else "duplicate" if (r, x) in seen else "" if core[-1] in ".!?" else "truncated")
            seen.add((r, x))
        cost, audit = cheapest([(r[:1], {"": 0, "truncated": 1}.get(f, 2)) for (_, r, _), f in zip(own, faults, strict=True)]) if own else (0, "")
        lines, state, at = [], 0, 0
        for e in audit:
            if e in "IR":
                state = 3 if state == 2 else 2
                lines.append(("user:", "assistant:")[state - 2] + (own[at][2] if e == "R" else ""))
            elif e == "K":
                state = NEXT[own[at][1][0], state]
                lines.append(own[at][1] + ":" + own[at][2])
            at += e != "I"
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        out.append((c, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def test_repair_equals_brute_force(spark):
    rnd = random.Random(3)
    words = ["Yes.", "No!", "cut short", "", " \t", "A. B? \n", None, "Same.", "Ü?", "one\ntwo."]
    rows = [(c, t + (t > 2) * rnd.randrange(2), rnd.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), rnd.choice(words)) for c in range(120) for t in range(rnd.randrange(1, 6))]
    rows += [(None, 1, "user", "Hi."), (None, None, "assistant", "Ho."), (500, None, "user", "Hi."), (500, None, "assistant", None), (501, 4, "user", "One."), (501, 4, "user", "One."), (501, 9, "assistant", "Two.")]
    got = sorted(map(tuple, repair.repaired(talks(spark, rows)).collect()), key=str)
    assert got == brute_repair(rows)
    assert repair.repaired(spark.createDataFrame([], TALKS)).count() == 0


def test_repair_of_one_long_conversation(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", f"Text {t % 700}." * 20) for t in range(6000)]
    got = repair.repaired(spark.createDataFrame(rows, TALKS)).collect()
    assert len(got) == 1 and got[0].duplicate > 4000 and len(got[0].audit.replace("I", "")) == repair.damaged(spark.createDataFrame(rows, TALKS)).count()
