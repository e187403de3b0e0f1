"""Byte-level BPE by rank files.

Every distinct word of the documents is folded once by Spark's higher-order functions: the bytes of a word are an array of pieces,
and each step merges the first adjacent pair of the lowest rank, which a literal map of pairs gives. A block of documents (neighbouring
rows of a file) gives its distinct words; they meet by word, are folded, and go back to their blocks with the ids as a table, so
that no text is shuffled. Documents are then split into words again and spelled from the ids of their block. Digests and
decoding, a concatenation of the tokens' binary pieces, are Spark expressions over a document's ids.
"""

from __future__ import annotations

import base64
import functools
import heapq
import json
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import regex
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import cut, shared_folder, slices, tasks, text_or_empty
from touchline.llm.token_words import DIGITS, LETTERS, OTHER, SPACES, Remembered

#: Buckets of the literal rank map, a prime: a lookup reads the few entries of one bucket.
BUCKETS = 65_521
CELLS = "array<bigint>"
#: All of Unicode's white space, as `\\s` of the rank files' pattern has it.
WHITE = SPACES + "\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


#: The first choices of the rank files' pattern.
ENDINGS, WORDS = "'s|'t|'re|'ve|'m|'ll|'d|", r" ?\p{L}+| ?\p{N}+|"


def default_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.lru_cache(maxsize=2)
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


@functools.lru_cache(maxsize=2)
def splitters(pattern: str) -> tuple[re.Pattern, regex.Pattern]:
    """The pattern for texts below U+0300, with letters and digits written out, and for all texts.

    Words and numbers are tried ahead of the endings, which no word or number begins like: the same matches in less time.
    """
    if pattern.startswith(ENDINGS + WORDS):
        pattern = WORDS + ENDINGS + pattern[len(ENDINGS + WORDS) :]
    plain = pattern.replace("[^\\s\\p{L}\\p{N}]", f"[^{SPACES}{LETTERS}{DIGITS}]").replace("\\p{L}", f"[{LETTERS}]").replace("\\p{N}", f"[{DIGITS}]").replace("\\s", f"[{SPACES}]").replace("\\S", f"[^{SPACES}]")
    wide = pattern.replace("[^\\s", f"[^{WHITE}").replace("\\s", f"[{WHITE}]").replace("\\S", f"[^{WHITE}]")
    return re.compile(plain), regex.compile(wide)


def pre_tokens(text: str, pattern: str) -> list[str]:
    plain, wide = splitters(pattern)
    try:
        text.encode("latin-1")  # much faster than a search, and most texts pass
    except UnicodeEncodeError:
        if OTHER.search(text):
            return wide.findall(text)
    return plain.findall(text)


# the fold by Spark's higher-order functions


@functools.lru_cache(maxsize=2)
def pieces_of(path: str) -> dict[bytes, int]:
    """Ids of all pieces: the ranks, and numbers above them for bytes that the file leaves out."""
    ranks = ranks_of(path)
    top = max(ranks.values()) + 1
    return ranks | {one: top + b for b in range(256) if (one := bytes([b])) not in ranks}


def literal(value: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value, separators=(",", ":"))), kind)


def bits_of(path: str) -> int:
    """Bits of a piece's id; the number of all ones is no id."""
    return (max(pieces_of(path).values()) + 1).bit_length()


@functools.lru_cache(maxsize=2)
def pair_ranks(path: str) -> list[dict[int, int]]:
    """The rank of every pair of pieces that are a token together, by the ids of both, dealt to buckets."""
    pieces, bits = pieces_of(path), bits_of(path)
    buckets: list[dict[int, int]] = [{} for _ in range(BUCKETS)]
    for token, rank in ranks_of(path).items():
        for k in range(1, len(token)):
            left, right = pieces.get(token[:k]), pieces.get(token[k:])
            if left is not None and right is not None:
                key = left << bits | right
                buckets[key % BUCKETS][key] = rank
    return buckets


@functools.lru_cache(maxsize=2)
def unmerged(path: str) -> dict[str, int]:
    """Tokens, in hex digits, that merges don't end in: only these must be looked for as whole words."""
    pieces = pieces_of(path)
    return {t.hex().upper(): r for t, r in ranks_of(path).items() if merged_alone(t, pieces) != [r]}


def let(value: Column, body, kind: str) -> Column:
    """`body`, of type `kind`, of a value that is computed once.

    A fold of one element: the type of a lambda's variable is known, while that of an element of a transformed array would be worked
    out from the whole body for every row.
    """
    return F.aggregate(F.array(value), F.lit(None).cast(kind), lambda _, own: body(own))


def folded_ids(word: Column, path: str) -> Column:
    """Ids of a word (array<int>): ranked merges folded over the array of its bytes."""
    # one literal for all lookups: the plan and its descriptions hold it once
    pairs = literal(pair_ranks(path), "array<map<string,bigint>>")
    return let(pairs, lambda ranks: folded_by(word, ranks, path), "array<int>")


def folded_by(word: Column, ranks: Column, path: str) -> Column:
    """A piece is one number: the rank of its pair with the next piece, its place and its id, so the least is the first pair of the lowest rank."""
    bits = bits_of(path)
    above = 63 - bits  # the rank's lowest bit; places have the bits between
    none = ((1 << bits) - 1) << above
    own, rest = (1 << bits) - 1, (1 << above) - 1
    places = rest - own

    def beside(left, right):
        """The rank of a pair, in its place; `none` if it is no token or has no right piece."""
        found = lambda key: F.element_at(F.get(ranks, (key % BUCKETS).cast("int")), key.cast("string"))
        return F.coalesce(F.shiftleft(let(F.shiftleft(left, bits).bitwiseOR(right), found, "bigint"), above), F.lit(none))

    def merged(cells, low, before):
        """The piece after `before` and the next as one, whose id is the rank of their pair; only the ranks beside it are looked up."""
        at, piece = F.size(before), F.shiftright(low, above)
        joined = beside(piece, F.get(cells, at + 2).bitwiseAND(own)).bitwiseOR(low.bitwiseAND(places)).bitwiseOR(piece)
        last = lambda cell: beside(cell.bitwiseAND(own), piece).bitwiseOR(cell.bitwiseAND(rest))
        here = F.when(at > 0, F.array(last(F.get(before, at - 1)), joined)).otherwise(F.array(joined))
        whole = lambda new: F.concat(F.slice(before, F.lit(1), F.greatest(at - 1, F.lit(0))), new, F.slice(cells, at + 3, F.size(cells)))
        return let(here, whole, CELLS)

    def step(cells, _):
        # found by a filter, as `array_position` throws and catches an exception for whatever it finds
        before = lambda low: let(low.bitwiseAND(places), lambda here: F.filter(cells, lambda cell: cell.bitwiseAND(places) < here), CELLS)
        best = lambda low: F.when(low >= none, cells).otherwise(let(before(low), lambda left: merged(cells, low, left), CELLS))
        return let(F.array_min(cells), best, CELLS)

    pieces = pieces_of(path)
    codes = literal([pieces[bytes([b])] for b in range(256)], "array<bigint>")
    letters = F.split(F.decode(word.cast("binary"), "ISO-8859-1"), "")  # one a byte
    single = F.transform(letters, lambda c: F.get(codes, F.ascii(c)))
    first = lambda ids: F.transform(ids, lambda i, k: beside(i, F.get(ids, k + 1)).bitwiseOR(F.shiftleft(k.cast("long"), bits)).bitwiseOR(i))
    fold = let(let(single, first, CELLS), lambda cells: F.aggregate(F.slice(cells, F.lit(2), F.size(cells)), cells, step), CELLS)
    folded = F.transform(fold, lambda cell: cell.bitwiseAND(own).cast("int"))
    if len(pieces) > len(ranks_of(path)):
        top = max(ranks_of(path).values())
        folded = F.transform(folded, lambda i: F.when(i <= top, i))
    if not (known := unmerged(path)):
        return folded
    # a word that is a token is taken whole, as the library does
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for digits, rank in known.items():
        buckets[zlib.crc32(digits.encode()) % BUCKETS][digits] = rank
    whole = lambda digits: F.element_at(F.get(literal(buckets, "array<map<string,int>>"), (F.crc32(digits.cast("binary")) % BUCKETS).cast("int")), digits)
    return let(let(F.hex(word.cast("binary")), whole, "int"), lambda rank: F.when(rank.isNotNull(), F.array(rank)).otherwise(folded), "array<int>")


# the words of blocks of documents


def in_blocks(docs: DataFrame, chars: int) -> DataFrame:
    """`doc_id, t, block`: rows of a file that follow one another, about `chars` characters, share a block.

    File and row number are the same in every read; rows without them are written first.
    """
    try:
        place = docs.metadataColumn("_metadata")
        rows = docs.select("doc_id", text_or_empty().alias("t"), place["file_path"].alias("file"), place["row_index"].alias("at"))
    except AnalysisException:
        return in_blocks(cut(docs.select("doc_id", "text"), "texts"), chars)
    n, total = rows.agg(F.count("*"), F.sum(F.length("t"))).first()
    each = max(1, chars * n // max(1, total or 0))
    return rows.select("doc_id", "t", F.xxhash64("file", F.floor(F.col("at") / each)).alias("block"))


def block_words(rows: DataFrame, pattern: str, words: int, longest: int) -> DataFrame:
    """`block, word`: each block's distinct words of at most `longest` bytes; a task gives them on when it holds more than `words`."""

    def run(batches):
        block, held = None, set()

        def given():
            own = sorted(w for w in held if len(w) * 4 <= longest or len(w.encode("utf-8", "replace")) <= longest)
            held.clear()
            for at in range(0, len(own), 1 << 14):
                part = own[at : at + (1 << 14)]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(part), pa.int64()), pa.array(part, pa.string())], ["block", "word"])

        for b in slices(batches):
            for here, text in zip(b["block"].to_pylist(), b["t"].to_pylist(), strict=True):
                if here != block or len(held) > words:
                    yield from given()
                    block = here
                held.update(pre_tokens(text, pattern))
        yield from given()

    return rows.select("block", "t").mapInArrow(run, "block long, word string")


def folded_words(rows: DataFrame, path: str, pattern: str, words: int, longest: int) -> DataFrame:
    """`block, word, ids`: the words of every block with their ids; each distinct word of all blocks is folded once.

    The first block of a word folds it, and a window hands the ids on to its other blocks.
    """
    found = block_words(rows, pattern, words, longest).repartition(tasks(rows.sparkSession), "word")
    same = Window.partitionBy("word").orderBy("block")
    ids = F.when(F.col("nth") == 1, folded_ids(F.col("word"), path))
    folded = found.withColumn("nth", F.row_number().over(same)).select("block", "word", "nth", ids.alias("ids"))
    handed = F.first("ids", ignorenulls=True).over(same.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return folded.select("block", "word", handed.alias("ids"))


def ids_of_block(folder: str, block: int) -> dict[str, bytes]:
    """The block's words, each with its ids as 32-bit integers."""
    files, root = pafs.FileSystem.from_uri(f"{folder}/block={block}")
    out: dict[str, bytes] = {}
    for found in files.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
        if not found.base_name.endswith(".parquet"):
            continue
        with files.open_input_file(found.path) as f:
            for b in pq.ParquetFile(f).iter_batches(1 << 16, columns=["word", "ids"]):
                ids = b["ids"]
                raw = np.asarray(ids.flatten(), np.int32).tobytes()
                ends = np.concatenate([[0], np.cumsum(ids.value_lengths())]) * 4
                out.update(zip(b["word"].to_pylist(), map(raw.__getitem__, map(slice, ends[:-1].tolist(), ends[1:].tolist())), strict=True))
    return out


# the same merges for a single word


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word by ranked merges; a heap keeps long words from costing the square of their length."""
    return [whole] if (whole := ranks.get(word)) is not None else merged_alone(word, ranks)


def merged_alone(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    if len(word) <= 64:
        pieces = [word[k : k + 1] for k in range(len(word))]
        pairs = [ranks.get(word[k : k + 2], NONE) for k in range(len(word) - 1)]
        while pairs and (low := min(pairs)) != NONE:
            k = pairs.index(low)
            pieces[k : k + 2] = [pieces[k] + pieces[k + 1]]
            del pairs[k]
            if k < len(pairs):
                pairs[k] = ranks.get(pieces[k] + pieces[k + 1], NONE)
            if k:
                pairs[k - 1] = ranks.get(pieces[k - 1] + pieces[k], NONE)
        return [ranks[p] for p in pieces]
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # each piece by its start: its end, and the start of the piece before it
    heap = [(r, k, k + 2) for k in range(n - 1) if (r := ranks.get(word[k : k + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, k, stop = heapq.heappop(heap)
        if end[k] in (-1, n) or end[end[k]] != stop:
            continue  # one of the two has been merged since
        gone = end[k]
        end[k], end[gone] = stop, -1
        if stop < n:
            before[stop] = k
            if (r := ranks.get(word[k : end[stop]])) is not None:
                heapq.heappush(heap, (r, k, end[stop]))
        if before[k] >= 0 and (r := ranks.get(word[before[k] : stop])) is not None:
            heapq.heappush(heap, (r, before[k], stop))
    out, k = [], 0
    while k < n:
        out.append(ranks[word[k : end[k]]])
        k = end[k]
    return out


NONE = 1 << 40


def decoded(ids: Column, path: str) -> Column:
    """Bytes of ids: the tokens' pieces, in hex digits, concatenated."""
    ranks = ranks_of(path)
    pieces: list[str | None] = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token.hex()
    joined = lambda own: F.array_join(F.transform(ids, lambda i: F.get(own, i)), "")
    return F.unhex(let(literal(pieces, "array<string>"), joined, "string"))


def spelled(rows: DataFrame, folder: str, path: str, pattern: str, longest: int) -> DataFrame:
    """`doc_id, ids` of rows in blocks, from the words of their block."""

    def run(batches):
        block, known = None, {}

        def alone(word: str) -> bytes:
            raw = word.encode("utf-8", "replace")
            if len(raw) <= longest:
                raise ValueError(f"a word of block {block} is new: the rows of `docs` changed between two reads")
            return np.array(merge(raw, ranks_of(path)), np.int32).tobytes()

        for b in slices(batches):
            out = []
            for here, text in zip(b["block"].to_pylist(), b["t"].to_pylist(), strict=True):
                if here != block:
                    known = Remembered(alone, {})
                    known.update(ids_of_block(folder, here))
                    block = here
                out.append(b"".join(map(known.__getitem__, pre_tokens(text, pattern))))
            ends = np.concatenate([[0], np.cumsum([len(o) // 4 for o in out])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(out), np.int32)))
            yield pa.RecordBatch.from_arrays([b["doc_id"], ids], ["doc_id", "ids"])

    return rows.mapInArrow(run, rows.select("doc_id", F.lit(None).cast("array<int>").alias("ids")).schema)


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, words: int = 1 << 20, longest: int = 4096, chars: int = 32_000_000, texts: bool = False, files: bool = False) -> DataFrame:
    """`doc_id, n_tokens, ids_sha256, decoded_sha256` per row; with `texts` also `ids` (array<int>) and `decoded` (binary).

    All distinct words are folded by higher-order functions. Only words of more than `longest` bytes, for which a fold of arrays
    costs the square of their length, are merged by the same ranks in the task. `chars` is the size of a block of documents, `words`
    the most that a task holds while it looks for a block's words. With `files`, `docs` is a table as read from files and needs no
    copy; other rows are written first, as both reads must see the same. Null text is empty (no ids); rows that repeat stay.
    """
    path = path or default_path()
    rows = in_blocks(docs if files else cut(docs.select("doc_id", "text"), "texts"), chars)
    folder = f"{shared_folder(docs.sparkSession, 'words')}/table"
    found = folded_words(rows, path, pattern, words, longest).repartition(tasks(docs.sparkSession), "block")
    found.write.option("compression", "zstd").partitionBy("block").parquet(folder)
    own = spelled(rows, folder, path, pattern, longest).select("doc_id", "ids", decoded(F.col("ids"), path).alias("decoded"))
    digits = F.array_join(F.col("ids").cast("array<string>"), " ")
    digests = [F.size("ids").cast("long").alias("n_tokens"), F.sha2(digits.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")]
    return own.select("doc_id", *digests, *["ids", "decoded"][: 2 * texts])
