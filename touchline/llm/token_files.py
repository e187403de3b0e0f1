"""Documents as token ids in wavelet-matrix files, in document order, and their reading.

Writing: one range shuffle of the texts by document id; each task streams its sorted rows, encodes them and closes
a file after `shard_tokens` ids, so a task holds one shard's ids however many documents or how long a document
it gets. A document may go on in the next file of its task; the reader joins its checksums.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import wavelet
from touchline.llm.common import cut, open_in, open_out, per_file, shared_folder, task_file, tasks, text_or_empty
from touchline.llm.token_words import default_path, words_of

FILES = "part int, shard int, path string, n_tokens long"


def write_token_files(docs: DataFrame, folder: str, end_id: int = 1, shard_tokens: int = 1 << 24, path: str | None = None) -> list:
    """Rows `part, shard, path, n_tokens` of the files, one a file, in document order.

    Null texts are empty (the end id alone), null ids come first, rows with equal ids stand by their text's hash.
    """
    path = path or default_path()

    def run(batches):
        words, part, shard = words_of(path), TaskContext.get().partitionId(), 0
        ids, doc_ids, lengths, room = [], [], [], shard_tokens
        done, ordinal = [], 0

        def close():
            nonlocal ids, doc_ids, lengths, room, shard
            uri = task_file(folder, shard, "twm")
            tokens = np.concatenate(ids)
            head = {"part": part, "shard": shard, "first": first, "nulls": [k for k, d in enumerate(doc_ids) if d is None]}
            with open_out(uri) as out:
                wavelet.write(out, tokens, np.array([d or 0 for d in doc_ids], np.int64), np.array(lengths, np.int64), head, 8 * tokens.itemsize)
            done.append((part, shard, uri, len(tokens)))
            shard += 1
            ids, doc_ids, lengths, room = [], [], [], shard_tokens

        first = 0
        for b in batches:
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["t"].to_pylist(), strict=True):
                own = np.append(words.id_array(text), words.kind(end_id))
                while True:
                    piece, own = own[:room], own[room:]
                    if not doc_ids:
                        first = ordinal
                    ids.append(piece)
                    doc_ids.append(doc_id)
                    lengths.append(len(piece))
                    room -= len(piece)
                    if not room:
                        close()
                    if not len(own):
                        break
                ordinal += 1
        if doc_ids:
            close()
        columns = list(zip(*done, strict=True)) if done else [[], [], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.int64())],
            ["part", "shard", "path", "n_tokens"],
        )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("t"))
    placed = rows.repartitionByRange(tasks(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", F.xxhash64("t"))
    return sorted(placed.mapInArrow(run, FILES).collect(), key=lambda r: (r.part, r.shard))


def read_token_files(spark: SparkSession, files: list) -> DataFrame:
    """`doc_id, start, n_tokens, ids_crc32` of every document in the files, which are given in document order."""
    start, rows = 0, []
    for f in files:
        rows.append((f.path, start))
        start += f.n_tokens

    def run(batches):
        for b in batches:
            for uri, at in zip(b["path"].to_pylist(), b["start"].to_pylist(), strict=True):
                with open_in(uri) as file:
                    shard = wavelet.WaveletFile(file)
                    ids, (doc_ids, lengths) = shard.ids(), shard.documents()
                ends = np.cumsum(lengths)
                wide = ids.astype("<u4")
                sums = [zlib.crc32(wide[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                last = len(lengths) - 1
                n = len(lengths)
                head = shard.head
                nulls = set(head["nulls"])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([head["part"]] * n, pa.int32()), pa.array([head["shard"]] * n, pa.int32()),
                        pa.array(np.arange(n) + head["first"], pa.int64()),
                        pa.array([None if k in nulls else d for k, d in enumerate(doc_ids.tolist())], pa.int64()),
                        pa.array(at + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64()),
                        pa.array([k in (0, last) for k in range(n)], pa.bool_()),
                    ],
                    ["part", "shard", "ordinal", "doc_id", "start", "n_tokens", "ids_crc32", "edge"],
                )

    # written, so that every file is opened once
    pieces = cut(per_file(spark, rows, "path string, start long").mapInArrow(
        run, "part int, shard int, ordinal long, doc_id long, start long, n_tokens long, ids_crc32 long, edge boolean"
    ), "pieces")
    joined = F.udf(join_checksums, "long")
    # only the first and the last document of a file can go on in another one
    edges = (
        pieces.filter("edge").groupBy("part", "ordinal")
        .agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n_tokens").alias("n"), F.sort_array(F.collect_list(F.struct("shard", "ids_crc32", "n_tokens"))).alias("own"))
        .select("doc_id", "start", F.col("n").alias("n_tokens"), F.when(F.size("own") == 1, F.col("own")[0]["ids_crc32"]).otherwise(joined("own")).alias("ids_crc32"))
    )
    return pieces.filter("not edge").select("doc_id", "start", "n_tokens", "ids_crc32").unionByName(edges)


def join_checksums(pieces) -> int:
    """CRC-32 of the pieces' bytes in a row, from each piece's own CRC-32 and ids (four bytes each)."""
    total = 0
    for _, crc, n in pieces:
        total = crc_of_zeros(total, 4 * n) ^ crc
    return total


def crc_of_zeros(crc: int, n: int) -> int:
    """What n zero bytes add to a checksum's own part, by squaring the one-bit step over GF(2)."""
    def times(matrix, vector):
        out, k = 0, 0
        while vector:
            if vector & 1:
                out ^= matrix[k]
            vector >>= 1
            k += 1
        return out

    step = [0xEDB88320] + [1 << k for k in range(31)]  # one zero bit
    bits = 8 * n
    while bits:
        if bits & 1:
            crc = times(step, crc)
        step = [times(step, row) for row in step]
        bits >>= 1
    return crc


def token_files(docs: DataFrame, **settings) -> DataFrame:
    spark = docs.sparkSession
    return read_token_files(spark, write_token_files(docs, shared_folder(spark, "tokens"), **settings))
