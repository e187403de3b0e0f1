"""Token counts by a whole-token shortcut.

Vocabulary strings that the library's model gives back as one token are found once, before any text is read;
a pre-token among them counts one without merging, and only the rest is merged. Counts of stretches between spaces are
remembered by each worker.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import text_or_empty
from touchline.llm.token_words import Remembered, default_path, words_of

WORD_END = "</w>"


@functools.lru_cache(maxsize=2)
def whole_tokens(path: str) -> frozenset[str]:
    """Words that alone encode as the one token that spells them: each is given to the model and the answer compared."""
    words = words_of(path)
    proven = []
    for token, number in words.library.get_vocab(with_added_tokens=False).items():
        if not token.endswith(WORD_END):
            continue
        spelled = token.removesuffix(WORD_END)
        got = words.library.model.tokenize(spelled) if spelled else []
        if len(got) == 1 and got[0].id == number:
            try:
                proven.append(words.unspell(spelled))
            except (KeyError, UnicodeDecodeError):  # bytes that are no text by themselves are merged as usual
                continue
    return frozenset(proven)


@functools.lru_cache(maxsize=2)
def counts_of(path: str) -> Remembered:
    """Tokens of a stretch without a space or line end: the sum over its pre-tokens, each proven whole or merged."""
    words = words_of(path)
    single = Remembered(lambda word: len(words.merge(word)), dict.fromkeys(whole_tokens(path), 1))
    return Remembered(lambda part: sum(map(single.__getitem__, words.words(part))))


def count_text(text: str, path: str) -> int:
    counts = counts_of(path)
    return sum(1 if isinstance(part, int) else sum(map(counts.__getitem__, part)) for part in words_of(path).parts(text))


def token_counts(docs: DataFrame, text: str = "text", limit: int = 2048, path: str | None = None) -> DataFrame:
    """`doc_id, n_bytes, n_tokens, over_limit` per row.

    Null text counts as empty (0 tokens); repeated rows stay; other columns are dropped. `path` names a
    tokenizers file that every node has. One pass without a shuffle.
    """
    path = path or default_path()

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], b["n_bytes"], pa.array([count_text(t, path) for t in b["t"].to_pylist()], pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    rows = docs.select("doc_id", F.octet_length(text_or_empty(text)).cast("long").alias("n_bytes"), text_or_empty(text).alias("t"))
    out = rows.mapInArrow(run, rows.select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_tokens")).schema)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
