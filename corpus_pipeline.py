"""The corpus pipeline: language, near copies, mix, tokens.

Each stage takes all rows its predecessor kept, as Parquet, and all but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import bpe, language, minhash, mixing
from touchline.llm.common import cut, quoted, table
from touchline.llm.queries import WEIGHTS


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those whose characters no model of a language expects, go."""
    models = language.learn(docs.filter(language.fold() != 0))
    return language.predictions(docs, models).filter("not rejected").select("row.*")


def one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays; of rows that repeat an id and its text, one."""
    copies = cut(minhash.near_copies(docs).filter("not kept").select("doc_id"), "copies")
    # merged at every size, as the copies have no bound
    kept = docs.join(copies.hint("merge"), "doc_id", "left_anti").select(*map(quoted, docs.columns))
    return kept.withColumn("__text_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "__text_hash"]).drop("__text_hash")


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; those of domains below their share are repeated by their rate (never below 1)."""
    labels = mixing.quality_domains(table(spark, sf_dir, "labels"))
    got = mixing.mix(docs, labels, WEIGHTS, lower=1.0)
    times = F.greatest(F.lit(1), mixing.repeats(F.coalesce(F.col("row.doc_id"), F.xxhash64("row.text"))))
    return got.withColumn("copy", F.explode(F.sequence(F.lit(1), times))).select("row.*")


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the byte-level BPE per document and their decoding, as counts and digests."""
    return bpe.encode(docs, files=True)


STAGES = [
    ("language", known_language),
    ("near copies", one_of_copies),
    ("mixing", to_weights),
    ("byte-level BPE", to_tokens),
]

#: The stages learn models and use a tokenizer: no SQL states them; the tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
