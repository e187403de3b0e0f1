"""The pipeline's stages, each judged on its own input."""

import hashlib
import random

import corpus_pipeline
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from touchline.llm import language
from touchline.llm.common import cut
from touchline.llm.queries import WEIGHTS


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(cut(stage(spark, out[-1], DATA), "stage"))
    return out


def test_stages_keep_the_columns_and_take_effect(stages):
    docs, known, single, mixed, tokens = stages
    assert all(s.columns == docs.columns for s in (known, single, mixed))
    ids = lambda s: [r.doc_id for r in s.select("doc_id").collect()]
    rejected = {r.doc_id for r in language.identify(docs).filter("rejected").collect()}
    assert set(ids(known)) == set(ids(docs)) - rejected and len(ids(known)) >= 0.98 * len(ids(docs))
    assert len(ids(single)) == len(set(ids(single))) and set(ids(single)) <= set(ids(known))
    assert set(ids(mixed)) == set(ids(single)) and len(ids(mixed)) >= len(ids(single))
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert sorted((r.doc_id, r.decoded_sha256) for r in tokens.collect()) == sorted((i, hashlib.sha256(texts[i].encode()).hexdigest()) for i in ids(mixed))


def test_one_of_each_group_by_brute_force(stages):
    _, known, single, *_ = stages
    rows = {}
    for r in known.collect():
        words = r.text.encode().lower().split()
        rows[r.doc_id] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    low = {i: i for i in rows}
    links = [(a, b) for a in rows for b in rows if a < b and rows[a] and rows[b] and 100 * (n := len(rows[a] & rows[b])) >= 85 * (len(rows[a]) + len(rows[b]) - n)]
    for _ in links:
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    assert {r.doc_id for r in single.collect()} == {i for i, c in low.items() if i == c}


def test_run_equals_its_stages(spark, stages):
    assert corpus_pipeline.run(spark, DATA).exceptAll(stages[-1]).count() == 0


def test_stages_take_odd_and_empty_tables(spark, stages):
    docs = stages[0]
    odd = docs.limit(30).union(docs.limit(2)).union(spark.createDataFrame([(None, None, None, None, None), (None, docs.first().text, "en", None, 3), (999, "", None, None, 0)], docs.schema))
    odd = odd.withColumns({"t": F.lit(1), "row": F.lit("r"), "rate": F.lit(1.5)})
    now = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = cut(stage(spark, now, DATA), "odd")
        assert now.columns == odd.columns
    assert now.filter("doc_id is null").count() >= 1 and now.filter("doc_id = 999").count() == 0
    nothing = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        nothing = stage(spark, nothing, DATA)
        assert nothing.count() == 0
        if nothing.columns != docs.columns:
            break


def test_mix_meets_the_weights_where_it_must_grow(spark, tmp_path):
    """Three tenths of the tokens are of a domain whose weight is 0.12: the mix is about 2.5 times its input."""
    rnd = random.Random(6)
    kinds = ["high"] * 6 + ["low"] * 3 + ["toxic"]
    rows = [(k, " ".join(f"{kinds[k % 10]}{rnd.randrange(40)}" for _ in range(50))) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = [(k, int(kinds[k % 10] == "high"), int(kinds[k % 10] == "toxic")) for k in range(0, 600, 3)]
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.to_weights(spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == set(range(600))
    shares = {d: sum(kinds[r.doc_id % 10] == d for r in got) / len(got) for d in WEIGHTS}
    assert all(abs(shares[d] - w) < 0.02 for d, w in WEIGHTS.items()), shares
