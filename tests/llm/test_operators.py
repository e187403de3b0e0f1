"""The training-data operators against brute force, round trips and their defined results for odd rows."""

import base64
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
from check import compare, connect
from conftest import DATA
from pyspark.sql import functions as F

from touchline.llm import bpe, components, embeddings, fingerprints, html_text, language, minhash, mixing, queries, shingles, token_counts, token_files, token_words, warc, wavelet
from touchline.llm.common import cut

LONG = "Long words in a row, " * 20_000
ODD = [
    (1, "The same text, and more of the same text.", "en"), (1, "The same text, and more of the same text.", "en"), (2, "", None), (3, None, "en"),
    (4, "   \n\t ", None), (None, "No id here at all, none.", "en"), (None, None, None), (5, LONG, "en"), (6, "日本語 テスト ½ <|endoftext|> don't", None), (7, "12345 !!!", "en"),
]
SCHEMA = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows with extra columns whose names the operators use themselves."""
    docs = spark.createDataFrame(ODD, SCHEMA)
    return docs.withColumns({"t": F.lit(1), "row": F.lit("x"), "n_tokens": F.lit(-1), "rate": F.lit(0), "place": F.lit("p"), "digest": F.lit("d")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, DATA), queries.ORACLES[name], connect(DATA)) is None


def test_components_by_stars(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(40)] + [(2000, 2001 + k) for k in range(50)]
    top = {}

    def find(x):
        while top.get(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        if p != q:
            top[max(p, q)] = min(p, q)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def brute_vectors(rows):
    ids = [i for i, v in rows]
    ok = [v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) and i is not None for i, v in rows]
    unit = [np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) if good else None for (_, v), good in zip(rows, ok, strict=True)]
    links = [[k for k in range(len(rows)) if k != j and ok[j] and ok[k] and unit[j] @ unit[k] >= 0.95] for j in range(len(rows))]
    low = list(ids)
    for _ in rows:
        low = [min([low[j], *(low[k] for k in links[j])]) if ok[j] else ids[j] for j in range(len(rows))]
    return sorted((ids[j], len(links[j]), low[j]) for j in range(len(rows)) if ids[j] is not None)


def test_vectors_with_copies_chains_and_odd_rows(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 16))
    rows = [(k, base[k].astype(np.float32).tolist()) for k in range(40)]
    rows += [(100 + k, (base[3] + 0.05 * k * rng.normal(size=16)).astype(np.float32).tolist()) for k in range(12)]
    rows += [(200 + k, rows[5][1]) for k in range(30)]
    rows += [(300, None), (301, [0.0] * 16), (302, [float("nan")] * 16), (303, [None] * 16), (304, [float("inf")] + [0.0] * 15)]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit("x"))
    got = embeddings.near_vectors(frame, block=8).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute_vectors(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert embeddings.near_vectors(frame.limit(0)).count() == 0
    odd_ids = spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted((r.vec_id or 0, r.n_links, r.kept) for r in embeddings.near_vectors(odd_ids).collect()) == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 0, True)]


def test_vector_recall_on_clusters(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(60, 64))
    rows = [(k, (centres[k % 60] + 0.15 * rng.normal(size=64)).astype(np.float32).tolist()) for k in range(900)]
    got = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    want = sum(n for _, n, _ in brute_vectors(rows))
    found = got.agg(F.sum("n_links")).first()[0]
    assert 0.9 * want <= found <= want


def jaccard_classes(rows):
    sets = [set(shingles.shingle_set(t).tolist()) for _, t in rows]
    low = [i for i, _ in rows]
    for _ in rows:
        for j in range(len(rows)):
            for k in range(len(rows)):
                both = len(sets[j] & sets[k])
                if sets[j] and sets[k] and 100 * both >= 85 * (len(sets[j]) + len(sets[k]) - both):
                    low[j] = min(low[j], low[k])
    return {i: (len(s), c) for (i, _), s, c in zip(rows, sets, low, strict=True)}


def test_minhash_with_chains_copies_and_small_blocks(spark):
    rnd = random.Random(9)
    words = [f"w{k}" for k in range(400)]
    base = [rnd.choice(words) for _ in range(200)]
    rows, now = [], base
    for k in range(25):  # a chain of small edits: neighbours link, the ends do not
        rows.append((k, " ".join(now)))
        now = list(now)
        for _ in range(2):
            now[rnd.randrange(200)] = f"new{k}"
    rows += [(100 + k, " ".join(base)) for k in range(8)] + [(200, "a b"), (201, "A  b"), (202, "a b c"), (203, ""), (204, "x " * 300)]
    got = minhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), block=5, text_block=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == jaccard_classes(rows)


def test_minhash_odd_rows(odd, empty):
    got = sorted(((r.doc_id or 0, r.n_shingles > 0, r.component_id or 0, r.kept) for r in minhash.near_copies(odd).collect()))
    assert len(got) == len(ODD)
    assert got == [(0, False, 0, True), (0, True, 0, True), (1, True, 1, True), (1, True, 1, True), (2, False, 2, True), (3, False, 3, True), (4, False, 4, True), (5, True, 5, True), (6, True, 6, True), (7, True, 7, True)]
    assert minhash.near_copies(empty).count() == 0


def library_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_words.default_path()).encode(text or "", add_special_tokens=False).ids


def test_token_counts(spark, docs, texts, odd, empty):
    words = token_words.words_of(token_words.default_path())
    for r in token_counts.token_counts(docs, limit=100).collect():
        ids = library_ids(texts[r.doc_id])
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (len(ids), len(texts[r.doc_id].encode()), len(ids) > 100)
    for text in ["", " ", "a<|endoftext|>B <|startoftext|>", "日本語 é ΑΣ İx \x01\x1c\x1d a\x85b\xa0c ½²", "don't I'LL x's", "é ﬁ", "x" * 5000]:
        assert words.encode(text) == library_ids(text)
    got = token_counts.token_counts(odd)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got.collect()) == sorted((i or 0, len(library_ids(t))) for i, t, _ in ODD)
    assert token_counts.token_counts(empty).count() == 0


def test_wavelet_matrix():
    import io

    ids = np.random.default_rng(1).integers(0, 49408, 3000).astype(np.uint16)
    ids[::7] = 5
    f = io.BytesIO()
    wavelet.write(f, ids, np.arange(2), np.array([1000, 2000]), {})
    got = wavelet.WaveletFile(f)
    assert (got.ids() == ids).all() and [got.access(k) for k in (0, 1, 1500, 2999)] == [int(ids[k]) for k in (0, 1, 1500, 2999)]
    assert got.count(5) == (ids == 5).sum() and got.count(5, 10, 100) == (ids[10:100] == 5).sum() and got.count(49407 - 1) == (ids == 49406).sum()
    at = np.flatnonzero(ids == 5)
    assert [got.locate(5, k) for k in (0, 3, len(at) - 1)] == [at[0], at[3], at[-1]]
    with pytest.raises(IndexError):
        got.locate(5, len(at))
    with pytest.raises(IndexError):
        got.access(3000)


def test_token_files(spark, docs, texts, odd, empty):
    got = token_files.token_files(docs, shard_tokens=700).orderBy("doc_id").collect()
    start = 0
    for r, doc_id in zip(got, sorted(texts), strict=True):
        ids = [*library_ids(texts[doc_id]), 1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    rows = token_files.token_files(odd, shard_tokens=50).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == sorted((i or 0, len(library_ids(t)) + 1) for i, t, _ in ODD)
    placed = sorted(rows, key=lambda r: r.start)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(placed, placed[1:])) and [r.doc_id is None for r in placed[:2]] == [True, True]
    assert token_files.token_files(empty).count() == 0


def test_main_text():
    page = """<html><body class="has-sidebar"><div id=top><a href=/>Home</a> <a href=/x>About</a></div><div class="cookie-notice">We use cookies</div>
    <div><h2>Title here</h2><p>This is a long <b>para</b>graph of text that goes on &amp; on for a good while, with many words in it.<p>Short.
    <p>Another long   paragraph with plenty of words,\n that says nothing much at all but fills the line.</div>
    <div class="comments"><p>I think this is a great article with many words and long text that a reader wrote in anger.</p></div></body></html>"""
    assert html_text.main_text(page) == (
        "Title here This is a long paragraph of text that goes on & on for a good while, with many words in it. Short. "
        "Another long paragraph with plenty of words, that says nothing much at all but fills the line."
    )
    article = "<nav>a b</nav><article><header><h1>T</h1></header><p>one<aside>zz</aside>two &eacute;<script>var x='</p>'</script><form>f</form></article><article class=comment>cc</article><footer>x"
    assert html_text.main_text(article) == "T one two é"
    assert [html_text.main_text(t) for t in (None, "", "<p>", "<script>x", "just text")] == ["", "", "", "", "just text"]
    assert html_text.main_text("<div>" * 30_000 + "deep") == "deep"
    assert len(html_text.main_text("<article>" + "word " * 200_000)) == 999_999


def test_main_texts_of_the_table(spark):
    import html
    import re

    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    want = {}
    for r in pages.collect():
        inner = re.sub(r"</?(?:br|p|h1)>", " ", re.search(r"(?s)<article>(.*?)</article>", r.html)[1])
        want[r.page_id] = " ".join(html.unescape(re.sub(r"<[^>]+>", "", inner)).split())
    got = html_text.main_texts(pages).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)
    odd = spark.createDataFrame([(None, None, None), (1, "u", ""), (1, "u", "")], "page_id long, url string, html string").withColumn("t", F.lit(1))
    assert [(r.text, r.n_chars) for r in html_text.main_texts(odd).collect()] == [("", 0)] * 3
    assert html_text.main_texts(odd.limit(0)).count() == 0


def test_mixing_meets_targets_and_bounds(spark):
    rnd = random.Random(4)
    words = {"a": [f"a{k}" for k in range(50)], "b": [f"b{k}" for k in range(50)]}
    rows = [(k, " ".join(rnd.choice(words["ab"[k % 5 == 0]]) for _ in range(rnd.randint(20, 60)))) for k in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"t": F.lit(1), "row": F.lit(2), "rate": F.lit(3)})
    labels = spark.createDataFrame([(k, "ab"[k % 5 == 0]) for k in range(0, 400, 3)] + [(None, "a"), (7, None)], "doc_id long, domain string")
    got = mixing.mix(frame, labels, {"a": 0.5, "b": 0.5}).collect()
    assert len(got) == 400 and sum(r.domain == "ab"[r.row.doc_id % 5 == 0] for r in got) > 390
    totals = np.array([np.array(r.posteriors) * r.rate * r.n_tokens for r in got]).sum(axis=0)
    assert abs(totals[0] / totals.sum() - 0.5) < 0.01 and min(r.rate for r in got) >= 0
    held = mixing.mix(frame, labels, {"a": 0.5, "b": 0.5}, lower=1.0).collect()
    assert min(r.rate for r in held) >= 1
    nothing = mixing.mix(frame, labels.limit(0)).collect()
    assert {r.domain for r in nothing} == {"all"} and {r.rate for r in nothing} == {1.0}


def test_mixing_rates_are_least_squares(spark):
    """Against projected gradient by numpy on the same posteriors, where the targets cannot be met."""
    rng = np.random.default_rng(2)
    p = rng.dirichlet([2, 2, 2], 80)
    n = rng.integers(1, 50, 80)
    targets = np.array([0.0, 0.0, 2.0 * n.sum()])
    known = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p, strict=True)], "n_tokens long, posteriors array<double>")
    steps = mixing.fit_rates(known, targets, most_steps=60)
    rates = np.array([r.rate for r in known.withColumn("rate", mixing.rate(steps)).collect()])
    loss = lambda r: ((((r * n) @ p - targets) / n.sum()) ** 2).sum()
    assert loss(rates) < 0.5 * loss(np.ones(80)) and rates.min() >= 0


def test_mixing_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, "x"), (5, "y")], "doc_id long, domain string")
    got = mixing.mix(odd, labels).collect()
    assert len(got) == len(ODD) and all(r.rate >= 0 for r in got) and {r.n_tokens for r in got if not (r.row.text or "").strip()} == {0}
    assert mixing.mix(empty, labels).count() == 0


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(bpe.default_path()), special_tokens={})


def test_byte_bpe(docs, texts, odd, empty, tiktoken_encoding):
    for frame, own in ((docs, texts.items()), (odd, [(i, t) for i, t, _ in ODD])):
        want = []
        for i, t in own:
            ids = tiktoken_encoding.encode_ordinary(t or "")
            want.append((i or 0, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
        got = bpe.encode(frame, words=500).collect()
        assert sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)
    full = bpe.encode(odd, words=10, texts=True).collect()
    assert all(bytes(r.decoded) == dict((i or 0, t) for i, t, _ in ODD if i)[r.doc_id].encode() for r in full if r.doc_id in (1, 5, 6))
    assert bpe.encode(empty).count() == 0


def test_every_distinct_word_is_folded(spark, docs, tiktoken_encoding, tmp_path):
    """All words of all documents, rare and long ones too, reach the fold once and every block gets theirs back."""
    more = [(-1, "rarestwordofall " + "w" * 300 + " it's 日本語"), (-2, None), (None, "")]
    frame = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    rows = cut(bpe.in_blocks(frame, 20_000), "rows")
    want = {(r.block, w) for r in rows.collect() for w in regex.findall(public_tokenizers.PATTERN, r.t)}
    got = bpe.folded_words(rows, bpe.default_path(), public_tokenizers.PATTERN, 100, 4096).collect()
    assert {(r.block, r.word) for r in got} == want and len({b for b, _ in want}) > 3
    assert all(r.ids == tiktoken_encoding._core_bpe.encode_single_piece(r.word.encode()) for r in got)
    # documents are spelled from that table alone
    spark.createDataFrame([(b, w, [7, 8]) for b, w in want], "block long, word string, ids array<int>").write.partitionBy("block").parquet(f"file://{tmp_path}/t")
    ids = bpe.spelled(rows, f"file://{tmp_path}/t", bpe.default_path(), public_tokenizers.PATTERN, 4096).collect()
    assert all(set(r.ids) <= {7, 8} for r in ids) and len(ids) == rows.count()


def test_words_split_as_the_pattern_does():
    own = ["it's 'tis don't 12's x'll'd a 'S", " 'real 've\n\n 3'm", "é'ré ß 'll ½'d", "\u0130's 日本's", "a\u0300's  b", "''s 's's"]
    assert all(bpe.pre_tokens(t, public_tokenizers.PATTERN) == regex.findall(public_tokenizers.PATTERN, t) for t in own)


def test_folds_and_merges_agree_with_the_library(spark, tiktoken_encoding):
    rnd = random.Random(6)
    words = ["".join(rnd.choice("abcdeth inZé語") for _ in range(rnd.randint(1, 14))) for _ in range(150)]
    single = lambda w: tiktoken_encoding._core_bpe.encode_single_piece(w.encode())
    folded = spark.createDataFrame([(w,) for w in words], "w string").select("w", bpe.folded_ids(F.col("w"), bpe.default_path()).alias("ids")).collect()
    assert all(r.ids == single(r.w) for r in folded)
    ranks = bpe.ranks_of(bpe.default_path())
    longer = ["".join(rnd.choice("abcdeth inZ") for _ in range(rnd.randint(60, 500))) for _ in range(60)] + ["a" * 3000, "ab" * 2000]
    assert all(bpe.merge(w.encode(), ranks) == single(w) for w in words + longer)


def test_folds_of_other_rank_files(spark, tiktoken_encoding, tmp_path):
    """Words that merges don't end in are taken whole, equal ranks go from the left, and a byte without a rank may be part of a token."""
    ranks = {bytes([b]): b for b in range(256) if b != ord("z")} | {b"aa": 300, b"ab": 301, b"xyw": 302, b"zz": 303, b"aaaa": 70_000}
    path = tmp_path / "own.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % r for t, r in ranks.items()))
    want = {"aaa": [300, 97], "aaab": [300, 301], "aab": [300, 98], "aaaaa": [70_000, 97], "xyw": [302], "xyww": [120, 121, 119, 119], "zz": [303], "azz": [97, 303], "zzz": [303, None], "é": [195, 169]}
    got = spark.createDataFrame([(w,) for w in want], "w string").select("w", bpe.folded_ids(F.col("w"), str(path)).alias("ids")).collect()
    assert {r.w: r.ids for r in got} == want


def test_a_fold_looks_pairs_up_by_number(spark):
    """A step hashes no digits of pieces and searches no array by `array_position`, which throws an exception to return."""
    own = str(bpe.folded_ids(F.col("w"), bpe.default_path()))
    assert "aggregate" in own and "array_position" not in own and "crc32" not in own


def test_fingerprints(spark, docs, texts):
    order = sorted(texts, reverse=True)
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs, batch=7, spread=5).collect()}
    near = lambda a, b: 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0
    for k, i in enumerate(order):
        t, after = texts[i], texts[order[(k + 1) % len(order)]]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        a, b, c = (set(fingerprints.items(x).tolist()) for x in (t, edited, after))
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r.near_edited - near(a, b)) < 1e-9 and abs(r.near_next - near(a, c)) < 1e-9
    same = {}
    for i, r in got.items():
        assert same.setdefault(texts[i], r.fingerprint) == r.fingerprint


def test_fingerprints_of_odd_rows(spark, odd, empty):
    got = fingerprints.fingerprints(odd, spread=3).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in got) == sorted((i or 0, len(t or "")) for i, t, _ in ODD)
    ones = [r for r in got if r.doc_id == 1]
    assert len(ones) == 2 and ones[0].fingerprint == ones[1].fingerprint and max(r.near_next for r in ones) == 1.0
    assert fingerprints.fingerprints(empty).count() == 0
    alone = fingerprints.fingerprints(odd.filter("doc_id = 5")).first()
    assert alone.near_next == 1.0


def test_sketches_recover_large_differences():
    rng = np.random.default_rng(3)
    keys = rng.integers(1, 1 << 62, 6000).astype(np.uint64)
    sets = [(keys[:3000], keys[2990:]), (keys[:50], keys[:49]), (keys[:0], keys[:5]), (keys, keys)]
    a, b = fingerprints.differing([x for x, _ in sets], [y for _, y in sets])
    assert a.tolist() == [2990, 1, 0, 0] and b.tolist() == [3000, 0, 5, 0]


def test_language_on_the_held_out_fold(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 100 and np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    assert {r.doc_id for r in got} == {i for (i,) in docs.select("doc_id").collect() if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all(0 <= r.score <= 1 for r in got) and sum(r.rejected for r in got) <= 1


def test_language_rejects_noise_and_handles_odd_rows(spark, docs, odd, empty):
    models = language.learn(docs)
    rnd = random.Random(1)
    noise = "".join(rnd.choice("qxzjkvwyñçßüå") for _ in range(600))
    got = language.predictions(spark.createDataFrame([(1, noise), (2, None), (3, "42 !?"), (4, docs.first().text)], "doc_id long, text string"), models).collect()
    assert [r.rejected for r in got] == [True, True, True, False] and [r.lang_pred for r in got[1:3]] == ["und", "und"] and got[1].score == 0
    rows = language.identify(odd).collect()
    assert len(rows) == len(ODD) and {r.lang_pred for r in rows} <= {"en", "und"} and not any(r.held_out for r in rows if r.doc_id is None)
    assert language.identify(empty).count() == 0
    none = language.identify(spark.createDataFrame([(1, "some text", None)], SCHEMA)).first()
    assert none.lang_pred == "und"


def test_kneser_ney_probabilities_sum_to_one(spark, docs):
    models = language.learn(docs, chars=50_000)
    known = models.grams[0]
    for context in ("e t", " th", "xqx"):
        head = 0
        for c in language.codes(context):
            head = head << 16 | int(c)
        mass = np.exp(models.score(np.array([head << 16 | int(c) for c in known], np.uint64)).astype(np.float64)).sum(axis=0)
        assert (mass <= 1.0 + 1e-6).all() and (mass > 0.9).all()


def test_warc_round_trip_with_small_chunks(spark):
    rows = [(3, "http://a b", "<p>é</p>" * 300), (2, None, "<p>é</p>" * 300), (9, "u", "<p>é</p>" * 300), (4, "u", ""), (1, "u", None), (None, "u", "lonely\r\n\r\nWARC/1.1\r\n"), (7, "u", "x\n" * 5000), (7, "u", "x\n" * 5000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"record": F.lit(1), "size": F.lit(2), "first": F.lit(3)})
    got = warc.warc_round_trip(pages, chunk_bytes=100)
    lengths = {i: len((t or "").encode()) for i, _, t in rows}
    digests = {i: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode() for i, _, t in rows}
    kinds = {1: ("response", None), 2: ("response", None), 3: ("revisit", 2), 4: ("revisit", 1), 7: ("response", None), 9: ("revisit", 2), None: ("response", None)}
    want = sorted((i or 0, lengths[i], digests[i], *kinds[i]) for i, _, _ in rows)
    assert sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()) == want
    few = warc.warc_round_trip(pages, least_bytes=5).filter("page_id = 4").first()
    assert few.record_type == "response"
    chunks = warc.chunk_table(pages, chunk_bytes=100).filter("page_id = 3").orderBy("chunk_no").collect()
    assert b"".join(bytes(r.data) for r in chunks).decode() == rows[0][2] and chunks[-1].digest == digests[3] and max(len(r.data) for r in chunks) <= 100
    assert warc.warc_round_trip(pages.limit(0)).count() == 0


def test_mixing_rates_converge_at_a_bound(spark):
    """Rates of 1 at least, a mix of about twice all tokens: the loss of accelerated projected gradient run to its end."""
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.4, 0.15, 0.1], 300)
    n = rng.integers(1, 50, 300)
    have, everything = n @ p, n.sum()
    want = np.array([0.5, 0.3, 0.2])
    targets = (have / want).max() * want
    safe = np.linalg.eigvalsh((p * n[:, None]).T @ p / everything)[-1]
    r = y = np.ones(300)
    pace = 1.0
    for _ in range(20_000):
        new = np.maximum(1.0, y - p @ ((y * n) @ p - targets) / everything / safe)
        after = (1 + (1 + 4 * pace * pace) ** 0.5) / 2
        r, y, pace = new, new + (pace - 1) / after * (new - r), after
    known = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p, strict=True)], "n_tokens long, posteriors array<double>")
    steps = mixing.fit_rates(known, targets, lower=1.0)
    rates = np.array([x.rate for x in known.withColumn("rate", mixing.rate(steps, 1.0)).collect()])
    loss = lambda x: ((((x * n) @ p - targets) / everything) ** 2).sum()
    assert rates.min() >= 1 and loss(rates) <= loss(r) + 1e-5


def test_vectors_of_one_dense_group(spark):
    """All within cosine 0.8 of each other, so that one pivot stands for all; another length has two near copies only."""
    rng = np.random.default_rng(9)
    cone = rng.normal(size=24)
    rows = [(k, (cone + 0.3 * rng.normal(size=24)).astype(np.float32).tolist()) for k in range(60)]
    short = [(100, [1.0, 0.0]), (101, [2.0, 0.0]), (102, [1.0, 0.1])]
    want = sorted(brute_vectors(rows) + brute_vectors(short))
    assert 0 < sum(n for i, n, _ in want if i < 100) < 60 * 59
    got = embeddings.near_vectors(spark.createDataFrame(rows + short, "vec_id long, embedding array<float>"), block=8).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == want


def test_minhash_plan_of_a_threshold():
    """The plan of 85 is the one that the query has; each plan misses a pair at its threshold as rarely as stated."""
    assert minhash.bands_for(85) == (minhash.BANDS, minhash.ROWS) and np.ceil(minhash.least_for(85, 150) * 150) == np.ceil(0.73 * 150)
    for percent in (70, 80, 85, 95):
        bands, rows = minhash.bands_for(percent)
        share, n = percent / 100, bands * rows
        need = int(np.ceil(minhash.least_for(percent, n) * n))
        assert n <= 150 and (1 - share**rows) ** bands <= 1e-5
        assert sum(math.comb(n, k) * share**k * (1 - share) ** (n - k) for k in range(need)) <= 1e-4


def test_minhash_at_another_threshold(spark):
    """Pairs at exactly 0.80 and just below: the signature and the bands follow `percent`."""
    rnd = random.Random(8)
    rows = []
    for k in range(400):
        words = [f"w{rnd.randrange(10**12)}" for _ in range(84)]  # 80 shingles; the copy lacks the last words
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[: 84 - (17 if k % 4 == 3 else 16)]))]
    got = {r.doc_id: r.kept for r in minhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), percent=80).collect()}
    assert got == {i: i % 2 == 0 or i // 2 % 4 == 3 for i in range(800)}


def test_main_text_keeps_all_parts_of_an_article():
    """Without <article>: a second part, short opening lines and a closing list stay; with it, short articles beside a long one."""
    long, short = "Many words that say little in a long line of text. " * 6, "A few words only here."
    parts = f"<div id=story><div>{f'<p>{long}</p>' * 6}</div><div>{f'<p>{long}</p>' * 2}</div></div>"
    menu = "<div><a href=/>Home</a> | <a href=/x>All</a></div>"
    words = lambda *lines: " ".join(" ".join(lines).split())
    assert html_text.main_text(f"<body>{menu}{parts}{menu}<footer>{long}</footer>") == words(long * 8)
    items = [f"Item {k} of the list end" for k in range(6)]
    listed = f"<body>{menu}<div><p>By A. Writer</p><p>{short}</p><p>On a day</p><p>Long ago</p><p>Far away</p>{f'<p>{long}</p>' * 5}<ul>{''.join(f'<li>{x}</li>' for x in items)}</ul></div>"
    assert html_text.main_text(listed) == words("By A. Writer", short, "On a day Long ago Far away", long * 5, *items)
    assert html_text.main_text(f"<article><p>{long * 4}</p></article><article><p>{short}</p></article><article class=comment>{short}</article>") == words(long * 4, short)
