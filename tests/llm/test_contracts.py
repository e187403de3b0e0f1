"""Cases that a contract states and a fast path may miss."""

import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
from conftest import DATA
from pyspark.sql import functions as F

import corpus_pipeline
from touchline.llm import embeddings, fingerprints, html_text, language, token_counts, token_files, token_words
from touchline.llm.common import cut


def library(text):
    return token_words.words_of(token_words.default_path()).library.encode(text, add_special_tokens=False).ids


def test_every_low_character_in_a_word_has_the_librarys_ids():
    path = token_words.default_path()
    words = token_words.words_of(path)
    texts = [f"a{chr(c)}b Word{chr(c)}s {chr(c)}" for c in range(0x300)]
    assert [words.encode(t) for t in texts] == [library(t) for t in texts]
    assert [token_counts.count_text(t, path) for t in texts] == [len(library(t)) for t in texts]


def test_stretches_have_the_librarys_ids():
    rnd = random.Random(11)
    path = token_words.default_path()
    words = token_words.words_of(path)
    pool = "aB1 .'\n\t\x1c\x85\xa0éÉΣσ̸́ﬁ½日İȺ<|>’‍  "
    for _ in range(4000):
        text = "".join(rnd.choice(pool) for _ in range(rnd.randrange(14)))
        assert words.encode(text) == library(text) and token_counts.count_text(text, path) == len(library(text)), repr(text)


def test_a_memory_that_is_too_small_changes_nothing(monkeypatch):
    monkeypatch.setattr(token_words, "CACHE_WORDS", 3)
    words = token_words.Words(token_words.default_path())
    text = "one two three four five one two three four five, six. " * 3
    assert words.encode(text) == library(text) and len(words.stretches) <= 4


def test_numbers_are_no_letters(spark):
    rows = [(k, "Some words of a text that says little.", "en") for k in range(20)] + [(100, "½ ² ①", None), (101, "一二三", None), (102, "12 ٣ Ⅻ", None), (103, "½a", None)]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [(got[k].lang_pred, got[k].score) for k in (100, 102)] == [("und", 0.0)] * 2
    assert got[101].lang_pred == got[103].lang_pred == "en"


def kneser_ney(texts, text):
    """Mean negative log-probability of a text's characters, by interpolated Kneser-Ney over dictionaries.

    Contexts are grams that end in a text's characters; the pad before a text is none.
    """
    order, d = language.ORDER, language.DISCOUNT
    pad = " " * (order - 2)
    top = Counter(g for t in texts for w in [pad + language.letters(t)] for g in (w[k : k + order] for k in range(len(w) - order + 1)))
    counts = {order: top}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    follow = {k: defaultdict(Counter) for k in counts}
    for k, own in counts.items():
        for g, n in own.items():
            follow[k][g[:-1]][g[-1]] += n
    alphabet = max(2, len(counts[1]) + 1)

    def p(head, c):
        if len(head) == 0:
            own = follow[1][""]
            total = sum(own.values())
            return max(0, own[c] - d) / total + d * len(own) / total / alphabet
        below = p(head[1:], c)
        if head not in counts[len(head)]:
            return below
        own = follow[len(head) + 1].get(head, {})
        if not own:
            return below
        total = sum(own.values())
        return max(0, own[c] - d) / total + d * len(own) / total * below

    w = pad + language.letters(text)
    return -sum(math.log(p(w[k : k + order - 1], w[k + order - 1])) for k in range(len(w) - order + 1)) / (len(language.letters(text)) - 1)


def test_entropies_equal_kneser_ney_over_dictionaries(spark):
    texts = {"en": ["the cat sat on the mat", "a cat and a hat that sat"], "de": ["die katze sitzt auf der matte", "der hut und die katze"]}
    rows = [(k, t, lang) for lang, own in texts.items() for k, t in enumerate(own)]
    models = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = ["the katze sat", "zzz quux", "und der hut", "a"]
    got, _ = models.entropies([language.letters(t) for t in asked])
    # a character of any language is known to all, so the alphabets of one language alone are compared where they are the same
    one = {lang: language.learn(spark.createDataFrame([(k, t, lang) for k, t in enumerate(own)], "doc_id long, text string, lang string")) for lang, own in texts.items()}
    for lang, own in texts.items():
        alone, _ = one[lang].entropies([language.letters(t) for t in asked])
        assert np.allclose(alone[:, 0], [kneser_ney(own, t) for t in asked], atol=1e-4)
    assert models.languages == ["de", "en"] and got.argmin(axis=1)[[2]].tolist() == [0]


def test_many_languages_are_all_learned(spark):
    rnd = random.Random(2)
    rows = []
    for k in range(230):
        letters = [chr(0x4E00 + 40 * k + j) for j in range(8)]
        rows += [(10 * k + n, "".join(rnd.choice(letters) for _ in range(40)), f"l{k}") for n in range(4)]
    models = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), chars=100, cells=200_000)
    assert len(models.languages) == 230 and len(models.grams[-1]) * 230 <= 200_000


def test_next_documents_over_many_ranges(spark):
    rows = [(k * 3 % 4001, f"text {k} of some words, and more. " * (k % 3)) for k in range(400)] + [(None, "no id"), (5, "a"), (5, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    few, many = (sorted(map(tuple, fingerprints.fingerprints(docs, spread=n).collect()), key=str) for n in (3, 3000))
    assert few == many
    bounds = sorted((float(x) for x in range(0, 5000, 7)), reverse=True)
    values = spark.range(0, 5200, 3).select("id", fingerprints.bounds_above(F.col("id").cast("double"), bounds).alias("n"))
    assert all(r.n == sum(r.id < b for b in bounds) for r in values.collect())


PROSE = "This is a long sentence of a paragraph with many words in it, and a few more of them. " * 4


def test_names_alone_drop_no_article():
    two = f"<p>{PROSE}</p><p>{PROSE}</p>"
    want = " ".join([PROSE.strip()] * 2)
    for page in (f"<div class='section social science'><article>{two}</article></div>", f"<div id='search-results-explained'>{two}</div>", f"<article><div class='notice-of-claim'><p>{PROSE}</p></div><p>{PROSE}</p></article>"):
        assert html_text.main_text(f"<body>{page}</body>") == want
    cards = f"<article>{two}</article><article><h2><a href=x>Another story here</a></h2></article>"
    assert html_text.main_text(f"<body>{cards}</body>") == want
    inner = f"<article><p>{PROSE}</p><div class=ad>Buy this now.</div><p>{PROSE}</p><div class=comments><p>{PROSE}</p></div></article>"
    assert html_text.main_text(inner) == want
    beside = f"<body><article><a href=x>A card</a></article><div><p>{PROSE}</p><p>{PROSE}</p></div></body>"
    assert html_text.main_text(beside) == want


def test_clusters_choose_the_text(spark, monkeypatch):
    pages = [r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").select("html").collect()]
    before = [html_text.main_text(p) for p in pages]
    other = f"<body><article><p>short teaser of it</p></article><div><p>{PROSE}</p><p>{PROSE}</p><p>{PROSE}</p></div><div><a href=x>More of the same kind</a></div></body>"
    own = html_text.main_text(other)
    monkeypatch.setattr(html_text, "content_lines", lambda lines, *_: np.zeros(len(lines), bool))
    assert all(html_text.main_text(p) != b for p, b in zip(pages, before, strict=True))
    monkeypatch.setattr(html_text, "content_lines", lambda lines, *_: np.array([len(x.text) < 30 and not x.boiler for x in lines]))
    assert sum(html_text.main_text(p) != b for p, b in zip(pages, before, strict=True)) > 0 and html_text.main_text(other) != own


def test_time_grows_with_the_page():
    for page in ("<p>x</p><a ", "<p>x</p><!-- ", "<a ", "<!", "</", "<a b='>\"", "<!-- -->", "<![CDATA[>"):
        times = []
        for size in (20_000, 160_000):
            start = time.perf_counter()
            html_text.main_text("<p>first</p>" + page * (size // len(page)))
            times.append(time.perf_counter() - start)
        assert times[1] < 24 * times[0] + 0.5, (page, times)
    assert html_text.main_text("<p>one<!-- two --> three</p><!-- four <p>five</p>") == "one three five"


def test_vectors_of_seventy_lengths(spark):
    rng = np.random.default_rng(3)
    rows = []
    for length in range(1, 71):
        v = rng.normal(size=length)
        rows += [(1000 * length + k, (v * (k + 1) if k < 2 else -v).tolist()) for k in range(3)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), most_pivots=200).collect()}
    assert got == {1000 * n + k: ((1, 1000 * n) if k < 2 else (0, 1000 * n + 2)) for n in range(1, 71) for k in range(3)}


def test_cosine_is_of_doubles(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 1e-30]), (3, [1e300, 0.0]), (4, [0.0, 1e-300])]
    got = {r.vec_id: r.n_links for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: 2, 2: 2, 3: 2, 4: 0}


def test_stages_take_names_with_dots(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(40).withColumns({"a.b": F.lit(1), "c`d": F.lit(2)})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = cut(stage(spark, docs, DATA), "dots")
        assert out.columns == docs.columns and out.count()


def test_files_are_read_once(spark):
    docs = spark.createDataFrame([(k, "some words " * k) for k in range(60)], "doc_id long, text string")
    plan = token_files.token_files(docs, shard_tokens=40)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and re.search("FileScan parquet", plan)
