"""Language identification by interpolated Kneser-Ney character models.

Texts are lower-cased and every stretch of other characters than letters becomes one space. A gram of up to four
characters is packed into one 64-bit number (16 bits a character), so a model is a few sorted arrays of numbers with a row of
log-probabilities, one a language; a lookup is a binary search. The prediction is the language with the lowest
cross-entropy per character; one above the level that training texts reach is rejected.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import cut, quoted, slices, text_or_empty

ORDER = 4
DISCOUNT = 0.75
NOT_LETTERS = re.compile(r"[\W\d_]+")
#: Numbers such as U+00BD count as word characters for `re`, though they are no letters. Apart, and of the first
#: plane alone, as such a set is fast.
NUMBERS = re.compile("[" + "".join(c for c in map(chr, range(0x10000)) if c.isalnum() and not c.isalpha() and not c.isdecimal()) + "]")
UNKNOWN = "und"


def letters(text: str) -> str:
    """' word word ' in lower case, empty without a letter."""
    words = NOT_LETTERS.sub(" ", text.lower()).strip()
    if not words.isascii():
        if max(words) > "\uffff":
            words = "".join(c if c.isalpha() else " " for c in words)
        words = " ".join(NUMBERS.sub(" ", words).split())
    return f" {words} " if words else ""


def codes(text: str) -> np.ndarray:
    """16-bit codes: the low 16 bits of each code point (planes beyond the first fold onto it)."""
    return (np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32) & 0xFFFF).astype(np.uint64)


def packed(c: np.ndarray, order: int) -> np.ndarray:
    """Grams of `order` codes ending at each place from order - 1 on; 1 is added to the top so that lengths differ."""
    n = len(c) - order + 1
    out = np.zeros(max(0, n), np.uint64)
    for k in range(order):
        out = (out << np.uint64(16)) | c[k : k + n] if n > 0 else out
    return out


def gram_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """`lang, gram, n` of the highest order over all given texts: partial counts per batch meet before the shuffle."""

    def run(batches):
        for b in batches:
            by: dict[str, list[str]] = {}
            for lang, text in zip(b["lang"].to_pylist(), b["t"].to_pylist(), strict=True):
                if clean := letters(text):
                    by.setdefault(lang, []).append(" " * (order - 2) + clean)
            for lang, texts in by.items():
                grams, n = np.unique(np.concatenate([packed(codes(t), order) for t in texts]), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"]
                )

    rows = docs.select(F.col("lang").cast("string").alias("lang"), text_or_empty().alias("t"))
    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Models:
    """Sorted grams of each order 1..ORDER with log-probabilities (rows by gram, columns by language) and log back-off weights."""

    languages: list[str]
    grams: list[np.ndarray]
    logs: list[np.ndarray]
    backs: list[np.ndarray]
    floor: float
    #: By language: cross-entropy above which a text is rejected, set by `calibrate`.
    levels: np.ndarray

    def find(self, order: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = self.grams[order - 1]
        if not len(own):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
        return at, own[at] == keys

    def score(self, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Log-probability of each gram's last character after the others, by language."""
        if order == 0:
            return np.full((len(keys), len(self.languages)), self.floor, np.float32)
        at, known = self.find(order, keys)
        out = self.logs[order - 1][at] if len(self.grams[order - 1]) else np.zeros((len(keys), len(self.languages)), np.float32)
        rest = np.flatnonzero(~known)
        if len(rest):
            below = self.score(keys[rest] & np.uint64((1 << 16 * (order - 1)) - 1), order - 1)
            if order > 1:
                where, seen = self.find(order - 1, keys[rest] >> np.uint64(16))
                below = below + np.where(seen[:, None], self.backs[order - 2][where], 0)
            else:
                below = below + self.backs[-1]
            out[rest] = below
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character by text and language, and characters, of texts as `letters` gives them.

        Texts are scored together in stretches of about 260,000 characters.
        """
        sums = np.zeros((len(texts), len(self.languages)))
        sizes = np.array([max(0, len(t) - 1) for t in texts], np.int64)
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + sizes[end] < 1 << 18):
                size += sizes[end]
                end += 1
            if end == at + 1 and size > 1 << 19:
                c = codes(" " * (ORDER - 2) + texts[at])
                for k in range(0, len(c) - ORDER + 1, 1 << 18):
                    sums[at] += self.score(packed(c[k : k + (1 << 18) + ORDER - 1], ORDER)).sum(axis=0, dtype=np.float64)
            else:
                keys = [packed(codes(" " * (ORDER - 2) + t), ORDER) if t else np.zeros(0, np.uint64) for t in texts[at:end]]
                got = self.score(np.concatenate(keys)) if size else np.zeros((0, len(self.languages)), np.float32)
                ends = np.cumsum([len(k) for k in keys])
                total = np.vstack([np.zeros(len(self.languages)), np.cumsum(got, axis=0, dtype=np.float64)])
                sums[at:end] = total[ends] - total[ends - [len(k) for k in keys]]
            at = end
        return -sums / np.maximum(1, sizes)[:, None], sizes


def kneser_ney(counts: pa.Table, languages: list[str]) -> Models:
    """Models from the counts (`lang, gram, n`) of the highest order; lower orders count in how many longer grams a gram ends."""
    of = counts["lang"].to_numpy()
    gram, number = counts["gram"].to_numpy(), counts["n"].to_numpy()
    by_order: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(ORDER)]
    for lang in languages:
        grams, n = gram[of == lang].astype(np.uint64), number[of == lang].astype(np.float64)
        order = np.argsort(grams)
        grams, n = grams[order], n[order]
        by_order[ORDER - 1].append((grams, n))
        for k in range(ORDER - 1, 0, -1):
            grams, n = np.unique(grams & np.uint64((1 << 16 * k) - 1), return_counts=True)
            n = n.astype(np.float64)
            by_order[k - 1].append((grams, n))
    known = [np.unique(np.concatenate([g for g, _ in level])) if level else np.zeros(0, np.uint64) for level in by_order]
    letters_known = max(2, len(known[0]) + 1)
    floor = -float(np.log(letters_known))
    logs, backs = [], []
    below = None
    for k in range(1, ORDER + 1):
        level = known[k - 1]
        table = np.zeros((len(level), len(languages)))
        contexts = known[k - 2] if k > 1 else np.zeros(1, np.uint64)
        back = np.zeros((len(contexts), len(languages)))
        for m, (grams, n) in enumerate(by_order[k - 1]):
            heads = grams >> np.uint64(16)
            spot = np.searchsorted(contexts, heads)
            spot = np.minimum(spot, len(contexts) - 1)
            ok = contexts[spot] == heads
            total = np.bincount(spot[ok], weights=n[ok], minlength=len(contexts))
            kinds = np.bincount(spot[ok], minlength=len(contexts))
            back[:, m] = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
            at = np.searchsorted(contexts, level >> np.uint64(16))
            at = np.minimum(at, len(contexts) - 1)
            at_ok = contexts[at] == level >> np.uint64(16)
            weight = np.where(at_ok, back[at, m], 1.0)
            if k == 1:
                lower = np.full(len(level), np.exp(floor))
            else:
                low = np.searchsorted(known[k - 2], level & np.uint64((1 << 16 * (k - 1)) - 1))
                lower = below[np.minimum(low, len(known[k - 2]) - 1), m]
            part = np.zeros(len(level))
            place = np.searchsorted(level, grams)
            part[place] = np.where(ok, np.maximum(0, n - DISCOUNT) / np.maximum(total[spot], 1), 0)
            table[:, m] = part + weight * lower
        logs.append(np.log(np.maximum(table, 1e-12)).astype(np.float32))
        backs.append(np.log(np.maximum(back, 1e-12)).astype(np.float32))
        below = table
    # backs[k] belongs to contexts of k + 1 characters; that of the empty context stands last
    backs = [*backs[1:], backs[0]]
    return Models(languages, known, logs, backs, floor, np.full(len(languages), np.inf))


def learn(labelled: DataFrame, chars: int = 6_000_000, cells: int = 1 << 27, spread: float = 1.5) -> Models:
    """Models from about `chars` characters a language (all texts of a language with fewer), whole texts chosen by hash.

    Every language is learned. The models have a column a language and a row a distinct gram; where the sample would make more than
    `cells` numbers of them, as with hundreds of languages, all languages get half as many characters, until it fits. So the models are
    bounded and may be sent to every task. The rejection level is fitted on the same texts: the 0.999 quantile of their
    cross-entropies, times `spread`. Repeated rows count as often as they stand.
    """
    rows = labelled.filter("lang is not null and text is not null").select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.sum(F.length("text")).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Models([], [np.zeros(0, np.uint64)] * ORDER, [], [], 0.0, np.zeros(0))
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("language")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    while True:
        shares = F.map_from_arrays(F.lit(languages), F.lit([min(1.0, chars / max(1, sizes[lang])) for lang in languages]))
        sample = cut(rows.filter(draw < F.element_at(shares, F.col("lang"))), "language-sample")
        counts = cut(gram_counts(sample), "language-grams")
        if chars < 2 or len(languages) * counts.agg(F.count_distinct("gram")).first()[0] <= cells:
            break
        chars //= 2
    models = kneser_ney(counts.toArrow(), languages)
    quantiles = predictions(sample, models).groupBy("lang_pred").agg(F.percentile_approx("entropy", 0.999, 10000).alias("q")).collect()
    for r in quantiles:
        if r.lang_pred in languages and r.q is not None:
            models.levels[languages.index(r.lang_pred)] = r.q * spread
    return models


def predictions(docs: DataFrame, models: Models) -> DataFrame:
    """`row` (a struct of all columns), `lang_pred, score, entropy, rejected` per row, from the text alone.

    `score` is the posterior of the best language when each text counts as at most 40 characters. Without text,
    letters or languages the answer is `und`, score 0, rejected. Very short texts are rejected only far above the level. Of languages
    that tie, the first by name is the answer. Repeated rows each get theirs. Very long texts are scored in stretches of 260,000
    characters. Column names may be any, dots included, as they stay inside `row`.
    """
    languages = models.languages
    rows = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"))

    def run(batches):
        for b in slices(batches):
            texts = [letters(t or "") for t in b["row"].field("text").to_pylist()]
            if languages:
                bits, sizes = models.entropies(texts)
                best = bits.argmin(axis=1)
                low = bits[np.arange(len(texts)), best]
                scores = 1 / np.exp((low[:, None] - bits) * np.minimum(sizes, 40)[:, None]).sum(axis=1)
                out = (sizes > 0) & (low > models.levels[best] + 3 / np.sqrt(np.maximum(1, sizes)))
                none = sizes == 0
                names = [UNKNOWN if no else languages[k] for k, no in zip(best, none, strict=True)]
                scores, low, out = np.where(none, 0.0, scores), np.where(none, np.nan, low), out | none
            else:
                names, scores, low, out = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan), np.ones(len(texts), bool)
            yield pa.RecordBatch.from_arrays(
                [b["row"], pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(low, pa.float64(), from_pandas=True), pa.array(out, pa.bool_())],
                ["row", "lang_pred", "score", "entropy", "rejected"],
            )

    nothing = F.lit(None)
    schema = rows.select("row", nothing.cast("string").alias("lang_pred"), nothing.cast("double").alias("score"), nothing.cast("double").alias("entropy"), nothing.cast("boolean").alias("rejected")).schema
    return rows.mapInArrow(run, schema)


def fold(of: str = "doc_id"):
    """crc32 of the id as text, modulo 5; 0 is held out."""
    return F.crc32(F.col(of).cast("string").cast("binary")) % 5


def identify(docs: DataFrame, **settings) -> DataFrame:
    """Learn from labelled documents outside the held-out fold, predict all: `doc_id, held_out, lang_pred, score, entropy, rejected`.

    A null id is in no fold: it is neither learned from nor held out (false).
    """
    models = learn(docs.filter(fold() != 0), **settings)
    got = predictions(docs.select("doc_id", "text"), models).withColumn("doc_id", F.col("row.doc_id"))
    return got.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "entropy", "rejected")
