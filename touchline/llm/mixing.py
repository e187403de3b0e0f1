"""Mixing by soft membership: a classifier's domain posteriors and least squares over document rates.

A bounded sample of the labelled table trains a multinomial naive Bayes classifier over hashed words; it gives every document a
posterior over the domains. Nonnegative rates r are fitted so that the expected tokens of domain k, the sum of r * tokens *
posterior_k, meet a target: projected gradient descent whose steps need only K sums over all documents. A document's rate
follows from its posteriors and the K numbers of each step, so no rate is ever gathered and the driver holds steps x K numbers.
"""

from __future__ import annotations

import warnings
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import cut, quoted, slices, text_or_empty
from touchline.llm.shingles import HASHES

FEATURES = 1 << 14
TEMPERATURES = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0)


def features(text: str) -> np.ndarray:
    """Hashed words (A-Z lower-cased, ASCII white space between them)."""
    words = text.encode("utf-8", "replace").lower().split()
    return (np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words)) % np.uint64(FEATURES)).astype(np.int64)


class Classifier:
    """Multinomial naive Bayes with add-one smoothing; log-odds are divided by a temperature fitted on its sample."""

    def __init__(self, domains: list[str], prior: np.ndarray, logs: np.ndarray, temperature: float):
        self.domains, self.prior, self.logs, self.temperature = domains, prior, logs, temperature

    def posteriors(self, words: np.ndarray, temperature: float | None = None) -> np.ndarray:
        score = self.prior + self.logs[words].sum(axis=0) / (temperature or self.temperature)
        out = np.exp(score - score.max())
        return out / out.sum()


def train(docs: DataFrame, labelled: DataFrame, most: int = 20_000) -> Classifier:
    """From `doc_id, domain` rows and their texts: about `most` of them at most, chosen by hash.

    The chosen rows are so few that they may be sent to every task; word counts are summed per batch before they are shuffled.
    """
    rows = labelled.filter("domain is not null").select("doc_id", F.col("domain").cast("string").alias("domain"))
    n = rows.count()
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("mixing")), F.lit(1 << 30))
    chosen = rows.filter(draw < int(min(1.0, most / max(1, n)) * (1 << 30)))
    sample = cut(docs.select("doc_id", text_or_empty().alias("t")).join(F.broadcast(cut(chosen, "labels")), "doc_id").select("domain", "t"), "mixing-sample")
    sizes = {r.domain: r["count"] for r in sample.groupBy("domain").count().collect()}
    if not sizes:
        return Classifier(["all"], np.zeros(1), np.zeros((FEATURES, 1)), 1.0)

    def run(batches):
        for b in batches:
            by: dict[str, list[np.ndarray]] = {}
            for domain, text in zip(b["domain"].to_pylist(), b["t"].to_pylist(), strict=True):
                by.setdefault(domain, []).append(features(text))
            for domain, got in by.items():
                counts = np.bincount(np.concatenate(got), minlength=FEATURES)
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([domain] * len(at), pa.string()), pa.array(at), pa.array(counts[at])], ["domain", "feature", "n"])

    counts = sample.mapInArrow(run, "domain string, feature long, n long").groupBy("domain", "feature").agg(F.sum("n").alias("n")).toArrow()
    domains = sorted(sizes)
    table = np.ones((FEATURES, len(domains)))
    columns = np.searchsorted(np.array(domains, object), counts["domain"].to_numpy())
    np.add.at(table, (counts["feature"].to_numpy(), columns), counts["n"].to_numpy())
    logs = np.log(table / table.sum(axis=0))
    prior = np.log([sizes[d] / sum(sizes.values()) for d in domains])
    trial = Classifier(domains, prior, logs, 1.0)

    def losses(batches):
        for b in batches:
            total = np.zeros(len(TEMPERATURES))
            for domain, text in zip(b["domain"].to_pylist(), b["t"].to_pylist(), strict=True):
                words = features(text)
                total -= [np.log(max(1e-12, trial.posteriors(words, x)[domains.index(domain)])) for x in TEMPERATURES]
            yield pa.RecordBatch.from_arrays([pa.array(TEMPERATURES), pa.array(total)], ["temperature", "loss"])

    # a text's words are no independent witnesses: the temperature under which the sample's labels are likeliest
    fitted = sample.mapInArrow(losses, "temperature double, loss double").groupBy("temperature").agg(F.sum("loss").alias("loss")).collect()
    return Classifier(domains, prior, logs, min((r.loss, r.temperature) for r in fitted)[1])


def posteriors(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """`row` (a struct of all columns), `n_tokens` (words) and `posteriors` (array, in the order of the classifier's domains)."""

    def run(batches):
        for b in slices(batches):
            words = [features(t or "") for t in b["row"].field("text").to_pylist()]
            got = [classifier.posteriors(w).tolist() for w in words]
            yield pa.RecordBatch.from_arrays([b["row"], pa.array([len(w) for w in words], pa.int64()), pa.array(got, pa.list_(pa.float64()))], ["row", "n_tokens", "posteriors"])

    rows = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"))
    schema = rows.select("row", F.lit(0).cast("long").alias("n_tokens"), F.lit(None).cast("array<double>").alias("posteriors")).schema
    return rows.mapInArrow(run, schema)


def rate(steps: list[list[float]], lower: float = 0.0, p: str = "posteriors") -> Column:
    """The rate after projected steps r <- max(lower, r - sum_k g_k p_k) from 1."""
    if not steps:
        return F.lit(max(1.0, lower))
    moves = F.array(*(F.array(*map(F.lit, g)) for g in steps))
    dot = lambda g: F.aggregate(F.zip_with(g, F.col(p), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(moves, F.lit(1.0), lambda r, g: F.greatest(F.lit(lower), r - dot(g)))


def fit_rates(known: DataFrame, targets: np.ndarray, lower: float = 0.0, most_steps: int = 40, tolerance: float = 1e-4) -> list[list[float]]:
    """Steps of the projected gradient from rates of 1, by a row `n_tokens, posteriors` per document.

    The loss is half the sum of ((total_k - target_k) / tokens)^2. Its gradient, seen through a document's posteriors, moves the
    rate; it is scaled by the inverse of the damped second moments of the posteriors whose rates are above the bound, so that a step
    that moves only these meets the targets. A step that makes the loss larger is taken back and damped more, at most to the length of
    a safe plain gradient. It ends when no total is further from its target than `tolerance` of all tokens, or, where the targets can't be met
    with rates above the bound, when three steps no longer lower the loss. Where they still do so
    after `most_steps`, a warning names the distance that is left.
    """
    k = len(targets)
    t = F.col("n_tokens").cast("double")
    at = lambda i: F.get("posteriors", F.lit(i))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    moments = lambda of: [F.sum(of * at(i) * at(j)).alias(f"m{i}_{j}") for i, j in pairs]
    square = lambda r: np.array([[r[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) / everything
    first = known.agg(F.sum(t).alias("all"), *moments(t)).first()
    everything = first["all"] or 0.0
    if not everything:
        return []
    free = square(first)
    least, safe = 1e-4 * np.trace(free), max(1e-12, np.linalg.eigvalsh(free)[-1])
    damping = least
    steps: list[list[float]] = []
    best, error, stuck = np.inf, np.zeros(k), 0
    for _ in range(most_steps):
        above = F.when(F.col("rate") > lower, t).otherwise(0.0) if steps else t
        got = known.withColumn("rate", rate(steps, lower)).agg(*(F.sum(F.col("rate") * t * at(i)).alias(f"s{i}") for i in range(k)), *moments(above)).first()
        now = (np.array([got[f"s{i}"] for i in range(k)]) - targets) / everything
        loss = float(now @ now)
        if loss > best:
            steps.pop()
            damping = min(4 * damping, safe)
        else:
            stuck = stuck + 1 if loss > 0.999 * best else 0
            best, error, free = loss, now, square(got)
            damping = max(damping / 4, least)
        if np.abs(error).max() <= tolerance or stuck >= 3:
            return steps
        steps.append(np.linalg.solve(free + damping * np.eye(k), error).tolist())
    warnings.warn(f"after {most_steps} steps a total is still {np.abs(error).max():.2e} of all tokens from its target", stacklevel=2)
    return steps[:-1]  # the last step has not been judged


def fit_mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float] | None = None, lower: float = 0.0, least: float = 1.0, most: int = 20_000) -> tuple[Classifier, list[list[float]]]:
    """The classifier and the steps that give every document its rate."""
    classifier = train(docs, labelled, most)
    domains = classifier.domains
    known = cut(posteriors(docs.select("text"), classifier).drop("row"), "posteriors")
    now = known.agg(*(F.sum(F.col("n_tokens") * F.get("posteriors", F.lit(i))).alias(f"s{i}") for i in range(len(domains)))).first()
    have = np.array([now[f"s{i}"] or 0.0 for i in range(len(domains))])
    want = np.array([(weights or {}).get(d, 0.0 if weights else 1.0) for d in domains], float)
    want = want / want.sum() if want.sum() else np.ones(len(domains)) / len(domains)
    size = max((least * h / w for h, w in zip(have, want, strict=True) if w > 0 and h > 0), default=0.0)
    return classifier, fit_rates(known, size * want, lower)


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float] | None = None, lower: float = 0.0, least: float = 1.0, most: int = 20_000) -> DataFrame:
    """`row` (a struct of all columns), `n_tokens, posteriors, domain, rate` per document.

    `labelled` has `doc_id, domain`. `weights` are the domains' shares of the mixed tokens (equal ones if not given; domains without
    a weight count as 0, unknown ones are ignored). The mix is the smallest in which every domain keeps `least` times its tokens;
    no rate falls below `lower`. Null text is empty: no tokens, the prior's posteriors. Without labels there is one domain.
    """
    classifier, steps = fit_mix(docs, labelled, weights, lower, least, most)
    best = F.get(F.array(*map(F.lit, classifier.domains)), (F.array_position("posteriors", F.array_max("posteriors")) - 1).cast("int"))
    return posteriors(docs, classifier).withColumns({"domain": best, "rate": rate(steps, lower)})


def repeats(number: Column) -> Column:
    """Whole copies of a row with column `rate`: its integer part, and one more with the chance of the rest, drawn from the number's hash."""
    draw = F.pmod(F.xxhash64(number, F.lit("copies")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor(F.col("rate") + draw).cast("int")


def quality_domains(labels: DataFrame) -> DataFrame:
    """`doc_id, domain` from the quality table: toxic, else high or low."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), domain.alias("domain"))
