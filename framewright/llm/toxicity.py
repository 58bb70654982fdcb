"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic examples and unlabelled text train a linear model on hashed words and word
beginnings.  The risk of the negative class is the unlabelled risk less the class prior's share of the
positive examples' risk; where a batch makes it negative, the step goes the other way (Kiryo et al.,
2017).  The unlabelled text is a sample of all documents of the learning folds, labelled or not; negative labels
are never read.  The prior is estimated from positives and unlabelled text (``class_prior``).  The intercept is
the one that the risk leads to, moved so that a score of one half is where rows that a model has not seen are as
likely positive as not (``best_cut``); that too takes positives, unlabelled rows and the prior only.

The fit takes a bounded sample (``positives`` and ``unlabelled`` rows); scoring takes every whole
text.  Null or wordless texts get the score of the model's intercept.  Without any positive example
every score is 0.  Repeated rows get equal scores; an empty table gives none; other columns of the
documents pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm import textkernels as tk
from framewright.llm.columns import fresh
from framewright.llm.training import labelled_sample, unlabelled_sample


@dataclass(frozen=True)
class PUConfig:
    bits: int = 20
    beginnings: tuple[int, ...] = (4, 5, 6)
    least_docs: int = 3
    least_z: float = 4.0
    features: int = 5_000
    positives: int = 6_000
    unlabelled: int = 12_000
    steps: int = 300
    batch: int = 12_000
    rate: float = 0.1
    l2: float = 1e-4
    beta: float = 0.0
    #: Parts that are scored by models of the others; and of the bound on the class prior, the chance that it
    #: fails, and what it gives up for the least error.
    folds: int = 2
    doubt: float = 0.1
    slack: float = 0.01
    seed: int = 11


@dataclass
class LinearModel:
    weights: np.ndarray
    bias: float

    def score(self, offsets: np.ndarray, features: np.ndarray) -> np.ndarray:
        z = np.full(len(offsets) - 1, self.bias)
        np.add.at(z, np.repeat(np.arange(len(z)), np.diff(offsets)), self.weights[features])
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def hashed_features(texts: pa.Array, c: PUConfig, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Per document the distinct hashed words and word beginnings, as (offsets, features)."""
    w = tk.words(texts)
    doc = w.doc()
    parts = [w.hash] + [tk.mix(tk.span_hash(w.data, w.start, np.minimum(w.end, w.start + n)), n) for n in c.beginnings]
    both = np.concatenate(parts) >> np.uint64(64 - c.bits)
    docs = np.tile(doc, len(parts))
    if wanted is not None:
        keep = wanted[both]
        both, docs = both[keep], docs[keep]
    pairs = np.unique((docs.astype(np.uint64) << np.uint64(c.bits)) | both)
    owner = (pairs >> np.uint64(c.bits)).astype(np.int64)
    return np.searchsorted(owner, np.arange(len(texts) + 1)), (pairs & np.uint64((1 << c.bits) - 1)).astype(np.int64)


def _rows(sample: DataFrame, c: PUConfig) -> list[np.ndarray]:
    """The sample's features, one array per document; its size is bounded by the sample's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tk.slices(batches, "text"):
            offsets, found = hashed_features(part.column("text"), c)
            raw = [found[a:b].astype("<u4").tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("y"), pa.array(raw, pa.binary())], names=["y", "features"])

    table = sample.mapInArrow(run, "y double, features binary").toArrow()
    return [np.frombuffer(x, "<u4").astype(np.int64) for x in table.column("features").to_pylist()]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", config: PUConfig = PUConfig()) -> LinearModel:
    """Learn from confirmed positives and unlabelled text of the learning folds; no negative label is read."""
    positive = _rows(labelled_sample(docs, labels.filter(F.col(label) == 1), label, config.positives), config)
    unlabelled = _rows(unlabelled_sample(docs, config.unlabelled), config)
    if len(positive) < config.folds or len(unlabelled) < config.folds:
        return train([], [], 0.0, config)
    prior = class_prior(*crossed(positive, unlabelled, 0.5, config, corrected=False), config)
    cut = best_cut(*crossed(positive, unlabelled, prior, config), prior)
    model = train(positive, unlabelled, prior, config)
    return LinearModel(model.weights, model.bias - cut)


def crossed(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, c: PUConfig, corrected: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """What models give the positive and the unlabelled rows that they have not seen."""
    found: tuple[list[float], list[float]] = ([], [])
    for k in range(c.folds):
        model = train(*([x for i, x in enumerate(rows) if i % c.folds != k] for rows in (positive, unlabelled)), prior, c, corrected)
        for out, rows in zip(found, (positive, unlabelled), strict=True):
            out += [model.bias + model.weights[x].sum() for x in rows[k :: c.folds]]
    return np.array(found[0]), np.array(found[1])


def shares_above(p: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every score that a positive row has, and the shares of positive and of unlabelled rows from it on."""
    cuts = np.unique(p)
    return cuts, *(1 - np.searchsorted(np.sort(x), cuts) / len(x) for x in (p, u))


def class_prior(p: np.ndarray, u: np.ndarray, c: PUConfig) -> float:
    """The share of positives in unlabelled text, from scores of positives and unlabelled text alone.

    The scores tell the one from the other.  Above any score lies a share of the positives and one of the
    unlabelled rows; their quotient bounds the prior from above.  The bound is taken where it, with the error of
    both shares, is least (Garg et al., 2021).
    """
    _, above_p, above_u = shares_above(p, u)
    error = np.sqrt(np.log(4 / c.doubt) / 2) * (1 / np.sqrt(len(p)) + 1 / np.sqrt(len(u)))
    best = np.argmin((above_u + (1 + c.slack) * error) / above_p)
    return float(above_u[best] / above_p[best])


def best_cut(p: np.ndarray, u: np.ndarray, prior: float) -> float:
    """The score from which on a row is likelier positive than not: most true positives less false ones."""
    cuts, above_p, above_u = shares_above(p, u)
    best = int(np.argmax(2 * prior * above_p - above_u))
    below = u[u < cuts[best]]
    return float((cuts[best] + below.max()) / 2) if len(below) else float(cuts[best])


def enriched(positive: list[np.ndarray], unlabelled: list[np.ndarray], c: PUConfig) -> np.ndarray:
    """Features that positives hold far more often than unlabelled text does, the most telling ones."""
    count = np.bincount(np.concatenate(positive), minlength=1 << c.bits)
    share = count / len(positive)
    base = np.bincount(np.concatenate(unlabelled), minlength=1 << c.bits) / len(unlabelled)
    spread = np.sqrt(np.maximum(base * (1 - base), 1 / (4 * len(unlabelled))) / len(positive))
    z = np.where(count >= c.least_docs, (share - base) / spread, 0)
    best = np.argsort(-z, kind="stable")[: c.features]
    return np.sort(best[z[best] >= c.least_z])


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, c: PUConfig, corrected: bool = True) -> LinearModel:
    """Adam on the non-negative risk with the logistic loss over the enriched features; without the correction
    all unlabelled rows count as negative."""
    size = 1 << c.bits
    if not positive or not unlabelled or prior <= 0:
        return LinearModel(np.zeros(size), -40.0)
    prior = min(prior, 0.95)
    kept = enriched(positive, unlabelled, c)
    dense = np.full(size, -1)
    dense[kept] = np.arange(len(kept))
    groups = []
    for docs in (positive, unlabelled):
        narrowed = [(d := dense[x])[d >= 0] for x in docs]
        groups.append((np.concatenate(narrowed), np.cumsum([0, *map(len, narrowed)])))
    rng = np.random.default_rng(c.seed)
    theta = np.zeros(len(kept) + 1)
    theta[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, c.steps + 1):
        grads, risks = [], []
        for features, offsets in groups:
            chosen = rng.permutation(len(offsets) - 1)[: c.batch]
            length = offsets[chosen + 1] - offsets[chosen]
            index = np.repeat(offsets[chosen] - (np.cumsum(length) - length), length) + np.arange(length.sum())
            own, row = features[index], np.repeat(np.arange(len(chosen)), length)
            z = np.bincount(row, theta[own], len(chosen)) + theta[-1]
            p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            as_negative = np.append(np.bincount(own, p[row], len(kept)), p.sum()) / len(chosen)
            as_positive = np.append(np.bincount(own, (p - 1)[row], len(kept)), (p - 1).sum()) / len(chosen)
            grads.append((as_positive, as_negative))
            risks.append(np.logaddexp(0, z).mean())
        if not corrected:
            gradient = prior * grads[0][0] + (1 - prior) * grads[1][1]
        elif risks[1] - prior * risks[0] >= -c.beta:
            gradient = prior * grads[0][0] + grads[1][1] - prior * grads[0][1]
        else:
            gradient = prior * grads[0][1] - grads[1][1]
        gradient[:-1] += c.l2 * theta[:-1]
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient * gradient
        pace = c.rate * (1 - step / (c.steps + 1))
        theta -= pace * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(size)
    weights[kept] = theta[:-1]
    return LinearModel(weights, float(theta[-1]))


def score(docs: DataFrame, model: LinearModel, name: str = "score", text_col: str = "text", config: PUConfig = PUConfig()) -> DataFrame:
    """``docs`` with a double column ``name`` between 0 and 1; raises if they have such a column."""
    if name.lower() in (x.lower() for x in docs.columns):
        raise ValueError(f"the documents have a column {name}")
    plain = fresh(docs.columns, "plain_text")
    out = docs.withColumn(plain, F.col(text_col).cast("string")).withColumn(name, F.lit(None).cast("double"))
    sent = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = sent.value
        own, wanted = LinearModel(weights, bias), weights != 0
        for part in tk.slices(batches, plain):
            got = own.score(*hashed_features(part.column(plain), config, wanted))
            yield part.set_column(part.schema.get_field_index(name), pa.field(name, pa.float64()), pa.array(got))

    return out.mapInArrow(run, out.schema).drop(plain)
