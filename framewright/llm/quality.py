"""Quality scores by Bradley-Terry pairwise ranking.

Labelled rows give preference pairs: every good document over every poor one.  A document's strength is
linear in the indicator bins of its style figures; the weights minimise the logistic loss of the
difference between the two documents of a pair.  The cut is a quantile of the learning rows'
strengths: the share of poor rows among them.  Scores are a logistic curve through ``cut_score`` at
the cut, its slope fitted on the same rows.

The fit takes all labelled rows and all their pairs, and scoring every whole text.  Weights are whole
multiples of a unit, so strengths lie on a grid: how many good and poor rows have each strength says all
about the pairs, whose number is never met.  Rows stay with Spark as bins of one byte; each step of the
descent asks for counts by strength, and for whole sums by bin, which no order of rows changes.

Null or empty texts have all figures 0 and are scored like any other.  Without
rows of both kinds every score is 1.  Repeated rows get equal scores; an empty table gives none;
other columns of the documents pass through.
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
from framewright.llm.scratch import discard, materialize
from framewright.llm.training import labelled_texts, one_of_copies


@dataclass(frozen=True)
class RankConfig:
    bins: int = 16
    steps: int = 60
    l2: float = 1e-4
    cut_score: float = 0.3


FIGURES = (
    "words", "bytes_per_word", "upper", "digits", "symbols", "marks", "bars", "line_words",
    "repeated_words", "repeated_windows", "repeated_lines", "long_words", "short_words", "stops", "high_bytes", "spread",
)


def _class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=np.int64)
    table[list(chars)] = 1
    return table


_CLASSES = {
    "upper": _class(bytes(range(65, 91))),
    "letters": _class(bytes([*range(65, 91), *range(97, 123), *range(128, 256)])),
    "digits": _class(b"0123456789"),
    "symbols": _class(b"#$%&*@^~=+<>/\\{}[]_`"),
    "marks": _class(b"!?"),
    "bars": _class(b"|;:\t"),
    "stops": _class(b"."),
    "lines": _class(b"\n"),
    "high": _class(bytes(range(128, 256))),
    "upper2": _class(b"\xc3"),
}


def _repeats(keys: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Per document, how many keys equal an earlier key of it."""
    order = np.lexsort((keys, doc))
    k, d = keys[order], doc[order]
    same = np.zeros(len(k), dtype=bool)
    same[1:] = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
    return np.bincount(d[same], minlength=n).astype(float)


def figures(texts: pa.Array) -> np.ndarray:
    """Documents x style figures; ratios with an empty base are 0."""
    raw, offsets = tk.text_bytes(texts)
    w = tk.words(texts)
    n = len(texts)
    doc = w.doc()
    counts = {k: np.diff(np.concatenate([[0], np.cumsum(t[raw])])[offsets]).astype(float) for k, t in _CLASSES.items()}
    size, n_words = np.diff(offsets).astype(float), np.diff(w.offsets).astype(float)
    ratio = lambda a, b: np.divide(a, b, out=np.zeros(n), where=b > 0)
    length = (w.end - w.start).astype(float)
    total = np.bincount(doc, length, n)
    squares = np.bincount(doc, length * length, n)
    mean = ratio(total, n_words)
    windows = tk.windows(w.hash, 4)
    inside = doc[: len(windows)] == doc[3:] if len(windows) else np.zeros(0, bool)
    owner = doc[: len(windows)][inside]
    ends = np.flatnonzero(raw == 10)
    line_doc = np.searchsorted(offsets, ends, "right") - 1
    starts = np.concatenate([offsets[:-1], ends + 1])
    starts_doc = np.concatenate([np.arange(n), line_doc])
    stops = np.concatenate([ends, offsets[1:]])
    stops_doc = np.concatenate([line_doc, np.arange(n)])
    a, b = np.lexsort((starts, starts_doc)), np.lexsort((stops, stops_doc))
    starts, stops, line_doc = starts[a], stops[b], starts_doc[a]
    full = stops > starts
    lines = np.bincount(line_doc[full], minlength=n).astype(float)
    same_lines = _repeats(tk.span_hash(raw, starts[full], stops[full]), line_doc[full], n)
    columns = [
        np.log1p(n_words),
        ratio(size, n_words),
        ratio(counts["upper"], counts["letters"]),
        ratio(counts["digits"], size),
        ratio(counts["symbols"], size),
        ratio(counts["marks"], size),
        ratio(counts["bars"], size),
        np.log1p(ratio(n_words, lines)),
        ratio(_repeats(w.hash, doc, n), n_words),
        ratio(_repeats(windows[inside], owner, n), np.bincount(owner, minlength=n).astype(float)),
        ratio(same_lines, lines),
        ratio(np.bincount(doc, length > 12, n), n_words),
        ratio(np.bincount(doc, length <= 3, n), n_words),
        ratio(counts["stops"], n_words),
        ratio(counts["high"], size),
        np.sqrt(np.maximum(0, ratio(squares, n_words) - mean * mean)),
    ]
    return np.stack(columns, axis=1)


@dataclass
class RankModel:
    edges: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float
    cut_score: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return sum((w[np.searchsorted(e, x[:, k], "right")] for k, (e, w) in enumerate(zip(self.edges, self.weights, strict=True))), np.zeros(len(x)))

    def score(self, x: np.ndarray) -> np.ndarray:
        level = np.log(self.cut_score / (1 - self.cut_score))
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.strength(x) - self.cut) + level, -40, 40)))


UNIT = 1 / 256  # of a weight
WHOLE = 1 << 30  # a push of 1 as a whole number
MOST = 64.0  # a weight's size


def cells(x: np.ndarray) -> np.ndarray:
    """Numbers of narrow cells of the figures, in their order: single precision without its last 14 bits."""
    bits = x.astype(np.float32).view(np.int32)
    return np.where(bits < 0, bits ^ 0x7FFFFFFF, bits) >> 14


def cell_starts(cell: np.ndarray) -> np.ndarray:
    bits = cell.astype(np.int32) << 14
    return np.where(bits < 0, bits ^ 0x7FFFFFFF, bits).view(np.float32).astype(float)


def edges_of(counts: np.ndarray, width: int, bins: int) -> np.ndarray:
    """Bin edges of each figure: quantiles among good and among poor rows, from ``good, figure, cell, n``."""
    out = np.empty((width, 2 * (bins - 1)))
    for k in range(width):
        sides = []
        for kind in (0, 1):
            c = counts[(counts[:, 0] == kind) & (counts[:, 1] == k)]
            c = c[np.argsort(c[:, 2])]
            total = np.cumsum(c[:, 3])
            sides.append(cell_starts(c[np.searchsorted(total, np.arange(1, bins) / bins * total[-1]), 2]))
        out[k] = np.sort(np.concatenate(sides))
    return out


def bins_of(edges: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(edges)], axis=1).astype(np.uint8)


def cell_counts(good: np.ndarray, x: np.ndarray) -> np.ndarray:
    """``good, figure, cell, n`` of some rows."""
    keys = ((good[:, None] * 256 + np.arange(x.shape[1])) << 32) + cells(x) + (1 << 31)
    keys, n = np.unique(keys, return_counts=True)
    return np.column_stack([keys >> 40, (keys >> 32) % 256, keys % (1 << 32) - (1 << 31), n])


def strengths(code: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return sum((w[code[:, k]] for k, w in enumerate(weights)), np.zeros(len(code), dtype=np.int64))


def strength_counts(good: np.ndarray, code: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """``strength, good, poor`` of some rows, in units."""
    values, at = np.unique(strengths(code, weights), return_inverse=True)
    return np.column_stack([values, np.bincount(at, good, len(values)), np.bincount(at, ~good, len(values))]).astype(np.int64)


def push_sums(good: np.ndarray, code: np.ndarray, weights: np.ndarray, low: int, push: np.ndarray) -> np.ndarray:
    """Sums by bin of the whole pushes that rows of a kind (poor, good) and strength get."""
    width = weights.shape[1]
    each = push[good.astype(int), strengths(code, weights) - low]
    return np.bincount((code + np.arange(code.shape[1]) * width).ravel(), np.repeat(each, code.shape[1]), weights.size).astype(np.int64)


class HeldRows:
    """Rows in memory."""

    def __init__(self, good: np.ndarray, x: np.ndarray):
        self.good, self.x = good, x

    def cell_counts(self) -> np.ndarray:
        return cell_counts(self.good, self.x)

    def code(self, edges: np.ndarray) -> None:
        self.codes = bins_of(edges, self.x)

    def strength_counts(self, weights: np.ndarray) -> np.ndarray:
        return strength_counts(self.good, self.codes, weights)

    def push_sums(self, weights: np.ndarray, low: int, push: np.ndarray) -> np.ndarray:
        return push_sums(self.good, self.codes, weights, low, push)


class StoredRows:
    """Rows of a table (``y double, x binary``); one batch's bins are one row of another."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def cell_counts(self) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for good, x in _held(batches):
                yield _columns(cell_counts(good, x), ["good", "figure", "cell", "n"])

        return _numbers(self.rows.mapInArrow(run, "good long, figure long, cell long, n long").groupBy("good", "figure", "cell").agg(F.sum("n").alias("n")))

    def code(self, edges: np.ndarray) -> None:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for good, x in _held(batches):
                yield pa.RecordBatch.from_arrays([pa.array([good.tobytes()], pa.binary()), pa.array([bins_of(edges, x).tobytes()], pa.binary())], names=["good", "code"])

        self.blocks = materialize(self.rows.mapInArrow(run, "good binary, code binary"), "quality-bins")

    def strength_counts(self, weights: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for good, code in _blocks(batches):
                yield _columns(strength_counts(good, code, weights), ["strength", "good", "poor"])

        return _numbers(self.blocks.mapInArrow(run, "strength long, good long, poor long").groupBy("strength").agg(F.sum("good").alias("good"), F.sum("poor").alias("poor")))

    def push_sums(self, weights: np.ndarray, low: int, push: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(weights.size, dtype=np.int64)
            for good, code in _blocks(batches):
                total += push_sums(good, code, weights, low, push)
            yield _columns(np.column_stack([np.arange(len(total)), total]), ["bin", "total"])

        found = _numbers(self.blocks.mapInArrow(run, "bin long, total long").groupBy("bin").agg(F.sum("total").alias("total")))
        return found[np.argsort(found[:, 0]), 1]


def _columns(table: np.ndarray, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c, dtype=np.int64)) for c in table.T], names=names)


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            yield batch.column("y").to_numpy() >= 0.5, np.frombuffer(b"".join(batch.column("x").to_pylist()), dtype=float).reshape(batch.num_rows, -1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for good, code in zip(batch.column("good").to_pylist(), batch.column("code").to_pylist(), strict=True):
            yield np.frombuffer(good, dtype=bool), np.frombuffer(code, dtype=np.uint8).reshape(len(good), -1)


def _numbers(df: DataFrame) -> np.ndarray:
    table = df.toArrow()
    return np.column_stack([c.to_numpy() for c in table.columns]).astype(np.int64).reshape(-1, table.num_columns)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", config: RankConfig = RankConfig()) -> RankModel:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tk.slices(batches, "text"):
            x = figures(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("label_id"), part.column("digest"), pa.array([r.tobytes() for r in x], pa.binary())], names=["label_id", "digest", "x"])

    # a labelled text's figures are shuffled, not the text
    texts = labelled_texts(docs, labels, label)
    found = texts.mapInArrow(run, "label_id long, digest binary, x binary")
    rows = materialize(one_of_copies(found, labels, label, "x").select("y", "x"), "quality-figures")
    stored = StoredRows(rows)
    model = descend(stored, config)
    discard(rows)
    if model.edges.size:
        discard(stored.blocks)
    return model


def train(x: np.ndarray, y: np.ndarray, c: RankConfig) -> RankModel:
    """The fit to rows in memory."""
    return descend(HeldRows(y >= 0.5, x), c)


def all_pairs(counts: np.ndarray) -> tuple[float, int, np.ndarray]:
    """Of counts by strength: the mean loss of all pairs, the least strength, and by kind and strength above it
    a row's mean push over the other kind's rows."""
    low = int(counts[:, 0].min())
    n = int(counts[:, 0].max()) - low + 1
    good, poor = (np.bincount(counts[:, 0] - low, counts[:, k], n) for k in (1, 2))
    size = 1 << (3 * n).bit_length()
    gap = np.arange(-(n - 1), n) * UNIT  # of a poor row's strength over a good one's
    share = lambda rows, kernel: np.fft.irfft(np.fft.rfft(rows / rows.sum(), size) * np.fft.rfft(kernel, size), size)[n - 1 : 2 * n - 1]
    wrong = 1 / (1 + np.exp(-np.clip(gap, -40, 40)))
    loss = float(share(good, np.logaddexp(0, gap)) @ poor / poor.sum())
    return loss, low, np.stack([share(good, wrong), share(poor, wrong[::-1])])


def descend(rows: HeldRows | StoredRows, c: RankConfig) -> RankModel:
    """L-BFGS on the mean logistic loss of all pairs; steps go to weights in whole units."""
    counts = rows.cell_counts()
    if not {0, 1} <= set(counts[:, 0].tolist()):
        return RankModel(np.zeros((len(FIGURES), 0)), np.zeros((len(FIGURES), 1)), 0.0, 0.0, 1 - 1e-9)
    n_good, n_poor = (counts[(counts[:, 0] == kind) & (counts[:, 1] == 0), 3].sum() for kind in (1, 0))
    edges = edges_of(counts, int(counts[:, 1].max()) + 1, c.bins)
    rows.code(edges)
    shape = (len(edges), edges.shape[1] + 1)
    whole = lambda theta: np.rint(np.clip(theta, -MOST, MOST) / UNIT).astype(np.int64)

    def seen(weights: np.ndarray) -> tuple[float, np.ndarray, int, np.ndarray]:
        table = rows.strength_counts(weights.reshape(shape))
        loss, low, push = all_pairs(table)
        return loss + c.l2 / 2 * float((weights * UNIT) @ (weights * UNIT)), table, low, push

    def slope_of(weights: np.ndarray, low: int, push: np.ndarray) -> np.ndarray:
        signed = np.rint(np.clip(push, 0, 1) / np.array([[n_poor], [-n_good]]) * min(n_good, n_poor) * WHOLE)
        return rows.push_sums(weights.reshape(shape), low, signed) / (WHOLE * float(min(n_good, n_poor))) + c.l2 * weights * UNIT

    weights = np.zeros(shape[0] * shape[1], dtype=np.int64)
    loss, table, low, push = seen(weights)
    gradient = slope_of(weights, low, push)
    # the curvature at the start: a bin's shares among good and poor rows
    kind = lambda k: rows.push_sums(weights.reshape(shape), low, np.ones_like(push) * (np.arange(2) == k)[:, None])
    a, b = kind(1) / n_good, kind(0) / n_poor
    curve = 0.25 * (a + b - 2 * a * b) + 10 * c.l2
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(c.steps):
        way, kept = -gradient, []
        for s, d in reversed(past):
            kept.append((s @ way) / (s @ d))
            way = way - kept[-1] * d
        way = way / curve * ((past[-1][0] @ past[-1][1]) / (past[-1][1] @ (past[-1][1] / curve)) if past else 1.0)
        for (s, d), k in zip(past, reversed(kept), strict=True):
            way = way + (k - (d @ way) / (s @ d)) * s
        before, length = loss, 1.0
        while length > 1e-3:
            tried = whole(weights * UNIT + length * way)
            found = seen(tried)
            if found[0] < before - 1e-4 * length * max(0.0, -float(gradient @ way)):
                break
            length /= 2
        else:
            break
        loss, table, low, push = found
        after = slope_of(tried, low, push)
        s, d = (tried - weights) * UNIT, after - gradient
        if s @ d > 1e-12:
            past = [*past[-9:], (s, d)]
        weights, gradient = tried, after
        if before - loss < 1e-5 * before:
            break
    return calibrated(RankModel(edges, (weights * UNIT).reshape(shape), 0.0, 1.0, c.cut_score), table)


def calibrated(model: RankModel, table: np.ndarray) -> RankModel:
    """The cut and the curve's slope, from the counts of rows by strength."""
    table = table[np.argsort(table[:, 0])]
    n, strength = table[:, 1] + table[:, 2], table[:, 0] * UNIT
    place = table[:, 2].sum() / n.sum() * (n.sum() - 1)
    # rows at the quantile are above the cut
    model.cut = float(strength[np.searchsorted(np.cumsum(n), place, "right")]) - UNIT / 2
    level, slope = np.log(model.cut_score / (1 - model.cut_score)), 0.5
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(slope * (strength - model.cut) + level, -40, 40)))
        slope = float(np.clip(slope - 0.05 * ((p * n - table[:, 1]) @ (strength - model.cut)) / n.sum(), 1e-3, 20))
    model.slope = slope
    return model


def score(docs: DataFrame, model: RankModel, name: str = "score", text_col: str = "text") -> DataFrame:
    """``docs`` with a double column ``name`` between 0 and 1; raises if they have such a column."""
    if name.lower() in (x.lower() for x in docs.columns):
        raise ValueError(f"the documents have a column {name}")
    plain = fresh(docs.columns, "plain_text")
    out = docs.withColumn(plain, F.col(text_col).cast("string")).withColumn(name, F.lit(None).cast("double"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tk.slices(batches, plain):
            got = model.score(figures(part.column(plain)))
            yield part.set_column(part.schema.get_field_index(name), pa.field(name, pa.float64()), pa.array(got))

    return out.mapInArrow(run, out.schema).drop(plain)


def keep_good(docs: DataFrame, model: RankModel, least: float = 0.3) -> DataFrame:
    """The documents that score ``least`` or more, with their own columns."""
    name = fresh(docs.columns, "score")
    return score(docs, model, name=name).filter(F.col(name) >= least).select(*docs.columns)
