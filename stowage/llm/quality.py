"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature has a lookup table over quantile bins. The tables are learned by cyclic
boosting: in turn, each feature gets a tree of at most three leaves, fitted to the
gradient and added, damped, to its table. Then the pairs of features that explain most
of what is left are boosted in the same way, with trees that cut the two features once
each. A score is a sum of table entries, found for a whole batch at once.

Features are statistics of the whole text; nothing else of a row is looked at. The
model is fitted on the driver from at most ``labelled.SAMPLE`` labelled rows and is a
few kilobytes, whatever the size of the corpus; scoring is one pass without a shuffle.

Cases: a null or empty text has all features 0 and gets a score like any other; rows
without labels of both kinds give a model that scores the share of label 1, or 0.5
without any label; repeated rows score alike; an empty input gives an empty result.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from stowage.llm.labelled import held_out, training_rows
from stowage.llm.workers import texts, tidy
from stowage.session import small_batches

THRESHOLD = 0.3
FEATURES = (
    "words", "word_length", "distinct_words", "repeats_before", "upper", "exclaim", "bars", "symbols", "stops", "commas",
    "digits", "line_ends", "beyond_ascii", "short_words", "repeated_lines", "other_marks", "words_in_sentence", "space",
)
BINS, COARSE = 32, 8
ROUNDS, PAIR_ROUNDS, PAIRS, RATE, DAMP = 120, 60, 8, 0.15, 2.0


def text_features(text: bytes) -> list[float]:
    if not text:
        return [0.0] * len(FEATURES)
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    n = max(1, len(words))
    chars = len(text) - int(seen[0x80:0xC0].sum())
    upper, lower = int(seen[65:91].sum()), int(seen[97:123].sum())
    lines = text.split(b"\n")
    marks = int(seen[33:48].sum() + seen[58:65].sum() + seen[91:97].sum() + seen[123:127].sum())
    symbols = int(seen[[35, 36, 37, 38, 42, 64, 94, 126]].sum())
    known = symbols + int(seen[33] + seen[124] + seen[46] + seen[44])
    return [
        np.log1p(len(words)),
        chars / n,
        len(set(words)) / n,
        sum(map(operator.eq, words, words[1:])) / n,
        upper / max(1, upper + lower),
        seen[33] / n,
        seen[124] / n,
        symbols / n,
        seen[46] / n,
        seen[44] / n,
        seen[48:58].sum() / chars if chars else 0.0,
        seen[10] / n,
        (chars - seen[:128].sum()) / chars if chars else 0.0,
        sum(1 for w in words if len(w) < 3) / n,
        1.0 - len(set(lines)) / len(lines),
        max(0, marks - known) / n,
        n / (1.0 + seen[46] + seen[33] + seen[63]),
        (seen[9:14].sum() + seen[32]) / len(text),
    ]


@dataclass
class Additive:
    """Edges and tables by feature, tables by pair, and the intercept."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, f], "right")]
        for i, j, table in self.pairs:
            total += table[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return 1.0 / (1.0 + np.exp(-total))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + DAMP)


def _split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The gain of the best cut of a row of bins, and the number of bins left of it."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gains = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h) - _gain(g.sum(), h.sum())
    best = int(np.argmax(gains))
    return float(gains[best]), best + 1


def _shallow_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values by bin of a tree of at most three leaves."""
    _, first = _split(g, h)
    if not first:
        return np.zeros(len(g))
    bounds = [0, first, len(g)]
    options = [(s[0], a + s[1]) for a, b in ((0, first), (first, len(g))) if (s := _split(g[a:b], h[a:b]))[1]]
    if options:
        bounds = sorted({*bounds, max(options)[1]})
    values = np.zeros(len(g))
    for a, b in zip(bounds, bounds[1:], strict=False):
        values[a:b] = g[a:b].sum() / (h[a:b].sum() + DAMP)
    return values


def _best_cross(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The gain of the best tree that cuts both features of a pair once, and its leaf values by cell."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    total = np.zeros((g.shape[0] - 1, g.shape[1] - 1))
    if not total.size:
        return 0.0, np.zeros_like(g)
    parts = []
    for low_i in (True, False):
        for low_j in (True, False):
            quarter = []
            for c in (cg, ch):
                a, row, column = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1]
                quarter.append(a if low_i and low_j else row - a if low_i else column - a if low_j else c[-1, -1] - row - column + a)
            parts.append(quarter)
            total += _gain(*quarter)
    i, j = np.unravel_index(int(np.argmax(total)), total.shape)
    values = np.zeros_like(g)
    for (qg, qh), rows, columns in zip(parts, (slice(None, i + 1),) * 2 + (slice(i + 1, None),) * 2, (slice(None, j + 1), slice(j + 1, None)) * 2, strict=True):
        values[rows, columns] = qg[i, j] / (qh[i, j] + DAMP)
    return float(total[i, j] - _gain(cg[-1, -1], ch[-1, -1])), values


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    """A model of ``y`` (0 or 1) by the rows of ``x``."""
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or not 0 < share < 1:
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Additive(float(np.log(share / (1 - share))))
    model = Additive(float(np.log(share / (1 - share))))
    model.edges = [_cuts(c, BINS) for c in x.T]
    model.coarse = [_cuts(c, COARSE) for c in x.T]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    fine = [np.searchsorted(e, c, "right") for e, c in zip(model.edges, x.T, strict=True)]
    rough = [np.searchsorted(e, c, "right") for e, c in zip(model.coarse, x.T, strict=True)]
    total = np.full(len(y), model.intercept)
    for _ in range(ROUNDS):
        for f, bins in enumerate(fine):
            p = 1.0 / (1.0 + np.exp(-total))
            size = len(model.tables[f])
            step = RATE * _shallow_tree(np.bincount(bins, y - p, size), np.bincount(bins, p * (1 - p), size))
            model.tables[f] += step
            total += step[bins]

    def cells(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = 1.0 / (1.0 + np.exp(-total))
        shape = (len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)
        at = rough[i] * shape[1] + rough[j]
        return at, np.bincount(at, y - p, shape[0] * shape[1]).reshape(shape), np.bincount(at, p * (1 - p), shape[0] * shape[1]).reshape(shape)

    ranked = sorted(((_best_cross(*cells(i, j)[1:])[0], i, j) for i in range(x.shape[1]) for j in range(i)), reverse=True)
    model.pairs = [(i, j, np.zeros((len(model.coarse[i]) + 1, len(model.coarse[j]) + 1))) for _, i, j in ranked[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in model.pairs:
            at, g, h = cells(i, j)
            step = RATE * _best_cross(g, h)[1]
            table += step
            total += step.ravel()[at]
    return model


@tidy
def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [text_features(t) for t in texts(batch, 1)]
        yield pa.record_batch({"doc_id": batch.column(0), "y": batch.column(2), "x": pa.array(rows, pa.list_(pa.float64()))})


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Additive:
    """A model from the labelled documents outside the held-out fold."""
    small_batches(docs.sparkSession)
    rows = training_rows(docs, labels, label).mapInArrow(_features, "doc_id long, y double, x array<double>").collect()
    rows.sort(key=lambda r: (r.doc_id, r.y, r.x))
    return fit(np.array([r.x for r in rows]).reshape(-1, len(FEATURES)), np.array([r.y for r in rows]))


def score(docs: DataFrame, model: Additive, column: str = "score") -> DataFrame:
    """The rows of ``docs`` with a score; a column of that name is replaced."""
    docs = docs.drop(column)
    at = docs.columns.index("text")
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([text_features(t) for t in texts(batch, at)]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.scores(x))], names=[*batch.schema.names, column])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
