"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

1. A lexicon is counted from one half of the labelled sample: words and beginnings of
   words that are far more frequent in toxic texts, with the logarithm of that ratio as
   weight. Look-alike digits and signs within words are undone first.
2. Each text becomes a short vector: densities of lexicon words by weight, their share
   near a word of the second person, capitals, punctuation, and obfuscated words.
3. Histogram trees of depth three are boosted on most of the other half of the sample.
4. The rest of it, which the trees have not seen, gives the isotonic calibration.

The sample is bounded by ``labelled.SAMPLE`` and the lexicon by ``LEXICON``, so the
model does not grow with the corpus; scoring is one pass without a shuffle.

Cases: a null or empty text has all features 0 and gets a score; without labels of
both kinds every score is the share of label 1, or 0 without any label; repeated rows
score alike; an empty input gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from stowage.llm.labelled import held_out, training_rows
from stowage.llm.workers import texts, tidy
from stowage.session import materialize, small_batches

THRESHOLD = 0.5
LEXICON = 1_000
#: A term needs so many toxic documents of the sample, and so large a log ratio.
LEAST_DOCS, LEAST_WEIGHT = 6, 2.0
STEMS = (3, 4, 5, 6, 7, 8)
NEAR = 4
SECOND_PERSON = frozenset("you your yours yourself u du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti tus usted ustedes".split())
FEATURES = ("density", "strong", "strongest", "hits", "weight", "near_you", "you", "capitals", "shouted", "exclaim", "question", "marks", "obfuscated", "words")
LEAVES_DEEP, TREES, RATE, DAMP, BINS = 3, 120, 0.1, 2.0, 32
#: Words whose weights a task keeps from one document to the next.
KEPT_WORDS = 300_000

_LOOKALIKE = str.maketrans("013457@$", "oieastas")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_MIXED = re.compile(r"[^\W\d_][\d@$*#%+!|]+[^\W\d_]")


def plain(word: str) -> tuple[str, bool]:
    """A word in lower case without outer punctuation and look-alikes, and whether it hid behind such signs."""
    bare = _EDGES.sub("", word.lower())
    if bare.isalpha():
        return bare, False
    hidden = bool(_MIXED.search(bare))
    return re.sub(r"[\W\d_]+", "", bare.translate(_LOOKALIKE)) if hidden else bare, hidden


def terms(word: str) -> list[str]:
    """The word itself, and its beginnings, marked by a star."""
    return [word, *(f"{word[:n]}*" for n in STEMS if len(word) > n)]


class _Weights(dict):
    """Weight of each raw word, 0 if none of its terms is in the lexicon; NaN never occurs."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        super().__init__()
        self.lexicon = lexicon
        self.hidden: set[bytes] = set()
        self.person: set[bytes] = set()

    def bound(self) -> None:
        """Forget the words if they are many. Between documents only: a document's words are looked up twice."""
        if len(self) > KEPT_WORDS:
            self.clear()
            self.hidden.clear()
            self.person.clear()

    def __missing__(self, raw: bytes) -> float:
        word, hidden = plain(raw.decode("utf-8", "replace"))
        value = max((self.lexicon.get(t, 0.0) for t in terms(word)), default=0.0) if word else 0.0
        if hidden:
            self.hidden.add(raw)
        if word in SECOND_PERSON:
            self.person.add(raw)
        self[raw] = value
        return value


def text_features(text: bytes, weights: _Weights) -> list[float]:
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    weights.bound()
    n = len(words)
    w = np.fromiter(map(weights.__getitem__, words), np.float64, n)
    hits = np.flatnonzero(w)
    person = weights.person and [i for i, x in enumerate(words) if x in weights.person] or []
    near = 0
    if len(hits) and person:
        at = np.searchsorted(person, hits)
        spots = np.array(person)
        near = int(((np.abs(spots[np.minimum(at, len(spots) - 1)] - hits) <= NEAR) | (np.abs(spots[np.maximum(at - 1, 0)] - hits) <= NEAR)).sum())
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=128)
    upper, lower = int(seen[65:91].sum()), int(seen[97:123].sum())
    hidden = sum(x in weights.hidden for x in words) if weights.hidden else 0
    return [
        len(hits) / n,
        float((w >= 4).sum()) / n,
        float(w.max()),
        float(np.log1p(len(hits))),
        float(w.sum()) / n,
        near / n,
        len(person) / n,
        upper / max(1, upper + lower),
        sum(map(bytes.isupper, words)) / n,
        seen[33] / n,
        seen[63] / n,
        float(seen[33:48].sum() + seen[58:65].sum() + seen[91:97].sum() + seen[123:127].sum()) / n,
        hidden / n,
        float(np.log1p(n)),
    ]


@dataclass
class Boosted:
    """Bin edges, trees in heap order, and the calibration's points."""

    lexicon: dict[str, float]
    start: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    points: tuple[np.ndarray, np.ndarray] | None = None

    def margins(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        if self.trees:
            bins = np.stack([np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T, strict=True)], 1)
            rows = np.arange(len(x))
            for feature, cut, leaf in self.trees:
                at = np.zeros(len(x), np.int64)
                for _ in range(LEAVES_DEEP):
                    at = 2 * at + 1 + (bins[rows, feature[at]] > cut[at])
                total += leaf[at - len(feature)]
        return total

    def scores(self, x: np.ndarray) -> np.ndarray:
        margin = self.margins(x)
        return np.interp(margin, *self.points) if self.points else 1.0 / (1.0 + np.exp(-margin))


def fit_trees(x: np.ndarray, y: np.ndarray, lexicon: dict[str, float]) -> Boosted:
    """Trees boosted on the logistic loss."""
    share = float(np.clip(y.mean() if len(y) else 0.0, 1e-4, 1 - 1e-4))
    model = Boosted(lexicon, float(np.log(share / (1 - share))))
    if not 0 < y.sum() < len(y):
        return model
    model.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    # Most lexicon features are 0 in most texts: cuts among the others too.
    model.edges = [np.unique(np.r_[e, np.quantile(c[c > 0], np.linspace(0, 1, 9)[:-1])]) if (c > 0).any() else e for e, c in zip(model.edges, x.T, strict=True)]
    bins = np.stack([np.searchsorted(e, c, "right") for e, c in zip(model.edges, x.T, strict=True)], 1)
    width = max(len(e) for e in model.edges) + 1
    total = np.full(len(y), model.start)
    inner = 2**LEAVES_DEEP - 1
    for _ in range(TREES):
        p = 1.0 / (1.0 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, width)
        at = np.zeros(len(y), np.int64)
        for depth in range(LEAVES_DEEP):
            first, nodes = 2**depth - 1, 2**depth
            best = np.full(nodes, 1e-6)
            for f in range(x.shape[1]):
                cell = (at - first) * width + bins[:, f]
                cg = np.bincount(cell, g, nodes * width).reshape(nodes, width).cumsum(1)
                ch = np.bincount(cell, h, nodes * width).reshape(nodes, width).cumsum(1)
                gains = cg**2 / (ch + DAMP) + (cg[:, -1:] - cg) ** 2 / (ch[:, -1:] - ch + DAMP) - cg[:, -1:] ** 2 / (ch[:, -1:] + DAMP)
                top = gains.argmax(1)
                better = gains[np.arange(nodes), top] > best
                best[better] = gains[np.arange(nodes), top][better]
                feature[first + np.flatnonzero(better)] = f
                cut[first + np.flatnonzero(better)] = top[better]
            at = 2 * at + 1 + (bins[np.arange(len(y)), feature[at]] > cut[at])
        leaf = RATE * np.bincount(at - inner, g, inner + 1) / (np.bincount(at - inner, h, inner + 1) + DAMP)
        model.trees.append((feature, cut, leaf))
        total += leaf[at - inner]
    return model


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the non-decreasing fit of ``y`` by ``margin``: pooled neighbours, at the middles of their pools."""
    order = np.argsort(margin, kind="stable")
    pools: list[list[float]] = []  # sum of y, count, sum of margins
    for m, v in zip(margin[order], y[order], strict=True):
        pools.append([float(v), 1.0, float(m)])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    values = np.array([(s + 0.01) / (n + 0.02) for s, n, _ in pools])
    return np.array([m / n for _, n, m in pools]), np.maximum.accumulate(values)


def lexicon_of(rows: DataFrame) -> dict[str, float]:
    """Weights of the terms of ``text, y`` that mark toxic texts, LEXICON at most."""

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, bool], list[int]] = {}
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mine: Counter[str] = Counter()
                for raw, n in Counter((text or "").split()).items():
                    word = plain(raw)[0]
                    if word:
                        for t in terms(word):
                            mine[t] += n
                for t, n in mine.items():
                    slot = found.setdefault((t, y > 0.5), [0, 0])
                    slot[0] += n
                    slot[1] += 1
        keys = list(found)
        yield pa.record_batch({
            "term": pa.array([k[0] for k in keys], pa.string()), "toxic": pa.array([k[1] for k in keys], pa.bool_()),
            "n": pa.array([found[k][0] for k in keys], pa.int64()), "docs": pa.array([found[k][1] for k in keys], pa.int64()),
        })

    counts = rows.select("text", "y").mapInArrow(count, "term string, toxic boolean, n long, docs long")
    size = rows.groupBy((F.col("y") > 0.5).alias("toxic")).agg(F.sum(F.size(F.split("text", r"\s+"))).alias("n")).collect()
    size = {r.toxic: float(r.n or 1) for r in size}
    if len(size) < 2:
        return {}
    by = counts.groupBy("term").agg(
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("n1"), F.sum(F.when(F.col("toxic"), 0).otherwise(F.col("n"))).alias("n0"),
        F.sum(F.when(F.col("toxic"), F.col("docs")).otherwise(0)).alias("d1"),
    ).filter(F.col("d1") >= LEAST_DOCS)
    weight = F.log((F.col("n1") + 0.5) / size[True]) - F.log((F.col("n0") + 0.5) / size[False])
    top = by.select("term", weight.alias("weight"), "d1").filter(F.col("weight") >= LEAST_WEIGHT)
    return {r.term: r.weight for r in top.orderBy(F.desc(F.col("weight") * F.log1p("d1")), "term").limit(LEXICON).collect()}


def _vectors(lexicon: dict[str, float]):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = _Weights(lexicon)
        for batch in batches:
            rows = [text_features(t, weights) for t in texts(batch, 1)]
            yield pa.record_batch({"doc_id": batch.column(0), "y": batch.column(2), "x": pa.array(rows, pa.list_(pa.float64()))})

    return run


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Boosted:
    """A model from the labelled documents outside the held-out fold."""
    small_batches(docs.sparkSession)
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(10))
    rows = materialize(training_rows(docs, labels, label).withColumn("part", part), "labelled")
    lexicon = lexicon_of(rows.filter("part < 5"))
    got = rows.filter("part >= 5").select("doc_id", "text", "y").mapInArrow(_vectors(lexicon), "doc_id long, y double, x array<double>")
    got = sorted(got.withColumn("part", part).collect(), key=lambda r: (r.doc_id, r.y, r.x))
    x, y = np.array([r.x for r in got]).reshape(-1, len(FEATURES)), np.array([r.y for r in got])
    last = np.array([r.part >= 8 for r in got], bool)
    model = fit_trees(x[~last], y[~last], lexicon)
    if 0 < y[last].sum() < last.sum():
        model.points = isotonic(model.margins(x[last]), y[last])
    return model


def score(docs: DataFrame, model: Boosted, column: str = "score") -> DataFrame:
    """The rows of ``docs`` with a score; a column of that name is replaced."""
    docs = docs.drop(column)
    at = docs.columns.index("text")
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = _Weights(shared.value.lexicon)
        for batch in batches:
            x = np.array([text_features(t, weights) for t in texts(batch, at)]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.scores(x))], names=[*batch.schema.names, column])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
