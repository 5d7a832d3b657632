"""Toxicity: non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; all other texts are unlabelled, whatever they hold. A text's features are its words and their
beginnings of 4 to 8 bytes (lower case, edges without marks), so inflected forms share some, and of beginnings also whether two or three
unlike words of the text have them. Features are chosen on the sample: all whose share among positives exceeds that among unlabelled texts
by LEAST_Z standard errors, and that LEAST_TEXTS positives have. On these, numpy trains a linear classifier with the sigmoid loss by the
non-negative risk estimator

    prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1)),

where the class prior corrects for the toxic texts among the unlabelled: when the second term falls below zero, its gradient is turned
round, as the method demands. The prior is the share of label 1 among the labelled rows for training. At last a logistic curve is laid
over the margins, with unlabelled texts weighted by how little they look toxic, so that scores are between 0 and 1 and 0.5 divides.

The fit takes a bounded sample of rows: about SAMPLE positives and SAMPLE unlabelled texts, by hash. Texts are scored as wholes, of any length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from varspark.llm.common import as_bytes, in_blocks, labelled_sample, words_of

SAMPLE = 4000
PREFIXES = range(4, 9)
TIMES = 3
LEAST_TEXTS = 3
MEMO = 500_000
LEAST_Z = 3.0
EPOCHS = 60
EDGES = b".,;:!?\"'()[]{}*#$%&|"


def features_of_word(word: bytes) -> list[bytes]:
    """The word without marks at its edges, and its beginnings of PREFIXES bytes where more follows."""
    word = word.strip(EDGES)
    return [word, *(b"^" + word[:k] for k in PREFIXES if len(word) > k)]


def times(feature: bytes, n: int) -> list[bytes]:
    """The names of a feature that n unlike words of a text have: itself, and from two on with the number, up to TIMES."""
    return [feature, *(b"%d" % k + feature for k in range(2, min(n, TIMES) + 1))]


def features_of(text: bytes) -> set[bytes]:
    counts = Counter(f for w in {w.strip(EDGES) for w in words_of(text)} for f in features_of_word(w))
    return {name for f, n in counts.items() for name in times(f, n)}


def count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_blocks(batches, "text"):
        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for label, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
            counts[label].update(features_of(text))
        for label, c in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(c), pa.int32()), pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], ["label", "feature", "n"])


class Rows:
    """Rows of 0/1 features by their numbers; what stands in a row is summed or spread without a matrix."""

    def __init__(self, hits: list[list[int]]):
        sizes = np.fromiter(map(len, hits), np.int64, len(hits))
        self.begin, self.at = np.concatenate([[0], np.cumsum(sizes)]), np.fromiter((f for h in hits for f in h), np.int64, sizes.sum())

    def __len__(self) -> int:
        return len(self.begin) - 1

    def some(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the row in `rows`, feature) of all that stands in them."""
        sizes = self.begin[rows + 1] - self.begin[rows]
        where = np.repeat(self.begin[rows] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return np.repeat(np.arange(len(rows)), sizes), self.at[where]

    def margin(self, theta: np.ndarray) -> np.ndarray:
        row, at = self.some(np.arange(len(self)))
        return np.bincount(row, theta[at], len(self)) + theta[-1]


def mean_loss(rows: Rows, chosen: np.ndarray, theta: np.ndarray, sign: float) -> tuple[float, np.ndarray]:
    """Mean sigmoid loss of calling the chosen rows `sign`, and its gradient in theta (weights, then the bias)."""
    row, at = rows.some(chosen)
    margin = np.bincount(row, theta[at], len(chosen)) + theta[-1]
    loss = 0.5 * (1 - np.tanh(0.5 * sign * margin))
    d = -sign * loss * (1 - loss) / len(chosen)
    return float(loss.mean()), np.append(np.bincount(at, d[row], len(theta) - 1), d.sum())


def risk(positive: Rows, p: np.ndarray, unlabelled: Rows, u: np.ndarray, theta: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk over rows p and u, and the direction that is descended: its gradient, or where the second term is below zero
    that term's gradient turned round."""
    plus, g_plus = mean_loss(positive, p, theta, 1.0)
    minus, g_minus = mean_loss(positive, p, theta, -1.0)
    other, g_other = mean_loss(unlabelled, u, theta, -1.0)
    rest, g_rest = other - prior * minus, g_other - prior * g_minus
    return prior * plus + max(0.0, rest), prior * g_plus + g_rest if rest >= 0 else -g_rest


class Linear:
    """Weights of the chosen features, a bias, and the logistic curve over the margin."""

    def __init__(self, names: list[bytes]):
        self.index, self.w, self.b, self.slope, self.shift = {f: k for k, f in enumerate(names)}, np.zeros(len(names)), -1.0, 1.0, 0.0
        self.bases = {f.lstrip(b"23") for f in names} | set(names)
        self.memo: dict[bytes, list[bytes]] = {}

    def hits(self, text: bytes) -> list[int]:
        """The features of a text among the chosen; what a word can add to is kept for the next text that has it."""
        counts: Counter = Counter()
        for w in {w.strip(EDGES) for w in words_of(text)}:
            own = self.memo.get(w)
            if own is None:
                own = self.memo[w] = [f for f in features_of_word(w) if f in self.bases]
            counts.update(own)
        if len(self.memo) > MEMO:
            self.memo.clear()
        return sorted(self.index[name] for f, n in counts.items() for name in times(f, n) if name in self.index)

    def score(self, texts: list[bytes]) -> np.ndarray:
        margin = Rows([self.hits(t) for t in texts]).margin(np.append(self.w, self.b))
        return 0.5 * (1 + np.tanh(0.5 * (self.slope * margin + self.shift)))

    def fit(self, positive: Rows, unlabelled: Rows, prior: float, seed: int = 11) -> Linear:
        """Adam on the non-negative risk."""
        draw, m, v, t = np.random.default_rng(seed), 0.0, 0.0, 0
        theta = np.append(self.w, self.b)
        batches = max(1, min(len(positive), len(unlabelled)) // 256)
        for epoch in range(EPOCHS):
            parts = zip(np.array_split(draw.permutation(len(positive)), batches), np.array_split(draw.permutation(len(unlabelled)), batches), strict=True)
            for p, u in parts:
                _, g = risk(positive, p, unlabelled, u, theta, prior)
                g[:-1] += 1e-5 * theta[:-1]
                t += 1
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                theta = theta - 0.05 * (1 - 0.9 * epoch / EPOCHS) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        self.w, self.b = theta[:-1], theta[-1]
        return self

    def calibrate(self, positive: Rows, unlabelled: Rows, prior: float) -> Linear:
        """Lay a logistic curve over the margins of positives against unlabelled texts that look clean; their share is 1 - prior."""
        p, u = (x.margin(np.append(self.w, self.b)) for x in (positive, unlabelled))
        clean = 0.5 * (1 - np.tanh(0.5 * u))
        x = np.concatenate([p, u])
        y = np.concatenate([np.ones(len(p)), np.zeros(len(u))])
        weight = np.concatenate([np.full(len(p), prior / len(p)), (1 - prior) * clean / max(clean.sum(), 1e-9)])
        a, c = 1.0, 0.0
        for _ in range(50):
            q = 0.5 * (1 + np.tanh(0.5 * (a * x + c)))
            g = np.array([(weight * (q - y) * x).sum() + 1e-3 * (a - 1), (weight * (q - y)).sum()])
            h = weight * q * (1 - q)
            hess = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]])
            step = np.clip(np.linalg.solve(hess, g), -1, 1)
            a, c = max(a - step[0], 0.05), c - step[1]
        self.slope, self.shift = a, c
        return self


def train(docs: DataFrame, labels: DataFrame, key: str, text: str) -> Linear:
    """labels: (key, label). Without positives, or without other texts, every score is the prior (one half without labels)."""
    counts = dict(labels.where("label IS NOT NULL").groupBy("label").count().collect())
    prior = float(np.clip(counts.get(1, 0) / max(1, sum(counts.values())), 1e-3, 0.9)) if counts else 0.5
    toxic = labels.where("label = 1").select(key, F.lit(1).alias("label")).dropDuplicates([key])
    every = docs.select(key).dropDuplicates([key]).join(toxic, key, "left").select(key, F.coalesce("label", F.lit(0)).alias("label"))
    rows, found = labelled_sample(docs, every, key, text, SAMPLE)
    rows = rows.select("label", "text")
    model = Linear([])
    if len(found) == 2:
        seen = {k: 0 for k in (0, 1)} | dict(rows.groupBy("label").count().collect())
        by = rows.mapInArrow(count_features, "label int, feature binary, n long").groupBy("feature").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("u"))
        n, m = max(seen[1], 1), max(seen[0], 1)
        excess = F.col("p") / n - F.col("u") / m
        pooled = (F.col("p") + F.col("u")) / (n + m)
        noise = F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-12)) * (1 / n + 1 / m))
        chosen = by.where((F.col("p") >= LEAST_TEXTS) & (excess / noise >= LEAST_Z)).select("feature").collect()
        model = Linear(sorted(bytes(r.feature) for r in chosen))
    if not model.index:
        model.b = float(np.log(prior / (1 - prior)))
        return model

    def to_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_blocks(batches, "text"):
            hits = [model.hits(t) for t in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hits, pa.list_(pa.int32()))], ["label", "hits"])

    got = sorted((r.label, r.hits) for r in rows.mapInArrow(to_hits, "label int, hits array<int>").collect())
    positive, unlabelled = (Rows([h for label, h in got if label == k]) for k in (1, 0))
    return model.fit(positive, unlabelled, prior).calibrate(positive, unlabelled, prior)


def score_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", score: str = "score") -> DataFrame:
    """docs with a column `score`, 0 to 1: how likely the text is toxic. labels: (key, label), the rows to learn from; 1 is toxic.

    A column named as `score` is replaced. Null texts count as empty and get a score as any text without a feature. Texts of any length are looked at as wholes. Rows alike get
    the same score.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, key, text))
    docs = docs.drop(score)
    schema = StructType([*docs.schema, StructField(score, DoubleType())])

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_blocks(batches, text):
            scores = shared.value.score(as_bytes(batch.column(batch.schema.get_field_index(text))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*batch.schema.names, score])

    return docs.mapInArrow(block, schema)
