"""Quality classifier: gated attention-based multiple-instance learning.

A text is a bag of passages: runs of about PASSAGE bytes, cut at a space or line end, so the whole text is covered. Each passage is
encoded by shares of its bytes and words (FEATURES); the encoding looks at nothing else of the document. With h a passage's encoding,
its attention is the softmax over the bag of w . (tanh(V h) * sigmoid(U h)); the bag is the attention-weighted mean of the passages'
representations tanh(E h), and its score sigmoid(c . bag + b). All of V, U, w, E, c, b are learned by numpy from document labels only.

The fit takes a bounded sample of labelled rows, by hash: about SAMPLE of each label, fewer where their texts are long, so that a label's
texts have PASSAGES passages on average and twice that at most. A text in the sample is learned from whole, as it is scored. The share of
label 1 among all labelled rows for training sets the weights, so scores stay probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

from varspark.llm.common import as_bytes, in_blocks, labelled_sample, mix64

PASSAGE = 512
SAMPLE = 3000
#: Bytes of text that are encoded at once; a longer text is alone.
SLICE = 1 << 20
PASSAGES = 40_000
HIDDEN = 16
EPOCHS = 60

#: Byte classes whose shares are features: lower case, upper case, digits, spaces, line ends, beyond ASCII, then single marks.
MARKS = b".,;:!?|*#$%&@<>{}[]()/\\\"'-_=+~^"
CLASSES = np.zeros((256, 6 + len(MARKS)), dtype=bool)
CLASSES[ord("a") : ord("z") + 1, 0] = CLASSES[ord("A") : ord("Z") + 1, 1] = CLASSES[ord("0") : ord("9") + 1, 2] = True
CLASSES[[9, 11, 12, 13, 32], 3] = CLASSES[10, 4] = CLASSES[128:, 5] = True
for _k, _c in enumerate(MARKS):
    CLASSES[_c, 6 + _k] = True
FEATURES = CLASSES.shape[1] + 8


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of the texts, a space after each; where each passage starts; the first passage of each text. An empty text has one."""
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    begin = np.cumsum(sizes) - sizes
    n = -(-sizes // PASSAGE)
    first = np.cumsum(n) - n
    of = np.repeat(np.arange(len(texts)), n)
    at = begin[of] + (np.arange(n.sum()) - first[of]) * PASSAGE
    # a cut moves on to just after the next space within 64 bytes
    gaps = np.flatnonzero((data == 32) | (data == 10))
    following = gaps[np.minimum(np.searchsorted(gaps, at - 1), len(gaps) - 1)] + 1
    inner = np.ones(len(at), dtype=bool)
    inner[first] = False
    move = inner & (following - at <= 64) & (following < begin[of] + sizes[of])
    return data, np.where(move, following, at), first


def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The encodings of all passages of the texts, and the first passage of each text."""
    data, starts, first = passages(texts)
    size = np.diff(np.append(starts, len(data))).astype(np.float64)
    codes = np.zeros(256, dtype=np.uint8)
    for k in range(CLASSES.shape[1]):
        codes[CLASSES[:, k]] = k + 1
    coded = codes[data].astype(np.int64) + np.repeat(np.arange(len(starts)) * 64, size.astype(np.int64))
    shares = np.bincount(coded, minlength=64 * len(starts)).reshape(-1, 64)[:, 1 : CLASSES.shape[1] + 1] / size[:, None]
    # words: maximal runs of other than white space, cut at passages
    space = (data == 32) | ((data >= 9) & (data <= 13))
    opens = ~space
    opens[1:] &= space[:-1]
    opens[starts] |= ~space[starts]
    word = np.flatnonzero(opens)
    at = np.arange(len(data), dtype=np.int64)
    out = np.zeros((len(starts), FEATURES))
    out[:, : CLASSES.shape[1]] = np.sqrt(shares)
    if len(word):
        within = at - np.repeat(word, np.diff(np.append(word, len(data)))) if word[0] == 0 else np.concatenate([np.zeros(word[0], np.int64), at[word[0] :] - np.repeat(word, np.diff(np.append(word, len(data))))])
        powers = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))
        value = np.where(space, 0, data).astype(np.uint64) * powers[within & 63]
        hashes = mix64(np.add.reduceat(value, word))
        length = np.add.reduceat((~space).astype(np.int64), word)
        of = np.searchsorted(starts, word, side="right") - 1
        words = np.bincount(of, minlength=len(starts)).astype(float)
        some = np.maximum(words, 1)
        same = np.zeros(len(word), dtype=bool)
        same[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
        ranked = np.sort(hashes >> np.uint64(24) | (of.astype(np.uint64) << np.uint64(40)))
        distinct = np.bincount((ranked[np.concatenate([[True], ranked[1:] != ranked[:-1]])] >> np.uint64(40)).astype(np.int64), minlength=len(starts))
        mean = np.bincount(of, length, minlength=len(starts)) / some
        spread = np.sqrt(np.maximum(np.bincount(of, length.astype(float) ** 2, minlength=len(starts)) / some - mean**2, 0))
        extra = (np.bincount(of, same, minlength=len(starts)) / some, distinct / some, np.log1p(mean), np.log1p(spread), np.log1p(words) / 5, np.bincount(of, length <= 1, minlength=len(starts)) / some, np.bincount(of, length >= 20, minlength=len(starts)) / some)
        for k, x in enumerate(extra):
            out[:, CLASSES.shape[1] + k] = x
    out[:, -1] = np.log1p(size) / 6
    return out, first


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Attention:
    """The model: standardised inputs, then gated attention."""

    def __init__(self, features: int, seed: int = 7):
        draw = np.random.default_rng(seed)
        scale = 1 / np.sqrt(features)
        self.mean, self.spread = np.zeros(features), np.ones(features)
        self.p = {"V": draw.normal(0, scale, (features, HIDDEN)), "U": draw.normal(0, scale, (features, HIDDEN)), "w": draw.normal(0, 0.1, HIDDEN), "E": draw.normal(0, scale, (features, HIDDEN)), "e": np.zeros(HIDDEN), "c": draw.normal(0, 0.1, HIDDEN), "b": np.zeros(1)}

    def forward(self, x: np.ndarray, first: np.ndarray):
        p, h = self.p, (x - self.mean) / self.spread
        n = np.diff(np.append(first, len(h)))
        of = np.repeat(np.arange(len(first)), n)
        v, u, e = np.tanh(h @ p["V"]), sigmoid(h @ p["U"]), np.tanh(h @ p["E"] + p["e"])
        s = (v * u) @ p["w"]
        s = np.exp(s - np.maximum.reduceat(s, first)[of])
        a = s / np.add.reduceat(s, first)[of]
        bag = np.add.reduceat(a[:, None] * e, first)
        return h, of, v, u, e, a, bag, sigmoid(bag @ p["c"] + p["b"][0])

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.forward(x, first)[-1]

    def fit(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int = 7) -> Attention:
        """Adam on the weighted cross-entropy, in batches of 64 bags, with weight decay."""
        self.mean, self.spread = x.mean(0), x.std(0) + 0.05
        n = np.diff(np.append(first, len(x)))
        draw, m, v, t = np.random.default_rng(seed), {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        for epoch in range(EPOCHS):
            order = draw.permutation(len(first))
            for batch in np.array_split(order, max(1, len(order) // 64)):
                rows = np.concatenate([np.arange(first[k], first[k] + n[k]) for k in batch])
                g = self.gradient(x[rows], np.cumsum(n[batch]) - n[batch], y[batch], weight[batch])
                t += 1
                for k in self.p:
                    d = g[k] + 1e-4 * self.p[k]
                    m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.999 * v[k] + 0.001 * d * d
                    self.p[k] = self.p[k] - 0.01 * (1 - epoch / EPOCHS * 0.9) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        return self

    def gradient(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        h, of, v, u, e, a, bag, q = self.forward(x, first)
        d = weight * (q - y) / weight.sum()
        d_bag = d[:, None] * p["c"]
        d_e = a[:, None] * d_bag[of] * (1 - e * e)
        d_a = np.einsum("ij,ij->i", e, d_bag[of])
        d_s = a * (d_a - np.add.reduceat(a * d_a, first)[of])
        d_v, d_u = d_s[:, None] * p["w"] * u * (1 - v * v), d_s[:, None] * p["w"] * v * u * (1 - u)
        return {"V": h.T @ d_v, "U": h.T @ d_u, "w": (v * u).T @ d_s, "E": h.T @ d_e, "e": d_e.sum(0), "c": bag.T @ d, "b": np.array([d.sum()])}


def encode_bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, text) to (label, n, x): the passages of a text, all n of them, and their encodings as float32 bytes."""
    for batch in in_blocks(batches, "text", SLICE):
        x, first = encode(as_bytes(batch.column(1)))
        n = np.diff(np.append(first, len(x)))
        out = [x[at : at + m].astype(np.float32).tobytes() for at, m in zip(first, n, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(out, pa.binary())], ["label", "n", "x"])


def train(docs: DataFrame, labels: DataFrame, key: str, text: str) -> Attention:
    """With no labelled rows, or labels of one kind only, the score is the share of label 1 (one half without any)."""
    texts, counts = labelled_sample(docs, labels, key, text, SAMPLE, PASSAGES * PASSAGE)
    rows = texts.select("label", "text").mapInArrow(encode_bags, "label int, n long, x binary").toArrow()
    y, n = rows["label"].to_numpy().astype(float), rows["n"].to_numpy()
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    model = Attention(FEATURES)
    if len(set(y)) < 2:
        odds = np.clip(share if counts else 0.5, 1e-3, 1 - 1e-3)
        model.p["c"][:], model.p["b"][0] = 0, np.log(odds / (1 - odds))
        return model
    order = np.argsort([xxhash.xxh64_intdigest(x) for x in rows["x"].to_pylist()], kind="stable")  # whatever order the rows came in
    parts = rows["x"].to_pylist()
    x = np.frombuffer(b"".join(parts[k] for k in order), dtype=np.float32).reshape(-1, FEATURES).astype(np.float64)
    y, n = y[order], n[order]
    weight = np.where(y == 1, share / (y == 1).mean(), (1 - share) / (y == 0).mean())
    return model.fit(x, np.cumsum(n) - n, y, weight)


def score_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", score: str = "score") -> DataFrame:
    """docs with a column `score`, 0 to 1: how likely label 1 is. labels: (key, label), the rows to learn from.

    A column named as `score` is replaced. Null texts count as empty; an empty text is a bag of one empty passage and gets a score
    like any. Rows alike get the same score. Texts of any length are encoded as wholes, all passages of one in one bag.
    """
    model = train(docs, labels, key, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(score)
    schema = StructType([*docs.schema, StructField(score, DoubleType())])

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_blocks(batches, text, SLICE):
            x, first = encode(as_bytes(batch.column(batch.schema.get_field_index(text))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.score(x, first))], [*batch.schema.names, score])

    return docs.mapInArrow(block, schema)
