"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts and items are lower-cased (A-Z) and their white space made single spaces. An item of m bytes may differ from a passage by
e = RATE * m edits. A passage within e edits shares at least t = m - Q + 1 - Q * e of the item's Q-grams with it, on diagonals
(place in the text minus place in the item) that lie at most e apart. So shared Q-grams are counted in overlapping bands of 3(e + 1)
diagonals, one beginning every e + 1, wide enough to hold any such passage; a band of t or more is kept and verified by an alignment
within its diagonals. e is lowered for short items until t is at least 1; items under Q bytes must occur as whole words.

The items' Q-grams go to every task. If they are more than MOST_GRAMS, the items are dealt into slices by hash, each below that size,
and the texts are read once per slice.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varspark.llm.common import as_bytes, in_blocks, mix64

Q = 12
RATE = 0.05
MOST_GRAMS = 2_000_000
FILTER_BITS = 22
TURN = 0x9E3779B97F4A7C15


def plain(text: bytes) -> bytes:
    return b" ".join(text.lower().split())


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each Q bytes."""
    n = max(len(data) - Q + 1, 0)
    out = np.zeros(n, np.uint64)
    for k in range(Q):
        out = out * np.uint64(TURN) + data[k : k + n]
    return mix64(out)


def budget(m: int) -> tuple[int, int]:
    """Edits allowed for an item of m >= Q bytes, and the least number of shared Q-grams."""
    e = min(int(RATE * m), (m - Q) // Q)
    return e, m - Q + 1 - Q * e


def align(item: np.ndarray, region: np.ndarray, width: int) -> tuple[int, int, int]:
    """(edits, start, end) of the best passage of `region` whose diagonals against the item are 0 to width-1."""

    def run(item: np.ndarray, region: np.ndarray, d: np.ndarray) -> np.ndarray:
        padded = np.concatenate([region, np.full(len(item) + len(d), -1, np.int16)])
        step = np.arange(len(d))
        for i, c in enumerate(item):
            d = np.minimum(d + (padded[i : i + len(d)] != c), np.append(d[1:], 1 << 20) + 1)
            d = np.minimum.accumulate(d - step) + step
        return d

    item, region = item.astype(np.int16), region.astype(np.int16)
    m = len(item)
    d = run(item, region, np.zeros(width, np.int64))
    ends = np.arange(width) + m
    d = np.where(ends <= len(region), d, 1 << 20)
    k = int(np.argmin(d))
    end, edits = int(ends[k]), int(d[k])
    # the same backwards from that end, whose diagonal is in the middle of the band
    before = np.concatenate([np.full(width, -1, np.int16), region[:end]])[::-1]
    start = np.full(2 * width + 1, 1 << 20, np.int64)
    start[width] = 0
    shifted = np.concatenate([np.full(width, -1, np.int16), before])
    back = run(item[::-1], shifted, start)
    begins = end - (np.arange(2 * width + 1) + m - width)
    back = np.where((begins >= 0) & (begins <= end), back, 1 << 20)
    return edits, int(begins[int(np.argmin(back))]), end


class Items:
    """The items' Q-grams, sorted by hash."""

    def __init__(self, rows: list[tuple[int, bytes]]):
        self.ids = [i for i, _ in rows]
        self.texts = [plain(t) for _, t in rows]
        self.short = [k for k, t in enumerate(self.texts) if 0 < len(t) < Q]
        grams = [gram_hashes(np.frombuffer(t, np.uint8)) for t in self.texts]
        of = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        at = np.concatenate([np.arange(len(g)) for g in grams] or [np.empty(0, np.int64)])
        hashes = np.concatenate(grams or [np.empty(0, np.uint64)])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.of, self.at = hashes[order], of[order], at[order]
        self.edits = np.array([budget(len(t))[0] if len(t) >= Q else 0 for t in self.texts], np.int64)
        self.least = np.array([budget(len(t))[1] if len(t) >= Q else 1 << 30 for t in self.texts], np.int64)
        self.filter = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.filter[(self.hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def matches(self, texts: list[bytes]) -> list[list[tuple[int, int, int, int]]]:
        """For each text (item number, edits, start, end) in bytes of the plain text; of overlapping ones of an item the best."""
        texts = [plain(t) for t in texts]
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        for k in self.short:
            for n, t in enumerate(texts):
                padded, own = b" " + t + b" ", self.texts[k]
                at = padded.find(b" " + own + b" ")
                while at >= 0:
                    out[n].append((k, 0, at, at + len(own)))
                    at = padded.find(b" " + own + b" ", at + len(own) + 1)
        if not len(self.hashes):
            return out
        data = np.frombuffer((b"\0" * Q).join(texts) + b"\0" * Q, dtype=np.uint8)
        begin = np.cumsum([0, *(len(t) + Q for t in texts)])
        codes = gram_hashes(data)
        where = np.flatnonzero(self.filter[(codes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        codes = codes[where]
        low, high = np.searchsorted(self.hashes, codes, "left"), np.searchsorted(self.hashes, codes, "right")
        times = high - low
        where, low, times = where[times > 0], low[times > 0], times[times > 0]
        rows = np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())
        place = np.repeat(where, times)
        item = self.of[rows]
        doc = np.searchsorted(begin, place, side="right") - 1
        diagonal = place - begin[doc] - self.at[rows] + (1 << 20)
        band = diagonal // (self.edits[item] + 1)
        # a hit counts in the three bands that hold its diagonal
        band = (band[:, None] - np.arange(3)).ravel()
        doc, item = np.repeat(doc, 3), np.repeat(item, 3)
        order = np.lexsort((band, item, doc))
        doc, item, band = doc[order], item[order], band[order]
        new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1])])[: len(doc)])
        count = np.diff(np.append(new, len(doc)))
        found = defaultdict(set)
        for k in new[count >= self.least[item[new]]]:
            found[int(doc[k]), int(item[k])].add(int(band[k]))
        for (n, k), bands in found.items():
            e, own = int(self.edits[k]), np.frombuffer(self.texts[k], np.uint8)
            text, got = np.frombuffer(texts[n], np.uint8), set()
            for c in sorted(bands):
                first = c * (e + 1) - (1 << 20)
                lo, hi = max(first, 0), min(first + 3 * (e + 1) + len(own), len(text))
                at = texts[n].find(self.texts[k], lo, hi)
                edits, start, end = (0, at - lo, at - lo + len(own)) if at >= 0 else align(own, text[lo:hi], min(3 * (e + 1), max(hi - lo, 1)))
                if edits <= e:
                    got.add((edits, lo + start, lo + end))
            kept: list[tuple[int, int, int]] = []
            for x in sorted(got):
                if all(x[2] <= y[1] or y[2] <= x[1] for y in kept):
                    kept.append(x)
            out[n] += [(k, *x) for x in sorted(kept, key=lambda x: x[1])]
        return out


def slices(items: DataFrame, key: str, text: str) -> Iterator[list[tuple[int, bytes]]]:
    """The items (null texts left out), in slices of about MOST_GRAMS bytes at most; one slice if they are small enough."""
    own = items.select(F.col(key).alias("id"), F.col(text).cast("binary").alias("text")).where("text IS NOT NULL")
    total = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = -(-total // MOST_GRAMS)
    for k in range(n):
        part = own if n == 1 else own.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        yield sorted((r.id, bytes(r.text)) for r in part.collect())


def find_matches(docs: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """One row per passage of a text within the edit budget of an item: key, item key, start, end (code points of the plain text), edits, item_bytes.

    Null and empty texts and items match nothing. Rows and items alike are each compared; an item twice in a text is found twice if the
    places don't overlap. Without items the result is empty. Texts of any length are searched as wholes, with arrays of eight bytes for each
    byte of the text. item_key must be an integer column. Other columns are left out.
    """
    kind, item_kind = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    schema = f"`{key}` {kind}, `{item_key}` {item_kind}, start long, end long, edits int, item_bytes int"
    out = docs.sparkSession.createDataFrame([], schema)
    for rows in slices(items, item_key, text):
        out = out.union(docs.select(key, text).mapInArrow(_matcher(docs, rows, schema, text), schema))
    return out


def _matcher(docs: DataFrame, rows: list[tuple[int, bytes]], schema: str, text: str):
    shared = docs.sparkSession.sparkContext.broadcast(rows)

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(shared.value)
        for batch in in_blocks(batches, text):
            texts = as_bytes(batch.column(1))
            flat = [(n, m) for n, own in enumerate(items.matches(texts)) for m in own]
            chars = {n: plain(texts[n]) for n, _ in flat}
            points = lambda n, at: len(chars[n][:at].decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array([n for n, _ in flat], pa.int64())),
                    pa.array([items.ids[m[0]] for _, m in flat], pa.int64()),
                    pa.array([points(n, m[2]) for n, m in flat], pa.int64()),
                    pa.array([points(n, m[3]) for n, m in flat], pa.int64()),
                    pa.array([m[1] for _, m in flat], pa.int32()),
                    pa.array([len(items.texts[m[0]]) for _, m in flat], pa.int32()),
                ],
                names,
            )

    names = [x.strip().split(" ")[0].strip("`") for x in schema.split(",")]
    return block


def drop_contaminated(docs: DataFrame, items: DataFrame, item_key: str = "item_id", text: str = "text") -> DataFrame:
    """docs without the rows that hold a passage within the edit budget of an item. All columns stay; null texts are kept."""
    at = docs.columns.index(text)
    for rows in slices(items, item_key, text):
        shared = docs.sparkSession.sparkContext.broadcast(rows)

        def block(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = Items(shared.value)
            for batch in in_blocks(batches, text):
                yield batch.filter(pa.array([not m for m in own.matches(as_bytes(batch.column(at)))], pa.bool_()))

        docs = docs.mapInArrow(block, docs.schema)
    return docs
