"""Removal of repeated bytes with a logarithmic family of indexes.

What is removed: each byte covered by a string of LONG bytes that also starts earlier (a smaller key, or the same text further left).

The method named is a family of suffix arrays. Here the levels hold selected suffixes by hashes, and no suffixes are ordered: of every
LONG-byte window one suffix is indexed, the one that begins with the window's least hash of GRAM bytes (leftmost of equals), about one
suffix in 39. Equal windows pick the same suffix at the same offset, so nothing is lost. A suffix stands in a level by the hash of its first
GRAM bytes, and then by the hash of all bytes that its own windows cover; texts alike there are one class, of which only the first place is
kept. Hashes can be dealt out and combined before a shuffle, which the order of suffixes can't, and a window needs its left side too.

* Batches come in the order of their keys. A batch's suffixes are looked up by (h, c) in all levels of the family, an equi-join; a suffix
  whose class stands in a level, or earlier in the batch, has all its windows marked. New classes become a level. Before the next batch,
  levels of equal size merge, so there are no more than the logarithm of the number of batches.
* Classes that share h but differ in c agree in some windows only. The bytes around their first places are fetched from the texts, and their
  windows are halved in, by SIZES: in cells of 32 windows, equal parts leave but the first, and parts whose core (the bytes that all windows of
  the cell have in common) nobody shares end; what is left goes on in cells of 8, then window by window. Every step is a least place by hash.
* Marks meet their text by key; the union of marked windows is cut out.

No step needs all places of a hash in one task, and none pairs them: least places are aggregates, combined before the shuffle, and joined back.
Batches are four for half a gigabyte and one more for each doubling of the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varspark.llm.common import as_bytes, discard, in_blocks, mix64, release, saved

LONG = 100
GRAM = 24
WINDOW = LONG - GRAM + 1
BATCHES, FIRST_BYTES = 4, 1 << 29
SLICE = 1 << 20
SIZES = (32, 8, 1)
TURN_H, TURN_C = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


class Rolling:
    """Hashes of any stretch of bytes, from running sums of byte * turn^place (modulo 2^64)."""

    def __init__(self, data: np.ndarray, turn: int):
        n = len(data)
        powers = np.cumprod(np.full(n + 1, turn, np.uint64))
        self.back = np.cumprod(np.full(n + 1, pow(turn, -1, 1 << 64), np.uint64))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts in one array, and where each begins."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes) - sizes


def suffixes(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, h, c, place, lo, hi) of the indexed suffixes: those for the windows that begin place-lo to place-hi."""
    data, begin = joined(texts)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    none = np.empty(0, np.int64)
    if len(data) < LONG or not (sizes >= LONG).any():
        return none, none, none, none, none, none
    n = len(data) - GRAM + 1
    rolled = Rolling(data, TURN_H)
    at = np.arange(n)
    h = rolled.of(at, at + GRAM)
    low = (h & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    width = 1
    while width * 2 <= WINDOW:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: len(low) - (WINDOW - width)], low[WINDOW - width :])
    text = np.repeat(np.arange(len(texts)), sizes)[: len(low)]
    start = np.flatnonzero(np.arange(len(low)) + LONG <= (begin + sizes)[text])
    anchor, text = (low[start] & np.uint64(0xFFFFFFFF)).astype(np.int64), text[start]
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    place, lo, hi, text = anchor[first], start[first], start[last], text[first]
    c = Rolling(data, TURN_C).of(lo, hi + LONG)
    return text, h[place].view(np.int64), c.view(np.int64), place - begin[text], place - lo, place - hi


def index_of(docs: DataFrame) -> DataFrame:
    """(id, text) to (h, c, id, at): at packs place, lo and hi."""

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_blocks(batches, "text", SLICE):
            texts, shift = as_bytes(batch.column(1)), 0
            while texts:
                # a longer text is alone in its block and goes slice by slice; a window's suffix depends on its own bytes only
                text, h, c, place, lo, hi = suffixes([t[: SLICE + LONG - 1] for t in texts] if len(texts) == 1 else texts)
                at = place + shift << 14 | lo << 7 | hi
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c), batch.column(0).take(pa.array(text)), pa.array(at)], ["h", "c", "id", "at"])
                texts = [texts[0][SLICE:]] if len(texts) == 1 and len(texts[0]) > SLICE + LONG - 1 else []
                shift += SLICE

    return docs.mapInArrow(block, f"h long, c long, id {docs.schema['id'].dataType.simpleString()}, at long")


class Family:
    """Levels (h, c, id, at) of first places, dealt out by h; classes are distinct over all levels."""

    def __init__(self):
        self.levels: list[tuple[int, DataFrame]] = []

    def classes(self) -> DataFrame | None:
        out = None
        for _, level in self.levels:
            out = level if out is None else out.union(level)
        return out

    def add(self, batch: DataFrame) -> DataFrame:
        """Index a batch of (id, text); (id, at) of its suffixes whose class stands earlier. Keys of later batches must not be smaller."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (n, a), (_, b) = self.levels.pop(), self.levels.pop()
            self.levels.append((2 * n, saved(a.union(b).repartition("h").sortWithinPartitions("h", "c"))))
            discard(a)
            discard(b)
            release(a.sparkSession)
        rows = saved(index_of(batch))
        own = rows.groupBy("h", "c").agg(F.min(F.struct("id", "at")).alias("first"), F.count("*").alias("n"))
        before = self.classes()
        if before is None:
            own = saved(own.select("h", "c", "first", "n", F.lit(False).alias("known")))
        else:
            own = saved(own.join(before.select("h", "c", F.lit(True).alias("known")), ["h", "c"], "left").withColumn("known", F.coalesce("known", F.lit(False))))
        release(rows.sparkSession)
        seen = rows.join(own.where("known OR n > 1"), ["h", "c"]).where("known OR struct(id, at) != first").select("id", "at")
        seen = saved(seen)
        new = saved(own.where("NOT known").select("h", "c", "first.id", "first.at").repartition("h").sortWithinPartitions("h", "c"))
        discard(rows)
        discard(own)
        release(seen.sparkSession)
        self.levels.append((1, new))
        return seen

    def compare(self, docs: DataFrame) -> DataFrame:
        """(id, at) of windows, of first places of classes that share h with another class, that also start earlier."""
        every = self.classes()
        sizes = every.groupBy("h").agg(F.count("*").alias("m")).where("m > 1").select("h")
        wanted = every.join(sizes, "h").groupBy("id").agg(F.collect_list("at").alias("at"))
        texts = docs.join(wanted, "id").select("id", "text", "at")
        kind = docs.schema["id"].dataType.simpleString()
        places = saved(texts.mapInArrow(contexts_block, f"id {kind}, at long, context binary"))
        release(docs.sparkSession)
        # which windows of a place a row speaks of: those that begin `least` to `most` bytes before the place
        rows, found = places.select("id", "at", F.expr("at & 127").alias("least"), F.expr("(at >> 7) & 127").alias("most"), "context"), None
        for size in SIZES:
            rows = saved(cells(rows, size))
            key = ["part", "u"] if size > 1 else ["u"]
            first = rows.groupBy(*key).agg(F.min(F.struct("id", "at", "part")).alias("first"), F.count("*").alias("n"), *([F.min("core").alias("core")] if size > 1 else []))
            first = saved(first) if size > 1 else first
            again = rows.join(first.where("n > 1").select(*key, "first"), key).where("struct(id, at, part) != first")
            again = again.select("id", F.expr("(at >> 14 << 14) | (part & 16383)").alias("at"))
            found = again if found is None else found.union(again)
            if size > 1:
                cell = F.expr("part >> 14")
                shared = first.groupBy(cell.alias("cell"), "core").agg(F.count("*").alias("k")).where("k > 1").select("cell", "core")
                left = first.withColumn("cell", cell).join(shared, ["cell", "core"])
                rows = left.select("first.id", "first.at", F.expr("part & 127").alias("least"), F.expr("(part >> 7) & 127").alias("most")).join(places, ["id", "at"])
            release(docs.sparkSession)
        out = saved(found)
        discard(places)
        release(docs.sparkSession)
        return out


def cells(rows: DataFrame, size: int) -> DataFrame:
    """(id, at, least, most, context) to one row for each cell of `size` windows that it has a part in: (id, at, part, u, core).

    part packs the cell and the most and least of it; u is the hash of all bytes that the windows of the part cover, core that of the bytes
    which every window of the whole cell has, wherever the part ends. Rows with the same part and u have the same windows; a row whose core no
    other has, has no window that another has. Of single windows there is no core.
    """
    numbers = F.sequence(F.expr(f"least div {size}"), F.expr(f"most div {size}"))
    parts = rows.select("id", "at", "context", "least", "most", F.explode(numbers).alias("cell"))
    parts = parts.select("id", "at", "context", "cell", F.expr(f"greatest(least, cell * {size})").alias("least"), F.expr(f"least(most, cell * {size} + {size - 1})").alias("most"))
    # the context begins at place - lo
    whole = F.expr(f"substring(context, cast(((at >> 7) & 127) - most + 1 AS int), cast(most - least + {LONG} AS int))")
    core = F.expr(f"substring(context, cast(((at >> 7) & 127) - cell * {size} + 1 AS int), {LONG - size + 1})")
    part = F.expr("cast((cell << 14) | (most << 7) | least AS int)")
    return parts.select("id", "at", part.alias("part"), F.xxhash64(whole).alias("u"), *([F.xxhash64(core).alias("core")] if size > 1 else []))


def contexts_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, at) to (id, at, context): the bytes that the windows of each wanted place cover."""
    for batch in in_blocks(batches, "text"):
        row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False))
        at = batch.column(2).flatten()
        place, lo, hi = unpacked(at.to_numpy())
        texts = as_bytes(batch.column(1))
        context = [texts[r][p - a : p - b + LONG] for r, p, a, b in zip(row.tolist(), place.tolist(), lo.tolist(), hi.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), at, pa.array(context, pa.binary())], ["id", "at", "context"])


def unpacked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return at >> 14, at >> 7 & 127, at & 127


def cut_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, at) to (id, n_bytes, kept, n_removed, n_spans)."""
    for batch in in_blocks(batches, "text"):
        kept, removed, spans, sizes = [], [], [], []
        for text, at in zip(as_bytes(batch.column(1)), batch.column(2), strict=True):
            sizes.append(len(text))
            if not at.is_valid:
                kept.append(text)
                removed.append(0)
                spans.append(0)
                continue
            place, lo, hi = unpacked(at.values.to_numpy())
            depth = np.bincount(place - lo, minlength=len(text) + 1) - np.bincount(place - hi + LONG, minlength=len(text) + 1)
            gone = np.cumsum(depth[:-1]) > 0
            removed.append(int(gone.sum()))
            spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
            kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())], ["id", "n_bytes", "kept", "n_removed", "n_spans"])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", batches: int | None = None) -> DataFrame:
    """(key, n_bytes, kept, n_removed, n_spans): kept is the text's bytes without what repeats earlier ones.

    Null and empty texts, and those under LONG bytes, stay whole; texts of any length are handled, in slices. key: a numeric column. Rows with a null key stay whole
    and mark nothing. Of repeated texts the one of least key stays. Rows that have a key in common: equal texts count as one text, and each of
    the rows gets its result; unlike texts of one key come in the order of their bytes. Other columns are left out.
    """
    own = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    keyed, repeated = own.where("id IS NOT NULL"), False
    if keyed.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        # a place in the order for each distinct text of a key: the key, then the text itself as bytes
        repeated, keyed = True, keyed.select(F.struct("id", F.coalesce("text", F.lit("")).cast("binary").alias("t")).alias("id"), "text").dropDuplicates(["id"])
        order = F.struct(F.col("id.id").alias("id"), F.col("n").alias("n"))
        rank = F.row_number().over(Window.partitionBy("id.id").orderBy("id.t"))
        keyed = saved(keyed.withColumn("n", rank).select(order.alias("id"), "text"))
    if batches is None:
        size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        batches = BATCHES + max(0, int(np.log2(max(size / FIRST_BYTES, 1))))
    number = F.col("id.id") if repeated else F.col("id")
    cuts = keyed.agg(F.percentile_approx(number, [k / batches for k in range(1, batches)], 1000)).first()[0] or []
    bounds = [None, *sorted(set(cuts)), None]
    family, marks = Family(), None
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        part = keyed if low is None else keyed.where(number > low)
        seen = family.add(part if high is None else part.where(number <= high))
        marks = seen if marks is None else marks.union(seen)
    marks = marks.union(family.compare(keyed)).groupBy("id").agg(F.collect_list("at").alias("at"))
    if repeated:
        marks = keyed.join(marks, "id").select(F.col("id.id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"), "at")
        joined = own.withColumn("t", F.xxhash64(F.coalesce("text", F.lit("")))).join(marks, ["id", "t"], "left")
    else:
        joined = own.join(marks, "id", "left")
    kind = docs.schema[key].dataType.simpleString()
    out = joined.select("id", "text", "at").mapInArrow(cut_block, f"id {kind}, n_bytes long, kept binary, n_removed long, n_spans long")
    return out.withColumnRenamed("id", key)
