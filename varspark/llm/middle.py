"""Fill-in-middle: a text is cut at two of its unit boundaries and written in the order prefix, suffix, middle or suffix, prefix, middle.

The boundaries of a text are a set of byte offsets in containers of 2^16 numbers, each an array of its low halves, a bitmap, or runs,
whichever is smallest, with cumulative cardinalities over the containers. The offset after the k-th unit is a search over these, then
a select within one container. Containers are built one after the other, so beside the text and its set no array is longer than a container.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varspark.llm.common import as_bytes

BITS = 16
SPAN = 1 << BITS
#: The marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
FORMS = ("plain", "psm", "spm")
UNITS = ("words", "characters")
#: The white space that separates words.
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


class Boundaries:
    """A set of numbers, added a container at a time in rising order."""

    def __init__(self) -> None:
        self.high: list[int] = []
        self.kinds: list[str] = []
        self.data: list[np.ndarray] = []
        self.before = [0]

    def __len__(self) -> int:
        return self.before[-1]

    def add(self, high: int, low: np.ndarray) -> None:
        """The numbers high * 2^16 + low; low: distinct and sorted. An empty container isn't kept."""
        if not len(low):
            return
        breaks = np.flatnonzero(np.diff(low.astype(np.int64)) != 1)
        sizes = {"array": 2 * len(low), "bitmap": SPAN // 8, "runs": 4 * (len(breaks) + 1)}
        kind = min(sizes, key=sizes.__getitem__)
        if kind == "array":
            data = low.astype(np.uint16)
        elif kind == "bitmap":
            bits = np.zeros(SPAN, np.uint8)
            bits[low] = 1
            data = np.packbits(bits, bitorder="little").view("<u8")
        else:
            starts = low[np.concatenate(([0], breaks + 1))]
            ends = low[np.concatenate((breaks, [len(low) - 1]))]
            data = np.stack((starts, ends - starts)).astype(np.uint16)
        self.high.append(high)
        self.kinds.append(kind)
        self.data.append(data)
        self.before.append(self.before[-1] + len(low))

    def select(self, k: int) -> int:
        """The number with k smaller ones in the set; k from 0 to len - 1."""
        at = bisect_right(self.before, k) - 1
        k -= self.before[at]
        data = self.data[at]
        if self.kinds[at] == "array":
            low = int(data[k])
        elif self.kinds[at] == "bitmap":
            ends = np.cumsum(np.bitwise_count(data), dtype=np.int64)
            word = int(np.searchsorted(ends, k, side="right"))
            k -= int(ends[word - 1]) if word else 0
            low = 64 * word + int(np.flatnonzero(np.unpackbits(data[word : word + 1].view(np.uint8), bitorder="little"))[k])
        else:
            ends = np.cumsum(data[1].astype(np.int64) + 1)
            run = int(np.searchsorted(ends, k, side="right"))
            low = int(data[0, run]) + k - (int(ends[run - 1]) if run else 0)
        return (self.high[at] << BITS) + low


def boundaries_of(text: bytes, unit: str = "words") -> Boundaries:
    """The last byte of each unit: a word with the white space before it, and the white space at the end; or a character."""
    b, out = np.frombuffer(text, np.uint8), Boundaries()
    for first in range(0, len(b), SPAN):
        own, after = b[first : first + SPAN], b[first + 1 : first + SPAN + 1]
        if unit == "words":
            ends = ~SPACE[own[: len(after)]] & SPACE[after]
        else:
            ends = (after & 0xC0) != 0x80
        low = np.flatnonzero(ends)
        if len(after) < len(own):  # the text's last byte always ends a unit
            low = np.append(low, len(own) - 1)
        out.add(first >> BITS, low)
    return out


def characters(text: bytes, first: int, last: int) -> int:
    """Code points that begin in text[first:last]."""
    b = np.frombuffer(text, np.uint8)
    return sum(int(np.count_nonzero((b[k : min(k + SPAN, last)] & 0xC0) != 0x80)) for k in range(first, last, SPAN))


def cut(text: bytes, one: int, two: int, unit: str = "words") -> tuple[int, int, int]:
    """Units of the text, n, and the code points of prefix and middle: the cuts come after one % (n + 1) and two % (n + 1) units."""
    units = boundaries_of(text, unit)
    n = len(units)
    first, last = (units.select(k - 1) + 1 if k else 0 for k in sorted((one % (n + 1), two % (n + 1))))
    return n, characters(text, 0, first), characters(text, first, last)


def cuts(unit: str):
    @F.arrow_udf("n long, prefix long, middle long")
    def of(texts: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
        rows = [cut(t, a, b, unit) for t, a, b in zip(as_bytes(texts), one.to_pylist(), two.to_pylist(), strict=True)]
        columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 3
        return pa.StructArray.from_arrays(columns, ["n", "prefix", "middle"])

    return of


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 42, plain_percent: int = 50, spm_percent: int = 80, unit: str = "words") -> DataFrame:
    """docs with n_units, form (plain, psm, spm), prefix_chars and middle_chars (code points, null if plain) and output.

    The four numbers h1 to h4 that decide (two cuts, whether, which order) are the first 8-digit groups of the hex sha256 of `seed:key`, so
    a row is cut alike wherever it stands. A text that is empty or holds a mark stays plain, so that every output gives its text back.
    A null text is empty, a null key hashes as an empty one; rows of one key and text are cut alike, each once. Texts of any length are
    cut as a whole. An empty table gives an empty one. Columns of docs with the names of the results are replaced.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]
    own = F.coalesce(F.col(text), F.lit(""))
    df = docs.drop("n_units", "form", "prefix_chars", "middle_chars", "output", "_cut")
    df = df.withColumn("_cut", cuts(unit)(F.col(text), h[0], h[1]))
    stays = (own == "") | F.contains(own, F.lit(MARKS[0])) | F.contains(own, F.lit(MARKS[1])) | F.contains(own, F.lit(MARKS[2])) | (h[2] % 100 >= plain_percent)
    form = F.when(stays, FORMS[0]).when(h[3] % 100 < spm_percent, FORMS[2]).otherwise(FORMS[1])
    df = df.withColumns({"n_units": F.col("_cut.n"), "form": form, "_p": F.col("_cut.prefix"), "_m": F.col("_cut.middle")})
    p, m = F.col("_p"), F.col("_m")
    prefix, middle, suffix = F.substr(own, F.lit(1), p), F.substr(own, p + 1, m), F.substr(own, p + m + 1)
    psm = F.concat(F.lit(MARKS[0]), prefix, F.lit(MARKS[1]), suffix, F.lit(MARKS[2]), middle)
    spm = F.concat(F.lit(MARKS[1]), suffix, F.lit(MARKS[0]), prefix, F.lit(MARKS[2]), middle)
    output = F.when(F.col("form") == FORMS[0], own).when(F.col("form") == FORMS[1], psm).otherwise(spm)
    cutting = F.col("form") != FORMS[0]
    return df.withColumns({"prefix_chars": F.when(cutting, p), "middle_chars": F.when(cutting, m), "output": output}).drop("_cut", "_p", "_m")


def restored(output: Column, form: Column) -> Column:
    """The text from an output and its form alone. No text with a mark is cut, so each mark is found where it was written."""

    def between(body: Column, mark: str) -> tuple[Column, Column]:
        head = F.substring_index(body, mark, 1)
        return head, F.substr(body, F.length(head) + len(mark) + 1)

    body = F.substr(output, F.lit(len(MARKS[0]) + 1))
    prefix, rest = between(body, MARKS[1])
    suffix, middle = between(rest, MARKS[2])
    s, rest = between(body, MARKS[0])
    p, m = between(rest, MARKS[2])
    return F.when(form == FORMS[1], F.concat(prefix, middle, suffix)).when(form == FORMS[2], F.concat(p, m, s)).otherwise(output)
