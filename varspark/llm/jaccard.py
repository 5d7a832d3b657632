"""N-gram Jaccard join by vertical partitioning.

A text's set holds the 64-bit hashes of its distinct runs of GRAM words. All n-grams stand in one global order: by how many texts
hold an n-gram of the same of 2^18 hash buckets (a table of fixed size, counted over the whole corpus), rarest first, then by hash.
Any order gives the same links; this one keeps what many texts share at the end of each text's list, out of its prefix.

1. Texts with equal sets form a class; only one text of each, its representative, goes on.
2. Prefixes: two sets linked at T share an n-gram among the first |x| - ceil(T |x|) + 1 of each in the global order. Prefix n-grams
   that two or more representatives hold make the candidates; sizes and positions (the most that can still follow) cut them down.
   N-grams with the same holders, as those of one passage, are one from here on: the first of them in the global order, which stands
   first in each holder, and their number. (Were two sets of holders taken for one, they would only make more candidates.)
3. Dense groups would make the square of their size in pairs. So first every n-gram's holders are compared with one of them only, the
   leader, twice with different leaders; those linked are joined into components. Then the pairs that are left are those of holders
   in different components; pairs within one can't change the result. This loses no link between components. A pair of these goes on
   from those n-grams only that can be its first common one, as what can follow still reaches the limit.
   A crowded n-gram makes no row of a pair that an earlier crowded one, which the two rows name, makes already; so rows grow with the holders
   and with the pairs that may be links, not with each n-gram's holders squared.
   Before a pair is verified, the sketches of its two sets are compared: SKETCH bits, each the parity of the n-grams that fall on it.
   Bits that differ are at most the n-grams in one set only, so a pair goes only if it can't reach the limit. Pairs at random places of
   a dense group that fall short of the limit end here, in the join's own condition, not as rows. Sets of over SKETCH / 2 n-grams also have
   a wide sketch of twice their size in bits, which doesn't saturate; it ends what is left of the pairs that can't be linked before their
   texts are fetched.
4. Overlap of a pair: the global order is cut into FRAGMENTS by hash; every fragment of one set meets the same fragment of the other,
   the partial overlaps are counted separately and summed per pair; the sum decides exactly. The pair is one row while that happens.
5. Components of the links, by minima.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varspark.llm.common import as_bytes, connected_components, discard, in_blocks, mix64, release, saved, small_batches

BUCKETS = 18
FRAGMENTS = 8
SKETCH = 1024
#: Bytes of text that are worked on at once (arrays over them are 8 bytes a byte), and that Spark hands to Python at once.
PIECE = 1 << 18
BATCH = "1m"
#: An n-gram of that many holders is crowded; its rows carry up to EARLIER crowded ones before it.
CROWD = 16
EARLIER = 32
TURN = 0x9E3779B97F4A7C15

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, begin) of the words in `data`, which ends with a space; A-Z are lower-cased. From running sums of byte * turn^place modulo
    2^64, a piece of about PIECE bytes at a time, cut at spaces, so that a long text needs no more memory than its words."""
    found, begins, at = [], [], 0
    gaps = None if len(data) <= PIECE else np.flatnonzero(SPACE[data])
    while at < len(data):
        end = len(data) if gaps is None or len(data) - at <= PIECE else int(gaps[min(np.searchsorted(gaps, at + PIECE), len(gaps) - 1)]) + 1
        piece = LOWER[data[at:end]]
        gap = SPACE[piece]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).view(np.int8)))
        start, stop = edge[::2], edge[1::2]
        powers, back = turns(len(piece))
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * powers[: len(piece)], out=sums[1:])
        found.append(mix64((sums[stop] - sums[start]) * back[start] + (stop - start).astype(np.uint64)))
        begins.append(start + at)
        at = end
    none = np.empty(0, np.int64)
    return np.concatenate([none.view(np.uint64), *found]), np.concatenate([none, *begins])


HELD: list[np.ndarray] = []


def turns(n: int) -> list[np.ndarray]:
    """Powers of TURN and of its inverse, n at least; kept for the next piece up to PIECE."""
    if HELD and len(HELD[0]) >= n:
        return HELD
    out = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, PIECE), t, np.uint64)])) for t in (TURN, pow(TURN, -1, 1 << 64))]
    if n <= PIECE:
        HELD[:] = out
    return out


def sets_in(texts: list[bytes], gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The sets of a block of texts: hashes in order of text and value, and how many each text has. A set holds the distinct hashes of the
    text's runs of `gram` words, or of all its words if they are fewer."""
    data = np.frombuffer(b"\n".join([*texts, b""]) or b"\n", np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    h, begin = word_hashes(data)
    first = np.searchsorted(begin, np.cumsum(sizes) - sizes)
    words = np.diff(np.append(first, len(h)))
    factors = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(gram)], dtype=np.uint64)
    whole = max(len(h) - gram + 1, 0)
    run = np.full(whole, gram, np.uint64)
    for k in range(gram):
        run += h[k : k + whole] * factors[k]
    of = np.repeat(np.arange(len(texts)), words)
    keep = np.flatnonzero(of[:whole] == of[gram - 1 : gram - 1 + whole])
    hashes, text = [run[keep]], [of[keep]]
    for n in range(1, gram):
        own = np.flatnonzero(words == n)
        run = np.full(len(own), n, np.uint64)
        for k in range(n):
            run += h[first[own] + k] * factors[k]
        hashes.append(run)
        text.append(own)
    value, text = mix64(np.concatenate(hashes)).view(np.int64), np.concatenate(text)
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    return value[new], np.bincount(text[new], minlength=len(texts))


def bucket_of(hashes: np.ndarray) -> np.ndarray:
    return (mix64(hashes.view(np.uint64)) >> np.uint64(64 - BUCKETS)).astype(np.int64)


def parities(hashes: np.ndarray, of: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Sketches of several sets, one behind the other in 64-bit words: bits[k] parities of set k, a power of two."""
    begin = np.cumsum(bits) - bits
    odd = np.bincount(begin[of] + (hashes & (bits[of] - 1)), minlength=int(bits.sum())) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def sketch_bits(n: np.ndarray) -> np.ndarray:
    """Twice a set's size, as a power of two, SKETCH at least."""
    return np.maximum(SKETCH, 1 << np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64))


def lists(values: np.ndarray | pa.Array, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values if isinstance(values, pa.Array) else pa.array(values))


def bucket_counts(docs: DataFrame, text: str, gram: int) -> np.ndarray:
    """How many n-grams of all texts (distinct within a text) fall into each hash bucket."""

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BUCKETS, np.int64)
        for batch in in_blocks(batches, "text", PIECE):
            counts += np.bincount(bucket_of(sets_in(as_bytes(batch.column(0)), gram)[0]), minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["bucket", "n"])

    rows = docs.select(F.col(text).alias("text")).mapInArrow(block, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(1 << BUCKETS, np.int64)
    table[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return table


def sets_of(docs: DataFrame, key: str, text: str, gram: int, percent: int, table) -> DataFrame:
    """(id, n, signature, sketch, wide, prefix): prefix is the start of the set in the global order, as far as it can meet a partner's; sketch
    has SKETCH bits, wide as many as sketch_bits() says (null where that is no more)."""

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = table.value
        for batch in in_blocks(batches, "text", PIECE):
            h, n = sets_in(as_bytes(batch.column(1)), gram)
            of, begin = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
            raw = memoryview(h).cast("B")
            signs = [xxhash.xxh3_128_digest(raw[8 * a : 8 * (a + k)]) for a, k in zip(begin.tolist(), n.tolist(), strict=True)]
            sketches = parities(h, of, np.full(len(n), SKETCH))
            bits = sketch_bits(n)
            large = bits > SKETCH
            some = large[of]
            number = np.cumsum(large) - 1
            wide = parities(h[some], number[of[some]], bits[large])
            wide = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(large, bits // 64, 0))]).astype(np.int32), mask=np.append(~large, False)), pa.array(wide))
            order = np.lexsort((h, ranks[bucket_of(h)], of))
            probe = np.where(n > 0, n - -(-percent * n // 100) + 1, 0)
            kept = order[np.arange(len(h)) - begin[of] < probe[of]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(signs, pa.binary()), lists(sketches, np.full(len(n), SKETCH // 64)), wide, lists(h[kept], probe)], ["id", "n", "signature", "sketch", "wide", "prefix"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(block, f"id {kind}, n long, signature binary, sketch array<long>, wide array<long>, prefix array<long>")


def fragments_of(texts: DataFrame, gram: int) -> DataFrame:
    """(x, y, text) to (x, y, parts): the set of the text cut into FRAGMENTS ranges of hashes."""
    bounds = np.linspace(-(1 << 63), (1 << 63) - 1, FRAGMENTS + 1)[1:-1].astype(np.int64)

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_blocks(batches, "text", PIECE):
            h, n = sets_in(as_bytes(batch.column(2)), gram)
            # hashes stand in order of text and value, so a fragment of a text is a run of them
            cell = np.repeat(np.arange(len(n)), n) * FRAGMENTS + np.searchsorted(bounds, h, side="right")
            parts = lists(lists(h, np.bincount(cell, minlength=len(n) * FRAGMENTS)), np.full(len(n), FRAGMENTS))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), parts], ["x", "y", "parts"])

    kind = texts.schema["x"].dataType.simpleString()
    return texts.mapInArrow(block, f"x {kind}, y {kind}, parts array<array<long>>")


def linked(pairs: DataFrame, texts: DataFrame, gram: int, percent: int) -> DataFrame:
    """Of the candidate pairs (x, y) those that are links: overlaps counted fragment by fragment, summed per pair. texts: (own, text).

    A pair is one row that holds both sets by fragments; a fragment of one set meets the same fragment of the other only. A y with many
    partners is a hot key of an ordinary join, which Spark splits."""
    one = fragments_of(pairs.join(texts, pairs.x == texts.own).select("x", "y", "text"), gram)
    two = pairs.select("y").distinct().join(texts, F.col("y") == texts.own).select(F.col("y").alias("x"), "y", "text")
    two = fragments_of(two, gram).select("y", F.col("parts").alias("others"))
    mine, theirs = ([F.col(name)[k] for k in range(FRAGMENTS)] for name in ("parts", "others"))
    total = lambda counts: sum(counts, F.lit(0))
    common = total(F.size(F.array_intersect(a, b)) for a, b in zip(mine, theirs, strict=True))
    sizes = total(F.size(c) for c in (*mine, *theirs))
    counted = one.join(two, "y").select("x", "y", common.alias("common"), sizes.alias("sizes"))
    return counted.where(100 * F.col("common") >= percent * (F.col("sizes") - F.col("common"))).select(F.col("x").alias("src"), F.col("y").alias("dst"))


def needed(percent: int) -> str:
    """The least overlap of sets of nx and ny that are linked."""
    return f"(({percent} * (nx + ny) + {99 + percent}) div {100 + percent})"


def index_length(percent: int) -> str:
    """The start of x that must hold an n-gram of the prefix of a y of its size or larger, if they are linked."""
    return f"(nx - (({2 * percent} * nx + {99 + percent}) div {100 + percent}) + 1)"


def possible(percent: int) -> str:
    """Whether holders x (the smaller or equal) and y of one prefix n-gram, their first common one, can be linked, by sizes and positions."""
    return f"100 * nx >= {percent} * ny AND ax < {index_length(percent)} AND 1 + least(nx - ax - 1, ny - ay - 1) >= {needed(percent)}"


def alike(percent: int) -> str:
    """Whether the sketches sx and sy leave a link possible: each bit that differs is an n-gram that only one of the sets has."""
    differ = " + ".join(f"bit_count(sx[{k}] ^ sy[{k}])" for k in range(SKETCH // 64))
    return f"nx + ny - ({differ}) >= 2 * {needed(percent)}"


def still_alike(pairs: DataFrame, wide: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y, nx, ny) whose wide sketches leave a link possible; pairs of small sets have none, and stay. wide: (own, bits).

    Of sketches of unlike sizes the larger is folded: the parities of both its halves together are those of the smaller size. Sizes of sets
    that can be linked differ by less than a factor of two, so once is enough.
    """
    of_x, of_y = (wide.select(F.col("own").alias(v), F.col("bits").alias(f"w{v}")) for v in "xy")
    met = pairs.join(of_x, "x", "left").join(of_y, "y", "left")
    half = lambda w: F.expr(f"zip_with(slice({w}, 1, size({w}) div 2), slice({w}, (size({w}) div 2) + 1, size({w}) div 2), (a, b) -> a ^ b)")
    a = F.when(F.size("wx") > F.size("wy"), half("wx")).otherwise(F.col("wx"))
    b = F.when(F.size("wy") > F.size("wx"), half("wy")).otherwise(F.col("wy"))
    differ = F.aggregate(F.zip_with(a, b, lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda n, k: n + k)
    fits = F.expr("nx + ny") - differ >= F.expr(f"2 * {needed(percent)}")
    return met.where(F.coalesce(fits, F.lit(True))).select("x", "y", "nx", "ny")


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", gram: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id): components of texts whose sets have 100 * overlap >= percent * union.

    key must be an integer column that tells documents apart: rows of one key with unlike texts count as one document with links of
    any of them. A text with fewer than `gram` words is one n-gram as a whole; a null text or one without words has an empty set, links
    with nothing and is its own component. Texts of any length give their whole set. Repeated rows each give a row. A null key takes no part and has null as component. Other
    columns are left out.
    """
    with small_batches(docs.sparkSession, BATCH):  # all Python runs in here; what is returned only reads tables
        return _components(docs, key, text, gram, percent)


def _components(docs: DataFrame, key: str, text: str, gram: int, percent: int) -> DataFrame:
    spark = docs.sparkSession
    counts = spark.sparkContext.broadcast(bucket_counts(docs, text, gram))
    sets = saved(sets_of(docs, key, text, gram, percent, counts))
    release(spark)

    # 1. classes of equal sets, each by its least id
    reps = saved(sets.where("n > 0 AND id IS NOT NULL").groupBy("signature", "n").agg(F.min("id").alias("rep")))
    firsts = sets.join(reps, (sets.id == reps.rep) & (sets.signature == reps.signature), "left_semi").dropDuplicates(["id", "signature"])

    sketches = saved(firsts.select("id", "n", "sketch", "wide"))
    # rows of one key with unlike texts: no one sketch speaks for them, so they have none
    wide = sketches.where("wide IS NOT NULL").groupBy("id").agg(F.count("*").alias("k"), F.first("wide").alias("bits")).where("k = 1").select(F.col("id").alias("own"), "bits")
    of_x, of_y = (sketches.select(F.col("id").alias(v), F.col("n").alias(f"n{v}"), F.col("sketch").alias(f"s{v}")) for v in "xy")

    # 2. prefix n-grams that several representatives hold; those with the same holders, known by the xor of these, go on as one
    index = firsts.select(F.col("id").alias("x"), F.col("n").alias("nx"), F.posexplode("prefix").alias("ax", "gram"))
    several = index.groupBy("gram").agg(F.count("*").alias("k"), F.bit_xor(F.xxhash64("x")).alias("h")).where("k > 1").select("gram", "h")
    index = saved(index.join(several, "gram").groupBy("x", "nx", "h").agg(F.min("ax").alias("ax"), F.count("*").alias("w")))
    release(spark)
    holders = index.select(F.col("x").alias("own")).distinct()
    texts = saved(docs.select(F.col(key).alias("own"), F.col(text).alias("text")).join(holders, "own"))
    release(spark)

    # 3. two turns against leaders, then every pair of unlike components
    component = None
    for turn in range(3):
        held = index.withColumn("c", F.col("x")) if component is None else index.join(component, index.x == component.id, "left").select("x", "nx", "h", "ax", "w", F.coalesce("component_id", "x").alias("c"))
        held = saved(held)
        leader = F.min_by(F.struct("x", "nx", "ax", "c"), F.xxhash64("x", F.lit(turn)))
        mixed = held.groupBy("h").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), leader.alias("l"), F.count("*").alias("k")).where("c0 != c1")
        if turn < 2:
            met = held.join(mixed.select("h", "l"), "h").where("c != l.c")
            own, other = F.struct("nx", "x", "ax"), F.struct(F.col("l.nx").alias("nx"), F.col("l.x").alias("x"), F.col("l.ax").alias("ax"))
            met = met.select("x", "w", F.col("l.x").alias("l"), F.least(own, other).alias("a"), F.greatest(own, other).alias("b"))
            met = met.select(F.col("x").alias("f"), "w", "l", F.col("a.x").alias("x"), F.col("a.nx").alias("nx"), F.col("b.x").alias("y"), F.col("b.nx").alias("ny")).where(f"100 * nx >= {percent} * ny")
            # each holder is compared with the leader that shares most with it, of those whose sketch is like its own
            met = met.groupBy("f", "l", "x", "y", "nx", "ny").agg(F.sum("w").alias("c"))
            met = met.join(of_x, ["x", "nx"]).join(of_y, ["y", "ny"]).where(alike(percent))
            best = met.groupBy("f").agg(F.max_by(F.struct("x", "y", "nx", "ny"), F.struct("c", "l")).alias("p"))
            pairs = best.select("p.*").distinct()
        else:
            one = held.join(mixed.select("h", "k"), "h").join(of_x, ["x", "nx"])
            crowded = F.col("k") >= CROWD
            earlier = F.collect_list("h").over(Window.partitionBy("x", "nx", crowded).orderBy("ax").rowsBetween(-EARLIER, -1))
            one = saved(one.withColumn("ex", F.when(crowded, earlier)).drop("w", "k"))
            two = one.select(F.col("h").alias("h2"), F.col("x").alias("y"), F.col("nx").alias("ny"), F.col("ax").alias("ay"), F.col("c").alias("cy"), F.col("sx").alias("sy"), F.col("ex").alias("ey"))
            near = f"(nx < ny OR nx = ny AND x < y) AND {possible(percent)}"
            # a pair's first common n-gram always is at possible places, so rows of its others need not be made
            new = "NOT coalesce(arrays_overlap(ex, ey), false)"
            met = one.where(f"ax < {index_length(percent)}").join(two, F.expr(f"h = h2 AND c != cy AND {near} AND {new} AND {alike(percent)}"))
            pairs = met.select("x", "y", "nx", "ny").distinct()
        pairs = saved(still_alike(saved(pairs), wide, percent))
        # the components so far are stars, which stand for all links that made them
        edges, stars = linked(pairs, texts, gram, percent), component
        component = connected_components(edges if stars is None else edges.union(stars))
        for spent in (held, pairs) if stars is None else (held, pairs, stars):
            discard(spent)
        release(spark)

    for spent in (index, texts, sketches):
        discard(spent)
    groups = component.select(F.col("id").alias("rep"), "component_id")
    of_class = reps.join(groups, "rep", "left").select("signature", "n", F.coalesce("component_id", "rep").alias("component_id"))
    return sets.join(of_class, ["signature", "n"], "left").select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
