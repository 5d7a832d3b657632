"""Mixing sources to target weights: exact block quotas, split among output shards, then disjoint permuted blocks. DataFrame functions only.

A source's words are laid end to end in an order given by hashes of its documents and cut into blocks of equal length (the last may be
shorter). A pass over the source draws its blocks in the order of a keyed permutation; the mix takes whole passes and then the first blocks
of one more, until the source's words are exactly its target. So each source has a whole number of block draws, its quota.

The quotas are dealt to the output shards down a binary tree: a node that has some draws of each source gives its left half as many as that
half's shards hold, by a multivariate hypergeometric draw, and the rest to the right. Shards then take the draws of each source in turn, so
no two have one in common, and each shard orders its pieces by a hash.

Only the table of sources (one row a source: its size, target, quota and shard bounds) is on the driver; documents are never gathered, and
texts never leave the first pass.
"""

from __future__ import annotations

import math
import zlib
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varspark.llm.common import saved
from varspark.llm.sharding import PRIME, permute, round_keys, sides, walk_steps

WORD = r"[^\x20\x09-\x0D]+"
#: A mix draws about as many blocks; their length grows with the corpus.
BLOCKS = 1 << 12
#: A document is taken at most so many times.
COPIES = 3
WEIGHTS = (1, 2, 3)
#: Rows of a bucket of the running sum, on average, if one source holds them all.
BUCKET = 1024
#: The hash that lays out a source has so many bits.
HASH_BITS = 60
#: The table of sources goes out with the plan below this size, else it is joined by shuffle.
BROADCAST_BYTES = 8 << 20


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, most: int = COPIES) -> list[float]:
    """Shares of the whole by weight (repeating), none above `most` times its size; the excess goes to the others by weight."""
    own = [weights[k % len(weights)] for k in range(len(sizes))]
    whole, full = sum(sizes), set()
    while True:
        left, weight = whole - sum(most * sizes[k] for k in full), sum(w for k, w in enumerate(own) if k not in full)
        over = {k for k in range(len(sizes)) if k not in full and own[k] * left > most * sizes[k] * weight}
        if not over:
            return [float(most * sizes[k]) if k in full else own[k] * left / weight for k in range(len(sizes))]
        full |= over


def epoch_seed(seed: int, epoch: int) -> str:
    return f"{seed}.{epoch}"


def position(k: int, blocks: int, seed: str) -> int:
    """The place of block k among a source's, in Python; the columns of drawn() do the same."""
    x = permute(k, blocks, seed)
    while x >= blocks:
        x = permute(x, blocks, seed)
    return x


def source_facts(sizes: list[int], block: int, seed: int) -> list[dict]:
    """Per source what its documents need to know: target, words to take, blocks, sides and steps of the permutations, place of the last
    block in each pass, and the quota of draws."""
    out = []
    for size, target in zip(sizes, targets(sizes), strict=True):
        words, blocks = math.floor(target + 0.5), -(-size // block)
        a, b = sides(blocks)
        seeds = [epoch_seed(seed, e) for e in range(COPIES)]
        own = {"source_size": size, "target": target, "words": words, "blocks": blocks, "a": a, "b": b, "steps": [walk_steps(blocks, s) for s in seeds], "last": [position(blocks - 1, blocks, s) if blocks else 0 for s in seeds]}
        passes, rest = divmod(words, size) if size else (0, 0)
        draws = 0
        if rest:
            last = own["last"][passes]
            short = size - (blocks - 1) * block
            draws = -(-rest // block) if rest <= last * block else last + 1 + max(0, -(-(rest - last * block - short) // block))
        out.append(own | {"quota": passes * blocks + draws})
    return out


def split_quotas(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """Draws of each source (column) for each shard (row). Shards hold equally many draws, up to one; each node of the tree has its own
    generator, so the result follows from the arguments alone."""
    whole, out = sum(quotas), np.zeros((shards, len(quotas)), np.int64)

    def down(first: int, last: int, own: np.ndarray) -> None:
        if last - first == 1:
            out[first] = own
            return
        middle = (first + last) // 2
        room = whole * middle // shards - whole * first // shards
        left = np.random.default_rng([seed, first, last]).multivariate_hypergeometric(own, room, method="marginals")
        down(first, middle, left)
        down(middle, last, own - left)

    if quotas:
        down(0, shards, np.array(quotas, np.int64))
    return out


def running_sum(df: DataFrame, group: str, key: str, ties: list[str], value: Column, name: str, rows: int) -> DataFrame:
    """df with column `name`: the sum of value over the rows of the group before this one, by key (HASH_BITS bits, uniform) and ties.

    Rows are summed in buckets of the key's first bits, buckets in spans of fewer bits, spans in the group: a window has about BUCKET rows,
    or the square root of the number of buckets, whatever the group holds.
    """
    bits = max(0, math.ceil(math.log2(max(rows, 1) / BUCKET)))
    df = df.withColumn("_value", value).withColumn("_bucket", F.shiftright(key, HASH_BITS - bits))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0).cast("long"))
    buckets = df.groupBy(group, "_bucket").agg(F.sum("_value").alias("_value")).withColumn("_span", F.shiftright("_bucket", bits // 2))
    spans = buckets.groupBy(group, "_span").agg(F.sum("_value").alias("_value"))
    spans = spans.select(group, "_span", so_far("_value", before(group).orderBy("_span")).alias("_from_span"))
    buckets = buckets.withColumn("_from", so_far("_value", before(group, "_span").orderBy("_bucket"))).join(spans, [group, "_span"])
    buckets = buckets.select(group, "_bucket", (F.col("_from") + F.col("_from_span")).alias("_from"))
    df = df.withColumn("_own", so_far("_value", before(group, "_bucket").orderBy(key, *ties)))
    return df.join(buckets, [group, "_bucket"]).withColumn(name, F.col("_own") + F.col("_from")).drop("_value", "_bucket", "_own", "_from")


def drawn(k: Column, epoch: int, seed: int) -> Column:
    """The place of block k in a pass, from the source's columns blocks, a, b and steps: the permutation of sharding.place with sides
    that differ by row."""
    keys = F.array(*(F.struct(F.lit(mul).cast("long").alias("mul"), F.lit(add).cast("long").alias("add"), F.lit(r % 2 == 0).alias("even")) for r, (mul, add) in enumerate(round_keys(epoch_seed(seed, epoch)))))
    a, b, div = F.col("a"), F.col("b"), lambda x, y: F.call_function("div", x, y)

    def turn(s: Column, key: Column) -> Column:
        t = (s.q * key.mul + key.add) % PRIME
        return F.struct(s.q.alias("p"), ((s.p + t * t % PRIME) % F.when(key.even, a).otherwise(b)).alias("q"))

    def once(x: Column) -> Column:
        return F.aggregate(keys, F.struct(div(x, b).alias("p"), (x % b).alias("q")), turn, lambda s: s.p * b + s.q)

    return F.aggregate(F.sequence(F.lit(1), F.col("steps")[epoch]), k, lambda x, i: F.when((i > 1) & (x < F.col("blocks")), x).otherwise(once(x)))


def within(x: Column, most: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.least(x, most))


def pieces_of(block: int, seed: int) -> Column:
    """What the mix takes of one document, from its place `start` in the source and the source's columns: for each pass, each block that
    the document has words in, the words taken of it (those from first_word on)."""
    start, size, div = F.col("start"), F.col("size"), lambda x, y: F.call_function("div", x, F.lit(y))
    length = lambda k: F.when(k == F.col("blocks") - 1, F.col("source_size") - k * block).otherwise(F.lit(block)).cast("long")

    def of_block(epoch: int, k: Column) -> Column:
        first, last = F.greatest(start, k * block), F.least(start + size, (k + 1) * block)
        rest = within(F.col("words") - epoch * F.col("source_size"), F.col("source_size"))

        def with_place(p: Column) -> Column:
            at = F.col("last")[epoch]
            before = p * block - F.when(at < p, block - length(F.col("blocks") - 1)).otherwise(F.lit(0))
            taken = within(within(rest - before, length(k)) - (first - k * block), last - first)
            return F.struct(F.lit(epoch).alias("epoch"), k.alias("block"), (epoch * F.col("blocks") + p).alias("draw"), (first - start).alias("first_word"), taken.alias("words"))

        return F.get(F.transform(F.array(drawn(k, epoch, seed)), with_place), F.lit(0))

    spans = F.sequence(div(start, block), div(start + size - 1, block))
    passes = [F.when((size > 0) & (F.col("words") > epoch * F.col("source_size")), F.transform(spans, partial(of_block, epoch))) for epoch in range(COPIES)]
    none = F.array().cast("array<struct<epoch:int,block:long,draw:long,first_word:long,words:long>>")
    return F.filter(F.concat(*(F.coalesce(p, none) for p in passes)), lambda x: x.words > 0)


def mix_documents(docs: DataFrame, shards: int = 16, seed: int = 12, blocks: int = BLOCKS) -> DataFrame:
    """One row per document: doc_id, source, text_md5, size (words), source_size, target, taken (words taken, repeats counted), pieces
    (array of epoch, block, shard, turn, first_word, words; `turn` orders a shard).

    Sources by code point, null last, weigh 1, 2, 3, repeating, and share all words; no target is above 3 times its source's size, so no
    document is taken more than 3 times. A source's taken words are its target, rounded. Documents without words (null, empty, white
    space) have no pieces. Rows alike in doc_id, source and text are laid side by side, each with its own words. Texts of any length: one
    that spans blocks gives a piece a block. Everything follows from the rows and the seed, not from their order. Other columns are not
    looked at; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    own = F.coalesce(F.col("text"), F.lit(""))
    short = docs.select("doc_id", "source", F.md5(own.cast("binary")).alias("text_md5"), F.regexp_count(own, F.lit(WORD)).cast("long").alias("size"))
    short = saved(short.groupBy("doc_id", "source", "text_md5", "size").agg(F.count("*").alias("copies")))
    sizes = short.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("size"), F.count("*").alias("rows")).collect()
    sizes.sort(key=lambda r: (r.source is None, (r.source or "").encode()))
    block = max(1, -(-sum(r.size for r in sizes) // blocks))
    facts = source_facts([r.size for r in sizes], block, seed)
    bounds = np.cumsum(split_quotas([f["quota"] for f in facts], shards, seed), axis=0)
    kind = "number int, source string, source_size long, target double, words long, blocks long, a long, b long, steps array<int>, last array<long>, quota long, bounds array<long>"
    names = [c.split()[0] for c in kind.split(", ")]
    rows = [f | {"number": k, "source": r.source, "bounds": [int(x) for x in bounds[:, k]]} for k, (r, f) in enumerate(zip(sizes, facts, strict=True))]
    table = spark.createDataFrame([tuple(r[c] for c in names) for r in rows], kind).withColumnRenamed("source", "_source")
    if len(rows) * (200 + 8 * shards) <= BROADCAST_BYTES:
        table = F.broadcast(table)
    laid = short.withColumn("_key", F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "text_md5").cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long"))
    numbers = table.select("number", "_source")
    laid = laid.join(F.broadcast(numbers) if len(rows) * 200 <= BROADCAST_BYTES else numbers, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    laid = running_sum(laid, "number", "_key", ["doc_id", "text_md5"], F.col("size") * F.col("copies"), "start", sum(r.rows for r in sizes))
    each = laid.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).withColumn("start", F.col("start") + F.col("_copy") * F.col("size"))
    each = each.join(table.drop("_source"), "number").withColumn("_pieces", pieces_of(block, seed))
    shard = lambda p: F.size(F.filter("bounds", lambda b: b <= p.draw))
    turn = lambda p: F.xxhash64(F.lit(zlib.crc32(b"turn") + seed), "doc_id", "text_md5", "_copy", p.epoch, p.block)
    pieces = F.transform("_pieces", lambda p: F.struct(p.epoch.alias("epoch"), p.block.alias("block"), shard(p).alias("shard"), turn(p).alias("turn"), p.first_word.alias("first_word"), p.words.alias("words")))
    taken = F.aggregate("_pieces", F.lit(0).cast("long"), lambda x, p: x + p.words)
    return each.select("doc_id", "source", "text_md5", "size", "source_size", "target", taken.alias("taken"), pieces.alias("pieces"))


def mixed_pieces(docs: DataFrame, **options) -> DataFrame:
    """One row per piece of the mix: shard, turn, source, doc_id, epoch, block, first_word, words and text (these words, by one space)."""
    mix = mix_documents(docs, **options).select("doc_id", "text_md5", "source", F.explode("pieces").alias("p")).select("doc_id", "text_md5", "source", "p.*")
    own = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select("doc_id", F.md5(own.cast("binary")).alias("text_md5"), own.alias("text")).dropDuplicates(["doc_id", "text_md5"])
    same = mix.doc_id.eqNullSafe(texts.doc_id) & (mix.text_md5 == texts.text_md5)
    words = F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.col("first_word").cast("int") + 1, F.col("words").cast("int"))
    return mix.join(texts, same).select("shard", "turn", "source", mix.doc_id, "epoch", "block", "first_word", "words", F.array_join(words, " ").alias("text"))


def write_shards(pieces: DataFrame, path: str) -> None:
    """The pieces as Parquet, a folder a shard, each file a range of its shard's turns, so a shard's files in order are its shuffle."""
    pieces.repartitionByRange("shard", "turn").sortWithinPartitions("shard", "turn").write.partitionBy("shard").parquet(path)
