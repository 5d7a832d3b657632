"""Sharding by a Feistel permutation of global row numbers, with cycle walking. DataFrame functions only.

Rows are numbered 0 to N-1 in the order of their keys. Row n goes to place p(n), where p is a keyed permutation of 0 to N-1;
its shard is p mod shards and its slot there p div shards. So counts differ by one at most, slots have no gaps, and both follow
from (n, N, seed, shards) alone. The permutation is a Feistel network over pairs (u, v) with u < a, v < b, where a = ceil(sqrt(N))
and b = ceil(N / a); it permutes a * b >= N numbers, and a place of N or more is permuted again until it is below N (cycle walking).
Fewer than a numbers lie beyond N; following each of them on the driver gives the exact number of steps that any row can need.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varspark.llm.common import saved

PRIME = (1 << 31) - 1
ROUNDS = 6


def round_keys(seed: int) -> list[tuple[int, int]]:
    digest = [hashlib.sha256(f"{seed}:{k}".encode()).digest() for k in range(ROUNDS)]
    return [(1 + int.from_bytes(d[:4], "big") % (PRIME - 1), int.from_bytes(d[4:8], "big") % PRIME) for d in digest]


def sides(rows: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(rows, 1) - 1) + 1)
    return a, max(1, -(-rows // a))


def permute(x: int, rows: int, seed: int) -> int:
    """One pass of the network in Python; the result can lie beyond rows."""
    a, b = sides(rows)
    (p, q), (m, n) = divmod(x, b), (a, b)
    for mul, add in round_keys(seed):
        t = (q * mul + add) % PRIME
        p, q, m, n = q, (p + t * t % PRIME) % m, n, m
    return p * b + q


def walk_steps(rows: int, seed: int) -> int:
    """The most passes that a row can need: one, and those from the numbers beyond rows (fewer than sqrt(rows) + 1)."""
    a, b = sides(rows)
    most = 0
    for start in range(rows, a * b) if rows else ():
        x, steps = permute(start, rows, seed), 1
        while x >= rows and x != start:
            x, steps = permute(x, rows, seed), steps + 1
        if x < rows:  # else the cycle lies beyond rows as a whole and no row comes by
            most = max(most, steps)
    return 1 + most


def place(n: Column, rows: int, seed: int) -> Column:
    """The place of row number n among 0 to rows-1."""
    a, b = sides(rows)
    keys = F.array(*(F.struct(F.lit(mul).cast("long").alias("mul"), F.lit(add).cast("long").alias("add"), F.lit(a if k % 2 == 0 else b).cast("long").alias("m")) for k, (mul, add) in enumerate(round_keys(seed))))

    def turn(s: Column, k: Column) -> Column:
        t = (s.q * k.mul + k.add) % PRIME
        return F.struct(s.q.alias("p"), ((s.p + t * t % PRIME) % k.m).alias("q"))

    def once(x: Column) -> Column:
        start = F.struct(F.call_function("div", x, F.lit(b)).alias("p"), (x % b).alias("q"))
        return F.aggregate(keys, start, turn, lambda s: s.p * b + s.q)

    steps = F.sequence(F.lit(1), F.lit(walk_steps(rows, seed)))
    return F.aggregate(steps, n, lambda x, i: F.when((i > 1) & (x < rows), x).otherwise(once(x)))


def numbered(df: DataFrame, keys: list[str], name: str = "row_number") -> DataFrame:
    """Global row numbers 0 to N-1 in the order of keys (nulls first), as column `name`. Rows that agree in all keys are numbered in any order.

    Range partitions are sorted and written with their own numbers; the counts of the partitions (as many as partitions, never more)
    then give each its first number.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    laid = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    laid = saved(laid)
    first, offsets = 0, []
    for part, n in laid.groupBy("_part").count().orderBy("_part").collect():
        offsets.append((part, first))
        first += n
    at = spark.createDataFrame(offsets, "_part int, _first long")
    return laid.join(F.broadcast(at), "_part").withColumn(name, F.col("_first") + F.col("_at")).drop("_part", "_at", "_first")


def shard_rows(df: DataFrame, keys: list[str], shards: int = 16, seed: int = 2029) -> DataFrame:
    """df with row_number, shard and slot. Columns of these names (and _part, _at, _first) in df are replaced.

    Nulls in keys sort first; rows alike in every key take their numbers in any order, which only tells apart rows that are the same.
    An empty table gives an empty table.
    """
    df = numbered(df.drop("row_number", "shard", "slot", "_part", "_at", "_first"), keys)
    rows = df.count()
    where = place(F.col("row_number"), rows, seed)
    return df.withColumn("_place", where).withColumns({"shard": (F.col("_place") % shards).cast("int"), "slot": F.call_function("div", F.col("_place"), F.lit(shards))}).drop("_place")


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = 2029) -> DataFrame:
    """One row per document: doc_id, size (UTF-8 bytes of the text, null as none, plus 1), text_crc32, law, shard, slot, grown_shard.

    Only these short columns are dealt out and sorted, never the texts. The order is by doc_id, then checksum, then size.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    short = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shard_rows(short, ["doc_id", "text_crc32", "size"], shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")
