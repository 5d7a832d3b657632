"""Clusters of structural variants: islands of rows that can share a cluster first, the greedy step within each."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varspark.operators.intervals import islands


@dataclass
class Open:
    """A cluster that later rows can still join: its number, the length of its longest member, the least end of all members, the last begin
    that a row may have to overlap each member by enough, and the first member's begin."""

    number: int
    longest: int
    least_end: int
    reach: int
    begin: int


class Sweep:
    """Cluster numbers for the rows of one island, given in order of begin, end, id. A row joins the first cluster whose members it all
    overlaps by min_overlap (INS and BND: whose first member's point is within the slack), or opens one.

    As begins only rise, whether a row overlaps all members follows from three numbers of the cluster, and a cluster whose reach lies
    before a begin is closed. So what is held is what is open at one place.
    """

    def __init__(self, min_overlap: float, slack_ins: int, slack_bnd: int):
        self.min_overlap, self.slack = min_overlap, {"INS": slack_ins, "BND": slack_bnd}
        self.open: list[Open] = []
        self.count = 0

    def reach(self, begin: int, end: int, kind: str) -> int:
        return end + self.slack[kind] - 1 if kind in self.slack else end - math.ceil(self.min_overlap * (end - begin))

    def fits(self, c: Open, begin: int, end: int, kind: str) -> bool:
        if kind in self.slack:
            return end + self.slack[kind] > c.begin
        length = end - begin
        return length >= self.min_overlap * c.longest and c.least_end - begin >= self.min_overlap * length

    def place(self, begin: int, end: int, kind: str) -> int:
        self.open = [c for c in self.open if c.reach >= begin]
        reach = self.reach(begin, end, kind)
        for c in self.open:
            if self.fits(c, begin, end, kind):
                if kind not in self.slack:
                    c.longest, c.least_end, c.reach = max(c.longest, end - begin), min(c.least_end, end), min(c.reach, reach)
                return c.number
        self.open.append(Open(self.count, end - begin, end, reach, begin))
        self.count += 1
        return self.count - 1


def reach_of(min_overlap: float, slack_ins: int, slack_bnd: int) -> Column:
    """As Sweep.reach: behind it no row can begin and share a cluster with this one."""
    b, e = F.col("b").cast("long"), F.col("e").cast("long")
    return F.when(F.col("sv_type") == "INS", e + slack_ins - 1).when(F.col("sv_type") == "BND", e + slack_bnd - 1).otherwise(e - F.ceil(F.lit(min_overlap) * (e - b)))


def clustered(df: DataFrame, keys: list[str], min_overlap: float = 0.8, slack_ins: int = 50, slack_bnd: int = 50) -> DataFrame:
    """df (sv_id, chrom_no, sv_type, b, e, ...) with `cluster`, a text that is one per cluster. keys hold sv_type.

    Rows of different keys can't share a cluster, nor can rows without a chain of begins within reaches between them. A reach is a fifth of
    a variant's length at min_overlap 0.8, so these islands are many more than chains of overlaps. The greedy step goes over sorted rows,
    an island at a time; islands are dealt out by their hash, more of them than contigs and types.
    """
    padded = df.withColumns({"_pb": F.col("b").cast("long"), "_pe": reach_of(min_overlap, slack_ins, slack_bnd) + 1})
    placed = islands(padded, keys, "_pb", "_pe", ["e", "sv_id"]).drop("_pb", "_pe")
    names = [*keys, "island"]
    text = F.concat_ws(":", *(F.col(k).cast("string") for k in names))
    few = placed.select(text.alias("place"), "sv_id", "sv_type", F.col("b").cast("long").alias("b"), F.col("e").cast("long").alias("e"))

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for rows in batches:
            out = []
            for place, kind, begin, end in zip(rows.place, rows.sv_type, rows.b, rows.e, strict=True):
                if place != now:
                    now, state = place, Sweep(min_overlap, slack_ins, slack_bnd)
                out.append(f"{place}:{state.place(begin, end, kind)}")
            yield rows[["sv_id"]].assign(cluster=out)

    kind = df.schema["sv_id"].dataType.simpleString()
    dealt = few.repartition("place").sortWithinPartitions("place", "b", "e", "sv_id")
    return df.join(dealt.mapInPandas(step, f"sv_id {kind}, cluster string"), "sv_id")


def cluster_svs(df: DataFrame, sums: list[str], keys: list[str] | None = None, min_overlap: float = 0.8, slack_ins: int = 50, slack_bnd: int = 50) -> DataFrame:
    """One row per cluster: chrom_no, sv_type, b and e of its first row (by b, e, sv_id), the sums of the columns named, and its size."""
    keys = keys or ["chrom_no", "sv_type"]
    rows = clustered(df, keys, min_overlap, slack_ins, slack_bnd)
    first = F.min(F.struct("b", "e", "sv_id")).alias("first")
    out = rows.groupBy("cluster", *keys).agg(first, *(F.sum(c).alias(c) for c in sums), F.count("*").alias("size"))
    return out.select(*keys, "first.b", "first.e", F.col("first.sv_id").alias("sv_id"), *sums, "size")


def merge_callers(df: DataFrame, min_overlap: float = 0.8, slack_ins: int = 50, slack_bnd: int = 50) -> DataFrame:
    """Records of a case (case_id, sv_id, chrom_no, sv_type, b, e, callers) that several callers found, as one with all their callers."""
    keys = ["case_id", "chrom_no", "sv_type"]
    rows = clustered(df, keys, min_overlap, slack_ins, slack_bnd)
    out = rows.groupBy("cluster", *keys).agg(F.min(F.struct("b", "e", "sv_id")).alias("first"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("callers")))).alias("callers"))
    return out.select(*keys, "first.b", "first.e", F.col("first.sv_id").alias("sv_id"), "callers")


