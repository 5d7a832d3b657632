"""Running values over range partitions, islands and the greedy step against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from varspark.operators import cluster, intervals


def rows_of(seed, n, hot=0.5):
    """Random variants, a share of them of one contig and type."""
    draw = random.Random(seed)
    out = []
    for k in range(n):
        chrom, kind = (1, "DEL") if draw.random() < hot else (draw.randrange(3), draw.choice(["DEL", "INV", "INS", "BND"]))
        b = draw.randrange(3000)
        out.append((k, chrom, kind, b, b + draw.choice([0, 1, 5, 50, 300, 320, 350, 2000]) if kind not in ("INS", "BND") else b + 1))
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "sv_id long, chrom_no int, sv_type string, b long, e long")


@pytest.mark.parametrize(("how", "inclusive"), [("max", True), ("max", False), ("sum", True), ("sum", False)])
def test_running(spark, how, inclusive):
    rows = rows_of(1, 400)
    keys, order = ["chrom_no", "sv_type"], ["b", "e", "sv_id"]
    laid = intervals.laid_out(table(spark, rows), keys, order)
    assert laid.where("chrom_no = 1 AND sv_type = 'DEL'").select("_part").distinct().count() > 1
    got = {r.sv_id: r.out for r in intervals.running(laid, keys, order, F.col("e"), "out", how, inclusive).collect()}
    for k, chrom, kind, b, e in rows:
        before = [r[4] for r in rows if r[1:3] == (chrom, kind) and ((r[3], r[4], r[0]) < (b, e, k) or (inclusive and r[0] == k))]
        assert got[k] == ((max(before) if before else None) if how == "max" else sum(before))


@pytest.mark.parametrize("n", [0, 1, 500])
def test_islands(spark, n):
    rows = [(k, c, t, b, e + 1) for k, c, t, b, e in rows_of(2, n)]
    got = {r.sv_id: (r.chrom_no, r.sv_type, r.island) for r in intervals.islands(table(spark, rows), ["chrom_no", "sv_type"], "b", "e").collect()}
    reach, number, want = {}, {}, {}
    for k, c, t, b, e in sorted(rows, key=lambda r: (r[3], r[4])):
        if b >= reach.get((c, t), -1):
            number[c, t] = number.get((c, t), 0) + 1
        reach[c, t] = max(reach.get((c, t), -1), e)
        want[k] = (c, t, number[c, t])
    assert got == want


def greedy(rows, min_overlap, slack):
    """Every row against every member of every cluster."""
    groups, out = {}, {}
    for k, chrom, kind, b, e in sorted(rows, key=lambda r: (r[3], r[4], r[0])):
        own = groups.setdefault((chrom, kind), [])
        for c in own:
            if kind in ("INS", "BND"):
                fits = b - slack < c[0][1] and e + slack > c[0][0]
            else:
                fits = all(min(e, y) - max(b, x) >= min_overlap * max(e - b, y - x) for x, y, _ in c)
            if fits:
                c.append((b, e, k))
                break
        else:
            own.append([(b, e, k)])
    for own in groups.values():
        for c in own:
            out |= dict.fromkeys((m[2] for m in c), c[0][2])
    return out


@pytest.mark.parametrize(("min_overlap", "slack", "seed"), [(0.8, 50, 3), (0.5, 10, 4), (0.75, 0, 5), (1.0, 50, 6)])
def test_clusters_are_the_greedy_ones(spark, min_overlap, slack, seed):
    rows = rows_of(seed, 600)
    got = cluster.clustered(table(spark, rows), ["chrom_no", "sv_type"], min_overlap, slack, slack).collect()
    want, first = greedy(rows, min_overlap, slack), {}
    for r in sorted(got, key=lambda r: (r.b, r.e, r.sv_id)):
        first.setdefault(r.cluster, r.sv_id)
    assert {r.sv_id: first[r.cluster] for r in got} == want


def test_closed_clusters_are_let_go():
    sweep = cluster.Sweep(0.8, 50, 50)
    most = 0
    for k in range(5000):  # each overlaps the next ones, none by enough for long
        sweep.place(10 * k, 10 * k + 300, "DEL")
        most = max(most, len(sweep.open))
    assert most < 10 and sweep.count > 500


def test_islands_of_one_contig_are_many_tasks(spark):
    rows = [(k, 1, "DEL", 100 * k, 100 * k + 400) for k in range(500)]  # one chain of overlaps
    one = intervals.islands(table(spark, rows), ["chrom_no"], "b", "e").select("island").distinct().count()
    padded = table(spark, rows).withColumn("stop", cluster.reach_of(0.8, 50, 50) + 1)
    assert one == 1 and intervals.islands(padded, ["chrom_no"], "b", "stop").select("island").distinct().count() == 500
