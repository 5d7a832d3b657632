"""Embedding near-dedup with a forest of random-projection trees.

Equal vectors are gathered first: one point each, with the number of its rows. Medians fall inside dense groups and would cut them, so
these are taken out before the trees, without loss: a point of a bounded sample (about SAMPLE, by hash) that is linked with CROWDED or
more others leads a group, its core is every point of the table linked with it (each point belongs to the nearest leader), and what can
be linked with the core lies within twice the limit's angle of the leader. Cores are compared with all of that, so every link with an end
in a core is found, and counted where it is found: no pairs are written, only sums by point and an edge to the leader.

The other points go to the trees. Every tree splits the unit vectors again and again by a random direction at a median; points within
SPILL of the median (as a share of the spread) go to both sides. The top of each tree is fitted on the sample. Leaves that hold more
than LEAF points of the whole table are split on by further random directions at their own medians, round by round, each round one pass
over the points of those leaves; a leaf where a sample of pairs shows DENSE or more of them linked (a group too small for the sample to
show), or that random directions do not take apart any more (LEVELS rounds), is compared as it is, in blocks. Points are compared within
leaves, in double precision, and what reaches the limit is a link. Links of all trees are united; components follow by minima.

Comparisons go by blocks of rows against rows, so memory does not grow with a leaf or a group, whose rows are dealt over tasks: block i
meets block j in the task of the pair (i, j).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varspark.llm.common import connected_components, release, saved

TREES = 8
SAMPLE = 20_000
LEAF = 512
LEAST_SAMPLE = 64
SPILL = 0.1
LEVELS = 24
CROWDED = 32
DENSE = 0.1
BLOCK = 4096
STRIP = 512


def widths(vectors: DataFrame, column: str) -> list[int]:
    """The widths that two or more vectors of the table have; each is a space of its own."""
    counts = vectors.where(F.size(column) > 0).groupBy(F.size(column).alias("width")).agg(F.count("*").alias("n")).where("n > 1")
    return sorted(r.width for r in counts.collect())


def usable(x: list, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors as doubles and which rows are usable: not null, with components that are all finite, not all zero, of the given width."""
    good = np.array([v is not None and len(v) == width and width > 0 and all(c is not None for c in v) for v in x], dtype=bool)
    out = np.zeros((len(x), width))
    if good.any():
        out[good] = np.array([v for v, g in zip(x, good, strict=True) if g], dtype=np.float64)
    return out, good & np.isfinite(out).all(1) & (out != 0).any(1)


def matrix(v: list[bytes], kind: str) -> np.ndarray:
    """Unit vectors as doubles, from the bytes of their components."""
    if not v:
        return np.zeros((0, 0))
    x = np.frombuffer(b"".join(v), dtype=kind).reshape(len(v), -1).astype(np.float64)
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


class Tree:
    """Directions, medians and margins by node; node 1 is the root, 2n and 2n+1 its sides."""

    def __init__(self, points: np.ndarray, seed: int):
        self.seed, self.nodes = seed, {}
        todo = [(1, points)]
        while todo:
            node, own = todo.pop()
            if len(own) < 2 * LEAST_SAMPLE:
                continue
            at = own @ direction(seed, node, own.shape[1])
            middle, margin = np.median(at), SPILL * at.std()
            low, high = at <= middle + margin, at > middle - margin
            if max(low.sum(), high.sum()) > 0.9 * len(own):
                continue
            self.nodes[node] = middle, margin
            todo += [(2 * node, own[low]), (2 * node + 1, own[high])]

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that a row falls into."""
        rows, leaves, todo = [], [], [(1, np.arange(len(x)))]
        while todo:
            node, own = todo.pop()
            if node not in self.nodes:
                rows.append(own)
                leaves.append(np.full(len(own), node))
            elif len(own):
                middle, margin = self.nodes[node]
                at = x[own] @ direction(self.seed, node, x.shape[1])
                todo += [(2 * node, own[at <= middle + margin]), (2 * node + 1, own[at > middle - margin])]
        return np.concatenate(rows), np.concatenate(leaves)


def direction(seed: int, node: int, width: int) -> np.ndarray:
    x = np.random.default_rng([seed, node]).normal(size=width)
    return x / np.sqrt((x * x).sum())


def as_points(vectors: DataFrame, key: str, column: str, kind: str, width: int) -> DataFrame:
    """(id, v): usable vectors of a width as the bytes of their components."""

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, good = usable(batch.column(1).to_pylist(), width)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), pa.array([v.astype(kind).tobytes() for v in x[good]], pa.binary())], ["id", "v"])

    return vectors.select(F.col(key).alias("id"), F.col(column).alias("v")).where((F.col("id").isNotNull()) & (F.size("v") == width)).mapInArrow(block, "id long, v binary")


def in_leaves(points: DataFrame, trees: list[Tree], kind: str) -> DataFrame:
    shared = points.sparkSession.sparkContext.broadcast(trees)

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1).to_pylist(), kind)
                for k, tree in enumerate(shared.value):
                    rows, leaves = tree.leaves(x)
                    some = batch.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.array(np.full(len(rows), k), pa.int32()), pa.array(leaves)], ["id", "v", "tree", "leaf"])

    return points.mapInArrow(block, "id long, v binary, tree int, leaf long")


def projected(leaf: DataFrame, kind: str) -> DataFrame:
    """The rows with `at`, their place on the next random direction of their leaf."""

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, tree, node = matrix(batch.column(1).to_pylist(), kind), batch.column(2).to_numpy(), batch.column(3).to_numpy()
                at = np.zeros(len(x))
                for t, n in set(zip(tree.tolist(), node.tolist(), strict=True)):
                    own = (tree == t) & (node == n)
                    at[own] = x[own] @ direction(t, n, x.shape[1])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], ["id", "v", "tree", "leaf", "at"])

    return leaf.mapInArrow(block, "id long, v binary, tree int, leaf long, at double")


def close(group: pd.DataFrame, limit: float, kind: str) -> pd.DataFrame:
    """Pairs of a block pair (side 0 against side 1; a block with itself has side 2 only) whose cosine is `limit` or more."""
    a, b = group[group.side != 1], group[group.side != 0]
    x, y = matrix(a.v.tolist(), kind), matrix(b.v.tolist(), kind)
    if not len(x) or not len(y):
        return pd.DataFrame({"src": np.empty(0, np.int64), "dst": np.empty(0, np.int64)})
    i, j = np.nonzero(x @ y.T >= limit - 1e-9)
    cos = np.einsum("ij,ij->i", x[i], y[j])
    u, v = a.id.to_numpy()[i], b.id.to_numpy()[j]
    keep = (cos >= limit) & (u != v)
    return pd.DataFrame({"src": np.minimum(u, v)[keep], "dst": np.maximum(u, v)[keep]}).drop_duplicates()


def leaders(x: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the sample that lead its dense groups, and which rows they cover: the one with the most links to rows not covered yet is
    taken, while these are CROWDED or more. Single precision will do, as it only chooses."""
    x = x.astype(np.float32)

    def near(y: np.ndarray) -> np.ndarray:
        return np.concatenate([(x[k : k + STRIP] @ y.T >= limit).sum(1) for k in range(0, len(x), STRIP)])

    out, covered = [], np.zeros(len(x), dtype=bool)
    count = near(x) if len(x) else np.zeros(0, np.int64)
    while len(x) and count.max() >= CROWDED:
        k = int(count.argmax())
        new = np.flatnonzero(~covered & (x @ x[k] >= limit))
        if len(new) >= CROWDED:
            out.append(k)
            covered[new] = True
            count -= near(x[new])
        count[k] = -1
    return np.array(out, dtype=np.int64), covered


def placed(points: DataFrame, centres: np.ndarray, limit: float, kind: str) -> DataFrame:
    """points with `home`, the nearest leader if linked with it, else -1, and `near`, the leaders within twice the limit's angle."""
    shared = points.sparkSession.sparkContext.broadcast(centres)
    reach = np.cos(min(np.pi, 2 * np.arccos(limit))) - 1e-6

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = matrix(batch.column(1).to_pylist(), kind) @ shared.value.T
                home = at.argmax(1)
                home[at.max(1) < limit + 1e-9] = -1
                row, group = np.nonzero(at >= reach)
                cut = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(at)))]).astype(np.int32)
                near = pa.ListArray.from_arrays(pa.array(cut), pa.array(group.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home.astype(np.int32)), near], ["id", "v", "rows", "home", "near"])

    return points.select("id", "v", "rows").mapInArrow(block, "id long, v binary, rows long, home int, near array<int>")


def count_links(pair: pd.DataFrame, names: np.ndarray, limit: float, kind: str) -> pd.DataFrame:
    """(id, near, leader) of the points that have a link in a block of a core (side 0) against a block of its surroundings (side 1).

    near: the rows that a point is linked with. A core's points have all their links counted at home, so as surroundings they count none.
    """
    a, b = pair[pair.side == 0], pair[pair.side == 1]
    x, y = matrix(a.v.tolist(), kind), matrix(b.v.tolist(), kind)
    own, other = np.zeros(len(a)), np.zeros(len(b))
    linked = np.zeros(len(b), dtype=bool)
    of_a, of_b, ids_a, ids_b = a.rows.to_numpy(float), b.rows.to_numpy(float), a.id.to_numpy(), b.id.to_numpy()
    for first in range(0, len(a) if len(b) else 0, STRIP):
        strip = slice(first, first + STRIP)
        at = x[strip] @ y.T
        hit = at >= limit
        i, j = np.nonzero(np.abs(at - limit) < 1e-9)
        hit[i, j] = np.einsum("ij,ij->i", x[strip][i], y[j]) >= limit
        hit &= ids_a[strip, None] != ids_b
        linked |= hit.any(0)
        hit = hit.astype(float)
        own[strip] = hit @ of_b
        other += of_a[strip] @ hit
    other[b.home.to_numpy() >= 0] = 0
    ids, near = np.concatenate([ids_a[own > 0], ids_b[linked]]), np.concatenate([own[own > 0], other[linked]])
    return pd.DataFrame({"id": ids, "near": near.astype(np.int64), "leader": np.full(len(ids), names[pair.group.iloc[0]] if len(pair) else 0, np.int64)})


def core_links(points: DataFrame, names: np.ndarray, limit: float, kind: str) -> DataFrame:
    """(id, near, leader) from all links with an end in a core; points: as placed() gives them."""
    around = points.select("id", "v", "rows", "home", F.explode("near").alias("group"))
    sizes = around.groupBy("group").agg(F.count("*").alias("size"), F.sum((F.col("home") == F.col("group")).cast("long")).alias("core"))
    sizes = sizes.where("core > 0").select("group", *(F.ceil(F.col(c) / BLOCK).cast("int").alias(f"{c}_blocks") for c in ("core", "size")))
    dealt = around.join(F.broadcast(sizes), "group")
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    core = dealt.where("home = group").select("id", "v", "rows", "home", "group", block("core_blocks").alias("i"), each("size_blocks").alias("j"), F.lit(0).alias("side"))
    other = dealt.select("id", "v", "rows", "home", "group", each("core_blocks").alias("i"), block("size_blocks").alias("j"), F.lit(1).alias("side"))
    pairs = core.union(other).groupBy("group", "i", "j")
    return pairs.applyInPandas(lambda g: count_links(g, names, limit, kind), "id long, near long, leader long")


def dense(leaf: DataFrame, limit: float, kind: str) -> DataFrame:
    """(tree, leaf) of the leaves where DENSE or more of the pairs of about 2 * LEAST_SAMPLE points are linked. leaf: with `size`."""

    def look(group: pd.DataFrame) -> pd.DataFrame:
        x = matrix(group.v.tolist(), kind)
        pairs = len(x) * (len(x) - 1)
        return group[["tree", "leaf"]].head(int(pairs > 0 and (x @ x.T >= limit).sum() - len(x) >= DENSE * pairs))

    share = F.shiftrightunsigned(F.xxhash64("id", "tree", F.lit(7)), 11) / F.lit(float(1 << 53))
    return leaf.where(share < F.lit(2.0 * LEAST_SAMPLE) / F.col("size")).select("v", "tree", "leaf").groupBy("tree", "leaf").applyInPandas(look, "tree int, leaf long")


def near_duplicates(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", limit: float = 0.9) -> DataFrame:
    """(key, n_links, component_id, kept): rows linked by a cosine of `limit` or more that the forest finds; never one below it.

    key: an integer column. Vectors are compared with those of their own width. Those that are null, zero, or hold a null or non-finite
    component link with nothing and are components of their own, as rows with a null key are. Equal directions always link. Repeated rows
    each give a row; other columns are left out. An empty table gives an empty one. Ties: of equal vectors the least key speaks for all;
    a point as near to two leaders goes to the first in the order of the sample's components, which is the same in every run.
    """
    ids = vectors.select(F.col(key).alias("key"), F.size(column).alias("size"))
    every = vectors.sparkSession.createDataFrame([], "id long, n_links long, component_id long, width int")
    for width in widths(vectors, column):
        every = every.union(of_width(vectors, key, column, limit, width).withColumn("width", F.lit(width)))
    out = ids.join(every, (ids.key == every.id) & (ids.size == every.width), "left")
    component = F.coalesce("component_id", "key")
    return out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("key"), F.lit(True)).alias("kept"))


def of_width(vectors: DataFrame, key: str, column: str, limit: float, width: int) -> DataFrame:
    """(id, n_links, component_id) of the usable vectors of a width."""
    spark = vectors.sparkSession
    kind = "<f4" if "float" in vectors.schema[column].dataType.simpleString() else "<f8"
    rows = saved(as_points(vectors, key, column, kind, width))
    points = saved(rows.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("rows")))
    n = points.count()
    sample = points.select("id", "v").where(F.shiftrightunsigned(F.xxhash64("v"), 11) / F.lit(float(1 << 53)) < F.lit(SAMPLE / max(n, 1))).toArrow()
    x, ids = matrix(sample["v"].to_pylist(), kind), sample["id"].to_numpy()
    order = np.lexsort(x.T) if len(x) else np.arange(0)
    x, ids = x[order], ids[order]

    # dense groups: every link with an end in a core
    lead, covered = leaders(x, limit)
    cores = None
    rest = points.select("id", "v")
    if len(lead):
        homes = saved(placed(points, x[lead], limit, kind))
        cores = saved(core_links(homes, ids[lead], limit, kind))
        rest = homes.where("home < 0").select("id", "v")

    trees = [Tree(x[~covered], seed) for seed in range(TREES)]
    leaves = saved(in_leaves(rest, trees, kind))

    # leaves that are too large for the whole table are split on, at their own medians, but for dense ones
    done = []
    for _ in range(LEVELS):
        sizes = leaves.groupBy("tree", "leaf").agg(F.count("*").alias("size"))
        large = sizes.where(F.col("size") > LEAF)
        if large.isEmpty():
            break
        crowded = saved(dense(leaves.join(large, ["tree", "leaf"]), limit, kind))
        large = large.join(crowded, ["tree", "leaf"], "left_anti").select("tree", "leaf")
        done.append(leaves.join(large, ["tree", "leaf"], "left_anti").select("id", "v", "tree", "leaf"))
        at = saved(projected(leaves.join(large, ["tree", "leaf"]).select("id", "v", "tree", "leaf"), kind))
        middle = at.groupBy("tree", "leaf").agg(F.percentile_approx("at", 0.5, 1000).alias("middle"), F.stddev_pop("at").alias("spread"), F.count("*").alias("size"))
        halves = at.join(middle, ["tree", "leaf"])
        low, high = F.col("at") <= F.col("middle") + SPILL * F.col("spread"), F.col("at") > F.col("middle") - SPILL * F.col("spread")
        sides = halves.select("id", "v", "tree", "leaf", F.explode(F.array_compact(F.array(F.when(low, F.lit(0)), F.when(high, F.lit(1))))).alias("side"))
        leaves = saved(sides.select("id", "v", "tree", (F.col("leaf") * 2 + F.col("side")).alias("leaf")))
    for part in done:
        leaves = leaves.union(part)

    # blocks of a leaf meet in pairs, each pair in a task of its own
    sizes = leaves.groupBy("tree", "leaf").agg(F.count("*").alias("size")).where("size > 1").withColumn("blocks", F.ceil(F.col("size") / LEAF).cast("int"))
    dealt = leaves.join(sizes, ["tree", "leaf"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = dealt.select("id", "v", "tree", "leaf", "block", other).select("id", "v", "tree", "leaf", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.expr("CASE WHEN block < other THEN 0 WHEN block > other THEN 1 ELSE 2 END").alias("side"))
    links = dealt.groupBy("tree", "leaf", "i", "j").applyInPandas(lambda g: close(g, limit, kind), "src long, dst long")
    links = saved(links.distinct())
    release(spark)
    component = connected_components(links if cores is None else links.union(cores.select("id", "leader")))

    own = points.select(F.col("id").alias("rep"), "rows")
    both = links.union(links.select("dst", "src")).toDF("src", "dst")
    near = both.join(own, F.col("dst") == F.col("rep")).groupBy(F.col("src").alias("rep")).agg(F.sum("rows").alias("near"))
    if cores is not None:
        near = near.union(cores.select("id", "near")).groupBy("rep").agg(F.sum("near").alias("near"))
    each = own.join(near, "rep", "left").join(component.withColumnRenamed("id", "rep"), "rep", "left")
    each = each.select("rep", (F.coalesce("near", F.lit(0)) + F.col("rows") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    return rows.join(points.select("v", F.col("id").alias("rep")), "v").join(each, "rep").select(F.col("id"), "n_links", "component_id").distinct()
