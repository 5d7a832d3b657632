"""Centroid clustering, mixing and the fill-in-middle transformation against plain Python, on small tables and on odd ones."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from varspark.llm import centroids, middle, mixing

SCHEMA = "doc_id long, text string, source string"
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(3)
    own = [None, "", " \n\t ", "one", " one", "one two  ", "a b <P> c", "x <S> y", "z <M>", "<", "a <P", "naïve 漢字 🙂   text", "\x0b\x0c", "a\0b c", "ab" * 200]
    own += [" ".join(draw.choice(["tu", "漢", "lo\n", "mi  ra", "🙂"]) for _ in range(draw.randrange(1, 60))) for _ in range(60)]
    own += ["word 漢字 " * 30_000, "x" * 200_000 + " y"]
    return own


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, [None, "a", "b", "é", "c"][k % 5]) for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (3, "one", "a"), (3, "one", "a"), (None, "no key here", "b")], SCHEMA).repartition(3)


# fill in middle


def numbers(draw, n, most):
    return sorted(draw.sample(range(most), n))


@pytest.mark.parametrize(("own", "kind"), [
    (numbers(random.Random(1), 300, 1 << 16), "array"), (numbers(random.Random(2), 40_000, 1 << 16), "bitmap"), ([*range(100, 900), *range(7000, 65536)], "runs"), ([0], "array"), ([65535], "array"), ([*range(65536)], "runs"),
])
def test_containers(own, kind):
    s = middle.Boundaries()
    s.add(2, np.array(own))
    s.add(3, np.array([], np.int64))
    s.add(9, np.array(own))
    assert s.kinds == [kind, kind] and len(s) == 2 * len(own)
    whole = [(h << 16) + x for h in (2, 9) for x in own]
    step = max(1, len(whole) // 500)
    assert [s.select(k) for k in range(0, len(whole), step)] == whole[::step]
    assert s.select(len(whole) - 1) == whole[-1]


@pytest.mark.parametrize("unit", middle.UNITS)
def test_boundaries(texts, unit):
    for t in texts:
        t = t or ""
        parts, at, ends = UNIT.findall(t) if unit == "words" else list(t), 0, []
        for p in parts:
            at += len(p.encode())
            ends.append(at - 1)
        s = middle.boundaries_of(t.encode(), unit)
        step = max(1, len(ends) // 200)
        assert len(s) == len(ends) and [s.select(k) for k in range(0, len(ends), step)] == ends[::step]


def expected(key, text, seed=42, plain=50, spm=80):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in middle.MARKS) or h[2] % 100 >= plain:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("plain", "spm"), [(50, 80), (100, 50)])
def test_cuts(docs, plain, spm):
    clash = docs.withColumns({"form": F.lit(1), "output": F.lit(2), "n_units": F.lit(3), "other": F.lit(4)})
    out = middle.fill_in_middle(clash, plain_percent=plain, spm_percent=spm).withColumn("back", middle.restored(F.col("output"), F.col("form"))).collect()
    assert len(out) == docs.count()
    for r in out:
        assert (r.n_units, r.form, r.prefix_chars, r.middle_chars, r.output) == expected(r.doc_id, r.text, 42, plain, spm)
        assert r.back == (r.text or "") and r.other == 4
    assert {r.form for r in out} == set(middle.FORMS)


def test_cuts_of_characters(docs):
    out = middle.fill_in_middle(docs, unit="characters", plain_percent=100).collect()
    assert all(r.n_units == len(r.text or "") for r in out)
    with pytest.raises(ValueError):
        middle.fill_in_middle(docs, unit="lines")


def test_cuts_of_nothing(spark):
    out = middle.fill_in_middle(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0 and {"n_units", "form", "prefix_chars", "middle_chars", "output"} <= set(out.columns)


# centroids


def clustered(rows, k, width, scale, rounds, seed):
    kept = []
    for key, v in rows:
        if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v):
            kept.append((key, [math.floor(scale * float(x)) for x in v]))
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    own = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(own))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        own = [[sum(x) // len(groups[i]) for x in zip(*groups[i], strict=True)] if i in groups else c for i, c in enumerate(own)]
    return sorted(((key, near(v)[1], near(v)[0]) for key, v in kept), key=repr), own


@pytest.mark.parametrize(("n", "k", "scale"), [(300, 16, 64), (300, 5, 1), (7, 16, 64), (40, 1, 8)])
def test_clusters(spark, n, k, scale):
    draw = random.Random(n + k)
    rows = [(i, [draw.gauss(i % 3, 1) for _ in range(6)]) for i in range(n)]
    rows += [(n, None), (n + 1, []), (n + 2, [1.0] * 5), (n + 3, [1.0] * 5 + [None]), (n + 4, [float("nan")] + [0.0] * 5), (n + 5, [float("inf")] + [0.0] * 5), (n + 6, [0.0] * 6), (n + 7, [-0.0] * 6), (n + 8, [1e300] * 6)]
    rows += [rows[0], rows[0], (None, rows[1][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster string").repartition(4)
    out, table = centroids.cluster_vectors(df, k=k, width=6, scale=scale)
    want, own = clustered([r for r in rows if r[1] is None or 1e300 not in r[1]], k, 6, scale, 3, 1)
    assert sorted(map(tuple, out.collect()), key=repr) == want
    assert [r.centroid for r in table.orderBy("cluster").collect()] == own
    facts = centroids.with_inertia(out, table).collect()
    totals = Counter()
    for _, c, d in want:
        totals[c] += d
    assert all((r.cluster_inertia, r.inertia) == (totals[r.cluster], sum(totals.values())) for r in facts)
    assert {(r.cluster, r.centroid_sha256) for r in facts} == {(c, hashlib.sha256(",".join(map(str, own[c])).encode()).hexdigest()) for c in totals}


def test_search_rejects_and_keeps_ties():
    draw = np.random.default_rng(4)
    own = np.concatenate([draw.integers(-50, 50, (200, 64)) + draw.integers(-40, 40, (200, 1)), np.zeros((3, 64), np.int64)])
    vectors = np.concatenate([own[:100] + draw.integers(-2, 3, (100, 64)), np.zeros((5, 64), np.int64), draw.integers(-50, 50, (50, 64))])
    search = centroids.Search(own)
    number, distance = search.nearest(vectors)
    whole = ((vectors[:, None, :] - own[None]) ** 2).sum(2)
    assert (number == whole.argmin(1)).all() and (distance == whole.min(1)).all() and (number[100:105] == 200).all()
    assert search.compared < whole.size / 3


def test_clusters_of_nothing(spark):
    df = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    for rows in (df, df.where("vec_id > 1")):
        out, table = centroids.cluster_vectors(rows)
        assert out.count() == 0 and table.count() == 0 and centroids.with_inertia(out, table).count() == 0


# mixing


def test_targets():
    assert mixing.targets([600, 600, 600]) == [300.0, 600.0, 900.0]
    assert mixing.targets([1000, 10, 0, 1000]) == pytest.approx([1980 / 2, 30.0, 0.0, 1980 / 2])
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0.0, 0.0] and mixing.targets([5]) == [5.0]
    draw = random.Random(1)
    for _ in range(50):
        sizes = [draw.choice([0, 1, 10, 1000, draw.randrange(10**6)]) for _ in range(draw.randrange(1, 12))]
        own = mixing.targets(sizes)
        assert sum(own) == pytest.approx(sum(sizes)) and all(t <= 3 * s for t, s in zip(own, sizes, strict=True))
        free = [t / (k % 3 + 1) for k, (t, s) in enumerate(zip(own, sizes, strict=True)) if t < 3 * s]
        assert not free or max(free) == pytest.approx(min(free))


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_quotas_are_split_whole(shards):
    quotas = [1000, 0, 7, 333, 1]
    own = mixing.split_quotas(quotas, shards, 5)
    assert own.sum(0).tolist() == quotas and np.ptp(own.sum(1)) <= 1 and (own >= 0).all()
    assert (own == mixing.split_quotas(quotas, shards, 5)).all()
    assert shards == 1 or (own != mixing.split_quotas(quotas, shards, 6)).any()


def test_quotas_are_hypergeometric():
    left = [mixing.split_quotas([30, 10], 2, seed)[0, 0] for seed in range(3000)]
    # 20 of 40 without replacement, 30 of them of the first source: mean 15, variance 20 * 3/4 * 1/4 * 20/39
    assert abs(np.mean(left) - 15) < 0.1 and abs(np.var(left) - 1.923) < 0.2


@pytest.mark.parametrize("bucket", [1024, 2])
def test_running_sum(spark, monkeypatch, bucket):
    monkeypatch.setattr(mixing, "BUCKET", bucket)
    draw = random.Random(8)
    rows = [(k % 3 // 2, draw.randrange(1 << mixing.HASH_BITS), k, draw.randrange(9)) for k in range(200)]
    rows += [(0, rows[0][1], 900 + k, 1) for k in range(5)]
    df = spark.createDataFrame(rows, "g int, key long, id int, v long")
    out = mixing.running_sum(df, "g", "key", ["id"], F.col("v"), "start", len(rows)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.start == sum(v for g, key, i, v in rows if g == r.g and (key, i) < (r.key, r.id))


def sizes_of(docs):
    return [(r.doc_id, r.source, r.text or "") for r in docs.collect()]


@pytest.mark.parametrize("blocks", [mixing.BLOCKS, 300, 1])
def test_mix(docs, blocks):
    rows = sizes_of(docs)
    sizes = Counter()
    for _, s, t in rows:
        sizes[s] += len(WORD.findall(t))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, mixing.targets([sizes[s] for s in names]), strict=True))
    out = mixing.mix_documents(docs.withColumns({"size": F.lit("x"), "target": F.lit(1)}), blocks=blocks).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in out) == Counter((k, s, len(WORD.findall(t))) for k, s, t in rows)
    taken, by_draw, shards, lengths = Counter(), defaultdict(set), Counter(), Counter()
    for r in out:
        assert (r.source_size, r.target) == (sizes[r.source], want[r.source]) and 0 <= r.taken <= 3 * r.size
        assert r.taken == sum(p.words for p in r.pieces) and all(p.words > 0 and p.first_word + p.words <= r.size for p in r.pieces)
        taken[r.source] += r.taken
        for p in r.pieces:
            by_draw[r.source, p.epoch, p.block].add(p.shard)
            lengths[r.source, p.epoch, p.block] += p.words
            shards[p.shard] += p.words
    assert all(taken[s] == math.floor(want[s] + 0.5) for s in names)
    block = max(1, -(-sum(sizes.values()) // blocks))
    assert all(len(s) == 1 for s in by_draw.values()) and max(lengths.values()) <= block
    # blocks are of one length but for the last of a source and the one that ends its target
    short = Counter(s for (s, _, _), n in lengths.items() if n < block)
    assert all(n <= 3 + 1 for n in short.values())
    per_shard = Counter(next(iter(s)) for s in by_draw.values())
    assert max(per_shard.values()) - min(per_shard.get(k, 0) for k in range(16)) <= 1


def test_mix_does_not_depend_on_order(docs):
    first, second = (sorted(map(repr, mixing.mix_documents(d).collect())) for d in (docs, docs.repartition(5, "text")))
    assert first == second


def test_mix_of_nothing(spark):
    assert mixing.mix_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    (row,) = mixing.mix_documents(spark.createDataFrame([(1, None, None)], SCHEMA)).collect()
    assert (row.size, row.source_size, row.target, row.taken, row.pieces) == (0, 0, 0.0, 0, [])


def test_pieces_are_the_words(spark, docs, tmp_path):
    pieces = mixing.mixed_pieces(docs, blocks=500, shards=4)
    words = {(r.doc_id, r.text_md5): (r.taken, r.size) for r in mixing.mix_documents(docs, blocks=500, shards=4).collect()}
    own = defaultdict(set)
    for k, s, t in sizes_of(docs):
        own[k].add(tuple(WORD.findall(t)))
    rows = pieces.collect()
    for r in rows:
        assert any(tuple(r.text.split(" ")) == w[r.first_word : r.first_word + r.words] for w in own[r.doc_id])
    assert sum(r.words for r in rows) >= sum(t for t, _ in words.values())
    mixing.write_shards(pieces, str(tmp_path / "mix"))
    back = spark.read.parquet(str(tmp_path / "mix"))
    assert back.count() == len(rows) and {r.shard for r in back.select("shard").distinct().collect()} == set(range(4))
