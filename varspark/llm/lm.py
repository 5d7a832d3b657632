"""LM scoring with a probabilistic suffix tree over word classes.

Tokens are lower-cased words, then one end. The tree's alphabet are classes of tokens: each word with a share of CLASS_WORD or more
is a class of its own, the other words are classed by their last two bytes, endings with a share under CLASS_ENDING fall into one
class with unknown words, and the end is a class. So there are at most 1 / CLASS_WORD + 1 / CLASS_ENDING + 2 classes.

A context is the up to DEPTH classes before a token (the end stands before the first). Spark counts every (context, next class) of
the training texts. A context becomes a state of the tree if

* it was seen LEAST_COUNT times or more, whatever the size of the corpus, so states grow with the input, and
* its next-class distribution differs from that of its longest proper suffix: count times divergence is GAIN nats or more, beyond one
  nat for each class seen there (what chance alone could give), or it is a suffix of such a state.

A state's distribution is smoothed towards its longest suffix that is a state, by half the number of classes seen in it; the empty
context has the add-one distribution. All entries of a state are kept. A token is scored in the longest suffix of what stands before it that is a state: P(class | state) times the token's add-one share within its class. Summed
over all tokens, unknown ones as one, that is 1.

States and entries are tables and never meet on the driver: the probability of every (context, next class) of the texts is worked out by
joins, from the empty context on. Those with a share of COMMON or more of the training tokens (at most 1 / COMMON of them) are broadcast,
the others are joined to the texts by a shuffle.

The counts of words decide how they are looked up: words with a share of COMMON or more (at most 1 / COMMON of them) are broadcast,
the others are joined by a shuffle, as 64-bit hashes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varspark.llm.common import as_bytes, in_blocks, row_numbers, saved, words_of

DEPTH = 2
LEAST_COUNT = 16
GAIN = 12.0
CLASS_WORD = 1e-3
CLASS_ENDING = 1e-4
COMMON = 2e-6
END, OTHER = 0, 1
FLUSH = 600_000


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of words."""
    words: Counter = Counter()
    out = lambda: pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())], ["word", "n"])
    for batch in in_blocks(batches, "text"):
        for text in as_bytes(batch.column(0)):
            words.update(words_of(text))
        if len(words) > FLUSH:
            yield out()
            words = Counter()
    yield out()


def classes_of(words: list[list[bytes]], own: dict[bytes, int], endings: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """The classes of the tokens of some texts, each text with END DEPTH times before it; the number of symbols of each."""
    before = (END,) * DEPTH
    get, of = own.get, endings.get
    flat = chain.from_iterable((*before, *[get(w) or of(w[-2:], OTHER) for w in text], END) for text in words)
    sizes = np.fromiter((len(text) + 1 + DEPTH for text in words), np.int64, len(words))
    return np.fromiter(flat, np.int64, sizes.sum()), sizes


def grams(symbols: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """For each token the classes of its context and itself as one number in base k."""
    code = np.zeros(len(symbols) - DEPTH, dtype=np.int64)
    for d in range(DEPTH + 1):
        code = code * k + symbols[d : len(symbols) - DEPTH + d]
    keep = np.ones(len(symbols), dtype=bool)
    for d in range(DEPTH):
        keep[np.cumsum(sizes) - sizes + d] = False
    return code[keep[DEPTH:]]


def summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])[: len(codes)])
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


def gains(counts: DataFrame, shares: DataFrame, k: int) -> DataFrame:
    """(gram, n, gain) of all grams: log10 of P(class | context) / P(class), from counts (gram, n; n = 0 where only other texts have it)
    and the add-one shares (next, q) of the classes."""
    powers = F.array(*(F.lit(k**d) for d in range(DEPTH + 2)))
    nested = counts.select("gram", "n", F.explode(F.sequence(F.lit(1), F.lit(DEPTH))).alias("depth"))
    nested = nested.select("depth", (F.col("gram") % F.element_at(powers, F.col("depth") + 2)).alias("pair"), "n").groupBy("depth", "pair").agg(F.sum("n").alias("n"))
    nested = saved(nested.select("depth", "pair", "n", F.expr(f"pair div {k}").alias("state"), F.expr(f"pair % {k}").alias("next")))
    seen = nested.where("n > 0")
    of_state = seen.groupBy("depth", "state").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).where(F.col("total") >= LEAST_COUNT)
    pairs = seen.join(of_state, ["depth", "state"]).withColumn("up_state", F.col("state") % F.element_at(powers, F.col("depth")))
    below = pairs.where(F.col("depth") < DEPTH).select((F.col("depth") + 1).alias("depth"), F.col("state").alias("up_state"), "next", (F.col("n") / F.col("total")).alias("q"))
    below = below.union(shares.select(F.lit(1).alias("depth"), F.lit(0).cast("long").alias("up_state"), "next", "q"))
    told = pairs.join(below, ["depth", "up_state", "next"]).groupBy("depth", "state").agg(F.sum(F.expr("n * ln(n / total / q)")).alias("gain"), F.count("*").alias("seen"))
    states = told.where(F.col("gain") >= GAIN + F.col("seen")).select("depth", "state")
    suffixes = states.select(F.explode(F.sequence(F.lit(1), F.col("depth"))).alias("depth"), "state")
    suffixes = suffixes.select("depth", (F.col("state") % F.element_at(powers, F.col("depth") + 1)).alias("state")).distinct()
    states = saved(of_state.join(suffixes, ["depth", "state"]).select("depth", "state", "total", (F.col("kinds") / 2).alias("strength")))

    p = shares.select(F.col("next").alias("low"), F.col("q").alias("below"))
    for depth in range(1, DEPTH + 1):
        asked = nested.where(F.col("depth") == depth).select("pair", "n", "state", "next", (F.col("pair") % k**depth).alias("low"))
        asked = asked.join(states.where(F.col("depth") == depth).drop("depth"), "state", "left").join(p, "low")
        own = (F.col("n") + F.col("strength") * F.col("below")) / (F.col("total") + F.col("strength"))
        asked = asked.select("pair", "n", "next", F.coalesce(own, "below").alias("below"))
        p = asked.select(F.col("pair").alias("low"), "below")
    return asked.join(F.broadcast(shares), "next").select(F.col("pair").alias("gram"), "n", F.log10(F.col("below") / F.col("q")).alias("gain"))


class Tree:
    """What gains() works out, in memory, for trees that fit there; it is held against it in the tests.

    For each depth the sorted states with the weight they leave to the suffix, and the sorted entries with their probabilities."""

    def __init__(self, rows: dict, shares: np.ndarray):
        self.k, self.levels, self.shares = len(shares), [], shares
        for depth in range(1, DEPTH + 1 if rows else 1):
            pair, n, total, kinds = (rows[x][rows["depth"] == depth] for x in ("pair", "n", "total", "kinds"))
            order = np.argsort(pair)
            pair, n, total, strength = pair[order], n[order], total[order], kinds[order] / 2
            states, first, of = np.unique(pair // self.k, return_index=True, return_inverse=True)
            kept = np.bincount(of, n, len(states))
            rest = (strength[first] + total[first] - kept) / (total[first] + strength[first])
            p = n / (total + strength) + rest[of] * self.probability(pair % self.k**depth)
            self.levels.append((states, rest, pair, p))

    def probability(self, pair: np.ndarray) -> np.ndarray:
        """Of the last class of each pair, in the longest suffix of its context that is a state among the levels so far."""
        factor, out, left = np.ones(len(pair)), np.zeros(len(pair)), np.arange(len(pair))
        for depth in range(len(self.levels), 0, -1):
            states, rest, pairs, p = self.levels[depth - 1]
            if len(states):
                key = pair[left] % self.k ** (depth + 1)
                at = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
                hit = pairs[at] == key
                out[left[hit]] = factor[left[hit]] * p[at[hit]]
                left, key = left[~hit], key[~hit] // self.k
                at = np.minimum(np.searchsorted(states, key), len(states) - 1)
                at, is_state = at, states[at] == key
                factor[left[is_state]] *= rest[at[is_state]]
        out[left] = factor[left] * self.shares[pair[left] % self.k]
        return out


def score_texts(docs: DataFrame, training: Column, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: id, n_tokens, n_known, train_tokens, base_score, score. training: which rows to learn from.

    Null and empty texts have one token, the end. Rows alike are scored alike, and each counts in training as often as it is there.
    With nothing to learn from, every token is unknown. Texts of any length are scored as wholes. Ids may repeat or be null: rows are told apart by numbers of their own. Other
    columns of docs are left out.
    """
    spark = docs.sparkSession
    is_training = F.coalesce(training, F.lit(False))
    learn = docs.where(is_training).select(F.col(text).alias("text"))
    of_words = saved(learn.mapInArrow(count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    texts = learn.count()
    seen = of_words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_train, vocabulary = seen.n + texts, seen.v + bool(texts)
    whole = n_train + vocabulary + 1

    # classes: at most 1 / CLASS_WORD + 1 / CLASS_ENDING rows come to the driver
    is_class = F.col("n") >= CLASS_WORD * n_train
    own = {bytes(w): (k, n + 1) for k, (w, n) in enumerate(of_words.where(is_class).orderBy("word").collect(), 2)}
    ends = of_words.where(~is_class).groupBy(F.substring("word", -2, 2).alias("ending")).agg(F.sum(F.col("n") + 1).alias("mass")).where(F.col("mass") >= CLASS_ENDING * n_train)
    endings = {bytes(e): (k, m) for k, (e, m) in enumerate(ends.orderBy("ending").collect(), 2 + len(own))}
    mass = np.array([texts + bool(texts), 0, *(m for _, m in (*own.values(), *endings.values()))], dtype=float)
    mass[OTHER] = whole - mass.sum()
    own, endings = {w: k for w, (k, _) in own.items()}, {e: k for e, (k, _) in endings.items()}
    shares, k = mass / whole, len(mass)

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in in_blocks(batches, "text"):
            symbols, sizes = classes_of([words_of(t) for t in as_bytes(batch.column(0))], own, endings)
            learned = np.repeat(batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64), sizes - DEPTH)
            codes, of = np.unique(grams(symbols, sizes, k), return_inverse=True)
            held = summed(np.concatenate([held[0], codes]), np.concatenate([held[1], np.bincount(of, learned, len(codes)).astype(np.int64)]))
            if len(held[0]) > FLUSH:
                yield pa.RecordBatch.from_arrays([*map(pa.array, held)], ["gram", "n"])
                held = np.empty(0, np.int64), np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([*map(pa.array, held)], ["gram", "n"])

    counts = docs.select(F.col(text).alias("text"), is_training.alias("learned")).mapInArrow(count_grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    by_class = spark.createDataFrame([(i, float(q)) for i, q in enumerate(shares) if q > 0], "next long, q double")
    gain_of = saved(gains(saved(counts), by_class, k))

    # words and grams with a share of COMMON or more: at most 1 / COMMON
    common = {bytes(w): n for w, n in of_words.where(F.col("n") >= COMMON * n_train).collect()}
    often = (F.col("n") >= COMMON * n_train) & (F.col("n") > 0)
    known = gain_of.where(often).orderBy("gram").select("gram", "gain").toArrow()
    shared = spark.sparkContext.broadcast((common, known["gram"].to_numpy(), known["gain"].to_numpy()))

    def score_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, known, gain_known = shared.value
        first, get = 0, common.get
        for batch in in_blocks(batches, "text"):
            words = [words_of(t) for t in as_bytes(batch.column(1))]
            n_tokens = np.fromiter((len(x) + 1 for x in words), np.int64, len(words))
            at = np.cumsum(n_tokens) - n_tokens
            codes = grams(*classes_of(words, own, endings), k)
            place = np.minimum(np.searchsorted(known, codes), max(len(known) - 1, 0))
            hit = known[place] == codes if len(known) else np.zeros(len(codes), dtype=bool)
            gain = np.zeros(len(codes))
            gain[hit] = gain_known[place[hit]]
            gain = np.add.reduceat(gain, at)
            cut = np.concatenate([[0], np.cumsum(np.add.reduceat((~hit).astype(np.int64), at))]).astype(np.int32)
            rare_grams = pa.ListArray.from_arrays(pa.array(cut), pa.array(codes[~hit]))
            count = np.fromiter(chain.from_iterable((*[get(w, 0) for w in x], texts) for x in words), np.int64, n_tokens.sum())
            sure = np.add.reduceat((count > 0).astype(np.int64), at)
            base = np.add.reduceat(np.log10(count + 1.0), at)
            odd = [Counter([w for w in x if w not in common]) for x in words]
            cut = np.cumsum([0, *map(len, odd)]).astype(np.int32)
            hashes = np.fromiter((xxhash.xxh64_intdigest(w, 42) for x in odd for w in x), np.uint64, cut[-1]).view(np.int64)
            times = np.fromiter((n for x in odd for n in x.values()), np.int64, cut[-1])
            rare = pa.ListArray.from_arrays(pa.array(cut), pa.StructArray.from_arrays([pa.array(hashes), pa.array(times)], ["h", "k"]))
            row = row_numbers(first, len(words))
            first += len(words)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (row, n_tokens, sure, base, gain)), rare, rare_grams], ["id", "row", "n_tokens", "sure", "base", "gain", "rare", "rare_grams"])

    kind = docs.schema[id_column].dataType.simpleString()
    scored = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")).mapInArrow(score_block, f"id {kind}, row long, n_tokens long, sure long, base double, gain double, rare array<struct<h:long,k:long>>, rare_grams array<long>")
    scored = saved(scored)
    counted = of_words.where(F.col("n") < COMMON * n_train).select(F.xxhash64("word").alias("h"), "n")
    odd = scored.select("row", F.explode("rare").alias("r")).select("row", "r.h", "r.k").join(counted, "h")
    odd = odd.groupBy("row").agg(F.sum("k").alias("more_sure"), F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("more_base"))
    more = scored.select("row", F.explode("rare_grams").alias("gram")).join(gain_of.where(~often).select("gram", F.col("gain").alias("g")), "gram")
    more = more.groupBy("row").agg(F.sum("g").alias("more_gain"))
    scored = scored.drop("rare", "rare_grams").join(odd, "row", "left").join(more, "row", "left")
    base = F.col("base") + F.coalesce("more_base", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(whole))
    return scored.select(
        F.col("id").alias(id_column),
        "n_tokens",
        (F.col("sure") + F.coalesce("more_sure", F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (base + F.col("gain") + F.coalesce("more_gain", F.lit(0.0))).alias("score"),
    )
