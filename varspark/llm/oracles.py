"""The results of the operators as DuckDB SQL, where SQL can express them: sharding, the n-gram Jaccard join, repeated bytes and near vectors."""

from __future__ import annotations

import string

from varspark.llm.mixing import BLOCKS, COPIES, WORD, epoch_seed
from varspark.llm.sharding import PRIME, round_keys


def once(source: str, seed: int) -> str:
    """One pass of the permutation over the column x of `source` (n, x), with the sides a and b from the table `size`."""
    sql = f"SELECT n, x // b AS p, x % b AS q, a, b FROM {source}, size"
    for k, (mul, add) in enumerate(round_keys(seed)):
        side = "a" if k % 2 == 0 else "b"
        sql = f"SELECT n, q AS p, (p + t * t % {PRIME}) % {side} AS q, a, b FROM (SELECT *, (q * {mul} + {add}) % {PRIME} AS t FROM ({sql}))"
    return f"SELECT n, p * b + q AS x FROM ({sql})"


def sharding(shards: int = 16, seed: int = 2029) -> str:
    digit = lambda k: f"(instr('0123456789ABCDEF', h[{k}]) - 1)"
    table = "SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(cast(i AS BIGINT), range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(i))"
    return f"""WITH RECURSIVE crc AS ({table}),
bytes AS (SELECT doc_id, coalesce(text, '') AS text, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: cast({digit(1)} * 16 + {digit(2)} AS BIGINT)) AS own FROM documents),
short AS (SELECT doc_id, cast(octet_length(encode(text)) + 1 AS BIGINT) AS size, xor(list_reduce(list_prepend(cast(4294967295 AS BIGINT), own), lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295) AS text_crc32 FROM bytes, crc),
numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS n FROM short),
size AS (SELECT total, a, (total + a - 1) // a AS b FROM (SELECT count(*) AS total, cast(floor(sqrt(greatest(count(*), 1) - 1)) AS BIGINT) + 1 AS a FROM documents)),
walk AS ({once('(SELECT n, n AS x FROM numbered)', seed)} UNION ALL {once('(SELECT n, x FROM walk, size WHERE x >= total)', seed)}),
placed AS (SELECT n, x FROM walk, size WHERE x < total)
SELECT doc_id, size, text_crc32, 'rows' AS law, cast(x % {shards} AS INTEGER) AS shard, x // {shards} AS slot, cast(NULL AS INTEGER) AS grown_shard, n AS row_number FROM numbered JOIN placed USING (n)"""


def jaccard(gram: int = 5, percent: int = 80) -> str:
    return f"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {gram} THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - {gram - 2}), lambda i: array_to_string(w[i : i + {gram - 1}], ' '))) END AS s FROM words),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, x.n + y.n AS n, count(*) AS c FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * c >= {percent} * (n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, least) AS (SELECT doc_id, doc_id FROM sets UNION SELECT b, least FROM reach JOIN edges ON id = a WHERE least < b),
parts AS (SELECT id, min(least) AS component_id FROM reach GROUP BY id)
SELECT doc_id, cast(len(s) AS BIGINT) AS n_shingles, component_id FROM sets JOIN parts ON doc_id = id"""


def repeats(long: int = 100) -> str:
    """Every window of `long` bytes by its hash; those that are not the first of theirs are cut out. Keys must be distinct."""
    return f"""WITH texts AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
places AS (SELECT doc_id, b, range(1, octet_length(b) - {long - 2}) AS p FROM texts),
windows AS (SELECT doc_id, unnest(p) AS p, unnest(list_transform(p, lambda i: hash(b[i : i + {long - 1}]))) AS h FROM places),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS k FROM windows) WHERE k > 1),
begun AS (SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= {long} AS on_ FROM again),
numbered AS (SELECT doc_id, p, count(*) FILTER (on_ IS NOT true) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM begun),
runs AS (SELECT doc_id, min(p) AS lo, max(p) + {long - 1} AS hi FROM numbered GROUP BY doc_id, run),
cuts AS (SELECT doc_id, lo, hi FROM runs UNION ALL SELECT doc_id, octet_length(b) + 1, octet_length(b) FROM texts),
stays AS (SELECT doc_id, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo, hi) + 1 AS lo, lo - 1 AS hi, hi - lo + 1 AS gone FROM cuts),
kept AS (SELECT doc_id, cast(sum(gone) AS BIGINT) AS n_removed, count(*) - 1 AS n_spans, sha256(unhex(string_agg(CASE WHEN hi >= lo THEN hex(b[lo : hi]) ELSE '' END, '' ORDER BY lo))) AS kept_sha256 FROM stays JOIN texts USING (doc_id) GROUP BY doc_id)
SELECT doc_id, octet_length(b) AS n_bytes, n_removed, n_spans, kept_sha256 FROM texts JOIN kept USING (doc_id)"""


def near_vectors(limit: float = 0.9) -> str:
    """All pairs of usable vectors; exact, so the forest equals it only where it misses no link."""
    return f"""WITH RECURSIVE vectors AS (SELECT vec_id, list_transform(cast(embedding AS DOUBLE[]), lambda c: coalesce(c, cast('nan' AS DOUBLE))) AS v FROM embeddings),
usable AS (SELECT vec_id, v FROM vectors WHERE len(list_filter(v, lambda c: isfinite(c))) = len(v) AND list_sum(list_transform(v, lambda c: c * c)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y ON x.vec_id != y.vec_id AND len(x.v) = len(y.v) WHERE list_cosine_similarity(x.v, y.v) >= {limit}),
counts AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a),
reach(vec_id, least) AS (SELECT vec_id, vec_id FROM vectors UNION SELECT b, least FROM reach JOIN links ON vec_id = a WHERE least < b),
parts AS (SELECT vec_id, min(least) AS component_id FROM reach GROUP BY vec_id)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM parts LEFT JOIN counts USING (vec_id)"""


def clusters(k: int = 16, width: int = 64, scale: int = 64, rounds: int = 3, seed: int = 1) -> str:
    """Every vector against every centroid; a round is a table of assignments and one of means."""
    assigned = """SELECT r, vec_id, first(number ORDER BY d, number) AS cluster, min(d) AS distance FROM
  (SELECT r, vec_id, number, cast(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM kept, {0}) GROUP BY r, vec_id"""
    steps = []
    for i in range(rounds):
        steps.append(f"""a{i} AS ({assigned.format(f"c{i}")}),
s{i} AS (SELECT cluster, place, cast(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT cluster, generate_subscripts(v, 1) AS place, unnest(v) AS x FROM a{i} JOIN kept USING (r)) GROUP BY cluster, place),
m{i} AS (SELECT cluster, list(cast((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY place) AS c FROM s{i} GROUP BY cluster),
c{i + 1} AS (SELECT number, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} ON number = cluster)""")
    return f"""WITH vectors AS (SELECT row_number() OVER () AS r, vec_id, list_transform(cast(embedding AS DOUBLE[]), lambda x: coalesce(x, cast('nan' AS DOUBLE))) AS e FROM embeddings WHERE len(embedding) = {width}),
kept AS MATERIALIZED (SELECT r, vec_id, list_transform(e, lambda x: cast(floor({scale} * x) AS BIGINT)) AS v FROM vectors WHERE len(list_filter(e, lambda x: isfinite(x))) = {width}),
c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS number, v AS c FROM (SELECT sha256('{seed}:' || vec_id) AS h, v FROM kept ORDER BY h, v LIMIT {k})),
{", ".join(steps)},
placed AS ({assigned.format(f'c{rounds}')}),
inertia AS (SELECT cluster, cast(sum(distance) AS BIGINT) AS cluster_inertia FROM placed GROUP BY cluster)
SELECT vec_id, cast(p.cluster AS INTEGER) AS cluster, distance, cluster_inertia, (SELECT cast(sum(distance) AS BIGINT) FROM placed) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM placed p JOIN inertia USING (cluster) JOIN c{rounds} ON number = p.cluster"""


def middles(seed: int = 42, plain_percent: int = 50, spm_percent: int = 80) -> str:
    whole = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
    h = [f"cast(('0x' || substr(digest, {1 + 8 * k}, 8)) AS BIGINT)" for k in range(4)]
    return f"""WITH units AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{whole}') AS u, sha256('{seed}:' || doc_id) AS digest FROM documents),
numbers AS (SELECT *, len(u) AS n, {h[0]} % (len(u) + 1) AS a, {h[1]} % (len(u) + 1) AS b, {h[2]} % 100 AS c, {h[3]} % 100 AS d FROM units),
cut AS (SELECT *, array_to_string(u[1 : least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1 : greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1 :], '') AS s,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR c >= {plain_percent} THEN 'plain' WHEN d < {spm_percent} THEN 'spm' ELSE 'psm' END AS form FROM numbers)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(p || m || s) AS restored_sha256 FROM cut"""


def mix(seed: int = 12) -> str:
    """The same permutations, layout and quotas over all blocks of all passes; a document's words are added up over its blocks."""
    keys = [round_keys(epoch_seed(seed, e)) for e in range(COPIES)]
    by_epoch = lambda r, which: "CASE epoch " + " ".join(f"WHEN {e} THEN {keys[e][r][which]}" for e in range(COPIES)) + " END"

    def turned(source: str) -> str:
        sql = f"SELECT number, epoch, k, blocks, x // b AS p, x % b AS q, a, b FROM {source}"
        for r in range(len(keys[0])):
            side = "a" if r % 2 == 0 else "b"
            sql = f"SELECT number, epoch, k, blocks, q AS p, (p + t * t % {PRIME}) % {side} AS q, a, b FROM (SELECT *, (q * cast({by_epoch(r, 0)} AS BIGINT) + {by_epoch(r, 1)}) % {PRIME} AS t FROM ({sql}))"
        return f"SELECT number, epoch, k, blocks, p * b + q AS x, a, b FROM ({sql})"

    weight = "CASE number % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END"
    return f"""WITH RECURSIVE own AS (SELECT row_number() OVER () AS r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size, md5(coalesce(text, '')) AS digest FROM documents),
sources AS (SELECT source, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS number, cast(sum(size) AS BIGINT) AS source_size FROM own GROUP BY source),
weighed AS (SELECT *, {weight} AS w, {COPIES} * source_size / cast({weight} AS DOUBLE) AS ratio FROM sources),
summed AS (SELECT *, coalesce(sum({COPIES} * source_size) OVER before, 0) AS capped, coalesce(sum(w) OVER before, 0) AS spent, sum(source_size) OVER () AS total, sum(w) OVER () AS weights FROM weighed WINDOW before AS (ORDER BY ratio, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT arg_min(total - capped, ratio) AS rest, arg_min(weights - spent, ratio) AS weight FROM summed WHERE w * (total - capped) <= {COPIES} * source_size * (weights - spent)),
aimed AS (SELECT number, source, source_size, CASE WHEN w * rest > {COPIES} * source_size * weight THEN cast({COPIES} * source_size AS DOUBLE) ELSE cast(w * rest AS DOUBLE) / cast(weight AS DOUBLE) END AS target FROM weighed, level),
block AS (SELECT greatest(1, (cast(sum(source_size) AS BIGINT) + {BLOCKS - 1}) // {BLOCKS}) AS size FROM sources),
facts AS (SELECT number, source_size, cast(floor(target + 0.5) AS BIGINT) AS words, (source_size + block.size - 1) // block.size AS blocks FROM aimed, block),
sided AS (SELECT *, (blocks + a - 1) // a AS b FROM (SELECT *, cast(floor(sqrt(blocks - 1)) AS BIGINT) + 1 AS a FROM facts WHERE blocks > 0)),
every AS (SELECT number, epoch, k, blocks, a, b FROM (SELECT *, unnest(range(blocks)) AS k FROM sided), range({COPIES}) AS e(epoch)),
walk AS ({turned("(SELECT number, epoch, k, blocks, k AS x, a, b FROM every)")} UNION ALL {turned("(SELECT * FROM walk WHERE x >= blocks)")}),
placed AS (SELECT number, epoch, k, x AS p, max(CASE WHEN k = blocks - 1 THEN x END) OVER (PARTITION BY number, epoch) AS last FROM walk WHERE x < blocks),
sized AS (SELECT number, epoch, k, p, last, block.size AS len, source_size - (blocks - 1) * block.size AS short, greatest(0, least(words - epoch * source_size, source_size)) AS rest, k = blocks - 1 AS ends FROM placed JOIN facts USING (number), block),
drawn AS (SELECT number, k, epoch, greatest(0, least(rest - (p * len - CASE WHEN last < p THEN len - short ELSE 0 END), CASE WHEN ends THEN short ELSE len END)) AS taken FROM sized),
laid AS (SELECT r, number, size, cast(sum(size) OVER (PARTITION BY number ORDER BY substr(md5(concat(doc_id, ':', digest)), 1, 15), doc_id, digest ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start FROM own JOIN sources ON own.source IS NOT DISTINCT FROM sources.source),
spans AS (SELECT r, number, start, laid.size, block.size AS len, unnest(range(start // block.size, (start + laid.size - 1) // block.size + 1)) AS k FROM laid, block WHERE laid.size > 0),
took AS (SELECT r, sum(greatest(0, least(taken - (greatest(start, k * len) - k * len), least(start + size, (k + 1) * len) - greatest(start, k * len)))) AS taken FROM spans JOIN drawn USING (number, k) GROUP BY r)
SELECT doc_id, cast(size AS BIGINT) AS size, source_size, target, cast(coalesce(taken, 0) AS BIGINT) AS taken FROM own JOIN aimed ON own.source IS NOT DISTINCT FROM aimed.source LEFT JOIN took USING (r)"""
