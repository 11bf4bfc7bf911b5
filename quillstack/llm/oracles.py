"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from quillstack.llm import mixing, secrets

_OP2 = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.row <> q.row)
SELECT query_id, (row_number() OVER w)::INT AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY row ORDER BY score DESC, vec_id) QUALIFY rank <= 20
"""

_OP3 = """
WITH table_ AS (
  SELECT list(c ORDER BY n) AS t FROM (
    SELECT n, list_reduce([n::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS c FROM range(256) r(n))),
h AS (SELECT doc_id, source, hex(encode(coalesce(text, ''))) AS x, '0x' || md5('17:' || coalesce(doc_id::VARCHAR, 'null'))[1:12] AS draw FROM documents),
d AS (
  SELECT doc_id, source, draw::BIGINT AS draw, length(x) // 2 + 8 AS size,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(length(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT)),
      lambda a, b: xor(a // 256, t[xor(a, b) % 256 + 1])), 4294967295) AS text_crc32
  FROM h, table_),
f AS (
  SELECT *, (row_number() OVER (PARTITION BY source ORDER BY draw, doc_id NULLS FIRST, text_crc32, size) - 1
    + ('0x' || md5('17/' || coalesce('=' || source, 'null'))[1:8])::BIGINT / 4294967296.0::DOUBLE) / count(*) OVER (PARTITION BY source) AS frac FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY frac, source NULLS FIRST, draw, doc_id NULLS FIRST, text_crc32, size) - 1 AS pos, count(*) OVER () AS n FROM f)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, (pos * 24 // n)::INT AS shard, (pos - (pos * 24 // n * n + 23) // 24)::BIGINT AS slot, NULL::INT AS grown_shard FROM p
"""

_OP4 = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def _op6() -> str:
    (w1, w2, w3), b = mixing.WEIGHTS, mixing.BLOCK_WORDS
    return f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    ('0x' || md5('29:' || coalesce(doc_id::VARCHAR, 'null'))[1:12])::BIGINT AS draw FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, {mixing.MOST} * sum(size)::DOUBLE AS cap,
    [{w1}, {w2}, {w3}][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY source),
o AS (
  SELECT *, row_number() OVER f AS k, {mixing.SHARE} * sum(source_size) OVER () - coalesce(sum(cap) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_,
    sum(w) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS over_
  FROM s WINDOW f AS (ORDER BY cap / w, source NULLS LAST)),
a AS (SELECT arg_min({{'k': k, 'l': left_, 'o': over_}}, k) AS lvl FROM o WHERE cap / w >= left_ / over_),
t AS (
  SELECT source, source_size, CASE WHEN k < lvl.k THEN cap ELSE coalesce(least(cap, w * lvl.l / lvl.o), cap) END AS target FROM o, a),
q AS (
  SELECT *, (source_size + {b - 1}) // {b} AS blocks,
    CASE WHEN source_size > 0 THEN (quota // source_size) * ((source_size + {b - 1}) // {b}) + (quota % source_size + {b - 1}) // {b} ELSE 0 END AS slots
  FROM (SELECT *, least(floor(target + 0.5), floor({mixing.MOST} * source_size))::BIGINT AS quota FROM t)),
n AS (SELECT coalesce(sum(slots), 0)::BIGINT AS n FROM q),
arc AS (SELECT q.*, (sum(slots) OVER w - slots)::DOUBLE / n AS lo, (sum(slots) OVER w)::DOUBLE / n AS hi FROM q, n WINDOW w AS (ORDER BY source NULLS LAST)),
x AS (SELECT k, floor(k / {1 << 20}::DOUBLE) * {mixing.GOLDEN * (1 << 20) % 1.0!r}::DOUBLE + (k % {1 << 20}) * {mixing.GOLDEN!r}::DOUBLE AS x FROM (SELECT unnest(range(n)) AS k FROM n)),
hit AS (SELECT k AS slot, source, slots, row_number() OVER (PARTITION BY source ORDER BY k) - 1 AS rank FROM x JOIN arc ON x - floor(x) >= lo AND x - floor(x) < hi),
late AS (SELECT source, unnest(range(coalesce(got, 0), slots)) AS rank FROM q LEFT JOIN (SELECT source AS s, count(*) AS got FROM hit GROUP BY source) ON s IS NOT DISTINCT FROM source WHERE coalesce(got, 0) < slots),
turn AS (SELECT slot, source, rank FROM hit WHERE rank < slots UNION ALL SELECT n + rank, source, rank FROM late, n),
slot AS (
  SELECT slot, turn.source, rank % blocks AS block, least({b}, source_size - rank % blocks * {b}, quota - rank // blocks * source_size - rank % blocks * {b}) AS words
  FROM turn JOIN q ON turn.source IS NOT DISTINCT FROM q.source),
p AS (
  SELECT row_number() OVER () AS row, d.doc_id, d.source, d.size, q.source_size, q.target, quota,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY draw, doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
f AS (
  SELECT row, min(slot) AS first_slot FROM (SELECT *, unnest(range(pos // {b}, (pos + size - 1) // {b} + 1)) AS cell FROM p WHERE size > 0) z
  JOIN slot ON slot.source IS NOT DISTINCT FROM z.source AND block = cell AND words > greatest(pos - cell * {b}, 0) GROUP BY row)
SELECT doc_id, size, source_size, target,
  CASE WHEN size = 0 THEN 0 ELSE (quota // source_size) * size + greatest(0, least(quota % source_size - pos, size)) END::BIGINT AS taken, first_slot
FROM p LEFT JOIN f USING (row)
"""


def _op7() -> str:
    def found(kind: int, pattern: str, group: int) -> str:
        p = pattern.replace("'", "''")
        return f"""
  SELECT row, repo, owner, {kind} AS kind, unnest(string_split_regex(text, '{p}')) AS gap, unnest(regexp_extract_all(text, '{p}', 0)) AS m,
    unnest(regexp_extract_all(text, '{p}', {group})) AS v, generate_subscripts(string_split_regex(text, '{p}'), 1) AS i FROM d WHERE regexp_matches(text, '{p}')"""

    parts = "\n  UNION ALL".join(found(k, p, g) for k, (p, g) in enumerate([(secrets.ASSIGN, 2), (secrets.ACCESS, 0), (secrets.HEX, 0), (secrets.SHAPED, 0)]))
    names = "['assign', 'access', 'hex', 'live']"
    joined = "array_to_string(list_transform({}, lambda s: {}[s.k + 1] || ':' || s.a || ':' || s.b), ',')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce('=' || source, 'null') AS repo, CASE WHEN source IS NULL AND lang IS NULL THEN 'null' ELSE '=' || concat_ws('/', source, lang) END AS owner, coalesce(text, '') AS text FROM documents),
f AS ({parts}),
h AS (
  SELECT row, repo, owner, kind, v, (sum(length(gap)) OVER w + coalesce(sum(length(m)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS a, length(m) AS n
  FROM f WHERE m IS NOT NULL WINDOW w AS (PARTITION BY row, kind ORDER BY i)),
c AS (SELECT *, a + n AS b FROM h WHERE CASE WHEN kind = 0 THEN length(v) ELSE n END >= [8, 16, 32, 0][kind + 1]),
u AS (SELECT v, count(DISTINCT repo) AS repos, count(DISTINCT owner) AS owners FROM c GROUP BY v),
j AS (
  SELECT c.*, repos <= {secrets.MOST_REPOSITORIES} AND owners <= {secrets.MOST_OWNERS} AS single,
    len(list_distinct(string_split(c.v, ''))) >= {secrets.LEAST_DIFFERENT} AND NOT regexp_matches(c.v, '{secrets.EXAMPLE_WORDS}') AS looks
  FROM c JOIN u USING (v)),
g AS (
  SELECT row, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    coalesce(list_sort(list({{'a': a, 'k': kind, 'b': b}}) FILTER (kind < 3)), []) AS base,
    coalesce(list_distinct(list({{'a': b - length(v), 'k': 3, 'b': b}}) FILTER (single AND looks)), []) AS added, count(*) FILTER (NOT single) AS n_example
  FROM j GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce({joined.format("base", names)}, '')) AS base_sha256, coalesce({joined.format("list_sort(list_concat(base, added))", names)}, '') AS spans,
  coalesce(len(added), 0)::BIGINT AS n_live, coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN g USING (row)
"""


_OP11 = """
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT row) >= 30),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS total FROM groups g LEFT JOIN counts c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.total + 5 * l.v))::BIGINT AS p, (1 + (1000000000::HUGEINT * (k.n + 5)) // (l.total + 5 * l.v))::BIGINT AS q
  FROM totals g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON g.lang = c.lang AND g.source = c.source AND k.term = c.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value FROM shares a JOIN shares b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts QUALIFY part = 'pair' OR rank <= 50
"""


def _op13() -> str:
    """The rounds one after the other, every vector against every centroid."""
    square = "list_sum(list_transform(list_zip(r.v, c.m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    floored = "((s - ((s % n) + n) % n) // n)::BIGINT"
    steps = []
    for i in range(4):
        steps.append(f"a{i} AS MATERIALIZED (SELECT r.row, min({{'d': {square}, 'c': c.c}}) AS best FROM r CROSS JOIN c{i} c GROUP BY r.row)")
        if i < 3:
            steps.append(
                f"s{i} AS MATERIALIZED (SELECT c, list({floored} ORDER BY i) AS m FROM (SELECT best.c AS c, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT best, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM a{i} JOIN r USING (row)) GROUP BY ALL) GROUP BY c),\n"
                f"c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(s{i}.m, c{i}.m) AS m FROM c{i} LEFT JOIN s{i} USING (c))"
            )
    return f"""
WITH r AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1)::INT AS c, v AS m FROM r QUALIFY c < 16),
{", ".join(steps)}
SELECT vec_id, best.c AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia, (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a3 JOIN r USING (row) JOIN c3 ON c3.c = best.c
"""


ORACLES = {"op2_exact_topk": _OP2, "op3_stratified_sharding": _OP3, "op4_exact_dedup": _OP4, "op6_source_mixing": _op6(), "op7_secret_scan": _op7(), "op11_source_divergence": _OP11, "op13_ball_kmeans": _op13()}
