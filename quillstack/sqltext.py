"""DuckDB twins of the engine's tables and functions, as common table expressions for the oracles.

What a query means (``Asked``) and every weight is written out here or beside the query, not taken from the
engine's own parser and constants.
"""

from __future__ import annotations

from dataclasses import dataclass

from quillstack.sources.samples import BASE_MS, HOUR_MS

NL = "chr(10)"


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def fold(x: str) -> str:
    return f"lower(replace(replace(strip_accents({x}), '''', ''), '’', ''))"


def key(x: str) -> str:
    return rf"trim(regexp_replace({fold(x)}, '\s+', ' ', 'g'))"


def let(x: str, body: str) -> str:
    """body, an expression in s, for s = x."""
    return f"list_transform([{x}], lambda s: {body})[1]"


def _ends(*tails: str) -> str:
    return "(" + " OR ".join(f"ends_with(s, '{t}')" for t in tails) + ")"


def _cut(n: int) -> str:
    return f"left(s, length(s) - {n})"


_RESTORED = (
    "CASE WHEN length(r) < 3 THEN r WHEN right(r, 1) = left(right(r, 2), 1) AND right(r, 1) NOT IN ('a', 'e', 'i', 'o', 'u', 'l', 's', 'z') THEN left(r, length(r) - 1) "
    "WHEN ends_with(r, 'at') OR ends_with(r, 'bl') OR ends_with(r, 'iz') OR ends_with(r, 'v') OR ends_with(r, 'u') THEN r || 'e' ELSE r END"
)


def stem(x: str) -> str:
    restored = lambda n: f"list_transform([{_cut(n)}], lambda r: {_RESTORED})[1]"
    plural = (
        f"CASE WHEN {_ends('ies')} AND length(s) > 4 THEN {_cut(3)} || 'y' WHEN {_ends('sses')} THEN {_cut(2)} WHEN {_ends('ses')} AND length(s) > 4 THEN {_cut(2)} "
        f"WHEN {_ends('xes', 'zes', 'ches', 'shes')} THEN {_cut(2)} WHEN {_ends('s')} AND NOT {_ends('ss', 'us', 'is')} THEN {_cut(1)} ELSE s END"
    )
    verbal = f"CASE WHEN {_ends('ing')} AND length(s) > 5 THEN {restored(3)} WHEN {_ends('edly')} AND length(s) > 6 THEN {restored(4)} WHEN {_ends('ed')} AND length(s) > 4 THEN {restored(2)} ELSE s END"
    out = let(let(x, plural), verbal)
    for tail, least in (("ly", 4), ("ment", 6), ("ness", 6)):
        out = let(out, f"CASE WHEN {_ends(tail)} AND length(s) > {least} THEN {_cut(len(tail))} ELSE s END")
    return f"CASE WHEN length({x}) <= 3 THEN {x} ELSE {out} END"


def parts(w: str) -> str:
    out = f"regexp_replace({w}, '[_''’]', ' ', 'g')"
    for b in (r"([a-z])([A-Z])", r"([A-Z])([A-Z][a-z])", r"([0-9])([^0-9 ])", r"([^0-9 ])([0-9])"):
        out = rf"regexp_replace({out}, '{b}', '\1 \2', 'g')"
    return f"list_filter(string_split({out}, ' '), lambda p: p <> '')"


def trigrams(x: str) -> str:
    return f"list_distinct(list_transform(range(1, length({x}) + 2), lambda i: substring('  ' || {x} || ' ', i, 3)))"


WORD = "[\\p{L}\\p{N}][\\p{L}\\p{N}''’_]*"
DOC_NOTES = f"""
notes AS (
  SELECT doc_id::VARCHAR AS note_id, 'doc ' || doc_id AS title,
    coalesce(text, '') || {NL} || '#' || lang || '/' || source || CASE WHEN doc_id % 23 <> 22 THEN {NL} || '[[doc ' || (doc_id * 7 % 1200) || ']]' ELSE '' END
      || CASE doc_id % 3 WHEN 0 THEN {NL} || '- [ ] open' WHEN 1 THEN {NL} || '- [x] done' ELSE '' END AS body,
    {BASE_MS} + doc_id * {HOUR_MS} AS created_at, {BASE_MS} + doc_id * 7919 % 2000 * {HOUR_MS} AS updated_at,
    doc_id % 17 = 0 AS pinned, doc_id % 11 = 0 AS archived, doc_id % 19 = 0 AS locked, CASE WHEN doc_id % 13 = 0 THEN {BASE_MS} + doc_id * 7919 % 2000 * {HOUR_MS} END AS trashed_at,
    (1 + doc_id % 60)::INT AS rev
  FROM documents)"""
CLEAN = "regexp_replace(regexp_replace(body, '```(?s:.*?)(?:```|\\z)', ' ', 'g'), '`[^`\\n]*`', ' ', 'g')"
TAGS = f"""
tags AS (
  SELECT note_id, list_sort(list_distinct(list_filter(list_transform(list_filter(regexp_extract_all({CLEAN}, '(^|[\\s(\\[])#([\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}_/-]*)', 2),
    lambda t: regexp_matches(t, '\\p{{L}}')), lambda t: regexp_replace({fold("t")}, '/+$', '')), lambda t: t <> ''))) AS tags FROM notes)"""
LINKS = f"""
link AS (
  SELECT note_id, updated_at, trashed_at, unnest(list_distinct(list_transform(list_filter(regexp_extract_all({CLEAN}, '\\[\\[([^\\]|\\n]+)(?:\\|([^\\]\\n]*))?\\]\\]', 1), lambda t: trim(t) <> ''), lambda t: {key("t")}))) AS key FROM notes),
byk AS (SELECT {key("title")} AS key, arg_min(note_id, {{'u': -updated_at, 'n': note_id}}) AS dst FROM notes WHERE trashed_at IS NULL AND {key("title")} <> '' GROUP BY 1),
target AS (SELECT link.note_id AS src, link.key, link.updated_at, byk.dst FROM link LEFT JOIN byk USING (key) WHERE trashed_at IS NULL),
edge AS (SELECT DISTINCT src, dst FROM target WHERE dst IS NOT NULL AND dst <> src)"""
TOKENS = f"""
word AS (
  SELECT note_id, field, regexp_replace(unnest(regexp_extract_all(text, '{WORD}')), '[''’_]+$', '') AS w FROM (
    SELECT note_id, 'title' AS field, title AS text FROM notes UNION ALL SELECT note_id, 'body', body FROM notes
    UNION ALL SELECT note_id, 'tag', replace(array_to_string(tags, ' '), '/', ' ') FROM tags)),
token AS (SELECT note_id, field, unnest(list_transform(list_concat([w], CASE WHEN len({parts("w")}) > 1 THEN {parts("w")} ELSE [] END), lambda x: {fold("x")})) AS term FROM word WHERE w <> ''),
post AS (
  SELECT term, note_id, count(*) FILTER (field = 'title')::INT AS tf_title, count(*) FILTER (field = 'body')::INT AS tf_body, count(*) FILTER (field = 'tag')::INT AS tf_tag
  FROM token WHERE term <> '' GROUP BY ALL),
vocab AS (SELECT *, {stem("term")} AS stem FROM (SELECT term, count(*) AS df FROM post GROUP BY term)),
lens AS (SELECT note_id, sum(tf_title) AS len_title, sum(tf_body) AS len_body, sum(tf_tag) AS len_tag FROM post GROUP BY note_id),
linked AS (
  SELECT n.note_id, (SELECT count(*) FROM link l WHERE l.note_id = n.note_id) + (SELECT count(*) FROM edge e WHERE e.dst = n.note_id) AS link_count FROM notes n),
docs AS (
  SELECT n.note_id, {fold("n.title")} AS folded_title, created_at, updated_at, pinned, archived, trashed_at IS NOT NULL AS trashed, locked, tags,
    regexp_matches(body, '(?m)^\\s*[-*]\\s+\\[ \\]') AS has_open, regexp_matches(body, '(?m)^\\s*[-*]\\s+\\[[xX]\\]') AS has_done, link_count,
    coalesce(len_title, 0) AS len_title, coalesce(len_body, 0) AS len_body, coalesce(len_tag, 0) AS len_tag
  FROM notes n JOIN tags USING (note_id) JOIN linked USING (note_id) LEFT JOIN lens USING (note_id)),
stats AS (SELECT greatest(1, count(*)) AS n, greatest(1.0, avg(len_title)) AS avg_title, greatest(1.0, avg(len_body)) AS avg_body, greatest(1.0, avg(len_tag)) AS avg_tag FROM docs)"""
ALL = f"WITH {DOC_NOTES},{TAGS},{LINKS},{TOKENS}"


def values(rows: list[tuple], names: str) -> str:
    cell = lambda v: "NULL" if v is None else quote(v) if isinstance(v, str) else str(v)
    return f"(VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS v({names})"


@dataclass
class Asked:
    """What a query text means, as a reader of the query language writes it down. dates: (created or updated, < or >, epoch ms)."""

    terms: tuple[str, ...] = ()
    phrases: tuple[tuple[str, ...], ...] = ()
    excluded: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    states: tuple[str, ...] = ()
    scope: str = "active"
    dates: tuple[tuple[str, str, int], ...] = ()


def _list(values, kind: str = "VARCHAR") -> str:
    return f"[{', '.join(values)}]::{kind}[]"


def pattern(phrase: tuple[str, ...]) -> str:
    return "(?i)" + r"[^\p{L}\p{N}]+".join(phrase)


def asked_table(queries: dict[str, Asked], scope: str | None = None) -> str:
    """q: query_id, ranked, patterns, excluded, wanted, states, scope, dates."""
    rows = []
    for i, q in queries.items():
        ranked = list(dict.fromkeys([*q.terms, *(t for p in q.phrases for t in p)]))
        dates = [f"{{'f': {quote(f)}, 'op': {quote(op)}, 'ms': {at}::BIGINT}}" for f, op, at in q.dates]
        lists = [_list(map(quote, x)) for x in (ranked, map(pattern, q.phrases), q.excluded, q.tags, q.states)]
        rows.append(f"({quote(i)}, {', '.join(lists)}, {quote(scope or q.scope)}, {_list(dates, 'STRUCT(f VARCHAR, op VARCHAR, ms BIGINT)')})")
    return f"q AS (SELECT * FROM (VALUES {', '.join(rows)}) AS v(query_id, ranked, patterns, excluded, wanted, states, scope, dates))"


#: A query's filters over docs d.
PREDICATE = """CASE q.scope WHEN 'active' THEN NOT d.archived AND NOT d.trashed WHEN 'archive' THEN d.archived AND NOT d.trashed WHEN 'trash' THEN d.trashed ELSE NOT d.trashed END
  AND len(list_filter(q.wanted, lambda w: len(list_filter(d.tags, lambda t: t = w OR starts_with(t, w || '/'))) = 0)) = 0
  AND len(list_filter(q.states, lambda s: NOT CASE s WHEN 'pinned' THEN d.pinned WHEN 'todo' THEN d.has_open WHEN 'done' THEN d.has_done WHEN 'locked' THEN d.locked WHEN 'linked' THEN d.link_count > 0 WHEN 'orphan' THEN d.link_count = 0 ELSE len(d.tags) = 0 END)) = 0
  AND len(list_filter(q.dates, lambda x: NOT CASE x.op WHEN '>' THEN CASE x.f WHEN 'created' THEN d.created_at ELSE d.updated_at END >= x.ms ELSE CASE x.f WHEN 'created' THEN d.created_at ELSE d.updated_at END <= x.ms END)) = 0"""

def _single(x: str) -> str:
    """Letters that folding leaves outside of ASCII as a byte each, which is what DuckDB's distances count."""
    return f"translate({x}, 'ßæœøłđðþı', 'ABCDEFGHI')"


_PLAIN, _SWAPS = (f"{f}({_single('term')}, {_single('surface')})" for f in ("levenshtein", "damerau_levenshtein"))


def _around(a: str, b: str) -> str:
    """Whether b has two neighbours of a swapped around a letter: two edits to DuckDB, three where a swapped pair isn't edited again."""
    return f"len(list_filter(range(0, length({a})), lambda i: left({a}, i) = left({b}, i) AND {a}[i + 1] = {b}[i + 3] AND {a}[i + 2] = {b}[i + 1] AND substring({a}, i + 3) = substring({b}, i + 4))) > 0"


_BUDGET = "CASE WHEN length(term) <= 3 THEN 0 WHEN length(term) <= 5 THEN 1 ELSE 2 END"
#: The expansion of the ranked terms of q: asked, layers and expn (query_id, i, surface, weight).
EXPANSION = f"""
asked AS (SELECT query_id, (unnest(range(1, len(ranked) + 1)) - 1) AS i, unnest(ranked) AS term, unnest(list_concat(ranked[2:], [NULL::VARCHAR])) AS next FROM q WHERE len(ranked) > 0),
terms AS (SELECT DISTINCT term, {stem("term")} AS stem, {_BUDGET} AS budget, term IN (SELECT term FROM vocab) AS known FROM asked),
prefix AS (
  SELECT term, surface FROM (
    SELECT t.term, v.term AS surface FROM terms t JOIN vocab v ON starts_with(v.term, t.term) AND length(v.term) > length(t.term)
    QUALIFY row_number() OVER (PARTITION BY t.term ORDER BY v.term) <= 192)
  QUALIFY row_number() OVER (PARTITION BY term ORDER BY length(surface), surface) <= 24),
gram AS (SELECT term AS surface, unnest({trigrams("term")}) AS g FROM vocab),
qgram AS (SELECT term, budget, greatest(1, len({trigrams("term")}) - 3 * budget) AS needed, unnest({trigrams("term")}) AS g FROM terms WHERE budget > 0 AND NOT known),
close AS (
  SELECT term, surface, {_SWAPS} AS distance
  FROM (SELECT term, surface, any_value(budget) AS budget FROM qgram JOIN gram USING (g) WHERE abs(length(surface) - length(term)) <= budget GROUP BY term, surface HAVING count(*) >= any_value(needed))
  WHERE surface <> term AND {_SWAPS} <= budget AND NOT ({_SWAPS} = 2 AND {_PLAIN} > 2 AND ({_around("term", "surface")} OR {_around("surface", "term")}))),
near AS (SELECT * FROM close QUALIFY row_number() OVER (PARTITION BY term ORDER BY distance, surface) <= 12),
cut AS (SELECT term, unnest(range(3, length(term) - 2)) AS i FROM terms WHERE length(term) >= 6 AND NOT known),
half AS (
  SELECT term, arg_min([left(term, i), substring(term, i + 1)], i) AS ab FROM cut
  WHERE left(term, i) IN (SELECT term FROM vocab) AND substring(term, i + 1) IN (SELECT term FROM vocab) GROUP BY term),
layer AS (
  SELECT term, term AS surface, 1.0::DOUBLE AS weight FROM terms WHERE known
  UNION ALL SELECT t.term, t.stem, 0.85 FROM terms t WHERE stem IN (SELECT term FROM vocab)
  UNION ALL SELECT t.term, v.term, 0.85 FROM terms t JOIN vocab v ON v.stem = t.stem AND v.stem <> v.term
  UNION ALL SELECT term, surface, 0.7 * pow(length(term)::DOUBLE / length(surface), 0.35) FROM prefix
  UNION ALL SELECT term, surface, 0.55 / distance FROM near
  UNION ALL SELECT term, unnest(ab), 0.75 FROM half),
expn AS (
  SELECT query_id, i, surface, max(weight) AS weight FROM (
    SELECT a.query_id, a.i, l.surface, l.weight FROM asked a JOIN layer l USING (term)
    UNION ALL SELECT query_id, unnest([i, i + 1]), term || next, 0.9 FROM asked WHERE term || next IN (SELECT term FROM vocab))
  GROUP BY ALL)"""


_HAY = fold(f"n.title || {NL} || n.body")
_HOLDS = " OR ".join(f"regexp_matches({x}, p)" for x in ("n.title", "n.body", fold("n.title"), fold("n.body")))
_TEXT = f"(len(q.excluded) + len(q.patterns) = 0 OR (len(list_filter(q.excluded, lambda x: contains({_HAY}, x))) = 0 AND len(list_filter(q.patterns, lambda p: NOT ({_HOLDS}))) = 0))"
# Field weights 3.4, 1.0 and 2.2, their length normalisation 0.35, 0.75 and 0.3.
_WEIGHTED = "(3.4 * tf_title / (1 - 0.35 + 0.35 * len_title / avg_title) + 1.0 * tf_body / (1 - 0.75 + 0.75 * len_body / avg_body) + 2.2 * tf_tag / (1 - 0.3 + 0.3 * len_tag / avg_tag))"


def ranked_from(tables: str, now: int, limit: int) -> str:
    """The ranked search of the queries in q, a table of ``tables``: query_id, place, note_id, score."""
    return f"""{tables},{EXPANSION},
hit AS (
  SELECT q.query_id, note_id, i, weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * ({_WEIGHTED} / (1.35 + {_WEIGHTED})) AS part
  FROM expn JOIN q USING (query_id) JOIN vocab ON vocab.term = surface JOIN post ON post.term = surface JOIN docs d USING (note_id), stats WHERE {PREDICATE}),
raw AS (SELECT query_id, note_id, sum(part) AS raw, count(DISTINCT i) AS matched FROM hit GROUP BY ALL),
final AS (
  SELECT query_id, note_id, d.updated_at, raw * (0.35 + 0.65 * pow(matched::DOUBLE / len(q.ranked), 1.6))
    * CASE WHEN folded_title = array_to_string(q.ranked, ' ') THEN 2.2 WHEN starts_with(folded_title, array_to_string(q.ranked, ' ')) THEN 1.7 ELSE 1.0 END
    * (1 + 0.28 / (1 + greatest(0.0, ({now} - d.updated_at) / 864e5) / 21)) * CASE WHEN d.pinned THEN 1.15 ELSE 1.0 END * CASE WHEN d.archived THEN 0.75 ELSE 1.0 END
    * CASE WHEN len(q.patterns) > 0 THEN 1.5 ELSE 1.0 END AS score
  FROM raw JOIN q USING (query_id) JOIN docs d USING (note_id) JOIN notes n USING (note_id) WHERE {_TEXT})
SELECT query_id, row_number() OVER w AS place, note_id, round(score, 6) AS score FROM final WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, updated_at DESC, note_id) QUALIFY place <= {limit}"""


def ranked(queries: dict[str, Asked], now: int, limit: int, scope: str | None = None, tables: str = ALL) -> str:
    return ranked_from(f"{tables},{asked_table(queries, scope)}", now, limit)


def listed(queries: dict[str, Asked], limit: int, scope: str | None = None) -> str:
    return f"""{ALL}, {asked_table(queries, scope)}, met AS (SELECT query_id, note_id, d.updated_at FROM q, docs d WHERE {PREDICATE})
SELECT query_id, row_number() OVER w AS place, note_id FROM met WINDOW w AS (PARTITION BY query_id ORDER BY updated_at DESC, note_id) QUALIFY place <= {limit}"""


#: Passages as queries, an operator behind each: what they mean, from the words of the text and the known operators.
_QUERY_WORDS = f"list_transform(list_filter(list_transform(regexp_extract_all(text, '{WORD}'), lambda w: regexp_replace(w, '[''’_]+$', '')), lambda w: w <> ''), lambda w: list_concat([w], CASE WHEN len({parts('w')}) > 1 THEN {parts('w')} ELSE [] END))"
PASSAGES = f"""
p AS (SELECT item_id::VARCHAR AS query_id, item_id % 4 AS k, list_transform(list_filter(flatten({_QUERY_WORDS}), lambda w: w <> ''), lambda w: {fold("w")}) AS words FROM benchmark),
r AS (SELECT query_id, k, CASE k WHEN 3 THEN list_concat(words, ['of', 'the']) ELSE words END AS words FROM p),
q AS (
  SELECT query_id, list_filter(words, lambda w, i: list_position(words, w) = i) AS ranked, CASE k WHEN 3 THEN ['(?i)of[^\\p{{L}}\\p{{N}}]+the'] ELSE []::VARCHAR[] END AS patterns,
    CASE k WHEN 2 THEN ['qzx'] ELSE []::VARCHAR[] END AS excluded, CASE k WHEN 1 THEN ['en'] ELSE []::VARCHAR[] END AS wanted, CASE k WHEN 2 THEN ['todo'] ELSE []::VARCHAR[] END AS states, 'active' AS scope,
    CASE k WHEN 3 THEN [{{'f': 'created', 'op': '>', 'ms': 1704844800000::BIGINT}}] ELSE []::STRUCT(f VARCHAR, op VARCHAR, ms BIGINT)[] END AS dates
  FROM r)"""
