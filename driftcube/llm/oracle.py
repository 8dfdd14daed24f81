"""DuckDB SQL for those of this subpackage's queries that SQL can express.

None for the others: fingerprints by rolling or seeded XXH64 hashes (2, 5),
iterations over staged tables (3, 5, 9, 12) and tokenizers (4, 10) are held against
brute force and the libraries in the tests.
"""

from __future__ import annotations

from driftcube.llm import filter_audit, mixing, secrets


def _sql_pattern(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _spans(no: int, pattern: str, group: int) -> str:
    """(row_no, kind_no, start_at, end_at, value) of a pattern's matches, by running sums of what stands between and of the matches."""
    p = _sql_pattern(pattern)
    return f"""
        SELECT row_no, {no} AS kind_no, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS start_at,
               length(hits[i]) AS chars, vals[i] AS value
        FROM (SELECT row_no, gaps, hits, vals, unnest(generate_series(1, len(hits))) AS i
              FROM (SELECT row_no, string_split_regex(text, {p}) AS gaps, regexp_extract_all(text, {p}) AS hits, regexp_extract_all(text, {p}, {group}) AS vals
                    FROM d WHERE regexp_matches(text, {p})))"""


def _op1() -> str:
    kinds = [*secrets.KINDS.values(), (secrets.OWNED_PATTERN, 0, 24)]
    names = [*secrets.KINDS, secrets.OWNED]
    least = " OR ".join(f"(kind_no = {i} AND length(value) >= {k[2]})" for i, k in enumerate(kinds[:-1]))
    n = len(kinds) - 1
    owned = f"kind_no = {n} AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[0-9]')"
    case = " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(names))
    found = " UNION ALL ".join(_spans(i, p, g) for i, (p, g, _) in enumerate(kinds))
    listed = "string_agg(kind || ':' || start_at || ':' || end_at, ',' ORDER BY start_at, kind_no, end_at)"
    counts = ", ".join(f"count(*) FILTER (kind_no = {i}) AS n_{x}" for i, x in enumerate(names[:-1]))
    return f"""
WITH d AS MATERIALIZED (
    SELECT row_number() OVER () AS row_no, doc_id, to_json([source])::VARCHAR AS owner, to_json([source, lang])::VARCHAR AS repository, coalesce(text, '') AS text FROM documents),
hits AS MATERIALIZED (
    SELECT row_no, doc_id, owner, repository, text, kind_no, CASE kind_no {case} END AS kind, start_at, start_at + chars AS end_at, value
    FROM ({found}) JOIN d USING (row_no) WHERE {least} OR ({owned})),
-- copies of one text count once
holders AS (SELECT value, text, min({{'o': owner, 'r': repository}}) AS h FROM hits GROUP BY value, text),
owners AS (SELECT value, count(DISTINCT h.o) AS owners, count(DISTINCT h.r) AS repositories FROM holders GROUP BY value),
kept AS (SELECT hits.*, owners < {secrets.WIDE_OWNERS} OR repositories < {secrets.WIDE_REPOSITORIES} AS live FROM hits JOIN owners USING (value)),
per AS (
    SELECT row_no, {counts}, {listed} AS spans, coalesce({listed} FILTER (kind_no < {n}), '') AS base, count(*) FILTER (live) AS n_live
    FROM kept GROUP BY row_no)
SELECT doc_id, {", ".join(f"coalesce(n_{x}, 0) AS n_{x}" for x in names[:-1])}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live
FROM d LEFT JOIN per USING (row_no)"""


def _op6() -> str:
    w = mixing.WEIGHTS
    return f"""
WITH RECURSIVE d AS MATERIALIZED (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS draw FROM documents),
s AS MATERIALIZED (
    SELECT source, sum(size)::BIGINT AS source_size, [{", ".join(map(str, w))}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(w)}] AS weight, sum(size)::BIGINT * {mixing.MAX_EPOCHS} AS stop
    FROM d GROUP BY source),
n AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS id FROM s),
-- rounds of resharing: the sources at their stop, until a round adds none
rounds AS (
    SELECT 0 AS r, []::BIGINT[] AS full_ids, (SELECT sum(source_size) * {mixing.SHARE}::DOUBLE FROM s) / (SELECT sum(weight) FROM s) AS level
    UNION ALL
    SELECT r + 1, now, CASE WHEN (SELECT count(*) FROM n WHERE NOT list_contains(now, id)) = 0 THEN level
           ELSE ((SELECT sum(source_size) * {mixing.SHARE}::DOUBLE FROM s) - (SELECT coalesce(sum(stop), 0) FROM n WHERE list_contains(now, id))) / (SELECT sum(weight) FROM n WHERE NOT list_contains(now, id)) END
    FROM (SELECT r, full_ids, level, (SELECT coalesce(list(id ORDER BY id), []) FROM n WHERE stop <= level * weight) AS now FROM rounds) WHERE len(now) > len(full_ids)),
goals AS (SELECT source, source_size, least(stop::DOUBLE, level * weight) AS target FROM s, (SELECT level FROM rounds ORDER BY r DESC LIMIT 1)),
placed AS (
    SELECT d.*, g.source_size, g.target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
           CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size)::BIGINT ELSE 0 END AS epochs
    FROM d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, floor(target - epochs * source_size)::BIGINT - before)))::BIGINT AS taken FROM placed"""


_OP7 = r"""
WITH t AS (
    SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS lone, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, NULL, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, NULL, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (
    SELECT *, row_number() OVER w AS no, count(*) OVER (PARTITION BY conv_id, lone) AS n_turns,
           sum(length('<|im_start|>') + length(replace(replace(replace(role, '&', '&amp;'), '<|', '&lt;|'), chr(10), '&nl;')) + 1 + length(replace(replace(text, '&', '&amp;'), '<|', '&lt;|')) + length('<|im_end|>') + 1)
               OVER (w ROWS UNBOUNDED PRECEDING) AS upto
    FROM t WINDOW w AS (PARTITION BY conv_id, lone ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY no)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY no) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(upto) FILTER (role = 'assistant' OR no = n_turns)::BIGINT AS formatted_chars,
       count(*) FILTER (role = 'assistant') AS n_examples
FROM e GROUP BY conv_id, lone"""

_OP8 = """
WITH v AS MATERIALIZED (
    SELECT row_number() OVER () AS row_no, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY q_no ORDER BY score DESC, vec_id) AS rank
    FROM (SELECT q.row_no AS q_no, q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.row_no <> c.row_no AND len(q.e) = len(c.e)))
WHERE rank <= 5"""


_OP11 = r"""
WITH d AS MATERIALIZED (
    SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
i AS (SELECT row_number() OVER () AS no, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM benchmark),
s AS (SELECT count(*)::BIGINT AS N, sum(len(terms))::BIGINT AS L FROM d WHERE len(terms) > 0),
lengths AS (SELECT row_no, doc_id, 100 - 75 + ((75 * len(terms)::BIGINT * N) // L) AS m FROM d, s WHERE len(terms) > 0),
tf AS MATERIALIZED (SELECT row_no, term, count(*)::BIGINT AS tf FROM (SELECT row_no, unnest(terms) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * N + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, s GROUP BY term, N),
asked AS (SELECT no, item_id, term, count(*)::BIGINT AS times FROM (SELECT no, item_id, unnest(terms) AS term FROM i) GROUP BY ALL),
scored AS (
    SELECT no, item_id, row_no, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
    FROM asked JOIN w USING (term) JOIN tf USING (term) JOIN lengths USING (row_no) GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY no ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0) WHERE rank <= 10"""


def _op13() -> str:
    a = filter_audit
    letters = "".join(a.FILTERS)
    return rf"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
v AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
           CASE WHEN len(words) < {a.LEAST_WORDS} THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < {a.LEAST_DISTINCT} * len(words) THEN 'B' ELSE '' END
           || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {a.MOST_CAPITALS} * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[{a.BANNED}]') THEN 'D' ELSE '' END
           || CASE WHEN coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) THEN 'E' ELSE '' END AS fails
    FROM d LEFT JOIN l USING (doc_id)),
n AS MATERIALIZED (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM v GROUP BY ALL),
letter AS (SELECT unnest(string_split('{letters}', '')) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letter a, letter b, letter c, letter d, letter e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, s AS step, filter_order[s] AS f, filter_order[1:s - 1] AS before FROM orders, (SELECT unnest(generate_series(1, 5)) AS s)),
c AS (SELECT part, filter_order, step, f, n, good, toxic, fails, contains(fails, f) AS bad, translate(fails, before, '') = fails AS alive FROM n, steps),
o AS (
    SELECT part, filter_order, step::INT AS step, f, coalesce(sum(n) FILTER (alive AND NOT bad), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (alive AND bad), 0)::BIGINT AS removed,
           coalesce(sum(n) FILTER (bad AND NOT alive), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = f), 0)::BIGINT AS unique_fails,
           coalesce(sum(good) FILTER (alive AND bad), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (alive AND bad), 0)::BIGINT AS toxic_lost
    FROM c GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM o"""


def oracle_sql() -> dict[str, str]:
    return {"op11_sparse_product_search": _OP11, "op13_filter_audit": _op13(), "op1_secret_ownership": _op1(), "op6_capped_mixing": _op6(), "op7_prefix_targets": _OP7, "op8_histogram_topk": _OP8}
