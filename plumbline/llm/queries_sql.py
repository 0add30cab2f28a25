"""DuckDB SQL of the training-text problems."""

from __future__ import annotations

_W = r"[\p{L}\p{N}_]"
_TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\p{Z}\t-\r\x1c-\x1f\x{85}]+"
_S = r"[\p{Z}\t-\r\x1c-\x1f\x{85}]"


def tokens(x: str) -> str:
    return f"coalesce(len(regexp_extract_all({x}, '{_TOKEN}')), 0)"


P2_FOUND = rf"""WITH RECURSIVE e AS (
  SELECT DISTINCT regexp_replace(review_id_a, '^{_S}+|{_S}+$', '', 'g') AS a, regexp_replace(review_id_b, '^{_S}+|{_S}+$', '', 'g') AS b FROM duplicate_edges
),
g AS (SELECT a, b FROM e WHERE a != '' AND b != '' AND a != b UNION SELECT b, a FROM e WHERE a != '' AND b != '' AND a != b),
reach AS (SELECT DISTINCT a AS v, a AS r FROM g UNION SELECT g.b, reach.r FROM reach JOIN g ON g.a = reach.v)
SELECT v AS review_id, min(r) AS group_id FROM reach GROUP BY v"""

P5_FOUND = """WITH v AS (
  SELECT review_id, any_value(embedding) AS e FROM embeddings_cache
  WHERE model_name = 'minilm-multi-384' AND len(embedding) = 384 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0 GROUP BY review_id
),
c AS (SELECT a.review_id AS x, b.review_id AS y, round(list_cosine_similarity(a.e, b.e), 9) AS s FROM v a JOIN v b ON a.review_id != b.review_id),
k AS (SELECT x, y FROM c WHERE s >= 0.8 QUALIFY row_number() OVER (PARTITION BY x ORDER BY s DESC, y) <= 5)
SELECT DISTINCT least(x, y) AS review_id_a, greatest(x, y) AS review_id_b FROM k"""

P7_FOUND = f"""WITH t AS (SELECT DISTINCT review_id, trim(regexp_replace(lower(text), '{_S}+', ' ', 'g')) AS x FROM reviews WHERE review_id IS NOT NULL AND length(text) >= 100),
n AS (SELECT row_number() OVER (ORDER BY review_id)::INT AS i, review_id, list_distinct(list_transform(range(1, length(x) - 2), lambda k: x[k:k + 3])) AS s FROM t WHERE length(x) >= 100),
e AS (SELECT i, hash(unnest(s)) AS g FROM n),
c AS (SELECT a.i AS x, b.i AS y, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.i < b.i GROUP BY ALL)
SELECT a.review_id AS review_id_a, b.review_id AS review_id_b FROM c JOIN n a ON a.i = c.x JOIN n b ON b.i = c.y WHERE k >= 0.7 * (len(a.s) + len(b.s) - k)"""

P8_FOUND = f"SELECT doc_id FROM documents WHERE {tokens('text')} > 2048"

P9_FOUND = f"""WITH t AS (
  SELECT m.source, m.target_share, m.max_repeats, coalesce(sum({tokens('text')}), 0) AS n
  FROM mix_targets m LEFT JOIN documents d ON lower(trim(d.source)) = m.source GROUP BY ALL
)
SELECT source FROM t WHERE n * max_repeats < target_share * (SELECT sum(n) FROM t)"""

P10_FOUND = rf"""WITH d AS (SELECT doc_id, text FROM documents WHERE {tokens('text')} > 512),
p AS (SELECT doc_id, list_max(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?…]){_S}', '\1' || chr(10), 'g'), chr(10)),
  lambda x: {tokens('x')})) AS most FROM d)
SELECT doc_id, (most > 512)::INT AS forced_cut FROM p"""

P2_GROUPS = f"""WITH g AS ({P2_FOUND})
SELECT group_id, 0::BIGINT AS part, count(*) AS group_size, array_to_string(list_sort(list(review_id)), ' ') AS review_ids FROM g GROUP BY group_id"""

P5_NEIGHBOURS = P5_FOUND[: P5_FOUND.index("SELECT DISTINCT least")].replace("SELECT x, y FROM c", "SELECT x, y, s, row_number() OVER (PARTITION BY x ORDER BY s DESC, y) AS r FROM c") + (
    "SELECT x AS review_id, y AS neighbour, floor(s * 1e6 + 0.5) / 1e6 AS cosine, r::INT AS rank FROM k"
)

P7_GROUPS = f"""WITH RECURSIVE pr AS ({P7_FOUND}),
g AS (SELECT review_id_a AS a, review_id_b AS b FROM pr UNION SELECT review_id_b, review_id_a FROM pr),
own AS (SELECT DISTINCT review_id FROM reviews WHERE review_id IS NOT NULL AND length(trim(regexp_replace(lower(text), '{_S}+', ' ', 'g'))) >= 100),
reach AS (SELECT review_id AS v, review_id AS r FROM own UNION SELECT g.b, reach.r FROM reach JOIN g ON g.a = reach.v)
SELECT v AS review_id, min(r) AS group_id FROM reach GROUP BY v"""

P8_CHECK = f"""WITH t AS (SELECT {tokens('text')} AS n FROM documents)
SELECT count(*) AS items, sum(ceil(n / 2048))::BIGINT AS pieces, sum(n)::BIGINT AS tokens, 0::BIGINT AS overfull, 0::BIGINT AS missing_numbers, 0::BIGINT AS needless_cuts, true AS tight
FROM t WHERE n > 0"""

_MIX = f"""t AS (
  SELECT m.source, m.target_share AS w, m.max_repeats AS k, coalesce(sum({tokens('text')}), 0) AS n, count(d.doc_id) AS documents
  FROM mix_targets m LEFT JOIN documents d ON lower(trim(d.source)) = m.source GROUP BY ALL
),
p AS (SELECT *, sum(n) OVER () AS whole, sum(w) OVER () / sum(CASE WHEN n > 0 THEN w END) OVER () AS spread FROM t),
q AS (SELECT *, least(whole, min(CASE WHEN n > 0 THEN n * k / (w * spread) END) OVER ()) AS total FROM p)"""
P9_PLAN = f"""WITH {_MIX} SELECT source, n::BIGINT AS tokens, floor(w * total * spread * 100 + 0.5) / 100 AS target_tokens,
  floor(CASE WHEN n > 0 THEN least(k, w * total * spread / n) ELSE 0 END * 1e6 + 0.5) / 1e6 AS expected_copies, n * k < w * whole AS capped FROM q"""
P9_CHECK = f"WITH {_MIX} SELECT source, documents, 0::BIGINT AS beyond_cap, true AS held FROM q WHERE documents > 0"

P10_PIECES = rf"""WITH u AS (SELECT doc_id, regexp_extract_all(text, '(?:^{_S}*)?(?:{_TOKEN}){_S}*') AS u FROM documents WHERE {tokens('text')} > 512),
c AS (SELECT doc_id, u, array_to_string(list_transform(u, lambda x: CASE WHEN regexp_matches(x, '[^\p{{Z}}\t-\r\x1c-\x1f\x{{85}}]{_S}*\n{_S}*\n{_S}*$') THEN 'p'
  WHEN regexp_matches(x, '[^\p{{Z}}\t-\r\x1c-\x1f\x{{85}}]{_S}*\n{_S}*$') THEN 'l' WHEN regexp_matches(x, '[.!?…]{_S}+$') THEN 's' ELSE 'o' END), '') AS c FROM u),
p AS (SELECT doc_id, u, regexp_extract_all(c, '[plso]{{1,448}}$|[plso]{{223,447}}p|[plso]{{223,447}}l|[plso]{{223,447}}s|[plso]{{0,447}}[pls]|[plso]{{448}}') AS p FROM c),
e AS (SELECT doc_id, u, len(p) AS n, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS x FROM p),
f AS (SELECT *, (sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i) - length(x))::BIGINT AS start FROM e)
SELECT doc_id, i::INT AS piece_no, array_to_string(u[greatest(1, start - 63):start + length(x)], '') AS piece, (length(x) + least(start, 64))::INT AS piece_tokens,
  (i < n AND x[-1] = 'o')::INT AS forced FROM f"""

ORACLES = {
    "p2_found": P2_FOUND, "p2_groups": P2_GROUPS, "p5_found": P5_FOUND, "p5_neighbours": P5_NEIGHBOURS, "p7_found": P7_FOUND, "p7_groups": P7_GROUPS, "p8_found": P8_FOUND,
    "p8_check": P8_CHECK, "p9_found": P9_FOUND, "p9_plan": P9_PLAN, "p9_check": P9_CHECK, "p10_found": P10_FOUND, "p10_pieces": P10_PIECES,
}
