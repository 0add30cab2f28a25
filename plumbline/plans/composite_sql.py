"""DuckDB SQL of the composite queries."""

from __future__ import annotations

from plumbline.plans.reference_sql import AGREED, REL, RV, SHIFT, SPACE, TOK, clamp, r
from plumbline.plans.reference_sql import ORACLES as BASE

ORACLES: dict[str, str] = {}


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{SPACE}+', ''), '{SPACE}+$', '')"



_SIGNALS = [
    ("0.3", "coalesce(p.phrase_reuse, 0.0)"), ("0.2", "least(1.0::DOUBLE, greatest(0.0::DOUBLE, (coalesce(b.peers, 0) - 3) / 3.0::DOUBLE))"), ("0.15", "coalesce(st.structure, 0.0)"),
    ("0.1", "least(1.0::DOUBLE, greatest(0.0::DOUBLE, (50 - sp.specificity) / 50))"), ("0.1", "coalesce(u.low_unique_detail, 0.0)"), ("0.1", "coalesce(sy.uniformity, 0.0)"),
    ("0.05", "coalesce(least(t.peers, 5) / 5, 0.0)"),
]
TEMPLATED = f"""(WITH {RV}
  SELECT rv.review_id, rv.place_id, {r('100 * (' + ' + '.join(f'{w}::DOUBLE * {v}' for w, v in _SIGNALS) + ')', 1)} AS templated, {' + '.join(f'({v} >= 0.5)::INT' for _, v in _SIGNALS)} AS active
  FROM rv JOIN ({BASE['specificity']}) sp ON sp.review_id = rv.review_id LEFT JOIN ({BASE['phrase_reuse']}) p ON p.review_id = rv.review_id
  LEFT JOIN ({BASE['bigram_peers']}) b ON b.review_id = rv.review_id LEFT JOIN ({BASE['structure_similarity']}) st ON st.review_id = rv.review_id
  LEFT JOIN ({BASE['unique_detail']}) u ON u.review_id = rv.review_id LEFT JOIN ({BASE['style_uniformity']}) sy ON sy.place_id = rv.place_id
  LEFT JOIN ({BASE['temporal_peer_signal']}) t ON t.place_id = rv.place_id AND t.day = rv.day)"""
ORACLES["templated_scores"] = f"SELECT *, CASE WHEN templated >= 65 AND active >= 3 THEN 'HIGH' WHEN templated >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM {TEMPLATED}"

EDGES = f"""e AS (SELECT {_strip('review_id_a')} AS u, {_strip('review_id_b')} AS v, kind, score FROM duplicate_edges WHERE kind IS NOT NULL),
ee AS (SELECT * FROM e WHERE u != '' AND v != '' AND u != v)"""
COMP = f"""{EDGES}, g AS (SELECT u, v FROM ee UNION SELECT v, u FROM ee),
reach AS (SELECT DISTINCT u AS n, u AS r FROM g UNION SELECT g.v, reach.r FROM reach JOIN g ON g.u = reach.n),
comp AS (SELECT n AS node, min(r) AS component FROM reach GROUP BY n),
best AS (SELECT least(u, v) AS u, greatest(u, v) AS v, kind, CASE WHEN kind = 'exact' THEN 1.0 ELSE score END AS score FROM ee QUALIFY row_number() OVER (PARTITION BY least(u, v), greatest(u, v)
    ORDER BY (kind = 'exact') DESC, coalesce(CASE WHEN kind = 'exact' THEN 1.0 ELSE score END, -1.0) DESC, CASE kind WHEN 'fuzzy' THEN 1 WHEN 'near' THEN 2 ELSE 3 END) = 1)"""
# of families of three or more: size, and how alike their members are
DUP = f"""{COMP}, big AS (SELECT component, count(*) AS family_size FROM comp GROUP BY 1 HAVING count(*) >= 3),
sim AS (SELECT component, {r('coalesce(sum(floor(score * 1e6 + 0.5)::BIGINT) / count(score) / 1e6, 0.0)', 4)} AS s FROM best JOIN comp ON node = u GROUP BY 1),
dup AS (SELECT node AS review_id, {r('least(1.0, family_size / 5.0) * least(1.0, greatest(0.5, s))', 3)}::DOUBLE AS duplicate FROM comp JOIN big USING (component) JOIN sim USING (component))"""
ORACLES["coordinated_places"] = f"""WITH RECURSIVE {SHIFT}, {DUP}, tpl AS (SELECT * FROM {TEMPLATED}),
  n AS (SELECT place_id, count(*) AS reviews FROM rv WHERE place_id IS NOT NULL GROUP BY 1),
  c AS (SELECT n.place_id, n.reviews, {r(clamp('''100 * (0.3::DOUBLE * coalesce((SELECT least(1.0, greatest(0.0, max(z_score) / 10)) FROM bursts b WHERE b.place_id = n.place_id), 0.0)
    + 0.25::DOUBLE * coalesce((SELECT least(1.0, greatest(0.0, max(jsd) / 0.3::DOUBLE)) FROM shifts s WHERE s.place_id = n.place_id), 0.0)
    + 0.08::DOUBLE * (SELECT count(*) FROM dup d JOIN rv ON rv.review_id = d.review_id WHERE rv.place_id = n.place_id)::DOUBLE / n.reviews + 0.1::DOUBLE * coalesce(g.temporal_density, 0.0)
    + 0.07::DOUBLE * (SELECT count(*) FROM tpl t WHERE t.place_id = n.place_id AND templated >= 65)::DOUBLE / n.reviews + 0.05::DOUBLE * o.top_share)''', 0, 100), 1)} AS coordinated
    FROM n LEFT JOIN ({BASE['temporal_gap_signal']}) g ON g.place_id = n.place_id LEFT JOIN ({BASE['top_reviewer_share']}) o ON o.place_id = n.place_id)
  SELECT *, CASE WHEN coordinated >= 65 THEN 'HIGH' WHEN coordinated >= 35 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM c"""
EVIDENCE = f"""evd AS (SELECT place_id, day FROM bursts UNION SELECT place_id, (day + o)::DATE FROM shifts CROSS JOIN (VALUES (-1), (0), (1)) o(o)),
str AS ({AGREED}),
busy AS (SELECT d.place_id, sum(n) AS event_reviews FROM daily d JOIN evd USING (place_id, day) GROUP BY 1),
tot_p AS (SELECT place_id, count(*) AS place_reviews FROM rv GROUP BY 1), {DUP}, tpl AS (SELECT * FROM {TEMPLATED}),
ev0 AS (SELECT rv.review_id, coalesce(d.duplicate, 0.0) AS duplicate, {r('coalesce(t.templated, 0.0) / 100', 3)} AS templated_p,
  {r('coalesce(s.burst, 0.0) * (0.5 + 0.5 * coalesce(s.shift, 0.0))', 3)} AS event, (e.day IS NOT NULL)::INT::DOUBLE AS one, coalesce(b.event_reviews, 0)::DOUBLE AS er, p.place_reviews
  FROM rv LEFT JOIN dup d ON d.review_id = rv.review_id LEFT JOIN tpl t ON t.review_id = rv.review_id LEFT JOIN str s ON s.place_id = rv.place_id AND s.day = rv.day
  LEFT JOIN evd e ON e.place_id = rv.place_id AND e.day = rv.day LEFT JOIN busy b ON b.place_id = rv.place_id LEFT JOIN tot_p p ON p.place_id = rv.place_id),
evidence AS (SELECT review_id, duplicate, templated_p, {r('least(1.0::DOUBLE, 0.35::DOUBLE * event + 0.3::DOUBLE * greatest(duplicate, templated_p) + 0.15::DOUBLE * CASE WHEN er > 0 THEN '
  + r('0.5 * one + 0.5 * least(1.0::DOUBLE, greatest(0.0::DOUBLE, er - one) / place_reviews)', 3) + ' ELSE 0.0 END)', 3)} AS coordinated FROM ev0)"""
ORACLES["review_evidence"] = f"WITH RECURSIVE {SHIFT}, {EVIDENCE} SELECT * FROM evidence"
WEIGHTS = f"""{EVIDENCE}, {REL},
wq AS (SELECT v.*, s.specificity AS sp, e.category_experience AS ce, l.relevance AS re, x.duplicate AS du, x.templated_p AS tp, x.coordinated AS co FROM rv v
  JOIN ({BASE['specificity']}) s ON s.review_id = v.review_id JOIN evidence x ON x.review_id = v.review_id
  LEFT JOIN exper e ON e.reviewer_id = v.reviewer_id AND e.place_category = v.place_category
  LEFT JOIN rel l ON l.reviewer_id = v.reviewer_id AND l.place_category IS NOT DISTINCT FROM v.place_category AND l.city IS NOT DISTINCT FROM v.city AND l.region IS NOT DISTINCT FROM v.region),
weights AS (SELECT review_id, place_id, rating, {r(clamp('''1 + 2 * greatest(0.0::DOUBLE, 0.35::DOUBLE * sp / 100 + 0.2::DOUBLE * coalesce(ce, 0.0) / 100 + 0.25::DOUBLE * coalesce(re, 0.0) / 100
  + 0.2::DOUBLE * (CASE WHEN day IS NOT NULL THEN pow(0.5::DOUBLE, greatest(0, DATE '2025-01-01' - day) / 365.0::DOUBLE) ELSE 0.0 END) - 0.5)
  - (0.3::DOUBLE * du + 0.25::DOUBLE * tp + 0.2::DOUBLE * greatest(0.0::DOUBLE, ''' + r('co - ' + r('0.3::DOUBLE * greatest(du, tp)', 3), 3) + '))', 0.25, 2.0), 4)} AS weight FROM wq)"""
ORACLES["review_weights"] = f"WITH RECURSIVE {SHIFT}, {WEIGHTS} SELECT * FROM weights"
ORACLES["weighted_rating"] = f"""WITH RECURSIVE {SHIFT}, {WEIGHTS} SELECT place_id, count(*) AS rated, {r('avg(rating)', 2)} AS raw, {r('sum(rating * weight) / sum(weight)', 2)} AS weighted,
  {r('sum(rating * weight) / sum(weight) - avg(rating)', 3)} AS delta, {r('avg((weight < 0.6)::INT)', 4)} AS low_share, {r('avg((weight > 1.2)::INT)', 4)} AS high_share,
  CASE WHEN count(*) >= 20 THEN 'HIGH' WHEN count(*) >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM weights WHERE rating IS NOT NULL AND place_id IS NOT NULL GROUP BY 1"""

ORACLES["family_components"] = f"WITH RECURSIVE {COMP} SELECT * FROM comp"
ORACLES["family_structure"] = f"""WITH RECURSIVE {COMP},
  l AS (SELECT component, count(*) AS links, {", ".join(f"count(*) FILTER (kind = '{k}') AS {k}_links" for k in ("exact", "near", "fuzzy", "semantic"))} FROM best JOIN comp ON node = u GROUP BY 1),
  m AS (SELECT component, count(*) AS members FROM comp GROUP BY 1)
  SELECT component, members, links, floor(links / (members * (members - 1) / 2) * 10000 + 0.5)::BIGINT AS density_e4, exact_links, near_links, fuzzy_links, semantic_links,
    members >= 3 AND links < members * (members - 1) / 2 AS transitive, members >= 3 AND links * 2 < members * (members - 1) / 2 AS sparse,
    CASE WHEN semantic_links = 0 THEN 'Repeated-text family' WHEN exact_links + near_links + fuzzy_links = 0 THEN 'Semantic similarity family' ELSE 'Mixed similarity family' END AS label
  FROM m JOIN l USING (component)"""

_ENUM = {
    "templated_label": "organic templated uncertain", "specificity_label": "low medium high uncertain", "duplicate_label": "unique duplicate uncertain",
    "sample_type": "evaluation challenge", "sampling_stratum": "random high medium low duplicate",
}


def _enum(c: str) -> str:
    return f"lower(trim({c})) IN ({', '.join(repr(x) for x in _ENUM[c].split())})"


LABELS = f"""lab AS (SELECT trim(review_id) AS review_id, nullif(trim(template_group_id), '') AS template_group_id, nullif(trim(duplicate_group_id), '') AS duplicate_group_id,
  nullif(trim(annotator_id), '') AS annotator_id, {", ".join(f"CASE WHEN {_enum(c)} THEN lower(trim({c})) END AS {c}" for c in _ENUM)},
  {" + ".join(f"(coalesce(trim({c}), '') != '' AND NOT {_enum(c)})::INT" for c in _ENUM)} AS unknown FROM human_labels WHERE trim(review_id) != ''),
labels AS (SELECT * EXCLUDE unknown, unknown + (coalesce(duplicate_label = 'duplicate', false) AND duplicate_group_id IS NULL)::INT
  + (duplicate_group_id IS NOT NULL AND NOT coalesce(duplicate_label = 'duplicate', false))::INT + (template_group_id IS NOT NULL AND coalesce(templated_label = 'organic', false))::INT AS warnings FROM lab)"""
ORACLES["cleaned_labels"] = f"WITH {LABELS} SELECT * FROM labels"
PAIRS = f"{RV}, {LABELS}, pairs AS (SELECT * FROM labels JOIN ({BASE['specificity']}) s USING (review_id))"
_RATES = f"""{r('tp / nullif(tp + fp, 0)', 4)} AS precision, {r('tp / nullif(tp + fn, 0)', 4)} AS recall, {r('2 * tp / nullif(2 * tp + fp + fn, 0)', 4)} AS f1"""
ORACLES["confusion_sweep"] = f"""WITH {LABELS}, x AS (SELECT t.t AS threshold, templated_label = 'templated' AS y, templated >= t.t AS p FROM labels JOIN {TEMPLATED} tp USING (review_id) CROSS JOIN range(0, 101, 5) t(t)
  WHERE templated_label IN ('templated', 'organic')),
  c AS (SELECT threshold::INT AS threshold, count(*) FILTER (y AND p) AS tp, count(*) FILTER (NOT y AND p) AS fp, count(*) FILTER (y AND NOT p) AS fn, count(*) FILTER (NOT y AND NOT p) AS tn FROM x GROUP BY 1)
  SELECT *, {_RATES}, {r('fp / nullif(fp + tn, 0)', 4)} AS fpr, {r('fn / nullif(fn + tp, 0)', 4)} AS fnr FROM c"""
ORACLES["specificity_spearman"] = f"""WITH {PAIRS}, p AS (SELECT CASE specificity_label WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 END AS h, specificity AS s FROM pairs),
  q AS (SELECT rank() OVER (ORDER BY h) + (count(*) OVER (PARTITION BY h) - 1) / 2 AS a, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS b FROM p WHERE h IS NOT NULL)
  SELECT count(*) AS n, {r('covar_pop(a, b) / sqrt(var_pop(a) * var_pop(b))', 4)} AS spearman FROM q"""
ORACLES["specificity_crosstab"] = f"""WITH {PAIRS} SELECT specificity_label, {", ".join(f"count(*) FILTER (band = '{b}') AS {b}" for b in ("LOW", "MEDIUM", "HIGH"))}
  FROM pairs WHERE specificity_label != 'uncertain' GROUP BY 1"""
ORACLES["label_coverage"] = f"WITH {LABELS} " + " UNION ALL ".join(f"SELECT '{c}' AS dimension, coalesce({c}, 'missing') AS value, count(*) AS n FROM labels GROUP BY ALL" for c in _ENUM)
ORACLES["duplicate_pair_metrics"] = f"""WITH RECURSIVE {COMP}, {LABELS},
  h AS (SELECT review_id, min(CASE WHEN duplicate_label = 'duplicate' THEN duplicate_group_id END) AS h FROM labels GROUP BY 1),
  j AS (SELECT h.review_id, h, component AS p FROM h LEFT JOIN comp ON node = h.review_id),
  k AS (SELECT count(*) FILTER (a.h = b.h AND a.p = b.p) AS tp, count(*) FILTER (a.h = b.h) AS t, count(*) FILTER (a.p = b.p) AS f FROM j a JOIN j b ON a.review_id < b.review_id),
  m AS (SELECT tp, f - tp AS fp, t - tp AS fn FROM k) SELECT tp, fp, fn, {_RATES} FROM m"""
ORACLES["score_distribution"] = f"""WITH {PAIRS}, o AS (SELECT specificity_label, list_sort(list(specificity)) AS v FROM pairs WHERE specificity_label IS NOT NULL GROUP BY 1)
  SELECT specificity_label, len(v)::BIGINT AS n, v[1] AS min, {", ".join(f"v[least(len(v) - 1, floor(len(v) * {p})::INT) + 1] AS {n}" for p, n in ((0.25, 'p25'), (0.5, 'median'), (0.75, 'p75'), (0.95, 'p95')))},
  {r('list_avg(v)', 2)} AS mean, v[len(v)] AS max FROM o"""
ORACLES["specificity_disagreements"] = f"""WITH {PAIRS} SELECT p.review_id, annotator_id, specificity_label, band, specificity,
  CASE WHEN length(coalesce(v.text, '')) > 300 THEN rtrim(v.text[1:300]) || ' …' ELSE coalesce(v.text, '') END AS text
  FROM pairs p JOIN rv v ON v.review_id = p.review_id WHERE (specificity_label = 'low' AND band = 'HIGH') OR (specificity_label = 'high' AND band = 'LOW')"""
SAMPLE = "smp AS (SELECT review_id FROM rv ORDER BY sha256('7:' || review_id), review_id LIMIT 200)"
ORACLES["evaluation_sample"] = f"WITH {RV}, {SAMPLE} SELECT * FROM smp"
ORACLES["stratified_sample"] = f"""WITH {RV}, {SAMPLE}, s AS (SELECT review_id, band FROM ({BASE['specificity']}) WHERE review_id NOT IN (SELECT review_id FROM smp)),
  k AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY sha256('11:' || review_id), review_id) AS k FROM s)
  SELECT review_id, band FROM k WHERE k <= CASE band WHEN 'HIGH' THEN 30 WHEN 'MEDIUM' THEN 40 ELSE 20 END"""
SIZES = "sizes AS (SELECT place_id, count(*) AS n FROM rv WHERE place_id IS NOT NULL GROUP BY 1)"


def _alloc(target: int) -> str:
    return f"""{SIZES}, ex AS (SELECT place_id, n, n * {target} // (SELECT sum(n) FROM sizes)::BIGINT AS a, n * {target} % (SELECT sum(n) FROM sizes)::BIGINT AS m FROM sizes),
  al AS (SELECT place_id, n, a + (row_number() OVER (ORDER BY m DESC, n DESC, place_id) <= {target} - (SELECT sum(a) FROM ex))::INT AS allocated FROM ex)"""


ORACLES["largest_remainder"] = f"WITH {RV}, {_alloc(1000)} SELECT place_id, n, allocated::BIGINT AS allocated FROM al"
ORACLES["proportional_sample"] = f"""WITH {RV}, {_alloc(500)}, k AS (SELECT review_id, rv.place_id, allocated, row_number() OVER (PARTITION BY rv.place_id ORDER BY sha256('3:' || review_id), review_id) AS k
  FROM rv JOIN al ON al.place_id = rv.place_id) SELECT review_id, place_id FROM k WHERE k <= allocated"""
ORACLES["cumulative_pick"] = f"WITH {RV}, {SIZES}, c AS (SELECT *, sum(n) OVER (ORDER BY n DESC, place_id ROWS UNBOUNDED PRECEDING) AS c FROM sizes) SELECT place_id, n FROM c WHERE c - n < (SELECT ceil(sum(n) / 3) FROM sizes)"
ORACLES["place_band"] = f"WITH {RV}, {SIZES} SELECT place_id, n FROM sizes WHERE n BETWEEN 80 AND 150 ORDER BY n DESC, place_id LIMIT 250"


def _word(x: str) -> str:
    return f"('0x' || left(sha256({x}), 16))::UBIGINT"


ORACLES["dataset_fingerprint"] = f"""WITH {RV}, p AS (SELECT coalesce(place_id, 'None') AS place_id, count(*) AS n FROM rv GROUP BY 1)
  SELECT 'v1|' || (SELECT count(*) FROM rv) || '|' || (SELECT count(*) FROM p)
  || '|' || lpad(lower(to_hex((SELECT bit_xor({_word("review_id || chr(0) || lower(" + _strip("coalesce(text, '')") + ")")}) FROM rv))), 16, '0')
  || '|' || lpad(lower(to_hex((SELECT bit_xor({_word("place_id || ':' || n")}) FROM p))), 16, '0') || '|' AS fingerprint"""
ORACLES["pseudonyms"] = f"WITH {RV} SELECT DISTINCT reviewer_id, 'rv_' || left(sha256('salt' || chr(31) || reviewer_id), 12) AS pseudonym, left(sha1(reviewer_id), 8) AS short_id FROM rv WHERE reviewer_id IS NOT NULL"
ORACLES["cache_misses"] = f"""WITH {RV}, w AS (SELECT review_id, sha256(lower({_strip('text')})) AS text_hash FROM rv WHERE text IS NOT NULL)
  SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM embeddings_cache c WHERE c.review_id = w.review_id AND c.text_hash = w.text_hash AND model_name = 'minilm-multi-384')"""
ORACLES["cache_summary"] = """SELECT model_name, count(*) AS rows, count(DISTINCT review_id) AS reviews, count(*) FILTER (embedding IS NULL) AS null_vectors,
  count(*) FILTER (len(embedding) = 0) AS empty_vectors, max(len(embedding))::INT AS longest FROM embeddings_cache GROUP BY 1"""
ORACLES["mean_cosine"] = f"""WITH {RV}, v AS (SELECT review_id, min(embedding) AS e FROM embeddings_cache WHERE model_name = 'minilm-multi-384' AND len(embedding) = 384 GROUP BY 1),
  u AS (SELECT place_id, review_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v JOIN rv USING (review_id)),
  c AS (SELECT place_id, count(*) AS n FROM u WHERE norm > 0 GROUP BY 1),
  s AS (SELECT place_id, sum(x * x) AS sq FROM (SELECT place_id, i, sum(x) AS x FROM (SELECT place_id, unnest(list_transform(e, lambda x: x / norm)) AS x, unnest(range(384)) AS i FROM u WHERE norm > 0) GROUP BY ALL) GROUP BY 1)
  SELECT place_id, n, {r('CASE WHEN n < 2 THEN 1.0 ELSE (sq - n) / (n * (n - 1)) END', 6)} AS mean_cosine FROM c JOIN s USING (place_id)"""
ORACLES["escaped_texts"] = rf"""WITH {RV} SELECT review_id, replace(regexp_replace(text, '([\\`*_{{}}\[\]()#+\-.!|<>~])', '\\\1', 'g'), chr(10), '  ' || chr(10)) AS escaped FROM rv WHERE text IS NOT NULL"""
ORACLES["event_type_daily"] = "SELECT ts::DATE AS day, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE ts IS NOT NULL GROUP BY ALL"

_TOK2 = TOK.replace("tok AS", "tk AS").replace("NOT list_contains", "length(w) > 1 AND NOT list_contains")
ORACLES["place_phrases"] = f"""WITH {RV}, {_TOK2}, a AS (
    SELECT place_id, unnest(t) AS phrase, 1 AS k FROM tk WHERE place_id IS NOT NULL
    UNION ALL SELECT place_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])), 2 FROM tk WHERE place_id IS NOT NULL),
  c AS (SELECT place_id, k, phrase, count(*) AS n FROM a GROUP BY place_id, k, phrase QUALIFY row_number() OVER (PARTITION BY place_id, k ORDER BY count(*) DESC, phrase) <= CASE k WHEN 2 THEN 40 ELSE 30 END)
  SELECT place_id, phrase, n, (row_number() OVER w)::INT AS rank FROM c WINDOW w AS (PARTITION BY place_id ORDER BY n DESC, phrase) QUALIFY row_number() OVER w <= 5"""
ORACLES["complete_places"] = f"""WITH {RV}, v AS (SELECT DISTINCT review_id FROM embeddings_cache WHERE model_name = 'minilm-multi-384' AND len(embedding) = 384)
  SELECT place_id, review_id FROM rv WHERE place_id IS NOT NULL QUALIFY count(*) OVER (PARTITION BY place_id) = sum((review_id IN (SELECT review_id FROM v))::INT) OVER (PARTITION BY place_id)"""

# the k-core by rounds: each leaves out what the round before puts below a floor
ORACLES["kcore_reviews"] = f"""WITH RECURSIVE {RV}, core AS (
    SELECT 0 AS i, review_id, place_id, reviewer_id FROM rv WHERE place_id IS NOT NULL AND reviewer_id IS NOT NULL
    UNION ALL
    SELECT i + 1, review_id, place_id, reviewer_id FROM (
      SELECT *, count(*) OVER (PARTITION BY place_id) AS a, count(*) OVER (PARTITION BY reviewer_id) AS b, (SELECT count(*) FROM core) AS before,
        count(*) OVER (PARTITION BY reviewer_id, place_id) AS same FROM core WHERE i < 40) WHERE a >= 10 AND b >= 3 AND same < b)
  SELECT review_id, place_id, reviewer_id FROM core WHERE i = 40"""
