"""DuckDB SQL of the summary, report, family and corpus queries."""

from __future__ import annotations

from plumbline.plans.composite_sql import COMP, DUP, LABELS, TEMPLATED
from plumbline.plans.composite_sql import ORACLES as SCORES
from plumbline.plans.reference_sql import BURST, META, RV, r
from plumbline.plans.reference_sql import ORACLES as BASE

ORACLES: dict[str, str] = {}

FAM = f"""{COMP}, sized AS (SELECT component, count(*) AS size FROM comp GROUP BY 1),
sim AS (SELECT component, {r('coalesce(sum(floor(score * 1e6 + 0.5)::BIGINT) / count(score) / 1e6, 0.0)', 4)} AS s FROM best JOIN comp ON node = u GROUP BY 1)"""
_MED = lambda x: r(f"quantile_cont({x}, 0.5)", 4)
SUMMARY = f"""{RV}, {META}, {FAM}, wr AS ({SCORES['weighted_rating']}), co AS ({SCORES['coordinated_places']}), tp AS (SELECT * FROM {TEMPLATED}), sc AS ({BASE['specificity']}),
b AS (SELECT rv.place_id, count(*) AS review_count, count(DISTINCT reviewer_id) AS reviewer_count, count(published_at) AS dated_review_count,
  {r('100 * count(*) FILTER (rating = 1) / nullif(count(rating), 0)', 4)} AS one_star_share, {r('100 * count(*) FILTER (rating = 5) / nullif(count(rating), 0)', 4)} AS five_star_share,
  {_MED('specificity')} AS median_specificity, {r('avg(specificity)', 4)} AS mean_specificity FROM rv JOIN sc ON sc.review_id = rv.review_id WHERE rv.place_id IS NOT NULL GROUP BY 1),
k AS (SELECT place_id, component, count(*) AS k FROM rv JOIN comp ON node = review_id WHERE place_id IS NOT NULL GROUP BY ALL),
kk AS (SELECT place_id, count(*) FILTER (k >= 2) AS family_count, max(CASE WHEN k >= 2 THEN k END) AS largest_family, sum(CASE WHEN k >= 3 THEN k ELSE 0 END) AS repeated FROM k GROUP BY 1),
t AS (SELECT place_id, count(*) FILTER (templated >= 65) AS templated_high, max(templated) AS templated_max, {_MED('templated')} AS templated_median FROM tp GROUP BY 1),
summary AS (SELECT b.place_id, coalesce(meta.place_name, b.place_id) AS place_name, meta.place_category, b.review_count, reviewer_count, dated_review_count, raw AS raw_rating, weighted AS weighted_rating,
  {r('raw - weighted', 4)} AS rating_delta, abs({r('raw - weighted', 4)}) AS abs_rating_delta, one_star_share, five_star_share, coalesce(family_count, 0)::BIGINT AS family_count,
  coalesce(largest_family, 0)::BIGINT AS largest_family, {r('100 * coalesce(repeated, 0) / b.review_count', 4)} AS duplicate_rate, median_specificity, mean_specificity, 0::BIGINT AS topic_clusters,
  coalesce(templated_high, 0)::BIGINT AS templated_high, templated_max, templated_median, coordinated AS coordinated_score, co.band AS coordinated_band
  FROM b LEFT JOIN meta ON meta.place_id = b.place_id LEFT JOIN wr ON wr.place_id = b.place_id LEFT JOIN kk ON kk.place_id = b.place_id LEFT JOIN t ON t.place_id = b.place_id LEFT JOIN co ON co.place_id = b.place_id)"""
ORACLES["place_summary"] = f"WITH RECURSIVE {SUMMARY} SELECT * FROM summary"
_Q = lambda c, p: r(f"quantile_cont({c}, {p})", 4)
ORACLES["category_rollup"] = f"""WITH RECURSIVE {SUMMARY} SELECT coalesce(place_category, '(no category)') AS place_category, count(*) AS places, sum(review_count)::BIGINT AS reviews,
  {_Q('review_count', 0.5)} AS median_reviews, {", ".join(f"{_Q(c, p)} AS {n}_{c}" for c in ("raw_rating", "duplicate_rate", "median_specificity") for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)))},
  sum(topic_clusters)::BIGINT AS topic_clusters_total, count(*) FILTER (topic_clusters > 0) AS places_with_clusters, {_Q('topic_clusters', 0.5)} AS median_clusters, {_Q('templated_max', 0.5)} AS median_templated_max
  FROM summary GROUP BY 1"""
_SECTIONS = [
    ("duplicate_rate", "duplicate_rate", "DESC"), ("largest_group", "largest_family", "DESC"), ("rating_delta", "abs_rating_delta", "DESC"), ("high_specificity", "median_specificity", "DESC"),
    ("low_specificity", "median_specificity", "ASC"), ("templated", "templated_max", "DESC"), ("cohort", "review_count", "DESC"), ("one_star", "one_star_share", "DESC"),
    ("five_star", "five_star_share", "DESC"), ("coordinated", "coordinated_score", "DESC"),
]
ORACLES["ranking_sections"] = f"WITH RECURSIVE {SUMMARY} " + " UNION ALL ".join(
    f"(SELECT '{s}' AS section, row_number() OVER (ORDER BY {c} {o}, place_name NULLS LAST, place_id)::INT AS rank, place_id, place_name, {c}::DOUBLE AS value FROM summary WHERE {c} IS NOT NULL QUALIFY rank <= 5)"
    for s, c, o in _SECTIONS
)
ORACLES["place_listing"] = f"""WITH RECURSIVE {RV}, {META}, {COMP}, k AS (SELECT place_id, component, count(*) AS k FROM rv JOIN comp ON node = review_id GROUP BY ALL),
  kk AS (SELECT place_id, sum(k) AS repeated FROM k WHERE k >= 3 GROUP BY 1), n AS (SELECT place_id, count(*) AS review_count FROM rv WHERE place_id IS NOT NULL GROUP BY 1),
  x AS (SELECT n.place_id, place_name, place_category, n.review_count, floor(1e6 * coalesce(repeated, 0) / n.review_count + 0.5) / 1e4 AS duplicate_rate FROM n JOIN meta ON meta.place_id = n.place_id LEFT JOIN kk ON kk.place_id = n.place_id)
  SELECT * FROM x WHERE review_count >= 10 AND (contains(lower(coalesce(place_name, '')), 'an') OR contains(lower(place_id), 'an')) AND duplicate_rate BETWEEN 0 AND 50"""
CONTEXT = f"""{RV}, {FAM}, x AS (SELECT component AS family, rating, day, s FROM rv JOIN comp ON node = review_id JOIN sim USING (component)),
ctx AS (SELECT family, count(*) AS members, min(rating) AS low, max(rating) AS high, max(rating) - min(rating) AS spread,
  {r('greatest(' + ', '.join(f'count(*) FILTER (rating = {s})' for s in range(1, 6)) + ') / nullif(count(rating), 0)', 4)} AS identical_share, {r('avg(rating)', 2)} AS avg_rating, count(DISTINCT day) AS days,
  any_value(s) AS avg_similarity, {r('greatest(0.0, CASE WHEN count(DISTINCT day) > 1 THEN 1 - (count(DISTINCT day) - 1) / (count(*) - 1) ELSE 1.0 END)', 3)} AS concentration FROM x GROUP BY 1 HAVING count(*) >= 2)"""
ORACLES["family_context"] = f"WITH RECURSIVE {CONTEXT} SELECT * FROM ctx"
ORACLES["family_filter"] = f"""WITH RECURSIVE {CONTEXT}, l AS (SELECT component, count(*) AS links, count(*) FILTER (kind IN ('near', 'fuzzy')) AS lexical FROM best JOIN comp ON node = u GROUP BY 1)
  SELECT component, size AS members, links, avg_similarity, concentration FROM l JOIN sized USING (component) JOIN ctx ON family = component
  WHERE size >= 3 AND lexical > 0 AND avg_similarity >= 0.8 AND concentration >= 0.2"""
ORACLES["member_links"] = f"""WITH RECURSIVE {COMP}, {LABELS}, m AS (SELECT review_id, min(duplicate_label) AS label FROM labels GROUP BY 1)
  SELECT u, v, kind, score, a.label AS label_u, b.label AS label_v FROM best LEFT JOIN m a ON a.review_id = u LEFT JOIN m b ON b.review_id = v WHERE a.label IS NOT NULL OR b.label IS NOT NULL"""
JUDGED = f"""{RV}, {LABELS}, {FAM}, tp AS (SELECT review_id, templated FROM {TEMPLATED}), sc AS ({BASE['specificity']}),
judged AS (SELECT l.*, coalesce(l.sample_type, CASE WHEN l.review_id < 'rv8' THEN 'evaluation' ELSE 'challenge' END) AS sample, tp.templated, sc.specificity, sized.size AS family_size, v.text
  FROM labels l JOIN rv v ON v.review_id = l.review_id JOIN tp ON tp.review_id = l.review_id JOIN sc ON sc.review_id = l.review_id LEFT JOIN comp ON node = l.review_id LEFT JOIN sized USING (component))"""
_OFF = "abs(CASE specificity_label WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 END - CASE WHEN specificity >= 65 THEN 2 WHEN specificity >= 40 THEN 1 ELSE 0 END)"
_RATE = lambda a, b, n: f"{r(f'{a} / nullif({b}, 0)', 4)} AS {n}"
ORACLES["label_partitions"] = f"""WITH RECURSIVE {JUDGED}, c AS (SELECT sample, count(*) AS labels, count(*) FILTER (templated >= 65 AND templated_label = 'templated') AS tp, count(*) FILTER (templated >= 65 AND templated_label = 'organic') AS fp,
  count(*) FILTER (templated < 65 AND templated_label = 'templated') AS fn, count(*) FILTER (templated < 65 AND templated_label = 'organic') AS tn, count(*) FILTER ({_OFF} = 1) AS near, count(*) FILTER ({_OFF} = 2) AS far FROM judged GROUP BY 1)
  SELECT *, {_RATE('tp', 'tp + fp', 'precision')}, {_RATE('tp', 'tp + fn', 'recall')}, {_RATE('2 * tp', '2 * tp + fp + fn', 'f1')}, {_RATE('fp', 'fp + tn', 'fpr')}, {_RATE('fn', 'fn + tp', 'fnr')} FROM c"""
_KINDS = [
    ("templated_false_positive", "templated", "templated_label = 'organic' AND templated >= 65"), ("templated_false_negative", "templated", "templated_label = 'templated' AND templated < 65"),
    ("specificity_far_human_low", "specificity", "specificity_label = 'low' AND specificity >= 65"), ("specificity_far_human_high", "specificity", "specificity_label = 'high' AND specificity < 40"),
    ("duplicate_missed_group", "0", "duplicate_label = 'duplicate' AND coalesce(family_size, 0) < 2"), ("duplicate_false_positive", "family_size", "duplicate_label = 'unique' AND family_size >= 2"),
]
_T = "trim(coalesce(text, ''), ' ')"
ORACLES["disagreement_rows"] = f"WITH RECURSIVE {JUDGED} " + " UNION ALL ".join(
    f"""SELECT '{k}' AS kind, CASE sample_type WHEN 'evaluation' THEN 0 WHEN 'challenge' THEN 1 ELSE 2 END AS sample_rank, {s}::DOUBLE AS score, review_id, annotator_id, sample_type, sampling_stratum,
  CASE WHEN length({_T}) > 300 THEN rtrim(left({_T}, 300), ' ') || ' …' ELSE {_T} END AS text FROM judged WHERE {c}"""
    for k, s, c in _KINDS
)
ORACLES["unmatched_labels"] = f"WITH {LABELS} SELECT DISTINCT review_id FROM labels WHERE review_id NOT IN (SELECT review_id FROM reviews WHERE review_id IS NOT NULL)"
ORACLES["annotation_queue"] = f"WITH {LABELS} SELECT DISTINCT review_id FROM reviews WHERE review_id IS NOT NULL AND review_id NOT IN (SELECT review_id FROM labels)"
ORACLES["annotation_progress"] = f"WITH {LABELS} SELECT coalesce(sample_type, 'unattributed') AS sample_type, count(DISTINCT review_id) AS labelled FROM labels GROUP BY 1"
ORACLES["label_ids_equal"] = f"""WITH {LABELS}, a AS (SELECT DISTINCT review_id FROM labels), b AS (SELECT DISTINCT review_id FROM reviews WHERE review_id IS NOT NULL),
  c AS (SELECT (SELECT count(*) FROM a ANTI JOIN b USING (review_id)) AS only_a, (SELECT count(*) FROM b ANTI JOIN a USING (review_id)) AS only_b) SELECT *, only_a = 0 AND only_b = 0 AS equal FROM c"""
ORACLES["group_agreement"] = f"""WITH RECURSIVE {COMP}, {LABELS}, h AS (SELECT DISTINCT review_id, duplicate_group_id AS g FROM labels WHERE duplicate_label = 'duplicate' AND duplicate_group_id IS NOT NULL),
  hs AS (SELECT g, count(*) AS n FROM h GROUP BY 1), ps AS (SELECT component, count(*) AS n FROM comp GROUP BY 1),
  k AS (SELECT g, component, count(*) AS k FROM h JOIN comp ON node = review_id GROUP BY ALL), m AS (SELECT k.* FROM k JOIN hs ON hs.g = k.g JOIN ps ON ps.component = k.component WHERE 2 * k >= hs.n + ps.n - k),
  x AS (SELECT (SELECT count(*) FROM hs) AS human_groups, (SELECT count(*) FROM ps) AS predicted_groups, count(DISTINCT g) AS recovered_human, count(DISTINCT component) AS matched_predicted FROM m)
  SELECT *, {_RATE('recovered_human', 'human_groups', 'recovered_share')}, {_RATE('matched_predicted', 'predicted_groups', 'matched_share')} FROM x"""
ORACLES["challenge_strata"] = f"""WITH RECURSIVE {RV}, {COMP}, smp AS (SELECT review_id FROM rv ORDER BY sha256('7:' || review_id), review_id LIMIT 200),
  s AS (SELECT review_id, CASE WHEN templated >= 65 THEN 'high' WHEN templated >= 40 THEN 'medium' ELSE 'low' END AS stratum FROM {TEMPLATED} WHERE review_id NOT IN (SELECT review_id FROM smp)),
  t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY sha256('11:' || review_id), review_id) <= CASE stratum WHEN 'high' THEN 30 WHEN 'medium' THEN 40 ELSE 20 END),
  q AS (SELECT node AS review_id FROM comp WHERE node NOT IN (SELECT review_id FROM smp) AND node NOT IN (SELECT review_id FROM t) ORDER BY sha256('13:' || node), node LIMIT 25)
  SELECT * FROM t UNION ALL SELECT review_id, 'duplicate' FROM q"""
ORACLES["place_reviewers"] = f"WITH {RV} SELECT DISTINCT place_id, reviewer_id FROM rv WHERE place_id IS NOT NULL AND reviewer_id IS NOT NULL"
ORACLES["ranked_events"] = f"""WITH {BURST} SELECT place_id, day, severity, CASE severity WHEN 'HIGH' THEN 0 ELSE 1 END AS severity_rank,
  CASE WHEN expected <= 0.05 THEN 'baseline below one review a day' ELSE printf('about %.1f times the baseline of ~%.1f reviews a day', multiplier, expected) END AS sentence,
  coalesce(nullif(concat_ws(' · ', {", ".join(f"CASE WHEN r{s} > 0 THEN '{s}★×' || r{s} END" for s in (5, 4, 3, 2, 1))}), ''), 'no ratings on record') AS mix FROM bursts"""


def _fits(wanted: list[str], excluded: list[str]) -> str:
    some = lambda ws: " OR ".join(f"len(list_filter(t, lambda x: contains(x, '{w}'))) > 0" for w in ws)
    return f"(({some(wanted)}) AND NOT ({some(excluded)}))"


_RULES = {"food": (["cafe", "coffee", "restaurant", "bakery", "bar"], ["barber"]), "care": (["clinic", "dent", "barber", "salon"], ["pet"]), "stay": (["hotel", "hostel", "inn"], ["dinner"])}
ORACLES["single_categories"] = f"""WITH {RV}, c AS (SELECT DISTINCT place_category, list_filter(list_transform(string_split(lower(place_category), ';'), lambda x: trim(x)), lambda x: x != '') AS t FROM rv WHERE place_category IS NOT NULL),
  f AS (SELECT place_category, list_filter([{", ".join(f"CASE WHEN {_fits(*w)} THEN '{n}' END" for n, w in _RULES.items())}], lambda x: x IS NOT NULL) AS f FROM c)
  SELECT place_category, CASE WHEN len(f) = 1 THEN f[1] END AS category FROM f"""
ORACLES["skip_counters"] = """SELECT CASE WHEN rating IS NULL THEN 'rating' WHEN trim(coalesce(text, '')) = '' THEN 'text' WHEN trim(coalesce(place_name, '')) = '' THEN 'place' ELSE 'kept' END AS reason, count(*) AS rows FROM reviews GROUP BY 1"""
ORACLES["first_locations"] = f"WITH {RV} SELECT review_id, coalesce(nullif(trim(city), ''), nullif(trim(region), ''), nullif(trim(country), '')) AS location FROM rv"
ORACLES["iso_millis"] = "SELECT event_id, strftime(make_timestamp(epoch_us(ts) // 1000 * 1000), '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS iso FROM events WHERE ts IS NOT NULL"
_CAT = lambda *c: " || chr(31) || ".join(f"coalesce({x}, '')" for x in c)
ORACLES["derived_ids"] = f"""WITH {RV} SELECT review_id, 'pl_' || left(sha256({_CAT('place_name', 'city')}), 10) AS place_key, 'rw_' || left(sha256({_CAT('reviewer_id', 'place_id', 'review_id')}), 16) AS review_key FROM rv"""
_PRINT = " || chr(31) || ".join(f"coalesce('{c}=' || {c}::VARCHAR, '{c}')" for c in sorted(["place_id", "reviewer_id", "rating", "text", "city"]))
ORACLES["record_fingerprints"] = f"WITH {RV} SELECT review_id, sha256({_PRINT}) AS fingerprint FROM rv"
ORACLES["density_violations"] = f"""WITH {RV}, p AS (SELECT place_id AS id, count(*) AS n FROM rv WHERE place_id IS NOT NULL GROUP BY 1), q AS (SELECT reviewer_id AS id, count(*) AS n, count(DISTINCT place_id) AS k FROM rv WHERE reviewer_id IS NOT NULL GROUP BY 1)
  SELECT 'place_reviews' AS "check", id, n FROM p WHERE n < 10 UNION ALL SELECT 'reviewer_reviews', id, n FROM q WHERE n < 3 UNION ALL SELECT 'reviewer_places', id, k FROM q WHERE k < 2"""
ORACLES["reviews_per_place"] = f"""WITH {RV}, p AS (SELECT count(*) AS n FROM rv WHERE place_id IS NOT NULL GROUP BY place_id)
  SELECT count(*) AS n, min(n)::DOUBLE AS min, {", ".join(f"{r(f'quantile_cont(n, {q})', 3)} AS {a}" for q, a in ((0.25, 'p25'), (0.5, 'median'), (0.75, 'p75'), (0.9, 'p90')))}, max(n)::DOUBLE AS max FROM p"""
ORACLES["corpus_stats"] = f"""WITH {RV}, l AS (SELECT place_id, reviewer_id, count(*) AS n FROM rv WHERE place_id IS NOT NULL AND reviewer_id IS NOT NULL GROUP BY ALL),
  a AS (SELECT count(*) AS rows, count(DISTINCT place_id) AS places, count(DISTINCT reviewer_id) AS reviewers, count(*) FILTER (latitude IS NOT NULL AND longitude IS NOT NULL) AS located,
    count(*) FILTER (trim(coalesce(place_category, '')) != '') AS categorised, count(*) FILTER (trim(coalesce(text, '')) != '') AS texts FROM rv),
  b AS (SELECT count(*) AS links, count(*) FILTER (n > 1) AS repeated_links FROM l) SELECT *, {r('links / nullif(places * reviewers, 0)', 6)} AS density FROM a CROSS JOIN b"""
ORACLES["top_categories"] = f"WITH {RV} SELECT place_category AS value, count(*) AS n FROM rv WHERE place_category IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 15"
ORACLES["metadata_conflicts"] = f"""WITH {RV} SELECT place_id, count(DISTINCT {" || chr(31) || ".join(f"coalesce({c}, chr(1))" for c in ("place_name", "city", "region", "country"))}) AS versions FROM rv GROUP BY 1 HAVING versions > 1"""
ORACLES["reviewer_periods"] = f"""WITH {RV}, p AS (SELECT reviewer_id, (CASE WHEN count(day) = 1 THEN 1 WHEN count(day) > 1 THEN greatest(1, max(day) - min(day)) END)::INT AS days, avg((rating = 5)::INT) AS share FROM rv GROUP BY 1)
  SELECT reviewer_id, CASE WHEN days IS NULL OR days <= 0 THEN 'no data' WHEN days = 1 THEN '1 day' WHEN days < 30 THEN '~' || days || ' days' WHEN days < 365 THEN '~' || (days // 30) || ' months'
    ELSE replace(printf('~%.1f years', days / 365), '.0 years', ' years') END AS period, printf('%.1f', {r('share * 100', 1)}) || '%' AS five_star FROM p"""
ORACLES["centre_cosines"] = f"""WITH {RV}, v AS (SELECT review_id, min(embedding) AS e FROM embeddings_cache WHERE model_name = 'minilm-multi-384' AND len(embedding) = 384 GROUP BY 1),
  u AS (SELECT place_id, review_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM v JOIN rv USING (review_id) WHERE list_dot_product(e, e) > 0),
  m AS (SELECT place_id, i, avg(x) AS x FROM (SELECT place_id, unnest(u) AS x, unnest(range(384)) AS i FROM u) GROUP BY ALL), c AS (SELECT place_id, list(x ORDER BY i) AS c FROM m GROUP BY 1)
  SELECT u.place_id, review_id, {r('list_dot_product(u, c) / (sqrt(list_dot_product(c, c)) + 1e-9)', 3)} AS cosine FROM u JOIN c ON c.place_id IS NOT DISTINCT FROM u.place_id"""
