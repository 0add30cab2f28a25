"""DuckDB SQL of the review analytics."""

from __future__ import annotations

from plumbline.functions import lexicon
from plumbline.plans.general_sql import INSTANTS

ORACLES: dict[str, str] = {}

SPACE = r"[\p{Z}\t-\r\x1c-\x1f\x{85}]"
# one row per review: the current delivery, its day and the canonical form of its instant
RV = f"""{INSTANTS.strip()},
rv AS (SELECT cur.* EXCLUDE (published_at), coalesce(strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S.%f'), cur.published_at) AS published_at, make_timestamp(us)::DATE AS day
  FROM cur JOIN inst ON inst.review_id = cur.review_id)"""
DAILY = f"""{RV},
daily AS (SELECT place_id, day, count(*) AS n, {", ".join(f"count(*) FILTER (rating = {s}) AS r{s}" for s in range(1, 6))}
  FROM rv WHERE place_id IS NOT NULL AND day IS NOT NULL GROUP BY place_id, day)"""
FILLED = f"""{DAILY},
span AS (SELECT place_id, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM daily GROUP BY place_id),
filled AS (SELECT s.place_id, s.day, coalesce(n, 0) AS n, {", ".join(f"coalesce(r{s}, 0) AS r{s}" for s in range(1, 6))}
  FROM span s LEFT JOIN daily d ON s.place_id = d.place_id AND s.day = d.day)"""


def r(x: str, digits: int) -> str:
    s = f"1e{digits}"
    return f"(floor(({x}) * {s} + 0.5) / {s})"


def clamp(x: str, a: float, b: float) -> str:
    return f"greatest({a}::DOUBLE, least({b}::DOUBLE, {x}))"


def add(name: str, sql: str) -> None:
    ORACLES[name] = sql


KEYS = "place_id, place_name, place_category, city, region, country"
add("place_rollup", f"""WITH {RV} SELECT {KEYS}, min(latitude) AS latitude, min(longitude) AS longitude, count(*) AS review_count,
  count(DISTINCT reviewer_id) AS reviewer_count, {r('avg(rating)', 4)} AS avg_rating, min(published_at) AS first_published, max(published_at) AS last_published
  FROM rv GROUP BY ALL""")
META = f"""meta AS (SELECT {KEYS}, count(*) AS review_count FROM rv GROUP BY {KEYS} QUALIFY row_number() OVER (PARTITION BY place_id ORDER BY count(*) DESC,
  place_name NULLS LAST, place_category NULLS LAST, city NULLS LAST, region NULLS LAST, country NULLS LAST) = 1)"""
add("place_meta_best", f"WITH {RV}, {META} SELECT * FROM meta")
add("store_counts", f"WITH {RV} SELECT count(*) AS reviews, count(DISTINCT reviewer_id) AS reviewers, count(DISTINCT place_id) AS places FROM rv")
add("filtered_reviews", f"""WITH {RV} SELECT review_id, place_id, rating, day FROM rv
  WHERE (day IS NULL OR day BETWEEN '2023-01-01' AND '2023-12-31') AND (rating IS NULL OR rating IN (1, 5))""")
add("filtered_places", f"""WITH {RV}, {META} SELECT place_id, place_name, review_count FROM meta
  WHERE review_count >= 10 AND (contains(lower(coalesce(place_name, '')), 'an') OR contains(lower(place_id), 'an'))""")
add("capabilities", f"""WITH {RV} SELECT count(*) AS reviews, count(DISTINCT place_id) AS places, count(DISTINCT reviewer_id) AS reviewers, count(day) AS dated_reviews,
  count(rating) AS rated_reviews, count(*) FILTER (length(trim(coalesce(text, ''))) > 0) AS texts, count(*) FILTER (latitude IS NOT NULL AND longitude IS NOT NULL) AS located_reviews,
  count(DISTINCT place_category) AS categories,
  (SELECT count(*) FROM (SELECT reviewer_id FROM rv GROUP BY reviewer_id HAVING count(DISTINCT place_id) > 1)) AS multi_place_reviewers FROM rv""")
_B = "length(trim(coalesce({}, ''))) = 0"
_WRONG = f"(NOT ({_B.format('published_at')}) AND day IS NULL)"
add("data_quality", f"""WITH {RV} SELECT count(*) AS total, count(*) FILTER ({_B.format('text')}) AS missing_text, count(*) FILTER (rating IS NULL) AS missing_rating,
  count(*) FILTER ({_B.format('published_at')}) AS missing_date, count(*) FILTER ({_WRONG}) AS invalid_date,
  count(*) FILTER (latitude IS NULL OR longitude IS NULL) AS missing_coordinates, count(*) FILTER (latitude = 0 AND longitude = 0) AS zero_coordinates,
  count(*) FILTER ({_B.format('place_category')}) AS missing_category, count(*) FILTER (NOT ({_B.format('text')}) AND rating IS NOT NULL AND NOT {_WRONG}) AS complete FROM rv""")
add("repeated_ids", "SELECT review_id, count(*) AS rows FROM reviews WHERE review_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
add("rating_distribution", f"WITH {RV} SELECT s.s::INT AS rating, count(rv.review_id) AS n FROM range(1, 6) s(s) LEFT JOIN rv ON rv.rating = s.s GROUP BY 1")
add("rating_over_time", f"WITH {RV} SELECT day, {r('avg(rating)', 4)} AS avg_rating, count(*) AS n FROM rv WHERE day IS NOT NULL AND rating IS NOT NULL GROUP BY day")
add("category_quartiles", f"""WITH {RV}, {META}, a AS (SELECT place_id, avg(rating) AS avg_rating FROM rv GROUP BY 1)
  SELECT coalesce(place_category, '(no category)') AS place_category, count(*) AS places, sum(review_count)::BIGINT AS reviews,
  {", ".join(f"{r(f'quantile_cont(avg_rating, {q})', 4)} AS {n}" for q, n in ((0.25, 'q1'), (0.5, 'median'), (0.75, 'q3')))} FROM meta JOIN a USING (place_id) GROUP BY 1""")
add("place_ranking", f"""WITH {RV}, p AS (SELECT place_id, min(place_name) AS place_name, count(*) AS reviews, {r('avg(rating)', 4)} AS avg_rating,
  count(DISTINCT reviewer_id) AS reviewers FROM rv GROUP BY 1),
  l AS (SELECT place_id, place_name, 'most_reviews' AS section, reviews::DOUBLE AS value, -value AS o FROM p
    UNION ALL SELECT place_id, place_name, 'best_rated', avg_rating, -avg_rating FROM p
    UNION ALL SELECT place_id, place_name, 'worst_rated', avg_rating, avg_rating FROM p
    UNION ALL SELECT place_id, place_name, 'most_reviewers', reviewers, -reviewers FROM p)
  SELECT place_id, place_name, section, value, (row_number() OVER w)::INT AS rank FROM l WHERE value IS NOT NULL
  WINDOW w AS (PARTITION BY section ORDER BY o, place_name NULLS LAST, place_id) QUALIFY row_number() OVER w <= 5""")
add("daily_counts_filled", f"WITH {FILLED} SELECT place_id, day, n FROM filled")
BURST = f"""{FILLED},
base AS (SELECT *, list(n) OVER (PARTITION BY place_id ORDER BY day ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS b FROM filled),
med AS (SELECT *, list_median(b)::DOUBLE AS med FROM base WHERE len(b) = 30 AND n >= 3),
mad AS (SELECT *, list_median(list_transform(b, lambda x: abs(x - med)))::DOUBLE AS mad FROM med),
z AS (SELECT *, 0.6745 * (n - med) / greatest(mad, 1.0) AS z, n / greatest(med, 1.0) AS mult FROM mad),
sev AS (SELECT *, CASE WHEN z >= 5.25 THEN 'HIGH' WHEN z >= 3.5 THEN 'MEDIUM' WHEN med >= 1 AND mult >= 5 THEN 'MEDIUM' END AS severity FROM z),
bursts AS (SELECT place_id, day, n AS observed, {r('med', 2)} AS expected, {r('mult', 2)} AS multiplier, {r('z', 2)} AS z_score, {r('mad', 2)} AS mad,
  {r(clamp('(z - 1.75) / 5.25', 0, 1) + ' * 100', 1)} AS score, severity, r1, r2, r3, r4, r5 FROM sev WHERE severity IS NOT NULL)"""
BURST = BURST.replace("list_median(b)", "list_aggregate(b, 'median')").replace("list_median(list_transform(b, lambda x: abs(x - med)))", "list_aggregate(list_transform(b, lambda x: abs(x - med)), 'median')")
add("burst_events", f"WITH {BURST} SELECT * FROM bursts")
_E = "1e-10"


def _jsd() -> str:
    sp, sq = (" + ".join(f"({side}{s} + {_E})" for s in range(1, 6)) for side in "pq")
    parts = []
    for s in range(1, 6):
        a, b = f"((p{s} + {_E}) / ({sp}))", f"((q{s} + {_E}) / ({sq}))"
        m = f"(({a} + {b}) / 2)"
        parts.append(f"{a} * ln({a} / {m}) / 2 + {b} * ln({b} / {m}) / 2")
    return " + ".join(parts)


def _dominant(side: str) -> str:
    top = f"greatest({', '.join(f'{side}{s}' for s in range(1, 6))})"
    return "CASE " + " ".join(f"WHEN {side}{s} = {top} THEN {s}" for s in range(1, 6)) + " END"


SHIFT = f"""{BURST},
win AS (SELECT e.place_id, e.day, {", ".join(f"sum(CASE WHEN d.day < e.day - 1 THEN d.r{s} ELSE 0 END) AS b{s}, sum(CASE WHEN d.day >= e.day - 1 THEN d.r{s} ELSE 0 END) AS e{s}" for s in range(1, 6))}
  FROM bursts e JOIN daily d ON d.place_id = e.place_id AND d.day BETWEEN e.day - 30 AND e.day + 1 WHERE e.observed >= 5 GROUP BY ALL),
wtot AS (SELECT *, b1 + b2 + b3 + b4 + b5 AS b, e1 + e2 + e3 + e4 + e5 AS e FROM win),
dist AS (SELECT place_id, day, {", ".join(f"{r(f'b{s} / b', 4)} AS p{s}, {r(f'e{s} / e', 4)} AS q{s}" for s in range(1, 6))} FROM wtot WHERE b > 0 AND e > 0),
js AS (SELECT *, {r(_jsd(), 4)} AS jsd, greatest(q1, q2, q3, q4, q5) AS top_share FROM dist),
shifts AS (SELECT place_id, day, jsd, top_share, {_dominant('p')} AS baseline_rating, {_dominant('q')} AS event_rating,
  CASE WHEN jsd >= 0.1 AND top_share >= 0.7 THEN 'HIGH' WHEN jsd >= 0.05 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  {r(clamp('jsd / 0.1', 0, 1) + ' * 100', 1)} AS score FROM js)"""
add("rating_anomaly_jsd", f"WITH {SHIFT} SELECT * FROM shifts")
# the strengths that count as evidence: shifts weakened by how spread their ratings are
_AROUND = "CROSS JOIN (VALUES (-1), (0), (1)) o(o)"
add("event_days", f"WITH {SHIFT} SELECT place_id, day FROM bursts UNION SELECT place_id, (day + o)::DATE FROM shifts {_AROUND}")
add("burst_strength", f"""WITH {SHIFT},
  x AS (SELECT place_id, (day + o)::DATE AS day, {clamp('z_score / 10', 0, 1)} AS burst, 0.0::DOUBLE AS shift FROM bursts {_AROUND}
    UNION ALL SELECT place_id, (day + o)::DATE, 0.0, {clamp('jsd / 0.3', 0, 1)} FROM shifts {_AROUND})
  SELECT place_id, day, {r('max(burst)', 4)} AS burst, {r('max(shift)', 4)} AS shift FROM x GROUP BY ALL""")
AGREED = f"""SELECT place_id, day, {r('max(burst)', 4)} AS burst, {r('max(shift)', 4)} AS shift FROM (
    SELECT place_id, (day + o)::DATE AS day, {clamp('z_score / 10', 0, 1)} AS burst, 0.0::DOUBLE AS shift FROM bursts {_AROUND}
    UNION ALL SELECT place_id, (day + o)::DATE, 0.0, {clamp('jsd / 0.3', 0, 1)} * CASE WHEN top_share >= 0.7 THEN 1.0 WHEN top_share >= 0.5 THEN 0.5 WHEN top_share >= 0.3 THEN 0.15 ELSE 0.0 END::DOUBLE
    FROM shifts {_AROUND}) GROUP BY ALL"""
add("temporal_gap_signal", f"""WITH {RV}, g AS (SELECT place_id, day - lag(day) OVER (PARTITION BY place_id ORDER BY day) AS g FROM rv WHERE place_id IS NOT NULL AND day IS NOT NULL),
  m AS (SELECT place_id, median(g)::DOUBLE AS median_gap FROM g GROUP BY 1)
  SELECT place_id, median_gap, {r('coalesce(greatest(0.0, 1 - median_gap / 7.0), 0.0)', 4)} AS temporal_density FROM m""")
add("temporal_peer_signal", f"""WITH {DAILY} SELECT place_id, day, n, (sum(n) OVER (PARTITION BY place_id ORDER BY day RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 7 DAY FOLLOWING) - 1)::BIGINT AS peers FROM daily""")
add("top_reviewer_share", f"""WITH {RV}, c AS (SELECT place_id, reviewer_id, count(*) AS n FROM rv GROUP BY ALL)
  SELECT place_id, sum(n)::BIGINT AS reviews, {r('max(n) / sum(n)', 4)} AS top_share FROM c GROUP BY 1""")

_L = "lower(coalesce(text, ''))"


def _hit(words: list[str], points: float) -> str:
    return f"CASE WHEN regexp_matches({_L}, '{'|'.join(words)}') THEN {points} ELSE 0.0 END"


SQUEEZE = f"trim(regexp_replace(lower(text), '{SPACE}+', ' ', 'g'))"
_SCORE = " + ".join([
    "50.0::DOUBLE",
    f"CASE WHEN regexp_matches({_L}, '\\p{{Nd}}') THEN 12 ELSE 0 END",
    f"CASE WHEN len(regexp_extract_all({_L}, '[\\p{{L}}\\p{{N}}_]{{6,}}')) >= 5 THEN 10 ELSE 0 END",
    f"CASE WHEN regexp_matches({_L}, '(^|[^\\p{{L}}\\p{{N}}_])({'|'.join(lexicon.WAIT)})($|[^\\p{{L}}\\p{{N}}_])') THEN 10 ELSE 0 END",
    _hit(lexicon.PRODUCTS, 10.0), _hit(lexicon.STAFF, 8.0), _hit(lexicon.NARRATIVE, 6.0), f"CASE WHEN length({_L}) > 200 THEN 8 ELSE 0 END",
])
SPEC = f"""CASE WHEN coalesce({SQUEEZE}, '') = '' THEN 0.0 ELSE {r(clamp(f"({_SCORE})::DOUBLE * CASE WHEN length({_L}) < 50 THEN 0.55::DOUBLE ELSE 1.0::DOUBLE END - {_hit(lexicon.GENERIC, 15.0)}", 0, 100), 1)} END"""
add("specificity", f"WITH {RV}, s AS (SELECT review_id, {SPEC} AS specificity FROM rv) SELECT *, CASE WHEN specificity >= 65 THEN 'HIGH' WHEN specificity >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM s")
SPAN = "(max(day) - min(day))"
_N = "count(rating)"
_ENT = " + ".join(f"(CASE WHEN count(*) FILTER (rating = {s}) > 0 THEN -(count(*) FILTER (rating = {s}) / {_N}) * log2(count(*) FILTER (rating = {s}) / {_N}) ELSE 0.0 END)" for s in range(1, 6))
add("reviewer_metrics", f"""WITH {RV}, s AS (SELECT *, {SPEC} AS spec FROM rv),
  m AS (SELECT reviewer_id, count(*) AS review_count, {r('avg(rating)', 2)} AS rating_mean, CASE WHEN {_N} < 2 THEN 0.0 ELSE stddev_pop(rating) END AS std,
    CASE WHEN {_N} > 0 THEN ({_ENT}) / log2(5.0) END AS entropy, {r("avg(length(coalesce(text, '')))", 1)} AS text_length_mean,
    count(DISTINCT place_category) AS category_count, count(DISTINCT city) AS city_count,
    (CASE WHEN count(day) = 1 THEN 1 WHEN count(day) > 1 THEN greatest(1, {SPAN}) END)::INT AS active_period_days, {r('avg(spec)', 1)} AS specificity_mean FROM s GROUP BY 1)
  SELECT reviewer_id, review_count, rating_mean, {r('std', 3)} AS rating_std, {r('coalesce(entropy, 0.0)', 3)} AS rating_entropy, text_length_mean, category_count, city_count,
    active_period_days, specificity_mean, {r('coalesce(1 - entropy, 0.0)', 3)} AS review_diversity, {r(f"greatest(0.0, 1 - {r('std', 3)} / 2)", 3)} AS review_consistency FROM m""")
EXP = f"""tot AS (SELECT reviewer_id, count(*) AS total FROM rv GROUP BY 1),
per AS (SELECT reviewer_id, place_category, count(*) AS n, count(day) AS dated, {SPAN} AS span, count(DISTINCT place_id) AS places FROM rv WHERE place_category IS NOT NULL GROUP BY ALL),
exper AS (SELECT reviewer_id, place_category, {r(clamp('100 * (0.35 * least(1.0, log10(n + 1) / 3) + 0.4 * (n / total) * least(1.0, log10(total + 1) / 3) + 0.15 * (CASE WHEN dated >= 2 THEN least(1.0, span / 730.0) ELSE 0.0 END) + 0.1 * least(1.0, places / 5.0))', 0, 100), 1)}
  AS category_experience FROM per JOIN tot USING (reviewer_id))"""
add("category_experience", f"WITH {RV}, {EXP} SELECT * FROM exper")
_COMP = "100 * (0.4 * least(1.0, count(DISTINCT h.place_id) / 3.0) + 0.35 * least(1.0, log10(count(*) + 1) / 2.5) + 0.25 * (CASE WHEN count(h.day) >= 2 THEN least(1.0, (max(h.day) - min(h.day)) / 365.0) ELSE 0.0 END))"
LOCAL = f"""asked AS (SELECT DISTINCT reviewer_id, city, region FROM rv WHERE city IS NOT NULL OR region IS NOT NULL),
own AS (SELECT a.reviewer_id, a.city, a.region, {_COMP} AS c FROM asked a JOIN rv h ON h.reviewer_id = a.reviewer_id AND h.city = a.city GROUP BY ALL),
around AS (SELECT a.reviewer_id, a.city, a.region, {_COMP} AS r FROM asked a JOIN rv h ON h.reviewer_id = a.reviewer_id AND h.region = a.region AND h.city IS DISTINCT FROM a.city GROUP BY ALL),
fam AS (SELECT a.reviewer_id, a.city, a.region, {r(clamp('CASE WHEN c IS NOT NULL AND r IS NOT NULL THEN 0.75 * c + 0.25 * r ELSE coalesce(c, r, 0.0) END', 0, 100), 1)} AS local_familiarity
  FROM asked a LEFT JOIN own o ON o.reviewer_id = a.reviewer_id AND o.city IS NOT DISTINCT FROM a.city AND o.region IS NOT DISTINCT FROM a.region
  LEFT JOIN around w ON w.reviewer_id = a.reviewer_id AND w.city IS NOT DISTINCT FROM a.city AND w.region IS NOT DISTINCT FROM a.region)"""
add("local_familiarity", f"WITH {RV}, {LOCAL} SELECT * FROM fam")
REL = f"""{EXP}, {LOCAL},
hist AS (SELECT reviewer_id, avg(spec) AS spec, CASE WHEN count(rating) < 2 THEN 0.0 ELSE stddev_pop(rating) END AS std, count(*) AS total FROM (SELECT *, {SPEC} AS spec FROM rv) GROUP BY 1),
rel AS (SELECT k.reviewer_id, k.place_category, k.city, k.region,
  {r(clamp('100 * (0.3 * coalesce(category_experience, 0.0) / 100 + 0.25 * spec / 100 + 0.15 * greatest(0.0, 1 - std / 2) + 0.15 * coalesce(local_familiarity, 0.0) / 100 + 0.15 * least(1.0, log10(total + 1) / 2))', 0, 100), 1)} AS relevance
  FROM (SELECT DISTINCT reviewer_id, place_category, city, region FROM rv) k JOIN hist h ON h.reviewer_id = k.reviewer_id
  LEFT JOIN exper e ON e.reviewer_id = k.reviewer_id AND e.place_category = k.place_category
  LEFT JOIN fam f ON f.reviewer_id = k.reviewer_id AND f.city IS NOT DISTINCT FROM k.city AND f.region IS NOT DISTINCT FROM k.region)"""
add("reviewer_relevance", f"WITH {RV}, {REL} SELECT * FROM rel")

_STOP = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in lexicon.STOP) + "]"
TOK = f"tok AS (SELECT review_id, place_id, list_filter(regexp_extract_all({_L}, '[а-яёa-z]+'), lambda w: NOT list_contains({_STOP}, w)) AS t FROM rv)"
add("content_token_counts", f"WITH {RV}, {TOK} SELECT review_id, len(t)::INT AS tokens, len(list_distinct(t))::INT AS distinct_tokens, greatest(len(t) - 1, 0)::INT AS bigrams FROM tok")
_GRAM = "list_transform(range(1, len(t) - {k} + 2), lambda i: {{'g': array_to_string(t[i:i + {k} - 1], ' '), 'pos': i - 1, 'k': {k}}})"
add("phrase_reuse", f"""WITH {RV}, {TOK},
  g AS (SELECT place_id, review_id, unnest(list_concat({_GRAM.format(k=2)}, {_GRAM.format(k=3)}), recursive := true) FROM tok WHERE len(t) > 0),
  hot AS (SELECT place_id, g FROM g GROUP BY ALL HAVING count(DISTINCT review_id) - 1 >= 5),
  c AS (SELECT review_id, count(DISTINCT p) AS covered FROM (SELECT review_id, unnest(range(pos, pos + k)) AS p FROM g JOIN hot ON g.place_id = hot.place_id AND g.g = hot.g) GROUP BY 1)
  SELECT review_id, len(t)::INT AS tokens, {r('coalesce(covered, 0) / len(t)', 4)} AS coverage, {r(clamp('(coalesce(covered, 0) / len(t) - 0.5) / 0.25', 0, 1), 4)} AS phrase_reuse
  FROM tok LEFT JOIN c USING (review_id) WHERE len(t) > 0""")
add("unique_detail", f"""WITH {RV}, {TOK}, w AS (SELECT place_id, review_id, unnest(list_distinct(t)) AS w FROM tok),
  o AS (SELECT place_id, w, count(*) AS owners FROM w GROUP BY ALL)
  SELECT review_id, count(*) AS words, sum((owners - 1 <= 2)::INT)::BIGINT AS rare, {r(clamp('(1 - sum((owners - 1 <= 2)::INT) / count(*)) / 0.5', 0, 1), 4)} AS low_unique_detail
  FROM w JOIN o ON w.place_id IS NOT DISTINCT FROM o.place_id AND w.w = o.w GROUP BY 1""")
SENT = f"""sent AS (SELECT review_id, place_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[.!?…]+'), lambda s: trim(regexp_replace(lower(s), '{SPACE}+', ' ', 'g'))), lambda s: s != '') AS s FROM rv),
lens AS (SELECT review_id, place_id, list_transform(s, lambda x: len(string_split(x, ' '))) AS n FROM sent),
prof AS (SELECT review_id, place_id, n, CASE WHEN len(n) > 0 THEN list_transform(range(0, 6), lambda b: {r('len(list_filter(n, lambda x: least(x // 8, 5) = b)) / greatest(len(n), 1)', 6)}) END AS f FROM lens)"""
add("sentence_profiles", f"WITH {RV}, {SENT} SELECT review_id, array_to_string(list_transform(f, lambda x: floor(x * 10000 + 0.5)::BIGINT::VARCHAR), ',') AS profile FROM prof")
add("style_uniformity", f"""WITH {RV}, {SENT}, u AS (SELECT place_id, unnest(n) AS n FROM lens)
  SELECT place_id, count(*) AS sentences, {r('CASE WHEN count(*) < 2 THEN 0.0 ELSE 1 - ' + clamp('(stddev_pop(n) / (avg(n) + 1e-9) - 0.25) / 0.65', 0, 1) + ' END', 4)} AS uniformity FROM u GROUP BY 1""")
add("structure_similarity", f"""WITH {RV}, {SENT}, v AS (SELECT review_id, place_id, CASE WHEN len(n) > 0 THEN f ELSE [0.0::DOUBLE, 0, 0, 0, 0, 0] END AS f FROM prof),
  nn AS (SELECT review_id, place_id, {", ".join(f"coalesce(f[{i}], 0.0) AS f{i}" for i in range(1, 7))} FROM v),
  no AS (SELECT *, sqrt({" + ".join(f"f{i} * f{i}" for i in range(1, 7))}) + 1e-9 AS norm FROM nn),
  s AS (SELECT a.review_id, b.review_id AS o, ({" + ".join(f"a.f{i} * b.f{i}" for i in range(1, 7))}) / (a.norm * b.norm) AS sim FROM no a JOIN no b ON a.place_id = b.place_id AND a.review_id != b.review_id),
  k AS (SELECT review_id, sim FROM s QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY sim DESC) <= 5),
  m AS (SELECT review_id, avg(sim) AS mean FROM k GROUP BY 1)
  SELECT v.review_id, {r(f"CASE WHEN mean IS NULL THEN 0.0 ELSE {clamp('(mean - 0.6) / 0.35', 0, 1)} END", 4)} AS structure FROM v LEFT JOIN m USING (review_id)""")
add("exact_duplicate_groups", f"""WITH {RV} SELECT place_id, sha256(coalesce({SQUEEZE}, '')) AS text_hash, count(*) AS members, min(review_id) AS first_review FROM rv GROUP BY ALL HAVING count(*) > 1""")
add("bigram_peers", f"""WITH {RV}, {TOK}, b AS (SELECT review_id, place_id, list_distinct(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS s FROM tok),
  p AS (SELECT x.review_id, count(*) AS peers FROM b x JOIN b y ON x.place_id = y.place_id AND x.review_id != y.review_id AND len(x.s) > 0
    AND least(len(x.s), len(y.s)) >= 0.88 * greatest(len(x.s), len(y.s)) AND len(list_intersect(x.s, y.s)) >= 0.88 * (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s))) GROUP BY 1)
  SELECT review_id, coalesce(peers, 0) AS peers FROM b LEFT JOIN p USING (review_id)""")


def _keywords(docs: str, group: str, top: int) -> str:
    return f"""WITH {RV}, docs AS ({docs}), live AS (SELECT * FROM docs WHERE length(trim(coalesce(text, ''))) > 0),
  sizes AS (SELECT {group}, count(*) AS docs FROM live GROUP BY 1),
  words AS (SELECT {group}, doc, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: NOT list_contains({_STOP}, w)) AS t FROM live),
  tf AS (SELECT {group}, doc, term, count(*) AS tf FROM (SELECT {group}, doc, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM words) GROUP BY ALL),
  stats AS (SELECT {group}, term, count(*) AS df FROM tf GROUP BY {group}, term QUALIFY row_number() OVER (PARTITION BY {group} ORDER BY sum(tf) DESC, term) <= 5000),
  raw AS (SELECT tf.{group}, doc, tf.term, (1 + ln(tf)) * (ln((1 + docs) / (1 + df)) + 1) AS x FROM tf JOIN stats s ON tf.{group} = s.{group} AND tf.term = s.term JOIN sizes z ON z.{group} = tf.{group}),
  norm AS (SELECT {group}, doc, sqrt(sum(x * x)) AS norm FROM raw GROUP BY ALL),
  sc AS (SELECT r.{group}, term, {r('sum(x / norm) / any_value(docs)', 6)} AS score FROM raw r JOIN norm n ON r.{group} = n.{group} AND r.doc = n.doc JOIN sizes z ON z.{group} = r.{group} WHERE docs >= 2 GROUP BY ALL),
  many AS (SELECT {group}, term, score, (row_number() OVER w)::INT AS rank FROM sc WHERE score > 0 WINDOW w AS (PARTITION BY {group} ORDER BY score DESC, term) QUALIFY row_number() OVER w <= {top}),
  one AS (SELECT l.{group}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS t FROM live l JOIN sizes z ON z.{group} = l.{group} WHERE docs = 1),
  spots AS (SELECT {group}, len(t) AS total, unnest(t) AS term, unnest(range(len(t))) AS spot FROM one),
  shares AS (SELECT {group}, term, {r('count(*) / any_value(total)', 6)} AS score, (row_number() OVER (PARTITION BY {group} ORDER BY count(*) DESC, min(spot)))::INT AS rank FROM spots GROUP BY {group}, term)
  SELECT * FROM many UNION ALL SELECT * FROM shares WHERE rank <= {top}"""


add("tfidf_keywords", _keywords("SELECT country, review_id AS doc, text FROM rv WHERE country IS NOT NULL", "country", 15))
add("keywords_by_sentiment", _keywords("SELECT CASE WHEN rating >= 4 THEN 'positive' ELSE 'negative' END AS side, review_id AS doc, text FROM rv WHERE rating >= 4 OR rating <= 2", "side", 10))
add("keywords_by_rating", _keywords("SELECT rating, review_id AS doc, text FROM rv WHERE rating IS NOT NULL", "rating", 8))
