"""DuckDB SQL of the general problems."""

from __future__ import annotations

_S = r"[\p{Z}\t-\r\x1c-\x1f\x{85}]"
_Z = r"(Z|z|[A-Z]{3,4}|[+-]\d{2}(?::?\d{2})?|\[?[A-Za-z][A-Za-z_+-]*(?:/[A-Za-z0-9_+-]+)+\]?|\[UTC\])?"
_T = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?: ?(AM|PM|am|pm)\b)?"
_TAIL = rf"(?:(?:[Tt]|,? ){_T} ?{_Z})?$"
_ISO = rf"^(\d{{4}})[-./](\d{{1,2}})[-./](\d{{1,2}}){_TAIL}"
_DOT = rf"^(\d{{1,2}})[.-](\d{{1,2}})[.-](\d{{4}}|\d{{2}}){_TAIL}"
_SLASH = rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}){_TAIL}"
_DMY = rf"^(?:\p{{L}}{{2,9}}\.?, ?)?(\d{{1,2}})\.? (\p{{L}}+)\.?,? (\d{{4}})(?:,? {_T} ?{_Z})?$"
_MDY = rf"^(?:\p{{L}}{{2,9}}\.?, ?)?(\p{{L}}+)\.? (\d{{1,2}}),? (\d{{4}})(?:,? {_T} ?{_Z})?$"
_BARE = rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt](\d{{2}})(\d{{2}})(\d{{2}})(?:[.,](\d+))? ?{_Z}$"
_REST = r"\4|\5|\6|\7|\8|\9"
CANONICAL = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{6}"

# one row per review: us (the instant), rating and the keys of the current delivery
INSTANTS = rf"""
cur AS (
  SELECT * FROM reviews WHERE review_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY ingested_at DESC NULLS LAST, rating DESC NULLS LAST, source_url DESC NULLS LAST) = 1
),
tidy AS (
  SELECT r.*, coalesce(s.naive_zone, 'UTC') AS nz, coalesce(s.date_order, 'dmy') = 'mdy' AS mdy,
    regexp_replace(regexp_replace(published_at, '^{_S}+|{_S}+$', '', 'g'), '{_S}+', ' ', 'g') AS c
  FROM cur r LEFT JOIN review_sources s ON r.source = s.source
),
parts AS (
  SELECT *, string_split(CASE
    WHEN regexp_full_match(c, '{CANONICAL}') THEN 'w|' || regexp_replace(c, '^(....)-(..)-(..)T(..):(..):(..)\.(.+)$', '\1|\2|\3|\4|\5|\6|\7') || '||UTC'
    WHEN regexp_matches(c, '{_ISO}') THEN regexp_replace(c, '{_ISO}', 'w|\1|\2|\3|{_REST}')
    WHEN regexp_matches(c, '{_DOT}') THEN regexp_replace(c, '{_DOT}', 'w|\3|\2|\1|{_REST}')
    WHEN regexp_matches(c, '{_SLASH}') AND mdy THEN regexp_replace(c, '{_SLASH}', 'w|\3|\1|\2|{_REST}')
    WHEN regexp_matches(c, '{_SLASH}') THEN regexp_replace(c, '{_SLASH}', 'w|\3|\2|\1|{_REST}')
    WHEN regexp_matches(c, '^(\d{{10}}|\d{{13}}|\d{{16}})(\.\d+)?$') THEN 'e|' || replace(c, '.', '')
    WHEN regexp_matches(c, '{_DMY}') THEN regexp_replace(c, '{_DMY}', 'w|\3|\2|\1|{_REST}')
    WHEN regexp_matches(c, '{_MDY}') THEN regexp_replace(c, '{_MDY}', 'w|\3|\1|\2|{_REST}')
    WHEN regexp_matches(c, '{_BARE}') THEN regexp_replace(c, '{_BARE}', 'w|\1|\2|\3|\4|\5|\6|\7||\8')
  END, '|') AS p FROM tidy
),
named AS (
  SELECT *, map {{'january':1,'jan':1,'января':1,'february':2,'feb':2,'февраля':2,'march':3,'mar':3,'марта':3,'april':4,'apr':4,'апреля':4,
    'may':5,'мая':5,'june':6,'jun':6,'июня':6,'july':7,'jul':7,'июля':7,'august':8,'aug':8,'августа':8,'september':9,'sep':9,'сентября':9,
    'october':10,'oct':10,'октября':10,'november':11,'nov':11,'ноября':11,'december':12,'dec':12,'декабря':12}} AS months,
    map {{'Z':0,'UTC':0,'GMT':0,'EST':-18000,'EDT':-14400,'CET':3600,'CEST':7200,'MSK':10800}} AS fixed,
    try_cast(p[5] AS INT) AS h0
  FROM parts
),
walls AS (
  SELECT *, CASE WHEN p[1] = 'w' THEN try_cast(
      (CASE WHEN length(p[2]) = 2 THEN '20' ELSE '' END || p[2]) || '-' || lpad(coalesce(months[lower(p[3])]::VARCHAR, p[3]), 2, '0') || '-' || lpad(p[4], 2, '0')
      || ' ' || CASE WHEN p[5] = '' THEN '00:00:00' ELSE
        lpad(CASE WHEN p[9] = '' THEN p[5] WHEN h0 BETWEEN 1 AND 12 THEN (h0 % 12 + CASE WHEN upper(p[9]) = 'PM' THEN 12 ELSE 0 END)::VARCHAR ELSE 'x' END, 2, '0')
        || ':' || p[6] || ':' || CASE WHEN p[7] = '' THEN '00' ELSE p[7] END || '.' || rpad(substr(p[8], 1, 6), 6, '0') END AS TIMESTAMP) END AS wall,
    CASE WHEN p[5] = '' THEN 'UTC' ELSE trim(p[10], '[]') END AS zn
  FROM named
),
zoned AS (
  SELECT *, epoch_us(wall) AS wus, epoch_us(wall) // 1000000 AS w,
    CASE WHEN zn = '' THEN nz WHEN fixed[upper(zn)] IS NULL AND zn IN (SELECT name FROM pg_timezone_names()) AND contains(zn, '/') THEN zn END AS zone,
    CASE WHEN fixed[upper(zn)] IS NOT NULL THEN fixed[upper(zn)]
         WHEN regexp_matches(zn, '^[+-]') THEN CASE WHEN left(zn, 1) = '-' THEN -1 ELSE 1 END
           * (substr(zn, 2, 2)::INT * 3600 + coalesce(try_cast(substr(replace(zn, ':', ''), 4, 2) AS INT), 0) * 60) END AS off
  FROM walls
),
near AS (
  SELECT *, epoch(timezone(zone, to_timestamp(w - 86400)))::BIGINT - (w - 86400) AS o1,
    epoch(timezone(zone, to_timestamp(w + 86400)))::BIGINT - (w + 86400) AS o2 FROM zoned
),
inst AS (
  SELECT review_id, place_id, reviewer_id, place_category, rating, published_at, off, p, o1, o2, w, zone,
    CASE WHEN p[1] = 'e' THEN rpad(p[2], 16, '0')::BIGINT ELSE wus - 1000000 * (CASE WHEN off IS NOT NULL THEN off
      WHEN epoch(timezone(zone, to_timestamp(w - o1)))::BIGINT - (w - o1) = o1 THEN o1
      WHEN epoch(timezone(zone, to_timestamp(w - o2)))::BIGINT - (w - o2) = o2 THEN o2 ELSE o1 END) END AS us
  FROM near
)"""

P6_FOUND = rf"""WITH {INSTANTS}
SELECT review_id, strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S.%f') AS published_utc
FROM inst WHERE us IS NOT NULL AND NOT regexp_full_match(published_at, '{CANONICAL}')"""

P1_FOUND = f"""WITH {INSTANTS}
SELECT reviewer_id, place_category FROM inst WHERE place_category IS NOT NULL AND reviewer_id IS NOT NULL
GROUP BY ALL HAVING count(us) >= 4 AND date_diff('day', min(make_timestamp(us))::DATE, max(make_timestamp(us))::DATE) <= 1"""

P4_FOUND = f"""WITH {INSTANTS},
daily AS (SELECT place_id, make_timestamp(us)::DATE AS day, count(*) AS n FROM inst WHERE us IS NOT NULL AND place_id IS NOT NULL GROUP BY ALL),
calendar AS (SELECT place_id, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day, min(day) AS first FROM daily GROUP BY place_id),
filled AS (SELECT c.place_id, c.day, c.first, coalesce(n, 0) AS n FROM calendar c LEFT JOIN daily d ON c.place_id = d.place_id AND c.day = d.day),
sums AS (SELECT *, sum(n) OVER (PARTITION BY place_id ORDER BY day ROWS 6 PRECEDING) AS n7,
  sum(n) OVER (PARTITION BY place_id ORDER BY day ROWS 29 PRECEDING) AS n30 FROM filled)
SELECT place_id, strftime(day, '%Y-%m-%d') AS activity_day FROM sums
WHERE date_diff('day', first, day) >= 29 AND n7 >= 10 AND n7 * 5 >= n30 * 4"""

_SEP = {"\t": r"\t", ";": ";", ",": ",", "|": r"\|"}


def _cases(template: str) -> str:
    names = {"\t": "chr(9)", ";": "';'", ",": "','", "|": "'|'"}
    return "CASE " + " ".join(f"WHEN field_sep = {names[k]} THEN {template.replace('SEP', v)}" for k, v in _SEP.items()) + " END"


_FIELD = r'(?:"(?:[^"]|"")*"|[^"SEP]*)'
_FIELD_IN = r'(?:"(?:[^"]|"")*"|[^"SEP]?[^"SEP]*)'

P3_FOUND = rf"""WITH q AS (
  SELECT line_id, field_sep, coalesce(raw_line, '') AS r,
    {_cases("regexp_full_match(coalesce(raw_line, ''), '" + _FIELD + "(?:SEP" + _FIELD + ")*')")} AS quoted
  FROM raw_review_lines
),
f AS (
  SELECT line_id, quoted, CASE WHEN quoted THEN list_transform(
    {_cases("regexp_extract_all(field_sep || r, 'SEP(" + _FIELD + ")', 1)")},
    lambda x: CASE WHEN x[1] = '"' THEN replace(x[2:-2], '""', '"') ELSE x END) END AS f
  FROM q
),
g AS (
  SELECT *, list_transform(f, lambda x: regexp_replace(x, '^{_S}+|{_S}+$', '', 'g')) AS t,
    regexp_extract(f[7], '-?\d+') AS stars, replace(regexp_replace(f[13], '{_S}', '', 'g'), ',', '.') AS lat FROM f
),
h AS (
  SELECT line_id, CASE WHEN NOT quoted THEN 'quoting' WHEN len(f) != 16 THEN 'columns'
    WHEN t[1] = '' OR t[2] = '' OR t[5] = '' THEN 'key'
    WHEN t[7] != '' AND coalesce(try_cast(stars AS INT) NOT BETWEEN 1 AND 5, true) THEN 'rating'
    WHEN t[13] != '' AND (NOT regexp_full_match(lat, '[+-]?\d+(\.\d+)?') OR try_cast(lat AS DOUBLE) NOT BETWEEN -90 AND 90) THEN 'latitude' END AS reason
  FROM g
)
SELECT line_id, reason FROM h WHERE reason IS NOT NULL"""

def _window(w: int) -> str:
    over = f"OVER (PARTITION BY place_id ORDER BY day ROWS {w - 1} PRECEDING)"
    return f"""(sum(n) {over})::BIGINT AS events_{w}, (sum(s) {over})::DOUBLE AS value_sum_{w}, (sum(s) {over})::DOUBLE / nullif(sum(k) {over}, 0)::DOUBLE AS value_avg_{w},
  (min(lo) {over})::DOUBLE AS value_min_{w}, (max(hi) {over})::DOUBLE AS value_max_{w}"""


P4_ROLLING = f"""WITH {INSTANTS},
daily AS (SELECT place_id, make_timestamp(us)::DATE AS day, count(*) AS n, count(rating) AS k, coalesce(sum(rating), 0) AS s, min(rating) AS lo, max(rating) AS hi
  FROM inst WHERE us IS NOT NULL AND place_id IS NOT NULL GROUP BY ALL),
calendar AS (SELECT place_id, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day, min(day) AS first FROM daily GROUP BY place_id),
filled AS (SELECT c.place_id, c.day, c.first, coalesce(n, 0) AS n, coalesce(k, 0) AS k, coalesce(s, 0) AS s, lo, hi FROM calendar c LEFT JOIN daily d ON c.place_id = d.place_id AND c.day = d.day)
SELECT place_id, day AS activity_day, (date_diff('day', first, day) + 1)::INT AS day_number, n AS events, {_window(7)}, {_window(30)} FROM filled"""

P6_TIMESTAMPS = rf"""WITH {INSTANTS}
SELECT review_id, strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S.%f') AS published_utc, NOT coalesce(regexp_full_match(published_at, '{CANONICAL}'), false) AS rewritten,
  CASE WHEN us IS NULL THEN NULL WHEN off IS NOT NULL OR p[1] = 'e' THEN 'exact'
    WHEN (o1 != o2) AND epoch(timezone(zone, to_timestamp(w - o1)))::BIGINT - (w - o1) = o1 AND epoch(timezone(zone, to_timestamp(w - o2)))::BIGINT - (w - o2) = o2 THEN 'ambiguous'
    WHEN epoch(timezone(zone, to_timestamp(w - o1)))::BIGINT - (w - o1) = o1 OR epoch(timezone(zone, to_timestamp(w - o2)))::BIGINT - (w - o2) = o2 THEN 'exact' ELSE 'nonexistent' END AS zone_note
FROM inst"""

_MEASURES = """count(*) AS review_count, count(us) AS dated_count, min(make_timestamp(us)::DATE) AS first_day, max(make_timestamp(us)::DATE) AS last_day,
  greatest(1, max(make_timestamp(us)::DATE) - min(make_timestamp(us)::DATE))::INT AS active_period_days, (DATE '2025-01-01' - max(make_timestamp(us)::DATE))::INT AS recency_days,
  sum(rating)::BIGINT AS rating_sum, sum(rating)::DOUBLE / count(rating) AS rating_avg"""
_MEASURES = _MEASURES.replace("greatest(1, max", "CASE WHEN count(us) > 0 THEN greatest(1, max").replace("::DATE))::INT AS active", "::DATE)) END::INT AS active").replace(
    "/ count(rating)", "/ nullif(count(rating), 0)"
)
P1_BY_TYPE = f"WITH {INSTANTS} SELECT reviewer_id, place_category AS type, {_MEASURES} FROM inst WHERE reviewer_id IS NOT NULL AND place_category IS NOT NULL GROUP BY ALL"
P1_TOTALS = f"WITH {INSTANTS} SELECT reviewer_id, {_MEASURES} FROM inst WHERE reviewer_id IS NOT NULL GROUP BY ALL"

_BLANK = "nullif(t[{0}], '')"
_FIELDS = "review_id place_id place_name place_category reviewer_id reviewer_name rating text published_at city region country latitude longitude source source_url".split()
_LON = f"replace(regexp_replace(f[14], '{_S}', '', 'g'), ',', '.')"
_TYPED = {"rating": "try_cast(stars AS INT)", "latitude": r"CASE WHEN regexp_full_match(lat, '[+-]?\d+(\.\d+)?') THEN try_cast(lat AS DOUBLE) END", "longitude": f"CASE WHEN try_cast({_LON} AS DOUBLE) BETWEEN -180 AND 180 THEN try_cast({_LON} AS DOUBLE) END"}
P3_ROWS = P3_FOUND[: P3_FOUND.index("SELECT line_id, reason FROM h WHERE")].replace("SELECT line_id, CASE WHEN NOT quoted", "SELECT line_id, t, f, stars, lat, CASE WHEN NOT quoted") + (
    "SELECT line_id, " + ", ".join(f"{_TYPED[n] if n in _TYPED else _BLANK.format(i)} AS {n}" for i, n in enumerate(_FIELDS, 1)) + " FROM h WHERE reason IS NULL"
)

ORACLES = {
    "p1_by_type": P1_BY_TYPE, "p1_totals": P1_TOTALS, "p3_rows": P3_ROWS, "p4_rolling": P4_ROLLING, "p6_timestamps": P6_TIMESTAMPS, "p1_found": P1_FOUND, "p3_found": P3_FOUND, "p4_found": P4_FOUND,
    "p6_found": P6_FOUND,
}
