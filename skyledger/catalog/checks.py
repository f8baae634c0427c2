"""The registered queries in SQL, for DuckDB.  Written apart from the Spark code, over the test tables."""

from __future__ import annotations

# Flights as text of columns, before hash and stamp.
FLIGHTS = """
flights AS (
 SELECT CAST(l_shipdate AS DATE) AS flight_date, c_mktsegment AS carrier_code,
  'N' || CAST(l_suppkey AS VARCHAR) AS tail_number,
  CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS flight_number,
  ro.r_name AS origin_airport, rd.r_name AS dest_airport,
  CASE WHEN l_partkey % 20 = 0 THEN NULL ELSE l_quantity*2 - 10*l_linenumber END AS dep_delay_minutes,
  CASE WHEN l_partkey % 20 IN (0,1) THEN NULL ELSE l_quantity*5 - 75 END AS arr_delay_minutes,
  l_partkey % 20 = 0 AS is_cancelled, l_partkey % 20 = 1 AS is_diverted,
  CAST(p_size*50 AS DOUBLE) AS distance_miles,
  CASE WHEN l_partkey % 20 IN (0,1) THEN NULL ELSE CAST(p_size*6 AS DOUBLE) END AS air_time_minutes,
  CASE WHEN l_quantity > 15 AND l_partkey % 3 = 0 THEN l_quantity*5-75 ELSE 0e0 END AS carrier_delay_minutes,
  CASE WHEN l_quantity > 15 AND l_partkey % 3 = 1 THEN l_quantity*5-75 ELSE 0e0 END AS weather_delay_minutes,
  CASE WHEN l_quantity > 15 AND l_partkey % 3 = 2 THEN l_quantity*5-75 ELSE 0e0 END AS nas_delay_minutes,
  CASE WHEN l_partkey % 20 = 0 THEN 'A' END AS cancellation_code
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
 JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
 JOIN nation no ON s_nationkey = no.n_nationkey JOIN region ro ON no.n_regionkey = ro.r_regionkey
 JOIN nation nd ON c_nationkey = nd.n_nationkey JOIN region rd ON nd.n_regionkey = rd.r_regionkey)
"""

_COLUMNS = (
    "flight_date carrier_code tail_number flight_number origin_airport dest_airport dep_delay_minutes "
    "arr_delay_minutes is_cancelled is_diverted distance_miles air_time_minutes carrier_delay_minutes "
    "weather_delay_minutes nas_delay_minutes cancellation_code"
).split()


def _hash(columns: list[str]) -> str:
    return "md5(concat_ws('|', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '∅')" for c in columns) + "))"


SILVER = f"""{FLIGHTS},
silver AS (
 SELECT *, {_hash(_COLUMNS)} AS row_hash, TIMESTAMP '2002-01-01 00:00:00' AS ingestion_timestamp FROM flights)
"""

FACTS = f"""{SILVER},
delayed AS (
 SELECT *, CASE WHEN is_cancelled THEN NULL ELSE coalesce(arr_delay_minutes, 0e0) END AS total_delay_minutes
 FROM silver),
facts AS (
 SELECT *,
  CASE WHEN is_cancelled THEN 'CANCELLED' WHEN is_diverted THEN 'DIVERTED'
   WHEN total_delay_minutes <= 0 THEN 'ON_TIME' WHEN total_delay_minutes <= 15 THEN 'MINOR_DELAY'
   WHEN total_delay_minutes <= 60 THEN 'MODERATE_DELAY' ELSE 'SEVERE_DELAY' END AS delay_category,
  concat_ws('-', origin_airport, dest_airport) AS route_key,
  md5(concat_ws('|', carrier_code, flight_number, CAST(flight_date AS VARCHAR), origin_airport, dest_airport))
   AS flight_surrogate_key
 FROM delayed)
"""

DW_CATEGORY = """CASE WHEN arr_delay_minutes <= 15 THEN 'On Time' WHEN arr_delay_minutes <= 45 THEN 'Minor'
 WHEN arr_delay_minutes <= 120 THEN 'Moderate' ELSE 'Severe' END"""

LABELLED = f"{FLIGHTS}, labelled AS (SELECT *, {DW_CATEGORY} AS delay_category FROM flights)"

# Text cells: dates unreadable from 2500 miles on, departure delays from 2400 on.
TYPED = f"""{FLIGHTS},
typed AS (
 SELECT * REPLACE (
   CASE WHEN distance_miles >= 2500 THEN NULL ELSE flight_date END AS flight_date,
   CASE WHEN distance_miles >= 2400 THEN NULL ELSE dep_delay_minutes END AS dep_delay_minutes),
  CASE WHEN distance_miles >= 2500 THEN 1 ELSE 0 END + CASE WHEN distance_miles >= 2400 THEN 1 ELSE 0 END AS faults
 FROM flights)
"""

CARRIERS = """
carrier_names AS (
 SELECT DISTINCT c_mktsegment AS carrier_code,
  upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || ' Air' AS carrier_name FROM customer),
carriers AS (
 SELECT md5(carrier_code || '|1990-01-01') AS carrier_sk, carrier_code, carrier_name FROM carrier_names)
"""

# Region names are single words except MIDDLE EAST: capitals start both words.
AIRPORTS = """
airport_names AS (
 SELECT r_name AS airport_code,
  array_to_string(list_transform(string_split(r_name, ' '),
   lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') || ' Intl' AS airport_name,
  CAST(r_regionkey * 10.5 + 1 AS DOUBLE) AS latitude, CAST(r_regionkey * 20.5 - 40 AS DOUBLE) AS longitude
 FROM region),
airports AS (
 SELECT md5(airport_code || '|1990-01-01') AS airport_sk, * FROM airport_names)
"""

CALENDAR = """
span AS (
 SELECT date_trunc('year', min(l_shipdate)) AS f, date_trunc('year', max(l_shipdate)) + INTERVAL 1 YEAR AS u
 FROM lineitem),
days AS (SELECT CAST(unnest(generate_series(f, u - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS full_date FROM span)
"""

_ROUTES = """
 SELECT {period}carrier_code, origin_airport, dest_airport, count(*) AS total_flights,
  avg(dep_delay_minutes) AS avg_dep_delay_minutes, avg(arr_delay_minutes) AS avg_arr_delay_minutes,
  quantile_disc(arr_delay_minutes, 0.5) AS median_arr_delay_minutes,
  quantile_disc(arr_delay_minutes, 0.95) AS p95_arr_delay_minutes,
  avg(distance_miles) AS avg_distance_miles,
  CAST(sum(CASE WHEN arr_delay_minutes > 60 THEN 1 ELSE 0 END) AS BIGINT) AS severe_delay_count,
  round(1.0 - sum(CASE WHEN arr_delay_minutes > 60 THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE), 4) AS on_time_rate
 FROM flights WHERE NOT is_cancelled GROUP BY ALL
"""

_DELAY_ANALYSIS = f"""{FLIGHTS}, m AS (
 SELECT carrier_code, CAST(date_trunc('month', flight_date) AS DATE) AS flight_month,
  avg(carrier_delay_minutes) AS avg_carrier_delay, avg(weather_delay_minutes) AS avg_weather_delay,
  avg(nas_delay_minutes) AS avg_nas_delay, sum(carrier_delay_minutes) AS c, sum(weather_delay_minutes) AS w,
  sum(carrier_delay_minutes + weather_delay_minutes + nas_delay_minutes) AS total_delay_minutes
 FROM flights GROUP BY ALL)
SELECT * EXCLUDE (c, w), round(w / total_delay_minutes, 4) AS weather_delay_share,
 round(c / total_delay_minutes, 4) AS carrier_delay_share FROM m WHERE total_delay_minutes > 0"""

_HEADLINES = """count(*) AS total_flights, avg(arr_delay_minutes) AS avg_arr_delay,
  round(count(*) FILTER (delay_category = 'On Time') / CAST(count(*) AS DOUBLE), 4) AS on_time_rate,
  round(count(*) FILTER (is_cancelled) / CAST(count(*) AS DOUBLE), 4) AS cancellation_rate"""

EVENTS = """
e AS (
 SELECT event_id, ts, user_id, event_type, CAST(floor(value) AS BIGINT) AS knots,
  CAST(props->>'$.k' AS BIGINT) AS k, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS stamp
 FROM events)
"""

RAW = f"""{EVENTS},
raw AS (
 SELECT 'F' || CAST(event_id AS VARCHAR) AS fr24_id, lpad(printf('%X', user_id), 6, '0') AS hex,
  upper(event_type) || CAST(user_id AS VARCHAR) AS callsign,
  CAST(45 + user_id % 20 AS DOUBLE) AS lat, CAST(user_id % 23 - 10 AS DOUBLE) AS lon,
  k * 400 AS alt, knots AS gspeed, k - 50 AS vspeed, k = 0 AS on_ground, stamp AS ingestion_timestamp, ts
 FROM e)
"""

# None to three positions per event.
POLLED = f"""{EVENTS},
numbered AS (SELECT *, CAST(unnest(range(1, 1 + k % 4)) AS BIGINT) AS i FROM e),
polled AS (
 SELECT CAST(event_id AS VARCHAR) || '-' || CAST(i AS VARCHAR) AS fr24_id,
  lpad(printf('%X', user_id), 6, '0') AS hex,
  CASE WHEN event_type <> 'error' THEN upper(event_type) || CAST(user_id AS VARCHAR) END AS callsign,
  CAST(45 + user_id % 20 AS DOUBLE) + i * 0.25e0 AS lat, CAST(user_id % 23 - 10 AS DOUBLE) AS lon,
  k * 400 + i AS alt, knots AS gspeed, k - 50 AS vspeed, stamp AS ingestion_timestamp, ts
 FROM numbered)
"""


def _fact_positions(source: str, on_ground: str, select: str = "SELECT") -> str:
    return f"""{select} md5(fr24_id || '|' || CAST(epoch_us(ts) AS VARCHAR)) AS position_sk,
 strftime(ts, '%Y%m%d') AS date_sk, hex AS icao24, callsign, lat AS latitude, lon AS longitude,
 alt * CAST(0.3048 AS DOUBLE) AS altitude_metres, gspeed * CAST(0.514444 AS DOUBLE) AS velocity_ms,
 CAST(vspeed AS DOUBLE) AS vertical_speed, {on_ground} AS on_ground, ts AS ingestion_timestamp,
 CAST(ts AS DATE) AS position_date FROM {source}"""


def _merge(key: str, sk: str, tracked: list[str], old: str, new: str) -> str:
    cols = ", ".join(tracked)
    return f"""
old AS (SELECT DISTINCT *, {_hash(tracked)} AS row_hash FROM ({old})),
new AS (SELECT DISTINCT *, {_hash(tracked)} AS row_hash FROM ({new})),
changed AS (SELECT {key} FROM old JOIN new USING ({key}) WHERE old.row_hash <> new.row_hash)
SELECT md5({key} || '|1990-01-01') AS {sk}, {key}, {cols}, row_hash, DATE '1990-01-01' AS effective_from,
 CASE WHEN {key} IN (FROM changed) THEN DATE '2024-06-14' END AS effective_to,
 {key} NOT IN (FROM changed) AS is_current FROM old
UNION ALL
SELECT md5({key} || '|2024-06-15'), {key}, {cols}, row_hash, DATE '2024-06-15', NULL, true FROM new
WHERE {key} IN (FROM changed) OR {key} NOT IN (SELECT {key} FROM old)"""


def _pad(byte: int) -> str:
    """The padded key of `masked_view`, combined with a byte, as a literal."""
    return "'" + "".join(f"\\x{b ^ byte:02X}" for b in b"a key for the check".ljust(64, b"\0")) + "'::BLOB"



_RULES = {
    "flight_date_present": "flight_date IS NOT NULL",
    "carrier_present": "carrier_code IS NOT NULL",
    "airports_differ": "origin_airport <> dest_airport",
    "flags_present": "is_cancelled IS NOT NULL AND is_diverted IS NOT NULL",
    "not_cancelled_and_diverted": "NOT (is_cancelled AND is_diverted)",
    "cancelled_without_arrival": "NOT is_cancelled OR arr_delay_minutes IS NULL",
    "cancelled_with_code": "is_cancelled = (cancellation_code IS NOT NULL)",
    "departure_not_before_one_hour": "dep_delay_minutes IS NULL OR dep_delay_minutes >= -60",
    "distance_positive": "distance_miles > 0",
}

_RULE_COUNTS = " UNION ALL ".join(
    f"SELECT '{name}' AS rule, count(*) AS rows_checked,"
    f" count(*) FILTER (NOT coalesce({rule}, false)) AS rows_failed FROM flights"
    for name, rule in _RULES.items()
)

_RULE_NAMES = (
    "concat_ws(',', "
    + ", ".join(f"CASE WHEN NOT coalesce({rule}, false) THEN '{name}' END" for name, rule in _RULES.items())
    + ")"
)

# Late reports: an hour more for the flights of every fiftieth order.
_CORRECTED = """SELECT * REPLACE (CASE WHEN CAST(split_part(flight_number, '-', 1) AS BIGINT) % 50 = 0
 THEN arr_delay_minutes + 60 ELSE arr_delay_minutes END AS arr_delay_minutes) FROM {rows}"""

CHECKS: dict[str, str] = {
    "scan_silver": f"WITH {SILVER} SELECT * FROM silver",
    "silver_flights": f"WITH {SILVER} SELECT * FROM silver",
    "partition_scan": f"""WITH {FLIGHTS} SELECT flight_date, carrier_code, flight_number, origin_airport,
 dest_airport, arr_delay_minutes FROM flights""",
    "csv_scan": f"WITH {TYPED} SELECT * EXCLUDE (faults) FROM typed WHERE faults = 0",
    "ndjson_scan": f"WITH {POLLED} SELECT * EXCLUDE (ts) FROM polled",
    "bbox_filter": f"""WITH {RAW} SELECT * EXCLUDE (ts) FROM raw
 WHERE lat BETWEEN 49 AND 61.5 AND lon BETWEEN -8.5 AND 10.5""",
    "retention": f"""WITH {FLIGHTS} SELECT flight_date, count(*) AS expired_rows FROM flights
 WHERE flight_date < DATE '2000-09-01' - 365 GROUP BY flight_date""",
    "retention_kept": f"""WITH {FLIGHTS}, dated AS (
 SELECT CASE WHEN flight_number LIKE '%-1' THEN flight_date END AS flight_date FROM flights)
SELECT flight_date, count(*) AS kept_rows FROM dated
WHERE flight_date IS NULL OR flight_date >= DATE '2000-09-01' - 365 GROUP BY flight_date""",
    "fr24_explode": f"WITH {POLLED} SELECT * EXCLUDE (ts) FROM polled",
    "state_vectors": f"""WITH {EVENTS},
v AS (
 SELECT lower(lpad(printf('%X', user_id), 6, '0')) AS icao24, upper(event_type) AS callsign,
  CAST(NULL AS VARCHAR) AS origin_country, CAST(floor(epoch(ts)) AS BIGINT) AS time_position,
  CAST(floor(epoch(ts)) AS BIGINT) AS last_contact, user_id % 23 + 0.5e0 AS longitude,
  user_id % 20 + 45.25e0 AS latitude, CAST(k * 100 AS DOUBLE) AS baro_altitude, k = 0 AS on_ground,
  CAST(knots AS DOUBLE) AS velocity, CAST(NULL AS DOUBLE) AS true_track, -1.5e0 AS vertical_rate,
  '[1,' || CAST(k AS VARCHAR) || ']' AS sensors, CAST(NULL AS DOUBLE) AS geo_altitude, '7000' AS squawk,
  false AS spi, CAST(0 AS INTEGER) AS position_source, CAST(k % 9 AS INTEGER) AS category, event_type
 FROM e)
SELECT * EXCLUDE (event_type) FROM v WHERE event_type <> 'error'
UNION ALL SELECT icao24, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
 NULL, NULL, NULL FROM v WHERE event_type = 'view'""",
    "to_ndjson": f"""WITH {POLLED}
SELECT '{{"fr24_id":"' || fr24_id || '","hex":"' || hex || '","callsign":'
 || coalesce('"' || callsign || '"', 'null') || ',"lat":' || CAST(lat AS VARCHAR) || ',"lon":'
 || CAST(lon AS VARCHAR) || ',"alt":' || CAST(alt AS VARCHAR) || ',"gspeed":' || CAST(gspeed AS VARCHAR)
 || ',"vspeed":' || CAST(vspeed AS VARCHAR) || ',"type":"B77W","ingestion_timestamp":"'
 || ingestion_timestamp || '"}}' AS value FROM polled""",
    "positions_silver": f"""WITH {RAW} SELECT fr24_id, hex AS icao24, callsign, lat AS latitude, lon AS longitude,
 alt * CAST(0.3048 AS DOUBLE) AS altitude_metres, gspeed * CAST(0.514444 AS DOUBLE) AS velocity_ms,
 CAST(vspeed AS DOUBLE) AS vertical_speed, on_ground, ts AS ingestion_timestamp FROM raw""",
    "positions": f"WITH {RAW} {_fact_positions('raw', 'on_ground')}",
    "positions_stream": f"WITH {POLLED} {_fact_positions('polled', 'CAST(NULL AS BOOLEAN)', 'SELECT DISTINCT')}",
    "positions_late_files": f"WITH {POLLED} {_fact_positions('polled', 'CAST(NULL AS BOOLEAN)', 'SELECT DISTINCT')}",
    "dq_rejects_positions": f"""WITH {EVENTS}
SELECT 'no response' AS reason, 2 * count(*) AS rejects, count(DISTINCT ts) AS polls FROM e
UNION ALL SELECT 'no object', 3 * count(*), count(DISTINCT ts) FROM e""",
    "fact_flights": f"WITH {FACTS} SELECT * FROM facts",
    "delay_category_gold": f"""WITH {FACTS} SELECT delay_category, is_cancelled, is_diverted, count(*) AS flights,
 min(total_delay_minutes) AS least_delay, max(total_delay_minutes) AS most_delay FROM facts GROUP BY ALL""",
    "delay_category_dw": f"""WITH {LABELLED} SELECT delay_category,
 CASE WHEN arr_delay_minutes IS NULL THEN 'Unknown' ELSE delay_category END AS delay_category_split,
 count(*) AS flights, min(arr_delay_minutes) AS least_delay, max(arr_delay_minutes) AS most_delay
 FROM labelled GROUP BY ALL""",
    "surrogate_key": f"""WITH {FACTS} SELECT carrier_code, flight_number, flight_date, origin_airport, dest_airport,
 route_key, flight_surrogate_key FROM facts""",
    "mask_tail": f"WITH {FLIGHTS} SELECT flight_number, carrier_code, sha256(tail_number) AS tail_number FROM flights",
    "masked_view": f"""WITH {FLIGHTS} SELECT flight_number, carrier_code,
 sha256({_pad(0x5C)} || unhex(sha256({_pad(0x36)} || encode(tail_number)))) AS tail_number FROM flights""",
    "dim_date": f"""WITH {CALENDAR} SELECT strftime(full_date, '%Y%m%d') AS date_sk, full_date,
 CAST(year(full_date) AS INTEGER) AS year, CAST(month(full_date) AS INTEGER) AS month,
 CAST(day(full_date) AS INTEGER) AS day_of_month, dayname(full_date) AS day_name, monthname(full_date) AS month_name,
 CAST(quarter(full_date) AS INTEGER) AS quarter, dayofweek(full_date) IN (0, 6) AS is_weekend FROM days""",
    "distinct_carriers": f"WITH {FLIGHTS} SELECT DISTINCT carrier_code FROM flights",
    "scd2_carrier": "WITH "
    + _merge(
        "carrier_code",
        "carrier_sk",
        ["carrier_name"],
        "SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS carrier_code, s_name AS carrier_name FROM supplier",
        """SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS carrier_code,
   CASE WHEN s_nationkey < 5 THEN s_name || ' Group' ELSE s_name END AS carrier_name
  FROM supplier WHERE s_acctbal >= 1000
  UNION ALL SELECT 'C' || CAST(c_custkey AS VARCHAR), c_name FROM customer WHERE c_acctbal > 9000""",
    ),
    "scd2_late_snapshot": f"""WITH seen AS (
 SELECT DISTINCT * FROM (
  SELECT DATE '1990-01-01' AS seen, 'S' || CAST(s_suppkey AS VARCHAR) AS carrier_code, s_name AS carrier_name FROM supplier
  UNION ALL SELECT DATE '2010-03-01', 'S' || CAST(s_suppkey AS VARCHAR), CASE WHEN s_nationkey < 3 THEN s_name || ' Group'
   WHEN s_nationkey % 4 = 1 THEN s_name || ' Ltd' ELSE s_name END FROM supplier WHERE s_nationkey % 4 <> 3
  UNION ALL SELECT DATE '2024-06-15', 'S' || CAST(s_suppkey AS VARCHAR),
   CASE WHEN s_nationkey < 5 THEN s_name || ' Group' ELSE s_name END FROM supplier WHERE s_acctbal >= 1000
  UNION ALL SELECT DATE '2024-06-15', 'C' || CAST(c_custkey AS VARCHAR), c_name FROM customer WHERE c_acctbal > 9000)),
hashed AS (SELECT *, {_hash(["carrier_name"])} AS row_hash FROM seen),
starts AS (
 SELECT * FROM hashed QUALIFY lag(row_hash) OVER (PARTITION BY carrier_code ORDER BY seen) IS DISTINCT FROM row_hash)
SELECT md5(carrier_code || '|' || CAST(seen AS VARCHAR)) AS carrier_sk, carrier_code, carrier_name, row_hash, seen AS effective_from,
 CAST(lead(seen) OVER (PARTITION BY carrier_code ORDER BY seen) - 1 AS DATE) AS effective_to,
 lead(seen) OVER (PARTITION BY carrier_code ORDER BY seen) IS NULL AS is_current FROM starts""",
    "scd2_airport": "WITH "
    + _merge(
        "airport_code",
        "airport_sk",
        ["airport_name", "latitude", "longitude"],
        """SELECT 'A' || CAST(c_custkey AS VARCHAR) AS airport_code, c_name AS airport_name,
   CAST(c_nationkey AS DOUBLE) AS latitude,
   CASE WHEN c_mktsegment = 'BUILDING' THEN 2e0 ELSE -2e0 END AS longitude FROM customer""",
        """SELECT 'A' || CAST(c_custkey AS VARCHAR) AS airport_code, c_name AS airport_name,
   CAST(c_nationkey AS DOUBLE) AS latitude,
   CASE WHEN c_mktsegment = 'BUILDING' THEN 2e0 ELSE -2e0 END
    + CASE WHEN c_nationkey >= 20 THEN 0.5e0 ELSE 0e0 END AS longitude
  FROM customer WHERE c_nationkey <> 3
  UNION ALL SELECT 'B' || CAST(s_suppkey AS VARCHAR), s_name, CAST(s_nationkey AS DOUBLE), 0e0 FROM supplier""",
    ),
    "role_playing_airport": f"""WITH {FLIGHTS}, {AIRPORTS}
SELECT flight_date, flight_number, origin_airport, dest_airport, arr_delay_minutes,
 o.airport_name AS origin_name, o.latitude AS origin_latitude, o.longitude AS origin_longitude,
 d.airport_name AS dest_name, d.latitude AS dest_latitude, d.longitude AS dest_longitude
FROM flights LEFT JOIN airports o ON origin_airport = o.airport_code
LEFT JOIN airports d ON dest_airport = d.airport_code""",
    "fact_flights_dw": f"""WITH {FACTS}, {CARRIERS}, {AIRPORTS}, {CALENDAR}
SELECT flight_surrogate_key AS flight_sk, strftime(full_date, '%Y%m%d') AS date_sk, carrier_sk,
 o.airport_sk AS origin_airport_sk, d.airport_sk AS dest_airport_sk, flight_date, facts.carrier_code,
 origin_airport AS origin_airport_code, dest_airport AS dest_airport_code, dep_delay_minutes, arr_delay_minutes,
 distance_miles, air_time_minutes, is_cancelled, is_diverted, {DW_CATEGORY} AS delay_category,
 carrier_delay_minutes, weather_delay_minutes, nas_delay_minutes
FROM facts LEFT JOIN days ON flight_date = full_date
LEFT JOIN carriers ON facts.carrier_code = carriers.carrier_code
LEFT JOIN airports o ON origin_airport = o.airport_code LEFT JOIN airports d ON dest_airport = d.airport_code""",
    "fact_point_in_time": f"""WITH {FLIGHTS}, {AIRPORTS},
versions AS (
 SELECT airport_code, airport_sk, airport_name, DATE '1990-01-01' AS f, DATE '1998-06-30' AS t FROM airports
 UNION ALL SELECT airport_code, md5(airport_code || '|1998-07-01'), airport_name || ' II', DATE '1998-07-01', NULL
 FROM airports WHERE latitude < 30)
SELECT flight_date, flight_number, origin_airport, airport_sk AS origin_airport_sk, airport_name AS origin_name
FROM flights LEFT JOIN versions ON origin_airport = airport_code AND flight_date >= f
 AND (t IS NULL OR flight_date <= t)""",
    "mart_route_rollup": f"""WITH {FLIGHTS}, spans AS (
 SELECT *, CAST(date_trunc('month', flight_date) AS DATE) AS flight_month FROM flights
 UNION ALL SELECT *, NULL FROM flights)
SELECT flight_month, origin_airport, dest_airport, carrier_code, count(*) AS total_flights, avg(arr_delay_minutes) AS avg_arr_delay,
 quantile_disc(arr_delay_minutes, 0.5) AS median_arr_delay, quantile_disc(arr_delay_minutes, 0.95) AS p95_arr_delay
FROM spans GROUP BY flight_month, origin_airport, dest_airport, carrier_code""",
    "mart_route_daily": f"WITH {FLIGHTS} {_ROUTES.format(period='flight_date, ')}",
    "mart_route_monthly": f"""WITH {FLIGHTS}
{_ROUTES.format(period="CAST(date_trunc('month', flight_date) AS DATE) AS flight_month, ")}""",
    "mart_carrier_daily": f"""WITH {LABELLED}, {CARRIERS}
SELECT l.carrier_code, carrier_name, flight_date, count(*) AS total_flights,
 count(*) FILTER (is_cancelled) AS cancelled_flights,
 round(count(*) FILTER (is_cancelled) / CAST(count(*) AS DOUBLE), 4) AS cancellation_rate,
 avg(dep_delay_minutes) AS avg_dep_delay, avg(arr_delay_minutes) AS avg_arr_delay,
 count(*) FILTER (delay_category = 'On Time') AS on_time_count,
 round(count(*) FILTER (delay_category = 'On Time') / CAST(count(*) AS DOUBLE), 4) AS on_time_rate,
 count(*) FILTER (delay_category = 'Severe') AS severe_delay_count
FROM labelled l JOIN carriers c ON l.carrier_code = c.carrier_code GROUP BY ALL""",
    "mart_route_dw": f"""WITH {LABELLED}, {AIRPORTS}
SELECT origin_airport, dest_airport, carrier_code, count(*) AS total_flights, avg(arr_delay_minutes) AS avg_arr_delay,
 round(count(*) FILTER (delay_category = 'On Time') / CAST(count(*) AS DOUBLE), 4) AS on_time_rate,
 round(count(*) FILTER (delay_category = 'Severe') * 100e0 / CAST(count(*) AS DOUBLE), 4) AS pct_severe_delays,
 o.airport_name AS origin_name, o.latitude AS origin_latitude, o.longitude AS origin_longitude,
 d.airport_name AS dest_name, d.latitude AS dest_latitude, d.longitude AS dest_longitude
FROM labelled JOIN airports o ON origin_airport = o.airport_code JOIN airports d ON dest_airport = d.airport_code
GROUP BY ALL""",
    "mart_delay_analysis": f"WITH {_DELAY_ANALYSIS}",
    "mart_refresh": f"WITH {_DELAY_ANALYSIS}",
    "warehouse_rerun": f"WITH {_DELAY_ANALYSIS}",
    "corrected_flights": f"""WITH {FACTS}, corrected AS ({_CORRECTED.format(rows='facts')})
SELECT flight_surrogate_key AS flight_sk, flight_date, carrier_code, arr_delay_minutes, {DW_CATEGORY} AS delay_category,
 is_cancelled FROM corrected""",
    "corrected_marts": f"""WITH {FLIGHTS}, corrected AS ({_CORRECTED.format(rows='flights')}),
labelled AS (SELECT *, {DW_CATEGORY} AS delay_category FROM corrected)
SELECT origin_airport, dest_airport, carrier_code, count(*) AS total_flights, avg(arr_delay_minutes) AS avg_arr_delay,
 round(count(*) FILTER (delay_category = 'On Time') / CAST(count(*) AS DOUBLE), 4) AS on_time_rate,
 round(count(*) FILTER (delay_category = 'Severe') * 100e0 / CAST(count(*) AS DOUBLE), 4) AS pct_severe_delays,
 origin_airport AS origin_name, 0e0 AS origin_latitude, 0e0 AS origin_longitude,
 dest_airport AS dest_name, 0e0 AS dest_latitude, 0e0 AS dest_longitude
FROM labelled GROUP BY origin_airport, dest_airport, carrier_code""",
    "gold_emptied_day": f"""WITH {FLIGHTS}, marts AS ({_ROUTES.format(period='flight_date, ')})
SELECT * FROM marts WHERE flight_date <> DATE '1997-06-01'""",

    "daily_stats": f"""WITH {LABELLED} SELECT flight_date, count(*) AS total_flights,
 avg(arr_delay_minutes) AS avg_delay_minutes, count(*) FILTER (is_cancelled) AS cancelled_flights,
 count(*) FILTER (delay_category = 'Severe') AS severe_delay_count FROM labelled GROUP BY flight_date""",
    "daily_health": f"""WITH {LABELLED}, volume AS (
 SELECT flight_date, carrier_code, count(*) AS n FROM labelled WHERE flight_date IS NOT NULL GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY flight_date ORDER BY n DESC, carrier_code) AS position FROM volume),
busiest AS (SELECT flight_date, string_agg(carrier_code || ':' || n, ',' ORDER BY position) AS top_carriers
 FROM ranked WHERE position <= 3 GROUP BY flight_date)
SELECT flight_date, count(*) AS total_flights, count(*) FILTER (is_cancelled) AS cancelled_flights,
 count(*) FILTER (delay_category = 'Severe') AS severe_delay_count, avg(arr_delay_minutes) AS avg_delay_minutes,
 any_value(top_carriers) AS top_carriers FROM labelled JOIN busiest USING (flight_date) GROUP BY flight_date""",
    "scorecards": f"WITH {LABELLED} SELECT {_HEADLINES} FROM labelled",
    "daily_trend": f"WITH {LABELLED} SELECT flight_date, {_HEADLINES} FROM labelled GROUP BY flight_date",
    "top_carriers": f"""WITH {FLIGHTS}, volume AS (
 SELECT flight_date, carrier_code, count(*) AS total_flights FROM flights GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY flight_date ORDER BY total_flights DESC, carrier_code) AS INTEGER)
 AS position FROM volume QUALIFY position <= 3""",
    "ranked_routes": f"""WITH {FLIGHTS}, r AS (
 SELECT origin_airport, dest_airport, count(*) AS total_flights, avg(arr_delay_minutes) AS avg_arr_delay
 FROM flights GROUP BY ALL)
SELECT *, rank() OVER (ORDER BY avg_arr_delay DESC NULLS LAST) AS route_rank FROM r""",
    "carrier_ranking": f"""WITH {FLIGHTS}, c AS (
 SELECT carrier_code, count(*) AS total_flights, avg(arr_delay_minutes) AS avg_arr_delay,
  avg(carrier_delay_minutes) AS avg_carrier_delay, avg(weather_delay_minutes) AS avg_weather_delay,
  avg(nas_delay_minutes) AS avg_nas_delay FROM flights GROUP BY ALL)
SELECT *, rank() OVER (ORDER BY avg_arr_delay DESC NULLS LAST) AS carrier_rank FROM c""",
    "worst_routes_month": f"""WITH {FLIGHTS}
SELECT origin_airport, dest_airport, count(*) AS total_flights, avg(arr_delay_minutes) AS avg_arr_delay
FROM flights WHERE flight_date BETWEEN DATE '2000-08-01' AND DATE '2000-08-31'
GROUP BY ALL ORDER BY avg_arr_delay DESC NULLS LAST, origin_airport, dest_airport LIMIT 5""",
    "incremental_load": f"""WITH {FACTS}, held AS (SELECT * FROM facts WHERE flight_date < DATE '2001-06-01'),
loaded AS (
 SELECT * FROM held UNION ALL
 SELECT * FROM facts f WHERE flight_date >= DATE '2001-01-01' AND NOT EXISTS (
  SELECT 1 FROM held h WHERE h.flight_surrogate_key = f.flight_surrogate_key AND h.flight_date = f.flight_date))
SELECT carrier_code, flight_number, flight_date, origin_airport, dest_airport, flight_surrogate_key, delay_category
FROM loaded""",
    "already_loaded": f"""WITH {FLIGHTS}, m AS (
 SELECT CAST(year(flight_date) AS INTEGER) AS year, CAST(month(flight_date) AS INTEGER) AS month,
  count(*) AS source_rows, count(*) FILTER (flight_date < DATE '2001-06-01') AS loaded_rows
 FROM flights GROUP BY ALL)
SELECT *, CASE WHEN loaded_rows > 0 THEN 'already_loaded' ELSE 'to_load' END AS status FROM m""",
    "dq_rules": f"""WITH {FLIGHTS}, c AS ({_RULE_COUNTS})
SELECT *, round(1 - rows_failed / CAST(rows_checked AS DOUBLE), 6) AS pass_ratio FROM c""",
    "dq_broken_rows": f"""WITH {SILVER}, b AS (
 SELECT flight_number, row_hash, {_RULE_NAMES} AS failed_rules FROM silver)
SELECT * FROM b WHERE failed_rules <> ''""",
    "dq_unique_key": f"""WITH {FLIGHTS} SELECT carrier_code, flight_number, flight_date, origin_airport, dest_airport,
 count(*) AS copies FROM flights GROUP BY ALL HAVING count(*) > 1""",
    "dq_rejects": f"""WITH {TYPED} SELECT CAST(date_trunc('month', flight_date) AS DATE) AS flight_month,
 count(*) AS rows_read, count(*) FILTER (faults > 0) AS rows_rejected, CAST(sum(faults) AS BIGINT) AS cells_rejected
FROM typed GROUP BY ALL""",
    "run_log": f"""WITH {TYPED} SELECT '20240615T060000-flights' AS run_id, DATE '2024-06-15' AS run_date,
 TIMESTAMP '2024-06-15 06:00:00' AS run_timestamp, 'flights' AS source,
 count(*) FILTER (faults = 0) AS total_rows_loaded, count(*) FILTER (faults > 0) AS rows_rejected,
 avg(arr_delay_minutes) FILTER (faults = 0) AS avg_delay_minutes, CAST(NULL AS VARCHAR) AS gemini_summary,
 'success' AS pipeline_status, TIMESTAMP '2024-06-15 06:00:00' AS created_at FROM typed""",
}

CHECKS["fact_as_of"] = CHECKS["fact_point_in_time"]
CHECKS["incremental_load_by_filter"] = CHECKS["incremental_load"]
