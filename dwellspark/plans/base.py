"""Registration of queries and the SQL that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Family:
    """Queries by name, each with its SQL if SQL can express it."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return add


#: Sessions and charges derived from events, as in sources.fleet.
SESSIONS = """
ev AS (
  SELECT event_id, user_id, ts, least(value, 100.0) AS soc, CAST(json_extract(props, '$.k') AS INTEGER) AS k,
         CASE event_type WHEN 'purchase' THEN 'charging' WHEN 'signup' THEN 'moving' ELSE 'inactive' END AS session_type FROM events
), pl AS (
  SELECT *, CAST(CASE session_type WHEN 'charging' THEN 20 + k % 5 WHEN 'moving' THEN 30 ELSE k % 8 END AS INTEGER) AS place_no FROM ev
), co AS (
  SELECT *, 35.0::DOUBLE + 0.01::DOUBLE * place_no + 0.0001::DOUBLE * (event_id % 7) AS lat, 139.0::DOUBLE + 0.012::DOUBLE * place_no + 0.0001::DOUBLE * (event_id % 11) AS lon FROM pl
), nx AS (
  SELECT event_id AS session_id, 'hv_' || lpad(CAST(user_id AS VARCHAR), 5, '0') AS hashvin, ts AS start_time, lead(ts) OVER w AS end_time, session_type,
         CASE session_type WHEN 'charging' THEN 'C_' || (k % 5) WHEN 'moving' THEN 'M_0' ELSE CASE WHEN k >= 95 THEN '-1' ELSE 'I_' || (k % 8) END END AS session_cluster,
         place_no, k, lat AS start_lat, lon AS start_lon, lead(lat) OVER w AS end_lat, lead(lon) OVER w AS end_lon, soc AS start_soc, lead(soc) OVER w AS end_soc
  FROM co WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), sessions AS (
  SELECT *, (epoch_us(end_time) - epoch_us(start_time)) / 1e6 / 60 AS duration_minutes FROM nx WHERE end_time IS NOT NULL
)"""

CHARGES = (
    SESSIONS
    + """, nl AS (
  SELECT *, first_value(CASE WHEN session_type = 'inactive' AND duration_minutes >= 360 AND session_cluster <> '-1' THEN session_id END IGNORE NULLS)
            OVER (PARTITION BY hashvin ORDER BY start_time, session_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_id FROM sessions
), charges AS (
  SELECT c.session_id, c.hashvin, c.start_time AS charge_start_time, c.end_time AS charge_end_time, c.session_cluster AS charge_cluster, c.start_lat AS charge_lat, c.start_lon AS charge_lon,
         c.start_lat AS charging_start_lat, c.start_lon AS charging_start_lon, c.start_soc AS charge_start_soc, c.end_soc AS charge_end_soc, c.duration_minutes AS charge_durations_minutes, c.k,
         s.session_cluster AS next_long_inactive_cluster, s.start_time AS inactive_start_time, s.end_time AS inactive_end_time, s.start_lat AS inactive_lat, s.start_lon AS inactive_lon,
         s.duration_minutes AS inactive_time_minutes
  FROM nl c LEFT JOIN sessions s ON s.session_id = c.next_id WHERE c.session_type = 'charging'
), ordered AS (
  SELECT *, row_number() OVER w - 1 AS session_order, count(*) OVER (PARTITION BY hashvin) AS n,
         lag(next_long_inactive_cluster) OVER w AS prev_cluster, lag(inactive_lat) OVER w AS prev_lat, lag(inactive_lon) OVER w AS prev_lon
  FROM charges WHERE next_long_inactive_cluster IS NOT NULL WINDOW w AS (PARTITION BY hashvin ORDER BY charge_start_time, session_id)
), bounds AS (
  SELECT *, hashvin || '_' || session_order AS session_uid, greatest(CAST(floor(n * 0.7::DOUBLE) AS BIGINT), 1) AS te7,
  greatest(CAST(floor(n * 0.8::DOUBLE) AS BIGINT), 1) AS te8, CAST(floor(n * 0.1::DOUBLE) AS BIGINT) AS tenth FROM ordered
), split AS (
  SELECT *,
    CASE WHEN n <= 2 THEN CASE WHEN session_order = 0 THEN 'train' ELSE 'test' END WHEN session_order < te7 THEN 'train'
         WHEN session_order < least(greatest(te7 + tenth, te7 + 1), n - 1) THEN 'valid' ELSE 'test' END AS split,
    CASE WHEN n <= 2 THEN CASE WHEN session_order = 0 THEN 'train' ELSE 'test' END WHEN session_order < te8 THEN 'train'
         WHEN session_order < least(greatest(te8 + tenth, te8 + 1), n - 1) THEN 'valid' ELSE 'test' END AS split8
  FROM bounds
)"""
)

DATE06 = "(CAST(CAST({0} - INTERVAL 6 HOUR AS DATE) AS TIMESTAMP) + INTERVAL 6 HOUR)"

#: Stays cut at 06:00, then into hour bins: (session_id, hashvin, session_type, session_cluster, s, e, date06), then (.., bin, minutes).
PIECES = (
    SESSIONS
    + f""", days AS (
  SELECT *, unnest(generate_series({DATE06.format("start_time")}, {DATE06.format("end_time")}, INTERVAL 1 DAY)) AS date06 FROM sessions
), pieces AS (
  SELECT session_id, hashvin, session_type, session_cluster, date06, greatest(start_time, date06) AS s, least(end_time, date06 + INTERVAL 1 DAY) AS e
  FROM days WHERE greatest(start_time, date06) < least(end_time, date06 + INTERVAL 1 DAY)
), touched AS (
  SELECT *, unnest(generate_series(0, 23)) AS bin FROM pieces
), bins AS (
  SELECT session_id, hashvin, session_type, session_cluster, date06, s, CAST(bin AS INTEGER) AS bin,
         (epoch_us(least(e, date06 + (bin + 1) * INTERVAL 1 HOUR)) - epoch_us(greatest(s, date06 + bin * INTERVAL 1 HOUR))) / 1e6 / 60 AS minutes
  FROM touched WHERE greatest(s, date06 + bin * INTERVAL 1 HOUR) < least(e, date06 + (bin + 1) * INTERVAL 1 HOUR)
)"""
)
BIN_LABEL = "printf('%02d-%02d', ({0} + 6) % 24, ({0} + 7) % 24)"

#: Minutes are whole microseconds over 60, so ties at the sixth digit are common; a small shift settles them alike everywhere.
MINUTES = "round({0} + 2e-9, 6)"
