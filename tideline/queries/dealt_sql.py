"""The same results in ANSI SQL, for the queries of dealt.py that SQL can express."""

SQL = {}

SQL["p1_found"] = """
WITH ses AS (
  SELECT DISTINCT CAST(session_date AS DATE) AS d, open_at, close_at FROM trading_sessions WHERE open_at < close_at
),
src AS (
  SELECT secid, min(TRY_CAST(availability.intraday_10m_from AS DATE)) AS since FROM moex_universe
  WHERE secid IS NOT NULL AND TRY_CAST(availability.intraday_10m_from AS DATE) IS NOT NULL GROUP BY secid
),
grid AS (
  SELECT secid, unnest(generate_series(open_at, close_at - INTERVAL 1 MICROSECOND, INTERVAL 10 MINUTE)) AS slot
  FROM src JOIN ses ON d >= since
),
read AS (
  SELECT DISTINCT secid, open_at + to_minutes(CAST(10 * floor((epoch_us(timestamp) - epoch_us(open_at)) / 600000000) AS BIGINT)) AS slot
  FROM intraday_readings JOIN ses ON timestamp >= open_at AND timestamp < close_at + INTERVAL 10 MINUTE
  WHERE close > 0 AND isfinite(close)
)
SELECT DISTINCT secid, strftime(slot, '%Y-%m-%d %H:%M:%S') AS slot_start
FROM grid ANTI JOIN read USING (secid, slot)
"""

SQL["p5_found"] = """
WITH ok AS (
  SELECT DISTINCT q.quote_id, r.release_id, r.observation_date, r.known_at
  FROM bank_quotes q JOIN provider_rates r
    ON q.provider = r.provider AND r.known_at <= q.available_at AND r.observation_date <= CAST(q.available_at AS DATE)
)
SELECT DISTINCT quote_id, first_value(release_id) OVER (PARTITION BY quote_id ORDER BY observation_date DESC, known_at DESC, release_id DESC) AS release_id
FROM ok
"""

_DAYS = """
WITH one AS (
  SELECT instrument_id, trade_date, max(regret_bps) AS regret, max(close) AS close FROM outcome_days
  WHERE instrument_id IS NOT NULL AND trade_date IS NOT NULL GROUP BY ALL
),
cal AS (
  SELECT instrument_id, min(trade_date) AS d0, CAST(unnest(generate_series(min(trade_date), max(trade_date), INTERVAL 1 DAY)) AS DATE) AS day FROM one GROUP BY 1
),
dense AS (
  SELECT cal.*, CASE WHEN isnan(regret) THEN NULL ELSE regret END AS regret, CASE WHEN close <> 0 AND NOT isnan(close) THEN close END AS close
  FROM cal LEFT JOIN one ON cal.instrument_id = one.instrument_id AND cal.day = one.trade_date
),
win AS (
  SELECT instrument_id, day, d0,
    coalesce(sum(regret) OVER w7, 0) AS r7, coalesce(sum(regret) OVER w30, 0) AS r30, count(regret) OVER w7 AS rn7, count(regret) OVER w30 AS rn30,
    coalesce(sum(close) OVER w7, 0) AS c7, coalesce(sum(close) OVER w30, 0) AS c30, count(close) OVER w7 AS cn7, count(close) OVER w30 AS cn30
  FROM dense
  WINDOW w7 AS (PARTITION BY instrument_id ORDER BY day ROWS 6 PRECEDING),
w30 AS (PARTITION BY instrument_id ORDER BY day ROWS 29 PRECEDING)
)
"""

SQL["p6_found"] = (
    _DAYS
    + """
SELECT DISTINCT instrument_id, strftime(day, '%Y-%m-%d') AS day, measure FROM (
  SELECT instrument_id, day, d0, 'regret' AS measure FROM win WHERE r30 >= 150 AND r7 >= 0.5 * r30
  UNION ALL
  SELECT instrument_id, day, d0, 'close' FROM win WHERE cn7 > 0 AND c7 / cn7 > 1.03 * (c30 / cn30)
) WHERE day >= d0 + 29
"""
)
SQL["p6_trailing"] = (
    _DAYS
    + """
SELECT instrument_id AS entity, day, day - d0 AS day_no,
  r7 AS regret_bps_sum_7, rn7 AS regret_bps_n_7, r30 AS regret_bps_sum_30, rn30 AS regret_bps_n_30,
  c7 AS close_sum_7, cn7 AS close_n_7, c30 AS close_sum_30, cn30 AS close_n_30,
  r7 / nullif(rn7, 0) AS regret_bps_mean_7, r30 / nullif(rn30, 0) AS regret_bps_mean_30, c7 / nullif(cn7, 0) AS close_mean_7, c30 / nullif(cn30, 0) AS close_mean_30
FROM win
"""
)

SQL["p1_series"] = """
WITH ses AS (
  SELECT DISTINCT CAST(session_date AS DATE) AS d, open_at, close_at FROM trading_sessions WHERE open_at < close_at
),
src AS (
  SELECT secid, min(TRY_CAST(availability.intraday_10m_from AS DATE)) AS since FROM moex_universe
  WHERE secid IS NOT NULL AND TRY_CAST(availability.intraday_10m_from AS DATE) IS NOT NULL GROUP BY secid
),
grid AS (
  SELECT secid, open_at, unnest(generate_series(0, CAST(ceil((epoch_us(close_at) - epoch_us(open_at)) / 600000000) AS BIGINT) - 1)) AS k
  FROM src JOIN ses ON d >= since
),
read AS (
  SELECT secid, open_at, CAST(floor((epoch_us(timestamp) - epoch_us(open_at)) / 600000000) AS BIGINT) AS k,
    min(struct_pack(us := epoch_us(timestamp), v := close)) AS f, max(struct_pack(us := epoch_us(timestamp), v := close)) AS l
  FROM intraday_readings JOIN ses ON timestamp >= open_at AND timestamp < close_at + INTERVAL 10 MINUTE
  WHERE close > 0 AND isfinite(close) GROUP BY 1, 2, 3
),
seen AS (
  SELECT secid, epoch_us(open_at) + k * 600000000 AS slot_us, f,
    last_value(l IGNORE NULLS) OVER (PARTITION BY secid, open_at ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p,
    first_value(f IGNORE NULLS) OVER (PARTITION BY secid, open_at ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n
  FROM grid LEFT JOIN read USING (secid, open_at, k)
),
lined AS (
  SELECT *, CASE WHEN n.us = slot_us THEN n.v WHEN n.us - p.us <= 1800000000 THEN p.v + (n.v - p.v) * ((slot_us - p.us) / (n.us - p.us)) END AS line FROM seen
)
SELECT secid AS source, slot_us, round(coalesce(line, f.v), 6) AS value, CASE WHEN f IS NOT NULL THEN 'observed' WHEN line IS NOT NULL THEN 'filled' ELSE 'missing' END AS mark, p.us AS prev_us, n.us AS next_us FROM lined
"""

SQL["p5_known"] = """
WITH r AS (
  SELECT DISTINCT provider, release_id, observation_date, known_at, policy_rate_pct FROM provider_rates
  WHERE observation_date IS NOT NULL AND known_at IS NOT NULL
),
t AS (
  SELECT q.provider, q.available_at, max(struct_pack(o := r.observation_date, k := r.known_at, i := r.release_id)) AS best
  FROM (SELECT DISTINCT provider, available_at FROM bank_quotes) q JOIN r ON q.provider = r.provider AND r.known_at <= q.available_at AND r.observation_date <= CAST(q.available_at AS DATE) GROUP BY 1, 2
),
v AS (SELECT t.*, max(policy_rate_pct) AS rate FROM t JOIN r ON r.provider = t.provider AND r.release_id = best.i AND r.observation_date = best.o AND r.known_at = best.k GROUP BY ALL)
SELECT q.*, best.i AS known_release_id, CAST(best.o AS VARCHAR) AS known_observation_date, best.k AS known_known_at, rate AS known_policy_rate_pct
FROM bank_quotes q LEFT JOIN v ON q.provider = v.provider AND q.available_at = v.available_at
"""
