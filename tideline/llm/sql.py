"""The same results in ANSI SQL, for the queries that SQL can express."""

_ONE = """
WITH one AS (
  SELECT DISTINCT ON (score_id) * FROM score_frame WHERE score IS NOT NULL AND NOT isnan(score) ORDER BY score_id, computed_at DESC NULLS LAST
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY variant, corridor, horizon ORDER BY score DESC, timestamp, score_id) AS rank FROM one
)
"""
SQL = {
    "p4_found": _ONE + "SELECT score_id FROM placed WHERE rank <= 5",
    "p4_top": _ONE + "SELECT score_id, timestamp, variant, corridor, horizon, score, regret_bps, target, computed_at, rank FROM placed WHERE rank <= 5",
}
