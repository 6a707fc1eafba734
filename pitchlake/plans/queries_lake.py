"""Registered lake queries over ``events`` (one landed row per event, landing day = event date)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..sources import lake, landing
from . import silver as sv
from .registry import finalize, register

# Query parameters: a scheduled run for 2024-01-15..2024-01-20 that reads season to date.
YTD_START, YTD_END = "2024-01-15", "2024-01-20"
# Landing window and the "today" the run sees (later days are rejected as future).
LAND_START, LAND_END, LAND_TODAY = dt.date(2023, 12, 29), dt.date(2024, 2, 2), dt.date(2024, 1, 31)


def ytd_scan(spark, d):
    start, end = sv.effective_window(*lake.date_window(YTD_START, YTD_END), year_to_date=True)
    ev = fx.table(spark, d, "events")
    day = F.to_date("ts")
    return finalize(
        ev.where(day.between(F.lit(start), F.lit(end)))
        .groupBy(day.alias("day"))
        .agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("value_sum"), F.count_distinct("user_id").alias("n_users"))
    )


register(
    "ytd_window_scan",
    """SELECT CAST(ts AS DATE) AS day, COUNT(*) AS n_events, ROUND(SUM(value), 10) AS value_sum, COUNT(DISTINCT user_id) AS n_users
FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-20' GROUP BY CAST(ts AS DATE)""",
)(ytd_scan)

_DAYS_SQL = f"""d AS (SELECT CAST(x AS DATE) AS day FROM generate_series(DATE '{LAND_START}', DATE '{LAND_END}', INTERVAL 1 DAY) t(x)),
c AS (SELECT CAST(ts AS DATE) AS day, COUNT(*) AS n_rows FROM events
      WHERE CAST(ts AS DATE) BETWEEN DATE '{LAND_START}' AND DATE '{LAND_END}' GROUP BY CAST(ts AS DATE)),
s AS (SELECT d.day, COALESCE(c.n_rows, 0) AS n_rows, CAST(0 AS BIGINT) AS n_invalid,
        CASE WHEN d.day > DATE '{LAND_TODAY}' THEN 'error' WHEN COALESCE(c.n_rows, 0) > 0 THEN 'ok' ELSE 'no_data' END AS status
      FROM d LEFT JOIN c ON d.day = c.day)"""

register(
    "landing_status_rollup",
    f"""WITH {_DAYS_SQL}
SELECT day, n_rows, n_invalid, status FROM s""",
)(lambda spark, d: landing.day_status(fx.table(spark, d, "events"), "ts", LAND_START, LAND_END, today=LAND_TODAY)
  .select("day", "n_rows", "n_invalid", "status"))

register(
    "landing_rollup_summary",
    f"""WITH {_DAYS_SQL}
SELECT CASE WHEN COUNT(CASE WHEN status = 'error' THEN 1 END) > 0 AND COUNT(CASE WHEN status <> 'error' THEN 1 END) > 0 THEN 'partial'
            WHEN COUNT(CASE WHEN status = 'error' THEN 1 END) > 0 THEN 'error' ELSE 'ok' END AS status,
  COUNT(CASE WHEN status = 'ok' THEN 1 END) AS days_ok, COUNT(CASE WHEN status = 'no_data' THEN 1 END) AS days_no_data,
  COUNT(CASE WHEN status = 'error' THEN 1 END) AS days_error,
  CAST(COALESCE(SUM(CASE WHEN status = 'ok' THEN n_rows END), 0) AS BIGINT) AS total_records
FROM s""",
)(lambda spark, d: landing.rollup(
    landing.day_status(fx.table(spark, d, "events"), "ts", LAND_START, LAND_END, today=LAND_TODAY)))
