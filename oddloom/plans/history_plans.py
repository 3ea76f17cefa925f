"""History and reports H01-H11 and S13."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history as H
from ..sources import adapters as src
from ..sources.adapters import stamp
from .common import HISTORY_SQL, SEASON_OPPS_SQL, label_sql
from .registry import query, with_ctes

AS_OF = "2001-12-01 00:00:00"


def _as_of():
    return F.lit(AS_OF)


WIDE = """id, strftime(date_detection, '%Y-%m-%d %H:%M:%S') AS seen, match, sport, n_issues, bookmaker_a, event_a, cote_a,
  bookmaker_b, event_b, cote_b, bookmaker_c, event_c, cote_c"""
WIDE_COLS = ["match", "sport", "n_issues", "bookmaker_a", "event_a", "cote_a", "bookmaker_b", "event_b", "cote_b",
             "bookmaker_c", "event_c", "cote_c"]


@query("h01_legs_to_wide", with_ctes(HISTORY_SQL, f"""
SELECT {WIDE}, mise_a, mise_b, mise_c, round(marge_m, 6) AS marge_m, round(final_balance, 4) AS final_balance, score_ia, statut
FROM hist WHERE copy = 0"""))
def wide(spark, sf_dir):
    w = H.legs_to_wide(src.season_opportunities(spark, sf_dir), ["id"])
    return w.select(
        (F.col("id") * 2).alias("id"), stamp(F.col("date_detection")).alias("seen"), *WIDE_COLS, "mise_a", "mise_b", "mise_c",
        F.round("marge_m", 6).alias("marge_m"), F.round("final_balance", 4).alias("final_balance"), "score_ia", "statut")


@query("h02_list_recent", with_ctes(HISTORY_SQL, f"SELECT {WIDE} FROM hist ORDER BY date_detection DESC, id DESC LIMIT 50"))
def recent(spark, sf_dir):
    return H.list_recent(src.history(spark, sf_dir)).select("id", stamp(F.col("date_detection")).alias("seen"), *WIDE_COLS)


@query("h03_bankroll_curve", with_ctes(HISTORY_SQL, """
SELECT id, round(sum(profit) OVER (ORDER BY date_detection, id ROWS UNBOUNDED PRECEDING), 2) AS cumulative_profit FROM hist"""))
def curve(spark, sf_dir):
    return H.bankroll_curve(src.history(spark, sf_dir)).select("id", "cumulative_profit")


@query("h04_alert_pass_rate", with_ctes(HISTORY_SQL, """
SELECT round_even(100.0 * count(*) FILTER (score_ia >= 70) / count(*), 1) AS pass_rate FROM hist"""))
def pass_rate(spark, sf_dir):
    return H.alert_pass_rate(src.history(spark, sf_dir))


DISTINCT = """
det AS (SELECT match, event_a, cote_a, event_b, cote_b, cote_c, min(id) AS id, min(date_detection) AS seen_at,
  arg_min(sport, id) AS sport, arg_min(bookmaker_a, id) AS bookmaker_a, arg_min(roi_pct, id) AS roi_pct,
  arg_min(statut, id) AS statut FROM hist GROUP BY 1, 2, 3, 4, 5, 6)"""


@query("h05_distinct_detections", with_ctes(HISTORY_SQL, DISTINCT, """
SELECT id, strftime(seen_at, '%Y-%m-%d %H:%M:%S') AS seen, match, event_a, cote_a, event_b, cote_b, cote_c, sport,
  bookmaker_a, round(roi_pct, 6) AS roi_pct, statut FROM det"""))
def distinct(spark, sf_dir):
    return H.distinct_detections(src.history(spark, sf_dir)).select(
        "id", stamp(F.col("seen")).alias("seen"), *H.DETECTION_KEYS, "sport", "bookmaker_a",
        F.round("roi_pct", 6).alias("roi_pct"), "statut")


@query("h06_apply_verdicts", with_ctes(HISTORY_SQL, DISTINCT, """
SELECT h.id, CASE WHEN d.id % 5 = 0 AND d.statut = 'detected' THEN 'ok' ELSE h.statut END AS statut
FROM hist h JOIN det d ON h.match = d.match AND h.event_a = d.event_a AND h.cote_a = d.cote_a AND h.event_b = d.event_b
  AND h.cote_b = d.cote_b AND h.cote_c IS NOT DISTINCT FROM d.cote_c"""))
def verdicts(spark, sf_dir):
    h = src.history(spark, sf_dir)
    marks = H.distinct_detections(h, only_open=True).filter(F.col("id") % 5 == 0).withColumn("verdict", F.lit("ok"))
    return H.apply_verdicts(h, marks).select("id", "statut")


@query("h07_reliability_report", with_ctes(HISTORY_SQL, DISTINCT, f"""
SELECT *, CASE WHEN right_pct >= 90 THEN 'reliable' WHEN right_pct >= 70 THEN 'review' ELSE 'not ready' END AS band FROM (
SELECT count(*) AS detections, count(*) FILTER (statut <> 'detected') AS reviewed, count(*) FILTER (statut = 'ok') AS ok,
  count(*) FILTER (statut = 'partie') AS late, count(*) FILTER (statut IN ('fausse', 'marche', 'match')) AS errors,
  count(*) FILTER (statut = 'doute') AS doubt, round(avg(roi_pct) FILTER (statut = 'ok'), 6) AS ok_roi,
  round(100.0 * count(*) FILTER (statut IN ('ok', 'partie')) / count(*) FILTER (statut NOT IN ('detected', 'doute')), 6) AS right_pct,
  round(100.0 * count(*) FILTER (statut = 'partie') / count(*) FILTER (statut NOT IN ('detected', 'doute')), 6) AS late_pct,
  round(100.0 * count(*) FILTER (statut IN ('fausse', 'marche', 'match')) / count(*) FILTER (statut NOT IN ('detected', 'doute')), 6)
    AS error_pct
FROM det WHERE sport = 'football' AND seen_at >= TIMESTAMP '{AS_OF}' - INTERVAL 1500 DAYS)"""))
def reliability(spark, sf_dir):
    r = H.reliability_report(src.history(spark, sf_dir), _as_of(), 1500, "football")
    for c in ("ok_roi", "right_pct", "late_pct", "error_pct"):
        r = r.withColumn(c, F.round(c, 6))
    return r


@query("h08_repetition_report", with_ctes(HISTORY_SQL, f"""
SELECT match, event_a, event_b, bookmaker_a, bookmaker_b, min(sport) AS sport, count(*) AS alerts,
  count(DISTINCT concat(cote_a, '/', cote_b)) AS price_sets, strftime(min(date_detection), '%Y-%m-%d %H:%M:%S') AS first,
  strftime(max(date_detection), '%Y-%m-%d %H:%M:%S') AS last,
  string_agg(DISTINCT concat(cote_a, '/', cote_b), ',' ORDER BY concat(cote_a, '/', cote_b)) AS prices,
  CASE WHEN count(DISTINCT concat(cote_a, '/', cote_b)) = 1 THEN 'dedup failure' ELSE 'price drift' END AS diagnosis
FROM hist WHERE date_detection >= TIMESTAMP '{AS_OF}' - INTERVAL 36000 HOURS GROUP BY 1, 2, 3, 4, 5 HAVING count(*) > 1"""))
def repetitions(spark, sf_dir):
    r = H.repetition_report(src.history(spark, sf_dir), _as_of(), 36000)
    return r.withColumn("first", stamp(F.col("first"))).withColumn("last", stamp(F.col("last")))


BOOKS = """
rows AS (SELECT id, roi_pct, list_distinct([bookmaker_a, bookmaker_b, bookmaker_c]) AS books FROM hist {where}),
per AS (SELECT id, roi_pct, unnest(books) AS bookmaker, len(books) AS n FROM rows)"""


@query("h09_bookmaker_value", with_ctes(HISTORY_SQL, BOOKS.format(
    where=f"WHERE date_detection >= TIMESTAMP '{AS_OF}' - INTERVAL 1500 DAYS"), """
SELECT bookmaker, count(*) AS present, round(100.0 * count(*) / (SELECT count(*) FROM rows), 6) AS present_pct,
  count(*) FILTER (n <= 2) AS indispensable,
  round(100.0 * count(*) FILTER (n <= 2) / (SELECT count(*) FROM rows), 6) AS indispensable_pct,
  round(count(*) FILTER (n <= 2) / 1500, 6) AS loss_per_day FROM per GROUP BY 1"""))
def value(spark, sf_dir):
    v = H.bookmaker_value(src.history(spark, sf_dir), _as_of(), 1500)
    for c in ("present_pct", "indispensable_pct", "loss_per_day"):
        v = v.withColumn(c, F.round(c, 6))
    return v


@query("h10_upper_median_roi", with_ctes(HISTORY_SQL, BOOKS.format(where=""), """
SELECT bookmaker, round(list_sort(list(roi_pct))[count(*) // 2 + 1], 6) AS median_roi FROM per GROUP BY 1"""))
def median_roi(spark, sf_dir):
    return H.upper_median_roi(src.history(spark, sf_dir)).withColumn("median_roi", F.round("median_roi", 6))


REPORT_SQL = f"""
SELECT strftime(seen_at, '%Y-%m-%d %H:%M') AS bet_date, strftime(match_date, '%Y-%m-%d %H:%M') AS match_date,
  1000.0::DOUBLE AS init_balance, round_even(1000 + profit, 2) AS final_balance, round_even(roi_pct, 2) AS pct, round_even(profit, 2) AS profit,
  sport, match, bk1 AS book_a, {label_sql(1)} AS event_a, odds1 AS odds_a, round_even(mise_a, 2) AS mise_a,
  bk2 AS book_b, {label_sql(2)} AS event_b, odds2 AS odds_b, round_even(mise_b, 2) AS mise_b,
  coalesce(bk3, '') AS book_c, coalesce({label_sql(3)}, '') AS event_c, coalesce(CAST(odds3 AS VARCHAR), '') AS odds_c,
  coalesce(CAST(mise_c AS VARCHAR), '') AS mise_c
FROM scored"""
REPORT_NAMES = ["bet_date", "match_date", "init_balance", "final_balance", "pct", "profit", "sport", "match",
                *[f"{c}_{leg}" for leg in "abc" for c in ("book", "event", "odds", "mise")]]


@query("h11_report_columns", with_ctes(SEASON_OPPS_SQL, REPORT_SQL))
def report(spark, sf_dir):
    return H.report_columns(src.season_opportunities(spark, sf_dir)).toDF(*REPORT_NAMES)
