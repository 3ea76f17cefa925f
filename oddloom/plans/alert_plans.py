"""Scores, de-duplication and alerts P01-P12."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as S
from ..operators import alerts as P
from ..operators import cycle as Y
from ..session import cut_lineage
from ..sources import adapters as src
from .arbitrage_plans import FIRST_LEG_SQL
from .common import COMBOS_SQL, HISTORY_SQL, OPPS_SQL, SEASON_OPPS_SQL, on
from .reconciled import reconciled_sql
from .registry import query, with_ctes


@query("p01_freshness_score", """
SELECT event_id, round(CASE WHEN age <= 15 THEN 1 WHEN age <= 60 THEN 1 - 0.5::DOUBLE * (age - 15) / 45
  ELSE greatest(0, 0.5::DOUBLE - (age - 60) / 120) END, 6) AS score
FROM (SELECT event_id, value / 2 AS age FROM events)""")
def freshness(spark, sf_dir):
    ev = src.table(spark, sf_dir, "events")
    at = F.col("ts").cast("timestamp")
    now = at + F.make_dt_interval(secs=(F.col("value") / 2).cast("decimal(18,6)"))
    return ev.select("event_id", F.round(S.freshness_score(at, now), 6).alias("score"))


KS = "CAST(json_extract(props, '$.k') AS INTEGER)"


@query("p02_confidence_score", f"""
SELECT event_id, round(CASE WHEN k % 10 = 0 THEN 0.85 ELSE (k / 100 + (k * 7 % 100) / 100) / 2 END, 6) AS score
FROM (SELECT event_id, {KS} AS k FROM events)""")
def confidence(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    conf = F.when(k % 10 == 0, F.array().cast("array<double>")).otherwise(F.array(k / 100.0, (k * 7 % 100) / 100.0))
    return src.table(spark, sf_dir, "events").select(
        "event_id", F.round(S.confidence_score(conf), 6).alias("score"))


STABILITY = {"book_3": 0.9, "book_4": 0.7, "1xBet": 1.0}


@query("p03_stability_score", with_ctes(SEASON_OPPS_SQL, """
w AS (SELECT * FROM (VALUES ('book_3', 0.9), ('book_4', 0.7), ('1xBet', 1.0)) t(book, w))""", """
SELECT id, round((coalesce(a.w, 0.85) + coalesce(b.w, 0.85) + CASE WHEN bk3 IS NULL THEN 0 ELSE coalesce(c.w, 0.85) END)
  / n_outcomes, 6) AS score
FROM dated LEFT JOIN w a ON bk1 = a.book LEFT JOIN w b ON bk2 = b.book LEFT JOIN w c ON bk3 = c.book"""))
def stability(spark, sf_dir):
    known = F.create_map(*[F.lit(x) for kv in STABILITY.items() for x in kv])
    books = F.transform("legs", lambda leg: leg["bookmaker"])
    return src.season_opportunities(spark, sf_dir).select(
        "id", F.round(S.stability_score(books, known), 6).alias("score"))


@query("p04_volatility_score", """
SELECT event_id, round(greatest(0, 1 - least(coalesce(stddev_pop(price) OVER w / avg(price) OVER w, 0), 1)), 6) AS score
FROM (SELECT event_id, event_type, user_id, ts, 1.01 + value / 50 AS price FROM events)
WINDOW w AS (PARTITION BY event_type, user_id ORDER BY ts RANGE BETWEEN INTERVAL 2 DAYS PRECEDING AND CURRENT ROW)""")
def volatility(spark, sf_dir):
    v = P.price_volatility(src.ticks(spark, sf_dir), ["bookmaker", "match_id"], 2 * 86400)
    return v.select("event_id", F.round("volatility_score", 6).alias("score"))


@query("p05_plausibility", with_ctes(SEASON_OPPS_SQL, """
SELECT id, CASE WHEN market_type IN ('1x2', 'goals_total') AND roi_pct > 25 THEN 0 WHEN roi_pct > 40 THEN 0.15 ELSE 1 END
  AS plausibility FROM dated"""))
def plausible(spark, sf_dir):
    return src.season_opportunities(spark, sf_dir).select(
        "id", S.plausibility(F.col("market_type"), F.col("roi_pct")).alias("plausibility"))


@query("p06_score_opportunity", with_ctes(SEASON_OPPS_SQL, "SELECT id, score_ia FROM scored"))
def score(spark, sf_dir):
    return src.season_opportunities(spark, sf_dir).select("id", "score_ia")


@query("p07_should_alert", with_ctes(SEASON_OPPS_SQL, """
SELECT id FROM scored WHERE roi_pct >= 3 AND score_ia >= 70 AND 'book_4' IN (bk1, bk2, coalesce(bk3, ''))"""))
def alert(spark, sf_dir):
    return P.should_alert(src.season_opportunities(spark, sf_dir), 3.0, 70, " BOOK_4 ").select("id")


@query("p08_drop_exact_duplicates", with_ctes(HISTORY_SQL, """
SELECT id FROM hist n WHERE copy = 1 AND NOT EXISTS (SELECT 1 FROM hist h WHERE h.copy = 0 AND h.match = n.match
  AND h.n_issues = n.n_issues AND h.event_a = n.event_a AND h.cote_a = n.cote_a AND h.bookmaker_a = n.bookmaker_a
  AND h.event_b = n.event_b AND h.cote_b = n.cote_b AND h.bookmaker_b = n.bookmaker_b
  AND h.event_c IS NOT DISTINCT FROM n.event_c AND h.cote_c IS NOT DISTINCT FROM n.cote_c
  AND h.bookmaker_c IS NOT DISTINCT FROM n.bookmaker_c)
QUALIFY row_number() OVER (PARTITION BY match, n_issues, event_a, cote_a, bookmaker_a, event_b, cote_b, bookmaker_b,
  event_c, cote_c, bookmaker_c ORDER BY date_detection, roi_pct DESC, id) = 1"""))
def duplicates(spark, sf_dir):
    h = src.history(spark, sf_dir)
    return P.drop_exact_duplicates(h.filter("copy = 1"), h.filter("copy = 0")).select("id")


# Matches without history are left by an early year.
FIRST_SQL = """
late AS (SELECT * FROM hist WHERE year(date_detection) >= 1993),
early AS (SELECT * FROM hist WHERE year(date_detection) < 1993)"""


def _split(spark, sf_dir):
    h = src.history(spark, sf_dir)
    return h.filter(F.year("date_detection") >= 1993), h.filter(F.year("date_detection") < 1993)


@query("p09_first_signal_per_match", with_ctes(HISTORY_SQL, FIRST_SQL, """
SELECT id, row_number() OVER (PARTITION BY match, sport ORDER BY date_detection, roi_pct DESC, id) = 1
  AND NOT EXISTS (SELECT 1 FROM early e WHERE e.match = l.match AND e.sport = l.sport) AS alertable FROM late l"""))
def first(spark, sf_dir):
    return P.first_signal_per_match(*_split(spark, sf_dir)).select("id", "alertable")


@query("p10_cycle_counters", with_ctes(HISTORY_SQL, FIRST_SQL, """
kept AS (SELECT * FROM late l QUALIFY row_number() OVER (PARTITION BY match, n_issues, event_a, cote_a, bookmaker_a, event_b,
  cote_b, bookmaker_b, event_c, cote_c, bookmaker_c ORDER BY date_detection, roi_pct DESC, id) = 1),
fresh AS (SELECT * FROM kept n WHERE NOT EXISTS (SELECT 1 FROM early h WHERE h.match = n.match
  AND h.n_issues = n.n_issues AND h.event_a = n.event_a AND h.cote_a = n.cote_a AND h.bookmaker_a = n.bookmaker_a
  AND h.event_b = n.event_b AND h.cote_b = n.cote_b AND h.bookmaker_b = n.bookmaker_b
  AND h.event_c IS NOT DISTINCT FROM n.event_c AND h.cote_c IS NOT DISTINCT FROM n.cote_c
  AND h.bookmaker_c IS NOT DISTINCT FROM n.bookmaker_c)),
flagged AS (SELECT *, row_number() OVER (PARTITION BY match, sport ORDER BY date_detection, roi_pct DESC, id) = 1
  AND NOT EXISTS (SELECT 1 FROM early e WHERE e.match = l.match AND e.sport = l.sport) AS alertable FROM fresh l)""", """
SELECT (SELECT count(*) FROM late) AS detected, (SELECT count(*) FROM late) - count(*) AS duplicates,
  count(*) FILTER (NOT alertable) AS silent,
  count(*) FILTER (alertable AND roi_pct >= 3 AND score_ia >= 70) AS alerted FROM flagged"""))
def counters(spark, sf_dir):
    return P.cycle_counters(*_split(spark, sf_dir))


PARTS_SQL = """
parts AS (SELECT *, concat('https://x.example/?a=1&amp;b=') AS site, [bk1, bk2, bk3] AS bks, [sel1, sel2, sel3] AS sels,
  [odds1, odds2, odds3] AS os, [mise_a, mise_b, mise_c] AS ms FROM scored),
legs AS (SELECT id, string_agg(format('{}. <b>{}</b> @ <code>{}</code> chez <b>{}</b> → miser <code>{:.0f}</code> HTG', i, sels[i],
    os[i], bks[i], ms[i]) || chr(10) || format('   <a href="{}{}">Placer le pari</a>', site, bks[i]), chr(10) ORDER BY i) AS block
  FROM parts CROSS JOIN (VALUES (1), (2), (3)) n(i) WHERE bks[i] IS NOT NULL GROUP BY id)"""

TEXT_SQL = """concat(format('<b>SUREBET {:.2f}%</b> — {}', roi_pct, match), chr(10), '<i>', sport, ' · ', market_type,
  CASE WHEN line IS NOT NULL THEN concat(' · ligne ', line) ELSE '' END, ' · ', n_outcomes, ' issues</i>', chr(10), chr(10),
  format('Marge M : <code>{:.4f}</code>', margin), chr(10),
  format('Bankroll : <code>1000</code> HTG → Profit garanti : <b>{:.0f} HTG</b>', profit), chr(10),
  'Score IA : <code>', score_ia, '/100</code>', chr(10), chr(10), block)"""


@query("p11_alert_text", with_ctes(SEASON_OPPS_SQL, PARTS_SQL, f"SELECT id, {TEXT_SQL} AS text FROM parts JOIN legs USING (id)"))
def text(spark, sf_dir):
    return P.alert_text(src.season_opportunities(spark, sf_dir)).select("id", "text")


@query("p12_safe_after_rounding", with_ctes(SEASON_OPPS_SQL, """
SELECT id FROM dated WHERE least(mise_a * odds1, mise_b * odds2, mise_c * odds3) > 1000"""))
def safe(spark, sf_dir):
    return P.safe_after_rounding(src.season_opportunities(spark, sf_dir)).select("id")


CYCLE_AT, CYCLE_AGE_DAYS = "1996-06-01 00:00:00", 700

CYCLE_SQL = f"""
WITH RECURSIVE {reconciled_sql(f"""SELECT * FROM spelled WHERE start_time > TIMESTAMP '{CYCLE_AT}'
  AND scraped_at >= TIMESTAMP '{CYCLE_AT}' - INTERVAL {CYCLE_AGE_DAYS} DAYS""")}, {COMBOS_SQL}, {OPPS_SQL}, {FIRST_LEG_SQL},
new AS (
  SELECT CAST(concat('0x', substr(sha1(concat_ws('|', c.match_id, c.market_type, coalesce(CAST(c.line AS VARCHAR), ''), coalesce(c.team_scope, ''))), 1, 15))
      AS BIGINT) AS id, concat(f[3], ' - ', f[4]) AS match, f[1] AS sport, n_outcomes AS n_issues,
    bk1, odds1, sel1, bk2, odds2, sel2, bk3, odds3, sel3, c.market_type, c.line, roi_pct,
    CAST(round_even(100 * greatest(0, least(1, (0.30 + 0.35::DOUBLE * 0.85 + 0.20::DOUBLE * 0.85 + 0.15)
      * CASE WHEN c.market_type IN ('1x2', 'goals_total') AND roi_pct > 25 THEN 0 WHEN roi_pct > 40 THEN 0.15 ELSE 1 END)), 0) AS INTEGER) AS score_ia
  FROM opps c JOIN first_leg l ON {on('c', 'l')} AND l.selection = sel1 AND l.bookmaker = bk1 AND l.odds = odds1),
known AS (SELECT * REPLACE (CASE WHEN id % 2 = 0 THEN round(odds1 + 0.05, 2) ELSE odds1 END AS odds1) FROM new WHERE id % 3 = 0),
stored AS (
  SELECT * FROM new n WHERE NOT EXISTS (SELECT 1 FROM known h WHERE h.match = n.match AND h.n_issues = n.n_issues AND h.odds1 = n.odds1
    AND h.odds2 = n.odds2 AND h.odds3 IS NOT DISTINCT FROM n.odds3 AND h.bk1 = n.bk1 AND h.bk2 = n.bk2 AND h.bk3 IS NOT DISTINCT FROM n.bk3
    AND h.sel1 = n.sel1 AND h.market_type = n.market_type AND h.line IS NOT DISTINCT FROM n.line)
  QUALIFY row_number() OVER (PARTITION BY match, n_issues, market_type, line, sel1, bk1, odds1, bk2, odds2, bk3, odds3 ORDER BY roi_pct DESC, id) = 1),
flagged AS (
  SELECT *, row_number() OVER (PARTITION BY match, sport ORDER BY roi_pct DESC, id) = 1
    AND NOT EXISTS (SELECT 1 FROM known k WHERE k.match = s.match AND k.sport = s.sport) AS alertable FROM stored s)
SELECT id, match, sport, n_issues, round(roi_pct, 6) AS roi_pct, score_ia, alertable, alertable AND roi_pct >= 3 AND score_ia >= 70 AS alert
FROM flagged"""


@query("p13_full_cycle", CYCLE_SQL)
def cycle(spark, sf_dir):
    """A cycle whose history holds a third of its detections, half of those at another price."""
    at = F.lit(CYCLE_AT)
    found = cut_lineage(Y.detect(src.spelled_quotes(spark, sf_dir), at, CYCLE_AGE_DAYS * 86400), "detections")
    moved = F.when(F.col("id") % 2 == 0, F.round(F.col("cote_a") + 0.05, 2)).otherwise(F.col("cote_a"))
    known = found.filter(F.col("id") % 3 == 0).withColumn("cote_a", moved)
    return Y.store_and_alert(found, known).select(
        "id", "match", "sport", "n_issues", F.round("roi_pct", 6).alias("roi_pct"), "score_ia", "alertable", "alert")
