"""Membership metrics M01-M11."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import membership as M
from ..sources import adapters as src
from ..sources.adapters import BETS_SQL, MESSAGES_SQL, PAYMENTS_SQL, PROFILES_SQL, SIGNALS_SQL, stamp
from .registry import query, with_ctes

AS_OF = "2001-06-01 00:00:00"
BET_DAYS = 400


def _as_of():
    return F.lit(AS_OF)


def half_up(n: str) -> str:
    """Mean of whole-number returns, halves away from zero, in integers."""
    return f"((2 * CAST(sum(roi) * 100 AS BIGINT) + {n}) // nullif(2 * {n}, 0)) / 100"


@query("m01_weekly_production", with_ctes(SIGNALS_SQL, f"""
SELECT strftime(date_trunc('week', created_at), '%Y-%m-%d') AS week, count(*) AS signals, {half_up('count(*)')} AS avg_roi,
  CAST(max(roi) AS DOUBLE) AS max_roi, count(DISTINCT author_id) AS publishers FROM signals GROUP BY 1"""))
def weekly(spark, sf_dir):
    w = M.weekly_production(src.signals(spark, sf_dir))
    return w.withColumn("week", F.col("week").cast("string")).withColumn("avg_roi", F.col("avg_roi").cast("double")).withColumn(
        "max_roi", F.col("max_roi").cast("double"))


VALUE_SQL = f"""
val AS (
  SELECT p.id, p.username, coalesce(p.reviewed_at, p.created_at) AS begin_at, count(s.id) AS received,
    coalesce({half_up('count(s.id)')}, 0) AS avg_roi
  FROM payments p LEFT JOIN signals s ON s.created_at >= coalesce(p.reviewed_at, p.created_at)
    AND s.created_at < coalesce(p.reviewed_at, p.created_at) + INTERVAL 7 DAYS
  WHERE p.status = 'approved' GROUP BY 1, 2, 3)"""


@query("m02_value_per_subscription", with_ctes(SIGNALS_SQL, PAYMENTS_SQL, VALUE_SQL, """
SELECT id, username, strftime(begin_at, '%Y-%m-%d') AS start, received, avg_roi,
  CASE WHEN received = 0 THEN 'no signal' WHEN received < 4 THEN 'too few' ELSE 'ok' END AS verdict FROM val"""))
def value(spark, sf_dir):
    v = M.value_per_subscription(src.payments(spark, sf_dir), src.signals(spark, sf_dir), 7)
    return v.withColumn("start", F.col("start").cast("string"))


RENEW = """SELECT count(*) AS clients, count(*) FILTER (n = 1) AS once, count(*) FILTER (n >= 2) AS renewed,
  round(100.0 * count(*) FILTER (n >= 2) / count(*), 1) AS renewal_pct, round(avg(n), 2) AS avg_payments
FROM (SELECT user_id, count(*) AS n FROM payments WHERE status = 'approved' GROUP BY 1)"""


@query("m03_renewal_rate", with_ctes(PAYMENTS_SQL, RENEW))
def renewal(spark, sf_dir):
    return M.renewal_rate(src.payments(spark, sf_dir))


@query("m04_kpi_summary", with_ctes(SIGNALS_SQL, PAYMENTS_SQL, PROFILES_SQL, VALUE_SQL, f"""
SELECT count(*) FILTER (created_at >= t - INTERVAL 7 DAYS) AS signals_7d,
  count(*) FILTER (created_at >= t - INTERVAL 14 DAYS AND created_at < t - INTERVAL 7 DAYS) AS signals_prev_7d,
  round(coalesce(avg(roi) FILTER (created_at >= t - INTERVAL 7 DAYS), 0), 2) AS avg_roi_7d,
  (SELECT count(*) FROM profiles WHERE sub_expires_at > TIMESTAMP '{AS_OF}') AS active_subscribers,
  (SELECT round(avg(received), 1) FROM val) AS signals_per_subscription,
  (SELECT renewal_pct FROM ({RENEW})) AS renewal_pct
FROM signals, (SELECT TIMESTAMP '{AS_OF}' AS t)"""))
def kpi(spark, sf_dir):
    k = M.kpi_summary(src.signals(spark, sf_dir), src.profiles(spark, sf_dir), src.payments(spark, sf_dir), _as_of())
    return k.withColumn("avg_roi_7d", F.col("avg_roi_7d").cast("double"))


LAST = f"""SELECT strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS published_at,
  count(*) FILTER (created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAYS) AS signals_7d,
  round(date_diff('second', max(created_at), TIMESTAMP '{AS_OF}') / 3600, 1) AS hours_since FROM signals"""


@query("m05_last_publication", with_ctes(SIGNALS_SQL, LAST))
def last(spark, sf_dir):
    return M.last_publication(src.signals(spark, sf_dir), _as_of()).withColumn("published_at", stamp(F.col("published_at")))


@query("m06_teaser", with_ctes(SIGNALS_SQL, f"""
SELECT count(*) AS active_count, CAST(coalesce(max(roi), 0) AS DOUBLE) AS best_roi
FROM signals WHERE expires_at > TIMESTAMP '{AS_OF}'"""))
def teaser(spark, sf_dir):
    return M.teaser(src.signals(spark, sf_dir), _as_of()).withColumn("best_roi", F.col("best_roi").cast("double"))


WON_SQL = f"""
won AS (SELECT username, sum(CAST(profit AS DECIMAL(38,6))) AS p, count(*) AS n FROM bets JOIN profiles ON profiles.id = bets.user_id
  WHERE bets.status = 'won' AND bets.created_at >= TIMESTAMP '{AS_OF}' - INTERVAL {BET_DAYS} DAYS AND username IS NOT NULL
  GROUP BY 1)"""


def _bets(spark, sf_dir):
    return src.bets(spark, sf_dir), src.profiles(spark, sf_dir), _as_of()


@query("m07_leaderboard_amounts", with_ctes(BETS_SQL, PROFILES_SQL, WON_SQL, """
SELECT username, CAST(round(p, 2) AS DOUBLE) AS profit, n AS bets FROM won WHERE p > 0 ORDER BY p DESC, username LIMIT 20"""))
def amounts(spark, sf_dir):
    b = M.leaderboard_amounts(*_bets(spark, sf_dir), days=BET_DAYS)
    return b.withColumn("profit", F.col("profit").cast("double"))


@query("m07_leaderboard_admin", with_ctes(BETS_SQL, PROFILES_SQL, WON_SQL, """
SELECT username, CAST(round(p, 2) AS DOUBLE) AS profit, n AS bets FROM won ORDER BY p DESC, username LIMIT 50"""))
def admin(spark, sf_dir):
    b = M.leaderboard_amounts(*_bets(spark, sf_dir), limit=50, only_positive=False, days=BET_DAYS)
    return b.withColumn("profit", F.col("profit").cast("double"))


@query("m08_leaderboard_tiers", with_ctes(BETS_SQL, PROFILES_SQL, WON_SQL, """
SELECT username, row_number() OVER (ORDER BY p DESC, username) AS rank, CASE WHEN p >= 20000 THEN 'excellent'
  WHEN p >= 5000 THEN 'tres bon' WHEN p >= 1000 THEN 'bon' ELSE 'positif' END AS tier
FROM won WHERE p > 0 ORDER BY rank LIMIT 20"""))
def tiers(spark, sf_dir):
    return M.leaderboard_tiers(*_bets(spark, sf_dir), days=BET_DAYS)


@query("m09_passive_accounts", with_ctes(BETS_SQL, PROFILES_SQL, MESSAGES_SQL, f"""
SELECT id, username, email, CAST(date_diff('second', created_at, TIMESTAMP '{AS_OF}') // 86400 AS INTEGER) AS days_since_signup,
  sub_expires_at > TIMESTAMP '{AS_OF}' AS subscribed, (SELECT count(*) FROM bets b WHERE b.user_id = p.id) AS bets,
  (SELECT count(*) FROM events e WHERE e.user_id = p.id) AS movements,
  (SELECT count(*) FROM messages m WHERE m.user_id = p.id) AS messages
FROM (SELECT * FROM profiles UNION ALL SELECT * REPLACE (id + 1000000000 AS id) FROM profiles) p
WHERE role = 'user' AND sub_expires_at IS NOT NULL AND created_at < TIMESTAMP '{AS_OF}' - INTERVAL 7 DAYS
  AND NOT EXISTS (SELECT 1 FROM bets b WHERE b.user_id = p.id)"""))
def passive(spark, sf_dir):
    members = src.profiles(spark, sf_dir)
    # every member again under an id that never placed a bet
    members = members.unionByName(members.withColumn("id", F.col("id") + 1_000_000_000))
    p = M.passive_accounts(
        members, src.bets(spark, sf_dir), src.table(spark, sf_dir, "events"), src.messages(spark, sf_dir), _as_of())
    return p.drop("created_at")


@query("m10_publication_health", with_ctes(SIGNALS_SQL, f"""
SELECT CASE WHEN hours_since > 48 OR signals_7d < 4 THEN 'alert' ELSE 'ok' END AS status,
  CASE WHEN hours_since > 48 THEN 'last publication too old' WHEN signals_7d < 4 THEN 'too few signals' ELSE 'publishing' END
  AS detail FROM ({LAST})"""))
def health(spark, sf_dir):
    return M.publication_health(src.signals(spark, sf_dir), _as_of())


@query("m11_setting_lookup", "SELECT CAST(max(p_size) AS INTEGER) AS value FROM part WHERE p_partkey = 7")
def setting(spark, sf_dir):
    settings = src.table(spark, sf_dir, "part").select(
        F.concat(F.lit("key_"), F.col("p_partkey").cast("string")).alias("key"), F.col("p_size").cast("string").alias("value"))
    return M.setting_lookup(settings, "key_7", "2", "int")
