"""Pool operators B01-B08."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import arbitrage as A
from ..operators import pool as B
from ..sources import adapters as src
from ..sources.adapters import stamp
from .common import COMBOS_SQL, QUOTES_SQL
from .registry import query, with_ctes

AS_OF = "2000-01-01 00:00:00"
AGE_S = 180 * 86400.0


def as_of(text: str = AS_OF):
    return F.lit(text).cast("timestamp")


@query("b01_fresh_only", with_ctes(QUOTES_SQL, f"""
SELECT bookmaker, count(*) AS n, round(sum(odds), 4) AS sum_odds FROM quotes
WHERE date_diff('second', scraped_at, TIMESTAMP '{AS_OF}') <= {AGE_S} GROUP BY 1"""))
def fresh(spark, sf_dir):
    q = B.fresh_only(src.quotes(spark, sf_dir), as_of(), AGE_S)
    return q.groupBy("bookmaker").agg(F.count("*").alias("n"), F.round(F.sum("odds"), 4).alias("sum_odds"))


@query("b02_prematch_only", with_ctes(QUOTES_SQL, f"""
SELECT sport, count(*) AS n, count(DISTINCT match_id) AS matches FROM quotes
WHERE start_time > TIMESTAMP '{AS_OF}' + INTERVAL 30 MINUTES GROUP BY 1"""))
def prematch(spark, sf_dir):
    q = B.prematch_only(src.quotes(spark, sf_dir), as_of(), 30)
    return q.groupBy("sport").agg(F.count("*").alias("n"), F.count_distinct("match_id").alias("matches"))


@query("b03_latest_contribution", with_ctes(QUOTES_SQL, """
SELECT bookmaker, match_id, market_type, selection, odds, strftime(scraped_at, '%Y-%m-%d %H:%M:%S') AS batch
FROM quotes q WHERE date_trunc('month', scraped_at) =
  (SELECT max(date_trunc('month', scraped_at)) FROM quotes b WHERE b.bookmaker = q.bookmaker)"""))
def latest(spark, sf_dir):
    q = src.quotes(spark, sf_dir).withColumn("batch_ts", F.date_trunc("month", "scraped_at"))
    return B.latest_contribution(q).select(
        "bookmaker", "match_id", "market_type", "selection", "odds", stamp(F.col("scraped_at")).alias("batch")
    )


@query("b04_pool_stats", with_ctes(QUOTES_SQL, f"""
SELECT bookmaker, count(*) AS count,
  count(*) FILTER (date_diff('second', scraped_at, TIMESTAMP '{AS_OF}') <= {AGE_S}) AS fresh_count,
  strftime(max(scraped_at), '%Y-%m-%d %H:%M:%S') AS last_update,
  CAST(date_diff('second', max(scraped_at), TIMESTAMP '{AS_OF}') AS DOUBLE) AS age_s
FROM quotes GROUP BY 1"""))
def stats(spark, sf_dir):
    return B.pool_stats(src.quotes(spark, sf_dir), as_of(), AGE_S).withColumn(
        "last_update", stamp(F.col("last_update")))


@query("b05_pool_union", with_ctes(QUOTES_SQL, """
SELECT bookmaker, origin, count(*) AS n FROM (
  SELECT bookmaker, 'a' AS origin FROM quotes WHERE sport = 'football'
  UNION ALL SELECT bookmaker, NULL FROM quotes WHERE sport = 'basketball')
WHERE bookmaker NOT IN ('book_2', 'book_4') GROUP BY 1, 2"""))
def union(spark, sf_dir):
    q = src.quotes(spark, sf_dir)
    a = q.filter("sport = 'football'").withColumn("origin", F.lit("a"))
    b = q.filter("sport = 'basketball'")
    return B.pool_union([a, b], ["book_2", "book_4"]).groupBy("bookmaker", "origin").agg(F.count("*").alias("n"))


@query("b06_operator_of", with_ctes(QUOTES_SQL, """
SELECT CASE WHEN bookmaker IN ('book_0', 'book_1', 'book_2') THEN 'north-group' ELSE bookmaker END AS operator,
  count(*) AS n FROM quotes GROUP BY 1"""))
def owners(spark, sf_dir):
    q = src.quotes(spark, sf_dir).withColumn("bookmaker", F.concat(F.lit("  "), F.initcap("bookmaker")))
    return B.operator_of(q, src.OWNERS).groupBy("operator").agg(F.count("*").alias("n"))


@query("b07_scan_stats", with_ctes(QUOTES_SQL, COMBOS_SQL, """
SELECT (SELECT count(DISTINCT match_id) FROM quotes) AS matches_analysed,
  (SELECT string_agg(DISTINCT bookmaker, ',' ORDER BY bookmaker) FROM quotes) AS bookmakers,
  (SELECT count(DISTINCT bookmaker) FROM quotes) AS bookmakers_count,
  count(*) FILTER (margin < 1) AS arbitrages, count(*) AS combos FROM combos"""))
def headline(spark, sf_dir):
    q = src.quotes(spark, sf_dir)
    ranked = A.with_margin(A.best_combos(q)).withColumn("is_arbitrage", F.col("margin") < 1.0)
    return B.scan_stats(q, ranked)


@query("b08_reject_report", """
SELECT concat('book_', user_id % 5) AS bookmaker,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'unavailable' ELSE 'OK' END AS status, count(*) AS n
FROM events GROUP BY 1, 2""")
def rejects(spark, sf_dir):
    status = F.when(F.col("event_type") == "error", "error").when(
        F.col("event_type") == "signup", "unavailable").otherwise("OK")
    log = src.table(spark, sf_dir, "events").select(
        F.concat(F.lit("book_"), (F.col("user_id") % 5).cast("string")).alias("bookmaker"), status.alias("status"))
    return B.reject_report(log)

