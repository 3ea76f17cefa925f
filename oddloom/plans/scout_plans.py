"""Scouting Q01-Q06."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scout as Q
from ..schemas import MARKET_KEYS
from ..sources import adapters as src
from .common import COMBOS_SQL, QUOTES_SQL, SEASON_OPPS_SQL, K, flat_legs, r6
from .registry import query, with_ctes


@query("q01_near_arbitrages", with_ctes(QUOTES_SQL, COMBOS_SQL, f"""
SELECT {K}, bk1, odds1, bk2, odds2, bk3, odds3, round(margin, 6) AS margin
FROM combos WHERE margin >= 0.99 AND margin < 1.02"""))
def near(spark, sf_dir):
    n = Q.near_misses(src.quotes(spark, sf_dir))
    return n.select(*MARKET_KEYS, *flat_legs(n), r6("margin"))


def observations(ticks):
    """Margins over time from price ticks, one tracked key per match and bookmaker."""
    return ticks.select(
        "match_id", F.lit("goals_total").alias("market_type"), F.lit(2.5).alias("line"),
        F.concat_ws(":", F.col("bookmaker"), F.lit("over")).alias("legs_key"), "ts",
        F.round(1 / F.col("price"), 6).alias("margin"))


OBS_SQL = """
obs AS (SELECT CAST(user_id AS VARCHAR) AS match_id, concat(event_type, ':over') AS legs_key, ts,
  round(1 / (1.01 + value / 50), 6) AS margin FROM events)"""
TRAJECTORY_SQL = with_ctes(OBS_SQL, """
recent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY match_id, legs_key ORDER BY ts DESC, margin DESC) AS rn
  FROM obs) WHERE rn <= 10)""", """
SELECT match_id, legs_key, count(*) AS points, arg_min(margin, ts) AS first_margin, arg_max(margin, ts) AS last_margin,
  count(*) >= 2 AND arg_max(margin, ts) < arg_min(margin, ts) AS is_improving
FROM recent GROUP BY 1, 2""")


def trajectory_rows(t):
    return t.select(
        "match_id", "legs_key", F.size("points").cast("bigint").alias("points"),
        F.col("points")[0]["margin"].alias("first_margin"), F.element_at("points", -1)["margin"].alias("last_margin"),
        "is_improving")


@query("q02_margin_trajectory", TRAJECTORY_SQL)
def trajectory(spark, sf_dir):
    return trajectory_rows(Q.margin_trajectory(observations(src.ticks(spark, sf_dir))))


@query("q03_hot_markets", with_ctes(SEASON_OPPS_SQL, """
SELECT market_type, count(*) AS n FROM opps GROUP BY 1 ORDER BY n DESC, market_type LIMIT 3"""))
def markets(spark, sf_dir):
    return Q.hot_markets(src.season_opportunities(spark, sf_dir), 3)


LEGS = "SELECT unnest([bk1, bk2, bk3]) AS bookmaker FROM opps"


@query("q04_hot_bookmakers", with_ctes(SEASON_OPPS_SQL, f"""
SELECT bookmaker, count(*) AS n FROM ({LEGS}) WHERE bookmaker IS NOT NULL GROUP BY 1 ORDER BY n DESC, bookmaker LIMIT 5"""))
def bookmakers(spark, sf_dir):
    return Q.hot_bookmakers(src.season_opportunities(spark, sf_dir))


@query("q05_scrape_priority", with_ctes(SEASON_OPPS_SQL, f"""
SELECT bookmaker, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM ({LEGS}) WHERE bookmaker IS NOT NULL GROUP BY 1"""))
def priority(spark, sf_dir):
    return Q.scrape_priority(src.season_opportunities(spark, sf_dir)).withColumn("share", F.round("share", 6))


@query("q06_template_explanation", with_ctes(SEASON_OPPS_SQL, """
SELECT id, concat(format('Surebet {:.1f}% sur {} ({}).', roi_pct, match, market_type), chr(10),
  format('Profit garanti : {:.0f} HTG pour 1000 HTG mises.', profit), chr(10),
  format('- {} @ {} chez {} : {:.0f} HTG', sel1, odds1, bk1, mise_a), chr(10),
  format('- {} @ {} chez {} : {:.0f} HTG', sel2, odds2, bk2, mise_b), chr(10),
  CASE WHEN bk3 IS NOT NULL THEN concat(format('- {} @ {} chez {} : {:.0f} HTG', sel3, odds3, bk3, mise_c), chr(10)) ELSE '' END,
  'Fè vit, kòt yo ka chanje!') AS explanation FROM dated"""))
def explanation(spark, sf_dir):
    return Q.template_explanation(src.season_opportunities(spark, sf_dir)).select("id", "explanation")
