"""Sinks O01-O06, written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.alerts import first_signal_per_match
from ..session import scratch_path
from ..sinks import tables as O
from ..sources import adapters as src
from .alert_plans import PARTS_SQL, TEXT_SQL
from .common import HISTORY_SQL, QUOTES_SQL, SEASON_OPPS_SQL
from .history_plans import REPORT_NAMES, REPORT_SQL
from .registry import query, with_ctes


@query("o01_append_history", with_ctes(HISTORY_SQL, """
SELECT sport, strftime(date_detection, '%Y-%m-%d') AS date, count(*) AS n, round(sum(profit), 4) AS profit FROM hist GROUP BY 1, 2"""))
def history(spark, sf_dir):
    path = scratch_path(spark, "history")
    rows = src.history(spark, sf_dir)
    O.append_history(rows.filter("copy = 0"), path)
    O.append_history(rows.filter("copy = 1"), path)
    return spark.read.parquet(path).groupBy("sport", F.col("date").cast("string").alias("date")).agg(
        F.count("*").alias("n"), F.round(F.sum("profit"), 4).alias("profit"))


@query("o02_cache_insert_if_absent", """
WITH cache AS (SELECT DISTINCT lower(p_name) AS cache_key, 'old' AS market_type FROM part WHERE p_size % 3 = 0 AND p_name LIKE '%o%'),
new AS (SELECT lower(p_name) AS cache_key, min(p_brand) AS market_type FROM part GROUP BY 1)
SELECT * FROM cache UNION ALL SELECT * FROM new WHERE cache_key NOT IN (SELECT cache_key FROM cache)""")
def cache(spark, sf_dir):
    p = src.table(spark, sf_dir, "part").withColumn("cache_key", F.lower("p_name"))
    old = p.filter((F.col("p_size") % 3 == 0) & F.col("p_name").contains("o")).select(
        "cache_key", F.lit("old").alias("market_type")).distinct()
    return O.cache_insert_if_absent(old, p.select("cache_key", F.col("p_brand").alias("market_type")))


@query("o03_dated_snapshot", """
SELECT 'part' AS name, (SELECT count(*) FROM part) AS rows, 'saved' AS status UNION ALL
SELECT 'customer', (SELECT count(*) FROM customer), 'saved' UNION ALL SELECT 'orders', (SELECT count(*) FROM orders), 'saved'
UNION ALL SELECT 'sponsors', NULL, 'missing'""")
def snapshot(spark, sf_dir):
    tables = {n: src.table(spark, sf_dir, n) for n in ("part", "customer", "orders")}
    return O.dated_snapshot({**tables, "sponsors": None}, scratch_path(spark, "snapshot"), "2001-12-01").select("name", "rows", "status")


@query("o03_snapshots_to_drop", """
SELECT day FROM (SELECT DISTINCT strftime(date_trunc('year', l_shipdate), '%Y-%m-%d') AS day FROM lineitem) ORDER BY day DESC OFFSET 3""")
def retention(spark, sf_dir):
    days = src.table(spark, sf_dir, "lineitem").select(F.date_format(F.date_trunc("year", "l_shipdate"), "yyyy-MM-dd").alias("day"))
    return O.snapshots_to_drop(days, 3)


@query("o04_report_file", with_ctes(SEASON_OPPS_SQL, REPORT_SQL))
def report(spark, sf_dir):
    path = scratch_path(spark, "report")
    O.report_file(src.season_opportunities(spark, sf_dir), path)
    back = spark.read.option("header", True).csv(path).toDF(*REPORT_NAMES)
    numbers = {"init_balance", "final_balance", "pct", "profit", "odds_a", "mise_a", "odds_b", "mise_b"}
    return back.select(*[F.col(c).cast("double") if c in numbers else F.coalesce(c, F.lit("")).alias(c) for c in REPORT_NAMES])


@query("o05_json_rows", with_ctes(QUOTES_SQL, """
SELECT concat('{"bookmaker":"', bookmaker, '","match_id":"', match_id, '","n_outcomes":', n_outcomes, ',"selection":"', selection, '"',
  CASE WHEN team_scope IS NOT NULL THEN concat(',"team_scope":"', team_scope, '"') ELSE '' END, '}') AS json FROM quotes"""))
def documents(spark, sf_dir):
    return O.json_rows(src.quotes(spark, sf_dir).select("bookmaker", "match_id", "n_outcomes", "selection", "team_scope"))


@query("o06_alert_table", with_ctes(SEASON_OPPS_SQL, PARTS_SQL, """
flagged AS (SELECT *, row_number() OVER (PARTITION BY match, sport ORDER BY seen_at, roi_pct DESC, id) = 1 AS alertable FROM scored)""", f"""
SELECT id, match, {TEXT_SQL} AS text FROM parts JOIN legs USING (id)
WHERE id IN (SELECT id FROM flagged WHERE alertable AND roi_pct >= 3 AND score_ia >= 70)"""))
def alerts(spark, sf_dir):
    opp = src.season_opportunities(spark, sf_dir)
    rows = opp.withColumn("match", F.col("match_label")).withColumn("date_detection", F.col("detected_at"))
    none = rows.limit(0)
    path = scratch_path(spark, "alerts")
    O.alert_table(first_signal_per_match(rows, none), path)
    return spark.read.parquet(path).select("id", "match", "text")
