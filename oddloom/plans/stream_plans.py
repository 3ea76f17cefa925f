"""Streaming operators T01-T10, replayed over the landed tables and compared with their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..schemas import MARKET_KEYS
from ..sources import adapters as src
from ..sources.adapters import LOG_SQL, stamp
from ..streaming import live as T
from .common import BRANDED_SQL, COMBOS_SQL, HISTORY_SQL, OPPS_SQL, QUOTES_SQL, K, r6
from .reconciled import reconciled_sql
from .registry import query, with_ctes
from .scout_plans import TRAJECTORY_SQL, observations, trajectory_rows

AGE_DAYS = 20


def _landed(spark, rows, at, bounds):
    """The rows in landings by time: what is before each bound, and the rest."""
    edges = [None, *bounds, None]
    parts = [rows.filter((F.lit(True) if lo is None else F.col(at) >= lo) & (F.lit(True) if hi is None else F.col(at) < hi))
             for lo, hi in zip(edges, edges[1:])]
    return T.landed_stream(parts, scratch_path(spark, "landed"))


def _quote_stream(spark, sf_dir, bounds=("1994-01-01", "1996-01-01", "1998-01-01")):
    """Quotes as they were collected, in several landings."""
    return src.quote_projection(_landed(spark, src.table(src.prepare(spark), sf_dir, "lineitem"), "l_shipdate", bounds))


def _events(spark, sf_dir):
    """Events in three landings."""
    return _landed(spark, src.table(src.prepare(spark), sf_dir, "events"), "ts", ("2024-01-11", "2024-01-20"))


def _paths(spark, name):
    base = scratch_path(spark, name)
    return f"{base}/out", f"{base}/checkpoint"


def _pool(spark, sf_dir):
    out, mark = _paths(spark, "live")
    stream = src.branded(_quote_stream(spark, sf_dir)).withColumn("batch_ts", F.date_trunc("year", "scraped_at"))
    run = T.live_pool(stream, out, mark)
    run.awaitTermination()
    return T.latest(spark, out, run)


BOOK = """CASE bookmaker WHEN 'book_0' THEN '1xBet' WHEN 'book_1' THEN 'MelBet' WHEN 'book_2' THEN 'Line Bet' ELSE bookmaker END"""
LIVE_SQL = BRANDED_SQL + f""",
newest AS (SELECT bookmaker, max(year(scraped_at)) AS y FROM plain_quotes GROUP BY 1),
quotes AS (SELECT p.* REPLACE ({BOOK.replace('bookmaker', 'p.bookmaker')} AS bookmaker) FROM plain_quotes p JOIN newest n
  ON n.bookmaker = p.bookmaker AND n.y = year(p.scraped_at))"""


@query("t01_live_pool", with_ctes(LIVE_SQL, """
SELECT bookmaker, match_id, market_type, selection, line, odds, strftime(scraped_at, '%Y-%m-%d') AS day FROM quotes"""))
def live_pool(spark, sf_dir):
    return _pool(spark, sf_dir).select(
        "bookmaker", "match_id", "market_type", "selection", "line", "odds", F.date_format("scraped_at", "yyyy-MM-dd").alias("day"))


@query("t02_evict_stale", with_ctes(LIVE_SQL, f"""
SELECT bookmaker, match_id, market_type, selection, odds FROM quotes WHERE scraped_at >= TIMESTAMP '2001-11-01' - INTERVAL {AGE_DAYS} DAYS"""))
def evict(spark, sf_dir):
    pool = T.visible(_pool(spark, sf_dir), F.lit("2001-11-01 00:00:00"), AGE_DAYS * 86400)
    return pool.select("bookmaker", "match_id", "market_type", "selection", "odds")


NEWEST_SQL = """SELECT * FROM spelled JOIN (SELECT bookmaker, max(year(scraped_at)) AS y FROM spelled GROUP BY 1) USING (bookmaker)
  WHERE year(scraped_at) = y"""


@query("t02_watermark_eviction", f"""
WITH arrived AS (
  SELECT event_id, event_type, user_id, ts, CASE WHEN event_id % 7 = 0 THEN 3 WHEN ts < TIMESTAMP '2024-01-11' THEN 1
    WHEN ts < TIMESTAMP '2024-01-20' THEN 2 ELSE 3 END AS landing FROM events),
marks AS (SELECT landing, epoch_ms(max(ts)) - {AGE_DAYS // 4} * 86400000 AS seen FROM arrived GROUP BY 1)
SELECT event_id FROM arrived a
WHERE epoch_us(ts) > 1000 * coalesce((SELECT max(seen) FROM marks m WHERE m.landing < a.landing - 1), -1)""")
def watermark(spark, sf_dir):
    """Every seventh event comes with the last landing; those behind the watermark that the batch before it ran with are gone."""
    ev = src.table(src.prepare(spark), sf_dir, "events").withColumn("scraped_at", F.col("ts").cast("timestamp"))
    late, at = F.col("event_id") % 7 == 0, F.col("ts")
    landing = F.when(late, 3).when(at < "2024-01-11", 1).when(at < "2024-01-20", 2).otherwise(3)
    stream = T.landed_stream([ev.filter(landing == i) for i in (1, 2, 3)], scratch_path(spark, "landed"))
    out, mark = _paths(spark, "evicted")
    T.append_files(T.evict_stale(stream, ["event_id"], AGE_DAYS // 4 * 86400), out, mark).awaitTermination()
    return spark.read.parquet(out).select("event_id")


@query("t03_evaluation_loop", f"""
WITH RECURSIVE {reconciled_sql(NEWEST_SQL)}, {COMBOS_SQL}, {OPPS_SQL}
SELECT {K}, round(margin, 6) AS margin, round(roi_pct, 6) AS roi_pct FROM opps""")
def loop(spark, sf_dir):
    out, mark = _paths(spark, "loop")
    stream = src.spelled(_quote_stream(spark, sf_dir, ("1996-01-01",)), src.table(spark, sf_dir, "part")).withColumn("batch_ts", F.date_trunc("year", "scraped_at"))
    run = T.evaluation_loop(stream, out, mark, interval=None)
    run.awaitTermination()
    return T.latest_version(spark, f"{out}/opportunities", run).select(*MARKET_KEYS, r6("margin"), r6("roi_pct"))


@query("t04_independent_cadence", with_ctes(QUOTES_SQL, """
SELECT sport AS source, bookmaker, count(*) AS n FROM quotes GROUP BY 1, 2"""))
def cadence(spark, sf_dir):
    out, mark = _paths(spark, "sources")
    stream = src.quote_projection(T.table_stream(src.prepare(spark), sf_dir, "lineitem"))
    runs = T.independent_cadence(
        {s: (stream.filter(F.col("sport") == s), None) for s in ("football", "basketball")}, out, mark)
    for run in runs.values():
        run.awaitTermination()
    return spark.read.parquet(out).groupBy("source", "bookmaker").agg(F.count("*").alias("n"))


def _log_stream(spark, sf_dir):
    return src.log_projection(_events(spark, sf_dir))


@query("t05_health_state", with_ctes(LOG_SQL, """
last AS (SELECT bookmaker, max(ts) FILTER (ok) AS last_ok, max(ts) FILTER (NOT ok) AS last_fail, count(*) AS cycles,
  sum(n_quotes)::BIGINT AS quotes FROM log GROUP BY 1)""", """
SELECT bookmaker, strftime(last_ok, '%Y-%m-%d %H:%M:%S') AS last_ok, strftime(last_fail, '%Y-%m-%d %H:%M:%S') AS last_fail,
  (SELECT count(*) FROM log g WHERE g.bookmaker = l.bookmaker AND NOT g.ok AND g.ts > l.last_ok) AS streak, cycles, quotes FROM last l"""))
def health(spark, sf_dir):
    out, mark = _paths(spark, "health")
    run = T.health_stream(_log_stream(spark, sf_dir), out, mark)
    run.awaitTermination()
    h = T.latest(spark, out, run)
    return h.withColumn("last_ok", stamp(F.col("last_ok"))).withColumn("last_fail", stamp(F.col("last_fail")))


@query("t06_outage_alert_once", with_ctes(LOG_SQL, """
marked AS (SELECT *, max(CASE WHEN ok THEN ts END) OVER (PARTITION BY bookmaker ORDER BY ts) AS since FROM log),
fails AS (SELECT *, row_number() OVER (PARTITION BY bookmaker ORDER BY ts, event_id) AS rn FROM marked WHERE NOT ok)""", """
SELECT bookmaker, strftime(since, '%Y-%m-%d %H:%M:%S') AS since, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS alert_ts FROM fails
WHERE (since IS NOT NULL AND ts > since + INTERVAL 1 HOUR) OR (since IS NULL AND rn >= 3) GROUP BY bookmaker, fails.since"""))
def outage(spark, sf_dir):
    out, mark = _paths(spark, "outage")
    T.outage_stream(_log_stream(spark, sf_dir), out, mark, 3600).awaitTermination()
    a = spark.read.parquet(f"{out}/alerts")
    return a.select("bookmaker", stamp(F.col("since")).alias("since"), stamp(F.col("alert_ts")).alias("alert_ts"))


@query("t07_trajectory_state", TRAJECTORY_SQL)
def trajectory(spark, sf_dir):
    ticks = _events(spark, sf_dir).select(
        F.col("event_type").alias("bookmaker"), F.col("user_id").cast("string").alias("match_id"),
        F.col("ts").cast("timestamp").alias("ts"), (1.01 + F.col("value") / 50).alias("price"))
    out, mark = _paths(spark, "trajectory")
    run = T.trajectory_stream(observations(ticks), out, mark)
    run.awaitTermination()
    return trajectory_rows(T.latest(spark, out, run))


DUP = "match, n_issues, event_a, cote_a, bookmaker_a, event_b, cote_b, bookmaker_b, event_c, cote_c, bookmaker_c"


@query("t08_stream_dedup", with_ctes(HISTORY_SQL, f"""
kept AS (SELECT * FROM hist QUALIFY row_number() OVER (PARTITION BY {DUP} ORDER BY copy, date_detection, roi_pct DESC, id) = 1),
flagged AS (SELECT *, row_number() OVER (PARTITION BY match, sport ORDER BY copy, date_detection, roi_pct DESC, id) = 1 AS alertable FROM kept)""", """
SELECT match, sport, event_a, cote_a, event_b, cote_b, count(*) AS n, count(*) FILTER (alertable) AS alertable FROM flagged GROUP BY ALL"""))
def dedup(spark, sf_dir):
    landed = scratch_path(spark, "landed")
    rows = src.history(spark, sf_dir)
    for copy in (0, 1):  # two landings of several files, a match in one file of each, the second one after the first
        rows.filter(F.col("copy") == copy).repartition(3, "match").write.mode("append").parquet(landed)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(landed)
    out, mark = _paths(spark, "history")
    T.stream_dedup(stream, out, mark).awaitTermination()
    return spark.read.option("mergeSchema", True).parquet(out).groupBy(
        "match", "sport", "event_a", "cote_a", "event_b", "cote_b").agg(
        F.count("*").alias("n"), F.count_if(F.col("alertable")).alias("alertable"))


@query("t09_running_counters", with_ctes(QUOTES_SQL, """
SELECT market_type, bookmaker, count(*) AS n FROM quotes GROUP BY 1, 2"""))
def counters(spark, sf_dir):
    stream = _quote_stream(spark, sf_dir)
    out, mark = _paths(spark, "counters")
    run = T.running_counters(stream, ["market_type", "bookmaker"], out, mark)
    run.awaitTermination()
    return T.latest_version(spark, out, run)


@query("t10_rolling_windows", """
WITH edge AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events),
spread AS (SELECT event_type, value, time_bucket(INTERVAL 1 HOUR, ts) - to_hours(h) AS begin_at
  FROM events CROSS JOIN (VALUES (0), (1), (2), (3)) v(h))
SELECT strftime(begin_at, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean,
  round(stddev_pop(value), 6) AS deviation
FROM spread, edge WHERE begin_at + INTERVAL 4 HOURS <= date_trunc('milliseconds', mark) GROUP BY 1, 2""")
def windows(spark, sf_dir):
    ev = T.table_stream(src.prepare(spark), sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out, mark = _paths(spark, "windows")
    T.append_files(T.rolling_windows(ev, ["event_type"], "value", "4 hours", "1 hour", "1 hour"), out, mark).awaitTermination()
    w = spark.read.parquet(out)
    return w.select(stamp(F.col("start")).alias("start"), "event_type", "n", F.round("mean", 6).alias("mean"),
                    F.round("deviation", 6).alias("deviation"))


@query("t10_trailing_counts", """
SELECT event_id, count(*) OVER w AS n, round(stddev_pop(value) OVER w, 6) AS deviation FROM events
WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)""")
def trailing(spark, sf_dir):
    from ..operators.running import trailing_window

    ev = src.table(spark, sf_dir, "events")
    t = trailing_window(ev, ["event_type"], "ts", 3600, F.col("value"), {"n": "rows", "deviation": "deviation"})
    return t.select("event_id", "n", F.round("deviation", 6).alias("deviation"))


