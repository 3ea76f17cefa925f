"""Entity resolution R01-R08."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import resolve as R
from ..sources import adapters as src
from ..sources.adapters import TEAM_NAME_SQL, stamp, team_name
from .reconciled import LCS, MARK, close_sql, reconciled_sql
from .registry import query

NAMED = f"named AS (SELECT p_partkey, {TEAM_NAME_SQL.format(v='p_partkey % 5', n='p_name')} AS name FROM part)"


def _named(spark, sf_dir):
    p = src.table(spark, sf_dir, "part")
    return p.select("p_partkey", team_name(F.col("p_name"), F.col("p_partkey") % 5).alias("name"))


@query("r01_resolve_alias", """
SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'paris saint-germain' WHEN 1 THEN 'manchester united' WHEN 2 THEN 'Real  Sociedad'
  ELSE p_name END AS resolved FROM part""")
def alias(spark, sf_dir):
    k = F.col("p_partkey") % 7
    raw = F.when(k == 0, " PSG ").when(k == 1, "Man  UTD").when(k == 2, "Real  Sociedad").otherwise(F.col("p_name"))
    return src.table(spark, sf_dir, "part").select("p_partkey", X.resolve_alias(raw).alias("resolved"))


@query("r02_squad_marker", f"WITH {NAMED} SELECT p_partkey, {MARK.format(c='name')} AS marker FROM named")
def marker(spark, sf_dir):
    return _named(spark, sf_dir).select("p_partkey", X.squad_marker(F.col("name")).alias("marker"))


PAIRED = NAMED + f""",
pairs AS (SELECT x.p_partkey, x.name AS na, y.name AS nb, lower(x.name) AS ka, lower(y.name) AS kb,
    {MARK.format(c='x.name')} IS NOT DISTINCT FROM {MARK.format(c='y.name')} AS level
  FROM named x JOIN named y ON y.p_partkey = x.p_partkey + 5),
keyed AS (SELECT *, array_to_string(list_sort(string_split(ka, ' ')), ' ') AS sa, array_to_string(list_sort(string_split(kb, ' ')), ' ') AS sb FROM pairs)"""


def _pairs(spark, sf_dir):
    n = _named(spark, sf_dir)
    y = n.select((F.col("p_partkey") - 5).alias("p_partkey"), F.col("name").alias("name_b"))
    return n.withColumnRenamed("name", "name_a").join(y, "p_partkey")


@query("r03_teams_match", f"""WITH RECURSIVE {PAIRED},
texts AS (SELECT DISTINCT sa AS a, sb AS b FROM keyed), {LCS}
SELECT p_partkey, round(score, 6) AS score, level AND score >= 85 AS matched FROM keyed JOIN ratio ON a = sa AND b = sb""")
def match(spark, sf_dir):
    return R.teams_match(_pairs(spark, sf_dir)).select("p_partkey", F.round("score", 6).alias("score"), "matched")


@query("r04_teams_similar", f"""WITH RECURSIVE {PAIRED},
sets AS (SELECT *, list_sort(list_distinct(list_filter(string_split(ka, ' '), lambda w: list_contains(string_split(kb, ' '), w)))) AS common,
    list_sort(list_distinct(list_filter(string_split(ka, ' '), lambda w: NOT list_contains(string_split(kb, ' '), w)))) AS xa,
    list_sort(list_distinct(list_filter(string_split(kb, ' '), lambda w: NOT list_contains(string_split(ka, ' '), w)))) AS xb FROM keyed),
full_text AS (SELECT *, array_to_string(list_concat(common, xa), ' ') AS fa, array_to_string(list_concat(common, xb), ' ') AS fb,
  length(array_to_string(common, ' ')) AS shared FROM sets),
texts AS (SELECT DISTINCT sa AS a, sb AS b FROM full_text UNION SELECT DISTINCT fa, fb FROM full_text), {LCS},
scored AS (SELECT p_partkey, level, greatest(s.score, CASE WHEN len(common) > 0 AND (len(xa) = 0 OR len(xb) = 0) THEN 100
    WHEN len(common) > 0 THEN greatest(f.score, 200.0::DOUBLE * shared / (shared + length(fa)), 200.0::DOUBLE * shared / (shared + length(fb)))
    ELSE f.score END) AS score
  FROM full_text JOIN ratio s ON s.a = sa AND s.b = sb JOIN ratio f ON f.a = fa AND f.b = fb)
SELECT p_partkey, round(score, 6) AS score, level AND score >= 85 AS similar FROM scored""")
def similar(spark, sf_dir):
    return R.teams_similar(_pairs(spark, sf_dir)).select("p_partkey", F.round("score", 6).alias("score"), "similar")


@query("r05_best_team_match", f"""WITH RECURSIVE {NAMED},
registry AS (SELECT concat('FC ', p_name) AS candidate, min(p_partkey) AS pos FROM part GROUP BY 1),
{close_sql(f"SELECT name AS a, candidate AS b FROM (SELECT DISTINCT name FROM named WHERE {MARK.format(c='name')} IS NULL), registry", False)},
best AS (SELECT a, arg_min(candidate, (-score, pos)) AS candidate, max(score) AS score FROM close JOIN registry ON candidate = b GROUP BY a)
SELECT p_partkey, name, candidate, round(score, 6) AS score FROM named LEFT JOIN best ON a = name""")
def best(spark, sf_dir):
    p = src.table(spark, sf_dir, "part")
    registry = p.groupBy(F.concat(F.lit("FC "), F.col("p_name")).alias("candidate")).agg(F.min("p_partkey").alias("pos"))
    return R.best_team_match(_named(spark, sf_dir), registry).select("p_partkey", "name", "candidate", F.round("score", 6).alias("score"))


@query("r06_reconcile_pool", f"""WITH RECURSIVE {reconciled_sql()}
SELECT match_id, count(*) AS n, count(DISTINCT bookmaker) AS books FROM quotes GROUP BY match_id""")
def reconcile(spark, sf_dir):
    q = R.reconcile_pool(src.spelled_quotes(spark, sf_dir))
    return q.groupBy("match_id").agg(F.count("*").alias("n"), F.count_distinct("bookmaker").alias("books"))


@query("r07_reconciliation_report", f"""WITH RECURSIVE {reconciled_sql()},
books AS (SELECT match_id, count(DISTINCT bookmaker) AS books FROM quotes GROUP BY 1),
counted AS (SELECT count(DISTINCT match_id) AS before FROM spelled)
SELECT before AS match_ids_before, count(*) AS match_ids_after, count(*) FILTER (books >= 2) AS cross_book_matches, before - count(*) AS merged
FROM books, counted GROUP BY before""")
def report(spark, sf_dir):
    q = src.spelled_quotes(spark, sf_dir)
    return R.reconciliation_report(q, R.reconcile_pool(q))


@query("r08_match_lookup", f"""WITH RECURSIVE
homes AS (SELECT DISTINCT p_name AS h FROM part), aways AS (SELECT DISTINCT lower(p_brand) AS w FROM part),
{close_sql("SELECT x.h AS a, concat('fc ', y.h) AS b FROM homes x, homes y UNION SELECT x.w, y.w FROM aways x, aways y")},
found AS (
  SELECT r.h, r.w, min(p_partkey) AS event_id FROM (SELECT DISTINCT p_name AS h, lower(p_brand) AS w FROM part) r
  JOIN close x ON x.a = r.h JOIN close y ON y.a = r.w
  JOIN part e ON x.b = concat('fc ', e.p_name) AND y.b = lower(e.p_brand) GROUP BY 1, 2)
SELECT p.p_partkey AS request_id, event_id, e.p_type AS competition,
  strftime(TIMESTAMP '1996-01-01 00:00:00' + to_minutes(event_id), '%Y-%m-%d %H:%M:%S') AS starts
FROM part p LEFT JOIN found ON h = p.p_name AND w = lower(p.p_brand) LEFT JOIN part e ON e.p_partkey = event_id""")
def lookup(spark, sf_dir):
    p = src.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    events = p.select(
        k.alias("event_id"), k.alias("pos"), F.concat(F.lit("FC "), F.col("p_name")).alias("home_team"),
        F.col("p_brand").alias("away_team"), F.timestamp_seconds(F.lit(820454400) + k * 60).alias("start_time"),
        F.col("p_type").alias("competition"))
    requests = p.select(k.alias("request_id"), F.upper("p_name").alias("home_team"), F.lower("p_brand").alias("away_team"))
    out = R.match_lookup(requests, events)
    return out.select("request_id", "event_id", "competition", stamp(F.col("start_time")).alias("starts"))
