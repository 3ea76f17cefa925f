"""Boosted bets F01-F11 and their listing H12.

Offers are derived from parts: the match is the part's name against its type.
"old x" and "cold x" are similar names, so their quotes share a pool; no other
two names of the tables are. The checking SQL states that as a name class.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boosts as B
from ..operators import history as H
from ..schemas import QUOTE_COLUMNS
from ..sources import adapters as src
from .common import QUOTES_SQL
from .registry import query, with_ctes


def offers(spark, sf_dir):
    # Dealt out: offers cost their time per text, however few files and row groups hold them.
    p = src.spread(src.table(spark, sf_dir, "part"), "p_partkey")
    k, home, away = F.col("p_partkey") % 6, F.col("p_name"), F.col("p_type")
    text = (
        F.when(k == 0, F.concat(home, F.lit(" gagne & les deux equipes marquent")))
        .when(k == 1, F.concat(home, F.lit(" gagne & obtient 2 buts ou + (source: Opta)")))
        .when(k == 2, F.lit("obtient 1 buts ou + et obtient 2 corners ou +"))
        .when(k == 3, F.concat(away, F.lit(" obtient 2 corners ou +")))
        .when(k == 4, F.lit("chaque equipe obtient 2 corners ou +")).otherwise("truc exotique xyz")
    )
    return p.select(
        F.col("p_partkey").alias("boost_id"), F.concat(home, F.lit(" - "), away).alias("match"), text.alias("description"),
        F.col("p_size").cast("double").alias("boosted_odds"), F.concat(F.lit("/sports/event/"), F.col("p_partkey").cast("string")).alias("event_url"))


def match_quotes(spark, sf_dir):
    """Quotes with the part's name and type as teams."""
    p = src.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("part_id"), "p_name", "p_type")
    q = src.quotes(spark, sf_dir).join(p, F.col("match_id") == F.col("part_id"))
    return (
        q.withColumn("home_team", F.col("p_name")).withColumn("away_team", F.col("p_type"))
        .withColumn("match_id", F.concat_ws("|", "p_name", "p_type"))
        .withColumn("start_time", F.lit("2001-01-01 18:00:00").cast("timestamp")).select(*QUOTE_COLUMNS)
    )


CONDS_SQL = """
conds AS (
  SELECT p_partkey AS boost_id, p_size AS boosted, p_name, p_type, pos,
    CASE WHEN p_partkey % 6 IN (0, 1) AND pos = 0 THEN 'win' WHEN p_partkey % 6 = 0 THEN 'btts' WHEN p_partkey % 6 = 5 THEN 'unknown'
      ELSE 'threshold' END AS kind,
    CASE WHEN p_partkey % 6 IN (0, 1) AND pos = 0 THEN p_name WHEN p_partkey % 6 = 3 THEN p_type END AS team,
    p_partkey % 6 = 4 AS each_team,
    -- a type that is also the first word of the home name is similar to the home team, which is tried first
    CASE WHEN lower(p_type) = split_part(p_name, ' ', 1) THEN 'home' ELSE 'away' END AS side,
    CASE p_partkey % 6 WHEN 1 THEN CASE pos WHEN 1 THEN 'goals' END WHEN 2 THEN CASE pos WHEN 0 THEN 'goals' ELSE 'corners' END
      WHEN 3 THEN 'corners' WHEN 4 THEN 'corners' END AS stat,
    CASE p_partkey % 6 WHEN 1 THEN CASE pos WHEN 1 THEN 1.5 END WHEN 2 THEN CASE pos WHEN 0 THEN 0.5 ELSE 1.5 END
      WHEN 3 THEN 1.5 WHEN 4 THEN 1.5 END AS line,
    CASE p_partkey % 6 WHEN 0 THEN CASE pos WHEN 0 THEN concat(p_name, ' gagne') ELSE 'les deux equipes marquent' END
      WHEN 1 THEN CASE pos WHEN 0 THEN concat(p_name, ' gagne') ELSE 'obtient 2 buts ou +' END
      WHEN 2 THEN CASE pos WHEN 0 THEN 'obtient 1 buts ou +' ELSE 'obtient 2 corners ou +' END
      WHEN 3 THEN concat(p_type, ' obtient 2 corners ou +') WHEN 4 THEN 'chaque equipe obtient 2 corners ou +'
      ELSE 'truc exotique xyz' END AS raw
  FROM part CROSS JOIN (VALUES (0), (1)) v(pos) WHERE pos = 0 OR p_partkey % 6 < 3)"""

POOL_SQL = QUOTES_SQL + """,
mq AS (SELECT q.* EXCLUDE (home_team, away_team, match_id), p_name, p_type, regexp_replace(p_name, '^cold ', 'old ') AS cls,
  concat(p_name, '|', p_type) AS match_id FROM quotes q JOIN part ON p_partkey = CAST(match_id AS BIGINT)),
best AS (SELECT cls, p_type, market_type, selection, line, team_scope, max(odds) AS odds FROM mq GROUP BY ALL),
ref AS (SELECT cls, p_type, arg_min(bookmaker, (ingest_seq, bookmaker)) AS book FROM mq GROUP BY ALL)"""

PRICED_SQL = """
priced AS (
  SELECT c.*, regexp_replace(c.p_name, '^cold ', 'old ') AS cls,
    CASE kind WHEN 'win' THEN w.odds WHEN 'threshold' THEN CASE WHEN each_team THEN h.odds * a.odds WHEN team IS NOT NULL AND side = 'home' THEN h.odds WHEN team IS NOT NULL THEN a.odds ELSE t.odds END END AS fair
  FROM conds c
  LEFT JOIN best w ON w.cls = regexp_replace(c.p_name, '^cold ', 'old ') AND w.p_type = c.p_type AND w.market_type = '1x2' AND w.selection = 'home'
  LEFT JOIN best h ON h.cls = regexp_replace(c.p_name, '^cold ', 'old ') AND h.p_type = c.p_type AND h.market_type = c.stat || '_team'
    AND h.selection = 'over' AND h.team_scope = 'home' AND h.line = c.line
  LEFT JOIN best a ON a.cls = regexp_replace(c.p_name, '^cold ', 'old ') AND a.p_type = c.p_type AND a.market_type = c.stat || '_team'
    AND a.selection = 'over' AND a.team_scope = 'away' AND a.line = c.line
  LEFT JOIN best t ON t.cls = regexp_replace(c.p_name, '^cold ', 'old ') AND t.p_type = c.p_type AND t.market_type = c.stat || '_total'
    AND t.selection = 'over' AND t.line = c.line)"""

COVER_SQL = """
ranked_under AS (SELECT *, row_number() OVER (PARTITION BY cls, p_type, market_type, line, team_scope ORDER BY odds DESC, ingest_seq) AS rn
  FROM mq WHERE selection = 'under' AND bookmaker <> 'book_5'),
covers AS (
  SELECT c.*, u.bookmaker AS cover_book, u.odds AS cover_odds, u.market_type AS cover_market FROM conds c LEFT JOIN ranked_under u
    ON u.rn = 1 AND u.cls = regexp_replace(c.p_name, '^cold ', 'old ') AND u.p_type = c.p_type AND c.kind = 'threshold' AND NOT c.each_team
    AND u.line = c.line AND u.market_type = c.stat || CASE WHEN c.team IS NULL THEN '_total' ELSE '_team' END
    AND u.team_scope IS NOT DISTINCT FROM CASE WHEN c.team IS NOT NULL THEN side END)"""


def _conditions(spark, sf_dir):
    return B.parse_condition(B.parse_boost(offers(spark, sf_dir)))


@query("f01_parse_boost", with_ctes(CONDS_SQL, """
SELECT boost_id, pos, raw AS fragment, p_name AS home_team, p_type AS away_team FROM conds"""))
def parse(spark, sf_dir):
    return B.parse_boost(offers(spark, sf_dir))


@query("f02_parse_condition", with_ctes(CONDS_SQL, """
SELECT boost_id, pos, kind, team, each_team, stat, line, raw, kind = 'unknown' AS unknown FROM conds"""))
def condition(spark, sf_dir):
    return _conditions(spark, sf_dir)


@query("f03_is_parsable", with_ctes(CONDS_SQL, """
SELECT boost_id, bool_and(kind <> 'unknown') AS parsable, count(*) AS n_conditions FROM conds GROUP BY 1"""))
def parsable(spark, sf_dir):
    return B.is_parsable(_conditions(spark, sf_dir))


@query("f04_condition_team", with_ctes(CONDS_SQL, """
SELECT boost_id, pos, CASE WHEN kind = 'win' THEN p_name WHEN boost_id % 6 = 3 THEN p_type END AS named_team FROM conds"""))
def team(spark, sf_dir):
    return B.condition_team(B.parse_boost(offers(spark, sf_dir))).select("boost_id", "pos", "named_team")


DETAIL_SQL = """
detailed AS (
  SELECT p.*, CASE WHEN kind = 'win' THEN 'victoire (1X2)' WHEN kind = 'btts' THEN 'BTTS oui'
      WHEN kind = 'unknown' THEN 'condition non reconnue'
      WHEN fair IS NULL AND each_team THEN concat(stat, ' par equipe absent de 1xBet')
      WHEN fair IS NULL THEN concat(stat, ' (ligne ', line, ') absent de 1xBet')
      ELSE concat(stat, ' >= ', CAST(line + 0.5 AS INTEGER), CASE WHEN each_team THEN ' chaque equipe' ELSE '' END) END AS detail,
    CASE WHEN kind <> 'unknown' AND (kind <> 'threshold' OR fair IS NOT NULL) THEN book END AS bookmaker
  FROM priced p JOIN ref USING (cls, p_type))"""


@query("f05_price_condition", with_ctes(POOL_SQL, CONDS_SQL, PRICED_SQL, DETAIL_SQL, """
SELECT boost_id, pos, round(fair, 6) AS fair_odds, bookmaker, detail FROM detailed"""))
def price(spark, sf_dir):
    p = B.price_condition(_conditions(spark, sf_dir), offers(spark, sf_dir), match_quotes(spark, sf_dir))
    return p.select("boost_id", "pos", F.round("fair_odds", 6).alias("fair_odds"), "bookmaker", "detail")


VALUE_SQL = """
val AS (SELECT boost_id, any_value(boosted) AS boosted, count(*) FILTER (fair IS NULL) AS unpriced_count,
  CASE WHEN count(*) = count(fair) THEN product(fair) END AS fair_odds FROM priced GROUP BY 1)"""


def _valued(spark, sf_dir):
    o = offers(spark, sf_dir)
    return B.value_boost(o, B.price_condition(_conditions(spark, sf_dir), o, match_quotes(spark, sf_dir)))


@query("f06_value_boost", with_ctes(POOL_SQL, CONDS_SQL, PRICED_SQL, VALUE_SQL, """
SELECT boost_id, unpriced_count, unpriced_count = 0 AS complete, round(fair_odds, 6) AS fair_odds,
  round((boosted / fair_odds - 1) * 100, 6) AS edge_pct FROM val"""))
def value(spark, sf_dir):
    return _valued(spark, sf_dir).select(
        "boost_id", "unpriced_count", "complete", F.round("fair_odds", 6).alias("fair_odds"), F.round("edge_pct", 6).alias("edge_pct"))


@query("h12_boost_listing", with_ctes(POOL_SQL, CONDS_SQL, PRICED_SQL, DETAIL_SQL, VALUE_SQL, """
listed AS (SELECT boost_id, boosted, unpriced_count, unpriced_count = 0 AS complete, round_even(fair_odds, 2) AS fair_odds,
  round_even((boosted / fair_odds - 1) * 100, 1) AS edge_pct FROM val)""", """
SELECT boost_id, complete, l.fair_odds, edge_pct, unpriced_count,
  pos, detail AS label, raw, round_even(fair, 2) AS leg_fair_odds, bookmaker
FROM listed l JOIN detailed USING (boost_id)"""))
def listing(spark, sf_dir):
    rows = H.boost_listing(_valued(spark, sf_dir)).select(
        "boost_id", "complete", "fair_odds", "edge_pct", "unpriced_count", F.explode("legs").alias("leg"))
    return rows.select("boost_id", "complete", "fair_odds", "edge_pct", "unpriced_count", "leg.pos", "leg.label", "leg.raw",
                       F.col("leg.fair_odds").alias("leg_fair_odds"), "leg.bookmaker")


@query("f07_complement_quote", with_ctes(POOL_SQL, CONDS_SQL, COVER_SQL, """
SELECT boost_id, pos, cover_book AS bookmaker, cover_odds AS odds, cover_market AS market_type FROM covers"""))
def complement(spark, sf_dir):
    c = B.complement_quote(_conditions(spark, sf_dir), offers(spark, sf_dir), match_quotes(spark, sf_dir), "book_5")
    return c.select("boost_id", "pos", "cover.bookmaker", "cover.odds", "cover.market_type")


@query("f08_named_team_guard", with_ctes(CONDS_SQL, """
SELECT boost_id, pos, boost_id % 3 = 0 AND team IS NOT NULL AND (kind <> 'win' OR greatest(length(split_part(p_name, ' ', 1)),
  length(split_part(p_name, ' ', 2))) > 3) AS ambiguous FROM conds"""))
def guard(spark, sf_dir):
    c = _conditions(spark, sf_dir)
    dropped = c.withColumn("team", F.when(F.col("boost_id") % 3 != 0, F.col("team")))
    return B.named_team_guard(dropped, offers(spark, sf_dir)).select("boost_id", "pos", "ambiguous")


ARB_SQL = """
arb AS (SELECT boost_id, any_value(boosted) AS boosted, count(*) AS n, 1 / any_value(boosted) + sum(1 / cover_odds) AS margin
  FROM covers GROUP BY 1 HAVING count(*) = count(cover_odds) AND any_value(boosted) > 1)"""


@query("f09_find_boost_arbitrage", with_ctes(POOL_SQL, CONDS_SQL, COVER_SQL, ARB_SQL, """
SELECT boost_id, n + 1 AS n_outcomes, round(margin, 6) AS margin, round((1 / margin - 1) * 100, 6) AS roi_pct,
  round(1000 / boosted / margin, 6) AS boost_stake FROM arb WHERE margin < 1 AND (1 / margin - 1) * 100 >= 1"""))
def arbitrage(spark, sf_dir):
    a = B.find_boost_arbitrage(offers(spark, sf_dir), match_quotes(spark, sf_dir), 1000.0, 1.0, "book_5")
    return a.select("boost_id", "n_outcomes", F.round("margin", 6).alias("margin"), F.round("roi_pct", 6).alias("roi_pct"),
                    F.round(F.col("legs")[0]["stake"], 6).alias("boost_stake"))


@query("f10_diagnose_boost", with_ctes(POOL_SQL, CONDS_SQL, COVER_SQL, """
per AS (SELECT boost_id, any_value(boosted) AS boosted, 1 / any_value(boosted) + sum(1 / cover_odds) AS m, count(*) AS n, count(cover_odds) AS c,
  string_agg(CASE WHEN kind = 'win' THEN 'une condition de victoire (son inverse demande 2 paris)'
    WHEN each_team THEN 'un « chaque equipe » (inverse non unitaire)'
    WHEN cover_odds IS NULL THEN concat('pas de cote inverse pour « ', raw, ' »') END, '; ' ORDER BY pos) AS missing FROM covers GROUP BY 1)""", """
SELECT boost_id, CASE WHEN boost_id % 6 = 5 THEN 'libelle non analysable' WHEN boosted <= 1 THEN 'cote absente ou invalide'
  WHEN missing IS NOT NULL THEN missing WHEN m < 1 THEN format('COUVRABLE : marge {:.3f}', m)
  ELSE concat(format('marge {:.3f} (il manque {:.3f}) : ', m, m - 1), 'les couvertures coutent trop cher pour une cote de ', boosted) END AS reason
FROM per"""))
def diagnose(spark, sf_dir):
    return B.diagnose_boost(offers(spark, sf_dir), match_quotes(spark, sf_dir), "book_5")


@query("f11_wanted_stats_by_match", with_ctes(CONDS_SQL, """
SELECT p_name AS home_team, p_type AS away_team, string_agg(DISTINCT stat, ',' ORDER BY stat) AS stats FROM conds
WHERE kind = 'threshold' GROUP BY 1, 2"""))
def wanted(spark, sf_dir):
    return B.wanted_stats_by_match(_conditions(spark, sf_dir), offers(spark, sf_dir))
