"""Arbitrage core A01-A19."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import odds as O
from ..operators import arbitrage as A
from ..schemas import MARKET_KEYS
from ..sources import adapters as src
from ..sources.adapters import stamp
from .common import COMBOS_SQL, OPPS_SQL, QUOTES_SQL, K, flat_legs, label_sql, on, r6
from .reconciled import reconciled_sql
from .registry import query, with_ctes

AS_OF, SPELLED_AS_OF = "2000-01-01 00:00:00", "1996-06-01 00:00:00"


def _owned(spark, sf_dir):
    return src.branded(src.quotes(spark, sf_dir))


BRANDS = "CASE {c} WHEN 'book_0' THEN '1xBet' WHEN 'book_1' THEN 'MelBet' WHEN 'book_2' THEN 'Line Bet' ELSE {c} END"


def brand(col: str) -> str:
    return BRANDS.format(c=col)


@query("a01_market_groups", with_ctes(QUOTES_SQL, f"SELECT {K}, count(*) AS n_quotes FROM quotes GROUP BY {K}"))
def groups(spark, sf_dir):
    return A.market_groups(src.quotes(spark, sf_dir))


@query("a02_two_way_pairs", with_ctes(QUOTES_SQL, f"""
SELECT a.match_id, a.market_type, a.line, a.team_scope, count(*) AS n_combinations
FROM quotes a JOIN quotes b ON {on('a', 'b')} AND a.bookmaker <> b.bookmaker
WHERE a.selection IN ('over', 'home') AND b.selection IN ('under', 'away') GROUP BY 1, 2, 3, 4"""))
def pairs(spark, sf_dir):
    return A.two_way_pair_summary(src.quotes(spark, sf_dir)).withColumn(
        "n_combinations", F.col("n_combinations").cast("bigint"))


@query("a03_three_way_triplets", with_ctes(QUOTES_SQL, f"""
SELECT h.match_id, h.market_type, h.line, h.team_scope, count(*) AS n_combinations
FROM quotes h JOIN quotes d ON {on('h', 'd')} JOIN quotes a ON {on('h', 'a')}
WHERE h.selection = 'home' AND d.selection = 'draw' AND a.selection = 'away'
  AND NOT (h.bookmaker = d.bookmaker AND d.bookmaker = a.bookmaker) GROUP BY 1, 2, 3, 4"""))
def triplets(spark, sf_dir):
    return A.three_way_triplet_summary(src.quotes(spark, sf_dir)).withColumn(
        "n_combinations", F.col("n_combinations").cast("bigint"))


@query("a04_best_two_way", with_ctes(QUOTES_SQL, COMBOS_SQL, f"""
SELECT {K}, bk1 AS book_a, sel1 AS sel_a, odds1 AS odds_a, bk2 AS book_b, sel2 AS sel_b, odds2 AS odds_b
FROM combos WHERE n_outcomes = 2"""))
def two_way(spark, sf_dir):
    c = A.best_two_way(src.quotes(spark, sf_dir))
    return c.select(*MARKET_KEYS, *[
        F.col(f"leg_{s}.{f}").alias(f"{n}_{s}") for s in "ab"
        for f, n in (("bookmaker", "book"), ("selection", "sel"), ("odds", "odds"))])


@query("a05_best_three_way", with_ctes(QUOTES_SQL, COMBOS_SQL, f"""
SELECT {K}, bk1 AS book_h, odds1 AS odds_h, bk2 AS book_d, odds2 AS odds_d, bk3 AS book_a, odds3 AS odds_a
FROM combos WHERE n_outcomes = 3"""))
def three_way(spark, sf_dir):
    c = A.best_three_way(src.quotes(spark, sf_dir))
    return c.select(*MARKET_KEYS, *[
        F.col(f"leg_{s}.{f}").alias(f"{n}_{s}") for s in "hda"
        for f, n in (("bookmaker", "book"), ("odds", "odds"))])


@query("a06_best_per_outcome", with_ctes(QUOTES_SQL, f"""
SELECT {K}, selection, bookmaker, odds FROM (
  SELECT *, row_number() OVER (PARTITION BY {K}, selection ORDER BY odds DESC, ingest_seq, bookmaker) AS rn
  FROM quotes) WHERE rn = 1"""))
def per_outcome(spark, sf_dir):
    return A.best_per_outcome(src.quotes(spark, sf_dir))


MARGINS = with_ctes(QUOTES_SQL, COMBOS_SQL, f"SELECT {K}, {{}} FROM combos")


@query("a07_implied_margin", MARGINS.format("round(margin, 6) AS margin"))
def margin(spark, sf_dir):
    c = A.best_combos(src.quotes(spark, sf_dir))
    return c.select(*MARKET_KEYS, r6(O.implied_margin(A.leg_odds(F.col("legs"))), "margin"))


@query("a08_is_arbitrage", MARGINS.format("margin < 1 AS is_arbitrage"))
def is_arb(spark, sf_dir):
    c = A.best_combos(src.quotes(spark, sf_dir))
    return c.select(*MARKET_KEYS, O.is_arbitrage(A.leg_odds(F.col("legs"))).alias("is_arbitrage"))


@query("a09_roi_percent", MARGINS.format("round((1 / margin - 1) * 100, 6) AS roi_pct"))
def roi(spark, sf_dir):
    c = A.best_combos(src.quotes(spark, sf_dir))
    return c.select(*MARKET_KEYS, r6(O.roi_percent(A.leg_odds(F.col("legs"))), "roi_pct"))


OPP_COLS = f"""{K}, sport, match_label, n_outcomes, {brand('bk1')} AS bk1, odds1, {brand('bk2')} AS bk2, odds2,
  {brand('bk3')} AS bk3, odds3, round(margin, 6) AS margin, round(roi_pct, 6) AS roi_pct,
  round(bankroll * (1 / margin - 1), 4) AS profit"""
MATCHES_SQL = """
matches AS (SELECT DISTINCT match_id, sport, competition, concat(home_team, ' - ', away_team) AS match_label,
  start_time FROM quotes)"""


def _opp_rows(df):
    return df.select(
        *MARKET_KEYS, "sport", "match_label", "n_outcomes", *flat_legs(df), r6("margin"), r6("roi_pct"),
        F.round("profit", 4).alias("profit"))


def _opp_sql(where: str, bankroll: float) -> str:
    return with_ctes(QUOTES_SQL, COMBOS_SQL, OPPS_SQL, MATCHES_SQL, f"""
SELECT {OPP_COLS} FROM (SELECT o.*, m.sport, m.match_label, {bankroll} AS bankroll
FROM opps o JOIN matches m USING (match_id)) WHERE {where}""")


def _leg_sql(i: int) -> str:
    book = brand(f"bk{i}")
    there = f"CASE WHEN bk{i} IS NOT NULL THEN {{}} END"
    site = there.format(f"concat('https://', {book}, '.example')")
    return f"sel{i} AS selection{i}, {book} AS bookmaker{i}, odds{i}, {site} AS site{i}, {label_sql(i)} AS event_label{i}"


@query("a10_make_opportunity", with_ctes(QUOTES_SQL, COMBOS_SQL, OPPS_SQL, MATCHES_SQL, f"""
SELECT {K}, {", ".join(_leg_sql(i) for i in (1, 2, 3))}, n_outcomes, sport, match_label, strftime(start_time, '%Y-%m-%d %H:%M:%S') AS match_date,
  round(margin, 6) AS margin, round(roi_pct, 6) AS roi_pct, round(1000 * (1 / margin - 1), 4) AS profit
FROM opps JOIN matches USING (match_id)"""))
def opportunity(spark, sf_dir):
    q = _owned(spark, sf_dir).withColumn("url", F.concat(F.lit("https://"), F.col("bookmaker"), F.lit(".example")))
    legs = []
    for i in (1, 2, 3):
        leg = F.get(F.col("legs"), F.lit(i - 1))
        legs += [leg[f].alias(f"{n}{i}") for f, n in (("selection", "selection"), ("bookmaker", "bookmaker"), ("odds", "odds"),
                                                      ("url", "site"), ("event_label", "event_label"))]
    return A.make_opportunity(A.best_combos(q), q, 1000.0, 1.0).select(
        *MARKET_KEYS, *legs, "n_outcomes", "sport", "match_label", stamp(F.col("match_date")).alias("match_date"),
        r6("margin"), r6("roi_pct"), F.round("profit", 4).alias("profit"))


@query("a11_find_two_way", _opp_sql("n_outcomes = 2", 1000.0))
def find2(spark, sf_dir):
    return _opp_rows(A.find_two_way(_owned(spark, sf_dir), 1.0, 1000.0).orderBy(F.desc("roi_pct")))


@query("a12_find_three_way", _opp_sql("n_outcomes = 3", 1000.0))
def find3(spark, sf_dir):
    return _opp_rows(A.find_three_way(_owned(spark, sf_dir), 1.0, 1000.0).orderBy(F.desc("roi_pct")))


# What the quote of the first leg says; of equal quotes the one that comes first by these very facts.
FIRST_LEG_SQL = f"""
first_leg AS (
  SELECT {K}, selection, bookmaker, odds, arg_min((sport, competition, home_team, away_team), (ingest_seq, url, sport, competition, home_team, away_team)) AS f
  FROM quotes GROUP BY ALL)"""


@query("a13_rank_cross_book", f"""
WITH RECURSIVE {reconciled_sql(f"SELECT * FROM spelled WHERE start_time > TIMESTAMP '{SPELLED_AS_OF}'")}, {COMBOS_SQL}, {FIRST_LEG_SQL}
SELECT concat(f[3], ' - ', f[4]) AS match, f[1] AS sport, f[2] AS competition, {", ".join("c." + k for k in MARKET_KEYS)}, n_outcomes AS n_issues,
  round(margin, 6) AS margin, bk1, odds1, bk2, odds2, bk3, odds3, margin < 1 AS is_arbitrage
FROM combos c JOIN first_leg l ON {on('c', 'l')} AND l.selection = sel1 AND l.bookmaker = bk1 AND l.odds = odds1
WHERE op1 <> op2 OR (op3 IS NOT NULL AND op3 <> op1)
ORDER BY c.margin, c.match_id, c.market_type, c.line NULLS FIRST, c.team_scope NULLS FIRST LIMIT 40""")
def rank(spark, sf_dir):
    r = A.rank_cross_book(src.spelled_quotes(spark, sf_dir), F.lit(SPELLED_AS_OF))
    return r.select("match", "sport", "competition", *MARKET_KEYS, "n_issues", r6("margin"), *flat_legs(r), "is_arbitrage")


STAKED_SQL = """
  CASE WHEN odds1 >= odds2 AND odds1 >= coalesce(odds3, 0)
       THEN round_even(50000 - r2 - coalesce(r3, 0), 0) ELSE r1 END AS stake1,
  CASE WHEN odds2 > odds1 AND odds2 >= coalesce(odds3, 0)
       THEN round_even(50000 - r1 - coalesce(r3, 0), 0) ELSE r2 END AS stake2,
  CASE WHEN odds3 > odds1 AND odds3 > odds2 THEN round_even(50000 - r1 - r2, 0) ELSE r3 END AS stake3
FROM (SELECT *, round_even(50000 / (odds1 * margin), 0) AS r1, round_even(50000 / (odds2 * margin), 0) AS r2,
             round_even(50000 / (odds3 * margin), 0) AS r3 FROM opps)"""


@query("a14_evaluate", f"WITH RECURSIVE {reconciled_sql()}, {COMBOS_SQL}, {OPPS_SQL} SELECT {K}, round(roi_pct, 6) AS roi_pct, {STAKED_SQL}")
def evaluate(spark, sf_dir):
    o = A.evaluate(src.spelled_quotes(spark, sf_dir))
    return o.select(*MARKET_KEYS, r6("roi_pct"), *[
        F.get(F.col("legs"), F.lit(i))["stake"].alias(f"stake{i + 1}") for i in range(3)])


@query("a15_live_filter", with_ctes(QUOTES_SQL, COMBOS_SQL, f"""
SELECT {K}, round((1 / margin - 1) * 100, 6) AS roi_pct FROM combos WHERE (1 / margin - 1) * 100 >= 3.0"""))
def live(spark, sf_dir):
    r = A.with_margin(A.best_combos(src.quotes(spark, sf_dir)))
    return A.live_filter(r, 3.0).select(*MARKET_KEYS, r6("roi_pct"))


@query("a16_counter_odd", with_ctes(QUOTES_SQL, """
SELECT DISTINCT odds, round(CASE WHEN odds - 0.3 > 1 THEN 1 / (1 - 1 / (odds - 0.3)) END, 6) AS counter FROM quotes"""))
def counter(spark, sf_dir):
    q = src.quotes(spark, sf_dir).select("odds").distinct()
    return q.select("odds", r6(O.counter_odd(F.col("odds") - 0.3), "counter"))


@query("a17_intra_book_margin", with_ctes(QUOTES_SQL, f"""
SELECT bookmaker, market_type, count(*) AS markets, round(avg(p), 6) AS mean_pct, round(min(p), 6) AS min_pct,
  round(max(p), 6) AS max_pct, round(median(p), 6) AS median_pct
FROM (SELECT {K}, n_outcomes, bookmaker, (sum(1 / o) - 1) * 100 AS p
      FROM (SELECT {K}, n_outcomes, bookmaker, selection, max(odds) AS o FROM quotes
            GROUP BY {K}, n_outcomes, bookmaker, selection)
      GROUP BY {K}, n_outcomes, bookmaker HAVING count(*) = n_outcomes)
GROUP BY 1, 2"""))
def intra(spark, sf_dir):
    m = A.intra_book_margin(src.quotes(spark, sf_dir))
    return m.select("bookmaker", "market_type", "markets", *[r6(f"{c}_pct") for c in ("mean", "min", "max", "median")])


@query("a18_cross_book_price_agreement", with_ctes(QUOTES_SQL, f"""
last AS (SELECT {K}, selection, bookmaker, odds FROM (
  SELECT *, row_number() OVER (PARTITION BY {K}, selection, bookmaker ORDER BY ingest_seq DESC, odds DESC) AS rn
  FROM quotes) WHERE rn = 1)""", f"""
SELECT a.bookmaker AS book_a, b.bookmaker AS book_b, count(*) AS comparable,
  count(*) FILTER (a.odds = b.odds) AS identical,
  round(100.0 * count(*) FILTER (a.odds = b.odds) / count(*), 6) AS pct
FROM last a JOIN last b ON {on('a', 'b', K + ', selection')} AND a.bookmaker < b.bookmaker GROUP BY 1, 2"""))
def agreement(spark, sf_dir):
    return A.cross_book_price_agreement(src.quotes(spark, sf_dir)).withColumn("pct", F.round("pct", 6))


@query("a19_overlap_matrix", with_ctes(QUOTES_SQL, f"""
m AS (SELECT DISTINCT {K}, bookmaker FROM quotes)""", f"""
SELECT a.bookmaker AS book_a, b.bookmaker AS book_b, count(DISTINCT a.match_id) AS shared_matches,
  count(*) FILTER ({on('a', 'b')}) AS shared_markets
FROM m a JOIN m b ON a.match_id = b.match_id AND a.bookmaker < b.bookmaker GROUP BY 1, 2"""))
def overlap(spark, sf_dir):
    return A.overlap_matrix(src.quotes(spark, sf_dir))
