"""SQL shared by the checking statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.adapters import QUOTES_SQL  # noqa: F401

K = "match_id, market_type, line, team_scope"


def on(a: str, b: str, keys: str = K) -> str:
    return " AND ".join(f"{a}.{k.strip()} IS NOT DISTINCT FROM {b}.{k.strip()}" for k in keys.split(","))


def global_walk_sql(limit: int, window_s: int, open_until: str) -> str:
    """Tables r (all events in order) and walk (granted ones): one budget for all, from grant to grant.

    Each grant is the first event after the one before that is also outside the window of the grant ``limit`` back.
    """
    return f"""r AS (SELECT event_id, epoch_us(ts) AS t, row_number() OVER (ORDER BY ts, event_id) AS rn FROM events),
walk AS (
  SELECT 0 AS rn, 0 AS n, []::BIGINT[] AS last
  UNION ALL
  SELECT nxt.rn, w.n + 1, list_slice(list_append(w.last, nxt.t), greatest(1, len(w.last) + 2 - {limit}), len(w.last) + 1)
  FROM walk w, LATERAL (SELECT min(r.rn) AS rn, arg_min(r.t, r.rn) AS t FROM r
    WHERE r.rn > w.rn AND (w.n < {limit} OR r.t {open_until} w.last[1] + {window_s * 1_000_000})) nxt
  WHERE nxt.rn IS NOT NULL)"""


# Best combination per market by direct comparison: ranks, joins, and plain
# enumeration of triplets for markets one bookmaker dominates.
COMBOS_SQL = f"""
sided AS (
  SELECT *, CASE WHEN n_outcomes = 2 AND selection IN ('over', 'home') THEN 'a'
                 WHEN n_outcomes = 2 THEN 'b' ELSE selection END AS side FROM quotes),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY {K}, side ORDER BY odds DESC, ingest_seq, bookmaker) AS rn FROM sided),
top AS (SELECT * FROM ranked WHERE rn = 1),
pair AS (
  SELECT a.match_id, a.market_type, a.line, a.team_scope, a.bookmaker AS ba, a.odds AS oa, a.selection AS sa,
         b.bookmaker AS bb, b.odds AS ob, b.selection AS sb
  FROM top a JOIN top b ON {on('a', 'b')} WHERE a.side = 'a' AND b.side = 'b'),
alt AS (
  SELECT s.match_id, s.market_type, s.line, s.team_scope, s.side, s.bookmaker, s.odds, s.selection,
         row_number() OVER (PARTITION BY {', '.join('s.' + k.strip() for k in K.split(','))}, s.side
                            ORDER BY s.odds DESC, s.ingest_seq, s.bookmaker) AS rn
  FROM sided s JOIN pair p ON {on('s', 'p')} WHERE p.ba = p.bb AND s.bookmaker <> p.ba),
two AS (
  SELECT p.match_id, p.market_type, p.line, p.team_scope,
    CASE WHEN p.ba <> p.bb THEN 'as is'
         WHEN b.odds IS NOT NULL AND (a.odds IS NULL OR b.odds >= a.odds) THEN 'swap b'
         WHEN a.odds IS NOT NULL THEN 'swap a' END AS how,
    p.ba, p.oa, p.sa, p.bb, p.ob, p.sb, a.bookmaker AS aa, a.odds AS ao, a.selection AS asel,
    b.bookmaker AS ab, b.odds AS bo, b.selection AS bsel
  FROM pair p
  LEFT JOIN alt a ON {on('p', 'a')} AND a.side = 'a' AND a.rn = 1
  LEFT JOIN alt b ON {on('p', 'b')} AND b.side = 'b' AND b.rn = 1),
two_way AS (
  SELECT {K}, 2 AS n_outcomes,
    CASE how WHEN 'swap a' THEN aa ELSE ba END AS bk1, CASE how WHEN 'swap a' THEN asel ELSE sa END AS sel1,
    CASE how WHEN 'swap a' THEN ao ELSE oa END AS odds1,
    CASE how WHEN 'swap b' THEN ab ELSE bb END AS bk2, CASE how WHEN 'swap b' THEN bsel ELSE sb END AS sel2,
    CASE how WHEN 'swap b' THEN bo ELSE ob END AS odds2,
    CAST(NULL AS VARCHAR) AS bk3, CAST(NULL AS VARCHAR) AS sel3, CAST(NULL AS DOUBLE) AS odds3
  FROM two WHERE how IS NOT NULL),
trio AS (
  SELECT h.match_id, h.market_type, h.line, h.team_scope, h.bookmaker AS bh, h.odds AS oh, h.ingest_seq AS ih,
         d.bookmaker AS bd, d.odds AS od, d.ingest_seq AS id, a.bookmaker AS ba, a.odds AS oa, a.ingest_seq AS ia,
         h.rn = 1 AND d.rn = 1 AND a.rn = 1 AS is_top,
         NOT (h.bookmaker = d.bookmaker AND d.bookmaker = a.bookmaker) AS mixed
  FROM ranked h JOIN ranked d ON {on('h', 'd')} JOIN ranked a ON {on('h', 'a')}
  WHERE h.n_outcomes = 3 AND h.side = 'home' AND d.side = 'draw' AND a.side = 'away'),
three_way AS (
  SELECT {K}, 3 AS n_outcomes, bh AS bk1, 'home' AS sel1, oh AS odds1, bd AS bk2, 'draw' AS sel2, od AS odds2,
         ba AS bk3, 'away' AS sel3, oa AS odds3
  FROM (SELECT *, row_number() OVER (PARTITION BY {K}
          ORDER BY is_top DESC, 1 / oh + 1 / od + 1 / oa, ih, id, ia) AS pick
        FROM trio WHERE mixed) WHERE pick = 1),
combos AS (
  SELECT *, 1 / odds1 + 1 / odds2 + coalesce(1 / odds3, 0) AS margin,
    CASE WHEN bk1 IN ('book_0', 'book_1', 'book_2', '1xBet', 'MelBet', 'Line Bet') THEN 'north' ELSE bk1 END AS op1,
    CASE WHEN bk2 IN ('book_0', 'book_1', 'book_2', '1xBet', 'MelBet', 'Line Bet') THEN 'north' ELSE bk2 END AS op2,
    CASE WHEN bk3 IN ('book_0', 'book_1', 'book_2', '1xBet', 'MelBet', 'Line Bet') THEN 'north' ELSE bk3 END AS op3
  FROM (SELECT * FROM two_way UNION ALL SELECT * FROM three_way))"""

# Playable opportunities with the returns and whole-unit stakes.
OPPS_SQL = """
opps AS (
  SELECT *, (1 / margin - 1) * 100 AS roi_pct FROM combos
  WHERE margin < 1 AND (1 / margin - 1) * 100 >= 1.0
    AND (op1 <> op2 OR (op3 IS NOT NULL AND op3 <> op1)))"""


def r6(name: str | Column, alias: str | None = None) -> Column:
    col = F.col(name) if isinstance(name, str) else name
    return F.round(col, 6).alias(alias or name)


def flat_legs(df: DataFrame, legs: str = "legs") -> list[Column]:
    """Leg columns as scalars, the third one NULL for two-way markets."""
    cols = []
    for i in range(3):
        leg = F.get(F.col(legs), F.lit(i))
        cols += [leg["bookmaker"].alias(f"bk{i + 1}"), leg["odds"].alias(f"odds{i + 1}")]
    return cols


BRANDED_SQL = QUOTES_SQL.replace("quotes AS (", "plain_quotes AS (")
SEASON_SQL = BRANDED_SQL + """,
branded AS (SELECT * REPLACE (CASE bookmaker WHEN 'book_0' THEN '1xBet' WHEN 'book_1' THEN 'MelBet'
    WHEN 'book_2' THEN 'Line Bet' ELSE bookmaker END AS bookmaker), CAST(match_id AS BIGINT) // 20 AS fixture FROM plain_quotes),
quotes AS (
  SELECT * REPLACE (concat(fixture, '@', year(scraped_at)) AS match_id,
    CASE WHEN fixture % 4 = 0 THEN 'basketball' ELSE 'football' END AS sport,
    concat('Home ', fixture) AS home_team, concat('Away ', fixture) AS away_team,
    concat('https://x.example/?a=1&b=', bookmaker) AS url,
    TIMESTAMP '1996-01-01 18:00:00' + to_days(CAST(fixture % 2000 AS INTEGER)) AS start_time)
  FROM branded)"""


def label_sql(i: int) -> str:
    return (f"CASE WHEN bk{i} IS NOT NULL THEN concat(market_type, ' ', sel{i}, "
            f"CASE WHEN line IS NOT NULL THEN concat(' ', line) ELSE '' END) END")


STAKES_SQL = """
  CASE WHEN odds1 >= odds2 AND odds1 >= coalesce(odds3, 0) THEN 1000 - r2 - coalesce(r3, 0) ELSE r1 END AS mise_a,
  CASE WHEN odds2 > odds1 AND odds2 >= coalesce(odds3, 0) THEN 1000 - r1 - coalesce(r3, 0) ELSE r2 END AS mise_b,
  CASE WHEN odds3 > odds1 AND odds3 > odds2 THEN 1000 - r1 - r2 ELSE r3 END AS mise_c"""

SEASON_OPPS_SQL = SEASON_SQL + "," + COMBOS_SQL + "," + OPPS_SQL + f""",
numbered AS (
  SELECT *, CAST(split_part(match_id, '@', 1) AS BIGINT) AS fixture, CAST(split_part(match_id, '@', 2) AS BIGINT) AS yr,
    {", ".join(f"round_even(1000 / (odds{i} * margin), 0) AS r{i}" for i in (1, 2, 3))}
  FROM opps),
dated AS (
  SELECT *, ((fixture * 100 + (yr - 1990)) * 4 + CASE market_type WHEN '1x2' THEN 0 WHEN 'goals_total' THEN 1
      WHEN 'corners_total' THEN 2 ELSE 3 END) * 64 + CAST(coalesce(line * 2, 0) AS BIGINT) * 4
    + CASE team_scope WHEN 'home' THEN 1 WHEN 'away' THEN 2 ELSE 0 END AS id, {STAKES_SQL},
    1000 * (1 / margin - 1) AS profit, CASE WHEN fixture % 4 = 0 THEN 'basketball' ELSE 'football' END AS sport,
    concat('Home ', fixture, ' - Away ', fixture) AS match,
    TIMESTAMP '1996-01-01 18:00:00' + to_days(CAST(fixture % 2000 AS INTEGER)) AS match_date
  FROM numbered),
scored AS (
  SELECT *, make_timestamp(yr, 1, 1, 0, 0, 0) + to_days(CAST(id % 300 AS INTEGER)) + to_seconds(id % 86400) AS seen_at,
    CAST(round_even(100 * greatest(0, least(1, (0.30 * CASE WHEN id % 120 <= 15 THEN 1.0::DOUBLE
        WHEN id % 120 <= 60 THEN 1 - 0.5::DOUBLE * (id % 120 - 15) / 45
        ELSE greatest(0, 0.5::DOUBLE - (id % 120 - 60) / 120) END
      + 0.35::DOUBLE * 0.85 + 0.20::DOUBLE * 0.85 + 0.15)
      * CASE WHEN market_type IN ('1x2', 'goals_total') AND roi_pct > 25 THEN 0 WHEN roi_pct > 40 THEN 0.15 ELSE 1 END)), 0)
      AS INTEGER) AS score_ia,
    CASE id % 7 WHEN 0 THEN 'ok' WHEN 1 THEN 'partie' WHEN 2 THEN 'fausse' WHEN 3 THEN 'marche' WHEN 4 THEN 'match'
      WHEN 5 THEN 'doute' ELSE 'detected' END AS statut
  FROM dated)"""

HISTORY_SQL = SEASON_OPPS_SQL + f""",
hist AS (
  SELECT id * 2 + copy AS id, copy, CASE WHEN copy = 1 THEN seen_at + INTERVAL 2 HOURS ELSE seen_at END AS date_detection,
    match, sport, match_date, n_outcomes AS n_issues, bk1 AS bookmaker_a, {label_sql(1)} AS event_a,
    CASE WHEN copy = 1 AND id % 2 = 0 THEN round(odds1 + 0.05, 2) ELSE odds1 END AS cote_a,
    bk2 AS bookmaker_b, {label_sql(2)} AS event_b, odds2 AS cote_b, bk3 AS bookmaker_c, {label_sql(3)} AS event_c,
    odds3 AS cote_c, mise_a, mise_b, mise_c, margin AS marge_m, roi_pct, profit, 1000.0 AS init_balance,
    1000 + profit AS final_balance, score_ia, statut
  FROM scored CROSS JOIN (VALUES (0), (1)) c(copy) WHERE copy = 0 OR id % 3 = 0)"""
