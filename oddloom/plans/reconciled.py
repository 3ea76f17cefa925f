"""Checking SQL for quotes whose matches are spelled differently by each bookmaker, and reconciled."""

from __future__ import annotations

from ..sources.adapters import QUOTES_SQL, TEAM_NAME_SQL

MARK = r"""CASE WHEN regexp_matches({c}, '(?i)\bu-?\s?(?:15|16|17|18|19|20|21|22|23)\b|\byouth\b|\bjunior|\bjeunes?\b') THEN 'youth'
  WHEN regexp_matches({c}, '(?i)\breserves?\b|\bres\.\b|\bII\b|\bB\b|\bacademy\b') THEN 'reserve'
  WHEN regexp_matches({c}, '(?i)\b(?:women|dames|ladies)\b') THEN 'women' END"""


# Longest common subsequence by recursion over the letters of the left text.
LCS = """
lcs AS (
  SELECT a, b, 0 AS i, list_transform(range(0, length(b) + 1), lambda x: 0) AS line FROM texts
  UNION ALL
  SELECT a, b, i + 1, list_transform(range(1, length(b) + 2), lambda j: list_max(list_slice(step, 1, j)))
  FROM (SELECT *, list_transform(range(1, length(b) + 2), lambda k: CASE WHEN k = 1 THEN 0
          WHEN substr(b, k - 1, 1) = substr(a, i + 1, 1) THEN line[k - 1] + 1 ELSE line[k] END) AS step
        FROM lcs WHERE i < length(a))),
ratio AS (SELECT a, b, 200.0::DOUBLE * line[length(b) + 1] / (length(a) + length(b)) AS score FROM lcs WHERE i = length(a))"""


def close_sql(names: str, score_sets: bool = True) -> str:
    """Tables up to ``close`` (a, b): pairs of ``names`` (a, b), canonical and of equal level, that score at least 85.

    Pairs whose lengths alone rule them out are left out first, which no pair over the threshold is.
    """
    fits = "200.0 * least(length({a}), length({b})) >= 85 * (length({a}) + length({b}))"
    words = "list_filter(string_split({0}, ' '), lambda w: {1} list_contains(string_split({2}, ' '), w))"
    return f"""
asked AS (SELECT DISTINCT a, b FROM ({names})),
sorted AS (SELECT a, b, array_to_string(list_sort(string_split(a, ' ')), ' ') AS sa, array_to_string(list_sort(string_split(b, ' ')), ' ') AS sb FROM asked),
split AS (SELECT *, list_sort(list_distinct({words.format('a', '', 'b')})) AS common,
    list_sort(list_distinct({words.format('a', 'NOT', 'b')})) AS xa, list_sort(list_distinct({words.format('b', 'NOT', 'a')})) AS xb FROM sorted),
whole AS (SELECT *, array_to_string(list_concat(common, xa), ' ') AS fa, array_to_string(list_concat(common, xb), ' ') AS fb,
  length(array_to_string(common, ' ')) AS shared FROM split),
texts AS (SELECT DISTINCT sa AS a, sb AS b FROM whole WHERE {fits.format(a='sa', b='sb')}
  {"UNION SELECT DISTINCT fa, fb FROM whole WHERE " + fits.format(a='fa', b='fb') if score_sets else ""}), {LCS},
scored AS (SELECT w.a, w.b, greatest(coalesce(s.score, 0), {"""CASE WHEN len(common) > 0 AND (len(xa) = 0 OR len(xb) = 0) THEN 100
    WHEN len(common) > 0 THEN greatest(coalesce(f.score, 0), 200.0::DOUBLE * shared / (shared + length(fa)), 200.0::DOUBLE * shared / (shared + length(fb)))
    ELSE coalesce(f.score, 0) END""" if score_sets else "0"}) AS score
  FROM whole w LEFT JOIN ratio s ON s.a = sa AND s.b = sb LEFT JOIN ratio f ON f.a = fa AND f.b = fb),
close AS (SELECT a, b, score FROM scored WHERE score >= 85)"""


MATCH_ID = """substr(sha1(concat_ws('|', trim(regexp_replace(lower(home_team), '[^a-z0-9]+', ' ', 'g')),
  trim(regexp_replace(lower(away_team), '[^a-z0-9]+', ' ', 'g')), strftime(start_time, '%Y-%m-%d'))), 1, 16)"""

SPELLED_SQL = QUOTES_SQL.replace("quotes AS (", "plain_quotes AS (") + f""",
spelled AS (
  SELECT * REPLACE ({MATCH_ID} AS match_id) FROM (
    SELECT q.* EXCLUDE (form) REPLACE (
      {TEAM_NAME_SQL.format(v='form', n='p_name')} AS home_team, concat(p_brand, ' ', p_type) AS away_team,
      TIMESTAMP '1996-01-01 18:00:00' + to_days(CAST(p_partkey % 365 AS INTEGER)) AS start_time,
      CASE bookmaker WHEN 'book_0' THEN '1xBet' WHEN 'book_1' THEN 'MelBet' WHEN 'book_2' THEN 'Line Bet' ELSE bookmaker END AS bookmaker)
    FROM (SELECT *, [0, 3, 3, 2, 4, 1][CAST(right(bookmaker, 1) AS INTEGER) + 1] AS form FROM plain_quotes) q
    JOIN part ON p_partkey = CAST(q.match_id AS BIGINT)))"""



def reconciled_sql(pool: str = "SELECT * FROM spelled") -> str:
    """Tables up to ``quotes``: the spelled quotes of ``pool`` with the match ids of reconciliation.

    The spellings of a day stand in feed order; each follows the earliest leader that it is similar to, or leads itself.
    """
    return SPELLED_SQL + f""",
pool AS ({pool}),
nodes AS (
  SELECT *, row_number() OVER (ORDER BY first_seq, match_id) AS seq
  FROM (SELECT match_id, any_value(lower(home_team)) AS h, any_value(lower(away_team)) AS w, any_value(CAST(start_time AS DATE)) AS day,
          any_value({MARK.format(c='home_team')}) AS level, arg_min(sport, ingest_seq) AS sport, min(ingest_seq) AS first_seq
        FROM pool GROUP BY 1)),
{close_sql("""SELECT x.h AS a, y.h AS b FROM (SELECT DISTINCT h, level FROM nodes) x JOIN (SELECT DISTINCT h, level FROM nodes) y
    ON x.level IS NOT DISTINCT FROM y.level
  UNION SELECT x.w, y.w FROM (SELECT DISTINCT w FROM nodes) x, (SELECT DISTINCT w FROM nodes) y""")},
edges AS (
  SELECT x.day, x.sport, x.seq, list(y.seq ORDER BY y.seq) AS earlier FROM nodes x JOIN nodes y
    ON x.day = y.day AND x.sport = y.sport AND y.seq < x.seq AND x.level IS NOT DISTINCT FROM y.level
  JOIN close h ON h.a = x.h AND h.b = y.h JOIN close w ON w.a = x.w AND w.b = y.w
  GROUP BY 1, 2, 3),
line AS (SELECT *, row_number() OVER (PARTITION BY day, sport ORDER BY seq) AS rn FROM edges),
walk AS (
  SELECT day, sport, 0 AS rn, 0::BIGINT AS seq, NULL::BIGINT AS leader, []::BIGINT[] AS followers FROM (SELECT DISTINCT day, sport FROM line)
  UNION ALL
  SELECT day, sport, rn, seq, leader, CASE WHEN leader IS NULL THEN followers ELSE list_append(followers, seq) END
  FROM (SELECT n.day, n.sport, n.rn, n.seq, w.followers, list_filter(n.earlier, lambda x: NOT list_contains(w.followers, x))[1] AS leader
        FROM walk w JOIN line n ON n.day = w.day AND n.sport = w.sport AND n.rn = w.rn + 1)),
quotes AS (
  SELECT s.* REPLACE (c.match_id AS match_id) FROM pool s JOIN nodes n ON n.match_id = s.match_id
  LEFT JOIN walk k ON k.seq = n.seq JOIN nodes c ON c.seq = coalesce(k.leader, n.seq))"""
