"""Sources S01-S13: payloads derived from the tables, flattened and compared with them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import once
from ..operators.pool import branded_feed_union
from ..session import scratch_path
from ..sources import adapters as src
from ..sources import feeds as S
from ..sources import html as X
from ..sources.adapters import stamp
from .common import HISTORY_SQL, QUOTES_SQL
from .registry import query, with_ctes

OUT = ["bookmaker", "match_id", "home_team", "market_type", "n_outcomes", "selection", "line", "team_scope", "odds"]
OUT_SQL = """match_key AS match_id, home_team, market_type, n_outcomes, selection, line, team_scope, odds"""
KEYED_SQL = """
keyed AS (SELECT *, substr(sha1(concat(lower(home_team), '|', lower(away_team), '|', strftime(start_time, '%Y-%m-%d'))), 1, 16)
  AS match_key FROM quotes WHERE ingest_seq % 10 <> 0)"""


def _rows(q):
    return q.select(*OUT, stamp(F.col("start_time")).alias("starts"))


def _line_payload(spark, sf_dir):
    """One coded-feed document per quote: the quote, an excluded code and a worthless price."""
    q = src.spread_quotes(spark, sf_dir)
    m, s, sc = F.col("market_type"), F.col("selection"), F.col("team_scope")
    over = s == "over"
    g = F.when(m == "1x2", 1).when(m == "goals_total", 17).when(sc == "home", 15).when(sc == "away", 62).otherwise(99)
    t = (
        F.when(m == "1x2", F.when(s == "home", 1).when(s == "draw", 2).otherwise(3))
        .when(m == "goals_total", F.when(over, 9).otherwise(10)).when(sc == "home", F.when(over, 11).otherwise(12))
        .when(sc == "away", F.when(over, 13).otherwise(14)).otherwise(1)
    )

    def entry(gg, tt, c, p):
        return F.struct(gg.cast("int").alias("G"), tt.cast("int").alias("T"), c.cast("double").alias("C"), p.alias("P"))

    entries = F.array(
        entry(F.lit(8), F.lit(4), F.lit(1.5), F.col("line")), entry(g, t, F.col("odds"), F.col("line")),
        entry(F.lit(17), F.lit(9), F.lit(1.0), F.col("line")),
    )
    event = F.struct(
        F.col("match_id").cast("bigint").alias("I"),
        F.when(F.col("ingest_seq") % 10 != 0, F.col("home_team")).alias("O1"), F.col("away_team").alias("O2"),
        F.col("competition").alias("L"), F.unix_timestamp("start_time").alias("S"), entries.alias("E"))
    return q.select((F.col("ingest_seq") % 1000003).alias("feed_seq"), F.to_json(F.struct(F.array(event).alias("Value"))).alias("payload"))


LINE_SQL = f"""
line AS (SELECT {OUT_SQL.replace('market_type', "CASE market_type WHEN 'corners_team' THEN 'goals_team' ELSE market_type END AS market_type")},
  strftime(start_time, '%Y-%m-%d %H:%M:%S') AS starts FROM keyed WHERE market_type <> 'corners_total')"""


@query("s01_linefeed_explode", with_ctes(QUOTES_SQL, KEYED_SQL, LINE_SQL, "SELECT '1xBet' AS bookmaker, * FROM line"))
def line_feed(spark, sf_dir):
    return _rows(S.linefeed_explode(_line_payload(spark, sf_dir)))


@query("s12_branded_feed_union", with_ctes(QUOTES_SQL, KEYED_SQL, LINE_SQL, """
SELECT b AS bookmaker, market_type, selection, count(*) AS n FROM line CROSS JOIN (VALUES ('1xBet'), ('MelBet')) v(b) GROUP BY 1, 2, 3"""))
def brands(spark, sf_dir):
    raw = _line_payload(spark, sf_dir)
    q = branded_feed_union(S.linefeed_explode, {"1xBet": raw, "MelBet": raw})
    return q.groupBy("bookmaker", "market_type", "selection").agg(F.count("*").alias("n"))


def _landed(q, document):
    """One document per quote, written in a step of its own: in one with the parser, all of it would be interpreted."""
    return once(q.withColumn("feed_seq", F.col("ingest_seq") % 1000003), "payload", document).select("feed_seq", "payload")


def _map1(key, value):
    return F.create_map(key, value)


@query("s02_tree_flatten", with_ctes(QUOTES_SQL, KEYED_SQL, f"""
SELECT 'Golcash' AS bookmaker, {OUT_SQL}, strftime(start_time, '%Y-%m-%d %H:%M:%S') AS starts FROM keyed"""))
def tree(spark, sf_dir):
    q = src.spread_quotes(spark, sf_dir)
    m, sc, s = F.col("market_type"), F.col("team_scope"), F.col("selection")
    kind = (
        F.when(m == "1x2", "P1XP2").when(m == "goals_total", "OverUnder").when(sc == "home", "HomeTeamCornersOverUnder")
        .when(sc == "away", "AwayTeamCornersOverUnder").otherwise("CornersOverUnder")
    )
    outcome = F.when(s == "home", "P1").when(s == "draw", "X").when(s == "away", "P2").otherwise(F.initcap(s))
    name = F.when(F.col("line").isNull(), F.lit("W")).otherwise(F.concat(outcome, F.lit(" "), F.col("line").cast("string")))
    event = F.struct(outcome.alias("type"), name.alias("name"), F.col("odds").alias("price"))
    dud = F.struct(F.lit("Exact").alias("type"), F.lit("x 1").alias("name"), F.lit(9.0).alias("price"))
    market = F.struct(kind.alias("type"), F.create_map(F.lit("1"), event, F.lit("2"), dud).alias("event"))
    exotic = F.struct(F.lit("AsianHandicap").alias("type"), _map1(F.lit("1"), event).alias("event"))
    game = F.struct(
        F.col("match_id").cast("bigint").alias("id"), F.when(F.col("ingest_seq") % 10 != 0, F.col("home_team")).alias("team1_name"),
        F.col("away_team").alias("team2_name"), F.unix_timestamp("start_time").alias("start_ts"),
        F.create_map(F.lit("m1"), market, F.lit("m2"), exotic).alias("market"))
    comp = F.struct(F.col("competition").alias("name"), _map1(F.lit("g"), game).alias("game"))
    root = F.struct(_map1(F.lit("1"), F.struct(_map1(F.lit("c"), comp).alias("competition"))).alias("sport"))
    return _rows(S.tree_flatten(_landed(q, F.to_json(root))))


STATS = [("corners", "Corners"), ("cards", "YellowCards"), ("fouls", "Fouls"), ("shots_on_target", "ShotsOnTarget"),
         ("shots", "TotalShots"), ("tackles", "Tackles"), ("offside", "Offsides"), ("saves", "Saves")]


def _stat_sql(which: int) -> str:
    return "CASE p_size % 8 " + " ".join(f"WHEN {i} THEN '{s[which]}'" for i, s in enumerate(STATS)) + " END"


def _stat_col(which: int):
    return F.get(F.array(*[F.lit(s[which]) for s in STATS]), F.col("p_size") % 8)


@query("s03_tree_market_resolve", f"""
SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'btts' WHEN p_partkey % 5 = 4 THEN NULL ELSE concat(stat, CASE WHEN scope IS NULL THEN '_total' ELSE '_team' END,
    CASE p_partkey % 7 WHEN 0 THEN '_1h' WHEN 1 THEN '_2h' ELSE '' END) END AS market_type,
  CASE WHEN p_partkey % 11 = 0 OR p_partkey % 5 = 4 THEN NULL ELSE scope END AS team_scope
FROM (SELECT *, {_stat_sql(0)} AS stat, CASE p_partkey % 3 WHEN 0 THEN 'home' WHEN 1 THEN 'away' END AS scope FROM part)""")
def tree_market(spark, sf_dir):
    k = F.col("p_partkey")
    half = F.when(k % 7 == 0, "HalfTime").when(k % 7 == 1, "2ndHalf").otherwise("")
    side = F.when(k % 3 == 0, "HomeTeam").when(k % 3 == 1, "AwayTeam").otherwise("")
    tail = F.when(k % 5 == 4, "Handicap").when(k % 2 == 0, "Over/Under").otherwise("OverUnder")
    name = F.when(k % 11 == 0, F.lit("BothTeamsToScore")).otherwise(F.concat(half, side, _stat_col(1), tail))
    df = src.table(spark, sf_dir, "part").select("p_partkey", "p_size", name.alias("type"))
    r = S.tree_market_resolve(df)
    return r.select("p_partkey", "resolved.market_type", "resolved.team_scope")


@query("s04_grouped_feed_flatten", with_ctes(QUOTES_SQL, KEYED_SQL, f"""
SELECT 'Paryaj Pam' AS bookmaker, {OUT_SQL}, strftime(start_time, '%Y-%m-%d %H:%M:%S') AS starts FROM keyed"""))
def grouped(spark, sf_dir):
    q = src.spread_quotes(spark, sf_dir)
    m, sc, s = F.col("market_type"), F.col("team_scope"), F.col("selection")
    tp = F.when(m == "1x2", 2).when(m == "goals_total", 4).when(sc == "home", 68).when(sc == "away", 69).otherwise(67)
    name = F.when(s == "home", "Win1").when(s == "draw", "Draw").when(s == "away", "Win2").otherwise(F.initcap(s))
    text_line = F.coalesce(F.col("line").cast("string"), F.lit(""))
    on_market = F.col("ingest_seq") % 2 == 0

    def market(period, price, kind=tp):
        out = F.struct(name.alias("nm"), price.alias("kf"), F.when(on_market, F.lit("")).otherwise(text_line).alias("vl"))
        return F.struct(
            kind.alias("tp"), F.lit(period).alias("pn"), F.lit("M").alias("nm"),
            F.when(on_market, text_line).otherwise(F.lit("")).alias("vl"), F.array(_map1(F.lit("[k]"), out)).alias("ou"))

    cms = F.when(F.col("ingest_seq") % 3 == 0, F.array("home_team", "away_team"))
    home = F.when(F.col("ingest_seq") % 10 != 0, F.col("home_team")).otherwise(F.lit(""))
    event = F.struct(
        F.col("match_id").alias("id"), F.concat(home, F.lit(" - "), F.col("away_team")).alias("nm"),
        F.when(F.col("ingest_seq") % 10 != 0, cms).alias("cms"), F.date_format("start_time", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("tm"),
        F.create_map(
            F.lit("h1"), market("MainTime", F.col("odds")), F.lit("h2"), market("OvertimePenalties", F.col("odds")),
            F.lit("h3"), market("MainTime", F.col("odds"), F.lit(999))).alias("mr"))
    group = F.struct(F.lit("").alias("trn"), F.col("competition").alias("ctn"), F.array(event).alias("events"))
    return _rows(S.grouped_feed_flatten(_landed(q, F.to_json(_map1(F.lit("1"), F.array(group))))))


@query("s05_code_market_resolve", f"""
SELECT p_partkey, concat(CASE WHEN p_partkey % 4 = 0 THEN 'goals' ELSE stat END, CASE WHEN scope IS NULL THEN '_total' ELSE '_team' END,
    CASE p_partkey % 5 WHEN 0 THEN '_1h' WHEN 1 THEN '_2h' ELSE '' END) AS market_type, scope AS team_scope
FROM (SELECT *, {_stat_sql(0)} AS stat, CASE p_partkey % 3 WHEN 0 THEN 'home' WHEN 1 THEN 'away' END AS scope FROM part)
WHERE p_partkey % 5 <> 4""")
def code_market(spark, sf_dir):
    k = F.col("p_partkey")
    side = F.when(k % 3 == 0, "Team1").when(k % 3 == 1, "Team2").otherwise("")
    goals = F.when(k % 3 == 0, 5).when(k % 3 == 1, 6).otherwise(4)
    period = F.when(k % 5 == 0, "Half1").when(k % 5 == 1, "Half2").when(k % 5 == 4, "Overtime").otherwise("MainTime")
    df = src.table(spark, sf_dir, "part").select(
        "p_partkey", "p_size", F.when(k % 4 == 0, goals).otherwise(9999).alias("tp"), period.alias("pn"),
        F.concat(_stat_col(1), side, F.lit("Total")).alias("nm"))
    return S.code_market_resolve(df).select("p_partkey", "resolved.market_type", "resolved.team_scope")


# How the feed names the statistics, and what they are called here.
SUBGAMES = [("  CORNERS ", "corners"), ("Tirs cadrés", "shots_on_target"), ("Tirs vers le but", "shots"), ("Fautes", "fouls"),
         ("Cartons Jaunes", "cards"), ("cartons", "cards"), ("Tacles", "tackles"), ("Dégagements de but", "goalkicks"),
         ("Sauvetages", "saves"), ("CONTRÔLES VAR", "var"), ("Hors-jeu", "offside"), ("Touches", "throwins")]


@query("s06_stat_subgame_explode", with_ctes(QUOTES_SQL, f"""
names AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{stat}')" for i, (_, stat) in enumerate(SUBGAMES))}) t(s, stat)),
subs AS (SELECT *, ingest_seq // 10000 % 12 AS s, CAST(match_id AS BIGINT) AS k FROM quotes WHERE n_outcomes = 2)""", """
SELECT home_team, concat(stat, CASE WHEN team_scope IS NULL THEN '_total' ELSE '_team' END) AS market_type, selection, line, team_scope, odds
FROM subs JOIN names USING (s) WHERE CASE s WHEN 4 THEN k % 2 = 0 WHEN 5 THEN k % 2 = 1 ELSE TRUE END"""))
def stats(spark, sf_dir):
    """All two-way quotes, dealt over the sub-games of every statistic; of the two names for cards the one listed first counts."""
    q = src.spread_quotes(spark, sf_dir).filter("n_outcomes = 2")
    key = F.col("p_partkey")

    def sg(name, ident):
        return F.struct(F.lit(name).alias("TG"), ident.cast("bigint").alias("I"))

    first = F.when(key % 2 == 0, 4).otherwise(5)
    listed = [sg("Inconnu", key), sg("Fautes", F.lit(0))]  # an unknown name, and a sub-game without an id
    cards = [F.struct(F.when(at == 4, SUBGAMES[4][0]).otherwise(SUBGAMES[5][0]).alias("TG"), (key * 20 + at + 1).cast("bigint").alias("I"))
             for at in (first, 9 - first)]
    listed += cards + [sg(name, key * 20 + i + 1) for i, (name, stat) in enumerate(SUBGAMES) if stat != "cards"] + [sg("Corners", key)]
    main = src.spread(src.table(spark, sf_dir, "part"), "p_partkey").select(
        key.alias("event_id"), F.concat(F.lit("Home "), key.cast("string")).alias("home_team"),
        F.concat(F.lit("Away "), key.cast("string")).alias("away_team"), F.lit("L").alias("competition"),
        F.lit("2001-01-01 12:00:00").cast("timestamp").alias("start_time"), F.lit("u").alias("url"),
        F.lit(None).cast("timestamp").alias("scraped_at"), F.to_json(F.struct(F.array(*listed).alias("SG"))).alias("payload"))
    over, sc = F.col("selection") == "over", F.col("team_scope")
    g = F.when(sc == "home", 15).when(sc == "away", 62).otherwise(17)
    t = F.when(sc == "home", F.when(over, 11).otherwise(12)).when(sc == "away", F.when(over, 13).otherwise(14)).otherwise(
        F.when(over, 9).otherwise(10))

    def entry(gg, tt, p):
        return F.struct(gg.cast("int").alias("G"), tt.cast("int").alias("T"), p.alias("P"), F.col("odds").alias("C"))

    none = F.lit(None).cast("double")
    number = F.floor(F.col("ingest_seq") / 10000) % 12
    subs = q.select(
        (F.col("match_id").cast("bigint") * 20 + number + 1).alias("sub_id"), (F.col("ingest_seq") % 1000003).alias("feed_seq"),
        F.to_json(F.struct(F.array(entry(g, t, F.col("line")), entry(g, t, none), entry(F.lit(1), F.lit(1), F.col("line"))).alias("E"))).alias("payload"))
    return S.stat_subgame_explode(main, subs).select("home_team", "market_type", "selection", "line", "team_scope", "odds")


def _event_pages(spark, sf_dir):
    """An event page per line item: two markets, three selections."""
    li = src.spread(src.table(spark, sf_dir, "lineitem"), "l_orderkey")
    price = F.translate(F.format_string("%.2f", F.col("l_quantity") / 10), ".", ",")

    def item(name, odds):
        return F.concat(F.lit('<hg-event-bet-type-item id="x"><span class="name">'), name, F.lit('</span><span class="odds">'),
                        odds, F.lit("</span></hg-event-bet-type-item>"))

    def block(title, *items):
        return F.concat(F.lit('<div class="bet-type"><span class="bet-type-infos">'), title,
                        F.lit('</span></div><div class="groups"><div class="group">'), *items, F.lit("</div></div>"))

    body = F.concat(
        F.lit('<div class="page-content"><hg-event><span class="name">Home '), F.col("l_partkey").cast("string"), F.lit(" - Away "),
        F.col("l_suppkey").cast("string"), F.lit("</span></hg-event><hg-event-categories>Ligue <b>"), (F.col("l_partkey") % 10).cast("string"),
        F.lit("</b></hg-event-categories><p>Match du "), F.date_format(F.col("l_shipdate"), "dd/MM/yyyy"), F.lit(" a 18h"),
        F.lpad((F.col("l_linenumber") * 7).cast("string"), 2, "0"), F.lit("</p>"),
        block(F.lit("Nombre de buts"), item(F.lit("> 0.5"), price), item(F.lit("< 0.5"), F.lit("13"))),
        block(F.lit("Résultat &amp; match"), item(F.lit("X"), F.lit("N/A"))), F.lit("</div>"))
    return li.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("page_id"),
        F.concat(F.lit("/sports/event/a-b-m"), F.col("l_partkey").cast("string")).alias("url"), body.alias("html"))


@query("s07_html_market_extract", """
SELECT l_orderkey * 8 + l_linenumber AS page_id, title, label AS selection_label,
  CASE kind WHEN 1 THEN replace(format('{:.2f}', l_quantity / 10), '.', ',') WHEN 2 THEN '13' ELSE 'N/A' END AS odds_text
FROM lineitem CROSS JOIN (VALUES ('Nombre de buts', '> 0.5', 1), ('Nombre de buts', '< 0.5', 2), ('Résultat & match', 'X', 3)) v(title, label, kind)""")
def page_markets(spark, sf_dir):
    return X.html_market_extract(_event_pages(spark, sf_dir)).select("page_id", "title", "selection_label", "odds_text")


@query("s08_page_start_time", """
SELECT o_orderkey, strftime(CASE o_orderkey % 4
    WHEN 0 THEN date_trunc('day', o_orderdate) + INTERVAL 18 HOURS + INTERVAL 5 MINUTES
    WHEN 1 THEN make_timestamp(CAST(2000 + o_orderkey % 100 AS BIGINT), 3, 14, 9, 30, 0)
    WHEN 2 THEN TIMESTAMP '2001-03-01 00:00:00' + INTERVAL 20 HOURS + INTERVAL 45 MINUTES
    ELSE TIMESTAMP '2001-02-28 07:15:00' END, '%Y-%m-%d %H:%M:%S') AS starts FROM orders""")
def start_time(spark, sf_dir):
    k = F.col("o_orderkey")
    text = (
        F.when(k % 4 == 0, F.concat(F.lit("Match du "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(" a 18:05 <")))
        .when(k % 4 == 1, F.concat(F.lit("14.3."), F.lpad((k % 100).cast("string"), 2, "0"), F.lit(" 9h30")))
        .when(k % 4 == 2, F.lit("Demen 20:45")).otherwise(F.lit("Aujourd'hui 32/13 07:15"))
    )
    return src.table(spark, sf_dir, "orders").select(
        "o_orderkey", stamp(X.page_start_time(text, F.lit("2001-02-28 10:11:12"))).alias("starts"))




@query("s09_event_link_harvest", """
SELECT DISTINCT 'https://site.example' || unnest(regexp_extract_all(concat(html, '<a href="/sports/event/team-', page_id % 40, '-m', page_id % 40,
  '">x</a><a href="/sports/101/y">no</a><a href="/sports/event/club-', page_id % 90, '-m7">z</a>'), '(?i)/sports/event/[a-z0-9-]+m[0-9]+')) AS url
FROM pages""")
def links(spark, sf_dir):
    p = src.table(spark, sf_dir, "pages")
    a, b = (F.col("page_id") % 40).cast("string"), (F.col("page_id") % 90).cast("string")
    tail = F.concat(F.lit('<a href="/sports/event/team-'), a, F.lit("-m"), a, F.lit('">x</a><a href="/sports/101/y">no</a>'),
                    F.lit('<a href="/sports/event/club-'), b, F.lit('-m7">z</a>'))
    return X.event_link_harvest(p.withColumn("html", F.concat("html", tail)), "https://site.example")


def boost_pages(spark, sf_dir):
    """A boost page per part: one group with two offers, or a flat group without a link."""
    k = F.col("p_partkey")
    name = F.concat(F.lit("Home "), k.cast("string"), F.lit(" - Away "), k.cast("string"))
    item = (
        '<div class="manual-odds-with-event-item"><span class="odds-name">{d}</span>'
        '<span class="value">{v}</span><span class="value">{v}</span></div>'
    )
    linked = F.concat(
        F.lit('<div class="manual-odds-boost"><a href="/sports/event/'), k.cast("string"), F.lit('">'), name, F.lit("</a>"),
        F.lit(item.format(d="gagne &amp; les deux equipes marquent", v="4,5")),
        F.lit(item.format(d="obtient 8 corners ou +", v="n/a")), F.lit("</div>"))
    flat = F.concat(
        F.lit('<section class="x manual-odds-boost"><b>'), name, F.lit('</b>: <i class="odds-name">obtient 3 corners ou +</i><i class="y">?</i>'),
        F.lit('<span class="odds">'), F.col("p_size").cast("string"), F.lit("</span></section>"))
    return src.table(spark, sf_dir, "part").select(
        k.alias("page_id"), F.concat(F.lit("<body>"), F.when(k % 2 == 0, linked).otherwise(flat), F.lit("</body>")).alias("html"))


@query("s10_boost_html_extract", """
SELECT p_partkey AS page_id, concat('Home ', p_partkey, ' - Away ', p_partkey) AS match,
  CASE WHEN p_partkey % 2 = 0 THEN concat('/sports/event/', p_partkey) END AS event_url,
  CASE WHEN p_partkey % 2 = 0 THEN 'gagne & les deux equipes marquent' ELSE 'obtient 3 corners ou +' END AS description,
  CASE WHEN p_partkey % 2 = 0 THEN 4.5 ELSE CAST(p_size AS DOUBLE) END AS boosted_odds FROM part""")
def boosts(spark, sf_dir):
    b = X.boost_html_extract(boost_pages(spark, sf_dir))
    return b.select("page_id", "match", "event_url", "description", "boosted_odds")


@query("s11_page_meta", """
SELECT l_orderkey * 8 + l_linenumber AS page_id, concat('Home ', l_partkey) AS home_team, concat('Away ', l_suppkey) AS away_team,
  concat('Ligue ', l_partkey % 10) AS competition,
  strftime(l_shipdate + INTERVAL 18 HOURS + to_minutes(l_linenumber * 7), '%Y-%m-%d %H:%M:%S') AS starts FROM lineitem""")
def meta(spark, sf_dir):
    m = X.page_meta(_event_pages(spark, sf_dir), F.lit("2001-02-28 10:11:12"))
    return m.select("page_id", "home_team", "away_team", "competition", stamp(F.col("start_time")).alias("starts"))


@query("s13_history_scan", with_ctes(HISTORY_SQL, """
SELECT id, match, strftime(date_detection, '%Y-%m-%d %H:%M:%S') AS seen FROM hist"""))
def scan(spark, sf_dir):
    path = scratch_path(spark, "history")
    src.history(spark, sf_dir).drop("copy").write.parquet(path)
    return S.history_scan(spark, path).select("id", "match", stamp(F.col("date_detection")).alias("seen"))


