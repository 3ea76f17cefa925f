import json
import re

import pytest
from pyspark.sql import functions as F

from oddloom.sources import feeds as S
from oddloom.sources import html as X


def raw(spark, doc):
    return spark.createDataFrame([(1, json.dumps(doc))], "feed_seq bigint, payload string")


def test_line_feed(spark):
    def e(g, t, c, p=None):
        return {"G": g, "T": t, "C": c, **({"P": p} if p is not None else {})}

    doc = {"Value": [
        {"I": 5, "O1": "Ghana", "O2": "Colombie", "L": "Cup", "S": 1785000000, "E": [
            e(1, 1, 2.5), e(1, 2, 3.1), e(1, 3, 2.9), e(17, 9, 1.8, 2.5), e(17, 10, 2.0, 2.5), e(15, 11, 1.9, 1.5), e(62, 14, 1.9, 1.5),
            e(19, 180, 1.7), e(8, 4, 1.3), e(99, 1, 2.0), e(1, 1, 1.0)]},
        {"I": 6, "O1": "Ghana", "S": 1785000000, "E": [e(1, 1, 2.5)]}, {"I": 7, "O1": "A", "O2": "B", "E": [e(1, 1, 2.5)]}]}
    rows = S.linefeed_explode(raw(spark, doc)).collect()
    assert len(rows) == 8
    assert [(r["market_type"], r["selection"], r["team_scope"]) for r in rows if r["market_type"] == "goals_team"] == [
        ("goals_team", "over", "home"), ("goals_team", "under", "away")]
    assert len({r["match_id"] for r in rows}) == 1 and rows[0]["url"].endswith("/line/football/5")
    assert S.linefeed_explode(spark.createDataFrame([(1, "not json")], "feed_seq bigint, payload string")).isEmpty()


def test_tree_feed(spark):
    def ev(t, n, p):
        return {"type": t, "name": n, "price": p}

    game = {"id": 100, "team1_name": "Keilor Park SC", "team2_name": "Bayside", "start_ts": 1785000000, "market": {
        "1": {"type": "P1XP2", "event": {"1": ev("P1", "W1", 2.52), "2": ev("X", "Draw", 3.61), "3": ev("P2", "W2", 2.34)}},
        "2": {"type": "OverUnder", "event": {"4": ev("Over", "Over 2.5", 1.85), "5": ev("Under", "Under 2.5", 1.95)}},
        "3": {"type": "BothTeamsToScore", "event": {"6": ev("Yes", "Yes", 1.72), "7": ev("No", "No", 2.05)}},
        "4": {"type": "ExoticUnknownMarket", "event": {"8": ev("P1", "x", 5.0)}},
        "5": {"type": "CornersOverUnder", "event": {"9": ev("Over", "Over 9.5", 1.0), "10": ev("Exact", "9", 3.0)}}}}
    rows = S.tree_flatten(raw(spark, {"sport": {"1": {"competition": {"10": {"name": "NPL", "game": {"100": game}}}}}})).collect()
    assert len(rows) == 7 and {r["market_type"] for r in rows} == {"1x2", "goals_total", "btts"}
    assert {r["line"] for r in rows if r["market_type"] == "goals_total"} == {2.5}
    assert {r["competition"] for r in rows} == {"NPL"}


@pytest.mark.parametrize("name,want", [
    ("CornersOverUnder", ("corners_total", None)), ("HomeTeamCornersOverUnder", ("corners_team", "home")),
    ("YellowCardsOverUnder", ("cards_total", None)), ("HomeTeamYellowCardsOverUnder", ("cards_team", "home")),
    ("AwayTeamYellowCardsOverUnder", ("cards_team", "away")), ("ShotsOnTargetOverUnder", ("shots_on_target_total", None)),
    ("TotalShotsOverUnder", ("shots_total", None)), ("GoalKicksOverUnder", ("goalkicks_total", None)),
    ("HalfTimeFoulsOverUnder", ("fouls_total_1h", None)), ("2ndHalfCardsOver/Under", ("cards_total_2h", None)),
    ("AsianHandicap", None), ("CornerOddEven", None), ("CorrectScore", None), ("HalfTimeResult", ("1x2_1h", None))])
def test_tree_market_names(spark, name, want):
    r = S.tree_market_resolve(spark.createDataFrame([(name,)], "type string")).first()["resolved"]
    assert (r and (r["market_type"], r["team_scope"])) == want


def test_grouped_feed(spark):
    def market(tp, pn, outs, nm="M", vl=""):
        return {"tp": tp, "pn": pn, "nm": nm, "vl": vl, "ou": [{f"[{i}]": {"nm": n, "kf": k, "vl": v}} for i, (n, k, v) in enumerate(outs)]}

    mr = {
        "h1": market(2, "MainTime", [("Win1", 1.73, ""), ("Draw", 4.28, ""), ("Win2", 4.12, "")]),
        "h2": market(2, "Half1", [("Win1", 2.5, "")]), "t1": market(4, "MainTime", [("Over", 1.85, "2.5"), ("Under", 1.95, "2.5")]),
        "tt": market(5, "MainTime", [("Over", 2.05, "")], vl="1.5"), "xx": market(2, "OvertimePenalties", [("Win1", 9.0, "")]),
        "zz": market(999, "MainTime", [("Win1", 3.0, "")]), "nn": market(998, "MainTime", [("Over", 1.9, "3.5")], nm="CornersTeam2Total")}
    doc = {"1": [{"trn": "", "ctn": "Clubs", "events": [
        {"id": "17", "nm": "Como - Paris FC", "cms": ["Como", "Paris FC"], "tm": "2026-07-24T08:30:00Z", "mr": mr},
        {"id": "18", "nm": "Lyon - Nice - B", "tm": "2026-07-24T10:30:00+02:00", "mr": {"h": market(15, "MainTime", [("Yes", 1.5, "")])}},
        {"id": "19", "nm": "No time", "tm": "soon", "mr": mr}]}], "2": []}
    rows = S.grouped_feed_flatten(raw(spark, doc)).collect()
    got = sorted((r["market_type"], r["selection"], r["line"], r["team_scope"]) for r in rows if r["home_team"] == "Como" and r["line"])
    assert got == [("corners_team", "over", 3.5, "away"), ("goals_team", "over", 1.5, "home"), ("goals_total", "over", 2.5, None),
                   ("goals_total", "under", 2.5, None)]
    assert sum(r["home_team"] == "Como" for r in rows) == 8 and {r["competition"] for r in rows} == {"Clubs"}
    lyon = [r for r in rows if r["home_team"] == "Lyon"]
    assert len(lyon) == 1 and lyon[0]["away_team"] == "Nice - B" and lyon[0]["start_time"].hour == 8


def test_stat_subgames(spark):
    main = spark.createDataFrame([(1, "A", "B", "L", "u", json.dumps({"SG": [
        {"TG": "Tirs Cadrés", "I": 7}, {"TG": "Corners", "I": 8}, {"TG": "CORNERS", "I": 9}, {"TG": "Autre", "I": 5}]}))],
        "event_id int, home_team string, away_team string, competition string, url string, payload string",
    ).withColumn("start_time", F.lit("2026-07-24").cast("timestamp")).withColumn("scraped_at", F.lit(None).cast("timestamp"))
    entries = [{"G": 17, "T": 9, "P": 9.5, "C": 1.8}, {"G": 17, "T": 10, "P": 9.5, "C": 1.9}, {"G": 15, "T": 11, "P": 4.5, "C": 1.8},
               {"G": 62, "T": 14, "P": 4.5, "C": 1.8}, {"G": 17, "T": 9, "C": 1.8}, {"G": 1, "T": 1, "P": 1, "C": 3}]
    subs = spark.createDataFrame([(i, 1, json.dumps({"E": entries})) for i in (5, 7, 8, 9)], "sub_id bigint, feed_seq bigint, payload string")
    rows = S.stat_subgame_explode(main, subs, ["corners"]).collect()
    assert sorted((r["market_type"], r["team_scope"] or "") for r in rows) == [
        ("corners_team", "away"), ("corners_team", "home"), ("corners_total", ""), ("corners_total", "")]


EVENT = (
    '<div class="page-content"><div class="bet-type"><span class="bet-type-infos">Résultat du match</span></div><div class="groups">'
    '<hg-event-bet-type-item id="a"><span class="name">1</span><span class="odds">1,57</span></hg-event-bet-type-item></div>'
    '<div class="bet-type"><span class="bet-type-infos">Nombre de buts</span></div><div class="groups">'
    '<hg-event-bet-type-item id="EventBetTypeItem_1_> 2.5"><span class="name">> 2.5</span><span class="odds">1,78</span></hg-event-bet-type-item>'
    '<hg-event-bet-type-item id="EventBetTypeItem_1_< 2.5"><span class="name">< 2.5</span><span class="odds">1,90</span></hg-event-bet-type-item>'
    '<hg-event-bet-type-item><span class="name">seul</span></hg-event-bet-type-item></div></div>')


def pages(spark, *docs):
    return spark.createDataFrame([(i, "u", d) for i, d in enumerate(docs)], "page_id int, url string, html string")


def test_event_page(spark):
    rows = X.html_market_extract(pages(spark, EVENT, "<div></div>")).orderBy("m", "i").collect()
    assert [(r["title"], r["selection_label"], r["odds_text"]) for r in rows] == [
        ("Résultat du match", "1", "1,57"), ("Nombre de buts", "> 2.5", "1,78"), ("Nombre de buts", "< 2.5", "1,90")]


def test_boost_page(spark):
    doc = """<div class="manual-odds-boost"><a href="/sports/event/79197883">UTA Arad - ASC Otelul Galati</a>
      <div class="manual-odds-with-event-item"><span class="odds-name">Otelul reussit 8 tirs cadres ou + &amp; obtient 8 corners ou + (source: Opta)</span>
      <span class="value">45</span><span class="value">45</span></div>
      <div class="manual-odds-with-event-item"><span class="odds-name">UTA Arad gagne &amp; les deux equipes marquent</span>
      <span class="value">x</span><span class="value">4.5</span></div></div>"""
    rows = X.boost_html_extract(pages(spark, doc, "<div></div>")).orderBy("i").collect()
    assert [(r["match"], r["event_url"], r["boosted_odds"]) for r in rows] == [
        ("UTA Arad - ASC Otelul Galati", "/sports/event/79197883", 45.0), ("UTA Arad - ASC Otelul Galati", "/sports/event/79197883", 4.5)]
    assert rows[1]["description"] == "UTA Arad gagne & les deux equipes marquent"


@pytest.mark.parametrize("text,want", [
    ("Match du 24/07 a 18:00", "2026-07-24 18:00:00"), ("25/12/2026 20:30", "2026-12-25 20:30:00"), ("01/02/27 09:15", "2027-02-01 09:15:00"),
    ("Aujourd'hui 18:00", "2026-03-04 18:00:00"), ("Demain 21:45", "2026-03-05 21:45:00"), ("Demen 15:00", "2026-03-05 15:00:00"),
    ("Aujourd'hui 20h30", "2026-03-04 20:30:00"), ("32/13 18:00", "2026-03-04 18:00:00"), ("31/02 18:00", "2026-03-04 18:00:00"),
    ("Pas d'horaire ici", "2026-03-04 00:00:00")])
def test_start_time(spark, text, want):
    got = spark.range(1).select(X.page_start_time(F.lit(text), F.lit("2026-03-04 05:06:07")).cast("string")).first()[0]
    assert got == want


def test_links_and_meta(spark):
    doc = '<a href="/sports/event/a-b-m12">x</a><a href="/sports/event/a-b-m12">x</a><a href="/sports/101/">y</a><a href="/sports/event/c-m3">z</a>'
    assert [r["url"] for r in X.event_link_harvest(pages(spark, doc, doc), "https://s.example").collect()] == [
        "https://s.example/sports/event/a-b-m12", "https://s.example/sports/event/c-m3"]
    meta = '<div class="informations"><span class="name">Club - A - B</span></div><div class="categories">Ligue <i>1</i></div> 24/07/2026 18:00'
    r = X.page_meta(pages(spark, meta, "<b>vide</b>"), F.lit("2026-03-04")).collect()
    assert len(r) == 1 and (r[0]["home_team"], r[0]["away_team"], r[0]["competition"]) == ("Club", "A - B", "Ligue 1")
    assert r[0]["start_time"].strftime("%d %H:%M") == "24 18:00"


def test_chosen_sub_games_are_not_broadcast(spark, tmp_path):
    """Events explode into sub-games and so outgrow what their file's size lets expect: both sides are dealt out by sub-game."""
    main = spark.createDataFrame(
        [(1, "A", "B", "L", "u", '{"SG":[{"TG":"Corners","I":7},{"TG":"Fautes","I":8}]}')],
        "event_id long, home_team string, away_team string, competition string, url string, payload string",
    ).withColumn("start_time", F.lit("2001-01-01 12:00:00").cast("timestamp")).withColumn("scraped_at", F.col("start_time"))
    main.write.parquet(f"{tmp_path}/main")
    subs = spark.createDataFrame([(7, 1, '{"E":[{"G":17,"T":9,"P":4.5,"C":1.9}]}')], "sub_id long, feed_seq long, payload string")
    found = S.stat_subgame_explode(spark.read.parquet(f"{tmp_path}/main"), subs)
    assert [(r["market_type"], r["odds"]) for r in found.collect()] == [("corners_total", 1.9)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan


def landed(spark, tmp_path, *docs):
    """Documents read from a file: rows made in the driver would be worked on while planning."""
    path = str(tmp_path / "landed")
    spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "feed_seq bigint, payload string").write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("flatten", [S.tree_flatten, S.grouped_feed_flatten])
def test_feed_methods_are_short_enough_to_be_compiled(spark, tmp_path, capsys, flatten):
    """The JVM never compiles a method of more than 8,000 bytes: every row would be interpreted."""
    df = flatten(landed(spark, tmp_path, {}))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df.explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000


def test_names_of_a_pair(spark):
    names = ["A - B", "A - B - C", " - B", "A - ", "A-B", "", None, "É - ñ  -  x", "  -  "]
    pairs = spark.createDataFrame([(n,) for n in names], "n string").select(*S.split_pair(F.col("n"))).collect()
    assert [tuple(r) for r in pairs] == [("A", "B"), ("A", "B - C"), (None, "B"), ("A", None), (None, None), (None, None), (None, None),
                                         ("É", "ñ  -  x"), (None, None)]


def test_places_count_entries_of_all_levels_before(spark, tmp_path):
    """Blank, missing and dropped elements take their places too; two documents do not share any."""
    def market(n, tp=4):
        return {"tp": tp, "pn": "MainTime", "nm": "M", "vl": "2.5", "ou": [{str(i): {"nm": "Over", "kf": 2.0 + i, "vl": ""}} for i in range(n)]}

    def event(*markets, nm="A - B"):
        return {"id": "1", "nm": nm, "tm": "2026-07-24T08:30:00Z", "mr": {str(i): m for i, m in enumerate(markets)}}

    doc = {"1": [{"ctn": "x", "events": [event(market(2), market(1, 999), market(2)), event(market(3), nm="nobody")]}, {"ctn": "y", "events": []},
                 None, {"ctn": "z", "events": [event(market(1))]}]}
    rows = S.grouped_feed_flatten(landed(spark, tmp_path, doc, doc)).collect()
    assert sorted(r["ingest_seq"] for r in rows) == [(d << 31) + at for d in (0, 1) for at in (0, 1, 3, 4, 8)]
