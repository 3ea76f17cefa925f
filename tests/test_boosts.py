import pytest
from helpers import quotes

from oddloom.operators import boosts as B

HOME, AWAY = "PSG", "Marseille"


def offer(spark, odds, text, match="Real Madrid - Barcelona"):
    return spark.createDataFrame([(1, match, text, float(odds), "/e")],
                                 "boost_id int, match string, description string, boosted_odds double, event_url string")


def conditions(spark, odds, text, match):
    return B.parse_condition(B.parse_boost(offer(spark, odds, text, match))).orderBy("pos").collect()


def test_parse(spark):
    c = conditions(spark, 45, "Otelul reussit 8 tirs cadres ou + & obtient 8 corners ou + (source: Opta)", "UTA Arad - ASC Otelul Galati")
    assert [(x["kind"], x["stat"], x["line"], x["team"]) for x in c] == [("threshold", "shots_on_target", 7.5, None), ("threshold", "corners", 7.5, None)]
    c = conditions(spark, 20, "Viborg gagne & les deux equipes marquent & chaque equipe obtient 6 corners ou +", "Viborg FF - Odense Boldklub")
    assert [x["kind"] for x in c] == ["win", "btts", "threshold"]
    assert c[0]["team"] == "Viborg FF" and c[2]["each_team"] and c[2]["line"] == 5.5
    assert "source" not in conditions(spark, 3, "A gagne (source: x.ie)", "A - B")[0]["raw"]
    c = conditions(spark, 5, "quelque chose d'incomprehensible xyz", "A - B")
    assert c[0]["unknown"]


def price(spark, odds, text, rows, match="Real Madrid - Barcelona"):
    o = offer(spark, odds, text, match)
    q = quotes(spark, rows, home_team="Real Madrid", away_team="FC Barcelona", bookmaker="1xBet")
    p = B.price_condition(B.parse_condition(B.parse_boost(o)), o, q)
    return B.value_boost(o, p).first(), p.orderBy("pos").collect()


def test_pricing(spark):
    text = "Real Madrid gagne & les deux equipes marquent"
    v, _ = price(spark, 3.20, text, [("1xBet", "1x2", "home", None, 1.50), ("1xBet", "btts", "over", None, 1.80)])
    assert v["complete"] and v["fair_odds"] == pytest.approx(2.70) and v["edge_pct"] == pytest.approx(18.52, abs=0.01)
    v, legs = price(spark, 6.0, "Real Madrid gagne & obtient 8 corners ou +", [("1xBet", "1x2", "home", None, 1.5)])
    assert not v["complete"] and v["edge_pct"] is None and v["unpriced_count"] == 1
    assert [x["fair_odds"] for x in legs] == [1.5, None] and legs[1]["detail"] == "corners (ligne 7.5) absent de 1xBet"
    v, legs = price(spark, 2.0, "Inconnue gagne", [("1xBet", "1x2", "home", None, 1.5)], "Equipe Inconnue - Autre")
    assert not v["complete"] and legs[0]["detail"] == "match absent de 1xBet"
    v, legs = price(spark, 9.0, "chaque equipe obtient 6 corners ou +", [
        ("1xBet", "corners_team", "over", 5.5, 2.0, {"team_scope": "home"}), ("1xBet", "corners_team", "over", 5.5, 3.0, {"team_scope": "away"})])
    assert v["fair_odds"] == 6.0 and legs[0]["detail"] == "corners >= 6 chaque equipe"


COND = "boost_id int, pos int, kind string, team string, each_team boolean, stat string, line double, raw string, unknown boolean"


def threshold(stat, line, team=HOME, **kw):
    row = dict(kind="threshold", team=team, each_team=False, stat=stat, line=float(line), raw=f"+{line} {stat}", unknown=False)
    row.update(kw)
    return row


def hedge(spark, odds, conds, rows, bankroll=10_000.0):
    o = offer(spark, odds, "d", f"{HOME} - {AWAY}")
    c = spark.createDataFrame([(1, i, x["kind"], x["team"], x["each_team"], x["stat"], x["line"], x["raw"], x["unknown"]) for i, x in enumerate(conds)], COND)
    q = quotes(spark, rows, home_team=HOME, away_team=AWAY)
    found = B.find_boost_arbitrage(o, q, bankroll, conditions=c).collect()
    return (found[0] if found else None), B.diagnose_boost(o, q, conditions=c).first()["reason"]


H = {"team_scope": "home"}
TWO = [threshold("shots", 3), threshold("fouls", 5)]
POOL = [("1xBet", "shots_team", "under", 3.0, 8.0, H), ("Golcash", "fouls_team", "under", 5.0, 8.0, H)]


def test_hedge_accepts(spark):
    o, reason = hedge(spark, 1.60, TWO, POOL + [("Paryaj Pam", "shots_team", "under", 3.0, 6.0, H)])
    assert o["n_outcomes"] == 3 and o["roi_pct"] == pytest.approx(14.29, abs=0.01) and reason.startswith("COUVRABLE")
    back = [x["stake"] * x["odds"] for x in o["legs"]]
    assert back == pytest.approx([back[0]] * 3) and sum(x["stake"] for x in o["legs"]) == pytest.approx(10_000)
    assert [x["bookmaker"] for x in o["legs"]] == ["Paryaj Lakay", "1xBet", "Golcash"] and o["legs"][0]["selection"] == "funbet"
    o, _ = hedge(spark, 1.60, [threshold("corners", 4, None, raw="Le match compte 5 corners")], [("1xBet", "corners_total", "under", 4.0, 8.0)])
    assert o["n_outcomes"] == 2


REFUSED = [
    (50.0, TWO, [(b, m, s, li, 1.15, x) for b, m, s, li, _, x in POOL], "il manque"),
    (1.6, TWO, POOL[:1], "pas de cote inverse"),
    (1.6, TWO, [("Paryaj Lakay", *r[1:]) for r in POOL], "pas de cote inverse"),
    (1.6, TWO, [("1xBet", "shots_team", "under", 5.0, 8.0, H), POOL[1]], "pas de cote inverse"),
    (1.6, [threshold(None, 3, kind="win"), TWO[1]], POOL, "victoire"),
    (1.6, [threshold("shots", 3, None, each_team=True), TWO[1]], POOL, "chaque equipe"),
    (1.6, [threshold("shots", 3, unknown=True, kind="unknown")], POOL, "non analysable"),
    (2.0, [threshold("shots", 3)], [("1xBet", "shots_team", "under", 3.0, 2.0, H)], "il manque"),
    (1.6, [threshold("shots", 3, None, raw="Marseille reussit 4 tirs")], [("1xBet", "shots_total", "under", 3.0, 8.0)], "nomme une equipe"),
    (1.6, [threshold("shots", 3), threshold("shots", 3)], POOL, ""),
    (1.6, [threshold("shots", i) for i in range(4)], POOL, "4 conditions"),
]
TEAMS = [("Lyon", "Marseille"), ("Bordeaux", "Strasbourg"), ("Chelsea", "Everton"), ("Valencia", "Getafe"), ("Napoli", "Udinese"),
         ("Ajax", "Utrecht"), ("Benfica", "Braga"), ("Celtic", "Dundee"), ("Bochum", "Freiburg"), ("Genk", "Antwerp"), ("Boca", "Huracan")]


def test_hedge_refuses(spark):
    """Every refusal in one run: one offer per case, each on a match of its own."""
    offers, conds, rows = [], [], []
    for i, ((odds, cs, pool, _), (home, away)) in enumerate(zip(REFUSED, TEAMS)):
        offers.append((i, f"{home} - {away}", "d", float(odds), "/e"))
        conds += [(i, j, c["kind"], home if c["team"] else None, c["each_team"], c["stat"], c["line"], c["raw"].replace("Marseille", away), c["unknown"])
                  for j, c in enumerate(cs)]
        rows += [(*r[:5], {**(r[5] if len(r) > 5 else {}), "home_team": home, "away_team": away, "match_id": str(i)}) for r in pool]
    o = spark.createDataFrame(offers, "boost_id int, match string, description string, boosted_odds double, event_url string")
    c, q = spark.createDataFrame(conds, COND), quotes(spark, rows)
    assert B.find_boost_arbitrage(o, q, 10_000.0, conditions=c).isEmpty()
    reasons = {r["boost_id"]: r["reason"] for r in B.diagnose_boost(o, q, conditions=c).collect()}
    for i, case in enumerate(REFUSED):
        assert case[3] in reasons[i], (i, reasons[i])


def test_wanted_stats(spark):
    o = offer(spark, 2, "obtient 8 corners ou + & obtient 2 buts ou +", "A - B")
    r = B.wanted_stats_by_match(B.parse_condition(B.parse_boost(o)), o).first()
    assert (r["home_team"], r["away_team"], r["stats"]) == ("A", "B", "corners,goals")
    assert not B.is_parsable(B.parse_condition(B.parse_boost(offer(spark, 2, "xyz", "A - B")))).first()["parsable"]


def test_offers_are_dealt_out(spark, tmp_path):
    """Texts of offers are read by as many tasks as the session asks for, whatever the files; no offer goes through the driver."""
    from oddloom.plans.boost_plans import offers

    names = [(i, f"old plate {i}", "SMALL", i) for i in range(40)]
    spark.createDataFrame(names, "p_partkey long, p_name string, p_type string, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    o = offers(spark, str(tmp_path))
    assert o._jdf.queryExecution().toRdd().getNumPartitions() == 4
    guarded = B.named_team_guard(B.parse_condition(B.parse_boost(o)), o)
    assert guarded.count() == 61
    assert "BroadcastHashJoin" not in guarded._jdf.queryExecution().executedPlan().toString()
