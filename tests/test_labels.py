import random

import pytest
from pyspark.sql import functions as F

from oddloom.functions import text as X
from oddloom.functions.labels import normalize_market_label
from oddloom.operators import normalize as N
from oddloom.plans.label_cases import ACCEPTED, AWAY, HOME, OPEN

SCHEMA = "market_label string, selection_label string, home_team string, away_team string, sport string"


def mapped(spark, rows):
    df = spark.createDataFrame([(*r, *(["football"] if len(r) == 4 else [])) for r in rows], SCHEMA)
    return [r["mapping"] for r in normalize_market_label(df.coalesce(1)).collect()]


def test_accepted_labels(spark):
    got = mapped(spark, [(c[0], c[1], HOME, AWAY, c[6]) for c in ACCEPTED])
    assert [(g["market_type"], g["selection"], g["line"], g["team_scope"]) for g in got] == [c[2:6] for c in ACCEPTED]
    assert all(g["confidence"] >= 0.9 for g in got)
    assert all(g["n_outcomes"] == (3 if g["market_type"].startswith(("1x2", "bb_result")) else 2) for g in got)


def test_open_labels_stay_open(spark):
    for case, g in zip(OPEN, mapped(spark, [(m, s, HOME, AWAY) for m, s in OPEN])):
        assert g is None or g["confidence"] < 0.9, case


def test_n_or_more(spark):
    teams = ("UTA Arad", "ASC Otelul Galati")
    got = mapped(spark, [("Nombre de Corners - ASC Otelul Galati", f"{n} ou +", *teams) for n in (2, 3, 5, 8)]
                 + [("Nombre de tirs cadrés - UTA Arad", "8 ou +", *teams)])
    assert [(g["market_type"], g["selection"], g["line"], g["team_scope"]) for g in got] == [
        ("corners_team", "over", n - 0.5, "away") for n in (2, 3, 5, 8)] + [("shots_on_target_team", "over", 7.5, "home")]


def test_basketball(spark):
    def hoops(m, s):
        return (m, s, "Lakers", "Bulls", "basketball")

    got = mapped(spark, [
        hoops("Vainqueur du match", "1"), hoops("Money Line", "2"), hoops("Resultat du match", "1"), hoops("Vainqueur du match", "X"),
        hoops("Resultat du match (temps reglementaire)", "X"), hoops("Vainqueur (sans prolongation)", "1"),
        hoops("Total de points", "Plus de 180.5")])
    assert [(g["market_type"], g["selection"], g["n_outcomes"]) if g else None for g in got] == [
        ("bb_moneyline", "home", 2), ("bb_moneyline", "away", 2), ("bb_moneyline", "home", 2), None, ("bb_result_reg", "draw", 3),
        ("bb_result_reg", "home", 3), ("points_total", "over", 2)]


def test_odds_text(spark):
    df = spark.createDataFrame([("1,57",), ("13",), ("0,95",), ("N/A",), (" 1 250,5 ",)], "t string")
    assert [r[0] for r in df.coalesce(1).select(X.parse_odds_value(F.col("t"))).collect()] == [1.57, 13.0, None, None, 1250.5]


def test_names_and_ids(spark):
    r = spark.range(1).select(
        X.normalize_team_name(F.lit("  São-Paulo  F.C. ﬁ Ĳ")).alias("n"),
        X.make_match_id(F.lit("Como"), F.lit("Paris FC"), F.lit("2026-07-24 23:30:00").cast("timestamp")).alias("a"),
        X.make_match_id(F.lit("COMO "), F.lit("Pàris  fc"), F.lit("2026-07-24 01:30:00").cast("timestamp")).alias("b"),
        X.make_match_id(F.lit("Como"), F.lit("Paris FC"), F.lit("2026-07-25 01:30:00").cast("timestamp")).alias("c"),
        X.canonical_email(F.lit("A.b+x@GoogleMail.com")).alias("m"), X.canonical_email(F.lit("A.b+x@Mail.org")).alias("o")).first()
    assert r["n"] == "sao paulo f c fi ij" and r["a"] == r["b"] != r["c"] and len(r["a"]) == 16
    assert (r["m"], r["o"]) == ("ab@gmail.com", "a.b+x@mail.org")


@pytest.mark.parametrize("reply,ok", [
    ('Bien: {"market_type": "x", "selection": "over", "line": 2.5, "confidence": 0.9} fin', True),
    ('{"market_type": "x", "selection": "over", "line": null, "confidence": 1}', True),
    ('{"market_type": "x", "selection": "maybe", "confidence": 0.9}', False),
    ('{"market_type": "x", "selection": "over", "confidence": 1.5}', False),
    ('{"market_type": "", "selection": "over", "confidence": 0.5}', False),
    ('{"market_type": 5, "selection": "over", "confidence": 0.5}', False),
    ('{"market_type": "x", "selection": "over", "line": "abc", "confidence": 0.5}', False),
    ('{"market_type": "x", "selection": "over"', False), ("rien", False)])
def test_reply(spark, reply, ok):
    got = spark.createDataFrame([(reply,)], "r string").select(N.reply_validate(F.col("r")).alias("m")).first()["m"]
    assert (got is not None) == ok


def test_budget_denials_do_not_consume(spark):
    times = [0, 10, 20, 3600, 3601, 3611, 9000, 9001, 9002]
    df = spark.createDataFrame([(i, "k", t) for i, t in enumerate(times)], "id int, who string, s int").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["id"]: r["granted"] for r in N.hourly_budget_flag(df, 2, ["who"]).collect()}
    calls, want = [], {}
    for i, t in enumerate(times):
        calls = [c for c in calls if t - c <= 3600]
        want[i] = len(calls) < 2
        if want[i]:
            calls.append(t)
    assert got == want


def test_raw_rows_become_quotes(spark):
    df = spark.createDataFrame([
        ("football", "Resultat du match", "1", "Ghana", "Colombie", "1,57"), ("football", "Resultat du match", "X", "Ghana", "Colombie", "0,9"),
        ("football", "Score exact", "1:0", "Ghana", "Colombie", "7")],
        "sport string, market_label string, selection_label string, home_team string, away_team string, odds_text string",
    ).withColumn("start_time", F.lit("2026-07-24 10:00:00").cast("timestamp"))
    rows = N.raw_to_quotes(df).collect()
    assert [(r["market_type"], r["selection"], r["odds"]) for r in rows] == [("1x2", "home", 1.57)]


def plain_partial(a, b):
    from oddloom.functions import similarity as sim

    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short or not long:
        return 100.0 if not long else 0.0
    sides = [(short, long), (long, short)] if len(a) == len(b) else [(short, long)]
    return max(sim._ratio(s, t[max(0, i):i + len(s)]) for s, t in sides for i in range(1 - len(s), len(t)))


def test_windows_in_step_equal_one_by_one():
    from oddloom.functions import similarity as sim

    rng = random.Random(6)
    texts = ["".join(rng.choice("abc é") for _ in range(rng.randint(0, 12))) for _ in range(60)] + ["a" * 64, "ab" * 33, "b" * 70]
    pairs = [(rng.choice(texts), rng.choice(texts)) for _ in range(1500)]
    assert sim._partial_scores(pairs) == pytest.approx([plain_partial(a, b) for a, b in pairs])


def test_scope_decided_without_scoring_is_the_same(spark):
    rng = random.Random(7)
    names = ["".join(rng.choice("abcd ") for _ in range(rng.randint(0, 9))).strip() for _ in range(40)] + ["Ghana", "FC Ghana"]
    rows = [(rng.choice(["Total ", "", "x "]) + rng.choice(names), rng.choice([*names, None]), rng.choice([*names, None])) for _ in range(900)]

    def key(text):
        from oddloom.constants import TEAM_ALIASES

        k = " ".join((text or "").lower().split())
        return TEAM_ALIASES.get(k, k)

    want = []
    for label, home, away in rows:
        h, a = (plain_partial(key(label), key(n)) for n in (home, away))
        want.append(None if max(h, a) < 85 else "home" if h >= a else "away")
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, label string, home string, away string")
    got = [r["team_scope"] for r in N.team_scope_in_label(df, "label", "home", "away").orderBy("id").collect()]
    assert got == want and len({*want}) == 3


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_scope_reads_each_text_once(spark):
    """The canonical forms are worked out once a row, not again for every letter compared."""
    df = spark.createDataFrame([("Total Ghana", "Ghana", "Colombie")], "label string, home string, away string")
    scoped = N.team_scope_in_label(df, "label", "home", "away")
    assert scoped.first()["team_scope"] == "home"
    assert plan_of(scoped).count("regexp_replace") <= 6


def test_cache_join_normalises_once(spark):
    df = spark.createDataFrame([("football", "Nombre de buts", "> 2.5", "Ghana", "Colombie")], "sport string, market_label string, selection_label string, home_team string, away_team string")
    cache = spark.createDataFrame([], "cache_key string, market_type string, selection string, line double, team_scope string, confidence double")
    out = N.normalization_cache_join(N.normalize_market_label(df), cache)
    assert [(r["source"], r["mapping"]["market_type"]) for r in out.collect()] == [("rule", "goals_total")]
    assert "rlike" not in plan_of(out).lower()
