import random

import pytest
from helpers import AS_OF, START, quote_rows, quotes
from pyspark.sql import functions as F

from oddloom.functions import odds as O
from oddloom.operators import arbitrage as A
from oddloom.operators import pool as B
from oddloom.operators import scout as Q


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def stakes(spark, prices, bankroll, digits):
    df = spark.createDataFrame([(prices,)], "odds array<double>")
    return df.select(O.split_stakes(F.col("odds"), bankroll, digits).alias("s")).first()["s"]


def test_two_way_golden(spark):
    q = quotes(spark, [("Paryaj Pam", "shots_team", "under", 7.5, 2.16), ("Golcash", "shots_team", "over", 7.5, 2.00)])
    o = one(A.find_two_way(q, 1.0, 50_000.0))
    assert o["margin"] == pytest.approx(0.96296, abs=1e-5)
    assert o["roi_pct"] == pytest.approx(3.85, abs=0.01)
    assert o["profit"] == pytest.approx(1923, abs=1)
    assert [leg["selection"] for leg in o["legs"]] == ["over", "under"]
    assert sorted(stakes(spark, [2.16, 2.0], 50_000.0, 2)) == pytest.approx([24038.46, 25961.54], abs=0.01)


def test_three_way_golden(spark):
    q = quotes(spark, [("a", "1x2", "home", None, 3.55), ("b", "1x2", "draw", None, 3.90), ("c", "1x2", "away", None, 3.30)])
    o = one(A.find_three_way(q, 1.0, 50_000.0))
    assert o["margin"] == pytest.approx(0.84113, abs=1e-5)
    assert o["roi_pct"] == pytest.approx(18.8876, abs=1e-3)
    assert o["profit"] == pytest.approx(9443.8, abs=0.1)
    assert stakes(spark, [3.55, 3.90, 3.30], 50_000.0, 2) == pytest.approx([16744.73, 15242.00, 18013.27], abs=0.01)
    whole = stakes(spark, [3.55, 3.90, 3.30], 50_000.0, 0)
    assert sum(whole) == 50_000 and min(s * o for s, o in zip(whole, [3.55, 3.90, 3.30])) > 50_000


def test_one_bookmaker_is_refused_and_two_legs_are_fine(spark):
    rows = [("a", "1x2", "home", None, 3.55), ("a", "1x2", "draw", None, 3.90), ("a", "1x2", "away", None, 3.30)]
    assert A.find_three_way(quotes(spark, rows)).isEmpty()
    rows[2] = ("b", "1x2", "away", None, 3.30)
    assert A.find_three_way(quotes(spark, rows)).count() == 1


def test_same_owner_is_refused_after_best_price_selection(spark):
    rows = [("1xBet", "goals_total", "over", 2.5, 2.2), ("MelBet", "goals_total", "under", 2.5, 2.2),
            ("Golcash", "goals_total", "under", 2.5, 2.1)]
    assert A.find_two_way(quotes(spark, rows)).isEmpty()
    assert A.find_two_way(quotes(spark, rows[:1] + rows[2:])).count() == 1


def test_margin_of_one_is_not_an_arbitrage(spark):
    rows = [("a", "goals_total", "over", 2.5, 2.0), ("b", "goals_total", "under", 2.5, 2.0)]
    assert A.find_two_way(quotes(spark, rows), 0.0).isEmpty()
    assert Q.near_misses(quotes(spark, rows)).count() == 1


def test_variants_never_mix(spark):
    rows = [("a", "bb_moneyline", "home", None, 2.1), ("b", "bb_result_reg", "away", None, 2.1, {"n_outcomes": 3}),
            ("b", "bb_result_reg", "draw", None, 15.0, {"n_outcomes": 3})]
    q = quotes(spark, rows, sport="basketball")
    assert A.find_two_way(q, 0.1).isEmpty() and A.find_three_way(q, 0.1).isEmpty()


def brute_two(group):
    a = [q for q in group if q[2] in ("over", "home")]
    b = [q for q in group if q[2] in ("under", "away")]
    if not a or not b:
        return None
    top_a, top_b = max(a, key=lambda q: q[4]), max(b, key=lambda q: q[4])
    if top_a[0] != top_b[0]:
        return top_a, top_b
    else_a = max((q for q in a if q[0] != top_b[0]), key=lambda q: q[4], default=None)
    else_b = max((q for q in b if q[0] != top_a[0]), key=lambda q: q[4], default=None)
    if else_b is not None and (else_a is None or else_b[4] >= else_a[4]):
        return top_a, else_b
    return (else_a, top_b) if else_a is not None else None


def brute_three(group):
    sides = [[q for q in group if q[2] == s] for s in ("home", "draw", "away")]
    if not all(sides):
        return None
    tops = tuple(max(s, key=lambda q: q[4]) for s in sides)
    if len({q[0] for q in tops}) > 1:
        return tops
    best, low = None, float("inf")
    for h in sides[0]:
        for d in sides[1]:
            for a in sides[2]:
                m = 1 / h[4] + 1 / d[4] + 1 / a[4]
                if len({h[0], d[0], a[0]}) > 1 and m < low:
                    best, low = (h, d, a), m
    return best


def test_best_combos_equal_brute_force_on_skewed_random_pools(spark):
    rng = random.Random(7)
    rows, groups = [], {}
    for i in range(1500):
        match = "hot" if rng.random() < 0.33 else f"m{rng.randrange(120)}"
        three = rng.random() < 0.5
        market, line = ("1x2", None) if three else ("goals_total", rng.choice([1.5, 2.5]))
        pick = rng.choice(["home", "draw", "away"]) if three else rng.choice(["over", "under"])
        book = rng.choice("aaab") if rng.random() < 0.7 else rng.choice("abc")
        row = (book, market, pick, line, rng.choice([1.5, 2.0, 2.5, 3.0, 3.5]))
        rows.append((*row, {"match_id": match}))
        groups.setdefault((match, market, line), []).append((*row, i))
    got = {(r["match_id"], r["market_type"], r["line"]): tuple((x["bookmaker"], x["selection"], x["odds"], x["seq"]) for x in r["legs"])
           for r in A.best_combos(quotes(spark, rows)).collect()}
    want = {}
    for key, group in groups.items():
        combo = (brute_three if key[1] == "1x2" else brute_two)(group)
        if combo:
            want[key] = tuple((q[0], q[2], q[4], q[5]) for q in combo)
    assert got == want
    pairs = {(r["match_id"], r["line"]): r["n_combinations"]
             for r in A.two_way_pair_summary(quotes(spark, rows).filter("market_type = 'goals_total'")).collect()}
    listed = A.two_way_pairs(quotes(spark, rows).filter("market_type = 'goals_total'")).groupBy("match_id", "line").count().collect()
    assert pairs == {(r["match_id"], r["line"]): r["count"] for r in listed}


def test_result_does_not_depend_on_row_or_partition_order(spark):
    rows = quote_rows([(b, "goals_total", s, 2.5, o) for b in "abc" for s in ("over", "under") for o in (2.0, 2.1)])
    from oddloom.schemas import QUOTE_SCHEMA

    first = A.best_combos(spark.createDataFrame(rows, QUOTE_SCHEMA)).collect()
    again = A.best_combos(spark.createDataFrame(rows[::-1], QUOTE_SCHEMA).repartition(7)).collect()
    assert first == again


def test_ranking_skips_started_matches_and_shows_near_misses(spark):
    rows = [("a", "goals_total", "over", 2.5, 1.9), ("b", "goals_total", "under", 2.5, 1.9),
            ("a", "goals_total", "over", 2.5, 2.2, {"match_id": "past", "start_time": AS_OF}),
            ("b", "goals_total", "under", 2.5, 2.2, {"match_id": "past", "start_time": AS_OF})]
    r = one(A.rank_cross_book(quotes(spark, rows), F.lit(str(AS_OF)), reconcile=False))
    assert r["is_arbitrage"] is False and r["market"] == "Total buts 2.5" and [x["stake"] for x in r["legs"]] == [0.0, 0.0]
    assert [x["outcome"] for x in r["legs"]] == ["Plus de 2.5", "Moins de 2.5"]


def test_stake_helpers(spark):
    df = spark.createDataFrame([([2.10, 2.05],)], "o array<double>")
    r = df.select(
        O.roi_percent(F.col("o")).alias("roi"), O.split_stakes(F.col("o"), 1000.0, 0).alias("whole"),
        O.round_to_step(O.split_stakes(F.col("o"), 1000.0, None), 1000).alias("coarse"), O.counter_odd(F.lit(2.10)).alias("c"),
        O.counter_odd(F.lit(1.0)).alias("none"), O.stakes_from_fixed(100.0, -5, F.col("o")).alias("fixed"),
        O.roi_percent(F.array().cast("array<double>")).alias("empty"),
        O.clamp_limits(F.array(F.lit(5.0), F.lit(500.0)), F.array(F.lit(10.0), F.lit(10.0)), F.array(F.lit(100.0), F.lit(100.0))).alias("cl"),
    ).first()
    assert r["roi"] == pytest.approx(3.7349, abs=1e-3) and r["whole"] == [494.0, 506.0]
    assert r["c"] == pytest.approx(1.909, abs=1e-3) and r["none"] is None and r["empty"] == 0.0
    assert r["fixed"] == pytest.approx([100.0, 100 * 2.10 / 2.05]) and r["cl"] == [10.0, 100.0]
    out = df.select(O.realized_outcome(O.round_to_step(O.split_stakes(F.col("o"), 1000.0, None), 1000), F.col("o")).alias("x")).first()["x"]
    assert out["profit"] < 0


def test_trajectory_improves(spark):
    obs = spark.createDataFrame([("m", "goals_total", 9.5, "a:over+b:under", i, 1.0 - i / 1000) for i in range(14)],
                                "match_id string, market_type string, line double, legs_key string, ts int, margin double")
    t = one(Q.margin_trajectory(obs))
    assert len(t["points"]) == 10 and t["is_improving"] and t["points"][0]["ts"] == 4


def test_pool_operators(spark):
    rows = [("a", "1x2", "home", None, 2.0, {"scraped_at": AS_OF}), ("a", "1x2", "draw", None, 2.0, {"scraped_at": START})]
    q = quotes(spark, rows).withColumn("batch_ts", F.col("scraped_at"))
    assert B.fresh_only(q, F.lit("2026-07-24 10:01:00")).count() == 2
    assert B.fresh_only(q, F.lit("2026-07-24 10:01:01")).count() == 1
    assert one(B.latest_contribution(q))["selection"] == "draw"
    assert B.pool_union([q, q.drop("url")], ["a"]).isEmpty()


def test_facts_are_fetched_for_the_legs_alone(spark, monkeypatch):
    """Only quotes in the place of a leg reach the joins, whether quotes have a place or not; the rows stay the same."""
    rows = [(b, "1x2", side, None, odds, {"match_id": str(m), "home_team": f"Home {m}"})
            for m in range(6) for b, side, odds in (("a", "home", 3.55), ("b", "draw", 3.9), ("c", "away", 3.3), ("a", "away", 1.1))]
    plain = quotes(spark, rows).withColumn("ingest_seq", F.when(F.col("match_id") != "0", F.col("ingest_seq")))
    renamed = spark.createDataFrame([("1", "x")], "match_id string, canonical_id string")
    pool = plain.join(renamed, "match_id", "left").withColumn("match_id", F.coalesce("canonical_id", "match_id")).select(*plain.columns)
    combos = A.best_combos(pool)
    few = A.attach_quotes(combos, pool)
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.find("LeftOuter") < plan.find("LeftSemi")
    monkeypatch.setattr(A, "FEW_LEGS", 0)
    many = A.attach_quotes(combos, pool)
    assert "LeftSemi" not in many._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect())) and few.count() == 6
