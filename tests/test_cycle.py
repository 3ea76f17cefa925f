"""Scores, alerts, history, and the continuous mode against its batch twin."""

import random
from datetime import datetime, timedelta

import pytest
from helpers import AS_OF, quotes
from pyspark.sql import functions as F

from oddloom.operators import alerts as P
from oddloom.operators import arbitrage as A
from oddloom.operators import history as H
from oddloom.operators import running as R
from oddloom.sinks import tables as O
from oddloom.streaming import live as T

THREE = [("a", "1x2", "home", None, 3.55), ("b", "1x2", "draw", None, 3.90), ("c", "1x2", "away", None, 3.30)]
TWO = [("b", "goals_total", "over", 2.5, 2.16), ("a", "goals_total", "under", 2.5, 2.00)]


def found(spark, rows, at=AS_OF):
    return A.evaluate(quotes(spark, rows), bankroll=1000.0, reconcile=False, detected_at=F.lit(str(at)))


def test_scores(spark):
    def score(rows, age):
        return P.score_opportunity(found(spark, rows), F.lit(str(AS_OF + timedelta(seconds=age)))).first()["score_ia"]

    assert score(TWO, 0) == 92 and score(TWO, 180) < 70
    assert score([(b, m, s, li, 5.0) for b, m, s, li, _ in THREE], 0) == 0


def test_alerts(spark):
    o = P.score_opportunity(found(spark, TWO), F.lit(str(AS_OF)))
    assert P.should_alert(o, 3.0).count() == 1 and P.should_alert(o, 5.0).isEmpty()
    assert P.should_alert(o, 3.0, only_bookmaker=" B ").count() == 1 and P.should_alert(o, 3.0, only_bookmaker="z").isEmpty()
    assert P.should_alert(found(spark, TWO)).isEmpty()  # never scored
    text = P.alert_text(o.withColumn("match_label", F.lit("A & <B>"))).first()["text"]
    assert "A &amp; &lt;B&gt;" in text and "SUREBET 3.85%" in text and "miser <code>481</code>" in text


def wide(spark, rows, ident, at=AS_OF):
    w = H.legs_to_wide(P.score_opportunity(found(spark, rows, at), F.lit(str(at)))).withColumn("id", F.lit(ident))
    return spark.createDataFrame(w.collect(), w.schema)


def test_history_rules(spark):
    two, three = wide(spark, TWO, 1), wide(spark, THREE, 2)
    assert two.first()["bookmaker_c"] is None and three.first()["cote_c"] == 3.30
    assert two.first()["final_balance"] == pytest.approx(1000 + two.first()["profit"])
    assert P.drop_exact_duplicates(two, two).isEmpty()
    drift = wide(spark, [("b", "goals_total", "over", 2.5, 2.20), TWO[1]], 3)
    assert P.drop_exact_duplicates(drift, two).count() == 1
    flags = {r["id"]: r["alertable"] for r in P.first_signal_per_match(drift, two).collect()}
    assert flags == {3: False}
    both = two.unionByName(three)
    assert [r["alertable"] for r in P.first_signal_per_match(both, two.limit(0)).orderBy("roi_pct").collect()] == [False, True]
    c = P.cycle_counters(both.unionByName(drift), two).first()
    assert c.asDict() == {"detected": 3, "duplicates": 1, "silent": 2, "alerted": 0}


def test_history_file_and_reports(spark, tmp_path):
    rows = wide(spark, TWO, 1).unionByName(wide(spark, THREE, 2, AS_OF + timedelta(hours=1)))
    O.append_history(rows, str(tmp_path / "h"))
    O.append_history(rows, str(tmp_path / "h"), rows)
    back = spark.read.parquet(str(tmp_path / "h"))
    assert back.count() == 2
    curve = H.bankroll_curve(back).orderBy("t").collect()
    assert [r["cumulative_profit"] for r in curve] == pytest.approx([38.46, 38.46 + 188.88], abs=0.02)
    assert {(r["bookmaker"], r["indispensable"]) for r in H.bookmaker_value(back, F.lit("2026-08-01")).collect()} == {("a", 1), ("b", 1), ("c", 0)}
    O.report_file(found(spark, TWO), str(tmp_path / "r"))
    line = spark.read.option("header", True).csv(str(tmp_path / "r")).first()
    assert len(line) == 20 and line["MATCH"] == "Ghana - Colombie" and line["BOOKMAKER C"] is None


def test_running_helpers_equal_plain_windows(spark):
    rng = random.Random(1)
    rows = [(i, "hot" if rng.random() < 0.4 else f"k{rng.randrange(9)}", rng.randrange(200), rng.randrange(1, 50)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, k string, t int, v int")
    got = {r["id"]: r["s"] for r in R.running_sums(df, ["t", "id"], {"s": F.col("v").cast("bigint")}, by=["k"]).collect()}
    total, want = {}, {}
    for i, k, t, v in sorted(rows, key=lambda r: (r[2], r[0])):
        total[k] = want[i] = total.get(k, 0) + v
    assert got == want
    mid = {r["k"]: (r["lower_middle"], r["upper_middle"]) for r in R.middle_values(df, ["k"], "v").collect()}
    for k in total:
        vs = sorted(v for _, kk, _, v in rows if kk == k)
        assert mid[k] == (vs[(len(vs) - 1) // 2], vs[len(vs) // 2])


def log_rows(rng, n):
    out, t = [], datetime(2026, 1, 1)
    for i in range(n):
        t += timedelta(seconds=rng.randrange(1, 200))
        book = "hot" if rng.random() < 0.4 else rng.choice(["x", "dead"])
        out.append((i, book, t, book != "dead" and rng.random() < 0.4, rng.randrange(50), None))
    return out


def replay(rows):
    state, alerts = {}, []
    for _, book, t, ok, n, _ in rows:
        s = state.setdefault(book, dict(last_ok=None, last_fail=None, streak=0, cycles=0, quotes=0, alerted=False))
        s["cycles"] += 1
        if ok:
            s.update(last_ok=t, streak=0, alerted=False)
            s["quotes"] += n
            continue
        s["last_fail"], s["streak"] = t, s["streak"] + 1
        late = s["last_ok"] is not None and (t - s["last_ok"]).total_seconds() > 300
        if (late or (s["last_ok"] is None and s["streak"] >= 3)) and not s["alerted"]:
            s["alerted"] = True
            alerts.append((book, t))
    return state, alerts


LOG = "event_id int, bookmaker string, ts timestamp, ok boolean, n_quotes int, reason string"


def land(spark, folder, rows, schema, parts):
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size:(i + 1) * size], schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_health_and_outages_over_many_batches(spark, tmp_path):
    rows = log_rows(random.Random(4), 600)
    state, alerts = replay(rows)
    stream = land(spark, str(tmp_path / "in"), rows, LOG, 6)
    run = T.health_stream(stream, str(tmp_path / "h"), str(tmp_path / "hc"))
    run.awaitTermination()
    got = {r["bookmaker"]: r for r in T.latest(spark, str(tmp_path / "h"), run).collect()}
    for book, s in state.items():
        assert {k: got[book][k] for k in ("last_ok", "last_fail", "streak", "cycles", "quotes")} == {k: v for k, v in s.items() if k != "alerted"}
    T.outage_stream(stream, str(tmp_path / "o"), str(tmp_path / "oc")).awaitTermination()
    rows_out = spark.read.parquet(str(tmp_path / "o" / "alerts")).collect()
    assert sorted((r["bookmaker"], r["alert_ts"]) for r in rows_out) == sorted(alerts)
    twin = T.outage_alert_once(spark.createDataFrame(rows, LOG)).collect()
    assert sorted((r["bookmaker"], r["alert_ts"]) for r in twin) == sorted(alerts)


def test_live_pool_replaces_whole_batches(spark, tmp_path):
    folder = str(tmp_path / "in")
    first = quotes(spark, TWO + THREE).withColumn("batch_ts", F.lit("2026-07-24 10:00:00").cast("timestamp"))
    second = quotes(spark, [("a", "goals_total", "under", 2.5, 2.05)]).withColumn("batch_ts", F.lit("2026-07-24 10:00:30").cast("timestamp"))
    for df in (first, second):
        df.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    run = T.live_pool(stream, str(tmp_path / "p"), str(tmp_path / "pc"))
    run.awaitTermination()
    pool = T.latest(spark, str(tmp_path / "p"), run)
    assert sorted((r["bookmaker"], r["odds"]) for r in pool.collect()) == [("a", 2.05), ("b", 2.16), ("b", 3.9), ("c", 3.3)]
    loop = T.evaluation_loop(stream, str(tmp_path / "e"), str(tmp_path / "ec"), None, bankroll=1000.0, reconcile=False)
    loop.awaitTermination()
    last = T.latest_version(spark, str(tmp_path / "e" / "opportunities"), loop)
    assert [r["market_type"] for r in last.collect()] == ["goals_total"]


def test_stream_dedup_over_batches(spark, tmp_path):
    a, b = wide(spark, TWO, 1), wide(spark, TWO, 2, AS_OF + timedelta(minutes=1))
    c = wide(spark, [("b", "goals_total", "over", 2.5, 2.20), TWO[1]], 3, AS_OF + timedelta(minutes=2))
    folder = str(tmp_path / "in")
    for df in (a, b, c):
        df.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(a.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    T.stream_dedup(stream, str(tmp_path / "h"), str(tmp_path / "hc")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "h")).orderBy("id").collect()
    assert [(r["id"], r["alertable"]) for r in rows] == [(1, True), (3, False)]


def test_evict_stale_drops_late_rows(spark, tmp_path):
    folder = str(tmp_path / "in")
    # the watermark a batch applies is the one the batch before it started with
    times = [AS_OF + timedelta(seconds=x) for x in (0, 200, 201, 10, 190)]
    for i, t in enumerate(times):
        quotes(spark, [("a", "1x2", "home", None, 2.0 + i, {"scraped_at": t, "ingest_seq": i})]).coalesce(1).write.mode("append").parquet(folder)
    schema = spark.read.parquet(folder).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    T.append_files(T.evict_stale(stream, ["bookmaker", "ingest_seq"]), str(tmp_path / "o"), str(tmp_path / "oc")).awaitTermination()
    assert sorted(r["ingest_seq"] for r in spark.read.parquet(str(tmp_path / "o")).collect()) == [0, 1, 2, 4]


def test_snapshot_and_cache(spark, tmp_path):
    df = spark.range(5).withColumnRenamed("id", "x")
    m = {r["name"]: (r["rows"], r["status"]) for r in O.dated_snapshot({"t": df, "gone": None}, str(tmp_path), "2026-01-01").collect()}
    assert m == {"t": (5, "saved"), "gone": (None, "missing")} and spark.read.json(str(tmp_path / "2026-01-01" / "t")).count() == 5
    days = spark.createDataFrame([(f"2026-01-{d:02}",) for d in range(1, 12)], "day string")
    assert sorted(r["day"] for r in O.snapshots_to_drop(days).collect()) == ["2026-01-01", "2026-01-02", "2026-01-03"]
    old = spark.createDataFrame([("a", "x")], "cache_key string, market_type string")
    new = spark.createDataFrame([("a", "y"), ("b", "z")], "cache_key string, market_type string")
    assert sorted(map(tuple, O.cache_insert_if_absent(old, new).collect())) == [("a", "x"), ("b", "z")]


def test_two_way_signals_are_history(spark, monkeypatch):
    import __spark_entry__ as contract
    from oddloom.plans import alert_plans

    early, late = datetime(1992, 5, 1), datetime(1999, 5, 1)
    legs = "Over", 2.1, "a", "Under", 2.1, "b", None, None, None
    rows = [(1, "M2", "football", 2, early, 5.0, 90, *legs), (2, "M2", "football", 2, late, 4.0, 90, *legs),
            (3, "M3", "football", 2, late, 4.0, 90, *legs)]
    h = spark.createDataFrame(rows, """id long, match string, sport string, n_issues int, date_detection timestamp,
        roi_pct double, score_ia int, event_a string, cote_a double, bookmaker_a string, event_b string, cote_b double,
        bookmaker_b string, event_c string, cote_c double, bookmaker_c string""").withColumn("copy", F.lit(0))
    monkeypatch.setattr(alert_plans.src, "history", lambda *_: h)
    jobs = contract.queries()
    first = {r["id"]: r["alertable"] for r in jobs["p09_first_signal_per_match"](spark, "").collect()}
    assert first == {2: False, 3: True}
    assert jobs["p10_cycle_counters"](spark, "").first().asDict() == dict(
        detected=2, duplicates=1, silent=0, alerted=1)


def test_cycle_from_quotes_to_alerts(spark):
    from oddloom.operators.cycle import run_cycle

    at, soon = F.lit(str(AS_OF)), AS_OF + timedelta(seconds=30)
    late = {"match_id": "m2", "home_team": "Lyon", "away_team": "Nice", "scraped_at": AS_OF - timedelta(seconds=90)}
    begun = {"match_id": "m3", "home_team": "Metz", "away_team": "Lens", "start_time": AS_OF - timedelta(minutes=1)}
    rows = THREE + TWO + [(*r, late) for r in TWO] + [(*r, begun) for r in TWO]
    pool = quotes(spark, [(*r[:5], {"match_id": "other", "home_team": "FC Ghana"}) if i == 1 else r for i, r in enumerate(rows)])
    first = run_cycle(pool, wide(spark, TWO, 1).limit(0), at, bankroll=1000.0)
    got = [(r["n_issues"], r["alertable"], r["alert"]) for r in first.orderBy("n_issues").collect()]
    assert got == [(2, False, False), (3, True, True)]  # old and begun ones are out, spellings joined, the better one signals
    stored = spark.createDataFrame(first.collect(), first.schema)
    again = run_cycle(pool, stored, at, bankroll=1000.0)
    assert again.isEmpty()
    moved = quotes(spark, [("b", "goals_total", "over", 2.5, 2.20, {"scraped_at": soon}), (*TWO[1], {"scraped_at": soon})])
    later = run_cycle(moved, stored, F.lit(str(soon)), bankroll=1000.0).collect()
    assert [(r["cote_a"], r["alertable"], r["alert"]) for r in later] == [(2.20, False, False)]
