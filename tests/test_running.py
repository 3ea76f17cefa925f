"""Trailing windows against every row's own window."""

import random
import statistics
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from oddloom.operators.running import trailing_window

START = datetime(2026, 7, 24, 10, 0)


def test_trailing_window(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([None, *range(40)]), rng.choice([None, 7.25, rng.random() * 1e6])) for i in range(300)]
    rows += [(300, "alone", 5, 3.5), (301, "void", 5, None), (302, "edge", 0, 2.0), (303, "edge", 10, 4.0), (304, "edge", 20, 6.0)]
    df = spark.createDataFrame([(i, k, s if s is None else START + timedelta(seconds=s), v) for i, k, s, v in rows],
                               "id int, key string, ts timestamp, v double")
    aggs = {"n": "rows", "mean": "mean", "dev": "deviation"}
    for edge in (True, False):
        for itself in (True, False):
            got = {r["id"]: r for r in trailing_window(df, ["key"], "ts", 10, F.col("v"), aggs, edge, itself).collect()}
            assert set(got) == {i for i, _, s, _ in rows if s is not None}
            for i, key, s, _ in rows:
                if s is None:
                    continue
                span = [v for _, k, at, v in rows if k == key and at is not None and (at >= s - 10 if edge else at > s - 10)
                        and (at <= s if itself else at < s)]
                known = [v for v in span if v is not None]
                assert got[i]["n"] == len(span)
                if known:
                    assert abs(got[i]["mean"] - statistics.fmean(known)) < 1e-6
                    assert abs(got[i]["dev"] - statistics.pstdev(known)) < 1e-6
                else:
                    assert got[i]["mean"] is None and got[i]["dev"] is None


def test_no_frame_slides(spark):
    """A frame with two moving ends is computed anew for every row; both parts of a window only grow."""
    df = spark.range(5).select("id", F.lit("k").alias("key"), F.timestamp_seconds("id").alias("ts"))
    plan = trailing_window(df, ["key"], "ts", 10, F.col("id"), {"n": "rows"})._jdf.queryExecution().executedPlan().toString()
    frames = plan.split("specifiedwindowframe(")[1:]
    assert frames and all(f.startswith("RangeFrame, unboundedpreceding$(), currentrow$()") for f in frames)
