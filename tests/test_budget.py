"""The trailing budget against the sequential rule it stands for."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddloom.operators import budget
from oddloom.operators.quality import rate_limit_flags


def plain(times, limit, size):
    """Granted or not, in order; a grant counts while it is younger than ``size``."""
    out, taken = [], []
    for t in times:
        taken = [g for g in taken if t - g < size]
        out.append(len(taken) < limit)
        if out[-1]:
            taken.append(t)
    return out


def cut(times, width):
    parts = {}
    for t in times:
        parts.setdefault(t // width, []).append(t)
    return sorted(parts.items())


@pytest.mark.parametrize("seed", range(6))
def test_summaries_follow_and_compose(seed):
    rng = random.Random(seed)
    for _ in range(150):
        limit, size, span = rng.randint(1, 6), rng.randint(1, 20), rng.randint(1, 3)
        times = sorted(rng.randint(0, rng.choice([3, 30, 120, 600])) for _ in range(rng.randint(1, 120)))
        state, whole, got = np.full((1, limit), budget.FREE), None, []
        for node, part in cut(times, size * span):
            summary = budget.summarise(np.array(part), node * size * span, size, limit)
            flags = [False] * len(part)
            for i in budget.deal(part, state[0].tolist(), size, limit):
                flags[i] = True
            got += flags
            state = budget.follow(state, summary)[1]
            whole = summary if whole is None else (whole[0], whole[1] + (more := budget.follow(whole[2], summary))[0], more[1])
            end = (node + 1) * size * span
            at_once = budget.follow(np.full((1, limit), budget.FREE), whole)[1]
            assert [e for e in at_once[0] if e > end] == [e for e in state[0] if e > end]  # what is still open
        assert got == plain(times, limit, size)


def requests(spark, rows):
    """Rows (key, seconds, id)."""
    return spark.createDataFrame(rows, "who string, s double, id int").withColumn("ts", F.timestamp_micros((F.col("s") * 1e6).cast("long")))


@pytest.mark.parametrize("by, keep_edge, limit", [(["who"], True, 3), (["who"], False, 4), (None, True, 5), (None, False, 1)])
def test_grants_equal_the_sequential_rule(spark, by, keep_edge, limit):
    rng = random.Random(limit)
    rows, at = [], 0.0
    for i in range(2500):  # one key holds most rows; quiet, dense and equal time stamps
        at += rng.choice([0, 0, 1, 5, 20]) if i % 400 < 380 else 150
        rows.append(("hot" if rng.random() < 0.7 else rng.choice(["a", "b", None]), at, i))
    df = requests(spark, rows)
    got = {r["id"]: r["granted"] for r in budget.grant(df, limit, by, 60, keep_edge, span=2, fan=3).collect()}
    want = {}
    for key in {r[0] for r in rows} if by else {0}:
        own = [r for r in rows if not by or r[0] == key]
        flags = plain([round(r[1] * 1e6) for r in own], limit, 60_000_000 + (1 if keep_edge else 0))
        want.update({r[2]: f for r, f in zip(own, flags)})
    assert got == want and 0.02 < sum(got.values()) / len(got) < 0.98


def test_grants_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "2026-01-01 00:00:00", "x"), (3, "2026-01-01 00:00:00", "y")],
                               "id int, t string, granted_by string").withColumn("ts", F.to_timestamp("t"))
    got = {r["id"]: r["granted"] for r in budget.grant(df, 1).collect()}
    assert got == {1: False, 2: True, 3: False}
    assert {r["granted"] for r in budget.grant(df, 0).collect()} == {False}
    assert budget.grant(df.limit(0), 1).count() == 0


def test_blocked_attempts_do_not_count(spark):
    times = [0, 1, 2, 60, 61, 62, 63, 120]
    df = requests(spark, [("u", float(t), i) for i, t in enumerate(times)])
    got = [r["blocked"] for r in rate_limit_flags(df, 2, 60, ["who"], order="id").orderBy("id").collect()]
    assert got == [not f for f in plain(times, 2, 60)] == [False, False, True, False, False, True, True, False]
    over = [r["blocked"] for r in rate_limit_flags(df, 1, 60, ["who"], over=True, order="id").orderBy("id").collect()]
    assert over == got
