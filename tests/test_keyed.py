"""State tables of which a batch rewrites what it touches."""

import glob
import random
from collections import Counter

from pyspark.sql import functions as F

from oddloom.streaming.keyed import KeyedTable


def counts(previous, batch):
    new = batch.groupBy("key").agg(F.count("*").alias("n"))
    return new if previous is None else previous.unionByName(new).groupBy("key").agg(F.sum("n").alias("n"))


def test_batches_fold_and_replay(spark, tmp_path):
    rng, want = random.Random(1), Counter()
    table = KeyedTable(spark, str(tmp_path / "s"), ["key"], buckets=8)
    assert table.read(-1) is None
    for batch_id in range(5):
        keys = [f"k{rng.randrange(3 + 10 * batch_id)}" for _ in range(40)]
        want.update(keys)
        batch = spark.createDataFrame([(k,) for k in keys], "key string")
        for _ in range(2 if batch_id % 2 else 1):  # a replay writes the same
            table.fold(batch, batch_id, counts)
        assert {r["key"]: r["n"] for r in table.read(batch_id).collect()} == want
        assert table.touched(batch, batch_id + 1).count() <= len(want)


def test_untouched_buckets_stay_and_old_ones_go(spark, tmp_path):
    path = str(tmp_path / "s")
    table = KeyedTable(spark, path, ["key"], buckets=16)
    every = spark.range(200).select(F.concat(F.lit("k"), "id").alias("key"))
    table.fold(every, 0, counts)
    for batch_id in range(1, 5):
        table.fold(every.limit(1), batch_id, counts)
    assert table.read(4).count() == 200
    assert len(glob.glob(f"{path}/data/batch=0/bucket=*")) == 15  # all but the one that changed
    assert [len(glob.glob(f"{path}/data/batch={i}/bucket=*")) for i in range(1, 5)] == [0, 0, 1, 1]
    assert len(glob.glob(f"{path}/manifest/as_of=*")) == 2


def test_rows_may_vanish(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "s"), ["key"], buckets=4)
    rows = spark.createDataFrame([("a",), ("b",)], "key string")
    table.fold(rows, 0, counts)
    table.fold(rows, 1, lambda p, b: p.limit(0))
    assert table.read(1) is None
    table.fold(rows.limit(0), 2, lambda p, b: counts(p, b))
    assert table.read(2) is None
