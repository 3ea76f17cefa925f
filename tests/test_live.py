"""Landings as a stream, and the state table of few keys."""

import glob

from pyspark.sql import functions as F

from oddloom.streaming import live as L
from oddloom.streaming.keyed import KeyedTable


def batches(stream, path):
    seen = {}
    L.start(stream, path, lambda b, i: seen.update({i: sorted(r["id"] for r in b.collect())})).awaitTermination()
    return seen


def test_landings_grow_in_files(spark, tmp_path):
    """A landing is cut into files of bounded length, and still is one batch, also beside a short or empty one."""
    parts = [spark.range(0, 1000), spark.range(1000, 1001), spark.range(0), spark.range(2000, 2300)]
    stream = L.landed_stream(parts, f"{tmp_path}/in", file_rows=100)
    lengths = [spark.read.parquet(f).count() for f in glob.glob(f"{tmp_path}/in/part-*")]
    assert len(lengths) == 40 and max(lengths) <= 200 and sum(lengths) == 1301
    seen = batches(stream, f"{tmp_path}/mark")
    assert [seen[i] for i in range(4)] == [list(range(1000)), [1000], [], list(range(2000, 2300))]


def test_few_buckets_are_written_by_several_tasks(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/s", ["key"])
    rows = spark.range(4000).select(F.lit("one").alias("key"), "id", F.create_map(F.lit("a"), "id").alias("m"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # as inside a streaming batch; it would join small shares
    try:
        table.fold(rows, 0, lambda p, b: b)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(glob.glob(f"{tmp_path}/s/data/batch=0/bucket=*/part-*")) > 1
    assert sorted(r["id"] for r in table.read(0).collect()) == list(range(4000))


def test_newest_batches_are_sent_to_the_pool(spark):
    """The pool is not dealt out by bookmaker, however small Spark takes a small table to be."""
    rows = spark.range(1000).selectExpr("id", "concat('b', id % 3) AS bookmaker", "timestamp_seconds(id DIV 100) AS batch_ts")
    key, known = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, "-1")
    try:
        newest = L.latest_contribution(rows)
        assert "SortMergeJoin" not in newest._jdf.queryExecution().executedPlan().toString()
        assert sorted(r["id"] for r in newest.collect()) == list(range(900, 1000))
    finally:
        spark.conf.set(key, known)
