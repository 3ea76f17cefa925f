"""Continuous mode: the batch operators applied micro-batch by micro-batch.

State that outlives a batch is a keyed table (``streaming/keyed.py``): a batch
reads and rewrites the buckets of its own keys, a replayed batch writes the
same again, and a lost executor loses nothing. Folding happens per batch with
ordinary aggregations, which combine before the shuffle, so one very busy
bookmaker is not processed by one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..constants import MAX_AGE_S, NEVER_OK_FAILURES, OUTAGE_AFTER_S, TRAJECTORY_KEEP
from ..operators.alerts import DUPLICATE_KEYS, drop_exact_duplicates, first_signal_per_match
from ..operators.arbitrage import evaluate
from ..operators.pool import fresh_only, latest_contribution
from ..operators.running import last_before
from ..operators.scout import TRAJECTORY_KEY, margin_trajectory
from .keyed import KeyedTable, count_files, forget_versions

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_disk_state(spark: SparkSession) -> None:
    """Keep native streaming state on disk instead of the executor heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A landed parquet table as a stream of its files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


#: Rows of a landed file, about; a task writes one file.
FILE_ROWS = 1_000_000


def landed_stream(landings: list[DataFrame], path: str, file_rows: int = FILE_ROWS) -> DataFrame:
    """Landings written one after another and streamed in that order, one landing a batch.

    A trigger takes so many files, so every landing has as many as the largest one needs: few rows are filled up with
    files without rows.
    """
    spark, schema = landings[0].sparkSession, landings[0].schema
    files = max(2, *[-(-rows.count() // file_rows) for rows in landings])
    for i, rows in enumerate(landings, 1):
        rows.repartition(files).write.mode("append").parquet(path)
        for _ in range(i * files - count_files(spark, path)):
            spark.createDataFrame([], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def keyed(path: str, keys: list[str], step: Callable[[DataFrame | None, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A batch function that folds every batch into a keyed state table."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        KeyedTable(batch.sparkSession, path, keys).fold(batch, batch_id, step)

    return apply


def latest(spark: SparkSession, path: str, query: StreamingQuery) -> DataFrame:
    """A keyed state table after the last finished batch of a query."""
    return KeyedTable(spark, path, []).read(query.lastProgress["batchId"])


def latest_version(spark: SparkSession, path: str, query: StreamingQuery) -> DataFrame:
    """What the last finished batch of a query wrote."""
    return spark.read.parquet(f"{path}/v={query.lastProgress['batchId']}")


def start(stream: DataFrame, checkpoint: str, on_batch, interval: str | None = None, mode: str = "append") -> StreamingQuery:
    """Start a query; without an interval it handles what has landed and stops."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).foreachBatch(on_batch)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()


def _merge(previous: DataFrame | None, batch: DataFrame) -> DataFrame:
    return batch if previous is None else previous.unionByName(batch)


def live_pool(stream: DataFrame, path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Table of current quotes, each bookmaker's newest ``batch_ts`` only."""
    return start(stream, checkpoint, keyed(path, ["bookmaker"], lambda p, b: latest_contribution(_merge(p, b))), interval)


def visible(pool: DataFrame, as_of: Column, max_age_s: float = MAX_AGE_S) -> DataFrame:
    """What a reader of the live pool may still see."""
    return fresh_only(pool, as_of, max_age_s)


def evict_stale(stream: DataFrame, identity: list[str], max_age_s: int = MAX_AGE_S) -> DataFrame:
    """Drop quotes later than the watermark and repeats inside it.

    State per quote is dropped once the watermark has passed it.
    """
    return stream.withWatermark("scraped_at", f"{max_age_s} seconds").dropDuplicatesWithinWatermark(identity)


def evaluation_loop(
    stream: DataFrame, path: str, checkpoint: str, interval: str | None = "10 seconds", min_roi: float = 1.0,
    bankroll: float = 50_000.0, reconcile: bool = True,
) -> StreamingQuery:
    """Refresh the pool, evaluate the snapshot when it is not empty, keep one result per cycle."""
    refresh = keyed(f"{path}/pool", ["bookmaker"], lambda p, b: latest_contribution(_merge(p, b)))

    def cycle(batch: DataFrame, batch_id: int) -> None:
        refresh(batch, batch_id)
        pool = KeyedTable(batch.sparkSession, f"{path}/pool", ["bookmaker"]).read(batch_id)
        if pool is not None and not pool.isEmpty():
            found = evaluate(pool.drop("batch_ts"), min_roi, bankroll, reconcile)
            found.write.mode("overwrite").parquet(f"{path}/opportunities/v={batch_id}")
            forget_versions(batch.sparkSession, f"{path}/opportunities", "v=", batch_id)

    return start(stream, checkpoint, cycle, interval)


def independent_cadence(
    sources: dict[str, tuple[DataFrame, str | None]], path: str, checkpoint: str
) -> dict[str, StreamingQuery]:
    """One query, trigger and checkpoint per source; a failing source stops alone."""
    queries = {}
    for name, (stream, interval) in sources.items():
        writer = stream.writeStream.format("parquet").option("path", f"{path}/source={name}").option(
            "checkpointLocation", f"{checkpoint}/{name}")
        writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
        queries[name] = writer.start()
    return queries


# --- bookmaker health -------------------------------------------------------------------

HEALTH = "bookmaker string, last_ok timestamp, last_fail timestamp, streak bigint, cycles bigint, quotes bigint"


def health_state(log: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Last success and failure, failure streak, cycles and quotes per bookmaker.

    The streak counts failures after the last success; two plain aggregations
    find it, and an earlier state adds to it when this log has no success.
    """
    ok, fail = F.col("ok"), ~F.col("ok")
    last = log.groupBy("bookmaker").agg(
        F.max(F.when(ok, F.struct("ts", "event_id"))).alias("ok_at"), F.max(F.when(fail, F.col("ts"))).alias("last_fail"),
        F.count("*").alias("cycles"), F.sum(F.when(ok, F.col("n_quotes")).otherwise(0)).alias("quotes"))
    marks = last.select("bookmaker", "ok_at")
    tail = log.filter(fail).join(marks, "bookmaker").filter(
        F.col("ok_at").isNull() | (F.struct("ts", "event_id") > F.col("ok_at")))
    streaks = tail.groupBy("bookmaker").agg(F.count("*").alias("streak"))
    new = last.join(streaks, "bookmaker", "left").select(
        "bookmaker", F.col("ok_at.ts").alias("last_ok"), "last_fail", F.coalesce("streak", F.lit(0)).alias("streak"), "cycles", "quotes")
    if previous is None:
        return new
    a, b = previous.alias("a"), new.alias("b")
    zero = F.lit(0).cast("bigint")
    return a.join(b, "bookmaker", "full").select(
        "bookmaker", F.coalesce("b.last_ok", "a.last_ok").alias("last_ok"), F.coalesce("b.last_fail", "a.last_fail").alias("last_fail"),
        (F.coalesce("b.streak", zero) + F.when(F.col("b.last_ok").isNull(), F.coalesce("a.streak", zero)).otherwise(zero)).alias("streak"),
        (F.coalesce("a.cycles", zero) + F.coalesce("b.cycles", zero)).alias("cycles"),
        (F.coalesce("a.quotes", zero) + F.coalesce("b.quotes", zero)).alias("quotes"))


def health_stream(stream: DataFrame, path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    return start(stream, checkpoint, keyed(path, ["bookmaker"], lambda p, b: health_state(b, p)), interval)


def outage_alert_once(
    log: DataFrame, after_s: int = OUTAGE_AFTER_S, health: DataFrame | None = None, alerted: DataFrame | None = None
) -> DataFrame:
    """The first failure that raises an alert in every outage.

    An outage is the run of failures after one success. It alerts once, when a
    failure comes more than ``after_s`` after it, or at the third failure of a
    bookmaker that never succeeded. ``health`` and ``alerted`` carry what was
    known before this log.
    """
    spark = log.sparkSession
    known = health if health is not None else spark.createDataFrame([], HEALTH)
    before = known.select("bookmaker", F.col("last_ok").alias("known_ok"), F.col("streak").alias("known_streak"))
    marked = last_before(log, ["bookmaker"], "ts", F.when(F.col("ok"), F.col("ts")), "own_ok")
    fails = marked.filter(~F.col("ok")).join(before, "bookmaker", "left").withColumn(
        "since", F.coalesce("own_ok", "known_ok"))
    late = (F.unix_micros("ts") - F.unix_micros("since")) > after_s * 1_000_000
    slow = fails.filter(F.col("since").isNotNull() & late).groupBy("bookmaker", "since").agg(F.min("ts").alias("alert_ts"))
    order = Window.partitionBy("bookmaker").orderBy("ts", "event_id")
    never = (
        fails.filter(F.col("since").isNull()).withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= NEVER_OK_FAILURES)
        .filter(F.col("rank") + F.coalesce("known_streak", F.lit(0)) >= NEVER_OK_FAILURES)
        .groupBy("bookmaker", "since").agg(F.min("ts").alias("alert_ts"))
    )
    alerts = slow.unionByName(never)
    if alerted is None:
        return alerts
    a, d = alerts.alias("a"), alerted.alias("d")
    same = (F.col("a.bookmaker") == F.col("d.bookmaker")) & F.col("a.since").eqNullSafe(F.col("d.since"))
    return a.join(d, same, "left_anti")


def outage_stream(stream: DataFrame, path: str, checkpoint: str, after_s: int = OUTAGE_AFTER_S, interval: str | None = None) -> StreamingQuery:
    """T06 over a stream: alerts of a batch go to ``alerts/v=<batch>``, once per outage."""

    def cycle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        health, alerted = (KeyedTable(spark, f"{path}/{name}", ["bookmaker"]) for name in ("health", "alerted"))
        before, known = health.touched(batch, batch_id), alerted.touched(batch, batch_id)
        target = f"{path}/alerts/v={batch_id}"
        outage_alert_once(batch, after_s, before, known).write.mode("overwrite").parquet(target)
        new = spark.read.parquet(target).select("bookmaker", "since")
        alerted.write(_merge(known, new), batch, batch_id)
        health.write(health_state(batch, before), batch, batch_id)

    return start(stream, checkpoint, cycle, interval)


# --- opportunities ----------------------------------------------------------------------

def trajectory_state(previous: DataFrame | None, observations: DataFrame, keep: int = TRAJECTORY_KEEP) -> DataFrame:
    """Last margins per tracked key, carried over from the previous state."""
    new = observations.select(*TRAJECTORY_KEY, "ts", "margin")
    if previous is not None:
        new = new.unionByName(previous.select(*TRAJECTORY_KEY, F.explode("points").alias("p")).select(
            *TRAJECTORY_KEY, "p.ts", "p.margin"))
    return margin_trajectory(new, keep)


def trajectory_stream(stream: DataFrame, path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    return start(stream, checkpoint, keyed(path, TRAJECTORY_KEY, trajectory_state), interval)


def stream_dedup(stream: DataFrame, path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Append only new detections to history, flagged when they may alert.

    History is append-only, one folder per batch. Beside it a keyed table holds what identifies the stored detections; a
    batch reads the buckets of its own matches only, however long the history is.
    """
    known = [*DUPLICATE_KEYS, "sport"]

    def cycle(batch: DataFrame, batch_id: int) -> None:
        index = KeyedTable(batch.sparkSession, f"{path}/_known", ["match"])
        stored = index.touched(batch, batch_id)
        history = batch.limit(0).select(*known) if stored is None else stored
        kept = first_signal_per_match(drop_exact_duplicates(batch, history), history)
        kept.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        new = batch.sparkSession.read.schema(kept.schema).parquet(f"{path}/batch={batch_id}").select(*known)
        index.write(history.unionByName(new).distinct(), batch, batch_id)

    return start(stream, checkpoint, cycle, interval)


def running_counters(stream: DataFrame, keys: list[str], path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Cumulative counts per key, kept in the engine's own aggregation state."""
    use_disk_state(stream.sparkSession)

    def publish(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/v={batch_id}")
        forget_versions(batch.sparkSession, path, "v=", batch_id)

    return start(stream.groupBy(*keys).agg(F.count("*").alias("n")), checkpoint, publish, interval, mode="complete")


def rolling_windows(stream: DataFrame, by: list[str], value: str, size: str, slide: str, late: str) -> DataFrame:
    """Count, mean and deviation per sliding window; rows beyond ``late`` are dropped.

    Works on a batch frame as well, where every window is complete.
    """
    return (
        stream.withWatermark("ts", late).groupBy(F.window("ts", size, slide), *by)
        .agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "mean", "deviation")
    )


def append_files(stream: DataFrame, path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Append a stream's finished rows to a parquet folder, exactly once."""
    use_disk_state(stream.sparkSession)
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()
