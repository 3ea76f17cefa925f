"""Running totals over a whole table without a single-task window.

Rows are range-partitioned on the full order, so one hot time stamp or key is
cut by its tie-breaking columns. Sums run inside each sorted partition, the few
partition totals are accumulated, and every row adds its own partition's
start. No task ever sees more than one range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..session import cut_lineage


def _accumulated(width: int, floats: list[bool], inclusive: bool):
    """Running sums of the last ``width`` columns inside every key, over sorted rows; the key is the first column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, carried = None, [0] * width
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0)
            cut = np.flatnonzero(pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)) + 1
            first = np.concatenate(([0], cut))
            if key[0].as_py() != current:
                carried = [0] * width
            out = []
            for i, is_float in enumerate(floats):
                own = pc.fill_null(batch.column(batch.num_columns - width + i), 0).to_numpy(zero_copy_only=False)
                own = own.astype(np.float64 if is_float else np.int64)
                total = np.cumsum(own)
                before = np.concatenate(([0], total))[first]  # what earlier keys of this batch add up to
                before[0] -= carried[i]
                total -= np.repeat(before, np.diff(np.append(first, len(own))))
                carried[i] = total[-1]
                out.append(pa.array(total if inclusive else total - own))
            current = key[batch.num_rows - 1].as_py()
            names = [*batch.schema.names, *(f"__r_{i}" for i in range(width))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=names)

    return run


def running_sums(
    df: DataFrame,
    order: list[str],
    sums: dict[str, Column],
    by: list[str] | None = None,
    inclusive: bool = True,
    partitions: int | None = None,
) -> DataFrame:
    """Add ``name = running sum of expr`` (whole or floating numbers) in ``order`` (within ``by`` groups).

    ``order`` must be a total order inside a group. With ``inclusive=False``
    a row's own value is left out. The one shuffle is the range partitioning:
    sums run inside the sorted partitions as they stream through.
    """
    spark = df.sparkSession
    keys = by or []
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    staged = df.select(
        (F.to_json(F.struct(*keys)) if keys else F.lit("")).alias("__key"), "*",
        *[expr.alias(f"__v_{name}") for name, expr in sums.items()])
    floats = [isinstance(staged.schema[f"__v_{name}"].dataType, (T.DoubleType, T.FloatType, T.DecimalType)) for name in sums]
    staged = staged.withColumns({
        f"__v_{name}": F.col(f"__v_{name}").cast("double" if f else "bigint") for name, f in zip(sums, floats)})
    sorted_ = staged.repartitionByRange(n, *[F.col(c) for c in keys + order]).sortWithinPartitions(*keys, *order)
    made = [T.StructField(f"__r_{i}", T.DoubleType() if f else T.LongType()) for i, f in enumerate(floats)]
    schema = T.StructType([*staged.schema.fields, *made])
    ranged = cut_lineage(
        sorted_.mapInArrow(_accumulated(len(sums), floats, inclusive), schema).withColumn("__pid", F.spark_partition_id()), "running")
    starts = ranged.groupBy("__pid", "__key").agg(*[F.sum(f"__v_{name}").alias(f"__t_{name}") for name in sums])
    before = Window.partitionBy("__key").orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("__pid", "__key", *[F.coalesce(F.sum(f"__t_{name}").over(before), F.lit(0)).alias(f"__s_{name}") for name in sums])
    out = ranged.join(starts, ["__pid", "__key"])
    return out.select(
        *[F.col(f"`{c}`") for c in df.columns if c not in sums],
        *[(F.col(f"__r_{i}") + F.col(f"__s_{name}")).alias(name) for i, name in enumerate(sums)])


def last_before(
    df: DataFrame, by: list[str], ts: str, value: Column, output: str, bucket_s: int = 3600
) -> DataFrame:
    """Add the latest non-NULL ``value`` at or before each row, per ``by`` key.

    ``value`` must not decrease with ``ts`` (a time stamp does not). Time
    buckets split a hot key; the per-bucket maxima are carried forward over
    the short list of buckets.
    """
    staged = df.withColumn("__v", value).withColumn(
        "__b", F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(bucket_s * 1_000_000))
    )
    tops = staged.groupBy(*by, "__b").agg(F.max("__v").alias("__m"))
    earlier = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumn("__c", F.max("__m").over(earlier)).drop("__m")
    inside = Window.partitionBy(*by, "__b").orderBy(ts).rangeBetween(Window.unboundedPreceding, 0)
    return (
        staged.withColumn("__w", F.max("__v").over(inside))
        .join(tops, [*by, "__b"])
        .withColumn(output, F.coalesce("__w", "__c"))
        .drop("__v", "__b", "__w", "__c")
    )


def middle_values(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Lower and upper middle of the sorted ``value``s per key, exactly.

    Equal values are counted first and the counts accumulated in order, so a
    hot key is spread over tasks by its values; nothing is collected.
    """
    counts = cut_lineage(df.groupBy(*by, value).agg(F.count("*").alias("__n")), "counts")
    totals = counts.groupBy(*by).agg(F.sum("__n").alias("__total"))
    ranked = running_sums(counts, [value], {"__upto": F.col("__n")}, by=by)
    low, high = F.floor((F.col("__total") - 1) / 2) + 1, F.floor(F.col("__total") / 2) + 1

    def holds(rank: Column) -> Column:
        return (F.col("__upto") >= rank) & (F.col("__upto") - F.col("__n") < rank)

    return (
        ranked.join(totals, by)
        .filter(holds(low) | holds(high))
        .groupBy(*by)
        .agg(F.min(value).alias("lower_middle"), F.max(value).alias("upper_middle"))
    )


def trailing_window(
    df: DataFrame, by: list[str], ts: str, size_s: int, value: Column, aggs: dict[str, str],
    include_edge: bool = True, include_self: bool = True,
) -> DataFrame:
    """Add ``name = rows | mean | deviation`` of ``value`` over the last ``size_s`` seconds of every row's key.

    Time is cut into buckets of the window's length, so a window is the end of
    one bucket and the start of the next. Both grow from row to row and are
    never computed anew: the work follows the rows, however many a window
    holds, and a hot key becomes many window partitions. ``include_edge`` keeps
    rows exactly ``size_s`` old.
    """
    size = size_s * 1_000_000
    staged = df.withColumn("__t", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("__x", value)
    staged = staged.withColumn("__b", F.floor(F.col("__t") / size))
    # A row counts in its own bucket, and in the next one until it is ``size`` old.
    spread = staged.withColumn("__k", F.explode(F.array(F.col("__b"), F.col("__b") + 1)))
    own = F.col("__k") == F.col("__b")
    spread = spread.withColumn("__at", F.when(own, F.col("__t")).otherwise(F.col("__t") + size))
    bucket = Window.partitionBy(*by, "__k")
    old = bucket.orderBy(F.desc("__at")).rangeBetween(Window.unboundedPreceding, 0 if include_edge else -1)
    new = bucket.orderBy("__at").rangeBetween(Window.unboundedPreceding, 0 if include_self else -1)
    for part, rows, span in (("o", ~own, old), ("n", own, new)):
        x = F.when(rows, F.col("__x"))
        spread = spread.withColumns({
            f"__{part}_rows": F.count_if(rows).over(span), f"__{part}_n": F.count(x).over(span),
            f"__{part}_mean": F.avg(x).over(span), f"__{part}_var": F.var_pop(x).over(span)})
    o_n, n_n, o_mean, n_mean = (F.col(f"__{part}_{name}") for name in ("n", "mean") for part in ("o", "n"))
    n = o_n + n_n
    squares = o_n * F.col("__o_var") + n_n * F.col("__n_var") + (o_mean - n_mean) * (o_mean - n_mean) * o_n * n_n / n
    made = {
        "rows": F.col("__o_rows") + F.col("__n_rows"),
        "mean": F.when(n_n == 0, o_mean).when(o_n == 0, n_mean).otherwise((o_n * o_mean + n_n * n_mean) / n),
        "deviation": F.sqrt(F.when(n_n == 0, F.col("__o_var")).when(o_n == 0, F.col("__n_var")).otherwise(squares / n)),
    }
    return spread.filter(own).select(*df.columns, *[made[kind].alias(name) for name, kind in aggs.items()])
