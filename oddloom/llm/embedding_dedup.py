"""Near-duplicate embeddings by Euclidean p-stable hashing.

Normalised vectors are projected on Gaussian directions, shifted and cut into steps of ``width``; ``digits`` of these
make a bucket key, in each of ``tables`` tables. Vectors at cosine 0.98 are 0.2 apart and share a given bucket with
probability 0.26, so that 48 tables miss a pair with probability below 1e-6. Pairs that share a bucket are compared
by exact cosine.

Equal vectors of one label form a class that is compared once and weighs as many rows as it has. A bucket of many
classes is cut into blocks, and pairs of blocks are compared by matrix products.

Cases: vectors that are null, zero or hold null or non-finite components, and rows without a label, link with
nothing; vectors of different lengths are not compared; rows with repeated ids count as vectors of their own; other
columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .arrow import slices
from .components import components
from .vectors import doubles, usable

TABLES, DIGITS, WIDTH, BLOCK, SEED = 48, 16, 2.0, 256, 17


def bucket_keys(unit: np.ndarray, tables: int, digits: int, width: float, seed: int) -> np.ndarray:
    """One 64-bit key per vector and table."""
    rng = np.random.default_rng([seed, unit.shape[1]])
    directions = rng.standard_normal((unit.shape[1], tables * digits))
    shift = rng.uniform(0, width, tables * digits)
    mix = rng.integers(1, 2**62, digits, dtype=np.int64) * 2 + 1
    steps = np.floor((unit @ directions + shift) / width).astype(np.int64)
    with np.errstate(over="ignore"):
        return (steps.reshape(len(unit), tables, digits) * mix).sum(2)


def _unit(part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of equal length as a matrix, and the same normalised."""
    values = np.array(part.to_pylist(), np.float64)
    scaled = values / np.abs(values).max(1, keepdims=True)
    return values, scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def classes(vectors: DataFrame) -> DataFrame:
    """label, embedding, key, members: the distinct labelled vectors."""
    keyed = vectors.filter(usable("embedding") & F.col("label").isNotNull()).select(
        "label", doubles(vectors, "embedding"))
    key = F.concat(F.hex(F.xxhash64("label", "embedding")), F.hex(F.xxhash64("embedding", "label", F.lit(SEED))))
    return keyed.groupBy("label", "embedding").agg(F.count("*").alias("members")).withColumn("key", key)


def links(distinct: DataFrame, threshold: float, tables: int = TABLES, digits: int = DIGITS, width: float = WIDTH) -> DataFrame:
    """a, b: keys of the classes of one label whose cosine is at least ``threshold``, each pair once."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2048):
            sizes = np.array([len(v) for v in part.column(1).to_pylist()])
            for size in np.unique(sizes):
                own = part.take(pa.array(np.nonzero(sizes == size)[0]))
                keys = bucket_keys(_unit(own.column(1))[1], tables, digits, width, SEED)
                n = own.num_rows
                at = pa.array(np.repeat(np.arange(n), tables))
                yield pa.RecordBatch.from_arrays(
                    [own.column(0).take(at), pa.array(np.full(n * tables, size, np.int32)),
                     pa.array(np.tile(np.arange(tables, dtype=np.int32), n)), pa.array(keys.ravel()), own.column(2).take(at)],
                    names=["label", "size", "table", "bucket", "key"])

    kind = distinct.schema["label"].dataType.simpleString()
    placed = distinct.select("label", "embedding", "key").mapInArrow(
        hashed, f"label {kind}, size int, table int, bucket long, key string")
    placed = cut_lineage(placed, "buckets")
    where = ["label", "size", "table", "bucket"]
    shared = placed.groupBy(*where).agg(F.count("*").alias("n")).filter("n > 1")
    found = placed.join(shared, where).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    # block i meets every block j: its rows go to the pairs (i, j) and (j, i), written smaller first
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    found = found.select(*where, "key", own.alias("own"), other)
    found = found.select(*where, "key", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    found = found.join(distinct.select("key", "embedding"), "key")

    def compare(table: pa.Table) -> pa.Table:
        if table.num_rows < 2:
            return pa.table({"a": pa.array([], pa.string()), "b": pa.array([], pa.string())})
        table = table.combine_chunks()
        _, unit = _unit(table["embedding"])
        keys = np.array(table["key"].to_pylist(), object)
        own, i, j = (table[c].to_numpy() for c in ("own", "i", "j"))
        left, right = np.nonzero(own == i)[0], np.nonzero(own == j)[0]
        hit = np.argwhere(unit[left] @ unit[right].T >= threshold)
        a, b = keys[left[hit[:, 0]]], keys[right[hit[:, 1]]]
        if i[0] == j[0]:
            a, b = a[a < b], b[a < b]
        else:
            a, b = np.minimum(a, b), np.maximum(a, b)
        return pa.table({"a": pa.array(a.tolist(), pa.string()), "b": pa.array(b.tolist(), pa.string())})

    return found.groupBy(*where, "i", "j").applyInArrow(compare, "a string, b string").distinct()


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, tables: int = TABLES, digits: int = DIGITS,
                    width: float = WIDTH) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    distinct = cut_lineage(classes(vectors), "classes")
    pairs = cut_lineage(links(distinct, threshold, tables, digits, width), "links")
    root = components(pairs, "a", "b")
    both = pairs.union(pairs.select("b", "a")).toDF("key", "other")
    weights = distinct.select(F.col("key").alias("other"), F.col("members").alias("more"))
    beside = both.join(weights, "other").groupBy("key").agg(F.sum("more").alias("more"))
    known = (distinct.drop("embedding", "label").join(beside, "key", "left")
             .join(root.withColumnRenamed("node", "key"), "key", "left")
             .select("key", F.coalesce("root", "key").alias("root"), "members", F.coalesce("more", F.lit(0)).alias("more")))
    key = F.concat(F.hex(F.xxhash64("label", "embedding")), F.hex(F.xxhash64("embedding", "label", F.lit(SEED))))
    typed = vectors.select("vec_id", "label", doubles(vectors, "embedding"))
    keyed = typed.select("vec_id", F.when(usable("embedding") & F.col("label").isNotNull(), key).alias("key"))
    rows = keyed.join(known, "key", "left")
    first = rows.filter("root IS NOT NULL").groupBy("root").agg(F.min("vec_id").alias("component_id"))
    rows = rows.join(first, "root", "left").select(
        "vec_id", F.coalesce(F.col("members") - 1 + F.col("more"), F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"))
    return rows.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
