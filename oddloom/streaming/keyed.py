"""State that outlives a batch, as a table of which every batch rewrites what it touches.

Rows are dealt to buckets by a hash of their keys. A batch reads the buckets of its own keys, folds itself in and writes
those buckets anew; a manifest of one row per bucket says which batch wrote a bucket last. A replayed batch finds the
manifest of the batch before it and writes the same again. Bucket versions that neither the last manifest nor the one
before names are removed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: Also the most rows of a manifest, which come to the driver.
BUCKETS = 64

Step = Callable[[DataFrame | None, DataFrame], DataFrame]


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def manifest(self, batch_id: int) -> dict[int, int]:
        """Bucket -> the batch that wrote it last, as of ``batch_id``; empty before the first batch."""
        if batch_id < 0:
            return {}
        rows = self.spark.read.schema("bucket int, batch long").parquet(f"{self.path}/manifest/as_of={batch_id}")
        return {r["bucket"]: r["batch"] for r in rows.collect()}

    def _read(self, versions: dict[int, int]) -> DataFrame | None:
        paths = [f"{self.path}/data/batch={v}/bucket={b}" for b, v in sorted(versions.items())]
        return self.spark.read.parquet(*paths) if paths else None

    def read(self, batch_id: int) -> DataFrame | None:
        """All rows as of a batch; None if there never were any."""
        return self._read(self.manifest(batch_id))

    def _buckets_of(self, batch: DataFrame) -> set[int]:
        return {r[0] for r in batch.select(self._bucket()).distinct().collect()}

    def touched(self, batch: DataFrame, batch_id: int, mine: set[int] | None = None) -> DataFrame | None:
        """What the batches before this one left in the buckets of this batch's keys (``mine``, if they are known)."""
        before = self.manifest(batch_id - 1)
        mine = self._buckets_of(batch) if mine is None else mine
        return self._read({b: v for b, v in before.items() if b in mine})

    def _dealt(self, rows: DataFrame, buckets: int) -> DataFrame:
        """Rows by bucket; where buckets are fewer than the shuffle's tasks, each one is shared out among several."""
        shares = int(self.spark.conf.get("spark.sql.shuffle.partitions")) // max(1, buckets)
        keyed = rows.withColumn("bucket", self._bucket())
        if shares < 2:
            return keyed.repartition("bucket")
        whole = [f"`{f.name}`" for f in rows.schema.fields if not isinstance(f.dataType, T.MapType)]
        return keyed.repartition("bucket", F.pmod(F.xxhash64(*whole), F.lit(shares)))

    def write(self, rows: DataFrame, batch: DataFrame, batch_id: int, mine: set[int] | None = None) -> None:
        """Replace the buckets of this batch's keys by ``rows``."""
        before = self.manifest(batch_id - 1)
        data = f"{self.path}/data/batch={batch_id}"
        mine = self._buckets_of(batch) if mine is None else mine
        self._dealt(rows, len(mine)).write.mode("overwrite").partitionBy("bucket").parquet(data)
        filled = set(subfolders(self.spark, data, "bucket="))
        after = {b: v for b, v in before.items() if b not in mine} | {b: batch_id for b in filled}
        listed = self.spark.createDataFrame(sorted(after.items()), "bucket int, batch long")
        listed.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/as_of={batch_id}")
        self._forget(batch_id, before, after)

    def fold(self, batch: DataFrame, batch_id: int, step: Step) -> None:
        """Fold a batch in: ``step`` gets what is known of its buckets (None: nothing) and the batch."""
        mine = self._buckets_of(batch)
        self.write(step(self.touched(batch, batch_id, mine), batch), batch, batch_id, mine)

    def _forget(self, batch_id: int, before: dict[int, int], after: dict[int, int]) -> None:
        kept = set(before.items()) | set(after.items())
        for version in subfolders(self.spark, f"{self.path}/data", "batch="):
            folder = f"{self.path}/data/batch={version}"
            buckets = subfolders(self.spark, folder, "bucket=")
            stale = [b for b in buckets if (b, version) not in kept]
            whole = len(stale) == len(buckets) and version != batch_id
            for path in [folder] if whole else [f"{folder}/bucket={b}" for b in stale]:
                remove(self.spark, path)
        forget_versions(self.spark, f"{self.path}/manifest", "as_of=", batch_id)


# Folders, on whatever store the path names --------------------------------------------------

def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def subfolders(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers of the folders ``<prefix><number>`` under a path."""
    where, store = _folder(spark, path)
    names = [s.getPath().getName() for s in store.listStatus(where)] if store.exists(where) else []
    return [int(n.removeprefix(prefix)) for n in names if n.startswith(prefix)]


def count_files(spark: SparkSession, path: str) -> int:
    """How many data files a folder holds; none if there is no folder."""
    where, store = _folder(spark, path)
    return sum(s.getPath().getName().startswith("part-") for s in store.listStatus(where)) if store.exists(where) else 0


def remove(spark: SparkSession, path: str) -> None:
    where, store = _folder(spark, path)
    store.delete(where, True)


def forget_versions(spark: SparkSession, path: str, prefix: str, batch_id: int) -> None:
    """Remove the versions before the last two."""
    for version in subfolders(spark, path, prefix):
        if version < batch_id - 1:
            remove(spark, f"{path}/{prefix}{version}")
