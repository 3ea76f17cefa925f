"""Nearest neighbours by a hash-prefix forest.

A tree is a sorted array of long bit strings: the signs of a vector's projections on random directions. A query
descends every tree to its longest matching prefix; then all trees ascend together, one bit at a time, and what lies
under the shortened prefixes joins the candidates, until they are ``share`` of the shard and ``k`` besides the rows
of the query's own id, or the whole shard. Candidates are ranked by exact inner product.

Rows are dealt by a hash of their id into shards of about ``SHARD`` rows, each with its own forest; queries come in blocks,
every block meets every shard, and the best of all shards are merged. One task holds one shard and one block.

Cases: rows without an id and vectors that are null, zero or hold null or non-finite components take no part; vectors
of different lengths are not compared; rows that carry the query's own id are not its neighbours; a repeated id may
appear twice; equal scores go by the smaller id; other columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .vectors import doubles, usable

TREES, BITS, SHARE, SHARD, QUERIES, SEED = 64, 24, 0.45, 8192, 4096, 29


class Forest:
    def __init__(self, vectors: np.ndarray, trees: int, bits: int, seed: int = SEED):
        rng = np.random.default_rng([seed, vectors.shape[1]])
        self.directions = rng.standard_normal((vectors.shape[1], trees * bits))
        self.vectors, self.trees, self.bits = vectors, trees, bits
        strings = self.strings(vectors)
        self.order = np.argsort(strings, axis=1, kind="stable")
        self.sorted = np.take_along_axis(strings, self.order, 1)

    def strings(self, vectors: np.ndarray) -> np.ndarray:
        """trees x vectors, each bit string as a number."""
        signs = (vectors @ self.directions > 0).reshape(len(vectors), self.trees, self.bits)
        return (signs @ (1 << np.arange(self.bits - 1, -1, -1, dtype=np.int64))).T

    def _ranges(self, asked: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Per tree and query, the slice of the sorted array that shares the first ``length`` bits."""
        rest = self.bits - length
        low = asked >> rest << rest
        at = [(np.searchsorted(s, a), np.searchsorted(s, a + (1 << rest))) for s, a in zip(self.sorted, low)]
        return np.stack([x for x, _ in at]), np.stack([y for _, y in at])

    def deepest(self, asked: np.ndarray) -> int:
        """The longest prefix that any query shares with any string of any tree."""
        n, best = self.sorted.shape[1], 0
        for s, a in zip(self.sorted, asked):
            at = np.searchsorted(s, a)
            for near in (s[np.minimum(at, n - 1)], s[np.maximum(at - 1, 0)]):
                different = int((near ^ a).min())
                best = max(best, self.bits - different.bit_length())
        return best

    def candidates(self, queries: np.ndarray, share: float, least: np.ndarray) -> list[np.ndarray]:
        """For each query the rows under its prefixes, once at least ``share`` of all rows and its ``least`` are."""
        n = len(self.vectors)
        wanted, asked = np.minimum(n, np.maximum(math.ceil(share * n), least)), self.strings(queries)
        out: list[np.ndarray | None] = [None] * len(queries)
        open_, length = np.arange(len(queries)), self.deepest(asked)
        while len(open_):
            low, high = self._ranges(asked[:, open_], length)
            ready = np.nonzero((high - low).sum(0) >= wanted[open_])[0]
            done = []
            for k in ready:
                under = np.zeros(n, bool)
                for t in range(self.trees):
                    under[self.order[t, low[t, k]:high[t, k]]] = True
                if length == 0 or under.sum() >= wanted[open_[k]]:
                    out[open_[k]] = np.nonzero(under)[0]
                    done.append(k)
            open_ = np.delete(open_, done)
            length -= 1
        return out


def products(rows: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Inner products, every row's summed in the same order wherever it stands, so that equal rows score alike."""
    return np.ascontiguousarray(rows * vector).sum(axis=1)


def _numbers(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, trees: int = TREES, bits: int = BITS, share: float = SHARE,
            shard: int = SHARD, block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best found for every row where ``is_query`` holds."""
    rows = vectors.filter(F.col("vec_id").isNotNull() & usable("embedding")).select(
        "vec_id", doubles(vectors, "embedding"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    n, asking = rows.agg(F.count("*"), F.count_if("asks")).first()
    shards, blocks = max(1, math.ceil(n / shard)), max(1, math.ceil(asking / block))
    number = F.xxhash64("vec_id")  # the same shards however the rows are laid out
    held = rows.select(F.pmod(number, F.lit(shards)).alias("shard"), "vec_id", "embedding", F.lit(False).alias("asks"))
    held = held.withColumn("block", F.explode(_numbers(blocks)))
    asked = rows.filter("asks").select(F.pmod(number, F.lit(blocks)).alias("block"), "vec_id", "embedding", "asks")
    asked = asked.withColumn("shard", F.explode(_numbers(shards)))
    sides = held.unionByName(asked).withColumn("size", F.size("embedding"))

    def search(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        asks, ids = table["asks"].to_numpy(), table["vec_id"].to_numpy()
        values = np.array(table["embedding"].to_pylist(), np.float64)
        own_ids, own, queries, query_ids = ids[~asks], values[~asks], values[asks], ids[asks]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(own) and len(queries):
            forest = Forest(own, trees, bits)
            kinds, counts = np.unique(own_ids, return_counts=True)
            at = np.minimum(np.searchsorted(kinds, query_ids), len(kinds) - 1)
            least = k + np.where(kinds[at] == query_ids, counts[at], 0)
            for q, vector, at in zip(query_ids, queries, forest.candidates(queries, share, least)):
                at = at[own_ids[at] != q]
                score = products(own[at], vector)
                if len(at) > k:
                    good = score >= np.partition(score, -k)[-k]
                    at, score = at[good], score[good]
                best = np.lexsort((own_ids[at], -score))[:k]
                found.append((np.full(len(best), q), own_ids[at][best], score[best]))
        parts = [np.concatenate([f[i] for f in found]) if found else np.zeros(0) for i in range(3)]
        return pa.table({"query_id": pa.array(parts[0].astype(np.int64)), "vec_id": pa.array(parts[1].astype(np.int64)),
                         "score": pa.array(parts[2].astype(np.float64))})

    best = sides.groupBy("size", "shard", "block").applyInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
