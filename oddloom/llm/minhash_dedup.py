"""Near-duplicate documents by min-max hashing.

A document is the set of its ``words``-word shingles. Under each permutation both the smallest and the largest value are
kept, so a signature of 180 values takes 90 evaluations. Bands of five values put documents into buckets: two sets of
similarity 0.8 meet in none of 36 bands with probability below 1e-6. Links are confirmed on the full sets.

Equal sets form a class that is read once. Within a bucket no pairs are listed: in each of ``ROUNDS`` rounds every class
is compared with one bucket mate, the pivot (smallest under that round's order) with which it shares most buckets, and
confirmed links are joined to components. Then only bucket mates of different components are left. Their buckets are cut
into blocks, and every pair whose signatures agree within five deviations of the threshold is decided in the first bucket
it shares: first the signatures tell whose sets are needed, then the sets decide. A block gives out only links that join
two components within it, fewer than it has members; no link between components is lost.

Cases: a null or empty text has the empty set and links with nothing; texts of fewer words than a shingle are one
shingle; repeated rows are one class; null ids take part but never name a component unless alone; other columns are
left out (``mark``) or kept (``keep_one``); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage
from .arrow import fresh, slices
from .bitmap import narrowed
from .components import components
from .substring_dedup import Sums, WordHashes, content_key

WORDS, PERMUTATIONS, PER_BAND, SEED, ROUNDS, TILE = 4, 90, 5, 5, 3, 1024
_PAIRS = 4096  # pairs of a block handed on at once
MULTIPLIERS = np.random.default_rng(SEED).integers(1, 1 << 62, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str, words: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``words`` words; A-Z lower-cased, ASCII white space parts words."""
    found = text.encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    n, size = len(found), min(words, len(found))
    runs = Sums(hashes(found)).runs(np.arange(n - size + 1), np.arange(size, n + 1), 0)
    return np.unique(runs ^ np.uint64(size if size < words else 0))


def signature(values: np.ndarray) -> np.ndarray:
    """The smallest value under every permutation, and then the largest."""
    out = np.empty(2 * PERMUTATIONS, np.uint64)
    for at, m in enumerate(MULTIPLIERS):
        turned = values * m
        out[at], out[PERMUTATIONS + at] = turned.min(), turned.max()
    return out


def bands(signed: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of ``PER_BAND`` values, the band's number included."""
    rows = signed.reshape(-1, PER_BAND)
    key = np.arange(1, len(rows) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(PER_BAND):
        key = (key ^ rows[:, k]) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def sketched(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, text_key, set_key, n_shingles, bands, sketch (eight bits of every signature value) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in slices(batches):
            keys, sizes, buckets, sketches = [], [], [], []
            for text in part.column(2).to_pylist():
                own = shingles(text, words, hashes)
                sizes.append(len(own))
                signed = signature(own) if len(own) else None
                keys.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                buckets.append(bands(signed) if len(own) else None)
                sketches.append((signed >> np.uint64(40)).astype(np.uint8).view(np.int8) if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()),
                 pa.array(buckets, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int8()))],
                names=["doc_id", "text_key", "set_key", "n_shingles", "bands", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", content_key("text").alias("text_key"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        run, f"doc_id {kind}, text_key binary, set_key binary, n_shingles long, bands array<long>, sketch array<tinyint>")


def _is_link(u: np.ndarray, v: np.ndarray, percent: int) -> bool:
    both = np.concatenate([u, v])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(u) + len(v) - shared)


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of which 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 512):
            good = []
            for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                good.append(_is_link(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent))
            yield part.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    pivots = narrowed(sets, "cid", pairs.select(F.col("b").alias("cid")).distinct()).select(
        F.col("cid").alias("b"), F.col("values").alias("v"))
    own = narrowed(sets, "cid", pairs.select(F.col("a").alias("cid")).distinct()).select(
        F.col("cid").alias("a"), F.col("values").alias("u"))
    return pairs.join(pivots, "b").join(own, "a").select("a", "b", "u", "v").mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """cid, values: the sets of the classes ``wanted`` (cid, text_key), read again from one text each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in slices(batches):
            made = [shingles(t, words, hashes).tobytes() for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.binary())], names=["cid", "values"])

    keyed = docs.select(content_key("text").alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
    texts = narrowed(keyed, "text_key", wanted.select("text_key")).groupBy("text_key").agg(F.first("text").alias("text"))
    return texts.join(wanted, "text_key").select("cid", "text").mapInArrow(run, "cid long, values binary")


def _apart(members: DataFrame, roots: DataFrame) -> DataFrame:
    """bucket, cid, root: members of buckets that still hold several components."""
    placed = members.join(roots, members.cid == roots.node, "left").select(
        "bucket", "cid", F.coalesce("root", "cid").alias("root"))
    mixed = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
    return placed.join(mixed.select("bucket"), "bucket", "left_semi")


def _blocks(apart: DataFrame) -> DataFrame:
    """bucket, i, j, tile, cid, root: buckets as blocks of at most two tiles, so that any two members meet in one block.

    Members are dealt to tiles of about ``TILE`` by a hash; block (i, i) compares tile i with itself, (i, j) tile i with j.
    """
    sizes = apart.groupBy("bucket").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    own = apart.join(sizes, "bucket").withColumn("tile", F.pmod(F.xxhash64("cid"), F.col("tiles")).cast("int"))
    met = own.select("bucket", "cid", "root", "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    return met.select("bucket", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "cid", "root")


class _Block:
    """The members of one block, and the pairs in it that only their full sets can decide."""

    def __init__(self, bucket: int, crossed: bool, rows: list[tuple], least: float):
        self.bucket, self.crossed, self.least = bucket, crossed, least
        self.tile = np.array([r[0] for r in rows])
        self.cid = np.array([r[1] for r in rows], np.int64)
        self.root = np.array([r[2] for r in rows], np.int64)
        self.sketch = np.array([r[3] for r in rows], np.int8)
        bands = np.array([r[4] for r in rows], np.int64)
        self.before = bands[:, :int(np.flatnonzero(bands[0] == bucket)[0])]

    def mates(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Later members of another component that look like member ``k`` and share no earlier bucket with it, and how
        many signature values agree."""
        far = self.root[k + 1:] != self.root[k]
        if self.crossed:
            far &= self.tile[k + 1:] != self.tile[k]
        at = np.flatnonzero(far) + k + 1
        agree = (self.sketch[at] == self.sketch[k]).sum(1)
        good = (agree >= self.least) & ~(self.before[at] == self.before[k]).any(1)
        return at[good], agree[good]

    def pairs(self) -> Iterator[tuple[int, int]]:
        """All pairs of mates, those that agree most first."""
        found = [(np.full(len(at), k, np.int32), at.astype(np.int32), agree.astype(np.int16))
                 for k in range(len(self.cid) - 1) for at, agree in [self.mates(k)] if len(at)]
        if found:
            k, at, agree = map(np.concatenate, zip(*found))
            del found
            order = np.argsort(-agree, kind="stable").astype(np.int32)
            for begin in range(0, len(order), _PAIRS):
                part = order[begin:begin + _PAIRS]
                yield from zip(k[part].tolist(), at[part].tolist())


def _in_blocks(rows: DataFrame, percent: int, fields: str, each: Callable[[_Block, list[tuple]], list[tuple]]) -> DataFrame:
    """``each`` over the blocks of ``rows`` (bucket, i, j, tile, cid, root, sketch, bands, more), one after another."""
    n, p = 2 * PERMUTATIONS, percent / 100
    least = n * (p - 5 * (p * (1 - p) / n) ** 0.5)
    names = [f.split()[0] for f in fields.split(", ")]

    def made(rows: list[tuple], key: tuple) -> pa.RecordBatch:
        out = each(_Block(key[0], key[1] != key[2], [r[3:] for r in rows], least), rows)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] or [pa.array([], pa.int64())] * len(names), names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = (row for part in slices(batches, 512) for row in zip(*(c.to_pylist() for c in part.columns)))
        for key, group in groupby(read, key=lambda r: r[:3]):
            members = list(group)  # at most about two tiles
            if len(members) > 1:
                yield made(members, key)

    laid = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "cid")
    return laid.mapInArrow(run, fields)


def _undecided(blocks: DataFrame, wanted: DataFrame, percent: int) -> DataFrame:
    """bucket, i, j, cid: the members of a block that look like a mate of another component."""

    def each(block: _Block, rows: list[tuple]) -> list[tuple]:
        needed: set[int] = set()
        for k in range(len(rows) - 1):
            mates, _ = block.mates(k)
            if len(mates):
                needed.add(k)
                needed.update(mates.tolist())
        return [(*rows[k][:3], int(block.cid[k])) for k in sorted(needed)]

    drawn = blocks.join(wanted.select("cid", "sketch", "bands"), "cid").select("bucket", "i", "j", "tile", "cid", "root", "sketch", "bands")
    return _in_blocks(drawn, percent, "bucket long, i long, j long, cid long", each)


def _joining(blocks: DataFrame, needed: DataFrame, wanted: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: confirmed links between bucket mates of different components, those that join two within a block alone."""

    def each(block: _Block, rows: list[tuple]) -> list[tuple]:
        sets = [np.frombuffer(r[8], np.uint64) for r in rows]
        links, root = [], block.root.copy()
        for k, m in block.pairs():
            if root[k] != root[m] and _is_link(sets[k], sets[m], percent):
                links.append((int(block.cid[k]), int(block.cid[m])))
                root[root == root[m]] = root[k]
        return links

    drawn = blocks.join(needed, ["bucket", "i", "j", "cid"], "left_semi").join(wanted.select("cid", "sketch", "bands"), "cid").join(sets, "cid")
    drawn = drawn.select("bucket", "i", "j", "tile", "cid", "root", "sketch", "bands", "values")
    return _in_blocks(drawn, percent, "a long, b long", each)


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` after ``links``: only the components that the links touch are looked at, as single nodes."""
    at = roots.withColumnRenamed("node", "a").withColumnRenamed("root", "ra")
    to = roots.withColumnRenamed("node", "b").withColumnRenamed("root", "rb")
    drawn = links.join(at, "a", "left").join(to, "b", "left").select(
        "a", "b", F.coalesce("ra", "a").alias("ra"), F.coalesce("rb", "b").alias("rb"))
    drawn = cut_lineage(drawn, "drawn")
    merged = components(drawn.select("ra", "rb").distinct(), "ra", "rb").toDF("root", "best")
    nodes = roots.union(drawn.select("a", "ra")).union(drawn.select("b", "rb")).distinct()
    return cut_lineage(nodes.join(merged, "root", "left").select("node", F.coalesce("best", "root").alias("root")), "roots")


def near_classes(docs: DataFrame, words: int = WORDS, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """The sketched rows, and set_key, component (smallest doc_id reachable) of every class."""
    rows = cut_lineage(sketched(docs, words), "sketches")
    classes = cut_lineage(
        rows.filter("set_key IS NOT NULL").groupBy("set_key").agg(
            F.min("doc_id").alias("first_id"), F.min("text_key").alias("text_key"), F.first("bands").alias("bands"),
            F.first("sketch").alias("sketch")).withColumn("cid", F.monotonically_increasing_id()), "classes")
    placed = classes.select("cid", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    members = cut_lineage(placed.join(shared, "bucket", "left_semi"), "buckets")
    wanted = narrowed(classes.select("cid", "text_key", "sketch", "bands"), "cid", members.select("cid").distinct())
    wanted = cut_lineage(wanted, "wanted")
    sets = cut_lineage(_sets(docs, wanted.select("cid", "text_key"), words), "sets")
    spark = docs.sparkSession
    roots = spark.createDataFrame([], "node long, root long")
    for turn in range(ROUNDS):
        apart = cut_lineage(_apart(members, roots), "apart")
        order = F.xxhash64("cid", F.lit(turn))
        pivot = apart.groupBy("bucket").agg(F.min(F.struct(order.alias("o"), "cid", "root")).alias("pivot"))
        offers = (apart.join(pivot, "bucket").filter("root <> pivot.root")
                  .groupBy(F.col("cid").alias("a"), F.col("pivot.cid").alias("b")).agg(F.count("*").alias("n")))
        best = offers.groupBy("a").agg(F.max(F.struct("n", "b")).alias("best")).select("a", "best.b")
        roots = _joined(roots, _linked(cut_lineage(best, "offers"), sets, percent))
    blocks = cut_lineage(_blocks(cut_lineage(_apart(members, roots), "apart")), "blocks")
    needed = cut_lineage(_undecided(blocks, wanted, percent), "needed")
    roots = _joined(roots, cut_lineage(_joining(blocks, needed, wanted, sets, percent), "joining"))
    rooted = classes.select("set_key", "cid", "first_id").join(roots, F.col("cid") == F.col("node"), "left").select(
        "set_key", F.coalesce("root", "cid").alias("root"), "first_id")
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component"))
    return rows, rooted.join(named, "root").select("set_key", "component")


def mark(docs: DataFrame, words: int = WORDS, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    rows, named = near_classes(docs, words, percent)
    out = rows.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = 80) -> DataFrame:
    """All columns of one row per component: the smallest id, and of its repeated rows the first text.

    Rows without words have no near-duplicates and all stay; so do components of which no row has an id, by one row.
    """
    rows, named = near_classes(docs, words, percent)
    bare = F.coalesce(F.col("text"), F.lit("")).rlike(r"^[\x20\x09-\x0D]*$")
    group = F.when(F.col("component").isNotNull(), F.struct(F.lit(""), F.col("component").cast("string")))
    firsts = (rows.filter("set_key IS NOT NULL").join(named, "set_key")
              .groupBy(group.alias("g"), F.when(F.col("component").isNull(), F.col("set_key")).alias("s"))
              .agg(F.min(F.struct("doc_id", "text_key")).alias("one")).select("one.doc_id", "one.text_key"))
    key, tie, number = (fresh(docs.columns, n) for n in ("__key", "__tie", "__n"))
    chosen = firsts.select(F.col("doc_id").alias(fresh([*docs.columns, key], "__id")), F.col("text_key").alias(fresh([*docs.columns, key], "__k")))
    ident, held = chosen.columns
    keyed = docs.withColumn(key, content_key("text"))
    kept = keyed.filter(~bare).join(chosen, (F.col(key) == F.col(held)) & F.col("doc_id").eqNullSafe(F.col(ident)))
    one = Window.partitionBy(key, "doc_id").orderBy(tie)
    kept = kept.withColumn(tie, F.monotonically_increasing_id()).withColumn(number, F.row_number().over(one)).filter(F.col(number) == 1)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.filter(bare))
