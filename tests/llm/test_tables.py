import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddloom.llm import fixity
from oddloom.llm.components import components
from oddloom.llm.embedding_dedup import near_duplicates
from oddloom.llm.prefix_forest import nearest

SCHEMA = "vec_id long, embedding array<float>, label int, score string, key string"
ODD = [(900, None, 1), (901, [0.0] * 8, 1), (902, [float("nan")] + [1.0] * 7, 1), (903, [float("inf")] + [1.0] * 7, 1),
       (904, [None] + [1.0] * 7, 1), (905, [], 1), (None, [1.0] * 8, 1), (906, [1.0] * 8, None)]


def vectors(spark, n=80, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if i % 4 == 3:
            v = np.array(rows[-1][1]) + rng.normal(size=8) * 0.02
        else:
            v = rng.normal(size=8)
        rows.append((i, [float(x) for x in v.astype(np.float32)], i // 4 % 2))
    rows += [(n + i, rows[5][1], rows[5][2]) for i in range(3)]  # equal vectors
    rows += [(n + 10, [1.0] * 4, 0)]  # another length
    rows += ODD
    return rows, spark.createDataFrame([(*r, "x", "x") for r in rows], SCHEMA)


def fine(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def test_embedding_dedup_against_brute_force(spark):
    rows, df = vectors(spark)
    ok = [(i, np.array(v, float), y) for i, v, y in rows if fine(v) and y is not None]
    links, root = {k: 0 for k in range(len(ok))}, list(range(len(ok)))
    for a, (_, u, x) in enumerate(ok):
        for b, (_, v, y) in enumerate(ok):
            if a != b and x == y and len(u) == len(v) and u @ v / np.sqrt((u @ u) * (v @ v)) >= 0.98:
                links[a] += 1
                old, new = root[a], root[b]
                root = [new if r == old else r for r in root]
    want = {}
    for a, (i, _, _) in enumerate(ok):
        ids = [ok[b][0] for b in range(len(ok)) if root[b] == root[a] and ok[b][0] is not None]
        want[i] = (links[a], min(ids, default=None))
    for i, v, y in rows:
        if i not in want:
            want[i] = (0, i)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_duplicates(df).collect()}
    assert got == want and max(n for n, _ in want.values()) >= 3


def test_embeddings_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(empty).count() == 0
    assert nearest(empty, F.col("vec_id") % 20 == 0).count() == 0


def test_prefix_forest_recall_and_exact_scores(spark):
    rng = np.random.default_rng(3)
    values = rng.normal(size=(600, 16))
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(values)] + [(1000 + i, v, y) for i, (_, v, y) in enumerate(ODD[:6])]
    df = spark.createDataFrame([(*r, "x", "x") for r in rows], SCHEMA)
    exact = np.array([[float(np.float32(x)) for x in v] for v in values])
    got = nearest(df, F.col("vec_id") % 20 == 0, k=20, shard=200, block=16).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r)
    hits = 0
    assert sorted(by) == list(range(0, 600, 20))
    for q, found in by.items():
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 21)) and all(r["vec_id"] != q for r in found)
        assert all(abs(r["score"] - exact[q] @ exact[r["vec_id"]]) < 1e-9 for r in found)
        assert [(-r["score"], r["vec_id"]) for r in found] == sorted((-r["score"], r["vec_id"]) for r in found)
        order = [i for i in np.argsort(-(exact @ exact[q])) if i != q][:20]
        hits += len(set(order) & {r["vec_id"] for r in found})
    assert hits / (20 * len(by)) >= 0.9


def test_few_candidates_are_all_returned(spark):
    df = spark.createDataFrame([(i, [1.0, float(i)], 0, "", "") for i in range(1, 5)] + [(20, [1.0, 1.0], 0, "", "")], SCHEMA)
    got = nearest(df, F.col("vec_id") % 20 == 0, k=20, share=1.0).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(4, 5.0), (3, 4.0), (2, 3.0), (1, 2.0)]


def test_few_candidates_with_the_share_in_use(spark):
    df = spark.createDataFrame([(i, [1.0, float(i)], 0, "", "") for i in range(1, 5)] + [(20, [1.0, 1.0], 0, "", "")], SCHEMA)
    got = nearest(df, F.col("vec_id") % 20 == 0, k=20).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(4, 5.0), (3, 4.0), (2, 3.0), (1, 2.0)]
    rng = np.random.default_rng(5)
    for n, copies in ((6, 1), (21, 1), (30, 1), (44, 8), (60, 30)):
        rows = [(20 if i < copies else 100 * i + 1, [float(x) for x in rng.normal(size=8)], 0, "", "") for i in range(n)]
        got = nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 20, k=20).collect()
        assert sorted(r["rank"] for r in got) == list(range(1, min(20, copies * (n - copies)) + 1)), n
        assert all(r["vec_id"] != 20 for r in got)


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)]
    root = {}
    for e in edges:
        for x in e:
            root.setdefault(x, x)
    for a, b in edges:
        old, new = root[a], root[b]
        root = {k: new if v == old else v for k, v in root.items()}
    want = {k: min(x for x in root if root[x] == root[k]) for k in root if any(k in e and e[0] != e[1] for e in edges)}
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == want


def test_fixity_audit(spark):
    rng = random.Random(4)
    rows = []
    for file_no in range(3):
        at = 0
        for _ in range(400):
            size = rng.randint(50, 9000)
            rows.append((file_no, at, size, hashlib.sha256(rng.randbytes(8)).hexdigest()))
            at += size
    rows += [(None, 5, 1, "x"), rows[7], rows[7]]
    schema = "file_no long, rec_offset long, rec_length long, digest string"
    replica, want = [], set()
    for i, r in enumerate(rows):
        if i in (30, 431):
            want.add((*r[:3], "missing"))
        elif i in (31, 800, 1199):
            replica.append((*r[:3], "0" * 64))
            want.add((*r[:3], "changed"))
        else:
            replica.append(r)
    replica += [(2, 10**7, 12, "new")]
    want.add((2, 10**7, 12, "extra"))
    frames = [spark.createDataFrame(x, schema).withColumn("node", F.lit("x")) for x in (rows, replica)]
    assert {tuple(r) for r in fixity.audit(*frames).collect()} == want
    same = fixity.audit(frames[0], frames[0])
    assert same.count() == 0
    empty = spark.createDataFrame([], schema)
    assert fixity.audit(empty, empty).count() == 0
    assert fixity.audit(frames[0], empty).filter("damage = 'missing'").count() == 1200


def test_layout_is_gapless(spark):
    df = spark.createDataFrame([(i // 3, 10 + i % 7) for i in range(100)], "page long, size long")
    got = sorted((r["file_no"] * 256 + r["rec_offset"], r["size"]) for r in fixity.laid_out(df, ["page"], "size", file_bytes=256).collect())
    at = 0
    for start, size in got:
        assert start == at
        at += size


def test_equal_vectors_tie_by_id_in_any_layout(spark):
    rng = np.random.default_rng(12)
    same = rng.normal(size=64).astype(np.float32)
    rows = [(i, [float(x) for x in (same if i % 3 == 1 else rng.normal(size=64).astype(np.float32))], 1, "x", "x") for i in range(400)]
    rows[20] = (20, [float(x) for x in same + 0.01], 1, "x", "x")
    random.Random(3).shuffle(rows)
    seen = []
    for parts in (1, 5):
        df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
        got = nearest(df, F.col("vec_id") % 20 == 0, k=20, shard=100, block=8).orderBy("query_id", "rank").collect()
        seen.append([tuple(r) for r in got])
    assert seen[0] == seen[1]
    mine = [r for r in seen[0] if r[0] == 20]
    assert [r[2] for r in mine] == sorted(r[2] for r in mine) and len({r[3] for r in mine}) == 1
