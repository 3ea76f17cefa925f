import os

import pytest

import __spark_entry__ as contract
import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_work_on_what_is_left(spark, tmp_path):
    rows = [(i, f"clean words number {i} here " + " ".join(f"w{i}x{j}" for j in range(50)), "en", "s", 1) for i in range(20)]
    rows += [(30, rows[3][1], "en", "s", 1), (31, None, "en", "s", 1), (32, "", None, None, None)]
    shared = " ".join(f"p{j}" for j in range(60))
    own = [" ".join(f"{side}{i}x{j}" for j in range(20)) for i in range(2) for side in "se"]
    rows += [(40 + i, f"{own[2 * i]} {shared} {own[2 * i + 1]}", "en", "s", 1) for i in range(2)]
    rows += [(50, 'my token = "0123456789abcdef0123456789abcdef" ok', "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    kept = docs
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept, str(tmp_path))
        if n < len(corpus_pipeline.STAGES) - 1:
            assert out.schema.simpleString() == docs.schema.simpleString(), name
        out.write.parquet(f"{tmp_path}/{n}")
        kept = spark.read.parquet(f"{tmp_path}/{n}")
        ids = {r["doc_id"] for r in kept.select("doc_id").distinct().collect()}
        if n == 1:
            assert ids == {r[0] for r in rows} - {30}
        if n == 3:
            texts = {r["doc_id"]: r["text"] for r in kept.collect()}
            assert texts[40] == f"{own[0]} {own[1]}" and texts[50] == 'my [SECRET]" ok'
            assert texts[31] is None and texts[5] == rows[5][1]
    assert {"doc_id", "ids", "sequence_id"} <= set(kept.columns)


def test_run_with_labels_copies_and_secrets(spark, tmp_path):
    from tokenizers import Tokenizer

    own = lambda i, n=60: " ".join(f"w{i}x{j}" for j in range(n))
    texts = {i: own(i) + (" vilecur" if i < 20 else "") for i in range(100)}
    texts |= {200: texts[30] + " tail", 210: 'my token = "0123456789abcdef0123456789abcdef" ok', 211: None, 212: ""}
    shared = " ".join(f"p{j}" for j in range(60))
    texts |= {220 + i: f"{own(f'a{i}', 20)} {shared} {own(f'b{i}', 20)}" for i in range(2)}
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts.items()],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i < 20)) for i in range(100)],
                          "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    want = {i: t for i, t in texts.items() if not (i < 20 or i == 200)}
    want |= {210: 'my [SECRET]" ok'} | {220 + i: f"{own(f'a{i}', 20)} {own(f'b{i}', 20)}" for i in range(2)}
    got = {}
    for r in contract.queries()["pipeline"](spark, str(tmp_path)).collect():
        got.setdefault(r["doc_id"], []).extend(r["ids"])
    assert got.keys() == want.keys()
    lib = Tokenizer.from_file(corpus_pipeline.public_tokenizers.path("word_bpe_49k.json"))
    wrong = {i for i, t in want.items() if sorted(got[i]) != sorted(lib.encode(t or "", add_special_tokens=False).ids + [2])}
    assert not wrong, wrong


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_all_are_registered():
    names = contract.queries()
    assert [n for n in range(1, 11) if not any(k.startswith(f"op{n}_") for k in names)] == [] and "pipeline" in names


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["op2_merkle_fixity_audit", "op10_p_stable_embedding_dedup"])
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("pages", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = contract.queries()[name](spark, SF)
    cur = con.execute(contract.oracle_sql()[name])
    at = [[d[0] for d in cur.description].index(c) for c in df.columns]
    assert sorted(tuple(r) for r in df.collect()) == sorted(tuple(r[i] for i in at) for r in cur.fetchall())
