"""The thin registered queries: whole tables, production parameters, digest columns.

Tokenizer files are named by the installed vocabulary package; their paths are parameters of the operators.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from .registry import query, table

WORD_BPE, PIECE_BPE, BYTE_BPE = "word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_50k.json"


@query("op3_power_of_two_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    packed = pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), end_id=2, max_len=4096)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "batch_id")


@query("op8_offset_preserving_pieces")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encode

    coded = encode(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_BPE))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), F.try_element_at("ends", F.lit(-1)).alias("last_byte"))


@query("op7_noisy_or_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import held_out, score, train

    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("sentences").alias("offending_sentences"))


@query("op9_crf_secrets")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import find, train

    docs = table(spark, sf_dir, "documents")
    return _span_digest(find(docs, train(docs)), ("assign", "access", "hex"))


def _span_digest(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Counts and digests of spans that come sorted by start and kind."""
    listed = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return found.select("doc_id", *[count(k) for k in kinds], F.sha2(listed(base), 256).alias("base_sha256"),
                        listed(F.col("spans")).alias("spans"))


@query("op6_hash_prefix_forest")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_forest import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query("op10_p_stable_embedding_dedup", sql="""
    WITH unit AS (
      SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
    fine AS (
      SELECT vec_id, label, e FROM unit WHERE label IS NOT NULL AND e IS NOT NULL
        AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
    pairs AS (
      SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
    reach AS (
      WITH RECURSIVE r(a, b) AS (
        SELECT vec_id, vec_id FROM embeddings
        UNION
        SELECT r.a, p.b FROM r JOIN pairs p ON p.a = r.b)
      SELECT a, min(b) AS component_id FROM r GROUP BY a),
    counted AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
    SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
    FROM embeddings e JOIN reach ON reach.a = e.vec_id LEFT JOIN counted ON counted.a = e.vec_id""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


@query("op4_seed_and_extend")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import mark

    marked = mark(table(spark, sf_dir, "documents"), window=35)
    return marked.select("doc_id", "n_words", "n_removed", "kept_sha256", F.size("repeats").alias("n_repeats"))


@query("op5_min_max_hashing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash_dedup import mark

    return mark(table(spark, sf_dir, "documents"), words=4, percent=80)


@query("op2_merkle_fixity_audit", sql="""
    WITH records AS (
      SELECT page_id, coalesce(url, '') AS url, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10)
        || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: '
        || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '')
        || chr(13) || chr(10) || chr(13) || chr(10) AS record
      FROM pages),
    placed AS (
      SELECT page_id, strlen(record) AS rec_length,
        sum(strlen(record)) OVER (ORDER BY page_id NULLS FIRST, url, sha256(record)
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - strlen(record) AS pos
      FROM records)
    SELECT page_id, CAST(pos // 16777216 AS BIGINT) AS file_no, CAST(pos % 16777216 AS BIGINT) AS rec_offset,
      CAST(rec_length AS BIGINT) AS rec_length, CASE WHEN page_id % 89 = 1 THEN 'missing' ELSE 'changed' END AS damage
    FROM placed WHERE page_id % 89 = 1 OR page_id % 97 = 3""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as an archive, against a replica that lost some records and holds a changed byte in others."""
    from ..session import cut_lineage
    from .fixity import AT, audit, laid_out, warc_record

    record = warc_record("url", "html")
    spoilt = F.when(F.col("page_id") % 97 == 3, F.concat(F.lit("?"), F.substring("record", 2, 1 << 30))).otherwise(F.col("record"))
    slim = table(spark, sf_dir, "pages").select("page_id", F.coalesce("url", F.lit("")).alias("url"), record.alias("record")).select(
        "page_id", "url", F.octet_length("record").cast("long").alias("rec_length"), F.sha2("record", 256).alias("digest"),
        F.sha2(spoilt, 256).alias("held"))
    archive = cut_lineage(laid_out(slim, ["page_id", "url", "digest"], "rec_length"), "archive")
    replica = archive.filter(~F.coalesce(F.col("page_id") % 89 == 1, F.lit(False))).select(*AT, "rec_length", F.col("held").alias("digest"))
    found = audit(archive.select(*AT, "rec_length", "digest"), replica)
    return found.join(archive.select(*AT, "page_id"), AT, "left").select("page_id", *AT, "rec_length", "damage")


@query("op1_bootstrapped_pii")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, extract

    return _span_digest(extract(table(spark, sf_dir, "documents")), KINDS)


@query("op11_bit_sliced_spelling")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import group

    return group(table(spark, sf_dir, "documents"))


@query("op12_url_filter")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge, labelled_urls, train

    return judge(table(spark, sf_dir, "pages"), train(labelled_urls(spark)))


@query("op13_spill_counted_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .alignment import align

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECE_BPE))
