"""The registered queries of the training-data operators (``opN_<name>``) and
their DuckDB twins where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunk_dedup, decontaminate, embedding_dedup, exact_dedup, hard_negatives, license_scan, minhash, packing, secret_scan, token_counts, toxicity, warc, whitening
from .common import rows_of

#: Token limit that op3 reports on.
TOKEN_LIMIT = 1024
#: What op1 puts after each document.
END_ID = 2


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows with their lexical neighbours."""
    docs = rows_of(spark, sf_dir, "documents")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID, with_ids=False)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence paragraphs of all documents and their families."""
    docs = rows_of(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.scan(docs, license_scan.train(docs))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document, read off the written prefix counts."""
    docs = rows_of(spark, sf_dir, "documents")
    store = token_counts.count_store(docs, public_tokenizers.path("byte_bpe_50k.json"))
    out = token_counts.answers(store, TOKEN_LIMIT)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"), "cut_chars")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return minhash.near_duplicates(rows_of(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document and its offending spans."""
    docs = rows_of(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, rows_of(spark, sf_dir, "labels"))
    out = toxicity.score(docs, model)
    predicted = (F.col("_score") >= 0.5).cast("int")
    return out.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), F.col("_score").alias("score"), predicted.alias("predicted"), F.to_json("_spans").alias("spans"))


def op6_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of documents that other documents hold as well."""
    return chunk_dedup.repeated_passages(rows_of(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item, and which."""
    return decontaminate.contaminated(rows_of(spark, sf_dir, "documents"), rows_of(spark, sf_dir, "benchmark"))


def op8_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page as a WARC record and read the archives back."""
    folder = warc.archive_folder(spark)
    warc.write_archives(rows_of(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, folder, payload=False).drop("url")


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link count and component of every embedding, within its label."""
    return embedding_dedup.near_duplicates(rows_of(spark, sf_dir, "embeddings"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document: the base kinds and what the models add."""
    docs = rows_of(spark, sf_dir, "documents").select("doc_id", "text")
    model = secret_scan.train(secret_scan.labelled_samples(docs))
    found = secret_scan.scan(docs, model)
    counts = [secret_scan.count_kind(F.col("_spans"), k).alias(f"n_{k}") for k in secret_scan.KINDS]
    digest = F.sha2(secret_scan.written(F.col("_base")), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, secret_scan.written(F.col("_spans")).alias("spans"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leading whitened components of every embedding."""
    return whitening.whiten(rows_of(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth embedding's positives, among all embeddings."""
    vectors = rows_of(spark, sf_dir, "embeddings")
    vectors = vectors.withColumn("label", hard_negatives.shifted_label(F.col("label"), F.col("vec_id")))
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0)


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row that stays for every document's text, by a persistent digest index."""
    return exact_dedup.deduplicate(rows_of(spark, sf_dir, "documents"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_license_scan": op2_license_scan,
    "op3_token_counts": op3_token_counts,
    "op4_minhash": op4_minhash,
    "op5_toxicity": op5_toxicity,
    "op6_chunk_dedup": op6_chunk_dedup,
    "op7_decontaminate": op7_decontaminate,
    "op8_warc_zstd": op8_warc_zstd,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_secret_scan": op10_secret_scan,
    "op11_whitening": op11_whitening,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_exact_dedup": op13_exact_dedup,
}

# base32 of a SHA-1: the 160 bits in groups of five
_BASE32 = """array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + list_sum(list_transform(range(5), lambda b: (1 << (4 - b)) * (substr(bits, k * 5 + b + 1, 1) = '1')::INT))::INT, 1)), '')"""

ORACLE: dict[str, str] = {
    "op8_warc_zstd": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, unhex(sha1(body))::BIT::VARCHAR AS bits,
             min(page_id) OVER (PARTITION BY sha1(body)) AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM d""",
    "op9_embedding_dedup": """
WITH RECURSIVE ok AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b
    ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach(node, seen) AS (
  SELECT DISTINCT a, a FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen),
root AS (SELECT node, min(seen) AS root FROM reach GROUP BY node),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(root.root, e.vec_id) AS component_id,
       coalesce(root.root, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN root ON root.node = e.vec_id LEFT JOIN n ON n.a = e.vec_id""",
    "op12_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
         list_inner_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, p.positive_id,
       (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other))::INT AS rank,
       s.other AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
 AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
QUALIFY rank <= 5""",
    "op13_exact_dedup": """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                           'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)""",
}
