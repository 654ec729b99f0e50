"""The queries of this subpackage, each over its whole table with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import bpe, compression, langid, ngram_join, packing, quality, secrets, token_store, topk, url_filter
from strata.llm.common import held_out
from strata.session import fresh_path, table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every text, decode the ids again, and give digests of both."""
    coded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), WORD_BPE), WORD_BPE)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def op2_url_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule or model verdict on every page's url."""
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op3_segment_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows for every twentieth vector, by inner product of the quantised vectors."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of the compression bands for every document."""
    return compression.quality_rules(table(spark, sf_dir, "documents"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of each document under links of Jaccard similarity 0.75 or more."""
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents"))


def op6_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed in the shares of their sources into sequences of 2,048 ids."""
    return packing.pack(table(spark, sf_dir, "documents"), WORD_BPE, 1).drop("queue")


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the ids of all documents in order, read the files back, and give a digest of each list."""
    path = fresh_path(spark, "tokens")
    token_store.write_store(table(spark, sf_dir, "documents"), path, BYTE_BPE, 2)
    return token_store.digests(token_store.read_store(spark, path))


def op8_credential_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain and linked secrets of every document."""
    found = secrets.scan_documents(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans")


def op9_quality_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labels that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score_documents(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op10_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the languages that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_codec": op1_bpe_codec,
    "op2_url_ratio": op2_url_ratio,
    "op3_segment_topk": op3_segment_topk,
    "op4_compression_bands": op4_compression_bands,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_mixture_packing": op6_mixture_packing,
    "op7_token_store": op7_token_store,
    "op8_credential_scan": op8_credential_scan,
    "op9_quality_attention": op9_quality_attention,
    "op10_string_kernel_language": op10_string_kernel_language,
}

ORACLE_SQL: dict[str, str] = {
    "op3_segment_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e
            FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        )
        SELECT * FROM r WHERE rank <= 20
    """,
    "op5_ngram_jaccard": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
        ), g AS MATERIALIZED (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS shingle FROM w
        ), n AS MATERIALIZED (
            SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
        ), l AS MATERIALIZED (
            SELECT a.doc_id AS x, b.doc_id AS y FROM g a JOIN g b USING (shingle) JOIN n p ON p.doc_id = a.doc_id JOIN n q ON q.doc_id = b.doc_id
            WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))
        ), c(doc_id, label) USING KEY (doc_id) AS (
            SELECT doc_id, doc_id FROM documents
            UNION
            SELECT l.y, min(c.label) FROM c JOIN l ON l.x = c.doc_id JOIN recurring.c r ON r.doc_id = l.y WHERE c.label < r.label GROUP BY l.y
        )
        SELECT doc_id, coalesce(n, 0) AS n_shingles, label AS component_id FROM c LEFT JOIN n USING (doc_id)
    """,
}
