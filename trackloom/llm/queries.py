"""The queries of this subpackage over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import bpe, conversation_trie, exact_search, language_id, media, merkle, near_dedup, packing, periodic_runs, pii, secrets, sentencepiece_codec, token_counts, toxicity

#: The key of the pseudonyms in the registered query and the pipeline; give your own in production.
PSEUDONYM_SECRET = "trackloom-example"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_docs(spark, sf_dir))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trips(_docs(spark, sf_dir), bpe.default_path("piece_bpe_32k.model"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media.documents_as_media(_docs(spark, sf_dir))
    return out.drop("shard", "offset")


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the documents are scanned first, then all with the ledger of that scan: only what it
    lacks is read again."""
    docs = _docs(spark, sf_dir)
    _, ledger = secrets.scan(docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0))
    return secrets.digests(secrets.scan(docs, ledger)[0])


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    found = language_id.identify(docs.select("doc_id", "text"), language_id.fit(docs))
    return found.select("doc_id", (~language_id.in_training()).alias("held_out"), "lang_pred", "score", F.size("lang_spans").cast("long").alias("n_spans"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = toxicity.score(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (~language_id.in_training()).alias("held_out"), "score", "predicted", F.size(F.array_distinct("clauses.start")).cast("long").alias("n_clauses"))


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(_docs(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(_docs(spark, sf_dir), 1024, 0, {"ids_crc32": F.crc32("ids")})
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.pseudonymise(_docs(spark, sf_dir).select("doc_id", "text"), PSEUDONYM_SECRET))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_docs(spark, sf_dir), k=2, percent=80)


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def repeated(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words that op12 takes: in one document of ten those from a place on repeat with a period,
    both by the CRC of doc_id."""
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is None or not n or h % 10:
        return words
    g = h // 10
    start = g % n
    period = 1 + (n - start) // (3 + g % 8)
    return words[: start + period] + [words[start + i % period] for i in range(period, n - start)]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.periodic_runs(_docs(spark, sf_dir), rewrite=repeated))


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = exact_search.quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 64)
    return exact_search.top_k(vectors.filter("vec_id % 20 = 0"), vectors, 20)


_OPERATORS = (
    *(op1_token_counts, op2_sentencepiece, op3_media_columns, op4_secret_scans, op5_language_id, op6_toxicity, op7_document_fingerprints),
    *(op8_packing, op9_pii, op10_minhash_near_dedup, op11_conversation_prefix_trie, op12_periodic_runs, op13_exact_top_k),
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {"op4_secret_scans": secrets.oracle(), "op7_document_fingerprints": merkle.oracle(), "op11_conversation_prefix_trie": conversation_trie.oracle(), "op13_exact_top_k": exact_search.oracle(64, 20, 20)}
