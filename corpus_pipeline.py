"""The corpus pipeline: language, toxicity, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; results are
written as Parquet and read again between stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import language_id, near_dedup, packing, pii, toxicity
from trackloom.llm.common import scratch, stored
from trackloom.llm.queries import PSEUDONYM_SECRET


def _beside(docs: DataFrame, made: tuple[str, ...]) -> tuple[DataFrame, list]:
    """``docs`` with columns named like those that an operator makes set aside, and the columns that
    give all of them back under their own names."""
    aside = {c: f"__own_{i}" for i, c in enumerate(docs.columns) if c.lower() in made}
    return docs.withColumnsRenamed(aside), [F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a known language: null, without a letter, mostly in scripts of no learned
    language, with trigrams less likely than held-out rows' (language_id.in_known_language), or with
    no language at a score of 0.35. lang stays the source's label. All columns of docs stay as they
    are, whatever their names."""
    model = language_id.fit(docs)
    rows, own = _beside(docs, ("lang_pred", "score", "lang_spans", "lang_letters", "lang_fit", "lang_known"))
    found = language_id.identify(rows, model)
    return found.filter(language_id.in_known_language(language_id.usual_fit(docs, model)) & (F.col("score") >= 0.35)).select(*own)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts whose score is 0.3 or more; all columns stay as they are."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows, own = _beside(docs, ("score", "predicted", "clauses"))
    return toxicity.score(rows, model).filter("predicted = 0").select(*own)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group (of similarity 0.8 on shingles of five words) stays: the one of
    least doc_id. Of repeated rows of that doc_id one stays; null ids stay."""
    with scratch(spark) as keep:
        kept = stored(near_dedup.near_duplicates(docs, k=5, percent=80).filter("kept").select("doc_id").distinct(), "pipeline-kept")
        keep(kept)
    known = docs.filter(F.col("doc_id").isNotNull()).join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return known.select(*docs.columns).unionByName(docs.filter(F.col("doc_id").isNull()))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms; n_chars follows the new text, other columns stay as they are."""
    rows, own = _beside(docs, ("pii",))
    out = pii.pseudonymise(rows, PSEUDONYM_SECRET)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*own)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    return packing.pack(docs, 1024, 0, {"ids_crc32": F.crc32("ids")})


STAGES = [
    ("language_id", identify_language),
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("pii", replace_personal_data),
    ("packing", pack_sequences),
]

#: Learned scores, signatures and tokenisation are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; folders between stages are deleted but for those that the
    result reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark) as keep:
        for i, (name, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            if i < len(STAGES) - 1:
                docs = stored(docs, f"pipeline-{name}")
        keep(docs)
    return docs
