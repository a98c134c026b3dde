"""Token counts of whole texts by the whole-token shortcut.

The driver proves, with the tokenizers library, which vocabulary strings encode alone as one token
(at most the vocabulary's size, so it is broadcast). Tasks count pre-tokens that are such strings
directly and merge only the rest. There is no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm import bpe
from trackloom.llm.common import map_batches, text_of


def count_tokens(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = 1024, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """One row for each row of ``docs``: the ``keep`` columns, n_bytes, n_tokens, over_limit.

    Null texts count as empty (0 tokens). Repeated rows, null ids and further columns do not
    matter; columns of ``docs`` that are not in ``keep`` are left out, so none can clash. An empty
    table gives an empty result.
    """
    json_path = json_path or bpe.default_path("byte_bpe_50k.json")
    ranks_path = ranks_path or bpe.default_path("byte_bpe_50k.tiktoken")
    spark = docs.sparkSession
    whole = spark.sparkContext.broadcast(bpe.whole_tokens(json_path))
    rows = docs.select(*keep, F.octet_length(text_of(text)).cast("long").alias("n_bytes"), text_of(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text")

    def make():
        count = bpe.Counter(ranks_path, whole.value)

        def work(b: dict[str, list]) -> dict[str, list]:
            texts = b.pop("__text")
            return b | {"n_tokens": list(map(count, texts))}

        return work

    out = map_batches(rows, make, f"{schema}, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
