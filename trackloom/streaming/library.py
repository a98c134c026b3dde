"""Files of positions and logs as they arrive in a folder, kept as tables.

A stream takes so many files a batch as it is told (so a backlog is worked off in pieces of one
size), and polls the folder for as long as its trigger says. Files are known by their content: one
that came before, under whatever name, is not taken again, nor is a batch that is repeated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trackloom.sources import files

FILE = "path string, modificationTime timestamp, length long, content binary"


def lines_of(found: DataFrame) -> DataFrame:
    """file, sha, value of whole files (path, content), line by line."""
    text = F.decode("content", "UTF-8")
    return found.select(F.col("path").alias("file"), F.sha2("content", 256).alias("sha"), F.explode(F.split(text, "\r?\n")).alias("value"))


def positions(found: DataFrame) -> DataFrame:
    return files.positions_of(lines_of(found))


def _note(seen: DataFrame, path: str) -> None:
    seen.write.mode("overwrite").parquet(path)


def _there(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def keep_files(spark: SparkSession, folder: str, table: str, checkpoint: str, rows_of: Callable[[DataFrame], DataFrame] = positions, at_once: int = 100, pattern: str = "*.csv", every: str | None = None) -> StreamingQuery:
    """Rows of the folder's files under ``table``, ``at_once`` files a batch at most: all that are there
    and then no more, or polling ``every`` so often. A batch takes files whose content no other batch
    has noted, of equal ones the first by path, and overwrites its own rows before it notes them, so a
    batch that fails anywhere and is repeated leaves the table as if it had not."""

    def write(batch: DataFrame, number: int) -> None:
        own = f"batch={number}"
        new = batch.withColumn("__sha", F.sha2("content", 256))
        first = new.groupBy("__sha").agg(F.min("path").alias("path"))
        if _there(batch.sparkSession, f"{table}/seen"):
            seen = batch.sparkSession.read.schema("path string, sha string, batch long").parquet(f"{table}/seen").filter(F.col("batch") != number)
            first = first.join(seen.select(F.col("sha").alias("__sha")), "__sha", "left_anti")
        first = first.persist()  # a batch's names and digests
        try:
            rows_of(batch.join(first.select("path"), "path", "left_semi")).write.mode("overwrite").parquet(f"{table}/rows/{own}")
            _note(first.select("path", F.col("__sha").alias("sha")), f"{table}/seen/{own}")
        finally:
            first.unpersist()

    found = spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).option("maxFilesPerTrigger", at_once).load(folder)
    writer = found.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def kept_rows(spark: SparkSession, table: str) -> DataFrame:
    """The rows of batches that were noted; a batch that broke off before has none yet."""
    seen = spark.read.parquet(f"{table}/seen").select(F.col("batch").cast("long").alias("batch")).distinct()
    return spark.read.parquet(f"{table}/rows").join(seen, "batch", "left_semi").drop("batch")
