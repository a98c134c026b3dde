"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from trackloom.session import ship_package


_frames = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where a local session names none, as in tests, a folder of this machine is made and set;
    on a cluster it must be named.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="trackloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again, so that its
    lineage ends there and a lost executor costs no recomputation. Within scratch() the folder goes
    when it is no longer needed; else the caller keeps it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for frame in getattr(_frames, "open", []):
        frame.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], None]]:
    """Folders that stored() writes in this block are deleted at its end, but for those that results
    given to the yielded function still read. After an error all stay."""
    frames = _frames.open = [*getattr(_frames, "open", []), []]
    kept: list[DataFrame] = []
    try:
        yield kept.append
    finally:
        _frames.open = frames[:-1]
    needed = {f.rsplit("/", 2)[-2] for df in kept for f in df.inputFiles()}
    for path in frames[-1]:
        if path.rsplit("/", 1)[-1] not in needed:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def text_of(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


#: Bytes of a batch that goes to Python, unless the session sets another bound than Spark's default.
BATCH_BYTES = 4 << 20
_BOUND, _DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def _bound_batches(spark: SparkSession) -> None:
    """Texts differ in length by orders of magnitude, so batches are bounded by bytes, not rows."""
    if spark.conf.get(_BOUND) == _DEFAULT:
        spark.conf.set(_BOUND, str(BATCH_BYTES))


def give_back() -> None:
    """Returns memory that a task has freed to the system: workers live on between tasks, several to
    an executor, and would each keep their largest task's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_batches(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, Iterable]]], schema: str) -> DataFrame:
    """Apply a function to column batches, within the tasks that hold the rows.

    ``make`` runs once a task and returns the function from a batch's columns (lists) to the
    result's columns. Batches are bounded by bytes.
    """
    ship_package(df.sparkSession)
    _bound_batches(df.sparkSession)
    types = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, out = make(), None
        for batch in batches:
            if batch.num_rows:
                out = work({n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in types], schema=types)
        del work, out
        give_back()

    return df.mapInArrow(run, schema)


def fold_batches(df: DataFrame, make: Callable[[], tuple[Callable[[dict[str, list]], None], Callable[[], dict[str, Iterable]]]], schema: str) -> DataFrame:
    """As map_batches, but one result a task: ``make`` returns a function that takes a batch's
    columns and one that gives the result's columns after the last."""
    ship_package(df.sparkSession)
    _bound_batches(df.sparkSession)
    types = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        add, result = make()
        for batch in batches:
            if batch.num_rows:
                add({n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)})
        out = result()
        yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in types], schema=types)

    return df.mapInArrow(run, schema)


def stream_batches(df: DataFrame, make: Callable[[], tuple[Callable[[dict[str, list]], dict[str, list]], Callable[[], dict[str, list]]]], schema: str) -> DataFrame:
    """As map_batches, for rows whose order within a task matters: ``make`` returns a function from
    a batch's columns to the result's columns, which may keep a bounded state between batches, and
    one that gives what is left after the last."""
    ship_package(df.sparkSession)
    _bound_batches(df.sparkSession)
    types = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        add, rest = make()
        for batch in batches:
            if batch.num_rows:
                out = add({n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in types], schema=types)
        out = rest()
        yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in types], schema=types)

    return df.mapInArrow(run, schema)
