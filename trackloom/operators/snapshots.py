"""A shared library kept as versions: a change set goes in as one unit, or not at all.

Every version is a folder of Parquet files that never changes. A writer reads the newest version,
checks its change set against it, writes the next version beside it, and then claims the number by
creating a small pointer file that must not exist yet. Whoever comes second finds the file, reads
the newer version and checks again, ``TRIES`` times at most. Readers see whole versions only.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions.naming import valid_path
from trackloom.operators import library
from trackloom.session import cut

MANIFEST = "path string, sha string, size long, owner long, public boolean"
TRIES = 3
#: Operations of one change set, at most, unless the library is given another bound; fixed value.
MOST_OPS = 2000


@dataclass
class Outcome:
    """ok, invalid, conflict, rejected, missing or busy (others came first each time); the version
    after it, and path and status of the operations that stand in the way."""

    status: str
    version: int
    refused: DataFrame | None = None


class Library:
    """The versions under a folder that driver and executors share. A change set has at most
    ``most_ops`` operations, any number if None."""

    def __init__(self, spark: SparkSession, root: str, most_ops: int | None = MOST_OPS):
        self.spark, self.root, self.most_ops = spark, root.rstrip("/"), most_ops
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def version(self) -> int:
        """The newest version; 0 before the first."""
        folder = self._path("versions")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return max((int(n.split("-")[0]) for n in names if n.split("-")[0].isdigit()), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        """The files of a version (the newest one)."""
        version = self.version() if version is None else version
        if version == 0:
            return self.spark.createDataFrame([], MANIFEST)
        stream = self._fs.open(self._path(f"versions/{version:012d}"))
        try:
            name = stream.readUTF()
        finally:
            stream.close()
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/data/{name}")

    def claim(self, version: int, files: DataFrame) -> bool:
        """Makes ``files`` that version, unless there is one; all of them or none."""
        name = f"{version:012d}-{uuid.uuid4().hex}"
        files.select("path", "sha", F.col("size").cast("long"), F.col("owner").cast("long"), "public").write.parquet(f"{self.root}/data/{name}")
        pointer = self._path(f"versions/{version:012d}")
        if not self._fs.exists(pointer):
            # the name goes into a file of its own first: a pointer is whole from its first moment
            draft = self._path(f"drafts/{name}")
            stream = self._fs.create(draft, False)
            stream.writeUTF(name)
            stream.close()
            self._fs.mkdirs(pointer.getParent())
            if self._link(draft, pointer):
                return True
        self._fs.delete(self._path(f"data/{name}"), True)
        return False

    def _link(self, draft, pointer) -> bool:
        """Renames without overwriting; false if another writer's pointer is there."""
        options = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        array = self.spark.sparkContext._gateway.new_array(options, 1)
        array[0] = options.NONE
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(draft, pointer, array)
        except Exception as e:
            if self._fs.exists(pointer):
                self._fs.delete(draft, False)
                return False
            raise e
        return True

    def commit(self, ops: DataFrame, blobs: DataFrame, user: int, admin: bool = False) -> Outcome:
        """Puts and deletes (op, path, sha, size, prev) as one unit. Nothing is written unless every
        operation is valid, was made against the newest state, is the user's to make and has its
        content among ``blobs``; of several faults the first kind in that order is told."""
        ops = cut(ops.select("op", "path", "sha", "size", "prev"))
        bad = invalid(ops, self.most_ops)
        for _ in range(TRIES):
            at = self.version()
            if bad is not None:
                return Outcome("invalid", at, bad)
            files = self.read(at)
            judged = cut(library.checked(files, ops, blobs, user, admin).filter("status <> 'ok'").select("path", "status"))
            found = {r.status for r in judged.select("status").distinct().collect()}  # three kinds at most
            for kind in ("conflict", "rejected", "missing"):
                if kind in found:
                    return Outcome(kind, at, judged.filter(F.col("status") == kind))
            if self.claim(at + 1, library.applied(files, ops, user)):
                return Outcome("ok", at + 1)
        return Outcome("busy", self.version())


def invalid(ops: DataFrame, most: int | None = MOST_OPS) -> DataFrame | None:
    """path and status of operations that no state could take: unknown kinds, bad paths, two of one
    path, puts without a digest or size (folders: with one), all if none or more than ``most`` are given;
    None if there are none."""
    folder = library.is_folder(F.col("path"))
    digest = F.coalesce(F.rlike("sha", F.lit("^[0-9a-f]{64}$")), F.lit(False)) & F.coalesce(F.col("size") >= 0, F.lit(False))
    put = F.when(folder, (F.coalesce("sha", F.lit("")) == "") & (F.coalesce("size", F.lit(0)) == 0)).otherwise(digest)
    right = F.coalesce(valid_path(F.col("path")), F.lit(False)) & F.when(F.col("op") == "put", put).otherwise(F.coalesce(F.col("op") == "delete", F.lit(False)))
    twice = ops.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("path", F.lit("twice").alias("status"))
    wrong = cut(ops.filter(~right).select("path", F.lit("invalid").alias("status")).unionByName(twice))
    n = ops.limit(1 if most is None else most + 1).count()
    if n == 0 or (most is not None and n > most):
        return ops.select("path", F.lit("number").alias("status"))
    return None if wrong.isEmpty() else wrong
