"""A member's copy of a shared library, brought level with it in both directions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.functions.naming import match_key
from trackloom.operators import graph, library, sets
from trackloom.session import cut


@dataclass
class Synced:
    """state: path with the digests local and base after the sync; remote: the library after it;
    refused: path, status of operations that were not allowed; undone: paths of their units."""

    state: DataFrame
    remote: DataFrame
    refused: DataFrame
    undone: DataFrame


def units(ops: DataFrame) -> DataFrame:
    """``ops`` with unit, by which they stand or fall together: a match's files are one, and so is a
    move, a put of content that a delete of the same set takes away. Of several such deletes the one
    of the greatest path counts."""
    key = F.when(library.is_folder(F.col("path")), F.col("path")).otherwise(match_key(F.col("path")))
    keyed = cut(ops.withColumn("__key", key))
    lost = keyed.filter("op = 'delete' AND coalesce(prev, '') <> ''").groupBy(F.col("prev").alias("sha")).agg(F.max_by("__key", "path").alias("__from"))
    links = keyed.filter("op = 'put'").join(lost, "sha").select("__key", "__from").filter(F.col("__key") != F.col("__from")).distinct()
    named = graph.components(links, "__key", "__from").select(F.col("node").alias("__key"), "unit")
    return keyed.join(named, "__key", "left").withColumn("unit", F.coalesce("unit", "__key")).drop("__key")


def synced(base: DataFrame, local: DataFrame, remote: DataFrame, blobs: DataFrame, user: int, member: bool = True) -> Synced:
    """One sync of ``local`` (path, sha, size) with ``remote`` (path, sha, size, owner, public), both
    having been ``base`` (path, sha) last time; ``blobs`` (sha) has what the library holds or the
    member can send.

    What changed there only comes here (for viewers: also what changed here too). A member's own
    changes go there, over other changes of the same path. Where an operation is refused its whole
    unit is undone here, and the others are sent without it: whether one is refused depends on the
    library alone, so the first check tells all.
    """
    rows = cut(sets.three_way(base, local, remote, "path", "sha"))
    here, there = ~F.col("local").eqNullSafe(F.col("base")), ~F.col("remote").eqNullSafe(F.col("base"))
    pulled = there & ~here if member else there
    sizes = local.select("path", F.col("size").cast("long").alias("size"))
    mine = rows.filter((F.lit(member) & here) & ~F.col("local").eqNullSafe(F.col("remote")))
    put = F.col("local").isNotNull()
    ops = mine.join(sizes, "path", "left").select(F.when(put, "put").otherwise("delete").alias("op"), "path", F.col("local").alias("sha"), "size", F.col("remote").alias("prev"))
    judged = cut(library.checked(remote, units(ops), blobs, user))
    bad = judged.filter("status <> 'ok'")
    lost = judged.join(bad.select("unit").distinct(), "unit", "left_semi")
    undone = cut(lost.select("path"))
    sent = judged.join(undone, "path", "left_anti").drop("status", "unit")
    marked = rows.join(undone.withColumn("__undone", F.lit(True)), "path", "left")
    theirs = pulled | F.coalesce("__undone", F.lit(False))
    settled = F.when(theirs, F.col("remote")).when(F.lit(member) & here, F.col("local")).otherwise(F.col("base"))
    state = marked.select("path", F.when(theirs, F.col("remote")).otherwise(F.col("local")).alias("local"), settled.alias("base")).filter("local IS NOT NULL OR base IS NOT NULL")
    return Synced(state, library.applied(remote, sent, user), bad.select("path", "status"), undone)
