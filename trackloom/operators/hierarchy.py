"""Paths, folders and what is visible in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parent(path: str, separator: str = "/") -> Column:
    """The folder of a path; '' at the top."""
    parts = F.split(path, separator)
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), separator)


def ancestors(path: Column, separator: str = "/") -> Column:
    """The path itself and every folder above it, but the top."""
    parts = F.split(path, separator)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), separator))


def visible(files: DataFrame, public: DataFrame, own: Column, path: str) -> DataFrame:
    """Files that are public themselves or lie in a public folder (column folder), at any depth:
    an equi-join of each file's ancestors with the public folders."""
    folders = public.select("folder").distinct()
    inherited = files.withColumn("folder", F.explode(ancestors(F.col(path)))).join(folders, "folder", "left_semi").select(path).distinct()
    marked = files.join(inherited.withColumn("__in", F.lit(True)), path, "left")
    return marked.filter(own | F.col("__in")).drop("__in")


def public_via(files: DataFrame, public: DataFrame, path: str) -> DataFrame:
    """``files`` with via: the deepest public folder (column folder) that holds the path or is it;
    null if none does."""
    above = files.select(path).distinct().withColumn("folder", F.explode(ancestors(F.col(path))))
    best = above.join(public.select("folder").distinct(), "folder", "left_semi").groupBy(path).agg(F.max_by("folder", F.length("folder")).alias("via"))
    return files.join(best, path, "left").select(*files.columns, "via")
