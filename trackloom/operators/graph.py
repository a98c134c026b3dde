"""Connected components of links between rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.session import ensure_checkpoint_dir


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node and unit, the smallest node that it reaches over ``links``. Each round takes the least
    label among neighbours and then that label's own label, so rounds grow with the logarithm of a
    unit's length; each is checkpointed in the shared folder. Labels grow with the rows, so the joins
    never send them to all tasks by way of the driver."""
    ensure_checkpoint_dir(links.sparkSession)
    one = links.select(F.col(a).alias("node"), F.col(b).alias("near"))
    both = one.union(one.select(F.col("near").alias("node"), F.col("node").alias("near"))).distinct().checkpoint()
    labels = both.groupBy("node").agg(F.least(F.min("near"), F.col("node")).alias("unit")).checkpoint()
    while True:
        told = both.join(labels.select(F.col("node").alias("near"), "unit").hint("merge"), "near").groupBy("node").agg(F.min("unit").alias("told"))
        step = labels.join(told.hint("merge"), "node").select("node", F.col("unit").alias("old"), F.least("unit", "told").alias("unit"))
        jump = step.select(F.col("node").alias("unit"), F.col("unit").alias("further"))
        new = step.join(jump.hint("merge"), "unit", "left").select("node", "old", F.least("unit", F.coalesce("further", "unit")).alias("unit")).checkpoint()
        labels = new.select("node", "unit")
        if new.filter("unit <> old").isEmpty():
            return labels
