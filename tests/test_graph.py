"""Components of links, and that their labels do not go through the driver."""

from pyspark.sql import DataFrame

from trackloom.operators import graph


def test_components_send_no_labels_to_all_tasks(spark, monkeypatch):
    plans, plain = [], type(spark.range(1)).checkpoint

    def checkpoint(self: DataFrame, *args, **kwargs):
        out = plain(self, *args, **kwargs)
        plans.append(self._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(type(spark.range(1)), "checkpoint", checkpoint)
    links = spark.range(1, 400).selectExpr("id AS a", "CASE WHEN id % 10 > 0 THEN id - 1 ELSE id END AS b")
    got = {r.node: r.unit for r in graph.components(links, "a", "b").collect()}
    assert got == {n: n - n % 10 for n in range(400)}
    assert any("isFinalPlan=true" in p for p in plans) and not any("Broadcast" in p for p in plans)
