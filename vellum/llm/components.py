"""Connected components of a link table, held by Spark from first to last."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.tables import discard, scratch_path, written


def connected_components(links: DataFrame, a: str = "a", b: str = "b", most: int = 200) -> DataFrame:
    """One row (node, label) for every node of a link; label is the smallest node of its component.

    Each round every node takes the least label among its neighbours, then its label's label (pointer jumping), so the number of rounds
    follows the logarithm of the longest path in practice. Hot nodes only meet map-side minima; both sides of the joins are plain
    scans, so Spark splits the partition of a hot node. Each round is written out and the one before deleted, one count comes back.
    """
    spark = links.sparkSession
    edges = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x <> y")
    edges = written(edges.union(edges.select("y", "x")).distinct(), "edges")
    labels = written(edges.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("label")), "labels")
    old: list[str] = []
    for _ in range(most):
        near = edges.join(labels, edges["x"] == labels["node"]).groupBy(F.col("y").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node", "left").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        step = step.join(up, "label", "left").select("node", "was", F.least("label", "up").alias("label"))
        path = scratch_path(spark, "labels")
        step.write.parquet(path)
        step = spark.read.schema(step.schema).parquet(path)
        changed = step.where("label <> was").limit(1).count()
        labels = step.select("node", "label")
        for x in old:
            discard(spark, x)
        old = [path]
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {most} rounds")
