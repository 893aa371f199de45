"""Connected components of links between integer ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steplake.llm.shared import written


def components(links: DataFrame) -> DataFrame:
    """(node, label): for every end of a link (a, b) the smallest id that links lead to.

    Every round takes the smallest label around a node and then that label's own label, so
    chains shorten by more than half; the labels of a round are a table in the shared folder.
    NULL ends and self-links are no links; an empty table gives none.
    """
    edges = links.select("a", "b").where("a <> b")
    edges = written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    while True:
        around = edges.join(labels, edges.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(around, "node").select("node", "label", F.least("label", "near").alias("low"))
        parents = labels.select(F.col("node").alias("low"), F.col("label").alias("above"))
        after = written(lower.join(parents, "low", "left")
                        .select("node", F.least("low", F.coalesce("above", "low")).alias("label"),
                                (F.least("low", F.coalesce("above", "low")) < F.col("label")).alias("changed")), "labels")
        labels = after.select("node", "label")
        if after.where("changed").limit(1).isEmpty():
            return labels
