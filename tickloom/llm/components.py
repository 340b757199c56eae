"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import common as c


def connected(ws: c.Workspace, links: DataFrame) -> DataFrame:
    """(uid, label) for each end of links (a, b): label is the smallest uid that can be reached.

    Every round takes the smallest label among the neighbours and then the label of
    the label, so long chains halve; each round is a table, so no lineage grows.
    """
    both = ws.table(links.select("a", "b").union(links.select("b", "a")).filter("a != b").distinct(), "edges")
    labels = ws.table(both.groupBy(F.col("a").alias("uid")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("uid").alias("b"), "label"), "b").groupBy(F.col("a").alias("uid")).agg(F.min("label").alias("near"))
        stepped = labels.join(near, "uid").select("uid", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        stepped = ws.table(stepped, "stepped")
        jump = stepped.select(F.col("uid").alias("label"), F.col("label").alias("further"))
        new = ws.table(stepped.join(jump, "label").select("uid", "old", F.least("label", "further").alias("label")), "labels")
        labels = new.select("uid", "label")
        if new.filter("old != label").isEmpty():
            return labels
