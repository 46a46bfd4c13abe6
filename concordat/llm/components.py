"""Connected components of a table of links, without gathering links or members anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import drop_tables, written


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of every node of ``links(a, b)``; comp is the least node reachable.

    Rounds of taking the least label among neighbours, then the label of that label (which halves the remaining
    distance), each written to the shared folder so that no lineage grows; sums and minima combine before shuffling.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    label = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")), "labels")
    old = [both]
    while True:
        near = both.join(label, both.b == label.node).groupBy("a").agg(F.min("comp").alias("m"))
        lower = label.join(near, label.node == near.a).select("node", F.col("comp").alias("before"), F.least("comp", "m").alias("c"))
        target = label.select(F.col("node").alias("c"), F.col("comp").alias("further"))
        new = written(lower.join(target, "c").select("node", "before", F.least("c", "further").alias("comp")), "labels")
        old.append(label)
        label = new.select("node", "comp")
        if new.where("before <> comp").isEmpty():
            drop_tables(links.sparkSession, old)
            return label
