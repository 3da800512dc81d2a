"""Connected components of a link table, by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmaq.llm.store import written


def components(links: DataFrame) -> DataFrame:
    """links(a, b) of long ids to (id, component): the least id reachable, for every id that has a link.

    Every round each label hooks onto the least label it has a link to, while labels jump along to
    their own label, so a chain of n links takes about log n rounds. Links whose ends have one label
    are dropped. Minima are combined on the map side, so a node with very many links sends one row a
    task. Null ids are not allowed; loops and repeated links don't matter.
    """
    links = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = written(ends.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("least")).select("id", F.least("id", "least").alias("component")))
    while True:
        of_a = label.select(F.col("id").alias("a"), F.col("component").alias("ca"))
        of_b = label.select(F.col("id").alias("b"), F.col("component").alias("cb"))
        apart = links.join(of_a, "a").join(of_b, "b").where("ca <> cb")
        links = written(apart.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct())
        jump = label.where("id <> component").select("id", "component")
        hook = links.select(F.col("b").alias("id"), F.col("a").alias("component"))
        lower = written(jump.unionByName(hook).groupBy(F.col("id").alias("component")).agg(F.min("component").alias("lower")).join(label.select("component").distinct(), "component", "left_semi"))
        if lower.isEmpty():
            return label
        label = written(label.join(lower, "component", "left").select("id", F.least("component", "lower").alias("component")))
