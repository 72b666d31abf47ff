"""Connected components of a link table, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectio.llm.common import stage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, component)`` for every id with a link; the component is the
    smallest id that links reach.

    Every round hands each id the smallest label among its own and its
    neighbours', then the label of that label; rounds go on until no label
    changes (their number grows with the logarithm of the longest chain).
    Labels are written each round, so lineage stays short.
    """
    both = links.select(F.col(a).alias("id"), F.col(b).alias("to")).unionByName(
        links.select(F.col(b).alias("id"), F.col(a).alias("to"))).filter("id <> to").distinct()
    edges = stage(both, "component-edges")
    labels = stage(edges.groupBy("id").agg(F.min("to").alias("m"))
                   .select("id", F.least("id", "m").alias("component")), "component-labels")
    while True:
        near = (edges.join(labels.withColumnRenamed("id", "to"), "to").groupBy("id")
                .agg(F.min("component").alias("near")))
        hop = labels.select(F.col("id").alias("component"), F.col("component").alias("further"))
        step = (labels.join(near, "id").withColumnRenamed("component", "old")
                .withColumn("component", F.least("old", "near"))
                .join(hop, "component", "left")
                .select("id", F.least("component", "further").alias("component"), "old"))
        step = stage(step, "component-labels")
        labels = step.drop("old")
        if step.filter("component <> old").isEmpty():
            return labels


def joined(labels: DataFrame, links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``labels`` (of :func:`components`) after further links: only the
    components that these join are labelled anew, not every earlier link."""
    def own(c: str) -> DataFrame:
        return labels.select(F.col("id").alias(c), F.col("component").alias(f"_{c}"))

    between = links.select(a, b).join(own(a), a, "left").join(own(b), b, "left").select(
        F.coalesce(f"_{a}", a).alias("a"), F.coalesce(f"_{b}", b).alias("b"))
    merged = components(between)
    new = merged.select(F.col("id").alias("component"), F.col("component").alias("_new"))
    old = labels.join(new, "component", "left").select("id", F.coalesce("_new", "component").alias("component"))
    return stage(old.unionByName(merged.join(labels.select("id"), "id", "left_anti")), "component-labels")
