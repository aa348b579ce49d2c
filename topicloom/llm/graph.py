"""Connected components of links, as DataFrames throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of ``links``; the label is the component's least node.

    Minimum labels pass over the links, and each label is replaced by its own
    label; every round is written out, so a path of n links takes about log n
    rounds and a lost executor costs one round at most. Null ends are ignored.
    """
    e = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x <> y")
    e = materialise(e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "cc-links")
    labels = materialise(e.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("label")).select(F.col("x").alias("node"), "label"), "cc-labels")
    old = labels
    while True:
        near = e.join(labels, F.col("y") == F.col("node")).groupBy("x").agg(F.min("label").alias("low"))
        up = labels.select(F.col("node").alias("n"), F.col("label").alias("up"))
        step = labels.join(near, F.col("node") == F.col("x"), "left").join(up, F.col("label") == F.col("n"), "left")
        new = materialise(step.select("node", F.col("label").alias("was"), F.least("label", F.coalesce("low", "label"), F.coalesce("up", "label")).alias("label")), "cc-labels")
        discard(old)
        old, labels = new, new.select("node", "label")
        if new.where("label <> was").isEmpty():
            discard(e)
            return labels


def joined(labels: DataFrame | None, links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The labels of all links so far from those of earlier ones and the new links: only components are linked, not nodes."""
    if labels is None:
        return components(links, a, b)
    of = lambda end, name: labels.select(F.col("node").alias(end), F.col("label").alias(name))
    between = links.select(a, b).join(of(a, "_la"), a, "left").join(of(b, "_lb"), b, "left").select(F.coalesce("_la", a).alias("a"), F.coalesce("_lb", b).alias("b"))
    moved = components(between.where("a <> b").distinct()).select(F.col("node").alias("_n"), F.col("label").alias("_to"))
    old = labels.join(moved, F.col("label") == F.col("_n"), "left").select("node", F.coalesce("_to", "label").alias("label"))
    new = moved.join(labels, F.col("_n") == F.col("node"), "left_anti").select(F.col("_n").alias("node"), F.col("_to").alias("label"))
    return materialise(old.unionByName(new), "labels")
