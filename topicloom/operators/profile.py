"""Cluster profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def concept_scores(labels: DataFrame, weights: DataFrame, top: int = 10) -> DataFrame:
    """(cluster_id, concept, score, rank): mean weight times prevalence, both over the cluster's size."""
    size = labels.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    s = labels.join(weights, "item_id").groupBy("cluster_id", "concept").agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n")).join(size, "cluster_id")
    s = s.withColumn("score", F.round(F.col("w") / F.col("size") * (F.col("n") / F.col("size")), 6))
    best = Window.partitionBy("cluster_id").orderBy(F.desc("score"), "concept")
    return s.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("cluster_id", "concept", "score", "rank")


def label_shares(labels: DataFrame, truth: DataFrame, top: int = 5) -> DataFrame:
    """(cluster_id, label, n, share, rank)."""
    t = labels.join(truth, "item_id").groupBy("cluster_id", "label").agg(F.count(F.lit(1)).alias("n"))
    t = t.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("cluster_id")), 6))
    best = Window.partitionBy("cluster_id").orderBy(F.desc("n"), "label")
    return t.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)


def profiles(labels: DataFrame, weights: DataFrame, prompts: DataFrame, truth: DataFrame | None = None, *, concepts: int = 10, examples: int = 3, least_chars: int = 10, cut_chars: int = 300) -> DataFrame:
    """One nested row per cluster: size, top concepts, example prompts with most concepts first, dominant label and purity."""
    size = labels.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    top = concept_scores(labels, weights, concepts).groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("rank", "concept", "score"))).alias("top_concepts"))
    n = weights.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_concepts"))
    p = labels.join(prompts.select("item_id", "prompt").where(F.length(F.trim("prompt")) > least_chars), "item_id").join(n, "item_id", "left").fillna(0, ["n_concepts"])
    p = p.withColumn("rank", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("n_concepts"), "item_id"))).where(F.col("rank") <= examples)
    p = p.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("rank", "item_id", F.substring("prompt", 1, cut_chars).alias("prompt"), "n_concepts"))).alias("example_prompts"))
    out = size.join(top, "cluster_id", "left").join(p, "cluster_id", "left")
    if truth is not None:
        from .evaluate import purity

        out = out.join(purity(labels, truth).select("cluster_id", F.struct("dominant", "purity").alias("gt")), "cluster_id", "left")
    return out


def slim(profile: DataFrame, clusters: int = 30, concepts: int = 10, prompts: int = 3) -> DataFrame:
    """The largest clusters with fewer columns."""
    return profile.orderBy(F.desc("size"), "cluster_id").limit(clusters).select("cluster_id", "size", F.slice("top_concepts.concept", 1, concepts).alias("concepts"), F.slice("example_prompts.prompt", 1, prompts).alias("prompts"))


def preview(labels: DataFrame, weights: DataFrame, prompts: DataFrame, clusters: int = 20, concepts: int = 4, examples: int = 3, cut_chars: int = 100) -> DataFrame:
    """(cluster_id, size, concepts, prompts): a few concepts and prompts of the largest clusters."""
    p = profiles(labels, weights, prompts, concepts=concepts, examples=examples, least_chars=0, cut_chars=cut_chars)
    return slim(p, clusters, concepts, examples)


def size_summary(labels: DataFrame) -> DataFrame:
    size = labels.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    return size.agg(F.round(F.avg("size"), 6).alias("mean_size"), F.percentile("size", 0.5).alias("median_size"), F.min("size").alias("min_size"), F.max("size").alias("max_size"))


def summary(labels: DataFrame, truth: DataFrame) -> DataFrame:
    """(what, mean, median, least, most) of cluster sizes and purities."""
    from .evaluate import purity

    rows = lambda df, c, name: df.agg(F.round(F.avg(c), 6).alias("mean"), F.percentile(F.col(c).cast("double"), 0.5).alias("median"), F.min(F.col(c).cast("double")).alias("least"), F.max(F.col(c).cast("double")).alias("most")).select(F.lit(name).alias("what"), "*")
    size = labels.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    return rows(size, "size", "size").unionByName(rows(purity(labels, truth), "purity", "purity"))
