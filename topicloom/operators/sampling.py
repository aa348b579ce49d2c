"""Deterministic sampling, quotas and triplets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def shuffled(seed: int, *columns: str) -> Column:
    """A reproducible random order: a hash that other engines compute alike."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def uniform(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement."""
    return df.orderBy(shuffled(seed, id_col), id_col).limit(n)


def stratified(df: DataFrame, id_col: str, stratum: str, n: int, seed: int = 42) -> DataFrame:
    """About ``n`` rows in proportion: two per stratum at least, its size at most, cut to ``n`` in shuffled order."""
    size = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("size"))
    total = size.agg(F.sum("size").alias("total"))
    quota = size.join(total).select(stratum, F.least("size", F.greatest(F.lit(2), F.round(F.lit(float(n)) * F.col("size") / F.col("total")))).cast("int").alias("quota"))
    w = Window.partitionBy(stratum).orderBy(shuffled(seed, id_col), id_col)
    ranked = df.join(quota, stratum).withColumn("_r", F.row_number().over(w))
    return ranked.where("_r <= quota").drop("_r", "quota").orderBy(shuffled(seed + 1, id_col), id_col).limit(n)


def capped(df: DataFrame, id_col: str, stratum: str, n: int, least: int = 1, most: int = 5, seed: int = 42) -> DataFrame:
    """``least`` to ``most`` rows per stratum; what is left of ``n`` goes to the largest strata, one each, in turn."""
    size = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("size"))
    one = size.withColumn("base", F.least("size", F.greatest(F.lit(least), F.least(F.lit(most), F.floor(F.lit(n) / F.count(F.lit(1)).over(Window.partitionBy()))))))
    one = one.withColumn("left", F.lit(n) - F.sum("base").over(Window.partitionBy())).withColumn("order", F.row_number().over(Window.orderBy(F.desc("size"), stratum)))
    quota = one.select(stratum, F.least("size", F.col("base") + (F.col("order") <= F.col("left")).cast("int")).alias("quota"))
    w = Window.partitionBy(stratum).orderBy(shuffled(seed, id_col), id_col)
    return df.join(quota, stratum).withColumn("_r", F.row_number().over(w)).where("_r <= quota").drop("_r", "quota").orderBy(shuffled(seed + 1, id_col), id_col).limit(n)


def batches(df: DataFrame, value: str, weight: str, size: int = 200) -> DataFrame:
    """(value, batch): values by falling weight in batches of ``size``; ranked within equal weights and two first letters, after the counts before."""
    rows = df.select(value, F.col(weight).alias("_w"), F.substring(value, 1, 2).alias("_p"))
    counts = rows.groupBy("_w", "_p").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy(F.desc("_w"), "_p").rowsBetween(Window.unboundedPreceding, -1))  # one row a weight and prefix
    counts = counts.select(F.col("_w").alias("_cw"), F.col("_p").alias("_cp"), F.coalesce(before, F.lit(0)).alias("_before"))
    row = F.row_number().over(Window.partitionBy("_w", "_p").orderBy(value))
    ranked = rows.withColumn("_row", row).join(counts, F.col("_w").eqNullSafe(F.col("_cw")) & F.col("_p").eqNullSafe(F.col("_cp")))
    return ranked.select(value, F.floor((F.col("_before") + F.col("_row") - 1) / size).alias("batch"))


def draw(seed: int, n: Column, *columns: str) -> Column:
    """A reproducible number from 0 to n - 1."""
    return F.conv(F.substring(shuffled(seed, *columns), 1, 8), 16, 10).cast("long") % n


def numbered(labels: DataFrame, seed: int = 42) -> DataFrame:
    """(item_id, cluster_id, at, size): members in shuffled order from 0, by sixteenths of a cluster, so that a large one is not one task."""
    m = labels.select("item_id", "cluster_id", shuffled(seed, "item_id").alias("o")).withColumn("part", F.substring("o", 1, 1))
    counts = m.groupBy("cluster_id", "part").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("cluster_id")  # at most 16 rows
    counts = counts.select("cluster_id", "part", (F.sum("n").over(whole.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(whole).alias("size"))
    row = F.row_number().over(Window.partitionBy("cluster_id", "part").orderBy("o", "item_id"))
    return m.withColumn("row", row).join(counts, ["cluster_id", "part"]).select("item_id", "cluster_id", (F.col("before") + F.col("row") - 1).alias("at"), "size")


def triplets(labels: DataFrame, anchors: DataFrame, seed: int = 42) -> DataFrame:
    """(anchor, positive, negative): the next member of the anchor's cluster in shuffled order, and a member drawn from a cluster drawn for each anchor."""
    m = cut(numbered(labels, seed), "numbered")
    clusters = m.where("at = 0").select("cluster_id", "size", (F.row_number().over(Window.orderBy("cluster_id")) - 1).alias("place"))  # one row a cluster
    k = clusters.count()
    own = m.where("size > 1").join(anchors.select("item_id"), "item_id", "left_semi").join(clusters.select("cluster_id", "place"), "cluster_id")
    own = own.withColumn("next", (F.col("at") + 1) % F.col("size")).withColumn("other", (F.col("place") + 1 + draw(seed + 1, F.lit(max(1, k - 1)), "item_id")) % max(1, k)).where(F.col("other") != F.col("place"))
    to = clusters.select(F.col("place").alias("other"), F.col("cluster_id").alias("to"), F.col("size").alias("to_size"))
    own = own.join(to, "other").withColumn("spot", draw(seed + 2, F.col("to_size"), "item_id")).select(F.col("item_id").alias("anchor"), "cluster_id", "next", "to", "spot")
    positive = m.select("cluster_id", F.col("at").alias("next"), F.col("item_id").alias("positive"))
    negative = m.select(F.col("cluster_id").alias("to"), F.col("at").alias("spot"), F.col("item_id").alias("negative"))
    return own.join(positive, ["cluster_id", "next"]).join(negative, ["to", "spot"]).select("anchor", "positive", "negative")


def annotation(sample: DataFrame, prompts: DataFrame, truth: DataFrame) -> DataFrame:
    """(item_id, prompt, label): the sampled ids that have both a prompt and a label."""
    return sample.select("item_id").join(prompts.select("item_id", "prompt"), "item_id").join(truth.select("item_id", "label"), "item_id")


def tagged(samples: dict[str, DataFrame], column: str = "dataset") -> DataFrame:
    """The samples one below the other, each row with its dataset's name; a column that one lacks is null there."""
    out = None
    for name, df in samples.items():
        now = df.withColumn(column, F.lit(name))
        out = now if out is None else out.unionByName(now, allowMissingColumns=True)
    return out


def uncertain(entropy: DataFrame, pct: float = 0.6) -> DataFrame:
    """Items whose neighbour entropy reaches the ``pct`` percentile."""
    cut = entropy.agg(F.percentile("entropy", pct).alias("cut"))
    return entropy.join(cut).where("entropy >= cut").select("item_id", "entropy")
