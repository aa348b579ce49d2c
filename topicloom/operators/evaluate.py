"""Cluster metrics and agreement statistics."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

D = "double"


def cluster_metrics(labels: DataFrame) -> DataFrame:
    """One row: items, clusters, clusters of two or more, singletons, coverage, share of the largest, effective number."""
    size = labels.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    total = size.agg(F.sum("size").alias("n"))
    p = F.col("size") / F.col("n")
    return size.join(total).agg(
        F.max("n").alias("n"), F.count(F.lit(1)).alias("k"), F.count_if(F.col("size") > 1).alias("n_real"), F.count_if(F.col("size") == 1).alias("singletons"),
        F.round(1 - F.count_if(F.col("size") == 1) / F.max("n"), 6).alias("coverage"), F.round(F.max(p), 6).alias("largest_pct"), F.round(F.exp(-F.sum(p * F.log(p + 1e-12))), 4).alias("effective_k"),
    )


def contingency(labels: DataFrame, truth: DataFrame) -> DataFrame:
    return labels.join(truth, "item_id").groupBy("cluster_id", "label").agg(F.count(F.lit(1)).cast(D).alias("n"))


def nmi_ari(labels: DataFrame, truth: DataFrame, least: int = 10) -> DataFrame:
    """One row (matched, nmi, ari): mutual information over the mean entropy, and the adjusted Rand index; null under ``least`` matched rows."""
    t = contingency(labels, truth)
    a = t.groupBy("cluster_id").agg(F.sum("n").alias("na"))
    b = t.groupBy("label").agg(F.sum("n").alias("nb"))
    total = t.agg(F.sum("n").alias("all_n"))
    h = lambda d, c: d.join(total).agg((-F.sum(F.col(c) / F.col("all_n") * F.log(F.col(c) / F.col("all_n")))).alias("h"), F.sum(F.col(c) * (F.col(c) - 1) / 2).alias("pairs"))
    mi = t.join(a, "cluster_id").join(b, "label").join(total).agg(F.sum(F.col("n") / F.col("all_n") * F.log(F.col("all_n") * F.col("n") / (F.col("na") * F.col("nb")))).alias("mi"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("both"), F.max("all_n").alias("all_n"))
    r = mi.join(h(a, "na").select(F.col("h").alias("ha"), F.col("pairs").alias("pa"))).join(h(b, "nb").select(F.col("h").alias("hb"), F.col("pairs").alias("pb")))
    mean = (F.col("ha") + F.col("hb")) / 2
    nmi = F.when(mean > 0, F.col("mi") / mean).otherwise(1.0)
    expected = F.col("pa") * F.col("pb") / (F.col("all_n") * (F.col("all_n") - 1) / 2)
    top = (F.col("pa") + F.col("pb")) / 2
    ari = F.when(top != expected, (F.col("both") - expected) / (top - expected)).otherwise(1.0)
    enough = F.col("all_n") >= least
    return r.select(F.col("all_n").cast("long").alias("matched"), F.when(enough, F.round(nmi, 4)).alias("nmi"), F.when(enough, F.round(ari, 4)).alias("ari"))


def balanced(labels: DataFrame, truth: DataFrame) -> DataFrame:
    """One row (nmi, coverage, bal): bal is their product, a missing nmi counting as 0."""
    r = nmi_ari(labels, truth).join(cluster_metrics(labels).select("coverage"))
    return r.select("nmi", "coverage", F.round(F.coalesce("nmi", F.lit(0.0)) * F.col("coverage"), 4).alias("bal"))


def purity(labels: DataFrame, truth: DataFrame) -> DataFrame:
    """(cluster_id, size, dominant, purity) over labelled members; ties: the least label."""
    t = contingency(labels, truth)
    return t.groupBy("cluster_id").agg(F.sum("n").cast("long").alias("size"), F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("dominant"), F.round(F.max("n") / F.sum("n"), 6).alias("purity"))


def confusion(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    return pairs.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def kappa(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row (n, accuracy, kappa, band): 1 if agreement by chance is certain, 0 without rows."""
    t = pairs.groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count(F.lit(1)).cast(D).alias("n"))
    rows = t.groupBy(F.col("a").alias("k")).agg(F.sum("n").alias("ra"))
    cols = t.groupBy(F.col("b").alias("k")).agg(F.sum("n").alias("rb"))
    chance = rows.join(cols, "k").agg(F.coalesce(F.sum(F.col("ra") * F.col("rb")), F.lit(0.0)).alias("e"))
    o = t.agg(F.coalesce(F.sum("n"), F.lit(0.0)).alias("all_n"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))), F.lit(0.0)).alias("o")).join(chance)
    po, pe = F.col("o") / F.col("all_n"), F.col("e") / (F.col("all_n") * F.col("all_n"))
    k = F.when(F.col("all_n") == 0, 0.0).when(pe >= 1, 1.0).otherwise((po - pe) / (1 - pe))
    band = F.when(k >= 0.81, "almost perfect").when(k >= 0.61, "substantial").when(k >= 0.41, "moderate").when(k >= 0.21, "fair").otherwise("slight")
    return o.select(F.col("all_n").cast("long").alias("n"), F.round(F.when(F.col("all_n") > 0, po).otherwise(0.0), 6).alias("accuracy"), F.round(k, 6).alias("kappa"), band.alias("band"))


#: Rows of the confusion table drawn at a time.
DRAWN = 65_536
#: Below these uniforms a Poisson variable of mean 1 is at most 0, 1, 2, ... (cumulative probabilities)
POISSON = tuple(sum(math.exp(-1) / math.factorial(j) for j in range(i + 1)) for i in range(10))


def kappa_bootstrap(pairs: DataFrame, b: int = 1000, seed: int = 42) -> DataFrame:
    """One row (lo, hi): the 95 % interval of kappa over ``b`` Poisson resamples; (0, 1) under 10 rows.

    Each row counts a hashed Poisson(1) number of times in a resample. Rows of a
    cell are alike, so they are numbered in the confusion table, and counts add
    up before the shuffle: what moves is runs x classes x classes.
    """
    from .sampling import shuffled

    cells = pairs.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b")).dropna().groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    each = cells.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(DRAWN).cast("long"))).alias("at"))
    each = each.select("a", "b", "n", "at", F.explode(F.sequence(F.lit(0), F.lit(b - 1))).alias("run"))
    each = each.repartition("run", "a", "b", "at").select("run", "a", "b", F.explode(F.sequence("at", F.least(F.col("at") + DRAWN, "n") - 1)).alias("row"))
    u = F.conv(F.substring(shuffled(seed, "run", "a", "b", "row"), 1, 8), 16, 10).cast("double") / 2.0**32
    times = sum((F.when(u >= p, 1).otherwise(0) for p in POISSON[1:]), F.when(u >= POISSON[0], 1).otherwise(0))
    t = each.groupBy("run", "a", "b").agg(F.sum(times).cast(D).alias("w"))
    ra, rb = t.groupBy("run", F.col("a").alias("k")).agg(F.sum("w").alias("ra")), t.groupBy("run", F.col("b").alias("k")).agg(F.sum("w").alias("rb"))
    e = ra.join(rb, ["run", "k"]).groupBy("run").agg(F.sum(F.col("ra") * F.col("rb")).alias("e"))
    o = t.groupBy("run").agg(F.sum("w").alias("w"), F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0)).alias("o")).where("w > 0")
    po, pe = F.col("o") / F.col("w"), F.coalesce("e", F.lit(0.0)) / (F.col("w") * F.col("w"))
    k = o.join(e, "run", "left").select(F.when(pe >= 1, 1.0).otherwise((po - pe) / (1 - pe)).alias("k"))
    ends = k.agg(F.percentile("k", 0.025).alias("lo"), F.percentile("k", 0.975).alias("hi"))
    few = cells.agg((F.coalesce(F.sum("n"), F.lit(0)) < 10).alias("few"))
    return few.join(ends).select(F.when(F.col("few"), 0.0).otherwise(F.round("lo", 6)).alias("lo"), F.when(F.col("few"), 1.0).otherwise(F.round("hi", 6)).alias("hi"))


def kendall_tau(scores: DataFrame) -> DataFrame:
    """One row (tau) of (method, x, y): pairs ordered alike less those that aren't; neither greater on both sides counts as alike."""
    a = scores.select(F.col("method").alias("m"), F.col("x").alias("xa"), F.col("y").alias("ya"))
    b = scores.select(F.col("method").alias("n"), F.col("x").alias("xb"), F.col("y").alias("yb"))
    alike = (F.col("xa") > F.col("xb")) == (F.col("ya") > F.col("yb"))
    return a.join(b, F.col("m") < F.col("n")).agg(F.round(F.avg(F.when(alike, 1.0).otherwise(-1.0)), 6).alias("tau"))  # methods: a handful


def bias(scores: DataFrame) -> DataFrame:
    """(type, mean_ratio) and the verdict: (method, type, x, y) with ratio x / y; a gap over 10 % is a bias."""
    r = scores.where("y <> 0").groupBy("type").agg(F.round(F.avg(F.col("x") / F.col("y")), 4).alias("mean_ratio"))
    gap = r.agg(F.round((F.max("mean_ratio") / F.min("mean_ratio") - 1) * 100, 1).alias("diff_pct"))
    return r.join(gap).select("type", "mean_ratio", "diff_pct", (F.abs("diff_pct") > 10).alias("biased"))


def neighbour_entropy(knn: DataFrame, labels: DataFrame) -> DataFrame:
    """(item_id, entropy): of the labels among the item itself and its neighbours."""
    near = knn.select(F.col("i").alias("q"), F.col("j").alias("item_id")).unionByName(labels.select(F.col("item_id").alias("q"), "item_id"))
    n = near.join(labels, "item_id").groupBy("q", "cluster_id").agg(F.count(F.lit(1)).cast(D).alias("n"))
    total = n.groupBy("q").agg(F.sum("n").alias("all_n"))
    p = F.col("n") / F.col("all_n")
    return n.join(total, "q").groupBy("q").agg(F.round(-F.sum(p * F.log(p + 1e-10)), 6).alias("entropy")).withColumnRenamed("q", "item_id")


def verdict_stats(v: DataFrame) -> DataFrame:
    """One row: verdict counts, acceptance, acceptance or borderline."""
    n = F.count("verdict")
    c = lambda x: F.count_if(F.col("verdict") == x)
    return v.agg(n.alias("n"), c("accept").alias("accepted"), c("borderline").alias("borderline"), c("reject").alias("rejected"), F.round(c("accept") / n, 6).alias("accept_rate"), F.round((c("accept") + c("borderline")) / n, 6).alias("acceptable_rate"))


def rejection_by_category(v: DataFrame) -> DataFrame:
    """(category, n, rejected, rate) of rated rows (category, verdict)."""
    rated = v.where(F.col("verdict").isin("accept", "borderline", "reject"))
    rejected = F.count_if(F.col("verdict") == "reject")
    return rated.groupBy("category").agg(F.count(F.lit(1)).alias("n"), rejected.alias("rejected"), F.round(rejected / F.count(F.lit(1)), 6).alias("rate"))


def corrections(v: DataFrame, top: int = 10) -> DataFrame:
    """(correction, n): what rejected rows (verdict, correction) should be instead, most frequent first."""
    n = v.where((F.col("verdict") == "reject") & F.col("correction").isNotNull()).groupBy("correction").agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.desc("n"), "correction").limit(top)


def disagreements(pairs: DataFrame, a: str = "a", b: str = "b", top: int = 20) -> DataFrame:
    """(a, b, n): the most frequent pairs of different labels."""
    return confusion(pairs.where(F.col(a) != F.col(b)), a, b).orderBy(F.desc("n"), a, b).limit(top)


def bias_deltas(scores: DataFrame) -> DataFrame:
    """(method, type, x, y, delta, ratio) of methods that have both scores."""
    s = scores.where("x is not null and y is not null")
    return s.select("method", "type", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), F.round(F.col("x") - F.col("y"), 4).alias("delta"), F.when(F.col("y") > 0, F.round(F.col("x") / F.col("y"), 4)).alias("ratio"))


def rank_vectors(scores: DataFrame) -> DataFrame:
    """(method, rank_x, rank_y): places by falling score; ties: the least name. Methods are a handful."""
    place = lambda c: F.row_number().over(Window.orderBy(F.desc(c), "method")).alias(f"rank_{c}")
    return scores.select("method", place("x"), place("y"))


def head_to_head(scores: DataFrame, method: str) -> DataFrame:
    """One row (method, rival, gap_x, gap_y, shrinkage_pct): against the best by ``x`` of the other types; the shrinkage is null unless both gaps are positive."""
    own = scores.where(F.col("method") == method).select(F.col("method"), F.col("type").alias("own"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    rival = scores.join(own.select("own")).where(F.col("type") != F.col("own")).agg(F.min_by(F.struct("method", "x", "y"), F.struct(-F.col("x"), F.col("method"))).alias("r"))
    gaps = own.join(rival).select("method", F.col("r.method").alias("rival"), (F.col("ox") - F.col("r.x")).alias("gx"), (F.col("oy") - F.col("r.y")).alias("gy"))
    shrink = F.when((F.col("gx") > 0) & (F.col("gy") > 0), F.round((1 - F.col("gy") / F.col("gx")) * 100, 4))
    return gaps.select("method", "rival", F.round("gx", 4).alias("gap_x"), F.round("gy", 4).alias("gap_y"), shrink.alias("shrinkage_pct"))
