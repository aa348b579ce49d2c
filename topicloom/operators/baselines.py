"""Standard clustering baselines on MLlib, and a density clustering on the kNN graph."""

from __future__ import annotations

from pyspark.ml.clustering import LDA, KMeans, PowerIterationClustering
from pyspark.ml.feature import PCA, CountVectorizer, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

SEED = 42


def _ml(dense: DataFrame) -> DataFrame:
    return dense.select("item_id", array_to_vector(F.col("v")).alias("features"))


def kmeans(dense: DataFrame, k: int, cosine: bool = False) -> DataFrame:
    """(item_id, cluster_id) of (item_id, v array); spherical with ``cosine``."""
    rows = _ml(dense)
    model = KMeans(k=k, seed=SEED, distanceMeasure="cosine" if cosine else "euclidean").fit(rows)
    return model.transform(rows).select("item_id", F.col("prediction").cast("long").alias("cluster_id"))


#: Numbers that the centres of a refit may hold (32 MB): they go to every task.
MOST_NUMBERS = 4_000_000


def spherical_refit(dense: DataFrame, labels: DataFrame, rounds: int = 3) -> DataFrame:
    """(item_id, cluster_id) after ``rounds`` of unit mean directions and the nearest of them (ties: the least id). Rows that are zero or unlabelled go to a centre too."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    unit = cut(dense.withColumn("n", norm).select("item_id", F.transform("v", lambda x: x / F.when(F.col("n") > 0, F.col("n")).otherwise(1.0)).alias("v")), "unit")
    now = labels.select("item_id", F.col("cluster_id").cast("long").alias("cluster_id"))
    for _ in range(rounds):
        mean = unit.join(now, "item_id").select("cluster_id", F.posexplode("v").alias("d", "x")).groupBy("cluster_id", "d").agg(F.avg("x").alias("x"))
        long = cut(mean.withColumn("x", F.col("x") / F.nullif(F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("cluster_id"))), F.lit(0.0))), "centres")
        if (n := long.count()) > MOST_NUMBERS:
            raise ValueError(f"centres of {n} numbers: too many for every task, take fewer clusters")
        each = long.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("c")).select("cluster_id", F.transform("c", lambda e: F.coalesce(e["x"], F.lit(0.0))).alias("c"))
        centres = each.agg(F.collect_list(F.struct("cluster_id", "c")).alias("centres"))  # at most MOST_NUMBERS
        dot = lambda c: F.aggregate(F.zip_with("v", c, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
        best = F.array_max(F.transform("centres", lambda e: F.struct(F.round(dot(e["c"]), 9).alias("sim"), (-e["cluster_id"]).alias("to"))))
        now = cut(unit.join(F.broadcast(centres)).select("item_id", (-best["to"]).alias("cluster_id")), "labels")
    return now


def reduce_pca(dense: DataFrame, d: int = 50) -> DataFrame:
    """(item_id, v) in ``d`` principal components; stands in for truncated SVD and UMAP."""
    rows = _ml(dense)
    return PCA(k=d, inputCol="features", outputCol="out").fit(rows).transform(rows).select("item_id", vector_to_array("out").alias("v"))


def lda(items: DataFrame, k: int, *, iterations: int = 10, min_df: int = 3) -> DataFrame:
    words = items.select("item_id", F.regexp_extract_all(F.lower("prompt"), F.lit("[a-z]{2,}"), F.lit(0)).alias("words"))
    counted = CountVectorizer(inputCol="words", outputCol="features", vocabSize=20_000, minDF=min_df).fit(words).transform(words)
    topics = LDA(k=k, seed=SEED, optimizer="online", maxIter=iterations).fit(counted).transform(counted)
    return topics.select("item_id", _argmax(vector_to_array("topicDistribution")).alias("cluster_id"))


def _argmax(v):
    return (F.array_position(v, F.array_max(v)) - 1).cast("long")


def nmf(tfidf: DataFrame, k: int, items: DataFrame | None = None, *, iterations: int = 10) -> DataFrame:
    """Non-negative factors of (item_id, dim, v) by alternating least squares; the strongest is the cluster. Those of ``items`` that have no values, all factors 0, get the first."""
    rows = StringIndexer(inputCol="dim", outputCol="d").fit(tfidf).transform(tfidf).select(F.col("item_id"), F.col("d").cast("int"), "v")
    ids = _small_ids(rows.select("item_id").distinct())
    m = ALS(rank=k, maxIter=iterations, nonnegative=True, userCol="i", itemCol="d", ratingCol="v", seed=SEED, regParam=0.01).fit(rows.join(ids, "item_id"))
    found = m.userFactors.join(ids, F.col("id") == F.col("i")).select("item_id", _argmax(F.col("features")).alias("cluster_id"))
    return found if items is None else items.select("item_id").join(found, "item_id", "left").fillna(0, ["cluster_id"])


def _small_ids(items: DataFrame, parts: int = 1024) -> DataFrame:
    """(item_id, i): numbers from 1 without gaps, as the factoriser takes 32-bit ids; counted by hash part, so no task orders all items."""
    part = items.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(parts)).cast("int"))
    n = part.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = n.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # at most ``parts`` rows
    row = F.row_number().over(Window.partitionBy("part").orderBy("item_id"))
    return part.withColumn("row", row).join(F.broadcast(before), "part").select("item_id", (F.col("before") + F.col("row")).cast("int").alias("i"))


def connectivity(near: DataFrame) -> DataFrame:
    """(src, dst, weight), src < dst, of neighbours (i, j): 1 where each is the other's neighbour, 0.5 where one is."""
    pair = near.where("i <> j").select("i", "j").distinct().groupBy(F.least("i", "j").alias("src"), F.greatest("i", "j").alias("dst"))
    return pair.agg((F.count(F.lit(1)) * 0.5).alias("weight"))


def spectral(nodes: DataFrame, edges: DataFrame, k: int, iterations: int = 20) -> DataFrame:
    """(item_id, cluster_id) by power iteration; a node without an edge gets an id of its own."""
    pic = PowerIterationClustering(k=k, maxIter=iterations, initMode="degree", weightCol="weight")
    found = pic.assignClusters(edges.select("src", "dst", "weight")).select(F.col("id").alias("item_id"), F.col("cluster").cast("long").alias("cluster_id"))
    return noise_to_singletons(nodes.select("item_id").join(found, "item_id", "left").fillna(-1, ["cluster_id"]))


def logistic(dense: DataFrame, labelled: DataFrame) -> DataFrame:
    """(item_id, label): a multinomial classifier fitted on (item_id, label), applied to all."""
    from pyspark.ml.classification import LogisticRegression

    rows = _ml(dense)
    names = StringIndexer(inputCol="label", outputCol="y").fit(labelled)
    model = LogisticRegression(labelCol="y", maxIter=50, regParam=0.01).fit(names.transform(rows.join(labelled, "item_id")))
    known = F.array(*map(F.lit, names.labels))
    return model.transform(rows).select("item_id", F.get(known, F.col("prediction").cast("int")).alias("label"))


def density(nodes: DataFrame, knn: DataFrame, min_samples: int = 5, min_size: int = 5, quantile: float = 0.3) -> DataFrame:
    """(item_id, cluster_id): mutual-reachability components; noise gets ids of its own.

    A point's core distance is 1 less its ``min_samples``-th similarity. Links
    whose larger of distance and both core distances is within the ``quantile``
    of all join; smaller groups than ``min_size`` are noise.
    """
    from .community import components

    core = knn.where(F.col("rank") == min_samples).select(F.col("i").alias("item_id"), (1 - F.col("sim")).alias("core"))
    reach = knn.join(core.select(F.col("item_id").alias("i"), F.col("core").alias("ci")), "i").join(core.select(F.col("item_id").alias("j"), F.col("core").alias("cj")), "j")
    reach = reach.select(F.least("i", "j").alias("src"), F.greatest("i", "j").alias("dst"), F.round(F.greatest(1 - F.col("sim"), "ci", "cj"), 9).alias("d")).distinct()
    within = reach.agg(F.percentile("d", quantile).alias("cut"))
    comp = components(nodes, reach.join(within).where("d <= cut").select("src", "dst", (1 - F.col("d")).alias("weight")))
    size = comp.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    return noise_to_singletons(comp.join(size, "cluster_id").select("item_id", F.when(F.col("n") >= min_size, F.col("cluster_id")).otherwise(-1).alias("cluster_id")))


def noise_to_singletons(labels: DataFrame) -> DataFrame:
    """Noise (-1) gets labels that no cluster has."""
    return labels.select("item_id", F.when(F.col("cluster_id") == -1, -F.col("item_id") - 2).otherwise(F.col("cluster_id")).alias("cluster_id"))


def class_terms(items: DataFrame, labels: DataFrame, top: int = 10) -> DataFrame:
    """(cluster_id, term, score, rank): class-based tf-idf, with the mean words of a class as its numerator."""
    from .vectors import ngrams

    tf = ngrams(items, longest=1).join(labels, "item_id").groupBy("cluster_id", "term").agg(F.sum("tf").alias("tf"))
    every = tf.groupBy("term").agg(F.sum("tf").alias("f"))
    mean = tf.groupBy("cluster_id").agg(F.sum("tf").alias("n")).agg(F.avg("n").alias("a"))
    size = tf.groupBy("cluster_id").agg(F.sum("tf").alias("n"))
    s = tf.join(every, "term").join(size, "cluster_id").join(mean).withColumn("score", F.round(F.col("tf") / F.col("n") * F.log(1 + F.col("a") / F.col("f")), 6))
    best = Window.partitionBy("cluster_id").orderBy(F.desc("score"), "term")
    return s.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("cluster_id", "term", "score", "rank")


def topic_pairs(items: DataFrame, labels: DataFrame, similarity: float, top: int = 20) -> DataFrame:
    """(i, j, sim), i < j: clusters whose ``top`` class terms have a cosine of ``similarity`` > 0 or more."""
    from .knn import similar_pairs
    from .vectors import l2

    terms = l2(class_terms(items, labels, top).select(F.col("cluster_id").alias("item_id"), F.col("term").alias("dim"), F.col("score").alias("v")))
    return similar_pairs(cut(terms, "terms"), similarity).select("i", "j", "sim")


def merge_topics(items: DataFrame, labels: DataFrame, similarity: float = 0.6, top: int = 20) -> DataFrame:
    """(item_id, cluster_id): clusters of two members or more whose class terms are alike become one, by the least id; others stay."""
    from .community import components

    labels = cut(labels.select("item_id", "cluster_id"), "labels")
    real = labels.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cluster_id")
    pairs = topic_pairs(items, labels.join(real, "cluster_id", "left_semi"), similarity, top)
    to = components(real.select(F.col("cluster_id").alias("item_id")), pairs.select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("sim").alias("weight")))
    to = to.select(F.col("item_id").alias("cluster_id"), F.col("cluster_id").alias("to"))
    return labels.join(to, "cluster_id", "left").select("item_id", F.coalesce("to", "cluster_id").alias("cluster_id"))


def topic_model(items: DataFrame, dense: DataFrame, *, d: int = 16, neighbours: int = 10, similarity: float = 0.6) -> DataFrame:
    """(item_id, cluster_id): principal components, density clusters, class terms, and a merge of topics whose terms are alike."""
    from .knn import knn_dense

    low = reduce_pca(dense, d)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    low = cut(low.withColumn("n", norm).select("item_id", F.transform("v", lambda x: x / F.when(F.col("n") > 0, F.col("n")).otherwise(1.0)).alias("v")), "reduced")
    return merge_topics(items, density(low, cut(knn_dense(low, neighbours), "knn")), similarity)
