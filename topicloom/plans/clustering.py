"""End-to-end clustering, sweeps, ensembles and their summaries."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cascade, community, evaluate, knn, propagate, vectors, weights
from ..session import cut, forget


def concept_vectors(items: DataFrame, n: int, *, pmi_k: int = 35, alpha: float = 0.8, max_df_pct: float = 0.08) -> DataFrame:
    own = cut(weights.concept_weights(items, n, max_df_pct=max_df_pct), "weights")
    w = cut(propagate.propagate(own, items), "propagated")
    forget(own)
    dense = cut(propagate.densify(w, n, top_k=pmi_k), "densified")
    c = vectors.concept_vectors(dense)
    v = cut(c if alpha >= 1 else vectors.hybrid(c, vectors.tfidf(items, n), alpha), "vectors")
    forget(w, dense)
    return v


def graph_clusters(nodes: DataFrame, v: DataFrame, k: DataFrame, sigma: float, gamma: float) -> DataFrame:
    """Edges, communities and the cascade."""
    e = cut(knn.edges(k, sigma), "edges")
    return cascade.cascade(v, community.leiden(nodes, e, gamma))


def concept_clusters(items: DataFrame, *, pmi_k: int = 35, alpha: float = 0.8, sigma: float = 0.6, gamma: float = 30.0, neighbours: int = 30, max_df_pct: float = 0.08) -> DataFrame:
    """(item_id, cluster_id) from items alone."""
    items = cut(items, "items")
    v, nodes = concept_vectors(items, items.count(), pmi_k=pmi_k, alpha=alpha, max_df_pct=max_df_pct), cut(items.select("item_id"), "nodes")
    forget(items)
    near = cut(knn.knn_sparse(v, neighbours, sigma), "knn")
    labels = graph_clusters(nodes, v, near, sigma, gamma)
    forget(v, near)
    return labels


def dense_clusters(dense: DataFrame, *, sigma: float, gamma: float, neighbours: int = 30) -> DataFrame:
    v = cut(vectors.long_form(dense), "vectors")
    return graph_clusters(dense.select("item_id"), v, cut(knn.knn_dense(dense, neighbours), "knn"), sigma, gamma)


def sweep(dense: DataFrame, truth: DataFrame, sigmas, gammas, neighbours: int = 30) -> tuple[DataFrame, DataFrame]:
    """(results, labels by run): vectors and neighbours are made once, edges once per sigma."""
    v, k = cut(vectors.long_form(dense), "vectors"), cut(knn.knn_dense(dense, neighbours), "knn")
    nodes, results, runs = dense.select("item_id"), None, None
    for sigma, gamma in product(sigmas, gammas):
        labels = cut(graph_clusters(nodes, v, k, sigma, gamma), "labels")
        run = f"s{sigma}-g{gamma}"
        row = evaluate.balanced(labels, truth).select(F.lit(run).alias("run"), F.lit(float(sigma)).alias("sigma"), F.lit(float(gamma)).alias("gamma"), "nmi", "coverage", "bal")
        results = row if results is None else results.unionByName(row)
        tagged = labels.withColumn("run", F.lit(run))
        runs = tagged if runs is None else runs.unionByName(tagged)
    return results, runs


def best_per_family(results: DataFrame) -> DataFrame:
    """(family, run, bal): the best run of each family; ties: the least name."""
    return results.groupBy("family").agg(F.min_by(F.struct("run", "bal"), F.struct(-F.col("bal"), F.col("run"))).alias("b")).select("family", "b.run", "b.bal")


def ablation_matrix(results: DataFrame, algorithms: list[str]) -> DataFrame:
    return results.groupBy("representation").pivot("algorithm", algorithms).agg(F.max("bal"))


def _stacked(rows: list[DataFrame]) -> DataFrame:
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def _scored(labels: DataFrame, truth: DataFrame, **axes) -> DataFrame:
    return evaluate.balanced(labels, truth).select(*[F.lit(v).alias(k) for k, v in axes.items()], "nmi", "coverage", "bal")


def concept_sweep(items: DataFrame, truth: DataFrame, pmi_ks, alphas, sigmas, gammas, neighbours: int = 30, max_df_pct: float = 0.08) -> DataFrame:
    """(pmi_k, alpha, sigma, gamma, nmi, coverage, bal): weights are made once, densified once per ``pmi_k``, neighbours once per ``alpha``, edges once per ``sigma``."""
    items = cut(items, "items")
    n, nodes, rows = items.count(), items.select("item_id"), []
    own = cut(weights.concept_weights(items, n, max_df_pct=max_df_pct), "weights")
    w = cut(propagate.propagate(own, items), "propagated")
    words = cut(vectors.tfidf(items, n), "tfidf") if any(a < 1 for a in alphas) else None
    nodes = cut(nodes, "nodes")
    forget(own, items)
    for k in pmi_ks:
        dense = cut(propagate.densify(w, n, top_k=k), "densified")
        c = cut(vectors.concept_vectors(dense), "vectors")
        forget(dense)
        for at, a in enumerate(alphas, 1):
            v = c if a >= 1 else cut(vectors.hybrid(c, words, a), "hybrid")
            if v is not c and at == len(alphas):
                forget(c)
            near = cut(knn.knn_sparse(v, neighbours, min(sigmas)), "knn")
            for s in sigmas:
                e = cut(knn.edges(near, s), "edges")
                for g in gammas:
                    labels = cascade.cascade(v, community.leiden(nodes, e, g))
                    rows.append(_scored(labels, truth, pmi_k=int(k), alpha=float(a), sigma=float(s), gamma=float(g)))
                forget(e)
            forget(near)
            if v is not c or at == len(alphas):
                forget(v)
    return _stacked(rows)


def graph_sweep(nodes: DataFrame, v: DataFrame, near: DataFrame, concepts: DataFrame, truth: DataFrame, ks, sigmas, shared, gamma: float = 1.0) -> DataFrame:
    """(k, sigma, min_shared, nmi, coverage, bal): ``near`` holds the largest k's neighbours (rank), ``concepts`` (item_id, concept) what ends of an edge must share."""
    rows = []
    for k in ks:
        for s in sigmas:
            e = cut(knn.edges(near.where(F.col("rank") <= k), s), "edges")
            for m in shared:
                kept = cut(knn.min_shared(e, concepts, m).select("src", "dst", "weight"), "edges") if m > 0 else e
                labels = cut(cascade.cascade(v, community.leiden(nodes, kept, gamma)), "labels")
                rows.append(_scored(labels, truth, k=int(k), sigma=float(s), min_shared=int(m)))
    return _stacked(rows)


def best_members(results: DataFrame, n: int | None) -> DataFrame:
    """(run): the ``n`` best runs by bal (all for None); ties: the least name."""
    return results.orderBy(F.desc("bal"), "run").select("run") if n is None else results.orderBy(F.desc("bal"), "run").limit(n).select("run")


def ensemble_sweep(nodes: DataFrame, near: DataFrame, runs: DataFrame, results: DataFrame, truth: DataFrame, sizes=(3, 5, 8, None), gammas=(1.0,)) -> DataFrame:
    """(members, gamma, nmi, coverage, bal): ensembles of the best runs; the co-association is made once per size."""
    rows = []
    for n in sizes:
        chosen = cut(runs.join(best_members(results, n), "run", "left_semi"), "members")
        e = cut(community.coassociation(near, chosen), "coassociation")
        for g in gammas:
            labels = cut(community.leiden(nodes, e, g), "labels")
            rows.append(_scored(labels, truth, members=int(n or 0), gamma=float(g)))
    return _stacked(rows)


def suite(methods: dict[str, dict], truth: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """(family, run, nmi, coverage, bal, error): each family's runs (name -> function without arguments that gives labels); a run that fails leaves its error, not the suite's."""
    spark, rows = truth.sparkSession, []
    for family, runs in methods.items():
        if family in skip:
            continue
        for name, make in runs.items():
            try:
                got = evaluate.balanced(cut(make(), "labels"), truth).first()
                rows.append((family, name, got["nmi"], got["coverage"], got["bal"], None))
            except Exception as e:  # one method's failure is a row of the report
                rows.append((family, name, None, None, None, f"{type(e).__name__}: {str(e)[:200]}"))
    return spark.createDataFrame(rows, "family string, run string, nmi double, coverage double, bal double, error string")


def bias_runs(methods: dict[str, tuple], x: DataFrame, y: DataFrame) -> DataFrame:
    """(method, type, x, y): bal of each method's labels (name -> (type, function without arguments)) under two ground truths; a method that fails has nulls."""
    made = {name: make for name, (_, make) in methods.items()}
    kept: dict[str, DataFrame] = {}

    def once(name):
        if name not in kept:
            kept[name] = cut(made[name](), "labels")
        return kept[name]

    runs = {"all": {name: (lambda name=name: once(name)) for name in made}}
    score = lambda truth, c: suite(runs, truth).select(F.col("run").alias("method"), F.col("bal").alias(c))
    types = x.sparkSession.createDataFrame([(name, kind) for name, (kind, _) in methods.items()], "method string, type string")
    return types.join(score(x, "x"), "method", "left").join(score(y, "y"), "method", "left")


def ablation(representations: dict[str, DataFrame], algorithms: dict, truth: DataFrame) -> DataFrame:
    """(representation, algorithm, nmi, coverage, bal): every algorithm (dense vectors -> labels) on every representation."""
    made = suite({r: {a: (lambda f=f, v=v: f(v)) for a, f in algorithms.items()} for r, v in representations.items()}, truth)
    return made.select(F.col("family").alias("representation"), F.col("run").alias("algorithm"), "nmi", "coverage", "bal", "error")
