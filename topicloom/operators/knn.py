"""Cosine nearest neighbours and the similarity graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import products


def _top(pairs: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("i").orderBy(F.desc("sim"), "j")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("i", "j", "sim", "rank")


def knn_sparse(vectors: DataFrame, k: int = 30, sigma: float | None = None) -> DataFrame:
    """(i, j, sim, rank) of unit long-form vectors; only items that share a dimension meet. With ``sigma``, neighbours of at least that similarity."""
    least = sigma if sigma is not None and sigma > 0 else None

    def pick(ia, ib, dots, counts, same):
        from topicloom.operators.products import best

        return best(ia, ib, dots, (dots > 0 if counts is None else counts > 0) & (ia[:, None] != ib), k)

    def both(ia, ib, dots, counts, same):  # few reach sigma: each pair of blocks is multiplied once, for the rows of both
        import numpy as np

        r, c = np.nonzero(dots >= least)
        i, j, sim = ia[r], ib[c], dots[r, c]
        i, j, sim = (x[i != j] for x in (i, j, sim))
        return (i, j, sim) if same else (np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([sim, sim]))

    def less(i, j, sim):
        from topicloom.operators.products import largest

        at = largest(i, j, sim, k)
        return i[at], j[at], sim[at]

    dims = products.numbered(vectors)
    p = products.packed(vectors, dims)
    products.forget(dims)
    n = products.sparse_blocks(p)
    kinds = "i long, j long, sim double"
    keep = lambda pairs: _top(pairs, k)
    return products.sparse_products(p, p, n, n, pick, kinds, keep=keep) if least is None else products.sparse_products(p, p, n, n, both, kinds, halves=True, less=less, keep=keep)


def similar_pairs(vectors: DataFrame, sigma: float, shared: int = 1) -> DataFrame:
    """(i, j, sim, shared), i < j: all pairs of long-form vectors (item_id, dim, v) with a product of at least ``sigma`` > 0 and ``shared`` dimensions in common.

    Pairs are found, summed up and dropped within tasks: only those asked for are ever written.
    """

    def pick(ia, ib, dots, counts, same):
        import numpy as np

        ok = (dots >= sigma) & (counts >= shared)
        r, c = np.nonzero(ok & (ia[:, None] < ib) if same else ok)
        return np.minimum(ia[r], ib[c]), np.maximum(ia[r], ib[c]), dots[r, c], counts[r, c]

    dims = products.numbered(vectors)
    p = products.packed(vectors, dims)
    products.forget(dims)
    n = products.sparse_blocks(p)
    return products.sparse_products(p, p, n, n, pick, "i long, j long, sim double, shared long", counted=True, halves=True)


def knn_dense(dense: DataFrame, k: int = 30, block_rows: int = products.BLOCK_ROWS) -> DataFrame:
    """(i, j, sim, rank) of (item_id, v) with unit vectors: every pair of blocks is one matrix product in one task, some rows at a time."""

    def task(a, b, x, y):
        import numpy as np
        import pyarrow.compute as pc

        from topicloom.operators.products import CELLS, _table

        got = []
        if len(a) and len(b):
            m = lambda t: np.asarray(pc.list_flatten(t["v"])).astype(float).reshape(len(t), -1)
            ia, ib, u, v = np.asarray(a["item_id"]), np.asarray(b["item_id"]), m(a), m(b).T
            some = max(1, CELLS // len(ib))
            for at in range(0, len(ia), some):
                s, own = u[at : at + some] @ v, ia[at : at + some]
                s[(own[:, None] == ib) | np.isnan(s)] = -np.inf
                few = min(k, len(ib))
                ok = s >= np.partition(s, len(ib) - few, axis=1)[:, len(ib) - few, None]
                r, c = np.nonzero(ok & (s > -np.inf))
                got.append((own[r], ib[c], s[r, c]))
        return _table(got, "i long, j long, sim double", np)

    products.ship_code(dense.sparkSession)
    n = products.n_blocks(dense.count(), block_rows)
    return _top(products.paired(dense.select("item_id", "v"), dense.select("item_id", "v"), n, n, task, "i long, j long, sim double"), k)


def edges(knn: DataFrame, sigma: float, mode: str = "sum") -> DataFrame:
    """(src, dst, weight), src < dst: neighbours at ``sigma`` or more; a mutual pair's two entries are summed (or the larger taken)."""
    agg = F.sum("sim") if mode == "sum" else F.max("sim")
    return knn.where(F.col("sim") >= sigma).groupBy(F.least("i", "j").alias("src"), F.greatest("i", "j").alias("dst")).agg(agg.alias("weight"))


def min_shared(e: DataFrame, weights: DataFrame, m: int) -> DataFrame:
    """Edges whose ends share at least ``m`` concepts."""
    a = weights.select(F.col("item_id").alias("src"), "concept")
    b = weights.select(F.col("item_id").alias("dst"), "concept")
    shared = e.join(a, "src").join(b, ["dst", "concept"]).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= m)
    return e.join(shared, ["src", "dst"])


def symmetric(e: DataFrame) -> DataFrame:
    return e.select("src", "dst", "weight").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def degrees(e: DataFrame) -> DataFrame:
    return symmetric(e).groupBy("src").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("strength")).withColumnRenamed("src", "item_id")


def isolated(nodes: DataFrame, e: DataFrame) -> DataFrame:
    return nodes.select("item_id").join(degrees(e), "item_id", "left_anti")
