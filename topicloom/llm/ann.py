"""Approximate nearest neighbours: an inverted file with product-quantised residuals and exact reranking.

Fit: k-means centroids, and one codebook per slice of the residuals brought to
length 1, so that tight groups are told apart as finely as loose ones, on the
first ``sample`` rows by hash; both are a few hundred kB and go to every task.
Index: every row gets its nearest centroid's list, its residual's length and codes.
Search: a query probes the lists of the largest inner product with their
centroids; a table of inner products per slice and code gives their rows'
approximate scores, and the best ``rerank`` rows of all probed lists together
are scored exactly on the original vectors.

The index is cut by hash into shards of ``BLOCK`` rows, each with its part of
every list, and queries into chunks; a task is a shard and a chunk, so a list
that holds a third of all rows is spread over all tasks. A shard reranks its
share of ``rerank`` and a margin of six standard deviations of that share.

Defined results: rows whose id or vector is null, or whose vector is zero or
holds a null or non-finite component, take no part; shorter vectors count as
padded with zeros; a query never finds its own id; where the probed lists hold
fewer than ``k`` other rows, a query goes on along its order of lists until
they hold ``k`` or all lists are read, so that fewer candidates than ``k`` are
all returned; no rows give no rows; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, session, ship_code
from .vectors import as_bytes, matrix, padded, usable, width

SAMPLE, SLICE, CODES = 16_384, 2, 256
PROBED, RERANK = 0.65, 120
BLOCK, CHUNK, SEED = 16_384, 1024, 41


def kmeans(x, k: int, rng, rounds: int = 12):
    """Lloyd's centroids of the rows of ``x``; an empty one restarts at a random row."""
    import numpy as np

    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), len(c))])
    return c


def nearest(x, c):
    import numpy as np

    half = (c * c).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[i : i + 4096] @ c.T - half, axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.empty(0, np.int64)


def unit(x):
    """Rows at length 1, and their lengths."""
    import numpy as np

    n = np.sqrt((x * x).sum(axis=1))
    return x / np.maximum(n, 1e-300)[:, None], n


def fit(rows: DataFrame, d: int, lists: int, *, sample: int = SAMPLE, seed: int = SEED):
    """(centroids, codebooks) from at most ``sample`` rows of (id, v)."""
    import numpy as np

    taken = rows.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample).toPandas()
    # a vector that many rows share takes one centroid
    x, rng = np.unique(np.array(taken["v"].tolist(), float).reshape(len(taken), d), axis=0), np.random.default_rng(seed)
    c = kmeans(x, lists, rng)
    rest, _ = unit(x - c[nearest(x, c)])
    return c, [kmeans(rest[:, i : i + SLICE], CODES, rng, 8) for i in range(0, d, SLICE)]


def search(df: DataFrame, is_query, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, probed: float = PROBED, rerank: int = RERANK, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """(query_id, rank, id, score): for rows where ``is_query`` (a condition on ``id``) holds, the ``k`` largest inner products found."""
    import numpy as np

    spark = session(df)
    ship_code(spark)
    rows = usable(df, id_col, vec_col, nonzero=True)
    d = width(rows)
    empty = spark.range(0).select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias(id_col), F.lit(0.0).alias("score"))
    if not d:
        return empty
    rows = rows.select("id", padded(F.col("v"), d).alias("v"))
    total = rows.count()
    lists = int(min(1024, max(1, math.sqrt(total))))
    centroids, books = fit(rows, d, lists, sample=sample, seed=seed)
    probe = max(1, min(len(centroids), math.ceil(probed * len(centroids))))
    model = spark.sparkContext.broadcast((centroids, books))  # at most 1024 x d and d x 256 numbers

    def index(batches):
        import pyarrow as pa

        c, b = model.value
        for batch in batches:
            x = matrix(batch.column(1), d)
            at = nearest(x, c)
            rest, far = unit(x - c[at])
            codes = np.stack([nearest(rest[:, m * SLICE : (m + 1) * SLICE], book).astype(np.uint8) for m, book in enumerate(b)], axis=1) if len(x) else np.empty((0, len(b)), np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.int32()), pa.array(far), pa.array(as_bytes(codes), pa.binary()), pa.array(as_bytes(x), pa.binary())], names=["id", "list", "far", "codes", "v"])

    indexed = materialise(rows.mapInArrow(index, "id long, list int, far double, codes binary, v binary"), "ivf-rows")
    held = np.zeros(len(centroids), np.int64)
    for r in indexed.groupBy("list").count().collect():  # at most 1024 numbers
        held[r["list"]] = r["count"]
    # rows of a query's own id are no candidates of it
    asking = indexed.where(is_query(F.col("id"))).groupBy("id", "list").agg(F.count(F.lit(1)).alias("n"))
    asking = asking.groupBy("id").agg(F.collect_list(F.struct("list", "n")).alias("own"))

    def probes(batches):
        import pyarrow as pa

        c, _ = model.value
        for batch in batches:
            x = matrix(batch.column(1), d)
            order = np.argsort(-(x @ c.T), axis=1, kind="stable").astype(np.int32)
            others = np.tile(held, (len(x), 1))
            for i, own in enumerate(batch.column(2).to_pylist()):
                for o in own:
                    others[i, o["list"]] -= o["n"]
            upto = np.cumsum(np.take_along_axis(others, order, axis=1), axis=1)
            n = np.clip((upto < k).sum(axis=1) + 1, probe, len(c))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int32())], names=["query", "q", "lists"])

    asked = indexed.where(is_query(F.col("id"))).select("id", "v").join(asking, "id").mapInArrow(probes, "query long, q binary, lists int")
    asked = materialise(asked, "ivf-probes")
    shards, chunks = math.ceil(total / BLOCK), max(1, math.ceil(asked.count() / CHUNK))
    # a shard is a random part of the rows: its share of the reranked ones, and a margin
    take = max(k + 1, math.ceil(rerank / shards + 6 * math.sqrt(rerank / shards))) if shards > 1 else max(k + 1, rerank)
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = indexed.select(dealt("id", shards).alias("shard"), every(chunks).alias("chunk"), "list", "id", "far", "codes", "v")
    right = asked.select(every(shards).alias("shard"), dealt("query", chunks).alias("chunk"), "query", "q", "lists")

    def rank(a, b):
        import pyarrow as pa

        out_q, out_i, out_s = [], [], []
        if len(a) and len(b):
            c, books_ = model.value
            a = a.sort_by([("list", "ascending"), ("id", "ascending")])  # equal approximations then go to the smaller ids
            ids, at_list, codes = np.asarray(a["id"]), np.asarray(a["list"]), matrix(a["codes"], len(books_), "u1")
            v, q, names, probed_ = matrix(a["v"], d), matrix(b["q"], d), np.asarray(b["query"]), np.asarray(b["lists"])
            far, ends = np.asarray(a["far"]).astype("f4"), np.searchsorted(at_list, np.arange(len(c) + 1))
            for s in range(0, len(q), 128):
                part = q[s : s + 128]
                base = part @ c.T
                rank_ = np.argsort(np.argsort(-base, axis=1, kind="stable"), axis=1)
                approx = np.full((len(part), len(ids)), -np.inf, "f4")
                tables = [(part[:, m * SLICE : (m + 1) * SLICE] @ book.T).astype("f4") for m, book in enumerate(books_)]  # asymmetric: the query's slice is exact
                for j in np.flatnonzero(ends[1:] > ends[:-1]):
                    who, rows_ = np.flatnonzero(rank_[:, j] < probed_[s : s + 128]), slice(ends[j], ends[j + 1])
                    if len(who):
                        got = np.zeros((len(who), ends[j + 1] - ends[j]), "f4")
                        for m, of in enumerate(tables):
                            got += of[who][:, codes[rows_, m]]
                        approx[who, rows_] = got * far[rows_] + base[who, j, None].astype("f4")
                for j in range(len(part)):
                    own = approx[j]
                    own[ids == names[s + j]] = -np.inf
                    at = np.flatnonzero(own > -np.inf)
                    if take < len(at):
                        cut = np.partition(own, len(ids) - take)[len(ids) - take]
                        over = np.flatnonzero(own > cut)
                        at = np.concatenate([over, np.flatnonzero(own == cut)[: take - len(over)]])
                    exact = (v[at] * part[j]).sum(axis=1)
                    keep = np.lexsort((ids[at], -exact))[:k]
                    out_q.append(np.full(len(keep), names[s + j])), out_i.append(ids[at][keep]), out_s.append(exact[keep])
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.empty(0, t)
        return pa.table({"query_id": cat(out_q, "i8"), "id": cat(out_i, "i8"), "score": cat(out_s, "f8")})

    keys = ("shard", "chunk")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(rank, "query_id long, id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
