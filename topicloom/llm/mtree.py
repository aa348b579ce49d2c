"""Exact top-k inner products by best-first search over M-trees of paged metric nodes.

Vectors are scaled to integers, so scores are exact. With M the largest norm
and one component sqrt(M^2 - |x|^2) more per candidate (0 for a query), the
distance of a query to a candidate falls as their inner product rises; that is
the metric of the trees.

Rows go to the nearest of ``pivots`` routing vectors; each such group is cut
into trees of about ``tree_rows`` rows, so a vector that a third of all rows
share makes many trees. A tree is bulk-loaded into pages: a page holds its
entries' vectors, covering radii and distances to the page's own routing
vector (the parent distances). A search keeps pages in a queue by their least
possible distance. An entry is skipped without computing its distance when the
triangle inequality over its parent distance excludes it already.

Every query first searches the tree that holds it, which gives it a bound. The
trees' routing vectors and radii form a directory, in pages of ``DIRECTORY``
trees; blocks of queries are held against it first, and only where a tree's
nearest possible point is within a query's bound are its pages sent for.

Defined results: rows whose id or vector is null, or whose vector holds a null
or non-finite component, take no part; zero vectors do; shorter vectors count
as padded with zeros; ties go to the smaller id; fewer than k candidates are
all returned; no rows give no rows; other columns are not read; rows that repeat an id are candidates for others, never for
that id; components so large that a score may pass 2^62 raise an error.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cpu_partitions, materialise, session, ship_code
from .vectors import matrix, padded, usable, width

PIVOTS, TREE_ROWS, LEAF, FANOUT, CHUNK, DIRECTORY, SEED = 64, 4096, 256, 16, 256, 1024, 53


class Page:
    """A node: its routing vector, and its entries with radii, parent distances, and pages below or ids."""

    __slots__ = ("ids", "vectors", "extra", "radii", "parent", "below")

    def __init__(self, vectors, extra, parent, radii=None, below=None, ids=None):
        self.vectors, self.extra, self.parent, self.radii, self.below, self.ids = vectors, extra, parent, radii, below, ids


def _distances(v, extra, route, route_extra):
    """From the rows of ``v`` (with their extra component) to one routing vector."""
    import numpy as np

    return np.sqrt(((v - route) ** 2).sum(axis=1) + (extra - route_extra) ** 2)


def bulk_load(ids, v, extra, leaf: int = LEAF, fanout: int = FANOUT, seed: int = SEED):
    """(page, routing row, radius) of a tree over the rows."""
    import numpy as np

    rng = np.random.default_rng(seed)
    f = v.astype(float)

    def build(at):
        route = at[0]
        d = _distances(f[at], extra[at], f[route], extra[route])
        if len(at) <= leaf:
            order = np.argsort(d, kind="stable")
            return Page(v[at][order], extra[at][order], d[order], ids=ids[at][order]), route, float(d.max())
        heads = rng.choice(at, min(fanout, max(2, math.ceil(len(at) / leaf))), replace=False)
        far = np.stack([_distances(f[at], extra[at], f[h], extra[h]) for h in heads])
        near = far.argmin(axis=0)
        head = np.isin(at, heads)  # a head leads its own part, whichever it is nearest to
        parts = [np.concatenate([[h], at[(near == i) & ~head]]) for i, h in enumerate(heads)]
        if max(map(len, parts)) > 0.9 * len(at):  # equal vectors: cut evenly
            parts = np.array_split(at, math.ceil(len(at) / leaf))
        made = [build(p) for p in parts]
        routes = np.array([r for _, r, _ in made])
        return Page(v[routes], extra[routes], _distances(f[routes], extra[routes], f[route], extra[route]), radii=np.array([r for _, _, r in made]), below=[p for p, _, _ in made]), route, float(max(d.max(), 0.0))

    return build(np.arange(len(ids)))


class Best:
    """A query's k best so far; ``worst`` is the score to reach."""

    def __init__(self, k: int, worst=None):
        self.k, self.heap, self.floor = k, [], worst

    def offer(self, scores, ids):
        for s, i in zip(scores.tolist(), ids.tolist()):
            item = (s, -i)
            if len(self.heap) < self.k:
                heapq.heappush(self.heap, item)
            elif item > self.heap[0]:
                heapq.heapreplace(self.heap, item)

    def worst(self):
        own = self.heap[0][0] if len(self.heap) == self.k else None
        return own if self.floor is None else self.floor if own is None else max(own, self.floor)


def search_tree(root: Page, route, route_extra, radius: float, q, own: int, norm2: float, best: Best):
    """Best-first: ``q`` against one tree; scores equal to the bound are still looked at, as ids break ties."""
    import numpy as np

    q2 = float((q.astype(float) ** 2).sum())
    qf = q.astype(float)
    slack = 1e-6 * math.sqrt(q2 + norm2) + 1e-6

    def reach():  # the distance beyond which nothing can matter
        w = best.worst()
        return math.inf if w is None else math.sqrt(max(0.0, q2 + norm2 - 2.0 * w)) + slack

    first = math.sqrt(float(((qf - route) ** 2).sum()) + route_extra**2)
    queue, n = [(max(0.0, first - radius), 0, root, first)], 0
    while queue:
        least, _, page, to_route = heapq.heappop(queue)
        limit = reach()
        if least > limit:
            break
        # |d(q, parent) - d(entry, parent)| - radius bounds the entry's distance from below
        bound = np.abs(to_route - page.parent) - (page.radii if page.below else 0.0)
        at = np.flatnonzero(bound <= limit)
        if not len(at):
            continue
        if page.below:
            d = np.sqrt(((page.vectors[at] - qf) ** 2).sum(axis=1) + page.extra[at] ** 2)
            low = np.maximum(d - page.radii[at], 0.0)
            for j in np.flatnonzero(low <= limit):
                n += 1
                heapq.heappush(queue, (float(low[j]), n, page.below[at[j]], float(d[j])))
        else:
            ids = page.ids[at]
            s = page.vectors[at] @ q
            ok = ids != own
            if (w := best.worst()) is not None:
                ok &= s >= w
            s, ids = s[ok], ids[ok]
            if len(s) > best.k:
                top = np.lexsort((ids, -s))[: best.k]
                s, ids = s[top], ids[top]
            best.offer(s, ids)


def search(df: DataFrame, every: int, *, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256, k: int = 5, pivots: int = PIVOTS, tree_rows: int = TREE_ROWS, chunk: int = CHUNK, seed: int = SEED) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` largest inner products of floor(scale * x) for rows whose id is divisible by ``every``."""
    import numpy as np

    spark = session(df)
    ship_code(spark)
    rows = usable(df, id_col, vec_col)
    d = width(rows)
    if not d:
        return spark.range(0).select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias(id_col), F.lit(0).cast("long").alias("score"))
    scaled = F.transform(padded(F.col("v"), d), lambda x: F.floor(x * scale))
    rows = materialise(rows.select("id", scaled.alias("v")), "mtree-rows")
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    norm2 = rows.agg(F.max(norm)).first()[0]
    if norm2 >= 2.0**62:
        raise ValueError("components too large for exact 64-bit scores")
    heads = rows.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(pivots).toPandas()["v"]
    routing = spark.sparkContext.broadcast(np.array(heads.tolist(), float).reshape(len(heads), d))

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            x = matrix(batch.column(1), d, "i8").astype(float)
            r = routing.value
            near = np.argmin((r * r).sum(axis=1) - 2 * (x @ r.T), axis=1).astype(np.int32) if len(x) else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near)], names=["id", "v", "pivot"])

    placed = materialise(rows.mapInArrow(place, "id long, v array<long>, pivot int"), "mtree-placed")
    counts = {r["pivot"]: r["n"] for r in placed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``pivots`` rows
    parts, first, total = [], [], 0
    for p in range(len(heads)):
        n = math.ceil(counts.get(p, 0) / tree_rows)
        parts.append(max(1, n)), first.append(total)
        total += n
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("pivot") + 1)
    placed = placed.select("id", "v", (of(first) + F.pmod(F.xxhash64("id", "v"), of(parts))).cast("int").alias("tree"))

    def load(table):
        ids = np.asarray(table["id"])
        v = matrix(table["v"], d, "i8")
        extra = np.sqrt(np.maximum(0.0, norm2 - (v.astype(float) ** 2).sum(axis=1)))
        root, route, radius = bulk_load(ids, v, extra)
        return ids, v, root, v[route].astype(float), float(extra[route]), radius

    def grow(table):
        """A tree's pages, and its own queries with their bounds and finds."""
        import pickle

        import pyarrow as pa

        ids, v, root, route, route_extra, radius = load(table)
        tree = table["tree"][0].as_py()
        at = np.flatnonzero(ids % every == 0)
        out = [(tree, None, None, None, None, pickle.dumps((root, route, route_extra, radius)), np.array([*route, route_extra, radius]).tobytes())]
        for i in at:
            best = Best(k)
            search_tree(root, route, route_extra, radius, v[i], int(ids[i]), norm2, best)
            found = sorted(best.heap, reverse=True)
            bound = found[-1][0] if len(found) == k else None
            out.append((tree, int(ids[i]), v[i].tobytes(), bound, [{"id": -b, "score": a} for a, b in found], None, None))
        kinds = (("tree", pa.int32()), ("query", pa.int64()), ("q", pa.binary()), ("bound", pa.int64()), ("found", pa.list_(pa.struct([("id", pa.int64()), ("score", pa.int64())]))), ("pages", pa.binary()), ("place", pa.binary()))
        return pa.table({name: pa.array([r[j] for r in out], kind) for j, (name, kind) in enumerate(kinds)})

    grown = placed.groupBy("tree").applyInArrow(grow, "tree int, query long, q binary, bound long, found array<struct<id: long, score: long>>, pages binary, place binary")
    grown = materialise(grown, "mtree-trees")
    asked = grown.where("query is not null")
    trees = grown.where("pages is not null").select("tree", "pages")
    # blocks of queries against the directory: which trees may hold something
    n = max(1, math.ceil(asked.count() / chunk))
    pages = max(1, math.ceil(total / DIRECTORY))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select(F.pmod(F.xxhash64("query"), F.lit(n)).cast("int").alias("block"), every(pages).alias("page"), "query", "q", "bound", F.col("tree").alias("home"))
    right = grown.where("pages is not null").select(every(n).alias("block"), F.floor(F.col("tree") / DIRECTORY).cast("int").alias("page"), "tree", "place").toDF("block", "page", "tree", "place")

    def choose(a, b):
        import pyarrow as pa

        out = []
        if len(a) and len(b):
            q, place = matrix(a["q"], d, "i8").astype(float), matrix(b["place"], d + 2)
            names, home, trees_ = a["query"].to_pylist(), np.asarray(a["home"]), np.asarray(b["tree"])
            raw, bounds = a["q"].to_pylist(), a["bound"].to_pylist()
            q2 = (q * q).sum(axis=1)
            far = np.sqrt(np.maximum(q2[:, None] + (place[:, : d + 1] ** 2).sum(axis=1) - 2 * q @ place[:, :d].T, 0.0))
            worst = np.array([-np.inf if x is None else x for x in bounds], float)
            # what search_tree's own slack allows, and as much again for the distances' rounding
            reach = np.sqrt(np.maximum(0.0, q2 + norm2 - 2.0 * worst)) + 2e-6 * np.sqrt(q2 + norm2) + 2e-6
            may = (far - place[:, d + 1] <= reach[:, None]) & (home[:, None] != trees_)
            for j in np.flatnonzero(may.any(axis=0)):
                out.append((int(trees_[j]), [{"query": names[i], "q": raw[i], "bound": bounds[i]} for i in np.flatnonzero(may[:, j])]))
        kind = pa.list_(pa.struct([("query", pa.int64()), ("q", pa.binary()), ("bound", pa.int64())]))
        return pa.table({"tree": pa.array([x for x, _ in out], pa.int32()), "queries": pa.array([x for _, x in out], kind)})

    keys = ("block", "page")
    blocks = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(choose, "tree int, queries array<struct<query: long, q: binary, bound: long>>")

    def visit(batches):
        import pickle

        import pyarrow as pa

        for batch in batches:
            out = []
            for pages, queries in zip(batch.column(1), batch.column(2).to_pylist()):
                root, route, route_extra, radius = pickle.loads(pages.as_buffer())
                for x in queries:
                    best = Best(k, x["bound"])
                    search_tree(root, route, route_extra, radius, np.frombuffer(x["q"], np.int64), x["query"], norm2, best)
                    out += [(x["query"], -b, a) for a, b in best.heap]
            c = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in c], names=["query_id", "id", "score"])

    blocks = blocks.repartition(cpu_partitions(spark), "tree")  # few bytes, much work: no coalescing to a few tasks
    seen = blocks.join(trees, "tree").select("tree", "pages", "queries").mapInArrow(visit, "query_id long, id long, score long")
    home = asked.select(F.col("query").alias("query_id"), F.explode("found").alias("f")).select("query_id", "f.id", "f.score")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = seen.unionByName(home).withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
