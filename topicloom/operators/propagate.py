"""Concepts handed on within a conversation, and PMI densification."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, small
from . import products

#: Products of six-digit weights often end in a 5 at the seventh digit; this sends them all upwards.
HALF_UP = 1e-9
PAIRS = "a int, b int, n long, f long, g long"


def donors(weights: DataFrame, items: DataFrame, min_concepts: int = 3) -> DataFrame:
    """(conv_id, donor_id, n): the turn with most concepts of each conversation of two items or more, if it has enough."""
    n = items.select("item_id", "conv_id").join(weights.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")), "item_id", "left").fillna(0, ["n"])
    first = Window.partitionBy("conv_id").orderBy(F.desc("n"), "item_id")
    ranked = n.withColumn("_r", F.row_number().over(first)).withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy("conv_id")))
    return ranked.where("_r = 1 and _size >= 2 and conv_id is not null").where(F.col("n") >= min_concepts).select("conv_id", F.col("item_id").alias("donor_id"), "n")


def renormalised(rows: DataFrame, k: int) -> DataFrame:
    """The k heaviest concepts of each item, brought to sum 1."""
    best = Window.partitionBy("item_id").orderBy(F.desc("weight"), "concept")
    kept = rows.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k)
    return kept.select("item_id", "concept", F.round(F.col("weight") / F.sum("weight").over(Window.partitionBy("item_id")), 6).alias("weight"))


def propagate(weights: DataFrame, items: DataFrame, *, inherit: float = 0.5, min_concepts: int = 3, max_concepts: int = 30) -> DataFrame:
    """(item_id, concept, weight): items with few concepts inherit the donor's at ``inherit`` times their weight."""
    d = donors(weights, items, min_concepts)
    n = weights.groupBy("item_id").agg(F.count(F.lit(1)).alias("have"))
    poor = items.select("item_id", "conv_id").join(d, "conv_id").where("item_id <> donor_id").join(n, "item_id", "left").fillna(0, ["have"]).where(F.col("have") < min_concepts)
    given = poor.select("item_id", "donor_id").join(weights.select(F.col("item_id").alias("donor_id"), "concept", (F.col("weight") * inherit).alias("weight")), "donor_id")
    new = given.join(weights.select("item_id", "concept"), ["item_id", "concept"], "left_anti").select("item_id", "concept", F.round(F.col("weight") + HALF_UP, 6).alias("weight"))
    touched = new.select("item_id").distinct()
    own = weights.select("item_id", "concept", "weight")
    return own.join(touched, "item_id", "left_anti").unionByName(renormalised(own.join(touched, "item_id", "left_semi").unionByName(new), max_concepts))


def cooccurrence(weights: DataFrame) -> DataFrame:
    """(a, b, n), a < b: in how many items both concepts are; items have at most some 30 concepts, so pairs are bounded per item."""
    x = weights.select("item_id", F.col("concept").alias("a"))
    y = weights.select("item_id", F.col("concept").alias("b"))
    return x.join(y, "item_id").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def associates(weights: DataFrame, n_items: int, *, top_k: int = 20, min_pmi: float = 1.0, min_freq: int = 3, base2: bool = False) -> DataFrame:
    """(concept, associate, pmi, rank): each frequent concept's best associates by (pmi, name)."""
    names = _names(weights)
    found = _associates(weights, names, n_items, top_k, min_pmi, min_freq, base2)
    name = lambda d, c: small(names.select(F.col("d").alias(d), F.col("dim").alias(c)), names.n_rows)
    return found.join(name("a", "concept"), "a").join(name("b", "associate"), "b").select("concept", "associate", "pmi", "rank")


def _names(weights: DataFrame) -> DataFrame:
    """(dim, d): all concepts, numbered in the order of their names."""
    return products.numbered(weights.select(F.col("concept").alias("dim")), ordered=True)


def _associates(weights: DataFrame, names: DataFrame, n_items: int, top_k: int, min_pmi: float, min_freq: int, base2: bool) -> DataFrame:
    """(a, b, pmi, rank): ``associates`` by numbers of concepts.

    Concepts, as vectors over items, are multiplied block by block; of each block
    only pairs that may be among a concept's best leave the task.
    """
    unit = math.log(2) if base2 else 1.0

    def task(s, t, x, y):
        import numpy as np
        import pyarrow.compute as pc

        from topicloom.operators.products import CELLS, _dots, _table

        f, g = (np.asarray(pc.list_value_length(side["d"])).astype(np.int64) for side in (s, t))
        got, at, held, most = [], 0, 0, CELLS

        def less(i, j, n, fi, gj, pm):
            order = np.lexsort((-pm, i))
            first = np.searchsorted(i[order], i[order], "left")
            last = np.minimum(first + top_k, np.searchsorted(i[order], i[order], "right")) - 1
            keep = order[pm[order] >= pm[order][last] - 2e-9]  # the exact figures decide between these
            return tuple(c[keep] for c in (i, j, n, fi, gj, pm))

        for ia, ib, dots, _ in _dots(s, t, False):
            fa = f[at : at + len(ia)]
            at += len(ia)
            r, c = np.nonzero(dots)
            r, c = (k[ia[r] != ib[c]] for k in (r, c))
            n = dots[r, c]
            pm = np.log(n * n_items / (fa[r] * g[c]) + 1e-10) / unit
            for i, j, fi, gj in ((ia[r], ib[c], fa[r], g[c]), (ib[c], ia[r], g[c], fa[r]))[: 1 if x == y else 2]:
                ok = (pm >= (min_pmi if min_pmi > 0 else 0) - 1e-9) & (fi >= min_freq)
                got.append(tuple(k[ok] for k in (i, j, n, fi, gj, pm)))
                held += int(ok.sum())
            if held > most:
                got = [less(*map(np.concatenate, zip(*got, strict=True)))]
                held = len(got[0][0])
                most = max(CELLS, 2 * held)
        return _table([less(*map(np.concatenate, zip(*got, strict=True)))[:5]] if got else [], PAIRS, np)

    rows = weights.select("concept", F.col("item_id").alias("dim"), F.lit(1.0).alias("v")).join(small(names.select(F.col("dim").alias("concept"), F.col("d").alias("item_id")), names.n_rows), "concept")
    dims = products.numbered(rows)
    p = products.packed(rows, dims)
    products.forget(dims)
    blocks = products.sparse_blocks(p)
    products.ship_code(weights.sparkSession)
    ratio = F.col("n") * F.lit(float(n_items)) / (F.col("f") * F.col("g")) + F.lit(1e-10)
    best = Window.partitionBy("a").orderBy(F.desc(F.round("pmi", 9)), "b")

    def keep(pairs):
        pm = pairs.withColumn("pmi", F.log2(ratio) if base2 else F.log(ratio)).where(F.col("pmi") >= min_pmi if min_pmi > 0 else F.col("pmi") > 0)
        return pm.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k)

    return products.in_rounds(p, p, blocks, blocks, task, PAIRS, halves=True, keep=keep).select("a", "b", "pmi", "rank")


def densify(weights: DataFrame, n_items: int, *, top_k: int = 20, decay: float = 0.3, min_pmi: float = 1.0, max_new: int = 20) -> DataFrame:
    """Adds associates of an item's concepts at ``weight * decay * min(pmi / 3, 1)``, the best parent's, at most ``max_new``; renormalised.

    Blocks of items meet the associates in tasks, and only the best new concepts of an item leave them.
    """
    names = _names(weights)
    number = lambda d: small(names.select(F.col("dim").alias("concept"), F.col("d").alias(d)), names.n_rows)
    own = weights.select("item_id", "concept", "weight").join(number("d"), "concept").select("item_id", F.struct("d", F.col("weight").alias("v")).alias("e"))
    p = cut(own.groupBy("item_id").agg(F.sort_array(F.collect_list("e")).alias("e")).select("item_id", F.col("e.d").alias("d"), F.col("e.v").alias("v")), "packed")
    near = _associates(weights, names, n_items, top_k, min_pmi, 3, False).groupBy("b").agg(F.collect_list(F.struct("a", "pmi")).alias("e"))
    near = cut(near.select(F.col("b").alias("item_id"), F.col("e.a").alias("d"), F.col("e.pmi").alias("v")), "associates")  # by what is added: each new concept of an item comes from one task

    def task(s, t, x, y):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        from topicloom.operators.products import CELLS, _entries, largest

        items, first, d, _ = _entries(s)
        w = np.asarray(pc.fill_null(pc.list_flatten(s["v"]), 0.0))
        other, begin, parent, pmi = _entries(t)
        other = np.repeat(other, np.diff(begin)).astype(np.int64)
        order = np.argsort(parent, kind="stable")
        parent, other, pmi = parent[order], other[order], pmi[order]
        lo = np.searchsorted(parent, d, "left")
        n = np.searchsorted(parent, d, "right") - lo
        terms = np.concatenate([[0], np.cumsum(n)])
        wide = int(max(other.max(initial=0), d.max(initial=0))) + 1
        got, at = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))], 0
        while at < len(items):
            to = max(at + 1, int(np.searchsorted(terms[first], terms[first[at]] + CELLS, "right")) - 1)
            e = slice(first[at], first[to])
            row = np.repeat(np.arange(at, to), np.diff(first[at : to + 1]))
            place = np.arange(n[e].sum()) + np.repeat(lo[e] - (terms[e] - terms[first[at]]), n[e])
            gain = np.floor((np.repeat(w[e], n[e]) * decay * np.minimum(pmi[place] / 3, 1.0) + HALF_UP) * 1e6 + 0.5) / 1e6
            key = np.repeat(row, n[e]) * wide + other[place]
            new = ~np.isin(key, row * wide + d[e])
            key, gain = key[new], gain[new]
            order = np.argsort(key)
            key, gain = key[order], gain[order]
            starts = np.flatnonzero(np.diff(key, prepend=-1))
            if len(starts):
                key, gain = key[starts], np.maximum.reduceat(gain, starts)
                top = largest(key // wide, key % wide, gain, max_new)
                got.append((key[top] // wide, key[top] % wide, gain[top]))
            at = to
        row, d, gain = map(np.concatenate, zip(*got, strict=True))  # by row
        ends = pa.array(np.searchsorted(row, np.arange(len(items) + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(c)) for c in (d.astype(np.int64), gain)]
        held = [s["d"].cast(pa.list_(pa.int64())), s["v"]] if y == 0 else [pa.nulls(len(items), pa.list_(kind)) for kind in (pa.int64(), pa.float64())]
        return pa.table(dict(zip(("item_id", "d", "v", "new", "gain"), [s["item_id"], *held, *lists], strict=True)))

    entries = [side.agg(F.sum(F.size("d"))).first()[0] or 0 for side in (p, near)]
    na, nb = products.grid(*entries)
    products.ship_code(weights.sparkSession)
    found = products.paired(p, near, na, nb, task, "item_id long, d array<long>, v array<double>, new array<long>, gain array<double>")
    pairs = lambda d, v: F.transform(F.arrays_zip(d, v), lambda e: F.struct(e[d].alias("d"), e[v].alias("v")))
    rows = found.select("item_id", pairs("d", "v").alias("own"), pairs("new", "gain").alias("new"))
    if nb > 1:
        rows = rows.groupBy("item_id").agg(F.max("own").alias("own"), F.flatten(F.collect_list("new")).alias("new"))
        best = F.array_sort(F.transform("new", lambda e: F.struct((-e["v"]).alias("v"), e["d"].alias("d"))))
        rows = rows.select("item_id", "own", F.transform(F.slice(best, 1, max_new), lambda e: F.struct(e["d"].alias("d"), (-e["v"]).alias("v"))).alias("new"))
    rows = rows.select("item_id", F.concat("own", "new").alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda a, e: a + F.coalesce(e["v"], F.lit(0.0)))
    every = rows.withColumn("total", F.nullif(total, F.lit(0.0))).select("item_id", "total", F.inline("e")).select("item_id", "d", F.round(F.col("v") / F.col("total"), 6).alias("weight"))
    return every.join(small(names.select("d", F.col("dim").alias("concept")), names.n_rows), "d").select("item_id", "concept", "weight")


def densify_ablation(weights: DataFrame, n_items: int, *, top_k: int = 35, decay: float = 0.3) -> DataFrame:
    """The ablation's form: log2, any positive pmi, ``weight * decay * pmi / 10``, existing weights may rise, no cap."""
    a = associates(weights, n_items, top_k=top_k, min_pmi=0.0, min_freq=1, base2=True)
    new = weights.select("item_id", "concept", "weight").join(a.select("concept", "associate", "pmi"), "concept").select("item_id", F.col("associate").alias("concept"), (F.col("weight") * decay * F.col("pmi") / 10).alias("weight"))
    return weights.select("item_id", "concept", "weight").unionByName(new).groupBy("item_id", "concept").agg(F.round(F.max("weight"), 6).alias("weight"))
