"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The unit of drawing is a block: the documents of one source whose hash falls
into one of ``blocks`` classes. Steps, all in DataFrame operations:

1. sizes (words) by document, then by source; targets by water-filling: each
   source gets its weight's share of ``ratio`` times all words, stops at
   ``cap`` times its own words, and the excess goes to the others by weight.
2. quotas: a source is drawn whole as often as its target allows; of the
   rest, each block in hashed order that still fits, then documents of the
   first block that does not, in key order, while they fit, then single
   documents from the largest to the smallest as long as any fits. So a source
   misses its target by less than its smallest undrawn document, and never
   exceeds it.
3. the splitting tree: the sources' quotas of blocks are halved level by
   level among ``shards`` output shards (a power of two); at each node the left half's counts
   are one draw of the multivariate hypergeometric distribution, taken source
   by source through inverse distribution functions.
4. each source's permuted blocks are cut by the shards' quotas, so shards are
   disjoint; a draw's ``position`` orders it within its shard.

Block tables have at most sources x ``blocks`` rows whatever the input. No
window spans more than one source's blocks or one block's documents; the folds
go over one source's blocks, or over the different sizes of its documents that
fit into what is left.

Defined results: null text has size 0; null source is a source of its own,
last in order; documents of size 0 are drawn with their block like others
and add nothing; equal rows (id, text and source) are drawn together; an
empty table gives no rows; other columns are not read, and ``drawn_rows`` keeps
them. The splitting tree folds over all sources in one row a node, so it is meant
for thousands of sources, not millions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fraction, materialise

WORD = "[^\\x20\\x09-\\x0D]+"
#: Weights by the sources' order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
RATIO, CAP = 1.5, 2.0
BLOCKS, SHARDS, SEED = 4096, 16, 17


def words(column: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(column), F.lit("")), F.lit(WORD)).cast("long")


def row_key(seed: int, *columns: str) -> Column:
    """What tells a document from others: the hash of its id, text and source."""
    return F.xxhash64(F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])


def targets(sizes: DataFrame, weights=WEIGHTS, ratio: float = RATIO, cap: float = CAP) -> DataFrame:
    """(source, source_size) -> the same and ``target``: min(cap x size, level x weight) with the level that meets the total."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    w = sizes.withColumn("_w", pick).withColumn("_cap", F.col("source_size") * cap).withColumn("_at", F.col("_cap") / F.col("_w"))
    every = Window.partitionBy()
    upto = Window.orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    w = w.withColumn("_total", F.sum("source_size").over(every) * ratio)
    need = F.sum("_cap").over(upto) + F.col("_at") * (F.sum("_w").over(every) - F.sum("_w").over(upto))
    w = w.withColumn("_full", need <= F.col("_total"))
    spent = F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(every), F.lit(0.0))
    left = F.coalesce(F.sum(F.when(~F.col("_full"), F.col("_w"))).over(every), F.lit(0.0))
    level = F.when(left > 0, (F.col("_total") - spent) / left).otherwise(F.lit(0.0))
    return w.withColumn("target", F.when(F.col("_full"), F.col("_cap")).otherwise(F.least(F.col("_cap"), level * F.col("_w")))).select("source", "source_size", "target")


def hypergeometric(population: Column, marked: Column, drawn: Column, *seeds: Column) -> Column:
    """How many of ``marked`` are among ``drawn`` out of ``population``, by urn: item by item, each is
    drawn with the chance that is left, so the count has exactly that distribution."""
    items = F.when(marked > 0, F.sequence(F.lit(0).cast("long"), marked - 1)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(items, F.lit(0).cast("long"), lambda got, j: got + F.when(fraction(*seeds, j) * (population - j) < drawn - got, 1).otherwise(0))


def split_quotas(quotas: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(source, quota) -> (source, shard, quota, first): the splitting tree's leaves; ``first`` counts earlier shards' blocks."""
    if shards < 1 or shards & (shards - 1):
        raise ValueError("shards: a power of two")
    depth = shards.bit_length() - 1

    def numbered(s, i):
        return F.struct(s.source.alias("source"), s.quota.alias("quota"), i.alias("i"))

    def deal(level):  # one source's share of the left half
        def step(s, x):
            got = hypergeometric(s.n, x.quota, s.m, F.lit(seed + 1 + level), F.col("shard"), x.i)
            return F.transform(F.array(got), lambda g: F.struct((s.n - x.quota).alias("n"), (s.m - g).alias("m"), F.concat(s.left, F.array(g)).alias("left")))[0]

        return step

    def half(side):
        return lambda s, i: F.struct(s.source.alias("source"), (F.get("_left", i) if side == 0 else s.quota - F.get("_left", i)).alias("quota"))

    node = quotas.groupBy().agg(F.array_sort(F.collect_list(F.struct("source", F.col("quota").cast("long").alias("quota")))).alias("q")).withColumn("shard", F.lit(0).cast("long"))
    for level in range(depth):
        total = F.aggregate("q", F.lit(0).cast("long"), lambda a, s: a + s.quota)
        node = node.withColumn("_n", total).withColumn("_u", F.transform("q", numbered))
        empty = F.array().cast("array<bigint>")
        zero = F.struct(F.col("_n").alias("n"), F.floor((F.col("_n") + 1) / 2).cast("long").alias("m"), empty.alias("left"))
        node = node.withColumn("_left", F.aggregate("_u", zero, deal(level), lambda s: s.left))
        sides = F.array(*[F.struct((F.col("shard") * 2 + side).alias("shard"), F.transform("q", half(side)).alias("q")) for side in (0, 1)])
        node = node.select(F.explode(sides).alias("n")).select("n.shard", "n.q")
    leaves = node.select("shard", F.explode("q").alias("s")).select("s.source", "shard", "s.quota")
    before = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return leaves.withColumn("first", F.coalesce(F.sum("quota").over(before), F.lit(0)))


def fill(queue: str, gap: Column, what: str) -> Column:
    """An array of (..., all, n) in order -> (gap, taken): of each entry's ``n`` times ``all`` words as many as still fit,
    later entries too where one does not; ``taken`` names the entries by ``what``, with their numbers."""
    none = F.array().cast("array<struct<what: bigint, n: bigint>>")

    def step(s, x):
        n = F.when(x["all"] > 0, F.least(x.n, F.floor(s.gap / x["all"]))).when(s.gap >= 0, x.n).otherwise(F.lit(0)).cast("long")
        more = lambda m: F.struct((s.gap - m * x["all"]).cast("double").alias("gap"), F.concat(s.taken, F.array(F.struct(x[what].cast("long").alias("what"), m.alias("n")))).alias("taken"))
        return F.transform(F.array(n), lambda m: F.when(m > 0, more(m)).otherwise(s))[0]

    return F.aggregate(queue, F.struct(gap.cast("double").alias("gap"), none.alias("taken")), step)


def mix(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, ratio: float = RATIO, cap: float = CAP, blocks: int = BLOCKS, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row per document: ``key`` (row_key of id, text and source), its id, ``size``, ``source_size``, ``target``, ``rows`` (equal rows) and ``draws``, an array of (copy, shard, position)."""
    key = row_key(seed, id_col, text_col, source_col)
    units = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), key.alias("key"), words(text_col).alias("size"))
    units = units.groupBy("id", "source", "key", "size").agg(F.count(F.lit(1)).alias("rows"))
    units = units.withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 101), "key"), F.lit(blocks)).cast("int")).withColumn("all", F.col("size") * F.col("rows"))
    units = materialise(units, "mix-units")
    per_block = materialise(units.groupBy("source", "block").agg(F.sum("all").alias("words")), "mix-blocks")
    goal = materialise(targets(per_block.groupBy("source").agg(F.sum("words").alias("source_size")), weights, ratio, cap), "mix-targets")
    few = _few(goal)

    def with_goal(t: DataFrame, *columns: str) -> DataFrame:
        g = goal.select(F.col("source").alias("_s"), *[F.col(c) for c in ("source_size", "target") if c in columns])
        return t.join(F.broadcast(g) if few else g, t["source"].eqNullSafe(F.col("_s")), "left").drop("_s")

    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    b = with_goal(per_block, "source_size", "target").withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    queue = b.groupBy("source", "rest").agg(F.array_sort(F.collect_list(F.struct(F.xxhash64(F.lit(seed + 102), "source", "block").alias("h"), "block", F.col("words").alias("all"), F.lit(1).cast("long").alias("n")))).alias("q"))
    filled = materialise(queue.select("source", fill("q", F.when(F.col("rest") > 0, F.col("rest")).otherwise(F.lit(-1.0)), "block").alias("f")), "mix-filled")
    fits = filled.select(F.col("source").alias("_s"), F.explode("f.taken").alias("t")).select("_s", F.col("t.what").alias("_b"), F.lit(True).alias("fits"))
    b = b.join(fits, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")), "left").drop("_s", "_b").withColumn("fits", F.coalesce("fits", F.lit(False)))
    b = materialise(b, "mix-order")
    # what is left for single documents, and the block from which they come first
    gaps = filled.select(F.col("source").alias("_s"), F.col("f.gap").alias("gap")).where("gap >= 1")
    free = units.join(b.where(~F.col("fits")).select(F.col("source").alias("_s"), F.col("block").alias("_b")), F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b"))).select("source", "block", "key", "all").where("all > 0")
    free = free.join(F.broadcast(gaps) if few else gaps, F.col("source").eqNullSafe(F.col("_s"))).where("all <= gap").drop("_s")
    free = materialise(free, "mix-free")
    edge = free.groupBy("source").agg(F.min(F.struct(F.xxhash64(F.lit(seed + 102), "source", "block"), "block")).alias("e")).select(F.col("source").alias("_s"), F.col("e.block").alias("edge"))
    first = free.join(F.broadcast(edge) if few else edge, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("edge"))).drop("_s", "edge")
    within = Window.partitionBy("source").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    chosen = materialise(first.withColumn("upto", F.sum("all").over(within)).where("upto <= gap").select("source", "key", "all"), "mix-chosen")
    # what is left then goes to documents by falling size: counts by size, then those places in a size's order of blocks and keys
    used = chosen.groupBy("source").agg(F.sum("all").alias("used")).select(F.col("source").alias("_s"), "used")
    more = free.join(F.broadcast(used) if few else used, F.col("source").eqNullSafe(F.col("_s")), "left").withColumn("gap", F.col("gap") - F.coalesce("used", F.lit(0))).drop("_s", "used").where("all <= gap")
    more = materialise(more.join(chosen.select(F.col("key").alias("_k")), F.col("key") == F.col("_k"), "left_anti"), "mix-more")
    counts = more.groupBy("source", "gap", "all", "block").agg(F.count(F.lit(1)).alias("n"))
    by_size = counts.groupBy("source", "gap", "all").agg(F.sum("n").alias("n"))
    queue = by_size.groupBy("source", "gap").agg(F.array_sort(F.collect_list(F.struct((-F.col("all")).alias("h"), "all", "n"))).alias("q"))
    taken = queue.select(F.col("source").alias("_s"), F.explode(fill("q", F.col("gap"), "all").taken).alias("t")).select("_s", F.col("t.what").alias("_a"), F.col("t.n").alias("take"))
    upto = F.sum("n").over(Window.partitionBy("source", "all").orderBy("block"))
    spots = counts.withColumn("before", upto - F.col("n")).join(taken, F.col("source").eqNullSafe(F.col("_s")) & (F.col("all") == F.col("_a"))).where("before < take")
    spots = spots.select(F.col("source").alias("_s"), F.col("all").alias("_a"), F.col("block").alias("_b"), (F.col("take") - F.col("before")).alias("take"))
    place = F.row_number().over(Window.partitionBy("source", "all", "block").orderBy("key"))
    rest = more.join(spots, F.col("source").eqNullSafe(F.col("_s")) & (F.col("all") == F.col("_a")) & (F.col("block") == F.col("_b"))).withColumn("place", place).where("place <= take").select("source", "key", "all")
    chosen = materialise(chosen.unionByName(rest), "mix-chosen")
    # draws of blocks: every whole pass, the rest's blocks, and the chosen documents as one block more (-1)
    passes = b.select("source", "block", F.explode(F.concat(F.when(F.col("whole") > 0, F.sequence(F.lit(1).cast("long"), F.col("whole"))).otherwise(F.array().cast("array<bigint>")), F.when(F.col("fits"), F.array(F.col("whole") + 1)).otherwise(F.array().cast("array<bigint>")))).alias("copy"))
    extra = chosen.groupBy("source").count().select("source", F.lit(-1).alias("block"))
    extra = with_goal(extra, "source_size", "target").select("source", "block", (whole + 1).alias("copy"))
    ranked = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 103), "source", "block", "copy"), "block", "copy")
    drawn = materialise(passes.unionByName(extra).withColumn("rank", F.row_number().over(ranked)), "mix-drawn")
    leaves = split_quotas(drawn.groupBy("source").agg(F.count(F.lit(1)).alias("quota")), shards, seed)
    leaf = leaves.select(F.col("source").alias("_s"), "shard", "first", "quota")
    placed = drawn.join(F.broadcast(leaf) if few else leaf, drawn["source"].eqNullSafe(leaf["_s"]) & (F.col("rank") > F.col("first")) & (F.col("rank") <= F.col("first") + F.col("quota")))
    placed = materialise(placed.groupBy("source", "block").agg(F.array_sort(F.collect_list(F.struct("copy", "shard"))).alias("in")), "mix-placed")
    p = placed.select(F.col("source").alias("_s"), F.col("block").alias("_b"), "in")
    x = p.where("_b = -1").select(F.col("_s").alias("_t"), F.col("in").alias("also"))
    picked = chosen.join(F.broadcast(x) if few else x, F.col("source").eqNullSafe(F.col("_t"))).select(F.col("key").alias("_k"), "also")
    out = units.join(p, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")), "left").join(picked, F.col("key") == F.col("_k"), "left").drop("_s", "_b", "_k")
    none = F.array().cast(placed.schema["in"].dataType)
    draws = F.transform(F.concat(F.coalesce("in", none), F.coalesce("also", none)), lambda d: F.struct(d.copy.alias("copy"), d.shard.alias("shard"), F.xxhash64(F.lit(seed + 104), F.col("key"), d.copy).alias("position")))
    return with_goal(out.withColumn("draws", draws), "source_size", "target").select("key", F.col("id").alias(id_col), "size", "source_size", "target", "rows", "draws")


#: A table of sources is broadcast only up to so many, of so many characters in all.
MOST_SOURCES, MOST_CHARS = 10_000, 1_000_000


def _few(goal: DataFrame) -> bool:
    """Whether the written table of sources is small enough to broadcast."""
    n, chars = goal.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(F.col("source").cast("string"))), F.lit(0))).first()
    return n <= MOST_SOURCES and chars <= MOST_CHARS


def drawn_rows(df: DataFrame, mixed: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """The mix itself: every row of ``df`` once per draw, with ``mix_shard`` and ``mix_position`` (replaced if there)."""
    d = mixed.where(F.size("draws") > 0).select("key", "draws")
    names = df.columns
    rows = df.toDF(*[f"c{i}" for i in range(len(names))])  # no column of ``df`` clashes with those made here
    at = [f"c{names.index(c)}" for c in (id_col, text_col, source_col)]
    rows = rows.withColumn("own", row_key(seed, *at)).join(d, F.col("own") == F.col("key")).select(*rows.columns, F.explode("draws").alias("d"))
    kept = [(f"c{i}", c) for i, c in enumerate(names) if c not in ("mix_shard", "mix_position")]
    return rows.select(*[F.col(i).alias(c) for i, c in kept], F.col("d.shard").alias("mix_shard"), F.col("d.position").alias("mix_position"))
