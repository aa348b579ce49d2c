"""Near-duplicate documents: BagMinHash signatures of word shingles, banding, and verified multiset overlap.

Every document is the multiset of its shingles of five lower-case words (the
whole text, if it has fewer). A shingle's weight, its count, is cut into the
dyadic intervals [0,1), [1,2), [2,4), [4,8), ...; each interval owns a Poisson
process of its length's rate, seeded by the shingle and the interval. A point
has a time, a register and a height; it counts where its height is below the
weight. A register's value is its earliest point, so two documents agree in
one with the probability of their weighted Jaccard similarity. Points are
made in order of time only as far as the last empty register needs.

Texts with equal words form a class (a node, named by a hash of its words).
Nodes that share a band meet in its bucket. Candidates are verified in two
steps, and only links between different components matter:

1. each bucket's hub, the member that shares the most buckets with others, is
   compared with all members; verified links join components.
2. of buckets that still hold two components, every pair across components is
   verified unless an exact bound excludes it. Let a document's *shared*
   elements be those that some other open document holds too; only they can
   overlap. A member with fewer of them than any partner in its bucket needs
   leaves the bucket. The others carry, beside their number of shared elements,
   the counts of these in cells of the hash space: the cells' lesser counts add
   up to a bound of the overlap. Bounds are looked at in tiles of at most
   ``TILE`` x ``TILE`` members, and only by members outside the bucket's largest
   component, so work is in proportion to a bucket's size times those. A pair
   is looked at in the first bucket that it shares.

No link between candidates is lost, and no bucket is expanded into pairs.
Comparisons with one document are dealt out by salt.

Defined results: ids should be unique; rows that repeat an id with other words
are classified each by its own words; a null id is replaced by a negative
hash of its text, also in the result. Null and empty texts (no words) are all
of one class. Rows repeat as they do in the input. An empty table gives none.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, identity, materialise, session, ship_code
from .graph import components, joined

SHINGLE, SIMILARITY = 5, 0.8
#: 24 bands of 5 registers: a pair at 0.8 is missed with probability 7e-5.
BANDS, ROWS = 24, 5
#: One task compares a document with about so many others.
SALT_ROWS = 512
#: Members on either side of a tile.
TILE = 1024
#: Documents are worked on in parts of about so many bytes of text.
_PART_BYTES = 1 << 20
#: Up to so many rows of two or three numbers (ids of candidates, pairs of a step) are broadcast; beyond, texts and sets are shuffled to them.
MOST_ROWS = 200_000


@lru_cache(1)
def _word_hashes():
    import xxhash

    class Hashes(dict):
        def __missing__(self, word):
            if len(self) > 200_000:
                self.clear()
            self[word] = h = xxhash.xxh3_64_intdigest(word)
            return h

    return Hashes()


def mix(x):
    """The splitmix64 finaliser on uint64 arrays."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: list[str], k: int = SHINGLE):
    """The hashes of a text's shingles, sorted, repeats kept."""
    import numpy as np

    if not words:
        return np.empty(0, np.uint64)
    h = mix(np.fromiter(map(_word_hashes().__getitem__, words), np.uint64, len(words)))
    n, base = max(1, len(h) - k + 1), np.uint64(0x9E3779B97F4A7C15)
    out = np.zeros(n, np.uint64)
    for i in range(min(k, len(h))):
        out = out * base + h[i : i + n]
    return np.sort(mix(out))


def counted(sorted_hashes):
    """Distinct hashes and their counts, of a sorted array."""
    import numpy as np

    new = np.ones(len(sorted_hashes), bool)
    new[1:] = sorted_hashes[1:] != sorted_hashes[:-1]
    at = np.flatnonzero(new)
    return sorted_hashes[at], np.diff(np.append(at, len(sorted_hashes)))


def multiset_elements(sorted_hashes):
    """One sorted hash per (shingle, occurrence): their overlap is the multisets' overlap."""
    import numpy as np

    s, c = counted(sorted_hashes)
    if len(s) == len(sorted_hashes):
        return sorted_hashes
    nth = np.arange(len(sorted_hashes)) - np.repeat(np.cumsum(c) - c, c)
    again = mix(np.repeat(s, c) + nth.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    return np.sort(np.where(nth == 0, np.repeat(s, c), again))


def signatures(docs: list, m: int):
    """BagMinHash registers, one row of ``m`` doubles per array of sorted shingle hashes (none of them empty)."""
    import numpy as np

    sets = [counted(d) for d in docs]
    count = np.concatenate([c for _, c in sets])
    levels = np.where(count > 1, np.ceil(np.log2(np.maximum(count, 2))).astype(np.int64) + 1, 1)
    doc0 = np.repeat(np.arange(len(docs)), [len(c) for _, c in sets])
    doc0, count0 = np.repeat(doc0, levels), np.repeat(count, levels).astype(float)
    level = np.arange(len(doc0)) - np.repeat(np.cumsum(levels) - levels, levels)
    seed0 = mix(np.repeat(np.concatenate([s for s, _ in sets]), levels) + level.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    bottom0 = np.where(level == 0, 0.0, 2.0 ** (level - 1))
    length0 = np.where(level == 0, 1.0, bottom0)
    weight = np.array([len(d) for d in docs], float)
    until = m / weight * (math.log(m) + 4)
    out = np.full(len(docs) * m, np.inf)
    todo = np.ones(len(docs), bool)
    while todo.any():
        on = todo[doc0]
        doc, seed, bottom, length, top = doc0[on], seed0[on], bottom0[on], length0[on], count0[on]
        time, k = np.zeros(len(doc)), 0
        while len(doc):
            k += 1
            x = mix(seed + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            time = time - np.log1p(-((x >> np.uint64(11)).astype(float) * 2.0**-53)) / length
            on = time <= until[doc]
            doc, seed, bottom, length, top, time, x = (v[on] for v in (doc, seed, bottom, length, top, time, x))
            y = mix(x ^ np.uint64(0xE7037ED1A0B428DB))
            held = np.floor(bottom + length * (y >> np.uint64(32)).astype(float) * 2.0**-32) < top
            register = ((y & np.uint64(0xFFFFFFFF)) % np.uint64(m)).astype(np.int64)
            np.minimum.at(out, (doc * m + register)[held], time[held])
        todo = np.isinf(out.reshape(-1, m)).any(axis=1)
        until = until * 2
    return out.reshape(-1, m)


def band_keys(sig, bands: int, rows: int):
    import numpy as np

    bits = sig.view(np.uint64).reshape(len(sig), bands, rows)
    out = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x8CB92BA72F3D8DD7), (len(sig), 1))
    for i in range(rows):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + bits[:, :, i])
    return out.view(np.int64)


def _in_parts(values):
    at = 0
    while at < len(values):
        end, size = at, 0
        while end < len(values) and size < _PART_BYTES:
            size += len(values[end] or "") + 64
            end += 1
        yield at, end
        at = end


def _words(text):
    return (text or "").lower().split()


def node_of(words: list[str]) -> int:
    return int.from_bytes(hashlib.blake2b(" ".join(words).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def signed(df: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, text_key, text) -> (id, text_key, node, number of shingles, band keys; no keys without words)."""
    ship_code(session(df))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(2).to_pylist()
            for at, end in _in_parts(texts):
                words = [_words(t) for t in texts[at:end]]
                full = [i for i, w in enumerate(words) if w]
                keys, n = np.zeros((len(words), bands), np.int64), [max(1, len(w) - SHINGLE + 1) if w else 0 for w in words]
                if full:
                    keys[full] = band_keys(signatures([shingle_hashes(words[i]) for i in full], bands * rows), bands, rows)
                offsets = np.concatenate([[0], np.cumsum([bands if w else 0 for w in words])]).astype(np.int32)
                flat = pa.array(keys[full].reshape(-1) if full else np.empty(0, np.int64))
                own = [batch.column(i).slice(at, end - at) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array([node_of(w) for w in words], pa.int64()), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), flat)], names=["id", "text_key", "node", "n", "bands"])

    return df.mapInArrow(run, "id long, text_key long, node long, n long, bands array<long>")


def element_sets(df: DataFrame) -> DataFrame:
    """(node, text) -> (node, sorted multiset elements as bytes), where the text's words are the node's."""
    ship_code(session(df))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            nodes, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, end in _in_parts(texts):
                words = [(k, w) for k, w in zip(nodes[at:end], map(_words, texts[at:end])) if node_of(w) == k]
                sets = [multiset_elements(shingle_hashes(w)).tobytes() for _, w in words]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in words], pa.int64()), pa.array(sets, pa.binary())], names=["node", "elements"])

    return df.mapInArrow(run, "node long, elements binary")


def overlaps(pairs: DataFrame, sets: DataFrame, salt_rows: int = SALT_ROWS) -> DataFrame:
    """(a, b) -> (a, b, similarity): the multisets' Jaccard similarity; a frequent ``a`` is dealt out by salt."""
    few = pairs.count() <= MOST_ROWS
    often = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / salt_rows).cast("int").alias("parts"))
    often = F.broadcast(often) if few else often
    left = sets.join(often, F.col("node") == F.col("a")).select("a", F.col("elements").alias("left"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    # the salt needs each pair's number of parts: joined on small rows, before the sets
    p = pairs.join(often, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")).select("a", "b", "salt")
    # few pairs go to the sets, so that a set is shuffled once a pair, to its hub, and not twice
    p = F.broadcast(p) if few else p
    p = sets.select(F.col("node").alias("b"), F.col("elements").alias("right")).join(p, "b").join(left, ["a", "salt"]).select("a", "b", "left", "right")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = []
            for x, y in zip(batch.column(2), batch.column(3)):
                u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(u) > len(v):
                    u, v = v, u
                at = np.searchsorted(v, u)
                both = int((v[np.minimum(at, len(v) - 1)] == u).sum()) if len(v) else 0
                out.append(both / max(1, len(u) + len(v) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["a", "b", "similarity"])

    return p.mapInArrow(run, "a long, b long, similarity double")


def cell_counts(elements):
    """Counts of hashes by cell; the number of cells is a power of two, about half of the hashes."""
    import numpy as np

    c = 1 << min(11, max(6, len(elements).bit_length() - 2))
    return np.bincount((elements & np.uint64(c - 1)).astype(np.int64), minlength=c).astype(np.int32)


def most_shared(one, others):
    """A bound of the overlap of ``one`` with each row of ``others``, by cell counts; the longer are folded to the shorter."""
    import numpy as np

    while others.shape[1] > len(one):
        others = others[:, : others.shape[1] // 2] + others[:, others.shape[1] // 2 :]
    while len(one) > others.shape[1]:
        one = one[: len(one) // 2] + one[len(one) // 2 :]
    return np.minimum(one, others).sum(axis=1)


def shared_elements(sets: DataFrame) -> DataFrame:
    """(node, elements) -> (node, shared: how many of its elements another node has too, cells: their counts).

    Elements of one node only are found by counts, so an element that all nodes have makes no hot key.
    """
    ship_code(session(sets))

    def each(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for node, e in zip(batch.column(0).to_pylist(), batch.column(1)):
                v = np.frombuffer(e.as_buffer(), np.int64)
                for i in range(0, len(v), 1 << 16):
                    part = v[i : i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(len(part), node))], names=["e", "node"])

    def rest(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for node, e, alone in zip(batch.column(0), batch.column(1), batch.column(2)):
                v = np.frombuffer(e.as_buffer(), np.uint64)
                if alone.is_valid:
                    v = v[~np.isin(v, np.asarray(alone.values).view(np.uint64), assume_unique=True)]
                yield pa.RecordBatch.from_arrays([pa.array([node.as_py()], pa.int64()), pa.array([len(v)], pa.int64()), pa.array([cell_counts(v).tobytes()], pa.binary())], names=["node", "shared", "cells"])

    once = sets.mapInArrow(each, "e long, node long").groupBy("e").agg(F.count(F.lit(1)).alias("times"), F.min("node").alias("node")).where("times = 1")
    once = once.groupBy("node").agg(F.collect_list("e").alias("alone"))  # no more than the node has elements
    return sets.join(once, "node", "left").select("node", "elements", "alone").mapInArrow(rest, "node long, shared long, cells binary")


def _components_in(members: DataFrame) -> DataFrame:
    """(key, node, label, ...) -> the members of keys with two labels, and ``minor``: whether one isn't of its key's largest label."""
    by = members.groupBy("key", "label").agg(F.count(F.lit(1)).alias("times"))
    most = by.groupBy("key").agg(F.count(F.lit(1)).alias("labels"), F.max(F.struct("times", "label")).alias("top")).where("labels > 1")
    return members.join(most.select("key", F.col("top.label").alias("top")), "key").withColumn("minor", F.col("label") != F.col("top")).drop("top")


def open_pairs(members: DataFrame, info: DataFrame, similarity: float, tile: int = TILE) -> DataFrame:
    """(a, b): pairs of members (key, node, n, label) of one bucket and two components that no bound excludes.

    ``info`` has (node, shared, cells, bands). Two multisets of x and y elements
    are similar enough only if they share at least s / (1 + s) (x + y).
    """
    ship_code(session(members))
    share = similarity / (1 + similarity)
    m = members.join(info.select("node", "shared"), "node")
    least = m.groupBy("key").agg(F.min("n").alias("least"))
    m = m.join(least, "key").where(F.col("shared") >= share * (F.col("n") + F.greatest(similarity * F.col("n"), F.col("least"))) - 1e-6)
    m = materialise(_components_in(m.select("key", "node", "n", "label", "shared")), "near-rest")
    parts = m.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("blocks"), F.ceil(F.count(F.when(F.col("minor"), 1)) / tile).cast("int").alias("chunks"))
    m = m.join(parts, "key").join(info.select("node", "cells", "bands"), "node")
    columns = ["key", "node", "n", "label", "shared", "minor", "cells", "bands"]
    dealt = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = m.where("minor").select(*columns, dealt("chunks").alias("chunk"), every("blocks").alias("block"))
    right = m.select(*columns, every("chunks").alias("chunk"), dealt("blocks").alias("block"))

    def look(left, right):
        import numpy as np
        import pyarrow as pa

        a, b = [], []
        if len(left) and len(right):
            key = left["key"][0].as_py()
            get = lambda t, c: np.asarray(t[c].combine_chunks())
            grid = lambda t: np.asarray(t["bands"].combine_chunks().flatten()).reshape(len(t), -1)
            cells = lambda t: [np.frombuffer(x.as_buffer(), np.int32) for x in t["cells"].combine_chunks()]
            (n1, s1, l1, k1), (n2, s2, l2, k2) = ([get(t, c) for c in ("n", "shared", "label", "node")] for t in (left, right))
            minor, g1, g2, c1, c2 = np.asarray(right["minor"].combine_chunks().to_numpy(zero_copy_only=False)), grid(left), grid(right), cells(left), cells(right)
            wide = np.array([len(c) for c in c2])
            at_width = {w: np.flatnonzero(wide == w) for w in np.unique(wide)}
            stacked = {w: np.stack([c2[i] for i in at]) for w, at in at_width.items()}
            place = np.empty(len(c2), np.int64)
            for at in at_width.values():
                place[at] = np.arange(len(at))
            for i in range(len(n1)):
                need = share * (n1[i] + n2) - 1e-6
                on = (l2 != l1[i]) & (np.minimum(n2, n1[i]) >= similarity * np.maximum(n2, n1[i]) - 1e-6) & (np.minimum(s2, s1[i]) >= need) & (~minor | (k2 < k1[i]))
                at = np.flatnonzero(on)
                at = at[g2[at, (g2[at] == g1[i]).argmax(axis=1)] == key]  # the first bucket that both are in
                for w in np.unique(wide[at]):
                    some = at[wide[at] == w]
                    some = some[most_shared(c1[i], stacked[w][place[some]]) >= need[some]]
                    a.append(k2[some]), b.append(np.full(len(some), k1[i]))
        cat = lambda x: np.concatenate(x).astype("i8") if x else np.empty(0, "i8")
        return pa.table({"a": cat(a), "b": cat(b)})

    keys = ("key", "block", "chunk")
    right = right.toDF(*right.columns)  # both sides come from the same rows
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(look, "a long, b long")


def _classes(df: DataFrame, id_col: str, text_col: str, similarity: float, bands: int, rows: int) -> DataFrame:
    """(id, text_key, node, class_node, class_id) for each row."""
    docs = df.select(identity(id_col, text_col).alias("id"), F.col(text_col).alias("text"))
    sig = materialise(signed(docs.select("id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "text"), bands, rows), "near-signatures")
    reps = materialise(sig.groupBy("node").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")), "near-classes")
    spread = reps.select("node", "n", F.explode("bands").alias("key"))
    shared = spread.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = materialise(spread.join(shared, "key"), "near-buckets")
    score = materialise(members.groupBy("node").agg(F.sum("size").alias("score")).join(reps.select("node", "rep"), "node"), "near-scores")
    wanted = score.select("node", F.col("rep").alias("id"))
    total = wanted.count()
    sets = materialise(element_sets(docs.join(F.broadcast(wanted) if total <= MOST_ROWS else wanted, "id").select("node", "text")), "near-sets")
    if sets.count() > total:  # rows that repeat an id and a text
        again, sets = sets, materialise(sets.dropDuplicates(["node"]), "near-sets")
        discard(again)
    # the hubs: sizes further apart than the similarity can't reach it
    scored = members.select("key", "node", "n").join(score.select("node", "score"), "node")
    hub = scored.groupBy("key").agg(F.max(F.struct("score", F.col("node").alias("hub"), F.col("n").alias("hub_n"))).alias("h")).select("key", "h.hub", "h.hub_n")
    fit = F.least("n", "hub_n") >= similarity * F.greatest("n", "hub_n") - 1e-6
    pairs = members.join(hub, "key").where(F.col("node") != F.col("hub")).where(fit).select(F.least("hub", "node").alias("x"), F.greatest("hub", "node").alias("y"), F.col("hub").alias("a"), F.col("node").alias("b"))
    pairs = materialise(pairs.groupBy("x", "y").agg(F.max("a").alias("a"), F.max_by("b", "a").alias("b")).select("a", "b"), "near-pairs")
    near = lambda p: materialise(overlaps(p, sets).where(F.col("similarity") >= similarity).select("a", "b"), "near-links")
    links = near(pairs)
    labels = components(links)
    # what is left open
    m = members.select("key", "node", "n").join(labels, "node", "left").select("key", "node", "n", F.coalesce("label", "node").alias("label"))
    left = materialise(_components_in(m).drop("minor"), "near-open")
    discard(members, score, pairs, links)
    if not left.isEmpty():
        open_sets = sets.join(left.select("node").distinct(), "node", "left_semi")
        info = materialise(shared_elements(open_sets).join(reps.select("node", "bands"), "node"), "near-shared")
        pairs = materialise(open_pairs(left, info, similarity), "near-pairs")
        discard(info)
        if not pairs.isEmpty():
            labels = joined(labels, near(pairs))
        discard(pairs)
    discard(left, sets)
    ends = reps.select("node", "rep").join(labels, "node", "left").select("node", "rep", F.coalesce("label", "node").alias("class_node"))
    least = ends.groupBy("class_node").agg(F.min("rep").alias("class_id"))
    ends = materialise(ends.join(least, "class_node").select("node", "class_node", "class_id"), "near-ends")
    discard(reps)
    return sig.select("id", "text_key", "node").join(ends, "node")


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: its id and ``class_id``, the least id among the documents that links connect it with."""
    return _classes(df, id_col, text_col, similarity, bands, rows).select(F.col("id").alias(id_col), "class_id")


def representatives(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, text_key): of each class the document of the least id; of its texts the one of the least ``text_key`` (xxhash64), for rows that share the id."""
    found = _classes(df, id_col, text_col, similarity, bands, rows).where("id = class_id")
    return found.groupBy("class_node", "id").agg(F.min("text_key").alias("text_key")).select("id", "text_key")
