"""Vector searches against brute force, ties, copies and unusable rows included."""

import numpy as np

from topicloom.llm import ann, mtree

rng = np.random.default_rng(1)


def _rows(n=600, d=16):
    x = rng.normal(size=(n, d)).astype(float)
    x[200:400] = x[200]  # a vector that a third share
    rows = [(i, v.tolist(), "k") for i, v in enumerate(x)]
    bad = [(1000, None, "k"), (1001, [1.0] * 15 + [None], "k"), (1002, [float("nan")] * d, "k"), (1003, [float("inf")] * d, "k"), (None, [1.0] * d, "k")]
    return x, rows, bad


def test_mtree_is_exact(spark):
    x, rows, bad = _rows()
    df = spark.createDataFrame([*rows, *bad, (1050, [0.0] * 16, "k"), (1051, [2.0], "k")], "vec_id long, embedding array<double>, score string")
    ids = np.array([*range(600), 1050, 1051])
    z = np.floor(256 * np.vstack([x, np.zeros(16), [2.0] + [0.0] * 15])).astype(np.int64)
    got = {}
    for r in mtree.search(df, 50, pivots=4, tree_rows=100).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    for q in np.flatnonzero(ids % 50 == 0):
        s = z @ z[q]
        order = [i for i in np.lexsort((ids, -s)) if i != q][:5]
        assert [got[ids[q]][k + 1] for k in range(5)] == [(ids[i], s[i]) for i in order]
    assert set(got) == {i for i in ids.tolist() if i % 50 == 0}


def test_few_or_no_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id, r.score) for r in mtree.search(df, 50).collect()] == [(0, 1, 65536)]
    assert [(r.query_id, r.vec_id, r.score) for r in ann.search(df, lambda i: i % 20 == 0, probed=1.0).collect()] == [(0, 1, 1.0)]
    assert mtree.search(df.limit(0), 50).count() == 0 and ann.search(df.limit(0), lambda i: i % 20 == 0).count() == 0


def test_ann_recall(spark):
    x, rows, bad = _rows(2000, 32)
    df = spark.createDataFrame([*rows, (1500_000, [0.0] * 32, "k"), *[b for b in bad]], "vec_id long, embedding array<double>, score string")
    got = {}
    for r in ann.search(df, lambda i: i % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for q in range(0, 2000, 20):
        s = (x * x[q]).sum(axis=1)
        top = [i for i in np.lexsort((np.arange(2000), -s)) if i != q][:20]
        found = [i for _, i, _ in sorted(got[q])]
        assert len(found) == 20 and q not in found and 1500_000 not in found
        assert all(abs(s[i] - v) < 1e-9 for _, i, v in got[q])
        hits, total = hits + len(set(top) & set(found)), total + 20
    assert hits / total >= 0.9 and 1500_000 not in got


def test_ann_goes_on_until_k_rows(spark):
    is_query = lambda i: i % 2 == 0
    few = [(i, rng.normal(size=8).tolist()) for i in range(18)]
    hot = [(i, [1.0, 0.0, 0.0, 0.0]) for i in range(400)] + [(400, [-9.0, 1.0, 0.0, 0.0]), (401, [-9.0, 0.0, 1.0, 0.0]), (402, [-9.0, 0.0, 0.0, 1.0])]
    for rows, want in ((few, 17), (hot, 20)):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = {}
        for r in ann.search(df, is_query).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        assert got.keys() == {i for i, _ in rows if i % 2 == 0}
        assert all(len(v) == want and q not in v for q, v in got.items())
