"""Hand-checked fixtures of the clustering operators."""

import json
import math

import pytest
from pyspark.sql import functions as F

from topicloom.functions import text as tx
from topicloom.operators import baselines, cascade, community, evaluate, knn, labelling, propagate, rules, sampling, vectors, weights
from topicloom.plans import clustering
from topicloom.sources import readers, sinks


def _frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_relaxed_filter(spark):
    want = {"ab": "short", "3.14": "number", "james": "person_name", "james bond": "person_name", "james mary": None, "james testing": None, "james pushkinovich": None, "please help": "llm_filler", "scalable design": "llm_filler", "value": "noise", "london": None}
    df = _frame(spark, [(k,) for k in want], "c string")
    got = {r.c: r.r for r in df.select("c", tx.drop_reason(F.col("c"), F.lit(True)).alias("r")).collect()}
    assert got == want
    response = df.where("c = 'london'").select(tx.drop_reason(F.col("c"), F.lit(False)).alias("r")).first().r
    assert response == "geo_noise"


def test_strict_filter(spark):
    df = _frame(spark, [("ab",), ("james mary",), ("james pushkinovich",), ("graph",)], "c string")
    got = {r.c: r.r for r in df.select("c", tx.drop_reason_strict(F.col("c"), F.lit(True)).alias("r")).collect()}
    assert got == {"ab": "low_quality", "james mary": "person_name", "james pushkinovich": "person_name", "graph": None}


def test_propagation(spark):
    w = _frame(spark, [(1, "d1", 1, 0.5), (1, "d2", 1, 0.3), (1, "d3", 1, 0.2), (2, "c0", 1, 1.0)], "item_id long, concept string, in_prompt int, weight double")
    items = _frame(spark, [(1, 7), (2, 7), (3, None)], "item_id long, conv_id long")
    got = {(r.item_id, r.concept): r.weight for r in propagate.propagate(w, items).collect()}
    assert {c: v for (i, c), v in got.items() if i == 2} == {"c0": 0.666667, "d1": 0.166667, "d2": 0.1, "d3": 0.066667}
    few = w.where("concept <> 'd3'")
    assert propagate.propagate(few, items).count() == 3


def test_pmi_associates(spark):
    rows = [(i, "a") for i in range(3)] + [(i, "b") for i in range(4)]
    w = _frame(spark, [(i, c, 0.6) for i, c in rows], "item_id long, concept string, weight double")
    got = {r.concept: r.pmi for r in propagate.associates(w, 16).collect()}
    assert math.isclose(got["a"], math.log(4), rel_tol=1e-9)
    assert propagate.associates(w, 8).count() == 0


def test_edges(spark):
    k = _frame(spark, [(1, 2, 0.7, 1), (2, 1, 0.7, 1), (3, 4, 0.7, 1), (5, 6, 0.59, 1), (7, 8, 0.6, 1)], "i long, j long, sim double, rank int")
    got = {(r.src, r.dst): round(r.weight, 6) for r in knn.edges(k, 0.6).collect()}
    assert got == {(1, 2): 1.4, (3, 4): 0.7, (7, 8): 0.6}


def test_cascade(spark):
    v = {1: (1, 0), 2: (0.96, 0.28), 3: (0, 1), 4: (0.28, 0.96), 5: (0.6, 0.8), 7: (-1, 0)}
    rows = [(i, str(d), float(x)) for i, xs in v.items() for d, x in enumerate(xs) if x]
    labels = _frame(spark, [(1, 0), (2, 0), (3, 1), (4, 1), (5, 2), (6, 3), (7, 4)], "item_id long, cluster_id long")
    out = {r.item_id: r.cluster_id for r in cascade.cascade(_frame(spark, rows, "item_id long, dim string, v double"), labels).collect()}
    assert out == {1: 0, 2: 0, 3: 1, 4: 1, 5: 1, 6: 0, 7: 4}
    log = cascade.cascade_rounds(_frame(spark, rows, "item_id long, dim string, v double"), labels).orderBy("stage").collect()
    assert len(log) == 7 and [r.coverage for r in log] == sorted(r.coverage for r in log) and log[-1].cumulative == 2


def test_nmi_ari(spark):
    pairs = list(zip("0001112223", "aaabbbbccc"))
    labels = _frame(spark, [(i, int(a)) for i, (a, _) in enumerate(pairs)], "item_id long, cluster_id long")
    truth = _frame(spark, [(i, b) for i, (_, b) in enumerate(pairs)], "item_id long, label string")
    r = evaluate.nmi_ari(labels, truth).first()
    assert r.nmi == pytest.approx(0.7474, abs=1e-4) and r.ari == pytest.approx(0.5679, abs=1e-4)
    assert evaluate.nmi_ari(labels.limit(9), truth).first().nmi is None


def test_kappa(spark):
    r = evaluate.kappa(_frame(spark, list(zip("xxxxyyyyzz", "xxxyyyyxzz")), "a string, b string")).first()
    assert r.kappa == 0.6875 and r.band == "substantial"
    assert evaluate.kappa(_frame(spark, [("x", "x")] * 3, "a string, b string")).first().kappa == 1.0
    assert evaluate.kappa(_frame(spark, [], "a string, b string")).first().kappa == 0.0
    assert evaluate.kappa_bootstrap(_frame(spark, [("x", "x")] * 3, "a string, b string")).first().hi == 1.0


def test_effective_number(spark):
    labels = _frame(spark, [(i, c) for i, c in enumerate([0] * 4 + [1] * 4 + [2] * 2)], "item_id long, cluster_id long")
    assert evaluate.cluster_metrics(labels).first().effective_k == pytest.approx(2.87, abs=0.01)


def test_published_bias_figures(spark):
    """The ratios of published agreement figures (fixed values): 1.038 and 1.0199, tau 1."""
    rows = [("m", "concept", 0.5627, 0.5361), ("ck", "concept", 0.478, 0.4657), ("sl", "embedding", 0.535, 0.5249), ("sk", "embedding", 0.519, 0.5136), ("su", "embedding", 0.5501, 0.5341), ("tk", "embedding", 0.4311, 0.4258)]
    df = _frame(spark, rows, "method string, type string, x double, y double")
    got = {r.type: r.mean_ratio for r in evaluate.bias(df).collect()}
    assert got["concept"] == pytest.approx(1.038, abs=1e-3) and got["embedding"] == pytest.approx(1.0175, abs=3e-3)
    assert evaluate.kendall_tau(df).first().tau == 1.0
    assert not evaluate.bias(df).first().biased


def test_components_and_leiden(spark):
    e = [(1, 2, 1.0), (2, 3, 1.0), (1, 3, 1.0), (3, 4, 0.1), (4, 5, 1.0), (5, 6, 1.0), (4, 6, 1.0), (10, 11, 1.0)]
    nodes = spark.range(1, 13).withColumnRenamed("id", "item_id")
    edges = _frame(spark, e, "src long, dst long, weight double")
    comp = {r.item_id: r.cluster_id for r in community.components(nodes, edges).collect()}
    assert comp == {**dict.fromkeys(range(1, 7), 1), 7: 7, 8: 8, 9: 9, 10: 10, 11: 10, 12: 12}
    for limit in (2_000_000, 1):  # in one task a component, and through the distributed rounds
        labels = community.leiden(nodes, edges, 1.0, local_edges=limit)
        got = {r.item_id: r.cluster_id for r in labels.collect()}
        assert len(got) == 12 and got[1] == got[2] == got[3] != got[4] == got[5] == got[6]
        better = community.modularity(edges, labels).first().modularity
        assert better >= community.modularity(edges, community.components(nodes, edges)).first().modularity
    none = community.leiden(nodes, edges.limit(0))
    assert none.where("item_id <> cluster_id").count() == 0


def test_leiden_joins_across_parts_at_every_size(spark):
    n = 120  # a ring: label propagation leaves many short runs, whose ends must still be able to join
    nodes = spark.range(n).withColumnRenamed("id", "item_id")
    edges = _frame(spark, [(i, (i + 1) % n, 1.0) for i in range(n)], "src long, dst long, weight double")
    quality = lambda limit: community.modularity(edges, community.leiden(nodes, edges, 1.0, local_edges=limit)).first().modularity
    assert quality(60) >= 0.97 * quality(2_000_000)


def test_knn_dense_blocks_agree(spark):
    import numpy as np

    x = np.random.default_rng(5).normal(size=(60, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = _frame(spark, [(i, v.tolist()) for i, v in enumerate(x)], "item_id long, v array<double>")
    one = {(r.i, r.j): r["rank"] for r in knn.knn_dense(df, 5).collect()}
    assert one == {(r.i, r.j): r["rank"] for r in knn.knn_dense(df, 5, block_rows=20).collect()}


def test_quota_samples(spark):
    df = _frame(spark, [(i, "a" if i < 70 else "b" if i < 95 else "c" if i < 99 else "d") for i in range(100)], "doc_id long, s string")
    n = {r.s: r["count"] for r in sampling.stratified(df, "doc_id", "s", 1000).groupBy("s").count().collect()}
    assert n == {"a": 70, "b": 25, "c": 4, "d": 1}
    assert sampling.stratified(df, "doc_id", "s", 20).count() == 20
    c = {r.s: r["count"] for r in sampling.capped(df, "doc_id", "s", 15).groupBy("s").count().collect()}
    assert c == {"a": 5, "b": 3, "c": 3, "d": 1} or sum(c.values()) <= 15


def test_labels_and_parsers(spark):
    cats = ["art_design", "finance", "music"]
    df = _frame(spark, [("Category: Art-Design",), ("economics",), ("",), ("so music it is",)], "a string")
    assert [r[0] for r in df.select(tx.normalise_label(F.col("a"), cats, {"economics": "finance"})).collect()] == ["art_design", "finance", None, "music"]
    v, b = tx.parse_verdict(F.lit("REJECT\nbetter: music"), cats)
    assert tuple(spark.range(1).select(v, b).first()) == ("reject", "music")
    w = _frame(spark, [(1, "x", 0.6), (1, "y", 0.4), (2, "z", 1.0)], "item_id long, concept string, weight double")
    c = _frame(spark, [("x", "A"), ("y", "B"), ("z", "unknown")], "concept string, label string")
    assert [tuple(r) for r in labelling.propagate_labels(w, c).collect()] == [(1, "A")]
    assert labelling.refine_taxonomy(["a"] * 10, ["b"] * 4) == ["a"] * 10


def test_sources_and_sinks(spark, tmp_path):
    rows = [{"item_id": 1, "conv_id": "c", "prompt": "", "features": {"concepts_all": ["graph", "node"]}}, {"item_id": 2, "prompt": "hi", "features": {"concepts_prompt": ["a"], "concepts_response": ["a", "b"]}}]
    (tmp_path / "f.json").write_text(json.dumps(rows))
    f = readers.read_features(spark, str(tmp_path / "f.json"))
    assert {r.item_id: r.prompt for r in f.collect()} == {1: "graph node", 2: "hi"}
    assert {(r.item_id, r.concept, r.in_prompt) for r in readers.feature_concepts(f).collect()} == {(1, "graph", 1), (1, "node", 1), (2, "a", 1), (2, "b", 0)}
    (tmp_path / "gt_fine_1.json").write_text(json.dumps({"prompt_labels": {"1": "x", "k": "y"}}))
    (tmp_path / "gt_fine_1_prompt_labels.json").write_text("{}")
    assert [tuple(r) for r in readers.read_ground_truth(spark, str(tmp_path), "fine").collect()] == [(1, "x")]
    chats = _frame(spark, [("7", [("system", "s"), ("human", "hello")])], "id string, conversations array<struct<`from`: string, value: string>>")
    assert tuple(readers.chat_export(chats).first()) == ("7", "hello")
    labels = _frame(spark, [(1, 2)], "item_id long, cluster_id long")
    sinks.write_labels(labels, "r1", str(tmp_path / "labels"))
    sinks.append_results(labels, str(tmp_path / "res"))
    sinks.append_results(labels, str(tmp_path / "res"))
    assert spark.read.parquet(str(tmp_path / "labels")).first().run == "r1" and spark.read.parquet(str(tmp_path / "res")).count() == 2
    assert sinks.next_version("a_v4.json") == "a_v5.json"


def test_rules(spark):
    df = _frame(spark, [(1, 1, None), (2, 0, "x")], "id long, flag int, matched string")
    assert [r.id for r in rules.chain(df, rules.flag_filter("flag")).collect()] == [1]
    assert [r.id for r in rules.null_issues("matched")(df).collect()] == [1]
    with pytest.raises(ValueError, match="missing"):
        rules.null_issues("nope")(df)
    assert rules.merged({"a": {"x": 1, "y": 2}}, {"a": {"x": 3}}) == {"a": {"x": 3, "y": 2}}
    assert rules.schema_errors(df, {"id": "bigint", "flag": "string", "z": "int"}) == ["flag: int, not string", "z: missing"]
    assert {r.rule: r.failures for r in rules.quality_report(df, {"f": F.col("flag") == 1}).collect()} == {"f": 1}


def test_weights_sum_to_one(spark):
    rows = [(i, f"common{'' if i % 3 else ' rare'} word{i % 7} topic{chr(97 + i % 9)}", None) for i in range(60)]
    items = _frame(spark, rows, "item_id long, prompt string, response string")
    w = weights.concept_weights(items, 60, max_df_pct=0.5)
    assert w.groupBy("item_id").agg(F.sum("weight").alias("s")).where("abs(s - 1) > 1e-5").count() == 0


def test_stream_agrees_with_table(spark, tmp_path):
    from topicloom.streaming import events

    table = readers.table(spark, "/root/testdata/sf0.001", "events")
    s = events.windowed(events.read_events(spark, "/root/testdata/sf0.001"))
    q = s.writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("w").count() == events.windowed(table).count()


def test_similar_pairs_are_all_pairs(spark):
    import numpy as np

    from topicloom.operators import knn

    rng = np.random.default_rng(6)
    x = rng.random((60, 12)) * (rng.random((60, 12)) < 0.3)
    x[:, 0] += 0.2  # a dimension that all share
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = spark.createDataFrame([(i, f"d{j}", float(x[i, j])) for i in range(60) for j in range(12) if x[i, j]], "item_id long, dim string, v double")
    for sigma in (0.3, 0.8):
        want = {(i, j) for i in range(60) for j in range(60) if i < j and x[i] @ x[j] >= sigma}
        assert {(r.i, r.j) for r in knn.similar_pairs(v, sigma).collect()} == want
        plain = {(r.i, r.j, r["rank"]) for r in knn.knn_sparse(v, 5).collect() if r.sim >= sigma}
        assert {(r.i, r.j, r["rank"]) for r in knn.knn_sparse(v, 5, sigma).collect()} == plain


def test_suite_keeps_going(spark):
    from topicloom.plans import clustering

    truth = spark.createDataFrame([(i, str(i % 2)) for i in range(12)], "item_id long, label string")
    labels = truth.selectExpr("item_id", "cast(label as long) as cluster_id")

    def broken():
        raise ValueError("no")

    got = {(r.family, r.run): (r.nmi, r.error) for r in clustering.suite({"a": {"good": lambda: labels, "bad": broken}, "b": {"x": broken}}, truth, skip=("b",)).collect()}
    assert got == {("a", "good"): (1.0, None), ("a", "bad"): (None, "ValueError: no")}


def test_triplets_draw_other_clusters(spark):
    from topicloom.operators import sampling

    labels = spark.createDataFrame([(i, i % 3) for i in range(90)] + [(100, 7)], "item_id long, cluster_id long")
    of = {r.item_id: r.cluster_id for r in labels.collect()}
    rows = sampling.triplets(labels, labels).collect()
    assert len(rows) == 90 and all(of[r.anchor] == of[r.positive] != of[r.negative] and r.anchor != r.positive for r in rows)
    assert len({r.negative for r in rows}) > 20


def test_shared_folder_is_asked_for(monkeypatch):
    from types import SimpleNamespace

    import pytest

    from topicloom import session

    far = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(ValueError):
        session.shared_dir(far)


def _planted(groups, size, inside, between, seed):
    import numpy as np

    rng = np.random.default_rng(seed)
    n = groups * size
    near = (np.arange(n)[:, None] // size) == (np.arange(n) // size)
    a, b = np.where(np.triu(rng.random((n, n)) < np.where(near, inside, between), 1))
    return n, np.concatenate([a, b]), np.concatenate([b, a])


def test_leiden_finds_planted_groups_and_keeps_them_connected():
    import numpy as np

    n, src, dst = _planted(8, 25, 0.5, 0.01, 3)
    w, k = np.ones(len(src)), np.bincount(src, minlength=n).astype(float)
    label = community._optimise(n, src, dst, w, k, 1.0 / len(src), 3)
    assert len(np.unique(label)) == 8 and all(len(np.unique(label[g * 25 : g * 25 + 25])) == 1 for g in range(8))
    for gamma in (0.5, 1.0, 4.0):
        label = community._optimise(n, src, dst, w, k, gamma / len(src), 3)
        assert len(np.unique(community._connected(label, src, dst))) == len(np.unique(label))


def test_refinement_stays_within_communities_and_bounds():
    import numpy as np

    n, src, dst = _planted(4, 12, 0.4, 0.1, 5)
    w, k = np.ones(len(src)), np.bincount(src, minlength=n).astype(float)
    comm, scale = np.arange(n) // 24, 1.0 / len(src)
    part = community._refine(n, src, dst, w, k, scale, comm)
    assert len(np.unique(part)) < n
    for p in np.unique(part):
        m = np.where(part == p)[0]
        assert len(np.unique(comm[m])) == 1
        if len(m) > 1:  # each part is connected
            inside = np.isin(src, m) & np.isin(dst, m)
            seen = community._connected(np.where(part == p, 0, 1 + np.arange(n)), src[inside], dst[inside])
            assert len(np.unique(seen[m])) == 1


def test_kept_labels_are_not_asked_again(spark, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()
    cats, folder = ["finance", "music"], str(asked)

    def ask(frames):
        import uuid
        from pathlib import Path

        for f in frames:
            for v in f["value"]:
                (Path(folder) / f"{v}-{uuid.uuid4().hex}").touch()
            yield f.assign(label=["Category: Music" if v == "song" else "no idea" for v in f["value"]])[["key", "label"]]

    df = _frame(spark, [("a", "song"), ("b", "noise"), ("a", "song"), (None, "void")], "k string, v string")
    path = str(tmp_path / "kept")
    for _ in range(2):
        assert [tuple(r) for r in labelling.label_kept(df, "k", "v", ask, cats, path, steps=2).collect()] == [("a", "music")]
    counts = [p.name.split("-")[0] for p in asked.iterdir()]
    assert counts.count("song") == 1 and counts.count("noise") == 2 and "void" not in counts
    assert labelling.label_kept(df.limit(0), "k", "v", ask, cats, str(tmp_path / "none")).count() == 0


def test_batches_are_tried_again():
    import pandas as pd

    left = [2]

    def flaky(frames):
        for f in frames:
            if left[0]:
                left[0] -= 1
                raise OSError("busy")
            yield f

    f = pd.DataFrame({"key": [1], "value": ["x"]})
    assert len(list(labelling.retrying(flaky, 3, 0.0)(iter([f])))) == 1
    left[0] = 2
    with pytest.raises(OSError):
        list(labelling.retrying(flaky, 2, 0.0)(iter([f])))


def test_judging_and_taxonomies(spark):
    cats = ["finance", "music"]
    rows = _frame(spark, [("k1", "music", "a"), ("k2", "music", "b"), ("k3", "music", "")], "k string, label string, t string")
    got = {r.k: (r.verdict, r.better) for r in labelling.verify(rows, "k", "t", labelling.rule_judge(cats), cats, 1).collect()}
    assert got == {"k1": ("accept", None), "k2": ("reject", "finance")}
    pairs = labelling.classify(rows.select("k", "t"), "k", "t", labelling.rule_labeller(cats), cats, rows.select("k", "label"))
    assert {(r.k, r.a, r.b) for r in pairs.collect()} == {("k1", "music", "music"), ("k2", "music", "finance"), ("k3", "music", "finance")}
    texts = _frame(spark, [(i, f"t{i}") for i in range(30)], "item_id long, t string")
    grow = lambda names, batch: sorted(set(names) | {f"c{len(names) + j}" for j in range(2)})
    assert len(labelling.taxonomy(texts, "item_id", "t", grow, batches=3, size=10)) == 6
    assert labelling.taxonomy(texts, "item_id", "t", lambda names, batch: ["x"] if names else ["a", "b", "c"], batches=2, size=10) == ["a", "b", "c"]
    labels = _frame(spark, [(i, "big" if i < 8 else "small") for i in range(10)], "item_id long, label string")
    assert labelling.subdivided(labels, ["big", "small", "none"], lambda n: ["x", "y"], 0.5) == ["big: x", "big: y", "small", "none"]
    assert tuple(labelling.dry_run(texts, "t", 20, 2.0).first()) == (30, 2, 80, 20, 0.00004)


def test_kappa_interval_covers_kappa(spark):
    pairs = _frame(spark, [(str(i % 2), str((i + (i % 10 == 0)) % 2)) for i in range(400)], "a string, b string")
    r, k = evaluate.kappa_bootstrap(pairs, 200).first(), evaluate.kappa(pairs).first().kappa
    assert 0 < r.lo < k < r.hi < 1 and abs((r.hi - r.lo) / 4 - 0.03) < 0.01  # the standard error of kappa here is 0.03


def test_strict_patterns_and_scripts(spark):
    df = _frame(spark, [("can you tell",), ("step 2",), ("i think",), ("kernel of",), ("canal",)], "c string")
    got = {r.c: r.r for r in df.select("c", tx.drop_reason_strict(F.col("c"), F.lit(True)).alias("r")).collect()}
    assert got == {"can you tell": "llm_filler", "step 2": "llm_filler", "i think": "llm_filler", "kernel of": "llm_filler", "canal": None}
    text = _frame(spark, [("Привет мир, été x 東京 ok",)], "t string")
    assert text.select(tx.word_concepts(F.col("t"), tx.ANY_SCRIPT).alias("w")).first().w == ["привет", "мир", "été", "東京", "ok"]
    assert text.select(tx.word_concepts(F.col("t")).alias("w")).first().w == ["ok"]


def test_usable_texts(spark):
    df = _frame(spark, [(None,), ("",), ("  0123456789 ",), ("01234567890",)], "t string")
    rows = df.select(tx.usable(F.col("t")).alias("a"), tx.usable(F.col("t"), beyond=True).alias("b"), tx.shortened(F.col("t"), 3).alias("c")).collect()
    assert [(r.a, r.b, r.c) for r in rows] == [(False, False, None), (False, False, ""), (True, False, "  0"), (True, True, "012")]


def test_hashed_and_defaulted_vectors(spark):
    items = _frame(spark, [(1, "alpha beta alpha"), (2, None), (3, "!!")], "item_id long, prompt string")
    got = {r.item_id: r.v for r in vectors.hashed(items, 32).collect()}
    assert math.isclose(sum(x * x for x in got[1]), 1.0) and len(got[1]) == 32
    assert got[2] == got[3] == [0.0] * 32
    pairs = _frame(spark, [(1, "a"), (1, "b")], "item_id long, concept string")
    w = _frame(spark, [(1, "a", 0.2)], "item_id long, concept string, weight double")
    v = {r.dim: r.v for r in vectors.paired_vectors(pairs, w, 0.1).collect()}
    assert math.isclose(v["a"] / v["b"], 2.0)


def test_spherical_refit_and_connectivity(spark):
    rows = [(i, [math.cos(a), math.sin(a)]) for i, a in enumerate((0.0, 0.1, 0.2, 1.5, 1.6, 1.4))] + [(6, [0.0, 0.0])]
    start = [(0, 0), (1, 0), (2, 1), (3, 1), (4, 1), (5, 1), (6, 1)]
    got = dict(baselines.spherical_refit(_frame(spark, rows, "item_id long, v array<double>"), _frame(spark, start, "item_id long, cluster_id long")).collect())
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1, 6: 0}
    near = _frame(spark, [(1, 2), (2, 1), (3, 1)], "i long, j long")
    edges = baselines.connectivity(near)
    assert sorted(map(tuple, edges.collect())) == [(1, 2, 1.0), (1, 3, 0.5)]
    found = dict(baselines.spectral(_frame(spark, [(1,), (2,), (3,), (9,)], "item_id long"), edges, 2).collect())
    assert set(found) == {1, 2, 3, 9} and found[9] == -11


def test_topics_with_like_terms_merge(spark):
    texts = ["solar panel energy", "energy solar panel", "panel energy solar", "solar energy panel", "violin concert", "concert violin"]
    items = _frame(spark, list(enumerate(texts)), "item_id long, prompt string")
    labels = _frame(spark, [(0, 1), (1, 1), (2, 4), (3, 4), (4, 7), (5, 7)], "item_id long, cluster_id long")
    assert dict(baselines.merge_topics(items, labels, 0.9).collect()) == {0: 1, 1: 1, 2: 1, 3: 1, 4: 7, 5: 7}


def test_consolidated_labels_and_annotation(spark):
    labels = _frame(spark, [("a", "x"), ("b", "y"), ("c", None)], "concept string, label string")
    canonical = _frame(spark, [("x", "z"), ("x", "w"), (None, "n")], "label string, canonical string")
    assert {r.concept: r.label for r in labelling.consolidate(labels, canonical).collect()} == {"a": "w", "b": "y", "c": None}
    ids = _frame(spark, [(1,), (2,)], "item_id long")
    rows = sampling.annotation(ids, _frame(spark, [(1, "p"), (3, "q")], "item_id long, prompt string"), _frame(spark, [(1, "l"), (2, "m")], "item_id long, label string"))
    assert [tuple(r) for r in rows.collect()] == [(1, "p", "l")]


def test_rules_report_and_refuse(spark):
    df = _frame(spark, [(1, 5.0), (2, None), (3, 9.0)], "id long, v double")
    rule, (before, after) = rules.counted(rules.between("id", 2, 3))
    assert rule(df).count() == 2 and (before.get["rows"], after.get["rows"]) == (3, 2)
    assert rules.between("id", first=9, enabled=False)(df).count() == 3
    assert not rules.validate(df, {"id": "bigint"}, {"id": F.col("id") > 0}).has_errors
    assert rules.validate(df, {"id": "int"}).errors == ("id: bigint, not int",)
    assert rules.validate(df, expectations={"v there": F.col("v").isNotNull()}).errors == ("v there: 1 of 3 rows",)
    with pytest.raises(ValueError, match="v there"):
        rules.validate(df, expectations={"v there": F.col("v").isNotNull()}, strict=True)
    made = []
    frames = rules.Frames(raw=lambda f: made.append("raw") or df, known=lambda f: f["raw"].where("v is not null"))
    assert frames["known"].count() == 2 and frames["raw"].count() == 3 and made == ["raw"]
    frames.clear()


def test_anomalies(spark):
    df = _frame(spark, [("a", 1.0)] * 20 + [("a", 100.0)] + [("b", 5.0)] * 3, "g string, v double")
    assert [(r.g, r.side, r.n) for r in rules.anomalies(df, "g", "v").collect()] == [("a", "high", 1)]


def test_vectors_and_items_must_agree(spark):
    dense = _frame(spark, [(1, [0.1]), (2, [0.2])], "item_id long, v array<double>")
    assert readers.aligned(dense, dense.select("item_id")).count() == 2
    for other in (dense.where("item_id = 1"), dense.unionByName(dense)):
        with pytest.raises(ValueError, match="vector"):
            readers.aligned(other, dense.select("item_id"))


def test_runs_profiles_and_reports(spark, tmp_path):
    df = _frame(spark, [(1, 0.5), (2, None)], "item_id long, cluster_id double")
    sinks.write_run(df, "r1", {"k": 3, "gamma": 1.0}, str(tmp_path / "run"))
    config = spark.read.json(str(tmp_path / "run/config")).first()
    assert (config.run, json.loads(config.config)) == ("r1", {"k": 3, "gamma": 1.0})
    assert spark.read.parquet(str(tmp_path / "run/labels")).count() == 2
    sinks.write_profiles(df, df.limit(1), str(tmp_path / "profiles"))
    assert readers.read_profiles(spark, str(tmp_path / "profiles/slim")).count() == 1
    assert sinks.console(df.orderBy("item_id")).split("\n")[1].split() == ["1", "0.5000"]
    sinks.write_html(_frame(spark, [("<b>",)], "c string"), str(tmp_path / "page"))
    assert "&lt;b&gt;" in spark.read.text(str(tmp_path / "page")).first()[0]


def test_metered_and_paced(spark):
    labeller, counts = labelling.metered(spark, labelling.paced(labelling.rule_labeller(["x", "y"]), 1000.0))
    df = _frame(spark, [(1, "abcde"), (2, "ab")], "id long, v string").coalesce(1)
    assert labelling.label(df, "id", "v", labeller).count() == 2
    assert (counts["values"].value, counts["tokens"].value) == (2, 3)


def test_facets_are_not_asked_again(spark, tmp_path):
    def extractor(frames):
        for f in frames:
            yield f.assign(label=[("" if v == "later" else f"t | {v}") for v in f["value"]])[["key", "label"]]

    def wrong(frames):
        for f in frames:
            yield f.assign(label="x | y | z")[["key", "label"]]

    items = _frame(spark, [(1, "one"), (2, "later"), (None, "none")], "item_id long, prompt string")
    path = str(tmp_path / "facets")
    assert [tuple(r) for r in labelling.facets_kept(items, extractor, path, 2).collect()] == [(1, "t", "one", None)]
    again = {r.item_id: tuple(r)[1:] for r in labelling.facets_kept(items, wrong, path, 2).collect()}
    assert again == {1: ("t", "one", None), 2: ("x", "y", "z")}


def test_bias_runs_keep_going(spark):
    labels = _frame(spark, [(i, i % 2) for i in range(20)], "item_id long, cluster_id long")
    truth = labels.select("item_id", F.col("cluster_id").cast("string").alias("label"))
    got = {r.method: (r.type, r.x, r.y) for r in clustering.bias_runs({"m": ("a", lambda: labels), "bad": ("b", lambda: labels.select("nothing"))}, truth, truth.withColumn("label", F.lit("one"))).collect()}
    assert got == {"m": ("a", 1.0, 0.0), "bad": ("b", None, None)}


def _random_vectors(spark, n=50, dims=9):
    import numpy as np

    rng = np.random.default_rng(8)
    x = (rng.random((n, dims)) + 0.05) * (rng.random((n, dims)) < 0.5)
    x[:, 0] = 0.4  # a dimension that all share
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x, spark.createDataFrame([(i, f"d{j}", float(x[i, j])) for i in range(n) for j in range(dims) if x[i, j]], "item_id long, dim string, v double")


def test_sparse_neighbours_leave_no_pairs_between_tasks(spark, monkeypatch):
    from topicloom.operators import products

    monkeypatch.setattr(products, "LEAST_ROWS", 20)  # several blocks
    x, v = _random_vectors(spark)
    near = knn.knn_sparse(v, 5)
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "CoGroups" in plan
    s = x @ x.T
    want = {(i, j) for i in range(len(x)) for j in sorted((j for j in range(len(x)) if j != i), key=lambda j: (-round(s[i, j], 12), j))[:5]}
    assert {(r.i, r.j) for r in near.collect()} == want


def test_similar_pairs_by_shared_dimensions(spark):
    x, v = _random_vectors(spark)
    both = (x > 0).astype(int) @ (x > 0).T.astype(int)
    want = {(i, j): both[i, j] for i in range(len(x)) for j in range(i + 1, len(x)) if x[i] @ x[j] >= 0.5 and both[i, j] >= 4}
    assert want and {(r.i, r.j): r.shared for r in knn.similar_pairs(v, 0.5, shared=4).collect()} == want


def test_moves_give_nodes_a_turn_only_when_due(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    n = 400  # ten groups with few links between them
    pairs = {(min(a, b), max(a, b)) for a in range(n) for b in np.r_[rng.choice(np.arange(a % 10, n, 10), 6), rng.integers(n)] if a != b}
    s, d = (np.array(x) for x in zip(*sorted(pairs)))
    src, dst = np.r_[s, d], np.r_[d, s]
    w = np.ones(len(src))
    k = np.bincount(src, minlength=n).astype(float)
    assert community.PASSES == 50
    calls = []
    monkeypatch.setattr(np, "unique", lambda *a, f=np.unique, **b: calls.append(1) or f(*a, **b))
    label = community._move(n, src, dst, w, k, 1 / w.sum(), np.arange(n))
    assert not calls  # none for a node's turn
    for i in range(n):  # no node of all wants to move
        gain = lambda c: w[(src == i) & (label[dst] == c)].sum() - k[i] / w.sum() * (k[label == c].sum() - (k[i] if label[i] == c else 0))  # noqa: B023, E731
        assert max(gain(c) for c in set(label[dst[src == i]])) <= gain(label[i]) + 1e-9


def test_tables_leave_no_shuffle_files_and_can_be_forgotten(spark):
    import os

    from topicloom.session import cut, forget

    files = lambda: {f.getName() for f in _each(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before = files()
    held = cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "held")
    assert not _lasting(files, before)
    assert len(held.collect()) == 7
    assert os.path.isdir(path := held.written_at.removeprefix("file://"))
    forget(held)
    assert not os.path.exists(path)


def _each(seq):
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


def _lasting(files, before):
    """Shuffle data written since, once removal had five seconds."""
    import time

    for _ in range(50):
        if not (left := {f for f in files() - before if f.endswith(".data")}):
            break
        time.sleep(0.1)
    return left


def test_texts_are_dealt_out_before_their_words(spark):
    rows = [(1, "Red apples and red pears", "green plums"), (1, "blue plums", None), (2, None, "Red sky")]
    ic = weights.item_concepts(_frame(spark, rows, "item_id long, prompt string, response string"))
    plan = ic._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")  # the parent stands first
    got = sorted((r.item_id, r.concept, r.in_prompt) for r in ic.collect())
    assert got == sorted([(1, "red", 1), (1, "apples", 1), (1, "and", 1), (1, "pears", 1), (1, "green", 0), (1, "plums", 1), (1, "blue", 1), (2, "red", 0), (2, "sky", 0)])


def test_halved_products_give_the_rows_of_both_blocks(spark, monkeypatch):
    from topicloom.operators import products

    monkeypatch.setattr(products, "LEAST_ROWS", 20)  # several blocks
    x, v = _random_vectors(spark)
    same = v.where("item_id = 3").select(F.explode(F.expr("sequence(1003L, 1012L)")).alias("item_id"), "dim", "v")  # a group of copies: ties go to the least ids
    v = v.unionByName(same)
    plain = {(r.i, r.j, r["rank"]) for r in knn.knn_sparse(v, 4).collect() if r.sim >= 0.5}
    assert plain and {(r.i, r.j, r["rank"]) for r in knn.knn_sparse(v, 4, 0.5).collect()} == plain
    assert products.grid(100_000_000, 1_000_000)[1] == 1 and products.grid(9, 1) == (12, 1)


def test_pairs_of_concepts_and_centroids_stay_within_tasks(spark, monkeypatch):
    from topicloom.operators import products

    w = _frame(spark, [(i, f"c{(i * i + 7 * j) % 23}", round(0.1 + 0.01 * j, 2)) for i in range(60) for j in range(5)], "item_id long, concept string, weight double").dropDuplicates(["item_id", "concept"])
    top = propagate.associates(w, 60, top_k=3, min_pmi=0.2)
    plan = top._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroups" in plan and "Aggregate" not in plan  # no pair is summed up between tasks
    x, v = _random_vectors(spark)
    labels = v.select("item_id").distinct().withColumn("cluster_id", F.when(F.col("item_id") % 3 == 0, F.col("item_id") % 4).otherwise(F.col("item_id") + 100))
    rows = lambda d: sorted(map(tuple, d.collect()))
    results = lambda: (rows(propagate.associates(w, 60, top_k=3, min_pmi=0.2)), rows(propagate.densify(w, 60, top_k=3, min_pmi=0.2, max_new=4)), rows(cascade.assign_singletons(v, labels, 0.1)))
    one = results()
    monkeypatch.setattr(products, "ENTRIES", 100)  # several blocks
    assert all(one) and results() == one
    moved = {i: c for i, c in one[2]}
    group = {c: [i for i in range(len(x)) if i % 3 == 0 and i % 4 == c] for c in range(4)}
    mean = {c: x[i].mean(axis=0) for c, i in group.items()}
    for i in range(len(x)):
        if i % 3:
            sim, to = max((round(float(x[i] @ m / (m @ m) ** 0.5), 9), -c) for c, m in mean.items())
            assert moved[i] == (-to if sim >= 0.1 else i + 100)


def test_rounds_of_blocks_give_the_same_rows_and_deal_out_a_part(spark, monkeypatch):
    from topicloom.operators import products

    w = _frame(spark, [(i, f"c{(i * i + 7 * j) % 23}", round(0.1 + 0.01 * j, 2)) for i in range(60) for j in range(5)], "item_id long, concept string, weight double").dropDuplicates(["item_id", "concept"])
    w = w.unionByName(_frame(spark, [(100, "c1", None), (100, "c2", 0.5)], "item_id long, concept string, weight double"))
    _, v = _random_vectors(spark)
    labels = v.select("item_id").distinct().withColumn("cluster_id", F.when(F.col("item_id") % 3 == 0, F.col("item_id") % 4).otherwise(F.col("item_id") + 100))
    rows = lambda d: sorted(map(str, d.collect()))
    near = lambda d: sorted((r.i, r.j, round(r.sim, 12), r["rank"]) for r in d.collect())
    results = lambda: (
        rows(propagate.associates(w, 60, top_k=3, min_pmi=0.2)), rows(propagate.densify(w, 60, top_k=3, min_pmi=0.2, max_new=4)), rows(cascade.assign_singletons(v, labels, 0.1)),
        near(knn.knn_sparse(v, 3, 0.05)), rows(knn.similar_pairs(v, 0.1).select("i", "j", "shared")),
    )
    one = results()
    for n in (1, 5, 30, 400):
        assert n * (n + 1) / 2 / products.n_rounds(n, n, True) <= max(12, n)
    monkeypatch.setattr(products, "sparse_blocks", lambda p: 3)
    monkeypatch.setattr(products, "n_rounds", lambda *a: 2)
    assert all(one) and results() == one
