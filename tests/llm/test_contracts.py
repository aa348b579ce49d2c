"""Registered queries and pipeline stages against brute force; clashing names; what the cut gains; few and many candidates."""

import os
import random
import re
import time
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from topicloom.llm import ann, bpe, html_extract, lines, minhash, mixing, queries
from topicloom.llm import quality as q4
from topicloom.llm.common import table

from .test_text_ops import RANKS, _classes_by_hand, _edit_distance

TINY, SMALL = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
given = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the given tables are not here")


def _kept_lines(rows):
    """Texts without the lines that come within two edits of an earlier one (those of one or two characters: equal ones)."""
    first = {}
    for i, t in sorted(rows):
        for n, x in enumerate((t or "").split("\n")):
            first.setdefault(x, (i, n))
    near = lambda a, b: abs(len(a) - len(b)) <= 2 and 2 < min(len(a), len(b)) and _edit_distance(a, b) <= 2
    lines_ = [x for x in first if x.strip()]
    gone = {b for a in lines_ for b in lines_ if first[a] < first[b] and near(a, b)}
    return {i: "\n".join(x for n, x in enumerate((t or "").split("\n")) if not x.strip() or (first[x] == (i, n) and x not in gone)) for i, t in rows}


def _corpus(n=60):
    random.seed(3)
    vocabulary = ["".join(random.choices("abcdefghijklmnop", k=random.randint(2, 8))) for _ in range(400)]
    line = lambda k: " ".join(random.choices(vocabulary, k=k)).capitalize() + "."
    shared = line(12)
    rows = []
    for i in range(n):
        if i % 10 == 7:  # junk
            text = " | ".join(random.choices(vocabulary, k=40)) + "!!!"
        elif i % 10 == 4:  # a near copy of the one before: the words of its lines stand in other lines
            words = rows[-1][1].split()
            words[5:6] = ["other"]
            text = " ".join(words)
        else:
            text = "\n".join([line(14) for _ in range(4)] + [shared] * (i % 3 == 0) + [line(14)[:-1] + "?"])
        rows.append((i, text, "en", f"s{i % 4}" if i % 9 else None))
    rows += [(100, None, None, "s1"), (101, "", "en", None), (102, rows[0][1], "en", "s2")]
    return rows


def _write(spark, tmp_path, rows):
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i % 10 != 7), 0) for i, *_ in rows[:60]]
    spark.createDataFrame([*labels, (None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")


def test_pipeline_stages_are_brute_force(spark, tmp_path):
    rows = _corpus()
    _write(spark, tmp_path, rows)
    docs, seen = table(spark, str(tmp_path), "documents"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        seen.append([r.asDict() for r in docs.collect()])
        assert k == 4 or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    first, deduped, single, mixed, tokens = seen
    score = {r.doc_id: r.score for r in queries.op4_quality(spark, str(tmp_path)).collect()}
    by_id = {r[0]: r for r in rows}
    assert {r["doc_id"] for r in first} == {i for i, s in score.items() if s >= 0.7} and not {r["doc_id"] for r in first} & {7, 17, 27, 37, 47, 57}
    assert all((r["doc_id"], r["text"], r["lang"], r["source"]) == by_id[r["doc_id"]] for r in first)
    want = _kept_lines([(r["doc_id"], r["text"]) for r in first])
    want = {i: t for i, t in want.items() if t.strip() or not (by_id[i][1] or "").strip()}
    assert {r["doc_id"]: r["text"] for r in deduped} == want and all(r["n_chars"] == len(r["text"]) for r in deduped)
    classes = _classes_by_hand([(r["doc_id"], r["text"]) for r in deduped])
    assert sorted(r["doc_id"] for r in single) == sorted(set(classes.values())) and len(single) < len(deduped)
    assert {r["doc_id"]: r["text"] for r in single}.items() <= want.items()
    times, sizes = Counter(r["doc_id"] for r in mixed), {r["doc_id"]: len(re.findall("[^\x20\x09-\x0d]+", r["text"])) for r in single}
    assert max(times.values()) <= 2 and times.keys() <= sizes.keys()
    assert abs(sum(sizes[i] * n for i, n in times.items()) - 1.5 * sum(sizes.values())) <= 4 * max(sizes.values())
    enc = bpe.encoder(bpe.read_ranks(RANKS), P.PATTERN)
    text = {r["doc_id"]: r["text"] for r in single}
    assert Counter((r["doc_id"], r["n_tokens"]) for r in tokens) == Counter((r["doc_id"], len(enc.encode_ordinary(text[r["doc_id"]]))) for r in mixed)
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in tokens)


def test_pipeline_takes_nulls_clashes_and_nothing(spark, tmp_path):
    rows = [(None, "A text that nobody has an id for.", None, None), (None, "A text that nobody has an id for.", None, None), (1, None, None, None), (2, "", "x", "y"), (2, "", "x", "y")]
    docs = spark.createDataFrame([(*r, 0, i, i, i, i) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars int, _score int, _had int, _ident int, `a``b` int")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for table_ in (docs, docs.limit(0)):
        now = table_
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, now, str(tmp_path)).write.mode("overwrite").parquet(f"{tmp_path}/out{k}")
            now = spark.read.parquet(f"{tmp_path}/out{k}")
            assert k == 4 or now.columns == docs.columns
        assert (now.count() > 0) == (table_ is docs)


def test_names_do_not_clash(spark):
    names = ["_id", "_doc", "_flags", "_stay", "_key", "_k", "_d", "_y", "id", "key", "line", "draws", "n", "c0", "label", "node", "features", "own", "a`b"]
    texts = ["One line of text.\nAnother one of them.", "One line of text.\nSome third words here.", None]
    df = spark.createDataFrame([(i, t, f"s{i}", *[f"{i}{c}" for c in names]) for i, t in enumerate(texts)], "doc_id long, text string, source string, " + ", ".join(f"`{c.replace('`', '``')}` string" for c in names))
    same = lambda r: all(r[c] == f"{r['doc_id']}{c}" for c in names)
    out = lines.dedup_lines(df, min_chars=1).collect()
    assert all(map(same, out)) and {r.doc_id: r.text for r in out} == {0: texts[0], 1: "Some third words here.", 2: ""}
    drawn = mixing.drawn_rows(df, mixing.mix(df)).collect()
    assert all(map(same, drawn))
    labels = df.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("_id"), F.lit(0).alias("id"), F.lit(0).alias("y"))
    assert all(map(same, q4.score(df, q4.train(df, labels)).collect()))
    assert all(map(same, bpe.encode(df, RANKS, P.PATTERN).collect()))
    assert minhash.near_duplicates(df).count() == 3
    assert all(map(same, html_extract.extract(df.withColumn("html", F.col("text"))).collect()))


def test_many_near_copies_in_one_bucket(spark):
    random.seed(41)
    words = [f"w{i}" for i in range(900)]
    base = random.choices(words, k=120)
    rows = []
    for i in range(300):  # half of them are within reach of others, half lie around the similarity
        t = list(base)
        for _ in range(random.choice([0, 1, 2, 3, 4, 5])):
            t[random.randrange(len(t))] = random.choice(words)
        rows.append((i, " ".join(t[: random.choice([len(t), len(t), 110, 90])])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = _classes_by_hand(rows)
    assert len(set(want.values())) > 20
    # more bands of fewer rows: nearly all meet, in large buckets
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(df, bands=60, rows=1).collect()} == want


def test_tiles_lose_no_pair(spark):
    random.seed(43)
    words = [f"w{i}" for i in range(900)]
    base = random.choices(words, k=60)
    rows = [(i, " ".join(random.choice(words) if random.random() < 0.03 else w for w in base)) for i in range(40)]
    df = spark.createDataFrame(rows, "node long, text string")
    sets = {i: minhash.multiset_elements(minhash.shingle_hashes(t.split())) for i, t in rows}
    s = spark.createDataFrame([(i, bytearray(e.tobytes())) for i, e in sets.items()], "node long, elements binary")
    info = minhash.shared_elements(s).withColumn("bands", F.array(F.lit(5).cast("long"), F.lit(6).cast("long")))
    members = df.select(F.explode(F.array(F.lit(5).cast("long"), F.lit(6).cast("long"))).alias("key"), "node", F.lit(56).cast("long").alias("n"), F.col("node").alias("label"))
    both = lambda a, b: len(np.intersect1d(sets[a], sets[b]))
    near = {(a, b) for a in sets for b in sets if a < b and both(a, b) >= 0.8 * (112 - both(a, b))}
    for tile in (1024, 7):
        got = [tuple(sorted((r.a, r.b))) for r in minhash.open_pairs(members, info, 0.8, tile).collect()]
        assert near <= set(got) and len(got) == len(set(got)) and len(got) < 780


def test_low_similarity_and_repeated_ids(spark):
    a, b = "one two three four five six seven", "one two three four five " + " ".join(f"x{i}" for i in range(30))
    df = spark.createDataFrame([(1, a), (2, b), (3, "q w e r t y"), (3, a), (None, a)], "doc_id long, text string")
    got = sorted((r.doc_id, r.class_id) for r in minhash.near_duplicates(df, similarity=0.4, bands=200, rows=1).collect())
    least = min(i for i, _ in got)
    assert got == sorted([(1, least), (2, 2), (3, 3), (3, least), (least, least)])


def test_ann_finds_all_of_few(spark):
    rng = np.random.default_rng(2)
    for n in (1, 17, 20, 21):
        df = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(n)], "vec_id long, embedding array<double>")
        got = Counter(r.query_id for r in ann.search(df, lambda i: i % 20 == 0).collect())
        assert got == Counter({i: min(20, n - 1) for i in range(0, n, 20) if n > 1})


@given
def test_ann_query_recall(spark):
    found = {}
    for r in queries.op9_ann(spark, SMALL).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    rows = [r for r in table(spark, SMALL, "embeddings").collect() if r.embedding is not None]
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    hits = [len(found[ids[q]] & set(ids[[i for i in np.lexsort((ids, -(x @ x[q]))) if i != q][:20]].tolist())) for q in np.flatnonzero(ids % 20 == 0)]
    assert sum(hits) / (20 * len(hits)) >= 0.9


@given
def test_quality_query_on_held_out_rows(spark):
    labels = {r.doc_id: r.quality for r in table(spark, SMALL, "labels").collect()}
    out = [r for r in queries.op4_quality(spark, SMALL).collect() if r.held_out and labels.get(r.doc_id) is not None]
    assert len(out) > 20 and sum(r.predicted == labels[r.doc_id] for r in out) / len(out) >= 0.97


def test_bradley_terry_fit_is_the_minimum():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, len(q4.FEATURES)))
    true = rng.normal(size=len(q4.FEATURES))
    y = (rng.random(400) < 1 / (1 + np.exp(-x @ true))).astype(int)
    model = q4.fit_pairs(x, y, 1 - y.mean(), pairs_each=40)
    w, z = np.array(model.weights), (x - model.mean) / model.sd
    good, bad = z[y == 1], z[y == 0]
    diff = (good[:, None] - bad[None]).reshape(-1, z.shape[1])  # all pairs, by plain gradient steps
    v = np.zeros(len(w))
    for _ in range(3000):
        v -= 0.5 * (-diff.T @ (1 / (1 + np.exp(np.clip(diff @ v, -30, 30)))) / len(diff) + q4.RIDGE * v)
    assert np.corrcoef(w, v)[0, 1] > 0.98


@given
def test_registered_queries_run_whole_tables(spark):
    columns = {
        "op1_bpe": "doc_id n_tokens ids_sha256 decoded_sha256", "op2_lines": "doc_id n_lines kept_lines n_chars text_sha256", "op4_quality": "doc_id held_out score predicted", "op5_mixing": "doc_id size source_size target taken",
        "op6_html": "page_id url text n_chars", "op10_minhash": "doc_id class_id",
    }
    docs = [(r.doc_id, r.text) for r in table(spark, TINY, "documents").collect()]
    for name, want in columns.items():
        out = queries.queries()[name](spark, TINY)
        assert out.columns[: len(want.split())] == want.split()
        rows = out.collect()
        assert len(rows) == (table(spark, TINY, "pages").count() if name == "op6_html" else len(docs))
        if name == "op10_minhash":
            assert {r.doc_id: r.class_id for r in rows} == _classes_by_hand(docs)
        if name == "op5_mixing":
            assert {r.doc_id: r.size for r in rows} == {i: len(re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t in docs} and all(r.taken <= 2 * r.size for r in rows)
    assert queries.op3_token_counts(spark, TINY).count() == len(docs)


def _unmarked(page):
    return re.sub(r"<(/?)(?:article|nav|footer)\b", r"<\1div", page).replace(' class="ad"', "")


@given
def test_the_cut_gains_where_marks_are_missing(spark):
    """The pages' own marks are the truth; with the marks taken away, costs and cut must find it."""
    alone = cut = flips = n = 0
    for r in table(spark, SMALL, "pages").collect():
        truth = [x.plain > 0 for _, x, _ in html_extract.blocks(r.html)]
        found = html_extract.blocks(_unmarked(r.html))
        s = html_extract.scores(found)
        kept = html_extract.min_cut(s, html_extract.edges(found))
        n, alone, cut = n + len(s), alone + sum((x > 0) == t for x, t in zip(s, truth)), cut + sum(k == t for k, t in zip(kept, truth))
        flips += sum((x > 0) != k for x, k in zip(s, kept))
        kept = html_extract.main_text(r.html).split("\n")
        assert kept == [t for (t, _, _), own in zip(html_extract.blocks(r.html), truth) if own]
    assert flips >= 10 and alone < cut and cut / n >= 0.997


def test_html_faint_and_plain_marks():
    para = "<p>This is a sentence of the article that is long enough to be read as prose.</p>"
    page = f"""<body><article>{para}<p class="warning-signs">Watch for the signs of it.</p>{para}<ul class="related-work"><li>An older paper on the subject.</li><li>And one more of them.</li></ul>
    <div class="notice">You have read three of five free articles.</div>{para}<div class="related-posts"><a href=x>Another post</a></div><div class="comment-list"><div class="comment-body"><p>I liked this text a lot, and I thank you for writing it.</p></div></div></article>
    <div class="site-sidebar">{para}</div></body>"""
    got = html_extract.main_text(page)
    assert "signs of it" in got and "older paper" in got and got.count("long enough") == 3
    assert not any(x in got for x in ("free articles", "Another post", "thank you"))


def test_html_reading_is_linear():
    hostile = ["<b>" * 100_000 + "</i>" * 100_000, "<div>" * 120_000 + "x" + "</div>" * 120_000, '<a b="c>x ' * 60_000, "<p x='\"y>t</p>" * 50_000, "<ul>" + "<div>" * 3000 + "<li>a</li>" * 60_000, "<" * 600_000, "<!-- " * 120_000, "<div><p>word of it</p><a href=x>l</a></div>" * 20_000]
    for page in hostile:
        start = time.time()
        html_extract.main_text(page)
        assert time.time() - start < 20
    assert html_extract.main_text("<p>a\x1fb \x1c and some more words here.</p>") == "a\x1fb \x1c and some more words here."
