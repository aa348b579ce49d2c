"""Small, hostile inputs for the operators on texts, held against brute force."""

import hashlib
import random
from collections import Counter

import public_tokenizers as P
import pytest

from topicloom.llm import bpe, chat, html_extract, lines, minhash, mixing, quality, token_counts

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def enc():
    return bpe.encoder(bpe.read_ranks(RANKS), P.PATTERN)


TEXTS = ["", None, "a", "  ", "The cat's 3 hats.\n\n x", "é" * 50, "x" * 150_000, "ab12" * 40_000, " " * 20_000 + "end", "漢字" * 100, "\x00\x1f", "same", "same", "<|endoftext|>"]


def test_bpe_round_trip(spark, enc):
    rows = [(i, t, "extra") for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")  # a clashing column
    out = {r.doc_id: r for r in bpe.encode_decode(df, RANKS, P.PATTERN).collect()}
    assert len(out) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        assert bytes(out[i].decoded) == (t or "").encode()
        assert out[i].ids == enc.encode_ordinary(t or "")
    again = bpe.decode(bpe.encode(df, RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert {bytes(r.decoded) for r in again.collect()} == {(t or "").encode() for t in TEXTS}
    assert bpe.encode(df.limit(0), RANKS, P.PATTERN).count() == 0


def test_bpe_long_space_is_whole(enc):
    text = "word " + " " * 6000 + "next " * 3
    assert bpe.encode_text(text, enc, P.PATTERN) == enc.encode_ordinary(text)
    huge = "a" + " " * 3_000_000 + "b"  # more than the library's engine holds
    assert enc.decode_bytes(bpe.encode_text(huge, enc, P.PATTERN)) == huge.encode()


def test_token_counts_follow_edits(spark, enc):
    random.seed(5)
    count = lambda p: len(enc.encode_ordinary(p)) if p else 0
    for start in ["", "x" * 2000, "one two  three\n" * 100, "d'or 12a b's " * 80]:
        tree, s = token_counts.Tree(start, count), start
        for _ in range(40):
            a = random.randint(0, len(s))
            b = min(len(s), a + random.choice([0, 1, 5, 600]))
            new = "".join(random.choices(["", " ", "\n", "a", "'s", "12", "é", " the "], k=3))
            tree.edit(a, b, new)
            s = s[:a] + new + s[b:]
            assert tree.text() == s and tree.n_tokens == count(s)
    df = spark.createDataFrame([(1, None, None), (2, "abc", [(0, 1, "x"), (None, None, "!")]), (3, "abc", [(5, 2, None)])], "doc_id long, text string, edits array<struct<start: int, end: int, text: string>>")
    out = {r.doc_id: r for r in token_counts.count_after_edits(df, RANKS, P.PATTERN).collect()}
    assert out[1].n_tokens_edited == 0 and out[2].n_tokens_edited == count("xbc!") and out[3].n_chars_edited == 3


def test_token_trees_encode_little(enc):
    tree = token_counts.Tree("some words here. " * 5000, lambda p: len(enc.encode_ordinary(p)))
    before = tree.encoded
    tree.edit(40_000, 40_010, "other")
    assert tree.encoded - before < 3000


def _edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_band_is_edit_distance(spark):
    from pyspark.sql import functions as F

    random.seed(7)
    rows = []
    for _ in range(150):
        a = "".join(random.choices("abcé ", k=random.randint(8, 40)))
        b = list(a)
        for _ in range(random.randint(0, 4)):
            k = random.randrange(len(b))
            b[k : k + random.randint(0, 1)] = random.choices("abc", k=random.randint(0, 1))
        b = "".join(b)
        if abs(len(a) - len(b)) <= 2:
            rows.append((max(a, b, key=len), min(b, a, key=len)) if len(a) != len(b) else (a, b))
    got = spark.createDataFrame(rows, "p string, q string").select("p", "q", lines.within(F.col("p"), F.col("q"), 2).alias("near")).collect()
    assert all(r.near == (_edit_distance(r.p, r.q) <= 2) for r in got)


def _lines_by_hand(rows, threshold, least):
    first = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        for n, x in enumerate((t or "").split("\n")):
            if len(x) >= least:
                first.setdefault(x, (i, n))
    gone = {b for a in first for b in first if first[a] < first[b] and abs(len(a) - len(b)) <= threshold and _edit_distance(a, b) <= threshold}
    return {i: "\n".join(x for n, x in enumerate((t or "").split("\n")) if len(x) < least or (first[x] == (i, n) and x not in gone)) for i, t in rows}


def test_line_dedup_is_brute_force(spark):
    random.seed(11)
    base = ["".join(random.choices("abcdefg hi", k=random.randint(20, 60))) for _ in range(30)]
    vary = lambda x: "".join(c for c in x if random.random() > 0.03) + random.choice(["", "z", "yy"])
    rows = [(i, "\n".join(random.choice([lambda: random.choice(base), lambda: vary(random.choice(base)), lambda: "short", lambda: ""])() for _ in range(6))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, base[0] + "\n" + base[0]), (103, "ü" * 30), (104, "ü" * 29 + "v")]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, n_lines string")
    for hot in (4096, 1):  # with every shared key cut again, nothing may be lost
        got = {r.doc_id: r.text for r in lines.dedup_lines(df, hot_pairs=hot).collect()}
        assert got == _lines_by_hand(rows, 2, 20)
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_short_lines_are_deduplicated(spark):
    random.seed(29)
    word = lambda: "".join(random.choices("abcdefghijklmnop", k=random.choice([1, 2, 3, 4, 6, 9, 15])))
    base = [word() for _ in range(60)]
    rows = [(i, "\n".join(random.choice([random.choice(base), word(), "", " \t"]) for _ in range(8))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    first = {}
    for i, t in rows:
        for n, x in enumerate(t.split("\n")):
            first.setdefault(x, (i, n))
    gone = {b for a in first for b in first if 2 < min(len(a), len(b)) and first[a] < first[b] and a.strip() and b.strip() and _edit_distance(a, b) <= 2}
    want = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if not x.strip() or (first[x] == (i, n) and x not in gone)) for i, t in rows}
    for hot in (4096, 1):
        assert {r.doc_id: r.text for r in lines.dedup_lines(df, min_chars=1, hot_pairs=hot).collect()} == want


def test_near_links_are_all_links(spark):
    from pyspark.sql import functions as F

    random.seed(31)
    base = "".join(random.choices("abcdefgh", k=30))
    texts = sorted({base} | {base[:i] + random.choice("xyz") + base[i + random.randint(0, 1) :] for i in range(30) for _ in range(2)})
    df = spark.createDataFrame(list(enumerate(texts)), "id long, line string")
    want = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and _edit_distance(a, b) <= 2}
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    for hot in (4096, 1):
        assert {tuple(r) for r in lines.near_links(df, hot_pairs=hot).select(*pair).collect()} == want
    some = {tuple(r) for r in lines.near_links(df, hot_pairs=1, one_each=True).select(*pair).collect()}
    assert some <= want and {j for _, j in some} == {j for _, j in want}


def test_stage_drops_copies_with_short_lines(spark):
    import corpus_pipeline

    text = "Les.\n\nA line that is longer than twenty characters.\nAnd ornd."
    rows = [(1, text), (2, text), (3, ""), (4, None), (5, " \n"), (6, "Les.\n \nsome other words")]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars int")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert got.keys() == {1, 3, 4, 5, 6} and got[1] == (text, len(text)) and got[6][0] == " \nsome other words"


def _shingles(t):
    w = (t or "").lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def _classes_by_hand(rows):
    s, up = {i: _shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in s:
        for b in s:
            if a < b and (s[a] == s[b] or (s[a] and s[b] and sum((s[a] & s[b]).values()) / sum((s[a] | s[b]).values()) >= 0.8)):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in s}


def test_near_duplicates_are_brute_force(spark):
    random.seed(13)
    words = [f"w{i}" for i in range(300)]
    rows, n = [], 0
    for _ in range(12):
        base = random.choices(words, k=random.choice([3, 60, 200]))
        for _ in range(random.choice([1, 2, 12])):
            t = list(base)
            for _ in range(random.choice([0, 0, 1, 2, 4])):
                t[random.randrange(len(t))] = random.choice(words)
            rows.append((n, " ".join(t)))
            n += 1
    rows += [(900, None), (901, ""), (902, "  "), (903, "one " * 400), (904, "ONE " * 400), (905, "one " * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(df).collect()}
    assert got == _classes_by_hand(rows)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_buckets_whose_hub_fits_none_stay_open(spark):
    from pyspark.sql import functions as F

    # the small text is the first round's hub of the only bucket, and too small for the two others
    hub, *large = [r.id for r in spark.range(3).orderBy(F.xxhash64(F.lit(0), "id")).collect()]
    for seed in range(500):
        w = [f"s{seed}w{i}" for i in range(100)]
        words = {hub: w[:70], large[0]: w, large[1]: [*w, "more"]}
        keys = minhash.band_keys(minhash.signatures([minhash.shingle_hashes(x) for x in words.values()], 1), 1, 1)
        if len(set(keys.reshape(-1).tolist())) == 1:
            break
    else:
        raise AssertionError("no seed puts the three in one bucket")
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in words.items()], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(df, bands=1, rows=1).collect()}
    assert got == {hub: hub, large[0]: min(large), large[1]: min(large)}


def test_near_dedup_keeps_one_row_of_copies(spark):
    import corpus_pipeline

    rows = [(1, "a text of its own", "y"), *[(2, "one that is repeated", "x")] * 5, *[(None, "a text without id", s) for s in "zxyxx"], (None, "another without id", "x"), (None, None, "x"), (None, "", "y"), (3, "one that is repeated", "x"), (4, "a first text of this id", "x"), (4, "and quite another one", "x")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, source string, n_chars int")
    got = Counter((r.doc_id, r.text or "") for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert got == Counter([(1, rows[0][1]), (2, rows[1][1]), (None, "a text without id"), (None, "another without id"), (None, ""), (4, rows[-2][1]), (4, rows[-1][1])])


def test_registers_estimate_weighted_jaccard():
    import numpy as np

    rng = np.random.default_rng(3)
    a = np.sort(minhash.mix(rng.integers(0, 40, 300).astype(np.uint64)))
    b = np.sort(np.concatenate([a[:220], minhash.mix(rng.integers(40, 60, 80).astype(np.uint64))]))
    x, y = Counter(a.tolist()), Counter(b.tolist())
    true = sum((x & y).values()) / sum((x | y).values())
    sig = minhash.signatures([a, b], 4096)
    assert abs((sig[0] == sig[1]).mean() - true) < 4 * (true * (1 - true) / 4096) ** 0.5


def test_hypergeometric_tree_keeps_quotas(spark):
    q = spark.createDataFrame([("a", 100), ("b", 7), (None, 30), ("c", 0)], "source string, quota long")
    leaves = mixing.split_quotas(q, 8).toPandas()
    assert leaves.groupby("source", dropna=False)["quota"].sum().to_dict()["a"] == 100 and leaves["quota"].sum() == 137
    assert leaves.groupby("shard")["quota"].sum().between(17, 18).all() and (leaves["quota"] >= 0).all()


def test_mixing_meets_targets(spark):
    random.seed(17)
    rows = [(i, " ".join(["w"] * random.randint(0, 60)), random.choice(["x", "y", "z", None])) for i in range(400)] + [(1000, None, "x"), (1001, " ", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).toPandas()
    assert len(got) == len(rows)
    size = {s: sum(len((t or "").split(" ")) if t else 0 for _, t, z in rows if z == s) for s in ("x", "y", "z", None)}
    total, weight, capped = 1.5 * sum(size.values()), {"x": 5, "y": 2, "z": 1, None: 5}, set()
    while True:
        level = (total - sum(2 * size[s] for s in capped)) / sum(w for s, w in weight.items() if s not in capped)
        more = {s for s in size if s not in capped and level * weight[s] > 2 * size[s]}
        if not more:
            break
        capped |= more
    source = {r[0]: r[2] for r in rows}
    got["source"] = [source[i] for i in got["doc_id"]]
    for s in size:
        part = got[got["source"].isna()] if s is None else got[got["source"] == s]
        want = 2 * size[s] if s in capped else level * weight[s]
        assert abs(part["target"].iloc[0] - want) < 1e-6
        taken = (part["size"] * part["draws"].map(len)).sum()
        assert want - 60 <= taken <= want + 1e-6
    assert got["draws"].map(len).max() <= 2
    again = mixing.mix(df).toPandas().set_index("key")["draws"].map(str)
    assert (again.sort_index() == got.set_index("key")["draws"].map(str).sort_index()).all()
    assert mixing.drawn_rows(df, mixing.mix(df)).count() == got["draws"].map(len).sum()
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixing_fills_until_nothing_fits(spark):
    for seed, blocks in ((1, 4096), (2, 4096), (3, 7), (4, 1)):
        random.seed(seed)
        rows = [(i, " ".join(["w"] * random.choice([3, 20, 100])), random.choice(["x", "y", "z", None])) for i in range(300)]
        rows += [(900 + i, " ".join(["w"] * n), s) for i, (n, s) in enumerate([(20_000, "x"), (9_000, "y"), (700, "y"), (5_000, "z")])]
        got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), blocks=blocks).toPandas()
        source = {r[0]: r[2] for r in rows}
        got["source"], got["n"] = [str(source[i]) for i in got["doc_id"]], got["draws"].map(len)
        for _, part in got.groupby("source"):
            left = part["target"].iloc[0] - (part["size"] * part["n"]).sum()
            whole = int(part["target"].iloc[0] // part["source_size"].iloc[0])
            free = part[part["n"] == whole]["size"]
            assert part["n"].isin([whole, whole + 1]).all() and left >= -1e-6
            assert free.empty or left < free.min()


def test_quality_ranks_and_survives(spark):
    random.seed(19)
    good = lambda: " ".join(random.choices("the cat sat on a mat and then went home again".split(), k=40)).capitalize() + "."
    bad = lambda: " | ".join(random.choices("buy cheap now".split(), k=30)) + "!!!"
    rows = [(i, good() if i % 2 else bad(), "e") for i in range(200)] + [(500, None, "e"), (501, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(None, 1), (3, None)], "doc_id long, quality int")
    out = {r.doc_id: r.score for r in quality.score(docs, quality.train(docs, labels)).collect()}
    assert len(out) == 202 and all(0 <= s <= 1 for s in out.values())
    assert all((out[i] >= quality.KEEP) == bool(i % 2) for i in range(200))
    none = quality.score(docs, quality.train(docs, labels.limit(0))).collect()
    assert all(abs(r.score - quality.KEEP) < 1e-9 for r in none)


def test_chat_round_trip_and_layouts(spark):
    for text in ["", "a\\b", "</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\n", "\\<|im_end|>", "<<|im_end|>", "é\n\n"]:
        for role in ("user", "a\nb", "", ":n\\"):
            piece, a, b = chat.write_turn(role, text)
            assert chat.read_turn(piece) == (role, text) and chat.unescape(piece[a:b]) == text
            assert "<|im_end|>" not in piece[a:b]
    rows = [(1, 2, "assistant", "two"), (1, 1, "user", None), (2, None, None, "x"), (None, 1, "assistant", "</s>")] + [(3, 1, "assistant", "same")] * 2
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, start int")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(chat.canonical_rows(df))).collect()}
    assert got[1].turns_sha256 == hashlib.sha256(b"user\n\nassistant\ntwo\n").hexdigest() and got[1].loss_chars == 3
    assert got[3].n_turns == 2 and got[None].loss_sha256 == hashlib.sha256(b"</s>").hexdigest()
    records = ['{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": null}]}', '{"instruction": "do", "input": "x", "output": "y", "more": {"z": 1}}', '{"conversations": [{"from": "human", "value": "h"}]}', '{"odd": 1}', "broken", None, '{"prompt": "p", "response": "r"}']
    turns = chat.canonical_json(spark.createDataFrame(list(enumerate(records)), "conv_id long, record string")).collect()
    assert sorted((r.conv_id, r.turn, r.role, r.text) for r in turns) == [(0, 0, "user", "q"), (0, 1, "assistant", ""), (1, 0, "user", "do"), (1, 1, "user", "x"), (1, 2, "assistant", "y"), (2, 0, "user", "h"), (6, 0, "user", "p"), (6, 1, "assistant", "r")]
    nested = spark.createDataFrame([(1, [("human", "q"), ("gpt", "a")])], "conv_id long, conversations array<struct<`from`: string, value: string>>")
    assert [(r.role, r.text) for r in chat.canonical_rows(nested).orderBy("turn").collect()] == [("user", "q"), ("assistant", "a")]


def test_min_cut_is_minimal():
    import itertools

    random.seed(23)
    for _ in range(300):
        n = random.randint(1, 7)
        s = [random.randint(-5, 5) * 0.7 for _ in range(n)]
        e = [(a, b, random.randint(1, 6) * 0.5) for a in range(n) for b in range(a) if random.random() < 0.5]
        cost = lambda k: sum(-x for x, y in zip(s, k) if y and x < 0) + sum(x for x, y in zip(s, k) if not y and x > 0) + sum(c for a, b, c in e if k[a] != k[b])  # noqa: B023, E731
        assert abs(cost(html_extract.min_cut(s, e)) - min(map(cost, itertools.product([0, 1], repeat=n)))) < 1e-9


def test_html_main_text(spark):
    page = """<html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="has-sidebar"><header><a href="/">Site</a></header><nav><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></nav>
    <div class="cookie-notice">We use cookies.</div><article><header><h1>Fish &amp; chips</h1></header><p>First   para&shy;graph<br>goes <b>on</b>.<p>Second.</p><div class=ad>Buy now, it is cheap and good.</div><p>Third one &lt;here&gt;.</p>
    <section id="comments"><p>What a great article this was, thank you very much.</p></section></article><aside>More</aside><form><input> Search <button>Go</button></form><footer>&copy; 2020</footer>"""
    rows = [(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", "<p>unclosed <b>text is here for you to read"), (5, "u", "<script>never closed"), (6, "u", "<!-- open"), (7, "u", "plain < text & more words of it")]
    out = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string")).collect()}
    assert out[1].split("\n") == ["Fish & chips", "First para­graph goes on.", "Second.", "Third one <here>."]
    assert out[2] == out[3] == out[5] == out[6] == "" and out[4] == "unclosed text is here for you to read" and out[7] == "plain < text & more words of it"


def test_driver_gives_back_memory_between_tables(spark, monkeypatch):
    from topicloom.llm import common

    heap = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    used = lambda: heap.totalMemory() - heap.freeMemory()
    monkeypatch.setattr(common, "HEAP_SHARE", 0.0)
    held = [bytes(1 << 20) for _ in range(8)]
    for b in held:
        spark.sparkContext._jvm.java.lang.String(b)  # garbage
    before = used()
    common.discard(common.materialise(spark.range(10), "some"))
    assert used() < before
    monkeypatch.setattr(common, "HEAP_SHARE", 1.0)
    assert not common.release(spark)
