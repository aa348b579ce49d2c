"""Line deduplication by a segment-partition edit join, in DataFrame operations only.

Lines within ``threshold`` edits (insert, delete, substitute a character) of
an earlier line go; the earlier one stays. Steps:

1. equal lines fall together; the first occurrence by (id, line number) stays.
2. each distinct line is cut into threshold + 1 segments. Of two lines within
   the threshold, one has a segment that stands unchanged in the other, at a
   place that the lengths and the edits left allow. So the shorter line's
   segments are indexed by (length, number, text), and a line probes, for its
   own length and the lengths below it, only those substrings.
3. lines that share a key are compared by a banded bit-parallel edit distance:
   one machine word holds the band's vertical differences, one step a
   character.

Pairs whose character counts already differ by more are left out before.
A key that many lines share is not expanded: its lines, without the shared
segment, are partitioned again, which keeps every pair within the threshold,
down to ``depth`` levels.

Defined results: blank lines (white space only) always stay, and so do lines of
fewer than ``min_chars`` characters; with ``min_chars=1`` no other line is
exempt. Lines no longer than the threshold, which any other such line is
within, go as exact repeats only. Null text counts as empty; rows of equal id are
one document; a null id is replaced by a negative hash of the text; documents
keep their other columns; a text whose lines all go becomes empty; an empty
table gives no rows. A removed line does not shield others: a line goes if any
earlier line is within the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import identity, materialise

THRESHOLD, MIN_CHARS = 2, 20
#: A key with more (indexed x probing) lines is partitioned again.
HOT_PAIRS, DEPTH = 4096, 3
#: Up to so many ids of lines to compare are broadcast; beyond, lines are shuffled to them.
MOST_IDS = 1_000_000


def _segment(length: Column, number: int, parts: int) -> tuple[Column, Column]:
    """Start (from 1) and length of a line's segment: the last ``length % parts`` segments are one longer."""
    base, longer = F.floor(length / parts).cast("int"), (length % parts).cast("int")
    before = F.lit((number - 1)) * base + F.greatest(F.lit(0), longer - (parts - number + 1))
    return before + 1, base + F.when(longer > parts - number, 1).otherwise(0)


def _probes(threshold: int) -> list[tuple[int, int, int]]:
    """(length difference, segment, shift): the substrings that a line probes; (0, segment, 0) are its own segments."""
    found = []
    for less in range(threshold + 1):
        for i in range(1, threshold + 2):
            lo, hi = max(-(i - 1), less - (threshold + 1 - i)), min(i - 1, less + (threshold + 1 - i))
            found += [(less, i, shift) for shift in range(lo, hi + 1)]
    return found


def keyed_rows(lines: DataFrame, threshold: int, *columns: str) -> DataFrame:
    """(id, group, line, size) -> (columns, key, probe): a row per substring that a line indexes or probes.

    ``probe`` is the place in ``_probes``. The places are exploded first and
    one small expression makes the key, so that it is compiled; an array of
    all keys is a method too large for the JVM to compile. Lines are read in
    UTF-32, where a substring is found without reading what stands before it.
    """
    parts = threshold + 1
    places = F.array(*[F.struct(F.lit(n).cast("tinyint").alias("probe"), F.lit(less).alias("less"), F.lit(i).alias("i"), F.lit(shift).alias("shift")) for n, (less, i, shift) in enumerate(_probes(threshold))])
    rows = lines.select(*columns, F.col("group").alias("_g"), F.encode("line", "UTF-32").alias("_w"), "size", F.explode(places).alias("_p"))
    rows = rows.withColumn("_l", F.col("size") - F.col("_p.less")).where("_l >= 0")
    rows = rows.withColumn("_base", F.expr(f"cast(_l div {parts} as int)")).withColumn("_longer", F.col("_l") % parts)
    i = F.col("_p.i")
    start = (i - 1) * F.col("_base") + F.greatest(F.lit(0), F.col("_longer") - (parts + 1 - i)) + 1 + F.col("_p.shift")
    rows = rows.withColumn("_start", start).withColumn("_n", F.col("_base") + (F.col("_longer") > parts - i).cast("int"))
    rows = rows.where("_start >= 1 and _start + _n - 1 <= size")
    key = F.xxhash64("_g", i, "_l", F.substring(F.col("_w"), F.col("_start") * 4 - 3, F.col("_n") * 4))
    return rows.select(*columns, key.alias("key"), F.col("_p.probe").alias("probe"))


def _without_segment(line: Column, probe: Column, threshold: int) -> Column:
    size, out = F.length(line), F.lit(None).cast("string")
    for n, (less, i, shift) in enumerate(_probes(threshold)):
        start, length = _segment(size - less, i, threshold + 1)
        rest = F.concat(F.substring(line, F.lit(1), start + shift - 1), F.substring(line, start + shift + length, size))
        out = F.when(probe == n, rest).otherwise(out)
    return out


def within(longer: Column, shorter: Column, threshold: int) -> Column:
    """Whether two lines are within ``threshold`` edits; ``longer`` is no shorter, longer than the threshold, by at most it.

    Hyyrö's band: bit b of the word at step i stands for character
    i - threshold + b of ``longer``; VP and VN hold where the next cell down
    is one more or one less.
    """
    top, ones = 2 * threshold, (1 << 2 * threshold + 1) - 1
    first = ((1 << threshold + 1) - 1) << threshold
    bits = lambda n: F.lit(n).cast("long")

    def compare(pair):
        a, b = pair.a, pair.b
        start = F.struct(bits(first).alias("vp"), bits(0).alias("vn"), F.lit(threshold).alias("d"), bits(1 << top - 1).alias("h"), F.lit(0).alias("i"))
        most = 2 * threshold + F.size(b) - F.size(a)

        def step(s, c):
            dead = (s.i < F.size(a) - threshold) & (s.d > most)
            match = bits(0)
            for n in range(top + 1):
                match = match + F.when(F.get(a, s.i + (n - threshold)) == c, bits(1 << n)).otherwise(bits(0))

            def second(x):  # x: the matches, then the diagonal differences
                hp = (s.vn.bitwiseOR(F.bitwise_not(x.d0.bitwiseOR(s.vp)))).bitwiseAND(bits(ones))
                hn = x.d0.bitwiseAND(s.vp)
                return F.struct(x.d0.alias("d0"), hp.alias("hp"), hn.alias("hn"))

            def third(x):
                diagonal = s.i < F.size(a) - threshold
                down = F.shiftright(x.d0, 1)
                moved = F.when(x.hp.bitwiseAND(s.h) != 0, 1).otherwise(0) - F.when(x.hn.bitwiseAND(s.h) != 0, 1).otherwise(0)
                return F.struct(
                    x.hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(x.hp))).bitwiseAND(bits(ones)).alias("vp"),
                    down.bitwiseAND(x.hp).alias("vn"),
                    (s.d + F.when(diagonal, F.when(x.d0.bitwiseAND(bits(1 << top)) == 0, 1).otherwise(0)).otherwise(moved)).alias("d"),
                    F.when(diagonal, s.h).otherwise(F.shiftright(s.h, 1)).alias("h"),
                    (s.i + 1).alias("i"),
                )

            d0 = F.transform(F.array(match), lambda m: F.struct((m.bitwiseAND(s.vp) + s.vp).bitwiseXOR(s.vp).bitwiseOR(m).bitwiseOR(s.vn).bitwiseAND(bits(ones)).alias("d0")))
            return F.when(dead, s).otherwise(F.transform(F.transform(d0, second), third)[0])

        return F.aggregate(b, start, step, lambda s: s.d)

    pair = F.array(F.struct(F.split(longer, "").alias("a"), F.split(shorter, "").alias("b")))
    return F.transform(pair, compare)[0] <= threshold


#: Character classes whose counts tell most pairs apart before any is compared.
CLASSES = ("[a-c]", "[d-f]", "[g-i]", "[j-m]", "[n-p]", "[q-s]", "[t-z]")


def _counts(line: Column, size: Column) -> list[Column]:
    own = [F.regexp_count(line, F.lit(c)) for c in CLASSES]
    return [F.array(*own, size - sum(own[1:], own[0])).alias("counts")]


def _may_be_near(a: str, b: str, threshold: int) -> Column:
    """An edit changes the length by one at most, and the class counts by two in all."""
    x, y = F.col(a), F.col(b)
    off = [F.abs(F.get(x, F.lit(i)) - F.get(y, F.lit(i))) for i in range(len(CLASSES) + 1)]
    return sum(off[1:], off[0]) <= 2 * threshold


def candidates(lines: DataFrame, threshold: int = THRESHOLD, hot_pairs: int = HOT_PAIRS, depth: int = DEPTH, one_each: bool = False) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """(id, line, size, at) with distinct lines -> distinct pairs (a, b) to compare, links (a, b) found already, and the lines that share a key.

    ``at`` orders the lines. With ``one_each``, where many lines share a key, the
    first of them is compared with all others at once; a line within the
    threshold of it has an earlier partner, so later levels look no further for
    partners of that line, but still offer it to others.
    """
    own = [n for n, p in enumerate(_probes(threshold)) if p[0] == 0 and p[2] == 0]
    level = lines.select("id", F.lit(0).cast("long").alias("group"), "line", "size")
    found = texts = stars = done = None
    for turn in range(depth):
        own_group = ["group"] if turn else []  # the same for all lines at first
        keyed = keyed_rows(level, threshold, "id", *own_group)
        keyed = keyed.repartition("key")  # one exchange, for the counts and for the rows
        counts = keyed.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.when(F.col("probe").isin(own), 1)).alias("indexed"), F.count(F.lit(1)).alias("probing"))
        busy = counts.where("lo <> hi and indexed > 0").select("key", (F.col("indexed") * F.col("probing") > (hot_pairs if turn < depth - 1 else 1 << 62)).alias("hot"))
        busy = materialise(keyed.join(busy, "key"), "line-keys")
        if texts is None:
            ids = materialise(busy.select("id").distinct(), "line-ids")
            few = ids.count() <= MOST_IDS
            texts = lines.join(F.broadcast(ids) if few else ids, "id", "left_semi")
            texts = materialise(texts.select("id", "at", "line", "size", *_counts(F.col("line"), F.col("size"))), "line-texts")
        cool = busy.where("not hot").join(texts.select("id", "at", "counts"), "id")
        cool = cool.withColumn("done", F.lit(False)) if done is None else cool.join(done.withColumn("done", F.lit(True)), "id", "left").fillna(False, ["done"])
        left = cool.where(F.col("probe").isin(own)).select("key", F.col("id").alias("x"), F.col("at").alias("ax"), F.col("done").alias("dx"), F.col("counts").alias("cx"))
        right = cool.select("key", F.col("id").alias("y"), F.col("at").alias("ay"), F.col("done").alias("dy"), F.col("counts").alias("cy"))
        open_ = ((F.col("ax") < F.col("ay")) & ~F.col("dy")) | ((F.col("ay") < F.col("ax")) & ~F.col("dx"))  # the later one still lacks a partner
        pairs = left.join(right, (left["key"] == right["key"]) & (F.col("x") != F.col("y")) & open_ & _may_be_near("cx", "cy", threshold)).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        found = pairs if found is None else found.unionByName(pairs)
        if turn == depth - 1:
            break
        hot = busy.where("hot").select("id", *own_group, "key", "probe")
        if hot.isEmpty():
            break
        if one_each:
            hubs = hot.join(texts.select("id", "at"), "id").groupBy("key").agg(F.min(F.struct("at", "id")).alias("h")).select("key", F.col("h.id").alias("a"))
            star = hot.select("key", F.col("id").alias("b")).join(hubs, "key").where("a <> b").select("a", "b").distinct()
            star = star if done is None else star.join(done.withColumnRenamed("id", "b"), "b", "left_anti").select("a", "b")
            star = materialise(compared(star, texts, threshold), "line-stars")
            stars = star if stars is None else stars.unionByName(star)
            done = materialise(stars.select(F.col("b").alias("id")).distinct(), "line-done")
        source = texts.withColumn("group", F.lit(0).cast("long")) if turn == 0 else level
        level = source.select("id", *own_group, "line").join(hot, ["id", *own_group]).select("id", F.col("key").alias("group"), _without_segment(F.col("line"), F.col("probe"), threshold).alias("line")).distinct()
        level = materialise(level.withColumn("size", F.length("line")), "line-rest")
    return found.distinct(), stars, texts


def compared(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose lines are within ``threshold`` edits."""
    side = lambda end, line, counts: texts.select(F.col("id").alias(end), F.col("line").alias(line), F.col("counts").alias(counts))
    both = pairs.join(side("a", "p", "cp"), "a").join(side("b", "q", "cq"), "b").where((F.abs(F.length("p") - F.length("q")) <= threshold) & _may_be_near("cp", "cq", threshold))
    swap = F.length("p") < F.length("q")
    longer, shorter = F.when(swap, F.col("q")).otherwise(F.col("p")), F.when(swap, F.col("p")).otherwise(F.col("q"))
    return both.where(within(longer, shorter, threshold)).select("a", "b")


def near_links(lines: DataFrame, threshold: int = THRESHOLD, hot_pairs: int = HOT_PAIRS, depth: int = DEPTH, one_each: bool = False) -> DataFrame:
    """(id, line) with distinct lines, longer than the threshold, and ``at`` to order them (else the id) -> all links (a, b) within ``threshold`` edits.

    With ``one_each`` links may be left out, but every line that has an earlier
    line within the threshold is linked with one.
    """
    lines = lines if "at" in lines.columns else lines.withColumn("at", F.col("id"))
    lines = lines.select("id", "line", "at", F.length("line").alias("size")) if "size" not in lines.columns else lines.select("id", "line", "at", "size")
    pairs, stars, texts = candidates(lines, threshold, hot_pairs, depth, one_each)
    links = compared(materialise(pairs, "line-pairs"), texts, threshold)
    return links if stars is None else links.unionByName(stars)


def exempt(line: Column, min_chars: int) -> Column:
    """Whether a line always stays: blank, or of fewer than ``min_chars`` characters."""
    return (F.length(line) < min_chars) | ~line.rlike("\\S")


def dedup_lines(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, hot_pairs: int = HOT_PAIRS, depth: int = DEPTH) -> DataFrame:
    """``df`` with repeated lines taken out of ``text_col``, and ``n_lines`` and ``kept_lines`` after its columns (replaced if there)."""
    names = df.columns
    own = df.toDF(*[f"c{i}" for i in range(len(names))])  # no column of ``df`` clashes with those made here
    id_at, text_at = (f"c{names.index(c)}" for c in (id_col, text_col))
    own = own.withColumn("own_id", identity(id_at, text_at))
    lines = own.select(F.col("own_id").alias("doc"), F.posexplode(F.split(F.coalesce(text_at, F.lit("")), "\n")).alias("n", "line"))
    lines = lines.where(~exempt(F.col("line"), min_chars))
    # equal lines: by 128 bits of hash; the text itself is the first's
    h = lines.select("doc", "n", F.xxhash64("line").alias("id"), F.xxhash64(F.lit(1), "line").alias("id2"), "line")
    first = h.groupBy("id", "id2").agg(F.min(F.struct("doc", "n")).alias("at"), F.first("line").alias("line"))
    first = materialise(first.select(F.xxhash64("id", "id2").alias("id"), F.col("at.doc").alias("doc"), F.col("at.n").alias("n"), "line", F.length("line").alias("size")), "line-distinct")
    longer = first.where(F.col("size") > threshold).withColumn("at", F.struct("doc", "n"))
    links = near_links(longer, threshold, hot_pairs, depth, one_each=True)
    at = first.select("id", F.struct("doc", "n").alias("at"))
    later = links.join(at.select(F.col("id").alias("a"), F.col("at").alias("at_a")), "a").join(at.select(F.col("id").alias("b"), F.col("at").alias("at_b")), "b")
    gone = later.select(F.when(F.col("at_a") < F.col("at_b"), F.col("b")).otherwise(F.col("a")).alias("id")).distinct()
    kept = first.select("id", "doc", "n").join(gone, "id", "left_anti").groupBy("doc").agg(F.array_sort(F.collect_list("n")).alias("ns"))
    flags = F.flatten(F.transform("ns", lambda n, i: F.concat(F.array_repeat(F.lit(False), n - F.coalesce(F.get("ns", i - 1), F.lit(-1)) - 1), F.array(F.lit(True)))))
    out = own.join(kept.select("doc", flags.alias("flags")), F.col("own_id") == F.col("doc"), "left")
    parts = F.split(F.coalesce(text_at, F.lit("")), "\n")
    stay = F.filter(parts, lambda x, i: exempt(x, min_chars) | F.coalesce(F.get("flags", i), F.lit(False)))
    out = out.withColumn("stay", stay)
    kept_columns = [(f"c{i}", c) for i, c in enumerate(names) if c not in ("n_lines", "kept_lines")]
    text = F.array_join("stay", "\n")
    return out.select(*[(text if at == text_at else F.col(at)).alias(c) for at, c in kept_columns], F.size(parts).cast("long").alias("n_lines"), F.size("stay").cast("long").alias("kept_lines"))
