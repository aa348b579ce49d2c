"""Model-assisted labelling without a model: a labeller protocol, and the relational steps around it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import broad, normalise_label, parse_verdict
from ..session import ship_code

#: Takes and gives pandas frames: (key, value) -> (key, label).
Labeller = Callable[[Iterator], Iterator]


def rule_labeller(categories: list[str]) -> Labeller:
    """Offline default: a value's category by the sum of its letters."""

    def run(frames):
        for f in frames:
            yield f.assign(label=[categories[sum(map(ord, str(v))) % len(categories)] for v in f["value"]])[["key", "label"]]

    return run


def rule_label(value: str, categories: list[str]) -> Column:
    """The same rule as an expression: no Python worker."""
    letters = F.transform(F.filter(F.split(F.col(value), ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.element_at(F.array(*map(F.lit, categories)), (F.aggregate(letters, F.lit(0).cast("long"), lambda a, x: a + x) % len(categories) + 1).cast("int"))


def label(df: DataFrame, key: str, value: str, labeller: Labeller) -> DataFrame:
    """(key, label) from any labeller, in batches on the executors; a remote one crosses the network there."""
    ship_code(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(value).alias("value")).mapInPandas(labeller, f"key {kind}, label string").withColumnRenamed("key", key)


def retrying(labeller: Labeller, tries: int = 3, wait: float = 1.0) -> Labeller:
    """Each batch is asked up to ``tries`` times, after twice as long a wait each time; the last failure fails the task."""

    def run(frames):
        import time

        for f in frames:
            for turn in range(tries):
                try:
                    found = list(labeller(iter([f])))
                    break
                except Exception:
                    if turn + 1 == tries:
                        raise
                    time.sleep(wait * 2**turn)
            yield from found

    return run


def paced(labeller: Labeller, per_second: float) -> Labeller:
    """At most ``per_second`` batches a second in each task; a cluster's rate is that times its tasks."""

    def run(frames):
        import time

        last = None
        for f in frames:
            if last is not None:
                time.sleep(max(0.0, last + 1 / per_second - time.monotonic()))
            last = time.monotonic()
            yield from labeller(iter([f]))

    return run


def metered(spark, labeller: Labeller) -> tuple[Labeller, dict]:
    """The labeller, and accumulators of batches, values and estimated tokens (four characters each) that it was asked; a task run twice counts twice."""
    counts = {name: spark.sparkContext.accumulator(0) for name in ("batches", "values", "tokens")}

    def run(frames):
        for f in frames:
            counts["batches"].add(1)
            counts["values"].add(len(f))
            counts["tokens"].add(int(sum(-(-len(str(v)) // 4) for v in f["value"])))
            yield from labeller(iter([f]))

    return run, counts


def label_kept(df: DataFrame, key: str, value: str, labeller: Labeller, categories: list[str], path: str, *, merge: dict[str, str] | None = None, steps: int = 1) -> DataFrame:
    """(key, label) with every answer kept at ``path``: what has a label there is not asked again.

    Answers that fit no category are kept with a null label, and asked again by
    the next call. Open keys go in ``steps`` parts by hash, each written before
    the next begins, so a call that is broken off loses one part at most. Of
    rows that repeat a key the least value is asked. A null key is left out.
    """
    spark, kind = df.sparkSession, df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, answer string, label string"
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs)
    rows = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(value).alias(value))
    for step in range(steps):
        part = rows.where(F.pmod(F.xxhash64(key), F.lit(steps)) == step)
        if there:
            done = spark.read.schema(schema).parquet(path).where("label is not null").select(key)
            part = part.join(done, key, "left_anti")
        asked = label(part, key, value, labeller).withColumnRenamed("label", "answer")
        asked.withColumn("label", normalise_label(F.col("answer"), categories, merge)).write.mode("append").parquet(path)
        there = True
    kept = spark.read.schema(schema).parquet(path).where("label is not null").groupBy(key).agg(F.min("label").alias("label"))
    return kept.join(rows.select(key), key, "left_semi")


def dry_run(df: DataFrame, value: str, size: int = 200, usd_per_million: float = 1.0) -> DataFrame:
    """One row (n_values, n_batches, n_chars, est_tokens, est_usd): what labelling ``value`` would ask, at four characters a token."""
    one = df.agg(F.countDistinct(value).alias("n_values"), F.coalesce(F.sum(F.length(value)), F.lit(0)).alias("n_chars"))
    tokens = F.ceil(F.col("n_chars") / 4)
    return one.select("n_values", F.ceil(F.col("n_values") / size).alias("n_batches"), "n_chars", tokens.alias("est_tokens"), F.round(tokens * usd_per_million / 1e6, 6).alias("est_usd"))


def rule_judge(categories: list[str]) -> Labeller:
    """Offline judge of values ``<label>\\n<text>``: accepts the rule labeller's category, else names it."""

    def run(frames):
        for f in frames:
            out = []
            for v in f["value"]:
                claimed, _, text = str(v).partition("\n")
                own = categories[sum(map(ord, text)) % len(categories)]
                out.append("ACCEPT" if own == claimed else f"REJECT\nbetter: {own}")
            yield f.assign(label=out)[["key", "label"]]

    return run


def verify(labelled: DataFrame, key: str, text: str, judge: Labeller, categories: list[str], least_chars: int = 0) -> DataFrame:
    """(key, label, verdict, better) of (key, label, text): a judge sees label and text; texts under ``least_chars`` are left out."""
    rows = labelled.where(F.length(F.trim(text)) >= least_chars)
    asked = label(rows.withColumn("asked", F.concat_ws("\n", "label", text)), key, "asked", judge).withColumnRenamed("label", "answer")
    verdict, better = parse_verdict(F.col("answer"), categories)
    return rows.select(key, "label").join(asked.select(key, verdict.alias("verdict"), better.alias("better")), key)


def classify(texts: DataFrame, key: str, text: str, labeller: Labeller, categories: list[str], truth: DataFrame) -> DataFrame:
    """(key, a, b): the given label and the one of an independent labeller, null where its answer fits no category; goes into kappa and confusion."""
    own = label(texts, key, text, labeller).select(key, normalise_label(F.col("label"), categories).alias("b"))
    return truth.select(key, F.col("label").alias("a")).join(own, key)


def taxonomy(texts: DataFrame, key: str, text: str, propose: Callable[[list[str], list[str]], list[str]], *, batches: int = 5, size: int = 50, seed: int = 42) -> list[str]:
    """Category names from ``batches`` drawn batches of ``size`` texts: ``propose(names so far, texts)`` gives the next names; a collapse is passed over.

    The sample is the feature: at most ``batches * size`` texts reach the driver.
    """
    from .sampling import uniform

    rows, names = [r[0] for r in uniform(texts, key, batches * size, seed).select(text).collect()], []
    for at in range(0, len(rows), size):
        names = refine_taxonomy(names, propose(names, rows[at : at + size]))
    return names


def subdivided(labels: DataFrame, names: list[str], split: Callable[[str], list[str]], most: float = 0.2) -> list[str]:
    """``names`` with ``name: part`` in place of each that holds over ``most`` of the (item_id, label) rows."""
    n = F.sum("n").over(Window.partitionBy())  # one row a category
    large = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("label").isin(names)).withColumn("share", F.col("n") / n).where(F.col("share") > most)
    large = {r.label for r in large.select("label").collect()}
    return [x for name in names for x in ([f"{name}: {p}" for p in split(name)] if name in large else [name])]


def category_samples(concept_labels: DataFrame, most: int = 3) -> DataFrame:
    """(label, n, concepts): each category's size and its first ``most`` concepts by name, what a request to merge categories shows."""
    row = F.row_number().over(Window.partitionBy("label").orderBy("concept"))
    n = concept_labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    first = concept_labels.withColumn("row", row).where(F.col("row") <= most).groupBy("label").agg(F.array_sort(F.collect_list("concept")).alias("concepts"))
    return n.join(first, "label")


def merge_categories(concept_labels: DataFrame, target: int) -> DataFrame:
    """(concept, label): labels beyond the ``target`` most frequent become their broad part, or ``other``."""
    n = concept_labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    kept = n.orderBy(F.desc("n"), "label").limit(target).select(F.col("label").alias("kept"))
    x = concept_labels.withColumn("broad", broad(F.col("label")))
    x = x.join(kept, F.col("label") == F.col("kept"), "left").join(kept.withColumnRenamed("kept", "kept_broad"), F.col("broad") == F.col("kept_broad"), "left")
    return x.select("concept", F.coalesce("kept", "kept_broad", F.lit("other")).alias("label"))


def consolidate(labels: DataFrame, canonical: DataFrame, label_col: str = "label") -> DataFrame:
    """``labels`` with each label replaced by its canonical one in (label, canonical); a label that is not there stays. A repeated entry counts by its least name."""
    to = canonical.where("label is not null and canonical is not null").groupBy(F.col("label").alias("_from")).agg(F.min("canonical").alias("_to"))
    joined = labels.join(to, F.col(label_col) == F.col("_from"), "left")
    return joined.withColumn(label_col, F.coalesce("_to", label_col)).drop("_from", "_to")


def propagate_labels(weights: DataFrame, concept_labels: DataFrame) -> DataFrame:
    """(item_id, label): the category with most weight among an item's concepts; ties: the least concept's, then the least label."""
    votes = weights.join(concept_labels.where("label <> 'unknown'"), "concept").groupBy("item_id", "label").agg(F.round(F.sum("weight"), 6).alias("w"), F.min("concept").alias("c"))
    return votes.groupBy("item_id").agg(F.min_by("label", F.struct(-F.col("w"), "c", "label")).alias("label"))


def concept_frequency(weights: DataFrame, top: int = 50) -> DataFrame:
    return weights.groupBy("concept").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "concept").limit(top)


def match_taxonomy(answers: DataFrame, names: list[str]) -> DataFrame:
    """(item_id, label): exact, case-blind, then contained names; else the raw answer."""
    known, raw = F.array(*map(F.lit, names)), F.col("answer")
    pick = lambda f: F.get(F.filter(known, f), F.lit(0))
    found = F.coalesce(pick(lambda k: k == raw), pick(lambda k: F.lower(k) == F.lower(raw)), pick(lambda k: F.contains(F.lower(raw), F.lower(k))), raw)
    return answers.select("item_id", found.alias("label"))


def facets(items: DataFrame, facet_rows: DataFrame) -> DataFrame:
    """(item_id, text): a row's combined facets, or its prompt where none were extracted."""
    f = facet_rows.select("item_id", F.nullif(F.concat_ws(" ", "topic", "task", "domain"), F.lit("")).alias("combined"))
    return items.join(f, "item_id", "left").select("item_id", F.coalesce("combined", "prompt").alias("text"))


def facets_kept(items: DataFrame, extractor: Labeller, path: str, steps: int = 10) -> DataFrame:
    """(item_id, topic, task, domain) of (item_id, prompt): answers ``topic | task | domain`` of an extractor, each written to ``path`` and not asked again.

    Open items go in ``steps`` parts by hash, so a call that is broken off loses
    one part at most. An answer with fewer parts has nulls; an empty or null one
    is asked again by the next call. A null item is left out.
    """
    spark, kind = items.sparkSession, items.schema["item_id"].dataType.simpleString()
    schema = f"item_id {kind}, answer string"
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs)
    rows = items.where("item_id is not null").groupBy("item_id").agg(F.min("prompt").alias("prompt"))
    answered = lambda: spark.read.schema(schema).parquet(path).where("trim(answer) <> ''")
    for step in range(steps):
        part = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(steps)) == step)
        part = part.join(answered().select("item_id"), "item_id", "left_anti") if there else part
        label(part, "item_id", "prompt", extractor).withColumnRenamed("label", "answer").write.mode("append").parquet(path)
        there = True
    one = answered().groupBy("item_id").agg(F.min("answer").alias("answer")).join(rows.select("item_id"), "item_id", "left_semi")
    piece = lambda i: F.nullif(F.trim(F.get(F.split("answer", "[|]"), F.lit(i))), F.lit(""))
    return one.select("item_id", *[piece(i).alias(name) for i, name in enumerate(("topic", "task", "domain"))])


def refine_taxonomy(old: list[str], new: list[str]) -> list[str]:
    """The new taxonomy unless it collapsed to under half of the old one."""
    return new if len(new) >= 0.5 * len(old) else old


def cost(n_items: int, tokens_each: int, usd_per_million: float) -> float:
    return round(n_items * tokens_each * usd_per_million / 1e6, 4)
