"""Concept frequencies, inverse document frequencies, weights; relaxed and strict rescoring."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import LATIN, drop_reason, drop_reason_strict, prompt_words, word_concepts
from ..functions.words import DEFAULT, Lists
from ..session import cut, forget, parts, small


def item_concepts(items: DataFrame, pattern: str = LATIN, n: int = 0) -> DataFrame:
    """(item_id, concept, in_prompt): the words of prompt and response; in_prompt is 1 if the prompt has it."""
    side = lambda c, flag: F.transform(word_concepts(F.col(c), pattern), lambda x: F.struct(x.alias("concept"), F.lit(flag).alias("in_prompt")))
    each = items.select("item_id", "prompt", "response").repartition(parts(items.sparkSession, n, 2000), "item_id")  # texts are dealt out, not their words
    each = each.select("item_id", F.explode(F.concat(side("prompt", 1), side("response", 0))).alias("c"))
    return each.groupBy("item_id", F.col("c.concept").alias("concept")).agg(F.max("c.in_prompt").alias("in_prompt"))


def filtered(ic: DataFrame, lists: Lists = DEFAULT, strict: bool = False) -> DataFrame:
    reason = (drop_reason_strict if strict else drop_reason)(F.col("concept"), F.col("in_prompt") == 1, lists)
    return ic.where(reason.isNull())


def df_idf(ic: DataFrame, n: int, plus: int = 0) -> DataFrame:
    """(concept, df, idf): idf = ln(n / (df + plus)); the ablation takes 1."""
    return with_idf(ic.groupBy("concept").agg(F.count(F.lit(1)).alias("df")), n, plus)


def with_idf(counts: DataFrame, n: int, plus: int = 0) -> DataFrame:
    return counts.withColumn("idf", F.log(F.lit(float(n)) / (F.col("df") + plus)))


def surviving(idf: DataFrame, n: int, min_df: int = 3, max_df_pct: float = 0.08, min_idf: float = 0.5) -> DataFrame:
    return idf.where((F.col("df") >= min_df) & (F.col("df") <= math.floor(n * max_df_pct)) & (F.col("idf") >= min_idf))


def top_weights(scored: DataFrame, k: int) -> DataFrame:
    """The k best concepts of each item by (score, concept), their scores brought to sum 1 and rounded."""
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), "concept")
    kept = scored.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k)
    return kept.withColumn("weight", F.round(F.col("score") / F.sum("score").over(Window.partitionBy("item_id")), 6)).drop("_r", "score")


def concept_weights(items: DataFrame, n: int, *, max_df_pct: float = 0.08, min_df: int = 3, min_idf: float = 0.5, max_concepts: int = 30, prompt_boost: float = 3.0, lists: Lists = DEFAULT) -> DataFrame:
    """(item_id, concept, in_prompt, weight): relaxed filter, document-frequency band, boosted idf, top k, normalised."""
    ic = item_concepts(items, n=n)
    seen = cut(ic.groupBy("concept", "in_prompt").agg(F.count(F.lit(1)).alias("df")), "concepts")  # written, so that the filter isn't pushed down to every item's rows
    every, seen = seen, cut(filtered(seen, lists), "concepts")
    forget(every)
    idf = surviving(with_idf(seen.groupBy("concept").agg(F.sum("df").alias("df")), n), n, min_df, max_df_pct, min_idf)
    kept = cut(seen.join(idf.select("concept", "idf"), "concept").select("concept", "in_prompt", "idf"), "concepts")
    forget(seen)
    scored = ic.join(small(kept, kept.count()), ["concept", "in_prompt"]).withColumn("score", F.col("idf") * F.when(F.col("in_prompt") == 1, prompt_boost).otherwise(1.0))
    return top_weights(scored.select("item_id", "concept", "in_prompt", "score"), max_concepts)


def ppmi(items: DataFrame, ic: DataFrame, n: int, lists: Lists = DEFAULT, min_joint: int = 2) -> DataFrame:
    """(word, concept, joint, ppmi): positive pointwise mutual information (log2) of prompt words and response concepts. Words and concepts too rare for ``min_joint`` meet no other."""
    words = items.select("item_id", F.explode(prompt_words(F.col("prompt"), lists)).alias("word"))
    concepts = ic.where("in_prompt = 0").select("item_id", "concept")
    cw = words.groupBy("word").agg(F.count(F.lit(1)).alias("cw"))
    cc = concepts.groupBy("concept").agg(F.count(F.lit(1)).alias("cc"))
    if min_joint > 1:
        words = words.join(cw.where(F.col("cw") >= min_joint), "word", "left_semi")
        concepts = concepts.join(cc.where(F.col("cc") >= min_joint), "concept", "left_semi")
    joint = words.join(concepts, "item_id").groupBy("word", "concept").agg(F.count(F.lit(1)).alias("joint")).where(F.col("joint") >= min_joint)
    value = F.log2(F.col("joint") * F.lit(float(n)) / (F.col("cw") * F.col("cc")))
    return joint.join(cw, "word").join(cc, "concept").withColumn("ppmi", value).where("ppmi > 0").select("word", "concept", "joint", "ppmi")


def concept_weights_strict(items: DataFrame, n: int, *, max_df_pct: float = 0.03, min_df: int = 5, min_idf: float = 1.5, max_concepts: int = 15, prompt_boost: float = 3.0, min_pmi: float = 0.0, min_joint: int = 1, lists: Lists = DEFAULT) -> DataFrame:
    """Prompt-anchored rescoring: response concepts stay only if a prompt word explains them (PPMI) or shares a word."""
    ic = filtered(item_concepts(items), lists, strict=True)
    idf = surviving(df_idf(ic, n), n, min_df, max_df_pct, min_idf)
    kept = ic.join(idf.select("concept", "idf"), "concept")
    pm = ppmi(items, kept, n, lists, min_joint)  # all rows of a concept or none are kept, so counts are those over ``ic``
    words = items.select("item_id", F.explode(prompt_words(F.col("prompt"), lists)).alias("word"))
    pairs = words.join(kept.where("in_prompt = 0").select("item_id", "concept"), "item_id")
    best = pairs.join(pm.select("word", "concept", "ppmi"), ["word", "concept"]).groupBy("item_id", "concept").agg(F.max("ppmi").alias("pmi"))
    bag = items.select("item_id", prompt_words(F.col("prompt"), lists).alias("bag"))
    rows = kept.join(best, ["item_id", "concept"], "left").join(bag, "item_id")
    overlap = F.arrays_overlap(F.split("concept", " "), F.col("bag"))
    pmi = F.coalesce("pmi", F.lit(0.0))
    response = F.when(overlap, F.greatest(pmi, F.lit(0.5)) * F.col("idf") * 2).when(pmi > min_pmi, pmi * F.col("idf"))
    scored = rows.withColumn("score", F.when(F.col("in_prompt") == 1, F.col("idf") * prompt_boost).otherwise(response)).where("score is not null")
    return top_weights(scored.select("item_id", "concept", "in_prompt", "score"), max_concepts)


def drop_reason_counts(ic: DataFrame, lists: Lists = DEFAULT) -> DataFrame:
    reason = drop_reason(F.col("concept"), F.col("in_prompt") == 1, lists)
    return ic.groupBy(F.coalesce(reason, F.lit("kept")).alias("drop_reason")).agg(F.count(F.lit(1)).alias("n"))
