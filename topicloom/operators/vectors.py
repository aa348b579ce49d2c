"""Sparse item vectors as long tables (item_id, dim, v), and their blends."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.words import DEFAULT, Lists
from ..session import small


def l2(rows: DataFrame) -> DataFrame:
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("item_id")))
    return rows.withColumn("v", F.col("v") / F.when(norm > 0, norm).otherwise(1.0))


def concept_vectors(weights: DataFrame, default: float = 0.1) -> DataFrame:
    return l2(weights.select("item_id", F.col("concept").alias("dim"), F.coalesce("weight", F.lit(default)).alias("v")))


def paired_vectors(pairs: DataFrame, weights: DataFrame, default: float = 0.1) -> DataFrame:
    """Unit vectors of all (item_id, concept) pairs; one that has no weight gets ``default``."""
    known = weights.select("item_id", "concept", "weight")
    return concept_vectors(pairs.select("item_id", "concept").join(known, ["item_id", "concept"], "left"), default)


def hashed(items: DataFrame, dims: int = 64, text_col: str = "prompt") -> DataFrame:
    """(item_id, v): unit vectors of hashed word counts, in place of a sentence encoder; a text without words is all zeros.

    A word adds 1 or -1, by its hash's ninth digit, to the dimension of its first eight.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(text_col, F.lit(""))), F.lit("[a-z]{2,}"), F.lit(0))
    spot = lambda h: F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % dims
    w = items.select("item_id", F.transform(words, F.md5).alias("h"))
    each = w.select("item_id", F.explode("h").alias("h")).groupBy("item_id", spot(F.col("h")).alias("d")).agg(F.sum(F.when(F.substring("h", 9, 1) < "8", 1.0).otherwise(-1.0)).alias("x"))
    held = each.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("d").cast("int").alias("d"), "x"))).alias("m"))
    v = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.coalesce(F.try_element_at("m", d), F.lit(0.0)))
    full = items.select("item_id").join(held, "item_id", "left").select("item_id", v.alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return full.withColumn("n", norm).select("item_id", F.transform("v", lambda x: x / F.when(F.col("n") > 0, F.col("n")).otherwise(1.0)).alias("v"))


def ngrams(items: DataFrame, text_col: str = "prompt", lists: Lists = DEFAULT, longest: int = 2) -> DataFrame:
    """(item_id, term, tf): word unigrams and bigrams without stop-words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text_col, F.lit(""))), F.lit("[a-z]{2,}"), F.lit(0))
    w = items.select("item_id", text_col).repartition("item_id")  # texts are dealt out, not their terms
    w = w.select("item_id", F.filter(words, lambda x: ~x.isin(*lists.stop)).alias("w"))
    two = F.transform(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), lambda x, i: F.concat(x, F.lit(" "), F.get("w", i + 1)))
    terms = F.concat("w", two) if longest == 2 else F.col("w")
    return w.select("item_id", F.explode(terms).alias("term")).groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def tfidf(items: DataFrame, n: int, *, max_features: int = 5000, min_df: int = 3, max_df: float = 0.08, text_col: str = "prompt") -> DataFrame:
    """Sublinear tf, smoothed idf, the most frequent terms within the document-frequency band, unit length."""
    tf = ngrams(items, text_col)
    stats = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).where((F.col("df") >= min_df) & (F.col("df") <= math.floor(n * max_df)))
    vocab = stats.orderBy(F.desc("total"), "term").limit(max_features)
    v = (1 + F.log(F.col("tf").cast("double"))) * (F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1)
    return l2(tf.join(small(vocab.select("term", "df"), max_features), "term").select("item_id", F.col("term").alias("dim"), v.alias("v")))


def bag_of_words(items: DataFrame, n: int, *, max_features: int = 20_000, min_df: int = 3, max_df: float = 0.1, text_col: str = "prompt") -> DataFrame:
    """(item_id, term, tf) over the most frequent unigrams."""
    tf = ngrams(items, text_col, longest=1)
    stats = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).where((F.col("df") >= min_df) & (F.col("df") <= math.floor(n * max_df)))
    return tf.join(small(stats.orderBy(F.desc("total"), "term").limit(max_features).select("term"), max_features), "term").select("item_id", "term", "tf")


def hybrid(concepts: DataFrame, texts: DataFrame, alpha: float = 0.8) -> DataFrame:
    """Unit vectors of alpha x concept beside (1 - alpha) x text dimensions."""
    side = lambda d, mark, a: d.select("item_id", F.concat(F.lit(mark), "dim").alias("dim"), (F.col("v") * a).alias("v"))
    return l2(side(concepts, "c:", alpha).unionByName(side(texts, "t:", 1 - alpha)))


def long_form(dense: DataFrame) -> DataFrame:
    """(item_id, dim, v) of dense (item_id, v array)."""
    return dense.select("item_id", F.posexplode("v").alias("d", "v")).select("item_id", F.col("d").cast("string").alias("dim"), "v")
