"""Sources: conversations, feature files, ground truth, vectors, chat exports, checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FEATURES = T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("conv_id", T.StringType()), T.StructField("prompt", T.StringType()),
    T.StructField("features", T.StructType([
        T.StructField("concepts_prompt", T.ArrayType(T.StringType())), T.StructField("concepts_response", T.ArrayType(T.StringType())),
        T.StructField("concepts_all", T.ArrayType(T.StringType())), T.StructField("concept_weights", T.MapType(T.StringType(), T.DoubleType())),
    ])),
])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(conversations: DataFrame) -> DataFrame:
    """(item_id, conv_id, turn, prompt, response): one row per user turn; the response is the next turn if an assistant's."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = conversations.select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("next_text"))
    return rows.where("role = 'user'").select((F.col("conv_id") * 100_000 + F.col("turn")).alias("item_id"), "conv_id", "turn", F.col("text").alias("prompt"), F.when(F.col("next_role") == "assistant", F.col("next_text")).alias("response"))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of items; an empty or missing prompt falls back to the joined concepts."""
    rows = spark.read.schema(FEATURES).option("multiLine", True).json(path)
    return rows.withColumn("prompt", usable_prompt("prompt", "features.concepts_all"))


def usable_prompt(prompt: str, concepts: str) -> Column:
    return F.coalesce(F.nullif(F.col(prompt), F.lit("")), F.array_join(F.coalesce(F.col(concepts), F.array()), " "))


def feature_concepts(rows: DataFrame) -> DataFrame:
    """(item_id, concept, in_prompt) of feature rows; without a prompt split all concepts count as the prompt's."""
    f = "features."
    split = F.col(f + "concepts_prompt").isNotNull()
    prompt = F.when(split, F.col(f + "concepts_prompt")).otherwise(F.col(f + "concepts_all"))
    side = lambda c, flag: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.struct(x.alias("concept"), F.lit(flag).alias("in_prompt")))
    each = rows.select("item_id", F.explode(F.concat(side(prompt, 1), side(F.when(split, F.col(f + "concepts_response")), 0))).alias("c"))
    return each.groupBy("item_id", F.col("c.concept").alias("concept")).agg(F.max("c.in_prompt").alias("in_prompt"))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def contract_report(prompts: DataFrame, labels: DataFrame, id_col: str = "item_id") -> DataFrame:
    """One row: rows, rows without a prompt, labelled rows, distinct labels, rows without a label."""
    n = prompts.agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.coalesce(F.trim("prompt"), F.lit("")) == "", 1)).alias("n_no_prompt"))
    g = labels.agg(F.count(F.lit(1)).alias("n_labels"), F.countDistinct("label").alias("n_categories"))
    m = prompts.join(labels, id_col, "left_anti").agg(F.count(F.lit(1)).alias("n_unlabelled"))
    one = lambda d: d.withColumn("_k", F.lit(1))
    return one(n).join(one(g), "_k").join(one(m), "_k").drop("_k")


def parse_ground_truth(files: DataFrame, raw_col: str = "value") -> DataFrame:
    """(item_id, label) of JSON documents in any of three layouts: prompt_labels, items or data rows, a flat map of digit keys."""
    row = "array<struct<query_idx:string,idx:string,category:string,label:string>>"
    doc = F.from_json(raw_col, f"prompt_labels map<string,string>, items {row}, data {row}")
    flat = F.map_filter(F.from_json(raw_col, "map<string,string>"), lambda k, v: k.rlike("^[0-9]+$"))
    d = files.select(doc.alias("d"), flat.alias("flat"))
    listed = F.coalesce("d.items", "d.data")
    pair = lambda k, v: F.struct(k.alias("k"), v.alias("v"))
    of_map = lambda m: F.transform(F.map_entries(m), lambda e: pair(e.key, e.value))
    pairs = F.when(F.col("d.prompt_labels").isNotNull(), of_map(F.col("d.prompt_labels"))).when(listed.isNotNull(), F.transform(listed, lambda x: pair(F.coalesce(x.query_idx, x.idx), F.coalesce(x.category, x.label)))).otherwise(of_map(F.col("flat")))
    each = d.select(F.explode(pairs).alias("p"))
    return each.select(F.expr("try_cast(p.k as bigint)").alias("item_id"), F.col("p.v").alias("label")).where("item_id is not null")


def read_ground_truth(spark: SparkSession, folder: str, granularity: str) -> DataFrame:
    """The first file by name that holds ``gt_<granularity>_`` and ends in .json, label files left out."""
    names = spark.read.format("binaryFile").option("pathGlobFilter", f"*gt_{granularity}_*.json").load(folder).select("path")
    first = names.where(~F.col("path").contains("_prompt_labels")).agg(F.min("path")).first()[0]  # one name
    if first is None:
        raise FileNotFoundError(f"no gt_{granularity}_*.json in {folder}")
    return parse_ground_truth(spark.read.text(first, wholetext=True))


def vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(item_id, v): dense vectors in double precision."""
    return df.select(F.col(id_col).alias("item_id"), F.col(vec_col).cast("array<double>").alias("v"))


def aligned(dense: DataFrame, items: DataFrame) -> DataFrame:
    """The vectors, after a check that each of ``items`` has exactly one and no other item has any."""
    n = dense.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")).join(items.select("item_id").distinct().withColumn("known", F.lit(1)), "item_id", "full")
    bad = n.where("n is null or known is null or n > 1").agg(F.count(F.lit(1))).first()[0]
    if bad:
        raise ValueError(f"{bad} items without exactly one vector, or vectors without an item")
    return dense


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Cluster profiles that ``sinks.write_json`` wrote."""
    return spark.read.json(path)


def chat_export(df: DataFrame, limit: int = 500) -> DataFrame:
    """(id, prompt) of exported chats: the prompt, else the first human turn, at most ``limit`` characters."""
    has = set(df.columns)
    ids = [F.col(c).cast("string") for c in ("id", "conversation_id") if c in has] or [F.monotonically_increasing_id().cast("string")]
    texts = [F.nullif(F.col("prompt"), F.lit(""))] if "prompt" in has else []
    for c in ("conversations", "conversation"):
        if c in has:
            names = {f.name for f in df.schema[c].dataType.elementType.fields}
            texts.append(F.get(F.transform(F.filter(F.col(c), _human(names)), _content(names)), F.lit(0)))
    return df.select(F.coalesce(*ids).alias("id"), F.substring(F.coalesce(*texts, F.lit("")), 1, limit).alias("prompt"))


def _human(names):
    fields = [n for n in ("from", "role") if n in names]
    return (lambda x: F.coalesce(*[x[n] for n in fields], F.lit("human")).isin("human", "user")) if fields else (lambda x: F.lit(True))


def _content(names):
    fields = [n for n in ("value", "content") if n in names]
    return lambda x: F.coalesce(*[x[n] for n in fields])


def judged_labels(validation: DataFrame) -> DataFrame:
    """(item_id, label) of a validation report's rows that carry both a judge's label and an index."""
    return validation.select(F.explode("raw_classify").alias("r")).where("r.judge is not null and r.idx is not null").select(F.col("r.idx").alias("item_id"), F.col("r.judge").alias("label"))


def batch_key(values: Column) -> Column:
    """A batch's cache key: the hash of its sorted values."""
    return F.md5(F.to_json(F.array_sort(values)))


def not_cached(batches: DataFrame, cache: DataFrame, max_unknown: float = 0.5) -> DataFrame:
    """Batches whose key is not in the cache, or whose cached answers are mostly unknown."""
    good = cache.groupBy("key").agg(F.avg((F.col("label") == "unknown").cast("double")).alias("u")).where(F.col("u") <= max_unknown)
    return batches.join(good, "key", "left_anti")


def method_results(spark: SparkSession, glob: str) -> DataFrame:
    """(method, bal) of result files whose score sits at different places."""
    schema = "method string, bal double, finetuned struct<bal:double>, clio_best struct<bal:double>"
    return spark.read.schema(schema).option("multiLine", True).json(glob).select("method", F.coalesce("finetuned.bal", "bal", "clio_best.bal").alias("bal"))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)
