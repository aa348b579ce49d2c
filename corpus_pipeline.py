"""The corpus pipeline: quality, line dedup, near-duplicate removal, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``. All stages but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm import bpe, lines, minhash, mixing, quality
from topicloom.llm.common import fresh, identity, materialise, quoted, table
from topicloom.llm.queries import PATTERN, RANKS, _held_out

def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7 go; the model learns from ``labels`` as op4 does."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), held_out=_held_out())
    score = fresh("score", docs.columns)
    return quality.score(docs, model, score_col=score).where(F.col(score) >= quality.KEEP).select(*map(quoted, docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that came before go; a document of which only blank lines are left goes too, one that was blank stays. n_chars follows the text."""
    had = fresh("had", docs.columns)
    written = F.coalesce("text", F.lit("")).rlike("\\S")
    out = lines.dedup_lines(docs.withColumn(had, written), min_chars=1).where(~F.col(had) | written)
    return out.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(quoted(c)) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document of the least id stays, in one row; other texts of the same id are no copies."""
    keep = minhash.representatives(docs.select("doc_id", "text"))
    ident, key = fresh("ident", docs.columns), fresh("text_key", docs.columns)
    rows = docs.withColumn(ident, identity("doc_id", "text")).withColumn(key, F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = rows.join(keep, (F.col(ident) == keep["id"]) & (F.col(key) == keep["text_key"]), "left_semi")
    if not rows.groupBy(ident, key).count().where("count > 1").isEmpty():  # equal rows fall together
        rows = rows.groupBy(ident, key).agg(F.min(F.struct(*[F.col(quoted(c)) for c in docs.columns])).alias("row")).select("row.*")
    return rows.select(*[quoted(c) for c in docs.columns])


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix draws it, 0 to 2 times."""
    mixed = materialise(mixing.mix(docs.select("doc_id", "text", "source")), "mix")
    return mixing.drawn_rows(docs, mixed).select(*map(quoted, docs.columns))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row: doc_id, n_tokens, and digests of the ids and of the bytes that they decode to."""
    coded = bpe.encode_decode(docs.select("doc_id", "source", "text"), RANKS, PATTERN)
    return coded.select(
        "doc_id",
        "source",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources to target weights", mixing_to_targets),
    ("byte-level BPE encoding and decoding", tokens),
]

#: No SQL: the classifier's fit, verified near-duplicate classes and BPE have none. tests/llm/test_contracts.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
