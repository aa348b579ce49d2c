"""The registered queries of this subpackage and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, html_extract, lines, minhash, mixing, mtree, quality, token_counts
from .common import env_path, table, text_or_empty

#: The rank file is a parameter; this is its default place.
RANKS = env_path("TOPICLOOM_RANKS", public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
PATTERN = public_tokenizers.PATTERN


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_decode(docs, RANKS, PATTERN).select("doc_id", "ids", "decoded")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=1)
    return out.select("doc_id", "n_lines", "kept_lines", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def edits():
    """Three edits a document, set by its id and length: an insertion, a deletion, a replacement."""
    n, i = F.length(text_or_empty()), F.coalesce(F.col("doc_id"), F.lit(0))
    at = lambda k: F.pmod(F.xxhash64(F.lit(k), i), n + 1).cast("int")
    edit = lambda a, b, t: F.struct(a.alias("start"), b.alias("end"), t.alias("text"))
    return F.array(edit(at(1), at(1), F.concat(F.lit("New words "), i.cast("string"), F.lit("! "))), edit(at(2), at(2) + 40, F.lit("")), edit(at(3), at(3) + 5, F.lit("e\u0301 x")))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_after_edits(docs.withColumn("edits", edits()), RANKS, PATTERN)


def _held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"), held_out=_held_out())
    scored = quality.score(docs, model)
    return scored.select("doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= quality.KEEP).cast("int").alias("predicted"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    each = mixed.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), F.transform("draws", lambda d: d.shard).alias("shards"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    return chat.read_back(chat.format_turns(chat.canonical_rows(rows.unionByName(more))))


def op8_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.search(table(spark, sf_dir, "embeddings"), 50, scale=256, k=5)


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0, k=20)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict:
    return {
        "op1_bpe": op1_bpe,
        "op2_lines": op2_lines,
        "op3_token_counts": op3_token_counts,
        "op4_quality": op4_quality,
        "op5_mixing": op5_mixing,
        "op6_html": op6_html,
        "op7_chat": op7_chat,
        "op8_mtree": op8_mtree,
        "op9_ann": op9_ann,
        "op10_minhash": op10_minhash,
    }


_OP8 = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as double)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""

#: A turn's piece: two marks of 12 and 10 characters, two line ends, and the escaped role and text.
_OP7 = """
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, len(text) + len(regexp_extract_all(text, '\\\\|<\\|im_start\\|>|<\\|im_end\\|>|<\\|endoftext\\|>|<\\|system\\|>|<\\|user\\|>|<\\|assistant\\|>|<s>|</s>|\\[INST\\]|\\[/INST\\]|<<SYS>>|<</SYS>>')) as written from t)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(len(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(24 + len(role) + written) as bigint) as formatted_chars
from e group by conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_chat": _OP7, "op8_mtree": _OP8}
