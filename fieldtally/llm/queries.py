"""The registered queries of this folder, with the parameters meant for production."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally.llm import (
    bitpack,
    bpe,
    jaccard,
    language,
    lines,
    negatives,
    oracle,
    packing,
    pii,
    prefix_trie,
    quality,
    shards,
    superminhash,
    vectors,
)
from fieldtally.llm.shared import folder, table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Bytes of text per shard.
SHARD_BYTES = 16 << 20
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"), keep=["doc_id"])

    def joined(spans: Column) -> Column:
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))

    def of(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    return found.select(
        "doc_id",
        *map(of, pii.BASE),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from labels outside the held-out third; host: source; path: language within it."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~_held_out())
    judged = quality.judge(docs, labels, F.col("source"), F.col("lang"), keep=["doc_id"])
    return judged.select(
        "doc_id",
        F.coalesce(_held_out(), F.lit(False)).alias("held_out"),
        "evidence",
        "host_rate",
        "path_rate",
        "p_quality",
        (F.col("p_quality") >= 0.5).alias("kept"),
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), VOCABULARY, end_id=1)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents")).drop("t", "stays")


def op5_binary_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "token-ids")
    bitpack.write(table(spark, sf_dir, "documents"), path, VOCABULARY, end_id=2)
    return bitpack.read(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # A document without id is in no fold and is learned from.
    model = language.fit(docs.where(~F.coalesce(_held_out(), F.lit(False))))
    held_out = F.coalesce(_held_out(), F.lit(False)).alias("held_out")
    found = language.identify(docs, model, keep=["doc_id"])
    return found.select("doc_id", held_out, "lang_pred", "score")


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = lines.verdicts(table(spark, sf_dir, "documents"))
    return judged.select(
        F.col("_id").alias("doc_id"), *lines.COUNTS, "base_failed", "kept", "n_removed_words"
    )


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), folder(spark, "shards-written")
    shards.write(docs, shards.assign(docs, limit=SHARD_BYTES), path)
    return shards.contents(spark, path, docs.schema)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(table(spark, sf_dir, "documents"), RANKS, keep=["doc_id"], decoded="back")
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("back", 256).alias("decoded_sha256"),
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label, vec_id = F.col("label"), F.col("vec_id")
    moved = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return negatives.mine(table(spark, sf_dir, "embeddings"), vec_id % 100 == 0, moved)


def op12_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_pii, op2_quality, op3_packing, op4_jaccard, op5_binary_ids, op6_language, op7_lines, op8_neighbours, op9_sharding,
        op10_byte_bpe, op11_hard_negatives, op12_superminhash, op13_prefix_trie,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
