"""The operators as registered queries: each applies one to its whole table and returns the contract's columns."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, html_extract, language_id, mixing, parity, periodic, quality_rules, simhash, token_store, toxic_crf, turn_repair, warc_zip, winnowing
from .common import table
from .oracles import ORACLES

#: A conversation whose texts are control strings, beside those of the table.
_TRICKY = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_html_consensus_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_quality_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judge(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op3_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc_zip.archive(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_crf.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_mix_fair_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_decontaminate_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnowing.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_chat_prefix_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    tricky = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(c).cast("long").alias("conv_id"), F.lit(t).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(x).alias("text")) for c, t, r, x in _TRICKY))))
    found = chat.read_back(chat.expand(talks.unionByName(tricky)))
    return found.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op9_language_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op10_token_zstd_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.tokenise(table(spark, sf_dir, "documents"), default_tokenizer())


def damaged(conversations: DataFrame) -> DataFrame:
    """The conversations with one in twenty rows each dropped, emptied, without end marks, repeated or in the wrong role.

    The CRC-32 of ``conv_id:turn`` decides; every null is one space.
    """
    filled = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")))
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = filled.withColumn("kind", F.crc32(key.cast("binary")) % 20).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def op11_turn_repair_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations")
    report, repaired = turn_repair.repair(damaged(talks))
    every = talks.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    same = lambda other: every["conv_id"].eqNullSafe(other["_conv"])
    report, shas = report.withColumnRenamed("conv_id", "_conv"), turn_repair.digests(repaired).withColumnRenamed("conv_id", "_conv")
    out = every.join(report, same(report), "left").drop("_conv").join(shas, same(shas), "left").drop("_conv")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select("conv_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def planted(doc_id: int, n: int) -> np.ndarray | None:
    """Which word stands at each place of a document: one in ten, by the CRC-32 of its id, repeats itself from a place on."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate((np.arange(a), a + np.arange(n - a) % p))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(table(spark, sf_dir, "documents"), rewrite=planted).withColumn("best", periodic.longest_run())
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_jaccard_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity.jaccard_components(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (
        op1_html_consensus_paths,
        op2_quality_weak_supervision,
        op3_simhash_tiles,
        op4_warc_zip,
        op5_toxicity_crf,
        op6_mix_fair_queue,
        op7_decontaminate_winnowing,
        op8_chat_prefix_target,
        op9_language_cross_parsing,
        op10_token_zstd_dictionary,
        op11_turn_repair_viterbi,
        op12_periodic_runs,
        op13_jaccard_parity_join,
    )
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
