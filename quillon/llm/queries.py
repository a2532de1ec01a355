"""Queries of the ten operators over their whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, latent, mil, neardup, pii, quality_rules, reply_trees, secrets, sharding, warc
from .common import load

QUERIES = {
    "op8_personal_identifiers": lambda spark, d: pii.identifiers(load(spark, d, "documents")),
    "op1_balanced_shards": lambda spark, d: sharding.shards(load(spark, d, "documents")),
    "op4_reply_trees": lambda spark, d: reply_trees.branches(reply_trees.replies(load(spark, d, "conversations"))),
    "op6_benchmark_leaks": lambda spark, d: latent.leaks(load(spark, d, "documents"), load(spark, d, "benchmark")),
    "op9_warc": lambda spark, d: warc.pages_through_warc(spark, load(spark, d, "pages")),
    "op10_attention_mil": lambda spark, d: mil.scored(load(spark, d, "documents"), load(spark, d, "labels")),
    "op5_bpe": lambda spark, d: bpe.encoded_and_decoded(load(spark, d, "documents")),
    "op7_secret_scan": lambda spark, d: secrets.find_secrets(load(spark, d, "documents")),
    "op3_quality_rules": lambda spark, d: quality_rules.judged(load(spark, d, "documents"), load(spark, d, "labels")),
    "op2_near_duplicates": lambda spark, d: neardup.near_duplicates(load(spark, d, "documents")),
}

ORACLE: dict[str, str] = {
    "op4_reply_trees": reply_trees.ORACLE,

    "op9_warc": warc.ORACLE,

    "op3_quality_rules": quality_rules.ORACLE,
}
