"""Queries of the training-data operators over their whole tables."""

from __future__ import annotations

from . import chat, decontam, dedup, licenses, mixing, quality, secrets, sharding, tokens, toxicity
from .common import table


def op1_quality_cascade(spark, sf_dir):
    return quality.digest(table(spark, sf_dir, "documents"))


def op2_kd_sharding(spark, sf_dir):
    return sharding.digest(table(spark, sf_dir, "documents"))


def op3_curriculum_mix(spark, sf_dir):
    return mixing.digest(table(spark, sf_dir, "documents"))


def op4_license_dice(spark, sf_dir):
    return licenses.digest(table(spark, sf_dir, "documents"))


def op5_compression_toxicity(spark, sf_dir):
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_transducer_tokens(spark, sf_dir):
    return tokens.digest(table(spark, sf_dir, "documents"))


def op7_forest_secrets(spark, sf_dir):
    return secrets.digest(table(spark, sf_dir, "documents"))


def op8_template_decontamination(spark, sf_dir):
    return decontam.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_prefix_target_chat(spark, sf_dir):
    return chat.digest(table(spark, sf_dir, "conversations"))


def op10_bottom_k_dedup(spark, sf_dir):
    return dedup.digest(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality_cascade, op2_kd_sharding, op3_curriculum_mix, op4_license_dice, op5_compression_toxicity, op6_transducer_tokens, op7_forest_secrets, op8_template_decontamination, op9_prefix_target_chat, op10_bottom_k_dedup)}
ORACLES = {
    "op1_quality_cascade": quality.ORACLE,
    "op3_curriculum_mix": mixing.ORACLE,
    "op9_prefix_target_chat": chat.ORACLE,
}
