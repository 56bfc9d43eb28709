"""The corpus pipeline: quality rules, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as
Parquet to the shared checkpoint folder and reads it back as the next stage's documents. All
stages but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from clausewise.llm import decontam, dedup, mixing, quality, sharding
from clausewise.llm.common import stored, table


def quality_rules(spark, docs, sf_dir):
    return quality.filter_documents(docs)


def near_dedup(spark, docs, sf_dir):
    return dedup.deduplicate(docs)


def decontaminate(spark, docs, sf_dir):
    return decontam.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark, docs, sf_dir):
    return mixing.mix(docs)


def shard(spark, docs, sf_dir):
    return sharding.shard_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("shard", shard),
]

#: Shingle groups and the tree's cuts have no SQL form here; tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if k == len(STAGES) - 1 else stored(out)
    return docs
