"""The corpus pipeline: stages applied to the documents table in order.

Each stage takes what its predecessor kept, whole, and returns documents' columns; the
last returns the packing. run() writes every stage's result to the shared folder and reads
it again, so a lost executor costs one stage's work at most.
"""

from __future__ import annotations

from sievestone.llm import bin_packing, exact_dedup, language_id, ngram_join, source_mixing
from sievestone.llm._common import materialise


def keep_identified(spark, docs, sf_dir):
    """Language ID: documents that it rejects go."""
    learned = language_id.learn(language_id.training_rows(docs))
    return language_id.accept(docs, learned)


def drop_copies(spark, docs, sf_dir):
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark, docs, sf_dir):
    """One document of each group that the n-gram join links stays."""
    return ngram_join.one_of_each(docs)


def mix_sources(spark, docs, sf_dir):
    return source_mixing.sample(docs)


def pack(spark, docs, sf_dir):
    return bin_packing.pack_documents(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", keep_identified),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack),
]

#: Compression and best-fit search have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
