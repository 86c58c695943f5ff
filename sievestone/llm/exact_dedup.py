"""Exact dedup by heavy-hitter split.

Every text becomes a SHA-256 digest of its form with A-Z lowered. A Misra-Gries summary
per task, merged by digest, finds the frequent digests; their winners are verified by
exact aggregates and broadcast (never more than `heavy` rows), so that members of a hot
group are judged where they lie. All other digests go through one ordinary shuffle.

Defined results: null text counts as empty; of equal texts the row with the largest id
stays, a null id being smaller than any; of rows with equal text and equal id exactly one
stays; an empty table gives an empty table; further columns are carried or ignored and
may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import FOLD, drop_rows, lean_batches, materialise, row_hash, text_bytes, texts

#: Bound of the broadcast winners and of each task's summary.
HEAVY = 256


def _digest(column: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(t.translate(FOLD)).digest() for t in texts(column)], pa.binary())


def text_digest(text_col: str) -> Column:
    """SHA-256 of the text with A-Z lowered, as binary."""
    return F.arrow_udf(_digest, "binary")(text_bytes(text_col))


def misra_gries(capacity: int):
    """Summarise each task's digests with `capacity` counters: (digest, count) lower bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[bytes, int] = {}
        for batch in batches:
            for x in batch.column(0).to_pylist():
                if x in counters:
                    counters[x] += 1
                elif len(counters) < capacity:
                    counters[x] = 1
                else:
                    counters = {k: c - 1 for k, c in counters.items() if c > 1}
        yield pa.record_batch([pa.array(list(counters), pa.binary()), pa.array(list(counters.values()), pa.int64())], ["digest", "seen"])

    return run


def judged(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", heavy: int = HEAVY) -> DataFrame:
    """One row per row of docs: id, at (hash of id and text), digest, keep_id, group_size, kept."""
    lean_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), row_hash(text_col, id_col).alias("at"), text_digest(text_col).alias("digest"))
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "digests")
    seen = rows.select("digest").mapInArrow(misra_gries(heavy), "digest binary, seen long")
    frequent = seen.groupBy("digest").agg(F.sum("seen").alias("seen")).orderBy(F.desc("seen"), "digest").limit(heavy)
    best = F.max(F.struct(F.col("id"), -F.col("row"))).alias("best")
    winners = rows.join(F.broadcast(frequent.select("digest")), "digest", "left_semi").groupBy("digest").agg(best, F.count("*").alias("group_size"))
    winners = materialise(winners, "winners")
    hot = rows.join(F.broadcast(winners), "digest")
    cold = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    # groups are summed map-side and joined, so that none of them ever sits in a task
    rest = cold.join(cold.groupBy("digest").agg(best, F.count("*").alias("group_size")), "digest")
    columns = ["digest", "id", "at", "row", "best", "group_size"]
    both = hot.select(columns).unionByName(rest.select(columns))
    return both.select("id", "at", "digest", F.col("best.id").alias("keep_id"), "group_size", (F.col("row") == -F.col("best.col2")).alias("kept"))


def deduplicate(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", heavy: int = HEAVY) -> DataFrame:
    """The rows of docs that stay, with all their columns.

    The rows to drop are written as (id, hash of id and text); only rows whose id may be
    among them are hashed again and shuffled. Repeated rows, alike in both, are cut to one.
    """
    verdict = judged(docs, text_col, id_col, heavy).groupBy("id", F.col("at").alias("mark")).agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    drop = materialise(verdict.where("not kept or n > 1"), "dropped")
    named = docs.columns
    hashed = lambda d: row_hash(d.columns[named.index(text_col)], d.columns[named.index(id_col)])
    return drop_rows(docs, drop.where("not kept").select("id", "mark"), id_col, hashed, drop.where("kept").select("id", "mark"))


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judged(docs).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP8_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM d
"""
