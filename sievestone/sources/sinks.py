"""Sinks and integrity: manifests, digests, journals, deltas, bundles."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .readers import file_digests, unique_by


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write once: an existing table is an error, never replaced."""
    w = df.write.mode("errorifexists")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def canonical_json(df: DataFrame) -> DataFrame:
    """One column, json: each row with its columns sorted."""
    return df.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(df.columns))), {"ignoreNullFields": "false"}).alias("json"))


def write_json_lines(df: DataFrame, path: str) -> None:
    canonical_json(df).write.mode("errorifexists").option("compression", "gzip").text(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return file_digests(spark, path)


def content_digest(df: DataFrame) -> tuple[int, str]:
    """(rows, digest): equal for equal multisets of rows, whatever their order or partitioning."""
    h = F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(df.columns))), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(4)]
    row = df.agg(F.count("*").alias("n"), *parts).first()
    return row["n"], hashlib.sha256("|".join(str(row[f"s{i}"] or 0) for i in range(4)).encode()).hexdigest()


def same_content(a: DataFrame, b: DataFrame) -> bool:
    return sorted(a.columns) == sorted(b.columns) and content_digest(a) == content_digest(b.select(a.columns))


def delta(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change): added, removed or changed."""
    x, y = before.select(key, F.col(value).alias("_x")), after.select(key, F.col(value).alias("_y"))
    change = F.when(F.col("_x").isNull(), "added").when(F.col("_y").isNull(), "removed").otherwise("changed")
    return x.join(y, key, "full").where(~F.col("_x").eqNullSafe(F.col("_y"))).select(key, change.alias("change"))


def chain_entries(rows: list[dict], previous: str = "0" * 64, start: int = 1) -> list[dict]:
    """Journal entries of new rows, appended in the driver: sequence, previous_hash, entry_hash."""
    out = []
    for i, row in enumerate(rows, start):
        body = json.dumps({"sequence": i, "previous_hash": previous, "payload": row}, sort_keys=True, separators=(",", ":"))
        entry = hashlib.sha256(body.encode()).hexdigest()
        out.append({"sequence": i, "previous_hash": previous, "payload": json.dumps(row, sort_keys=True, separators=(",", ":")), "entry_hash": entry})
        previous = entry
    return out


def verify_chain(journal: DataFrame, journal_key: str | None = None) -> DataFrame:
    """Entries (sequence, previous_hash, payload, entry_hash) that break the chain: none, if it is whole.

    With many journals, journal_key tells them apart and spreads the work.
    """
    own = F.sha2(F.concat(F.lit('{"payload":'), "payload", F.lit(',"previous_hash":"'), "previous_hash", F.lit('","sequence":'), F.col("sequence").cast("string"), F.lit("}")), 256)
    w = Window.partitionBy(journal_key or F.lit(0)).orderBy("sequence")
    x = journal.withColumn("_before", F.lag("entry_hash", 1, "0" * 64).over(w)).withColumn("_place", F.row_number().over(w))
    return x.where((F.col("_before") != F.col("previous_hash")) | (F.col("_place") != F.col("sequence")) | (own != F.col("entry_hash"))).drop("_before", "_place")


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(F.struct(*(c for c in rows.columns if c != key)), order).alias("_r")).select(key, "_r.*")


def merge_bundles(bundles: list[DataFrame], key: str) -> DataFrame:
    """Union of bundles; a key in two of them is an error."""
    out = bundles[0]
    for b in bundles[1:]:
        out = out.unionByName(b)
    return unique_by(out, key)


def routed(df: DataFrame, routes: dict[str, str], key: list[str], path: str) -> None:
    """Write rows to sub-folders by the first condition that holds; a repeated key is an error, rows of no route go to quarantine."""
    unique_by(df, key)
    to = F.lit("quarantine")
    for name, condition in reversed(routes.items()):
        to = F.when(F.expr(condition), name).otherwise(to)
    df.withColumn("route", to).write.mode("errorifexists").partitionBy("route").parquet(path)
