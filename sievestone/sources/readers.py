"""Scans: wiki dumps, typed JSON lines, verified streams, sharded sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGE_SCHEMA = T.StructType([
    T.StructField("title", T.StringType()), T.StructField("ns", T.IntegerType()), T.StructField("id", T.LongType()),
    T.StructField("redirect", T.StructType([T.StructField("_title", T.StringType())])),
    T.StructField("revision", T.StructType([T.StructField("id", T.LongType()), T.StructField("timestamp", T.StringType()), T.StructField("sha1", T.StringType()), T.StructField("text", T.StringType())])),
])


def wiki_pages(spark: SparkSession, path: str, need_revision: bool = True) -> DataFrame:
    """Articles of MediaWiki XML dumps (.bz2 and .gz are unpacked): page_id, revision_id, title, raw, redirect_target, sha1, timestamp.

    Splittable only where the file is; many dump parts read in parallel. Text is often a
    struct in dumps (attributes): the value is taken either way by the explicit schema.
    """
    raw = spark.read.format("xml").option("rowTag", "page").schema(PAGE_SCHEMA).load(path)
    out = raw.where("ns = 0 AND id IS NOT NULL AND revision.text IS NOT NULL").select(
        F.col("id").alias("page_id"), F.col("revision.id").alias("revision_id"), "title", F.col("revision.text").alias("raw"), F.col("redirect._title").alias("redirect_target"), F.col("revision.sha1").alias("sha1"), F.col("revision.timestamp").alias("timestamp")
    )
    return out.where("revision_id IS NOT NULL") if need_revision else out


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType, required: dict[str, object] | None = None) -> DataFrame:
    """Typed JSON lines, compressed or not. A row whose named column has another value than required fails the read."""
    df = spark.read.schema(schema).json(path)
    for name, value in (required or {}).items():
        bad = F.raise_error(F.concat(F.lit(f"{name} must be {value}, not "), F.coalesce(F.col(name).cast("string"), F.lit("null"))))
        df = df.withColumn(name, F.when(F.col(name).eqNullSafe(F.lit(value)), F.col(name)).otherwise(bad))
    return df


def unique_by(df: DataFrame, key: str | list[str]) -> DataFrame:
    """df, or an error if a key occurs twice."""
    keys = [key] if isinstance(key, str) else key
    if twice := df.groupBy(*keys).count().where("count > 1").limit(1).collect():
        raise ValueError(f"key occurs {twice[0]['count']} times: {twice[0][: len(keys)]}")
    return df


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, sha256) of every file under a path, hashed on the executors."""
    f = spark.read.format("binaryFile").load(path)
    return f.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verified(spark: SparkSession, path: str, manifest: DataFrame, read) -> DataFrame:
    """read(path), but only if its files are those of manifest (name, bytes, sha256)."""
    have = file_digests(spark, path)
    wrong = have.join(manifest, ["name", "bytes", "sha256"], "full").join(manifest.join(have, ["name", "bytes", "sha256"]), ["name", "bytes", "sha256"], "left_anti")
    if first := wrong.limit(1).collect():
        raise ValueError(f"{first[0]['name']} is not as the manifest says")
    return read(path)


def sections(df: DataFrame, key: str, shards: int) -> DataFrame:
    """df with shard: the first byte of the key's SHA-256, modulo; write it with partitionBy("shard") to prune reads."""
    return df.withColumn("shard", (F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 2), 16, 10).cast("int") % shards))


def ordered_pages(df: DataFrame, id_col: str, only: DataFrame | None = None) -> DataFrame:
    """Rows by length of the id, then the id; only those of a set of ids where one is given."""
    if only is not None:
        df = df.join(only, id_col, "left_semi")
    return df.orderBy(F.length(F.col(id_col).cast("string")), id_col)
