"""Helpers that the corpus operators share: storage, words, shingles, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = b"abcdefghijklmnopqrstuvwxyz"
#: A-Z in UTF-8 are single bytes that occur nowhere else, so bytes can be lowered in place.
FOLD = bytes.maketrans(UPPER, LOWER)
SPACE = b" \t\n\x0b\x0c\r"

SHINGLE_WORDS = 5
_MULT = np.uint64(0x9E3779B97F4A7C15)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; only where none is named (tests), a local one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sievestone-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


#: Rows of a batch between the JVM and Python, where the session sets Spark's default or more: texts are long, and every worker and task holds some batches.
BATCH_ROWS = 2000


def lean_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends, lost executors cost nothing."""
    lean_batches(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialise() wrote and that no later result reads."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table._stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


#: Bits of the filter that drop_rows broadcasts, at most, and bits that a key sets.
FILTER_BITS, FILTER_HASHES = 1 << 27, 4


def _places(keys: np.ndarray, size: int) -> np.ndarray:
    """The bits, one row a key, that stand for 64-bit keys in a filter of so many bits."""
    steps = np.arange(1, FILTER_HASHES + 1, dtype=np.uint64) * _MULT
    return mix(keys[:, None] + steps[None, :]) & np.uint64(size - 1)


def key_filter(keys: DataFrame, n: int, most_bits: int = FILTER_BITS) -> np.ndarray:
    """Bloom filter, in 64-bit words, of the column `key` (long) of `n` rows; never more than `most_bits` bits."""
    size = min(most_bits, 1 << max(10, (12 * n - 1).bit_length()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_places(batch.column(0).to_numpy().view(np.uint64), size))
            word, first = np.unique(at >> np.uint64(6), return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else at
            yield pa.record_batch([pa.array(word.astype(np.int64)), long_array(bits)], ["word", "bits"])

    made = keys.select("key").mapInArrow(work, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size // 64, dtype=np.uint64)
    out[made["word"].to_numpy()] = made["bits"].to_numpy().view(np.uint64)
    return out


def may_hold(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """False only for keys that are not in the filter."""
    at = _places(keys, 64 * len(words))
    return ((words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1)


def possibly(df: DataFrame, keys: DataFrame, key: Column) -> tuple[DataFrame, DataFrame] | None:
    """(rows whose key may be among `keys` (key long), all others); None if keys is empty.

    The filter is broadcast; its size grows with the keys up to FILTER_BITS, beyond which
    it only lets more rows through.
    """
    n = keys.count()
    if not n:
        return None
    lean_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(key_filter(keys, n))

    def test(column: pa.Array) -> pa.Array:
        return pa.array(may_hold(sent.value, column.to_numpy(zero_copy_only=False).view(np.uint64)))

    may = F.arrow_udf(test, "boolean")(key)
    return df.where(may), df.where(~may)


def drop_rows(docs: DataFrame, gone: DataFrame, id_col: str, mark: Callable[[DataFrame], Column], again: DataFrame | None = None) -> DataFrame:
    """docs without the rows that gone (id, mark) names; of rows that again (id, mark) names, one of each.

    mark, a hash, makes a row one of its own with the id; it is made, and rows are shuffled,
    only where the id may be named.
    """
    again = gone.limit(0) if again is None else again
    named = gone.select(F.xxhash64("id").alias("key")).union(again.select(F.xxhash64("id")))
    own = {c: f"_own{i}" for i, c in enumerate(docs.columns)}
    d = docs.withColumnsRenamed(own)
    parts = possibly(d, named, F.xxhash64(own[id_col]))
    if parts is None:
        return docs
    some = parts[0].withColumn("_mark", mark(parts[0]))
    on = lambda other: some[own[id_col]].eqNullSafe(other["id"]) & (some["_mark"] == other["mark"])
    left = some.join(gone, on(gone), "left_anti")
    if again.limit(1).count():
        left = left.join(again, on(again), "left_anti").unionByName(left.join(again, on(again), "left_semi").dropDuplicates([own[id_col], "_mark"]))
    return parts[1].unionByName(left.drop("_mark")).select(*(F.col(v).alias(k) for k, v in own.items()))


def texts(column: pa.Array) -> list[bytes | None]:
    """The column's values as UTF-8 bytes."""
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def row_hash(text_col: str, id_col: str) -> Column:
    return F.xxhash64(F.col(id_col), text_bytes(text_col))


def text_bytes(name: str) -> Column:
    """A null text counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def map_rows(df: DataFrame, columns: list[Column], work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, rows: int = BATCH_ROWS) -> DataFrame:
    """mapInArrow over the given columns only, in batches of at most `rows` rows."""

    lean_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows):
            yield work(batch)

    return df.select(*columns).mapInArrow(run, schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces, so that what is made of each stays small; freed memory goes back at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
            pa.default_memory_pool().release_unused()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


def shingle_sequence(hashes: np.ndarray, width: int = SHINGLE_WORDS) -> np.ndarray:
    """A hash of every run of `width` words, in order; of the whole sequence if it is shorter."""
    n = len(hashes)
    if not n:
        return np.empty(0, dtype=np.uint64)
    width = min(width, n)
    acc = np.zeros(n - width + 1, dtype=np.uint64)
    for j in range(width):
        acc = acc * _MULT + hashes[j : j + len(acc)]
    return mix(acc + np.uint64(width))


def shingle_set(text: bytes | None, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of the text's words, A-Z lowered."""
    words = (text or b"").translate(FOLD).split()
    return np.unique(shingle_sequence(word_hashes(words), width))


def long_array(values: np.ndarray) -> pa.Array:
    """uint64 bit patterns as Spark's bigint."""
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def connected_components(links: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of links(a, b); component is the smallest node reachable.

    Alternating large-star and small-star rounds, each written to the shared folder. Every
    step is an aggregate with map-side combining and an equi-join, so that a hub's
    neighbours are never gathered in one task's memory.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialise(edges, name)
    before = None
    for _ in range(most_rounds):
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = edges.select(F.col("v").alias("x"), F.col("u").alias("y")).join(least, F.col("x") == F.col("u")).select(F.col("y").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        done, edges = edges, materialise(small, name)
        discard(done)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"{name}: not settled after {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
