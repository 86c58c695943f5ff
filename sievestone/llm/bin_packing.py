"""Conflict-constrained best-fit packing of documents into token bins.

Documents are dealt by row over shards of about `shard_docs` rows (no key decides, so no
source or cluster can crowd a shard), and every shard is packed by itself, largest piece
first. Open bins stand in order of residual room; each carries bitmaps of its sources (one
per allowed repeat) and of its duplicate clusters, indexed by the shard's own numbering.
The successor search starts at the tightest bin that has room and goes on, without a
limit, until a bin has neither the cluster nor too many documents of the source; else a
bin is opened. Full bins leave the order. Texts longer than a bin are cut into whole bins
and a rest; all tokens are packed.

Defined results: null or empty text has no tokens and is listed with no bin; a null source
is a source of its own; rows of one id are packed each by itself; ties go by tokens, then
row; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import FOLD, map_rows, materialise, text_bytes, texts

CAPACITY, SHARD_DOCS, PER_SOURCE = 2048, 8192, 3


def _sizes(batch: pa.RecordBatch) -> pa.RecordBatch:
    tokens, cluster = [], []
    for text in texts(batch.column(2)):
        words = text.split()
        tokens.append(len(words))
        cluster.append(int.from_bytes(hashlib.blake2b(b" ".join(words).translate(FOLD), digest_size=8).digest(), "big", signed=True))
    return pa.record_batch([batch.column(0), batch.column(1), pa.array(tokens, pa.int64()), pa.array(cluster, pa.int64())], ["id", "source", "n_tokens", "cluster"])


def measured(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """id, source, n_tokens (words) and cluster (hash of the text without case and spacing)."""
    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs, [F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), text_bytes(text_col).alias("text")], _sizes, f"id {kind}, source string, n_tokens long, cluster long")


def best_fit(pieces: list[tuple[int, int, int]], capacity: int, per_source: int) -> list[tuple[int, int]]:
    """(bin, first token in it) of each (tokens, source number, cluster number), given largest first."""
    order: list[tuple[int, int]] = []  # (residual, bin) of bins with room
    sources: list[list[int]] = []  # per bin, bitmap k: sources with more than k pieces
    clusters: list[int] = []
    out = []
    for tokens, source, cluster in pieces:
        s, c = 1 << source, 1 << cluster
        at = bisect_left(order, (tokens, -1))
        while at < len(order):
            b = order[at][1]
            if not (sources[b][-1] & s or clusters[b] & c):
                break
            at += 1
        if at < len(order):
            room, b = order.pop(at)
        else:
            room, b = capacity, len(clusters)
            sources.append([0] * per_source)
            clusters.append(0)
        for k, have in enumerate(sources[b]):
            if not have & s:
                sources[b][k] |= s
                break
        clusters[b] |= c
        out.append((b, capacity - room))
        if room > tokens:
            insort(order, (room - tokens, b))
    return out


def _pack(capacity: int, per_source: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows, sizes = table["row"].to_pylist(), table["n_tokens"].to_pylist()
        sources, clusters = table["source"].to_pylist(), table["cluster"].to_pylist()
        number: dict = {}
        cut = sorted(((n % capacity, n - n % capacity, i) for i, n in enumerate(sizes) if n % capacity), key=lambda x: (-x[0], rows[x[2]]))
        keys = [number.setdefault(("s", sources[i]), len(number)) for _, _, i in cut]
        dups = [number.setdefault(("c", clusters[i]), len(number)) for _, _, i in cut]
        bins = best_fit([(n, s, c) for (n, _, _), s, c in zip(cut, keys, dups, strict=True)], capacity, per_source)
        used = max((b for b, _ in bins), default=-1) + 1
        out = [(i, start // capacity, start, n, b, at) for (n, start, i), (b, at) in zip(cut, bins, strict=True)]
        for i, n in enumerate(sizes):
            for start in range(0, n - n % capacity, capacity):
                out.append((i, start // capacity, start, capacity, used, 0))
                used += 1
            if not n:
                out.append((i, 0, 0, 0, None, None))
        shard = key[0].as_py()
        pick = pa.array([x[0] for x in out], pa.int64())
        return pa.table({
            "id": table["id"].take(pick), "piece": pa.array([x[1] for x in out], pa.int64()), "first_token": pa.array([x[2] for x in out], pa.int64()), "n_tokens": pa.array([x[3] for x in out], pa.int64()),
            "source": table["source"].take(pick), "cluster": table["cluster"].take(pick), "shard": pa.array([shard] * len(out), pa.int64()), "bin": pa.array([x[4] for x in out], pa.int64()), "bin_start": pa.array([x[5] for x in out], pa.int64()),
        })

    return run


def pack(items: DataFrame, capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS, per_source: int = PER_SOURCE) -> DataFrame:
    """One row per piece of items (id, source, n_tokens, cluster): where it lies. bin is unique within shard."""
    items = materialise(items.select("id", "source", "n_tokens", "cluster").withColumn("row", F.monotonically_increasing_id()), "items")
    shards = max(1, math.ceil(items.count() / shard_docs))
    kind = items.schema["id"].dataType.simpleString()
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards).cast("long")))
    return dealt.groupBy("shard").applyInArrow(_pack(capacity, per_source), f"id {kind}, piece long, first_token long, n_tokens long, source string, cluster long, shard long, bin long, bin_start long")


def pack_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", **how: int) -> DataFrame:
    return pack(measured(docs, text_col, id_col, source_col), **how)


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs).withColumnRenamed("id", "doc_id")
