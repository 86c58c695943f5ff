"""Line dedup over a sharded minimal perfect hash.

A line's key is the line without white space at both ends, A-Z lowered; keys of at least
`min_chars` code points found in at least `min_docs` documents lose all their lines except
in the largest id that holds them. Keys are 128-bit hashes. All distinct ones are dealt
over shards of bounded size; each shard is a minimal perfect hash (levels of bit arrays,
rank by prefix sums) over compact arrays: fingerprint, document count, keeping id.
Documents send 16-byte probes, never lines, to the shards: a shard's index travels once,
its probes stream past it, and count and keeping id decide. The `hot` most frequent keys (a fixed bound) form a shard
of their own that is broadcast, so no key's probes gather in one task.

Defined results: null and empty text are one empty line; every row is a document, rows of
one id count separately and are judged alike; a null id is smaller than any id, and keeps
a line only if no row with an id has it; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import FOLD, map_rows, materialise, mix, possibly, text_bytes, texts

MIN_CHARS, MIN_DOCS = 20, 3
#: Keys of one shard, and keys of the broadcast shard.
SHARD_KEYS, HOT_KEYS = 200_000, 4096
NO_ID = np.iinfo(np.int64).min


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys, with arrays indexed by it."""

    GAMMA, MOST_LEVELS = 2.0, 48

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, rest: np.ndarray, arrays: dict[str, np.ndarray]):
        self.sizes, self.bits, self.rest, self.arrays = sizes, bits, rest, arrays
        self.starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        self.rank = np.cumsum(bits, dtype=np.int64) - 1
        self.placed = int(bits.sum())

    @staticmethod
    def slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, **arrays: np.ndarray) -> PerfectHash:
        sizes, bits, left = [], [], keys
        for level in range(cls.MOST_LEVELS):
            if not len(left):
                break
            size = max(64, math.ceil(cls.GAMMA * len(left)))
            at = cls.slot(left, level, size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            left = left[~alone[at]]
        out = cls(np.array(sizes, dtype=np.int64), np.concatenate(bits) if bits else np.empty(0, dtype=bool), np.sort(left), {})
        where = out.find(keys)
        for name, values in arrays.items():
            out.arrays[name] = np.empty_like(values)
            out.arrays[name][where] = values
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's index; for keys that were not built in, any index or -1."""
        out, todo = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for level, (start, size) in enumerate(zip(self.starts, self.sizes, strict=True)):
            at = start + self.slot(keys[todo], level, int(size))
            hit = self.bits[at]
            out[todo[hit]] = self.rank[at[hit]]
            todo = todo[~hit]
        if len(self.rest) and len(todo):
            at = np.searchsorted(self.rest, keys[todo]).clip(max=len(self.rest) - 1)
            hit = self.rest[at] == keys[todo]
            out[todo[hit]] = self.placed + at[hit]
        return out

    def probe(self, keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """Indexes of the keys whose fingerprint agrees; -1 for all others."""
        at = self.find(keys)
        if not len(self.arrays["prints"]):
            return at
        at[self.arrays["prints"][at] != prints] = -1
        return at

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, sizes=self.sizes, bits=np.packbits(self.bits), n=np.array([len(self.bits)]), rest=self.rest, **{f"a_{k}": v for k, v in self.arrays.items()})
        return out.getvalue()

    @classmethod
    def load(cls, blob: bytes) -> PerfectHash:
        with np.load(io.BytesIO(blob), allow_pickle=False) as f:
            return cls(f["sizes"], np.unpackbits(f["bits"], count=int(f["n"][0])).astype(bool), f["rest"], {k[2:]: f[k] for k in f.files if k.startswith("a_")})


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """128-bit hash of the line's key, or None if the key is short."""
    key = line.strip().translate(FOLD)
    if len(key) < min_chars or len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def _doc_keys(min_chars: int):
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, rows, keys = batch.column(0), [], []
        for i, text in enumerate(texts(batch.column(1))):
            own = {k for line in text.split(b"\n") if (k := line_key(line, min_chars))}
            rows += [i] * len(own)
            keys += own
        pairs = np.frombuffer(b"".join(keys), dtype=np.int64).reshape(-1, 2)
        return pa.record_batch([ids.take(pa.array(rows, pa.int64())), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["id", "h1", "h2"])

    return work


def _longs(column: pa.Array, null: int = 0) -> np.ndarray:
    return column.fill_null(null).to_numpy(zero_copy_only=False).astype(np.int64)


def _index(table: pa.Table) -> PerfectHash:
    h1, h2 = _longs(table["h1"].combine_chunks()).view(np.uint64), _longs(table["h2"].combine_chunks()).view(np.uint64)
    return PerfectHash.build(h1 ^ mix(h2), prints=h2, count=_longs(table["n"].combine_chunks()), keep=_longs(table["keep"].combine_chunks(), NO_ID))


def build_shards(keys: DataFrame, shards: int) -> DataFrame:
    """One row per shard: its number and its serialised index."""

    def build(key: tuple, table: pa.Table) -> pa.Table:
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "blob": pa.array([_index(table).dump()], pa.binary())})

    return keys.withColumn("shard", F.pmod("h1", F.lit(shards).cast("long"))).groupBy("shard").applyInArrow(build, "shard long, blob binary")


def _verdict(index: PerfectHash, ids: np.ndarray, h1: np.ndarray, h2: np.ndarray, min_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Which probes are indexed, and which of them lose the line."""
    prints = h2.view(np.uint64)
    at = index.probe(h1.view(np.uint64) ^ mix(prints), prints)
    known = at >= 0
    lose = known.copy()
    lose[known] = (index.arrays["count"][at[known]] >= min_docs) & (index.arrays["keep"][at[known]] != ids[known])
    return known, lose


def dropped_keys(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, shard_keys: int = SHARD_KEYS, hot_keys: int = HOT_KEYS) -> DataFrame:
    """(id, drop): for each id that loses lines, the distinct keys of them."""
    spark = docs.sparkSession
    lines = map_rows(docs, [F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text")], _doc_keys(min_chars), "id long, h1 long, h2 long")
    lines = materialise(lines, "lines")
    keys = materialise(lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("id").alias("keep")), "keys")
    hot = keys.orderBy(F.desc("n"), "h1", "h2").limit(hot_keys).toArrow()
    sent = spark.sparkContext.broadcast(_index(hot).dump())
    shards = max(1, math.ceil(keys.count() / shard_keys))
    if hot.num_rows == hot_keys:
        last = {k: hot[k][-1].as_py() for k in ("n", "h1", "h2")}
        colder = (F.col("n") < last["n"]) | ((F.col("n") == last["n"]) & ((F.col("h1") > last["h1"]) | ((F.col("h1") == last["h1"]) & (F.col("h2") > last["h2"]))))
        rest = keys.where(colder)
    else:
        rest = keys.where(F.lit(False))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = PerfectHash.load(sent.value)
        for batch in batches:
            h1, h2 = _longs(batch.column(1)), _longs(batch.column(2))
            known, lose = _verdict(index, _longs(batch.column(0), NO_ID), h1, h2, min_docs)
            pick = pa.array(np.nonzero(lose | ~known)[0])  # what the hot shard knows and keeps is settled
            yield pa.record_batch([*(c.take(pick) for c in batch.columns), pa.array(lose).take(pick)], ["id", "h1", "h2", "lose"])

    judged = lines.mapInArrow(first, "id long, h1 long, h2 long, lose boolean")
    if hot.num_rows == hot_keys:
        judged = materialise(judged, "probes")
        blobs = build_shards(rest, shards).select("shard", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"), "blob")
        asked = judged.where("not lose").select(F.pmod("h1", F.lit(shards).cast("long")).alias("shard"), F.lit(1).alias("kind"), "id", "h1", "h2", F.lit(None).cast("binary").alias("blob"))
        routed = blobs.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "kind")

        def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, of = None, None
            for batch in batches:
                shard, kind = _longs(batch.column(0)), _longs(batch.column(1))
                edges = np.flatnonzero(np.diff(shard) != 0) + 1
                for lo, hi in zip([0, *edges], [*edges, len(shard)], strict=True):
                    if shard[lo] != of:
                        index, of = None, shard[lo]
                    if lo < hi and kind[lo] == 0:
                        index = PerfectHash.load(batch.column(5)[lo].as_py())
                        lo += 1
                    if index is None or lo == hi:
                        continue
                    part = batch.slice(lo, hi - lo)
                    _, lose = _verdict(index, _longs(part.column(2), NO_ID), _longs(part.column(3)), _longs(part.column(4)), min_docs)
                    pick = pa.array(np.nonzero(lose)[0])
                    yield pa.record_batch([part.column(k).take(pick) for k in (2, 3, 4)], ["id", "h1", "h2"])

        lost = judged.where("lose").select("id", "h1", "h2").unionByName(routed.mapInArrow(second, "id long, h1 long, h2 long"))
    else:
        lost = judged.where("lose").select("id", "h1", "h2")
    return lost.groupBy("id").agg(F.collect_set(F.struct("h1", "h2")).alias("drop"))


def _strip(min_chars: int):
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        drop = batch.column(2)
        offsets, pairs = drop.offsets.to_numpy(), drop.values
        raw = np.column_stack([_longs(pairs.field(0)), _longs(pairs.field(1))]).tobytes() if len(pairs) else b""
        some = drop.is_valid().to_numpy(zero_copy_only=False)
        kept, n_lines, n_dropped = [], [], []
        for i, text in enumerate(texts(batch.column(1))):
            n = text.count(b"\n") + 1
            n_lines.append(n)
            if some[i]:
                gone = {raw[16 * j : 16 * j + 16] for j in range(offsets[i], offsets[i + 1])}
                stay = [line for line in text.split(b"\n") if line_key(line, min_chars) not in gone]
                text = b"\n".join(stay)
                n -= len(stay)
            else:
                n = 0
            kept.append(text)
            n_dropped.append(n)
        return pa.record_batch([batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_lines", "n_dropped", "kept_text"])

    return work


def deduplicate_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, **shards: int) -> DataFrame:
    """One row per row of docs: id, n_lines, n_dropped, kept_text."""
    gone = materialise(dropped_keys(docs, text_col, id_col, min_docs, min_chars, **shards), "gone").withColumnRenamed("id", "of")
    d = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text"))
    schema, drop = "id long, n_lines long, n_dropped long, kept_text string", F.lit(None).cast(gone.schema["drop"].dataType).alias("drop")
    parts = possibly(d, gone.select(F.xxhash64("of").alias("key")), F.xxhash64("id"))
    if parts is None:
        return map_rows(d, [F.col("id"), F.col("text"), drop], _strip(min_chars), schema)
    # only texts that may lose a line are shuffled
    some, rest = parts
    both = some.join(gone, some["id"].eqNullSafe(gone["of"]), "left").select("id", "text", "drop").unionByName(rest.select("id", "text", drop))
    return map_rows(both, [F.col("id"), F.col("text"), F.col("drop")], _strip(min_chars), schema)


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = deduplicate_lines(docs)
    return out.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP6_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i
  FROM documents
), k AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (
  SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), j AS (
  SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.keep AS gone FROM k LEFT JOIN f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
