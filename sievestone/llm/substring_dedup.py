"""Substring dedup by paragraph MinHash banding.

Paragraphs are of two kinds. Lines of at least `least_words` words get MinHash signatures
over their five-word shingles, `bands` bands of `rows_per_band` values: a pair of
similarity 0.8 collides with probability 0.99 (6 bands of 3: 1 - (1 - 0.8**3)**6). Lines
that collide are verified by exact Jaccard similarity. Passages that stand inside longer
lines are found by seeds: of so many successive runs of ten words the one with the least
hash is an anchor, chosen so that rows that share a run of 21 words share an anchor. Each
row is aligned, by its texts, with the smallest row of every of its anchors, and each
alignment is extended left and right to the whole run that they share; runs of
`least_words` words or more are repeats. Runs are chained over the words between them: the
longest passages of `least_words` words or more that exact Jaccard similarity verifies are
repeats too. Passages that link share a run of 21 words, so near copies share an anchor; a
row is compared only with the smallest row of each anchor.

Components of colliding and verified lines are the clusters; of a cluster, the line of the
smallest id stays and all others are removed, as are passages that a smaller row of one of
their anchors has. A document's overlapping paragraphs are merged into spans of words.

Defined results: null and empty text has no paragraph; only paragraphs of different rows
count as repeats; a null id stays before all others; a repeated row is a document of its
own only if its id or text differs; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import FOLD, SHINGLE_WORDS, connected_components, discard, long_array, map_rows, materialise, mix, shingle_sequence, text_bytes, texts, word_hashes
from .ngram_join import BROADCAST_ROWS, DEALT, NODE, bitmap, least_overlap, linked, nodes_of, verify

LEAST_WORDS, BANDS, ROWS_PER_BAND, THRESHOLD = 25, 6, 3, 80
#: Words of a seed, fewer where a shared run may be shorter.
SEED_WORDS = 10
#: Bound of the most frequent seeds, whose rows are judged where they lie.
HOT_SEEDS = 1 << 16
#: Texts whose seeds are held at once, and how often these hold a seed that is reported.
UNIT_TEXTS, OFTEN_IN_TEXTS = 2000, 4


def seed_shape(least_words: int, threshold: int) -> tuple[int, int]:
    """(words of a seed, starts of which one is an anchor): so that passages of `least_words` words or more that link share an anchor."""
    whole = least_overlap(least_words - SHINGLE_WORDS + 1, threshold)
    broken = -(-(2 * SHINGLE_WORDS - 1) * threshold // (2 * (100 - threshold))) if threshold < 100 else whole
    run = min(whole, broken) + SHINGLE_WORDS - 1
    width = min(SEED_WORDS, run)
    return width, run - width + 1


def anchors(seeds: np.ndarray, among: int) -> np.ndarray:
    """Starts of the seeds that are the least of some `among` successive ones."""
    if len(seeds) <= among:
        return np.array([int(np.argmin(seeds))])
    view = np.lib.stride_tricks.sliding_window_view(seeds, among)
    return np.unique(np.argmin(view, axis=1) + np.arange(len(view)))


#: Rows of a text: an anchor; a line; and, of a batch of texts, a seed that it holds often (`n` times).
SEED, LINE, OFTEN = 0, 1, 2
UNITS = "kind byte, id long, at long, key long, first int, line int, words int, n int, bands array<long>, bits binary"


def _units(least_words: int, threshold: int, bands: int, rows_per_band: int):
    """Each text's anchors, and its lines of `least_words` words or more with their MinHash bands and bitmaps; words are hashed once."""
    width, among = seed_shape(least_words, threshold)
    odd = mix(np.arange(1, bands * rows_per_band + 1, dtype=np.uint64)) | np.uint64(1)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, starts, of = [], [], []
        row, line, first, words, sets, bits = [], [], [], [], [], []
        for r, text in enumerate(texts(batch.column(2))):
            folded = text.translate(FOLD)
            own = folded.split()
            if len(own) < least_words:
                continue
            hashes = word_hashes(own)
            seeds = shingle_sequence(hashes, width)
            at = anchors(seeds, among)
            keys.append(seeds[at])
            starts.append(at)
            of.append(np.full(len(at), r))
            sizes = [len(part.split()) for part in folded.split(b"\n")]
            if max(sizes) < least_words:
                continue
            shingles, done = shingle_sequence(hashes), 0
            for i, n in enumerate(sizes):
                if n >= least_words:
                    row.append(r)
                    line.append(i)
                    first.append(done)
                    words.append(n)
                    sets.append(np.unique(shingles[done : done + n - SHINGLE_WORDS + 1]))
                    bits.append(bitmap(sets[-1]))
                done += n
        none = np.empty(0, dtype=np.uint64)
        size = np.array([len(x) for x in sets], dtype=np.int64)
        tokens, begins = np.concatenate(sets or [none]), np.cumsum(size) - size
        node = nodes_of(tokens, begins, size)
        band = np.tile(np.arange(bands, dtype=np.uint64), (len(sets), 1))
        for k, factor in enumerate(odd if sets else ()):
            # tokens are spread over all bits already, and the least is told by the highest ones
            least = np.minimum.reduceat(tokens * factor, begins)
            band[:, k // rows_per_band] = mix(band[:, k // rows_per_band] * np.uint64(0x9E3779B97F4A7C15) + least)
        key, start = np.concatenate(keys or [none]), np.concatenate(starts or [none]).astype(np.int32)
        often, times = np.unique(key, return_counts=True)
        often, times = (v[times >= OFTEN_IN_TEXTS] for v in (often, times))
        m, k, o = len(key), len(sets), len(often)
        pick = pa.array(np.concatenate([np.empty(0, dtype=np.int64), *of, np.array(row, dtype=np.int64), np.zeros(o, dtype=np.int64)]).astype(np.int64))
        lines = lambda values, kind, rest=None: pa.concat_arrays([pa.nulls(m, kind), pa.array(values, kind), pa.nulls(o, kind) if rest is None else pa.array(rest, kind)])
        offsets = pa.array(np.concatenate([np.zeros(m + 1), np.arange(1, k + 1) * bands, np.full(o, k * bands)]).astype(np.int32))
        return pa.record_batch(
            [
                pa.array(np.repeat(np.array([SEED, LINE, OFTEN], dtype=np.int8), [m, k, o])), batch.column(0).take(pick), batch.column(1).take(pick), long_array(np.concatenate([key, node, often])),
                pa.array(np.concatenate([start, np.array(first, dtype=np.int32), np.zeros(o, dtype=np.int32)])), lines(line, pa.int32()), lines(words, pa.int32()), lines(size.astype(np.int32), pa.int32(), times.astype(np.int32)),
                pa.ListArray.from_arrays(offsets, long_array(band.reshape(-1))), lines(bits, pa.binary()),
            ],
            ["kind", "id", "at", "key", "first", "line", "words", "n", "bands", "bits"],
        )

    return work


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream (key, id, at, first), sorted: (lead, lead_id, at, id, shift) of the rows behind each key's first row."""
    last = None  # key, id, at, first of the key that the batch before ended in
    for batch in batches:
        if not batch.num_rows:
            continue
        key, at, first = (batch.column(k).to_numpy() for k in (0, 2, 3))
        begin = np.concatenate(([True], key[1:] != key[:-1]))
        if last is not None and key[0] == last[0]:
            begin[0] = False
        lead = np.maximum.accumulate(np.where(begin, np.arange(len(key)), -1))
        old = lead < 0
        lead_at, lead_first = at[lead], first[lead]
        if old.any():
            lead_at[old], lead_first[old] = last[2], last[3]
        behind = at != lead_at
        ids = batch.column(1)
        lead_ids = ids.take(pa.array(np.maximum(lead, 0)))
        if old.any():
            lead_ids = pa.concat_arrays([pa.array([last[1]] * int(old.sum()), pa.int64()), lead_ids.slice(int(old.sum()))])
        last = (key[-1], lead_ids[-1].as_py(), lead_at[-1], lead_first[-1])
        pick = pa.array(behind)
        yield pa.record_batch([pa.array(lead_at[behind]), lead_ids.filter(pick), pa.array(at[behind]), ids.filter(pick), pa.array((lead_first - first)[behind])], ["lead", "lead_id", "at", "id", "shift"])


def seed_pairs(seeds: DataFrame, often: DataFrame, most_hot: int = HOT_SEEDS) -> DataFrame:
    """(lead, lead_id, at, id, shift) for each seed (id, at, key, first) of a row other than the key's smallest, which leads.

    often: (key, n) of seeds that batches of texts hold often. The most frequent keys, of a bounded number, are judged where their rows lie; all others
    are shuffled once and streamed past their first row.
    """
    hot = materialise(often.groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(most_hot).select("key"), "hot-seeds")
    out = "lead long, lead_id long, at long, id long, shift int"
    cold = seeds.join(F.broadcast(hot), "key", "left_anti").select("key", "id", "at", "first")
    pairs = cold.repartition("key").sortWithinPartitions("key", "id", "at", "first").mapInArrow(_follow, out)
    mine = seeds.join(F.broadcast(hot), "key")
    stay = mine.groupBy("key").agg(F.min(F.struct("id", "at", "first")).alias("stay"))
    near = mine.join(F.broadcast(stay), "key").where(F.col("at") != F.col("stay.at"))
    return pairs.union(near.select(F.col("stay.at"), F.col("stay.id"), "at", "id", F.col("stay.first") - F.col("first")))


def shared_runs(own: np.ndarray, other: np.ndarray, shifts: list[int]) -> list[tuple[int, int, int]]:
    """Maximal runs (first in own, first in other, length) of equal shingles, in order, of the alignments other = own + shift."""
    out = []
    for d in shifts:
        lo, hi = max(0, -d), min(len(own), len(other) - d)
        if lo < hi:
            equal = np.concatenate(([0], (own[lo:hi] == other[lo + d : hi + d]).view(np.int8), [0]))
            edges = np.flatnonzero(np.diff(equal)) + lo
            out += [(x, x + d, y - x) for x, y in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]
    return sorted(out)


def chains(runs: list[tuple[int, int, int]], threshold: int) -> list[list[tuple[int, int, int]]]:
    """The runs, trimmed to follow one another in both sequences, in chains whose gaps what they share can make up for."""
    if len(runs) < 2:
        return [list(runs)] if runs else []
    longest, least, out = max(n for *_, n in runs), 100 - threshold, []
    live: list[list[int]] = []  # end in own, end in other, shared, number
    for p, q, n in runs:
        best = None
        for c in live:
            a, b = p - c[0], q - c[1]
            # gaps that the runs leave open in both, and what of the run lies behind the chain
            low = a if a < b else b
            cost, cut = (a + b, 0) if low >= 0 else (a - b if a > b else b - a, -low)
            if cut < n and cost * threshold <= (c[2] + n - cut) * least and (best is None or cost + cut < best[0]):
                best = (cost + cut, cut, c)
        if best is None:
            live.append([p + n, q + n, n, len(out)])
            out.append([(p, q, n)])
        else:
            _, cut, c = best
            out[c[3]].append((p + cut, q + cut, n - cut))
            c[0], c[1], c[2] = p + n, q + n, c[2] + n - cut
        if (p - live[0][0]) * threshold > (live[0][2] + longest) * least or len(live) % 32 == 0:
            live = [c for c in live if (p - c[0]) * threshold <= (c[2] + longest) * least]
    return out


def merged(spans: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """(first, words) of what overlapping or touching spans (first, words) cover."""
    out: list[list[int]] = []
    for first, words in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], first + words)
        else:
            out.append([first, first + words])
    return [(first, end - first) for first, end in out]


def links(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    x, y = np.unique(x), np.unique(y)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= threshold * (len(x) + len(y) - both)


def passages(own: np.ndarray, other: np.ndarray, shifts: list[int], least_words: int, threshold: int) -> set[tuple[int, int, int, int]]:
    """Shared passages (first word, words, first word in other, words in other) of two shingle sequences."""
    least, more = least_words - SHINGLE_WORDS + 1, SHINGLE_WORDS - 1
    runs = shared_runs(own, other, shifts)
    out = {(p, n + more, q, n + more) for p, q, n in runs if n >= least}
    for chain in chains(runs, threshold):
        if len(chain) < 2:
            continue
        p, q, n = np.array(chain).T
        shared, done = np.concatenate(([0], np.cumsum(n))), 0
        for i in range(len(chain)):
            # up to which later run the passage still links, by place; what follows reads the sets
            a, b, c = (p + n)[i:] - p[i], (q + n)[i:] - q[i], shared[i + 1 :] - shared[i]
            may = np.flatnonzero((100 * c >= threshold * (a + b - c)) & (np.minimum(a, b) >= least)) + i
            for j in may[may > max(i, done)][::-1].tolist():
                x, y = own[p[i] : p[j] + n[j]], other[q[i] : q[j] + n[j]]
                if links(x, y, threshold):
                    out.add((int(p[i]), len(x) + more, int(q[i]), len(y) + more))
                    done = j
                    break
    return out


def _align(least_words: int, threshold: int):
    """Stream (lead, part, member, at, id, lead_id, shifts, text), each part's leader first, each member's shifts before its text: spans of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, other, whole, seen, along = None, None, None, None, []
        for batch in batches:
            out, spans = {"at": [], "id": [], "kept_in": []}, []
            for key, member, at, id_, lead_id, shifts, text in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4, 5, 6)), texts(batch.column(7)), strict=True):
                if text is None:
                    along = shifts
                    continue
                if (key, at) == (lead, seen):
                    continue
                seen, shifts = at, along
                folded = text.translate(FOLD)
                if member and key != lead:
                    raise ValueError("a leader's text is missing")
                if member and folded == whole:
                    own, shifts = other, [0, *shifts]
                else:
                    own = shingle_sequence(word_hashes(folded.split()))
                if not member:
                    lead, other, whole = key, own, folded
                    continue
                found = passages(own, other, shifts, least_words, threshold)
                for who, whose, removed, own_spans in ((at, id_, True, {(p, n) for p, n, _, _ in found}), (key, lead_id, False, {(q, m) for _, _, q, m in found})):
                    for p, n in merged(own_spans):
                        out["at"].append(who)
                        out["id"].append(whose)
                        out["kept_in"].append(lead_id)
                        spans.append((p, n, removed))
            first, words, removed = zip(*spans, strict=True) if spans else ((), (), ())
            yield pa.record_batch(
                [pa.array(out["id"], pa.int64()), pa.array(out["at"], pa.int64()), pa.array(first, pa.int32()), pa.array(words, pa.int32()), pa.array(out["kept_in"], pa.int64()), pa.array(removed, pa.bool_())],
                ["id", "at", "first", "words", "kept_in", "removed"],
            )

    return run


def aligned(seeds: DataFrame, often: DataFrame, docs: DataFrame, text_col: str, id_col: str, least_words: int, threshold: int, part: int = 256) -> DataFrame:
    """Spans (id, at, first, words, kept_in, removed) of the passages that rows share with the smallest row of one of their seeds (id, at, key, first)."""
    pairs = seed_pairs(seeds, often).groupBy("lead", "at").agg(F.first("id").alias("id"), F.first("lead_id").alias("lead_id"), F.collect_set("shift").alias("shifts"))
    pairs = materialise(pairs, "seed-pairs")
    # as in verify: a leader's members are salted, the leader goes to every part; shifts travel beside the texts, so that what is broadcast is bounded by its rows
    leads = pairs.groupBy("lead").agg(F.first("lead_id").alias("lead_id"), F.ceil(F.count("*") / F.lit(part)).alias("parts"))
    members = pairs.join(leads.select("lead", "parts"), "lead").select("lead", F.pmod(F.xxhash64("at"), "parts").alias("part"), F.lit(True).alias("member"), "at", "id", "lead_id", "shifts")
    first = leads.select("lead", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(False), F.col("lead").alias("at"), F.col("lead_id").alias("id"), "lead_id", F.array().cast("array<int>"))
    wanted = materialise(members.union(first), "wanted")
    rows = wanted.drop("shifts")
    if wanted.count() <= BROADCAST_ROWS:
        rows = F.broadcast(rows)
    d = docs.select(F.xxhash64(F.col(id_col), text_bytes(text_col)).alias("at"), text_bytes(text_col).alias("text"))
    columns = ["lead", "part", "member", "at", "id", "lead_id"]
    sent = rows.join(d, "at").select(*columns, F.lit(None).cast("array<int>").alias("shifts"), "text").union(wanted.where("member").select(*columns, "shifts", F.lit(None).cast("string")))
    sent = sent.withColumn("second", F.col("shifts").isNull())
    return sent.repartition("lead", "part").sortWithinPartitions("lead", "part", "member", "at", "second").drop("second").mapInArrow(_align(least_words, threshold), "id long, at long, first int, words int, kept_in long, removed boolean")


def _repeated(units: DataFrame, key: str) -> DataFrame:
    """units (id, at, key, first, words) whose key occurs in other rows, with the one that stays."""
    stay = units.groupBy(key).agg(F.min(F.struct("id", "at")).alias("stay"), F.min("at").alias("lo"), F.max("at").alias("hi")).where("lo <> hi").select(key, "stay")
    return units.join(stay, key).select("id", "at", "first", "words", F.col("stay.id").alias("kept_in"), (F.col("at") != F.col("stay.at")).alias("removed"))


def _merge(batch: pa.RecordBatch) -> pa.RecordBatch:
    out = {k: [] for k in ("row", "first", "end", "kept_in", "removed")}
    for r, found in enumerate(batch.column(2).to_pylist()):
        for removed in (False, True):
            spans: list[list] = []
            for x in sorted((x for x in found if x["removed"] == removed), key=lambda x: (x["first"], x["words"])):
                end = x["first"] + x["words"]
                if spans and x["first"] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], end)
                    if spans[-1][2] is not None and (x["kept_in"] is None or x["kept_in"] < spans[-1][2]):
                        spans[-1][2] = x["kept_in"]
                else:
                    spans.append([x["first"], end, x["kept_in"]])
            for first, end, kept_in in spans:
                for k, v in zip(out, (r, first, end, kept_in, removed), strict=True):
                    out[k].append(v)
    pick = pa.array(out["row"], pa.int64())
    return pa.record_batch([batch.column(0).take(pick), batch.column(1).take(pick), pa.array(out["first"], pa.int64()), pa.array(out["end"], pa.int64()), pa.array(out["kept_in"], pa.int64()), pa.array(out["removed"], pa.bool_())], ["id", "at", "first_word", "end_word", "kept_in", "removed"])


def repeated_spans(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", least_words: int = LEAST_WORDS, bands: int = BANDS, rows_per_band: int = ROWS_PER_BAND, threshold: int = THRESHOLD) -> DataFrame:
    """One row per repeated span: id, at (hash of id and text), first_word, end_word, kept_in (smallest id of a copy), removed."""
    at = F.xxhash64(F.col(id_col), text_bytes(text_col)).alias("at")
    base = [F.col(id_col).cast("long").alias("id"), at, text_bytes(text_col).alias("text")]
    units = materialise(map_rows(docs, base, _units(least_words, threshold, bands, rows_per_band), UNITS, UNIT_TEXTS), "units")
    passed = materialise(aligned(units.where(F.col("kind") == SEED).select("id", "at", "key", "first"), units.where(F.col("kind") == OFTEN).select("key", "n"), docs, text_col, id_col, least_words, threshold), "passages")

    lines = units.where(F.col("kind") == LINE).select("id", "at", "line", "first", "words", F.col("key").alias("node"), "n", "bands", "bits")
    nodes = lines.groupBy("node").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("bands").alias("bands"))
    nodes = materialise(nodes, "line-nodes")
    signed = nodes.select(F.explode("bands").alias("key"), F.lit(NODE).cast("byte").alias("kind"), F.col("node").alias("x"), F.lit(0).cast("long").alias("y"), "n", F.lit(0).alias("q"))
    assert ", ".join(f"{n} {t}" for n, t in signed.dtypes).replace("bigint", "long").replace("tinyint", "byte") == DEALT
    where = lines.select("node", "at", "line")
    pick = F.element_at(F.split("text", "\n"), F.col("line") + 1)
    links = linked(signed, nodes.select("node", F.col("n").cast("long").alias("n"), "bits"), lambda pairs: verify(pairs, where, docs, text_col, id_col, threshold, pick=pick), threshold)
    discard(nodes)
    part = connected_components(links, "paragraphs")
    clustered = lines.join(part, "node", "left").select("id", "at", "first", "words", F.coalesce("component", "node").alias("cluster"))

    both = passed.unionByName(_repeated(clustered, "cluster"))
    found = both.groupBy("id", "at").agg(F.collect_set(F.struct("first", "words", "kept_in", "removed")).alias("found"))
    return found.mapInArrow(lambda batches: map(_merge, batches), "id long, at long, first_word long, end_word long, kept_in long, removed boolean")


def _cut(batch: pa.RecordBatch) -> pa.RecordBatch:
    out = []
    for text, spans in zip(texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
        if spans:
            kept, at, n = [], 0, 0
            gone = sorted((s["first_word"], s["end_word"]) for s in spans)
            for line in text.split(b"\n"):
                words, stay = line.split(), []
                for w in words:
                    while at < len(gone) and gone[at][1] <= n:
                        at += 1
                    if not (at < len(gone) and gone[at][0] <= n):
                        stay.append(w)
                    n += 1
                if stay or not words:
                    kept.append(line if len(stay) == len(words) else b" ".join(stay))
            text = b"\n".join(kept)
        out.append(text)
    return pa.record_batch([batch.column(0), pa.array(out, pa.binary()).cast(pa.string())], ["id", "kept_text"])


def remove_repeats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **how: int) -> DataFrame:
    """One row per row of docs: id, and its text without the removed spans."""
    spans = repeated_spans(docs, text_col, id_col, **how).where("removed").groupBy("at").agg(F.collect_list(F.struct("first_word", "end_word")).alias("spans"))
    d = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text"), F.xxhash64(F.col(id_col), text_bytes(text_col)).alias("at"))
    return d.join(spans, "at", "left").select("id", "text", "spans").mapInArrow(lambda batches: map(_cut, batches), "id long, kept_text string")


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return repeated_spans(docs).drop("at").withColumnRenamed("id", "doc_id")
