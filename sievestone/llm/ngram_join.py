"""N-gram Jaccard join by token-combination prefixes.

A text's set is its distinct five-word shingles (the whole sequence if it is shorter), as
64-bit hashes. Texts of one set form a node. Two nodes link when 100 * intersection is at
least `threshold` * union.

Signatures. Tokens have one global order: rare ones by hash, then the frequent ones by
count. Frequent are at most `most_frequent` tokens, those with the largest sums over all
batches of texts of counts that reach LEAST_IN_BATCH; any choice keeps the result exact. A set of n tokens shares
at least c = ceil(threshold * n) of them with any partner, so at most e = n - c are
missing. Its prefix is extended until, with every rare token worth one and every class of
frequent tokens worth its size less one, it is worth e + 1: however e tokens vanish, either
a rare token or two tokens of one class remain, and both partners' prefixes hold them.
Rare tokens are indexed singly, frequent ones as pairs within a class. The number of
classes follows the set's size in steps of two; sets at the lower edge of a step are
indexed for the step below too, so that partners always meet in one step.

Groups. Nodes are dealt by signature and streamed, those with the smallest share of rare
tokens first: what is common to near copies leads them. Up to `small_group` nodes of a
signature are paired at once. In a larger group every node is paired with the first leader
whose size fits (or leads itself) and is remembered. After verification, members of a
larger group that are still in different components are compared too, by bitmaps, in
blocks; what these don't rule out is verified. So no link that joins components is lost,
and a group of thousands of near copies costs one pair per member.

Verification first compares bitmaps of the sets, which rule out pairs without ever ruling
out a link, then reads the remaining nodes' texts again, sends each to its leaders, and
counts the exact intersection. Components come from distributed star rounds.

Defined results: null and empty text, or text of white space alone, has an empty set and
links with nothing; rows of equal sets form one component; a null id is never a smallest
id while another exists; repeated ids are rows of their own; an empty table gives an
empty table; other columns are carried or ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import connected_components, discard, drop_rows, long_array, materialise, mix, row_hash, shingle_set, slices, text_bytes, texts

THRESHOLD = 80
#: Bound of the broadcast frequent tokens; a batch reports tokens of at least so many texts.
FREQUENT_TOKENS, LEAST_IN_BATCH = 1 << 18, 4
SMALL_GROUP = 8
#: Rows of (leader, member) up to which they are broadcast to the texts; more are shuffled.
BROADCAST_ROWS = 400_000
#: Tokens of a set for each of its classes of frequent tokens.
CLASS_TOKENS = 5
#: Texts whose signatures are held at once.
SIGNED_TEXTS = 2000
#: Members of a block when the open members of a larger group are compared.
BLOCK = 512
#: Pairs of a member of a larger group that are verified before all open pairs are.
FEW = 4


def least_overlap(n: int, threshold: int = THRESHOLD) -> int:
    return -(-threshold * n // 100)


def nodes_of(tokens: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit digests of the sets that lie one after the other in tokens; none is empty."""
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    spread = np.bitwise_xor.reduceat(mix(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts)
    return mix(spread + sizes.astype(np.uint64) + np.add.reduceat(tokens, starts) * np.uint64(0x9E3779B97F4A7C15))


def node_of(tokens: np.ndarray) -> np.uint64:
    return nodes_of(tokens, np.zeros(1, dtype=np.int64), np.array([len(tokens)]))[0]


def bitmap(tokens: np.ndarray) -> bytes:
    """A bit for every token, in the power of two of bits that is at least twice their number."""
    size = 1 << max(6, (2 * len(tokens) - 1).bit_length())
    bits = np.zeros(size, dtype=bool)
    bits[(tokens & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _folded(bits: bytes, size: int) -> int:
    out, have = int.from_bytes(bits, "little"), 8 * len(bits)
    while have > size:
        have //= 2
        out = (out >> have) | (out & ((1 << have) - 1))
    return out


def may_link(x: bytes, n: int, y: bytes, m: int, threshold: int = THRESHOLD) -> bool:
    """False only if two sets, by their bitmaps and sizes, can't link: a bit that one lacks is a token that it lacks."""
    size = 8 * min(len(x), len(y))
    a, b = _folded(x, size), _folded(y, size)
    most = min(n - (a & ~b).bit_count(), m - (b & ~a).bit_count())
    return 100 * most >= threshold * (n + m - most)


DOCUMENT, TOKEN = 0, 1


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for every text: its node, size and bitmap; and one for every token of LEAST_IN_BATCH different sets of a batch."""
    names = ["kind", "id", "at", "node", "n", "bits", "token", "seen"]
    for batch in batches:
        sets, node, size, bits = {}, [], [], []
        for text in texts(batch.column(2)):
            tokens = shingle_set(text)
            size.append(len(tokens))
            if not len(tokens):
                node.append(None)
                bits.append(None)
                continue
            x = node_of(tokens)
            node.append(int(x.view(np.int64)))
            bits.append(bitmap(tokens))
            sets[node[-1]] = tokens
        k = len(size)
        none = pa.nulls(k, pa.int64())
        yield pa.record_batch([pa.array(np.full(k, DOCUMENT, dtype=np.int8)), batch.column(0), batch.column(1), pa.array(node, pa.int64()), pa.array(size, pa.int64()), pa.array(bits, pa.binary()), none, none], names)
        if not sets:
            continue
        token, times = np.unique(np.concatenate(list(sets.values())), return_counts=True)
        much = times >= LEAST_IN_BATCH
        k = int(much.sum())
        none = pa.nulls(k, pa.int64())
        yield pa.record_batch([pa.array(np.full(k, TOKEN, dtype=np.int8)), pa.nulls(k, batch.column(0).type), none, none, none, pa.nulls(k, pa.binary()), long_array(token[much]), pa.array(times[much], pa.int64())], names)


def frequent_tokens(survey: DataFrame, most: int = FREQUENT_TOKENS) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, places in the order of counts), tokens sorted; never more than `most`."""
    top = survey.where(F.col("kind") == TOKEN).groupBy("token").agg(F.sum("seen").alias("n")).orderBy(F.desc("n"), "token").limit(most).toArrow()
    tokens = top["token"].to_numpy().view(np.uint64)
    rank = np.arange(len(tokens), 0, -1, dtype=np.int64)
    by = np.argsort(tokens)
    return tokens[by], rank[by]


def rare_share(tokens: np.ndarray, frequent: np.ndarray) -> int:
    """Hundredths of the tokens that are not frequent: near copies' common core has few of them."""
    if not len(frequent):
        return 100
    at = np.searchsorted(frequent, tokens).clip(max=len(frequent) - 1)
    return int(100 * (frequent[at] != tokens).mean())


def signatures(tokens: np.ndarray, frequent: np.ndarray, rank: np.ndarray, threshold: int = THRESHOLD, class_tokens: int = CLASS_TOKENS) -> np.ndarray:
    """The set's distinct signatures; none if only an equal set can link with it."""
    n = len(tokens)
    missing = n - least_overlap(n, threshold)
    if missing == 0 and least_overlap(n + 1, threshold) > n:
        return np.empty(0, dtype=np.uint64)
    order = mix(tokens)
    if len(frequent):
        at = np.searchsorted(frequent, tokens).clip(max=len(frequent) - 1)
        hot = frequent[at] == tokens
    else:
        at, hot = None, np.zeros(n, dtype=bool)
    rare = tokens[~hot][np.argsort(order[~hot])]
    need = missing + 1
    if len(rare) >= need:
        return mix(rare[:need])
    common = tokens[hot][np.argsort(rank[at[hot]])]
    out = [mix(rare)]
    step = n.bit_length() - 1
    steps = [step] if threshold * n > 100 * (1 << step) or not step else [step, step - 1]
    for s in steps:
        classes = max(1, (1 << s) // class_tokens)
        of = mix(common + np.uint64(s)) % np.uint64(classes)
        worth, held = len(rare), {}
        for token, c in zip(common.tolist(), of.tolist(), strict=True):
            mine = held.setdefault(c, [])
            worth += bool(mine)
            mine.append(token)
            if worth >= need:
                break
        if worth < need:  # a set with that many classes always has enough tokens from a threshold of 50 on
            raise ValueError(f"no complete prefix for {n} tokens at {threshold} percent")
        pairs = [(x, y, c) for c, mine in held.items() for x, y in combinations(sorted(mine), 2)]
        if pairs:
            x, y, c = (np.array(v, dtype=np.uint64) for v in zip(*pairs, strict=True))
            out.append(mix(mix(x + np.uint64(s)) * np.uint64(0x9E3779B97F4A7C15) + mix(y) + c))
    return np.unique(np.concatenate(out))


#: Rows that are dealt out: a signature's node; the same of a node that leads others of its batch; a pair; a member of a larger group.
NODE, LEADER, PAIR, MEMBER = range(4)
DEALT = "key long, kind byte, x long, y long, n int, q int"


def fits(low: int, high: int, threshold: int) -> bool:
    return 100 * low >= threshold * high


def _rows(key, kind: int, x, y, n, q=None) -> pa.RecordBatch:
    key, x, y = (np.asarray(v).astype(np.uint64, copy=False) for v in (key, x, y))
    q = np.zeros(len(key)) if q is None else q
    return pa.record_batch([long_array(key), pa.array(np.full(len(key), kind, dtype=np.int8)), long_array(x), long_array(y), pa.array(np.asarray(n, dtype=np.int32)), pa.array(np.asarray(q, dtype=np.int32))], ["key", "kind", "x", "y", "n", "q"])


def _leader(leaders: list[tuple[int, int]], n: int, threshold: int) -> int | None:
    """The first leader (node, size) whose size fits."""
    for x, m in leaders:
        if fits(min(m, n), max(m, n), threshold):
            return x
    return None


def _sign(sent, threshold: int, small_group: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, rank = sent.value
        done: set[int] = set()
        for batch in slices(batches, SIGNED_TEXTS):
            sig, node, size, rare = [], [], [], []
            for text in texts(batch.column(0)):
                tokens = shingle_set(text)
                if not len(tokens) or (x := int(node_of(tokens))) in done:
                    continue
                done.add(x)
                own = signatures(tokens, frequent, rank, threshold)
                sig.append(own)
                node.append(np.full(len(own), x, dtype=np.uint64))
                size.append(np.full(len(own), len(tokens), dtype=np.int32))
                rare.append(np.full(len(own), rare_share(tokens, frequent), dtype=np.int32))
            if not sig:
                continue
            sig, node, size, rare = map(np.concatenate, (sig, node, size, rare))
            _, where, times = np.unique(sig, return_inverse=True, return_counts=True)
            crowded = times[where] > small_group
            yield _rows(sig[~crowded], NODE, node[~crowded], np.zeros((~crowded).sum()), size[~crowded], rare[~crowded])
            if not crowded.any():
                continue
            # a signature that many of a batch share: members meet their leader here, only leaders go on
            s_, x_, n_, q_ = sig[crowded], node[crowded], size[crowded], rare[crowded]
            by = np.lexsort((x_, n_, q_, s_))
            s_, x_, n_, q_ = s_[by], x_[by], n_[by], q_[by]
            yield _rows(mix(s_ ^ mix(x_)), MEMBER, s_, x_, n_, q_)
            first, pairs, at, leaders = np.zeros(len(s_), dtype=bool), set(), None, []
            for i, (s, x, n) in enumerate(zip(s_.tolist(), x_.tolist(), n_.tolist(), strict=True)):
                if s != at:
                    at, leaders = s, []
                lead = _leader(leaders, n, threshold)
                if lead is None:
                    leaders.append((x, n))
                    first[i] = True
                else:
                    pairs.add((lead, x))
            yield _rows(s_[first], LEADER, x_[first], np.zeros(first.sum()), n_[first], q_[first])
            a, b = (np.array([p[k] for p in pairs], dtype=np.uint64) for k in (0, 1))
            yield _rows(mix(a ^ mix(b)), PAIR, a, b, np.zeros(len(a)))

    return run


def _pairs(threshold: int, small_group: int):
    """Stream DEALT rows, sorted by key, q, n, x: PAIR and MEMBER rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig, group, leaders, last, led = None, [], [], None, False
        a, b, member = [], [], []

        def close() -> None:
            if led and not leaders:
                member.extend((sig, *row) for row in group)

        def flush() -> Iterator[pa.RecordBatch]:
            longs = lambda values: np.array(values, dtype=np.int64).view(np.uint64)
            if a:
                yield _rows(np.zeros(len(a)), PAIR, longs(a), longs(b), np.zeros(len(a)))
            if member:
                s, x, n, q = zip(*member, strict=True)
                yield _rows(np.zeros(len(s)), MEMBER, longs(s), longs(x), n, q)
            for kept in (a, b, member):
                kept.clear()

        for batch in batches:
            k_, t_, x_, n_, q_ = (batch.column(k).to_numpy() for k in (0, 1, 2, 4, 5))
            through = t_ >= PAIR
            if through.any():
                yield batch.filter(pa.array(through))
            k_, t_, x_, n_, q_ = (v[~through] for v in (k_, t_, x_, n_, q_))
            if not len(k_):
                continue
            # in the middle of a batch, a signature of one plain row pairs nothing
            keep = np.ones(len(k_), dtype=bool)
            keep[1:-1] = (k_[1:-1] == k_[:-2]) | (k_[1:-1] == k_[2:]) | (t_[1:-1] == LEADER)
            for s, t, x, n, q in zip(*(v[keep].tolist() for v in (k_, t_, x_, n_, q_)), strict=True):
                if s != sig:
                    close()
                    sig, group, leaders, last, led = s, [], [], None, False
                led = led or t == LEADER
                if x == last:
                    continue
                last = x
                if not leaders and len(group) < small_group:
                    for y, m, _ in group:
                        if fits(min(m, n), max(m, n), threshold):
                            a.append(y)
                            b.append(x)
                    group.append((x, n, q))
                    continue
                if not leaders:
                    for y, m, r in group:
                        if _leader(leaders, m, threshold) is None:
                            leaders.append((y, m))
                        member.append((s, y, m, r))
                lead = _leader(leaders, n, threshold)
                if lead is None:
                    leaders.append((x, n))
                else:
                    a.append(lead)
                    b.append(x)
                member.append((s, x, n, q))
            yield from flush()
        close()
        yield from flush()

    return run


def _overlaps(threshold: int):
    """Stream (lead, part, member, node, text), each part's leader first: verified links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, own, seen = None, None, None
        for batch in batches:
            a, b = [], []
            for x, y, text in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), texts(batch.column(4)), strict=True):
                if x == lead and y == seen:
                    continue
                tokens = shingle_set(text)
                if not len(tokens) or int(node_of(tokens).view(np.int64)) != y:
                    continue
                seen = y
                if x == y:
                    lead, own = x, tokens
                    continue
                if x != lead:
                    raise ValueError("a leader's text is missing")
                both = len(np.intersect1d(own, tokens, assume_unique=True))
                if 100 * both >= threshold * (len(own) + len(tokens) - both):
                    a.append(x)
                    b.append(y)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def verify(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, text_col: str, id_col: str, threshold: int = THRESHOLD, part: int = 256, pick: Column | None = None) -> DataFrame:
    """Those of the distinct pairs (a, b) that link.

    nodes: (node, at), and what `pick` needs to take a node's part of the text; at is a
    hash of a row's id and text.
    """
    # a leader's members are salted over parts of about `part` members; the leader goes to every part
    leads = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(part)).alias("parts"))
    members = pairs.join(leads, "a").select(F.col("a").alias("lead"), F.col("b").alias("node"), F.pmod(F.xxhash64("b"), "parts").alias("part"))
    wanted = members.union(leads.select("a", "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))))
    where = nodes.groupBy("node").agg(F.min(F.struct("at", *[c for c in nodes.columns if c not in ("node", "at")])).alias("w")).select("node", "w.*")
    wanted = materialise(wanted.join(where, "node"), "wanted")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    d = docs.select(F.xxhash64(F.col(id_col), text_bytes(text_col)).alias("at"), text_bytes(text_col).alias("text"))
    sent = wanted.join(d, "at").select("lead", "part", (F.col("lead") != F.col("node")).alias("member"), "node", (F.col("text") if pick is None else pick).alias("text"))
    return sent.repartition("lead", "part").sortWithinPartitions("lead", "part", "member", "node").mapInArrow(_overlaps(threshold), "a long, b long")


def possible(pairs: DataFrame, one: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The pairs (a, b) that sizes and bitmaps of one (a row a node: node, n, bits) don't rule out."""

    def test(x: pa.Array, n: pa.Array, y: pa.Array, m: pa.Array) -> pa.Array:
        return pa.array([may_link(*v, threshold) for v in zip(x.to_pylist(), n.to_pylist(), y.to_pylist(), m.to_pylist(), strict=True)], pa.bool_())

    x = one.select(F.col("node").alias("a"), F.col("n").alias("n"), F.col("bits").alias("x"))
    y = one.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("bits").alias("y"))
    return pairs.join(x, "a").join(y, "b").where(F.arrow_udf(test, "boolean")("x", "n", "y", "m")).select("a", "b")


def _matrix(bits: list[bytes], size: int) -> np.ndarray:
    """The bitmaps as rows of `size` bits, larger ones folded."""
    out = [np.frombuffer(x, dtype=np.uint64) for x in bits]
    while any(8 * x.nbytes > size for x in out):
        out = [x if 8 * x.nbytes <= size else x[: len(x) // 2] | x[len(x) // 2 :] for x in out]
    return np.stack(out)


def _block_pairs(rows: list[tuple], threshold: int, most: int | None) -> set[tuple[int, int]]:
    """Pairs of one block or two, (node, n, part, bits, block, own), of different parts, that sizes and bitmaps don't rule out; of each row at most so many, by hash.

    Rows that are not `own` meet only rows that are; those of two blocks meet only across.
    """
    out: set[tuple[int, int]] = set()
    split = len({r[4] for r in rows}) > 1
    for size in sorted({len(r[3]) for r in rows}):
        mine = [r for r in rows if len(r[3]) == size]
        both = mine + [r for r in rows if len(r[3]) == 2 * size]
        x, y = _matrix([r[3] for r in mine], 8 * size), _matrix([r[3] for r in both], 8 * size)
        n, m = (np.array([r[1] for r in side]) for side in (mine, both))
        p, q = (np.array([r[2] for r in side]) for side in (mine, both))
        c, d = (np.array([r[4] for r in side]) for side in (mine, both))
        own, other = (np.array([r[5] for r in side]) for side in (mine, both))
        ids = np.array([r[0] for r in both], dtype=np.int64).view(np.uint64)
        for i in range(len(mine)):
            may = (p[i] != q) & (100 * np.minimum(n[i], m) >= threshold * np.maximum(n[i], m)) & (own[i] | other)
            may[: i + 1] = False  # those of the same size class come first and in the same order
            if split:
                may &= c[i] != d
            at = np.flatnonzero(may)
            if not len(at):
                continue
            shared = np.minimum(n[i] - np.bitwise_count(x[i] & ~y[at]).sum(axis=1, dtype=np.int64), m[at] - np.bitwise_count(y[at] & ~x[i]).sum(axis=1, dtype=np.int64))
            at = at[100 * shared >= threshold * (n[i] + m[at] - shared)]
            if most is not None and len(at) > most:
                at = at[np.argpartition(mix(ids[at] ^ mix(ids[i : i + 1])), most)[:most]]
            for j in at:
                out.add((min(mine[i][0], both[j][0]), max(mine[i][0], both[j][0])))
    return out


def _compare(threshold: int, most: int | None):
    """Stream (sig, band, lo, hi, node, n, part, bits, block, own), sorted by the first four: pairs (a, b). A group has two blocks at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        made: set[tuple[int, int]] = set()
        for batch in batches:
            for s, band, lo, hi, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (s, band, lo, hi) != key:
                    made |= _block_pairs(rows, threshold, most) if len(rows) > 1 else set()
                    key, rows = (s, band, lo, hi), []
                rows.append(tuple(row))
            a, b = ([x[k] for x in made] for k in (0, 1))
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            made = set()
        made = _block_pairs(rows, threshold, most) if len(rows) > 1 else set()
        yield pa.record_batch([pa.array([x[k] for x in made], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def _compared(m: DataFrame, threshold: int, most: int | None) -> DataFrame:
    key = ("sig", "band", "lo", "hi")
    m = m.select(*key, "node", "n", "part", "bits", "block", "own").repartition(*key).sortWithinPartitions(*key, "node")
    return m.mapInArrow(_compare(threshold, most), "a long, b long").distinct()


def some_across(members: DataFrame, bits: DataFrame, threshold: int, most: int, salt: int, least: int, block: int = BLOCK) -> DataFrame:
    """Likely pairs (a, b) of different parts among members (sig, node, n, part) of groups of more than `least`: of each member at most so many, within blocks that the salt deals."""
    count = members.groupBy("sig").agg(F.count("*").alias("c")).where(F.col("c") > least).select("sig", F.ceil(F.col("c") / F.lit(block)).cast("int").alias("blocks"))
    m = members.join(count, "sig").withColumn("block", F.pmod(F.xxhash64("node", F.lit(salt)), F.col("blocks")).cast("int")).join(bits, "node")
    return _compared(m.withColumns({"band": F.lit(0), "lo": F.col("block"), "hi": F.col("block"), "own": F.lit(True)}), threshold, most)


def all_across(members: DataFrame, bits: DataFrame, threshold: int, block: int = BLOCK) -> DataFrame:
    """All likely pairs (a, b) of different parts among members (sig, node, n, part) of a signature.

    Groups of one block are compared as they are. Of larger ones, sizes that can link lie in
    one band or in two next to each other: a band meets itself and the one below. Of a band's
    group the members of its largest part do not meet each other: blocks of the rest meet the
    rest's and the largest part's blocks, each such pair of blocks a group of its own.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / threshold)) + 1e-9).cast("int") if threshold < 100 else F.col("n")
    m = members.join(members.groupBy("sig").agg(F.count("*").alias("c")), "sig").withColumn("of", F.when(F.col("c") > block, band).otherwise(0))
    m = m.withColumn("band", F.explode(F.when(F.col("c") > block, F.array(F.col("of"), F.col("of") + 1)).otherwise(F.array(F.lit(0))))).withColumn("own", F.col("of") == F.col("band")).drop("c")
    # groupwise counts, summed map-side: of parts, then of the group
    parts = m.groupBy("sig", "band", "part").agg(F.count("*").alias("c"), F.max("own").alias("any"))
    group = parts.groupBy("sig", "band").agg(F.max(F.struct("c", "part")).alias("top"), F.sum("c").alias("all"), F.max("any").alias("any"), F.count("*").alias("parts"))
    rest = F.col("all") - F.col("top.c")
    one = F.col("all") <= block
    group = group.where("any and parts > 1").select("sig", "band", F.col("top.part").alias("big"), F.ceil(rest / F.lit(block)).cast("int").alias("few"), F.when(one, 0).otherwise(F.ceil(F.col("top.c") / F.lit(block))).cast("int").alias("many"))
    m = m.join(group, ["sig", "band"]).withColumn("in", (F.col("part") == F.col("big")) & (F.col("many") > 0))
    m = m.withColumn("block", F.when(F.col("in"), F.col("few") + F.pmod(F.xxhash64("node"), F.greatest(F.col("many"), F.lit(1)))).otherwise(F.pmod(F.xxhash64("node"), F.col("few"))).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("in"), F.col("few") - 1).otherwise(F.col("few") + F.col("many") - 1))))
    return _compared(m.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).join(bits, "node"), threshold, None)


def linked(signed: DataFrame, nodes: DataFrame, check: Callable[[DataFrame], DataFrame], threshold: int, small_group: int = SMALL_GROUP) -> DataFrame:
    """Links (a, b) among the nodes (node, n, bits) of DEALT rows; check keeps those pairs that link.

    Links between nodes that others already join may be absent.
    """
    dealt = signed.repartition("key").sortWithinPartitions("key", "q", "n", "x")
    found = materialise(dealt.mapInArrow(_pairs(threshold, small_group), DEALT).drop("key"), "candidates")
    pairs = found.where(F.col("kind") == PAIR).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    pairs = materialise(pairs, "pairs")
    big = materialise(found.where(F.col("kind") == MEMBER).select(F.col("x").alias("sig"), F.col("y").alias("node"), "n").distinct(), "big")
    # of the nodes that meet any other; most meet none
    meet = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(big.select("node")).distinct()
    one = materialise(nodes.groupBy("node").agg(F.first("n").alias("n"), F.first("bits").alias("bits")).join(meet, "node", "left_semi"), "bitmaps")
    likely = materialise(possible(pairs, one, threshold), "likely")
    links = materialise(check(likely), "links")
    discard(likely, found)
    if not big.limit(1).count():
        discard(one, big)
        return links
    # first a few pairs of each member, dealt anew where there are many blocks, which join most of what belongs together, then all that are still open
    bits = one.select("node", "bits")
    for salt, least in ((0, 4 * FEW), (1, BLOCK), (None, 0)):
        part = connected_components(links, "parts")
        member = materialise(big.join(part, "node", "left").select("sig", "node", "n", F.coalesce("component", "node").alias("part")), "members")
        # near copies share many signatures: groups are merged by their smallest node, so that each pair is compared once, not once a signature
        split = member.groupBy("sig").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.min("node").alias("lead")).where("lo <> hi")
        open_ = materialise(member.join(split.select("sig", "lead"), "sig").select(F.col("lead").alias("sig"), "node", "n", "part").distinct(), "open")
        across = all_across(open_, bits, threshold) if salt is None else some_across(open_, bits, threshold, FEW, salt, least)
        more = materialise(across.join(pairs, ["a", "b"], "left_anti"), "more")
        none_open = not open_.limit(1).count()
        discard(member, open_)
        if none_open:
            break
        if not more.limit(1).count():
            continue
        pairs = pairs.union(more)
        links, before = materialise(links.union(check(more)), "all-links"), links
        discard(before)
    discard(one, big)
    return links


def placed_rows(docs: DataFrame, text_col: str, id_col: str, threshold: int, most_frequent: int, small_group: int) -> DataFrame:
    """One row per row of docs: id, at (hash of id and text), n_shingles, part (a node of its component; null without shingles)."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    survey = docs.select(F.col(id_col).alias("id"), row_hash(text_col, id_col).alias("at"), text_bytes(text_col).alias("text"))
    survey = materialise(survey.mapInArrow(_survey, f"kind byte, id {kind}, at long, node long, n long, bits binary, token long, seen long"), "survey")
    nodes = survey.where(F.col("kind") == DOCUMENT)
    sent = spark.sparkContext.broadcast(frequent_tokens(survey, most_frequent))

    def check(pairs: DataFrame) -> DataFrame:
        return verify(pairs, nodes.select("node", "at"), docs, text_col, id_col, threshold)

    signed = docs.select(text_bytes(text_col).alias("text")).mapInArrow(_sign(sent, threshold, small_group), DEALT)
    links = linked(signed, nodes.where("node is not null").select("node", "n", "bits"), check, threshold, small_group)

    part = connected_components(links, "last")
    placed = nodes.join(part, "node", "left").select("id", "at", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("part"))
    out = materialise(placed, "placed")
    discard(survey)
    return out


def join(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: int = THRESHOLD, most_frequent: int = FREQUENT_TOKENS, small_group: int = SMALL_GROUP) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id (smallest id reachable by links)."""
    placed = placed_rows(docs, text_col, id_col, threshold, most_frequent, small_group)
    least = placed.where("part is not null").groupBy("part").agg(F.min("id").alias("component_id"))
    some = placed.where("part is not null").join(least, "part").select("id", "n_shingles", "component_id")
    return some.union(placed.where("part is null").select("id", "n_shingles", F.col("id").alias("component_id")))


def one_of_each(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: int = THRESHOLD, most_frequent: int = FREQUENT_TOKENS, small_group: int = SMALL_GROUP) -> DataFrame:
    """The rows of docs that stay, with their columns: of each component the row of the smallest id (a null id only if all are null), and all rows without shingles.

    Rows are told apart by id and text; of rows alike in both one stays.
    """
    placed_all = placed_rows(docs, text_col, id_col, threshold, most_frequent, small_group)
    placed = placed_all.where("part is not null")
    best = placed.groupBy("part").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "at")).alias("best"))
    rows = placed.join(best, "part").groupBy("id", "at").agg(F.max(F.col("id").eqNullSafe(F.col("best.id")) & (F.col("at") == F.col("best.at"))).alias("stays"), F.count("*").alias("n"))
    rows = materialise(rows.where("not stays or n > 1").withColumnRenamed("at", "mark"), "verdicts")
    discard(placed_all)
    named = [c for c in docs.columns]
    hashed = lambda d: row_hash(d.columns[named.index(text_col)], d.columns[named.index(id_col)])
    return drop_rows(docs, rows.where("not stays").select("id", "mark"), id_col, hashed, rows.where("stays").select("id", "mark"))


def op2_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return join(docs).withColumnRenamed("id", "doc_id")
