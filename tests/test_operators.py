from __future__ import annotations

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievestone.operators import answering, evaluation, vectors


def test_walsh_hadamard_keeps_products(spark):
    x = np.random.default_rng(0).normal(size=(6, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = np.array([r.w for r in df.select("id", vectors.walsh_hadamard(F.col("v")).alias("w")).orderBy("id").collect()])
    assert np.allclose(got @ got.T, x @ x.T)


def test_greedy_diversity(spark):
    rng = np.random.default_rng(4)
    rows = [(g, g * 100 + i, round(float(rng.random()) * 0.2, 6), "abc"[int(rng.integers(3))]) for g in range(5) for i in range(12)]
    got = {}
    for r in answering.greedy_diversity(spark.createDataFrame(rows, "g long, i long, s double, f string"), "g", "i", "s", "f", 3).collect():
        got.setdefault(r.g, {})[r.step] = r.i
    for g, own in itertools.groupby(rows, key=lambda r: r[0]):
        left, seen, want = list(own), set(), []
        while len(want) < 3:
            best = max(left, key=lambda r: (r[2] + (0.06 if r[3] not in seen else 0), -r[1]))
            left.remove(best)
            seen.add(best[3])
            want.append(best[1])
        assert [got[g][k] for k in (1, 2, 3)] == want


def test_int8_and_hamming(spark):
    codes, scale = vectors.int8(F.col("v"))
    r = spark.createDataFrame([([0.5, -1.0, 0.0],)], "v array<double>").select(codes.alias("c"), scale.alias("s"), vectors.sign_code(F.col("v")).alias("k")).first()
    assert (r.c, r.k) == ([64, -127, 0], 0b101) and abs(r.s - 1 / 127) < 1e-12


def test_long_redirect_chains_and_cycles(spark):
    from sievestone.operators import graph

    chain = [(f"s{i}", f"s{i + 1}") for i in range(40)] + [("a", "b"), ("b", "c"), ("c", "a"), ("x", "a"), ("lost", "nowhere")]
    got = {r.surface: (r.target, r.state, r.hops) for r in graph.resolve_redirects(spark.createDataFrame(chain, "surface string, target string"), spark.createDataFrame([("s40",)], "title string")).collect()}
    assert all(got[f"s{i}"] == ("s40", "canonical", 40 - i) for i in range(40))
    assert all(got[k][1] == "redirect_cycle" for k in "abcx") and got["lost"][1] == "missing"


def test_code_pairs_are_all_pairs_within_three_bits_once(spark):
    rng = random.Random(5)
    codes = [rng.getrandbits(64) for _ in range(60)]
    codes += [c ^ sum(1 << b for b in rng.sample(range(64), k)) for c in codes[:40] for k in (1, 3, 4)]
    rows = [(i, c - (1 << 64) if c >> 63 else c) for i, c in enumerate(codes)]
    got = sorted(tuple(r) for r in vectors.code_pairs(spark.createDataFrame(rows, "id long, code long"), "id").collect())
    assert got == sorted((i, j, n) for i in range(len(codes)) for j in range(i + 1, len(codes)) if (n := (codes[i] ^ codes[j]).bit_count()) <= 3)


def test_simhash64(spark):
    rows = [(["a", "b", "c"],), ([],), (None,), (["a"],)]
    heads = [int(hashlib.sha256(x.encode()).hexdigest()[:16], 16) for x in "abc"]
    want = sum(1 << i for i in range(64) if sum(1 if h >> i & 1 else -1 for h in heads) >= 0)
    got = [r[0] for r in spark.createDataFrame(rows, "w array<string>").select(vectors.simhash64(F.col("w"))).collect()]
    assert [g % (1 << 64) for g in got] == [want, (1 << 64) - 1, (1 << 64) - 1, heads[0]]


def test_query_blocks_give_what_one_block_gives(spark):
    rng = random.Random(3)
    e = spark.createDataFrame([(i, [rng.random() for _ in range(4)]) for i in range(40)], "vec_id long, embedding array<double>")
    one, many = (sorted(map(tuple, vectors.top_dot(e, e.where("vec_id < 20"), 3, block=b).collect())) for b in (100, 6))
    assert len(one) == 60 and one == many
    assert vectors.top_dot(e, e.where("vec_id < 0"), 3).count() == 0


def test_percentiles_of_small_and_level_groups(spark):
    rows = [("a", 1.0, 1), ("b", 2.0, 2), ("b", 2.0, 3), *(("c", float(i), i) for i in range(100))]
    out = {r[0]: tuple(r)[1:] for r in evaluation.percentiles(spark.createDataFrame(rows, "g string, v double, i long"), "g", "v", "i", 0.95).collect()}
    assert out["a"] == (1.0, 1.0, 1.0) and out["b"] == (2.0, 2.0, 2.0)
    assert out["c"] == (94.0, pytest.approx(94.05), 94.0)


@pytest.fixture
def merged_differently(spark):
    """Small partitions, which Spark merges as their bytes tell: narrow and wide reads of one deal differ."""
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    was = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark.range(5000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("wide"), (F.col("id") % 3 == 0).alias("ok"), (F.col("id") / 5000).alias("score")).repartition(7)
    for k, v in was.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_ranks_across_ranges_have_no_gap(merged_differently):
    got = evaluation.global_rank(merged_differently, [F.col("id")]).select("id", "rank", "wide").collect()
    assert sorted((r.id, r.rank) for r in got) == [(i, i + 1) for i in range(5000)]


def test_token_set_heads_meet_for_every_near_pair(spark):
    """All pairs of different sets at 0.9, sizes at its edge too; only heads are shuffled, never whole sets."""
    from sievestone.functions import text as T

    rng = random.Random(11)
    sets = [{f"t{rng.randrange(60)}" for _ in range(rng.randrange(1, 50))} for _ in range(60)]
    sets += [(s - set(rng.sample(sorted(s), min(k, len(s) - 1)))) | {f"n{i}"} for i, s in enumerate(sets) for k in (0, 1, 2)] + [sets[0], set()]
    sets += [{f"u{i}" for i in range(m)} for n in (9, 10, 18, 27, 63, 70) for m in (n, n + n // 9)]
    df = spark.createDataFrame([(i, " ".join(rng.sample(sorted(s), len(s)))) for i, s in enumerate(sets)] + [(999, None)], "doc_id long, text string")
    heads = vectors.token_set_heads(df, T.SIMPLE_TOKEN, "doc_id", "text")
    first = {frozenset(s): i for i, s in reversed(list(enumerate(sets))) if s}
    assert {r.doc_id: (r.n, len(r["head"])) for r in heads.collect()} == {i: (len(s), len(s) - -(-9 * len(s) // 10) + 1) for s, i in first.items()}
    got = [tuple(r) for r in vectors.head_pairs(heads).collect()]
    want = {(i, j) for s, i in first.items() for r, j in first.items() if i < j and 10 * len(s & r) >= 9 * len(s | r)}
    assert len(want) > 60 and want <= set(got) and len(got) == len(set(got))


def test_equal_frequency_bins_hold_every_tenth(merged_differently):
    got = sorted(tuple(r)[:3] for r in evaluation.equal_frequency_bins(merged_differently, "score", "id", "ok").collect())
    assert got == [(b, 500, pytest.approx((500 * b + 499) / 5000)) for b in range(10)]
