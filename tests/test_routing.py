from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import functions as F

from sievestone.operators import addressing, hypervectors, learning, retrieval, routing


def proposal(expert, gain, macs=1.0, reads=1.0, needs=()):
    return {"expert": expert, "gain": gain, "macs": macs, "reads": reads, "dependencies": list(needs)}


def test_route_groups():
    offers = [proposal("a", 0.9), proposal("b", 0.8, macs=9.0), proposal("c", 0.7), proposal("d", 0.95, needs=["a"]), proposal("e", 0.1, needs=["nobody"])]
    assert routing.route_groups(offers, macs=5, reads=5, cycles=4, parallel=2) == [["a", "c"], ["d"]]
    assert routing.route_groups(offers, macs=5, reads=5, cycles=1, parallel=1) == [["a"]]
    assert routing.route_groups(offers, macs=0, reads=5, cycles=4, parallel=2) == []
    assert routing.route_groups([], 1, 1, 1, 1) == []


def test_budget_routes_reasons(spark):
    rows = [(1, "a", 0.5, 1.0, 1.0, None), (1, "b", 0.5, 1.0, 1.0, ["a"]), (2, "a", 0.01, 1.0, 1.0, []), (3, "a", 0.5, 100.0, 1.0, [])]
    p = spark.createDataFrame(rows, "workspace long, expert string, gain double, macs double, reads double, dependencies array<string>")
    got = {r.workspace: (r.route, r.experts, r.reason) for r in routing.budget_routes(p, 10, 10, 3, 2, 0.1).collect()}
    assert got == {1: ("a>b", 2, "route_selected"), 2: ("", 0, "expected_gain_below_gate"), 3: ("", 0, "compute_budget_exhausted")}
    assert {r.reason for r in routing.budget_routes(p, 10, 10, 0, 2, 0.1).collect()} == {"cycle_bound_reached"}
    assert routing.budget_routes(p.limit(0), 10, 10, 3, 2, 0.1).count() == 0


def test_bounded_fill_skips_and_goes_on(spark):
    rows = [("q", 1, 0.9, ["s1", "s2"], ["x"]), ("q", 2, 0.8, ["s3", "s4"], ["x"]), ("q", 3, 0.7, ["s2", "s3"], ["x"]), ("r", 4, 0.1, [], [])]
    df = spark.createDataFrame(rows, "g string, i long, p double, s array<string>, e array<string>")
    got = {r.g: r for r in routing.bounded_fill(df, "g", "i", [F.desc("p")], "s", "e", max_spans=3).collect()}
    assert got["q"].items == [1, 3] and got["q"].spans == ["s1", "s2", "s3"] and got["r"].items == [4]


def vector(symbol):
    return b"".join(hashlib.sha256(f"{i}:{symbol}".encode()).digest() for i in range(4))


def test_hypervectors_against_whole_numbers(spark):
    rows = [(1, ["Red", "blue", "green", "red"]), (2, ["red", "blue"]), (3, []), (4, None)]
    df = spark.createDataFrame(rows, "id int, w array<string>").withColumn("v", hypervectors.encode_terms(F.col("w")))
    got = {r.id: int.from_bytes(r.v, "big") for r in df.collect()}

    def brute(words):
        held = [int.from_bytes(vector(w), "big") for w in words]
        out = 0
        for bit in range(1024):
            twice = 2 * sum(h >> bit & 1 for h in held)
            if twice > len(held) or (held and twice == len(held) and int.from_bytes(vector(f"tie:{bit}"), "big") & 1):
                out |= 1 << bit
        return out

    assert got == {1: brute(["red", "blue", "green"]), 2: brute(["red", "blue"]), 3: 0, 4: 0}
    two = spark.createDataFrame([(vector("a"), vector("b"), 0), (vector("a"), None, 1)], "a binary, b binary, o int")
    r, null = two.select("o", hypervectors.bind(F.col("a"), F.col("b")).alias("x"), hypervectors.permute(F.col("a"), 5).alias("p"), hypervectors.similarity(F.col("a"), F.col("b")).alias("s")).orderBy("o").collect()
    a, b = (int.from_bytes(vector(s), "big") for s in "ab")
    assert int.from_bytes(r.x, "big") == a ^ b and r.s == 1 - (a ^ b).bit_count() / 1024 and null.x is None and null.s is None
    assert int.from_bytes(r.p, "big") == (a << 5 | a >> 1019) & (1 << 1024) - 1


def test_reduced_codes(spark):
    x = np.random.default_rng(2).normal(size=(50, 6)) * np.arange(1, 7)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    codes, scales = learning.reduced_int8(df, 3)
    got = np.array([r.codes for r in codes.orderBy("vec_id").collect()])
    assert got.shape == (50, 3) and (np.abs(got).max(axis=0) == 127).all()
    axes = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][:3]
    want = (x - x.mean(axis=0)) @ axes.T
    assert np.allclose(np.abs(got * scales), np.abs(want), atol=np.abs(want).max() / 60)
    assert learning.reduced_int8(df.limit(0), 3)[0].count() == 0


def test_folded_quotations_and_bins(spark):
    rows = [(1, "ann", "To  BE\nor not"), (2, None, "to be"), (3, "bob", ""), (4, "bob", None)]
    df = spark.createDataFrame(rows, "id int, speaker string, quotation string")
    assert [r.id for r in addressing.attributed(df, " to be ").collect()] == [1]
    edges = [(0.2, 0.1), (0.5, 0.6)]
    got = spark.createDataFrame([(0.2,), (0.21,), (0.9,)], "s double").select(addressing.binned(F.col("s"), edges).alias("p"), addressing.binned(F.col("s"), []).alias("z")).collect()
    assert [(r.p, r.z) for r in got] == [(0.1, 0.0), (0.6, 0.0), (0.6, 0.0)]


def test_weighted_search_prefers_titles(spark):
    units = spark.createDataFrame([("a", "cat", "one two"), ("b", "dog", "cat two"), ("c", "cow", None), *((f"d{i}", "hen", "x y") for i in range(6))], "id string, title string, body string")
    q = spark.createDataFrame([(1, "cat"), (2, ""), (3, "none")], "q long, t string")
    got = {(r.q, r.id): r.score for r in retrieval.weighted_bm25(units, q, "id", {"title": 1.8, "body": 1.0}, "q", "t").collect()}
    assert set(got) == {(1, "a"), (1, "b")} and got[1, "a"] > got[1, "b"] > 0
