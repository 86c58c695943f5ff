"""The queries over claims against brute force, over users of every id."""

from __future__ import annotations

import collections
import datetime

import numpy as np
import pytest

from sievestone.plans.registry import QUERIES


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    rng = np.random.default_rng(6)
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(minutes=int(rng.integers(9999))), int(rng.choice([3, 39, 40, 41, 977, 1499])), "abc"[int(rng.integers(3))], float(rng.integers(0, 90)) + 0.25) for i in range(400)]
    top = str(tmp_path_factory.mktemp("claims"))
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{top}/events.parquet")
    return top, [(i, u, k, int(v), i % 7, ts) for i, ts, u, k, v in rows]


def of(spark, top, name, *columns):
    return collections.Counter(tuple(r[c] for c in columns) for r in QUERIES[name](spark, top).collect())


def test_contradictions(spark, events):
    top, claims = events
    families = collections.defaultdict(set)
    for _, u, k, o, f, _ in claims:
        families[u, k, o].add(f)
    want = {(*a, b[2]) for a in families for b in families if a[:2] == b[:2] and a[2] < b[2] and families[a] != families[b]}
    assert of(spark, top, "contradiction_pairs", "subject", "relation", "object_a", "object_b") == collections.Counter(want)


def test_summaries_and_lineages(spark, events):
    top, claims = events
    own, first = collections.defaultdict(list), {}
    for i, u, k, o, f, ts in claims:
        own[u, k].append((o, f))
        first[u, k, f] = min(first.get((u, k, f), (ts, i)), (ts, i))
    want = {(*key, len({o for o, _ in v}), len({f for _, f in v}), min(v)[0], max(v)[0]) for key, v in own.items()}
    assert of(spark, top, "value_summaries", "subject", "relation", "n_values", "n_families", "least", "most") == collections.Counter(want)
    assert of(spark, top, "lineage_dedup", "claim_id", "subject", "relation", "family") == collections.Counter((i, *key) for key, (_, i) in first.items())


def test_comparisons(spark, events):
    top, claims = events
    want = set()
    for k in "abc":
        best = sorted((-o, i, u) for i, u, kind, o, *_ in claims if kind == k)[:4]
        pairs = [(k, best[a][2], best[b][2], int(best[a][0] < best[b][0])) for a in range(4) for b in range(a + 1, 4) if best[a][2] != best[b][2]]
        want |= set(pairs[:1])
    assert of(spark, top, "comparison_pairs", "relation", "subject_a", "subject_b", "direction") == collections.Counter(want)
