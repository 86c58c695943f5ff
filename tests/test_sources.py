from __future__ import annotations

import bz2

import pytest
from pyspark.errors import PySparkException

from sievestone.operators import evaluation, graph
from sievestone.sources import readers, sinks

DUMP = """<mediawiki>
<page><title>Moon</title><ns>0</ns><id>1</id><revision><id>10</id><timestamp>2020-01-01</timestamp><sha1>a</sha1><text>The [[Tide]].</text></revision></page>
<page><title>Luna</title><ns>0</ns><id>2</id><redirect title="Moon" /><revision><id>11</id><timestamp>t</timestamp><sha1>b</sha1><text>#REDIRECT [[Moon]]</text></revision></page>
<page><title>Talk:Moon</title><ns>1</ns><id>3</id><revision><id>12</id><text>x</text></revision></page>
<page><title>Empty</title><ns>0</ns><id>4</id><revision><id>13</id></revision></page>
</mediawiki>"""


def test_wiki_scan(spark, tmp_path):
    (tmp_path / "dump.xml.bz2").write_bytes(bz2.compress(DUMP.encode()))
    got = [(r.page_id, r.title, r.redirect_target) for r in readers.wiki_pages(spark, str(tmp_path / "dump.xml.bz2")).orderBy("page_id").collect()]
    assert got == [(1, "Moon", None), (2, "Luna", "Moon")]


def test_json_lines_and_keys(spark, tmp_path):
    df = spark.createDataFrame([(1, "wiki"), (2, "wiki")], "id long, kind string")
    sinks.write_json_lines(df, str(tmp_path / "rows"))
    assert readers.json_lines(spark, str(tmp_path / "rows"), df.schema, {"kind": "wiki"}).count() == 2
    with pytest.raises(PySparkException):
        readers.json_lines(spark, str(tmp_path / "rows"), df.schema, {"kind": "web"}).collect()
    assert readers.unique_by(df, "id") is df
    with pytest.raises(ValueError):
        readers.unique_by(df, "kind")


def test_manifest(spark, tmp_path):
    df = spark.range(20).withColumnRenamed("id", "k")
    path = str(tmp_path / "t")
    sinks.write_table(df, path)
    with pytest.raises(PySparkException):
        sinks.write_table(df, path)
    have = sinks.manifest(spark, path).collect()
    good = spark.createDataFrame(have)
    assert readers.verified(spark, path, good, spark.read.parquet).count() == 20
    bad = spark.createDataFrame([(r.name, r.bytes, "0" * 64) for r in have], good.schema)
    with pytest.raises(ValueError):
        readers.verified(spark, path, bad, spark.read.parquet)


def test_content_delta_and_journal(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k long, v string")
    b = spark.createDataFrame([(2, "y"), (3, "w"), (4, "q")], "k long, v string")
    assert sinks.same_content(a, a.orderBy("v").repartition(3)) and not sinks.same_content(a, b)
    assert sorted(tuple(r) for r in sinks.delta(a, b, "k", "v").collect()) == [(1, "removed"), (3, "changed"), (4, "added")]
    entries = sinks.chain_entries([{"n": i} for i in range(4)])
    j = spark.createDataFrame(entries, "sequence long, previous_hash string, payload string, entry_hash string")
    assert sinks.verify_chain(j).count() == 0
    entries[2]["payload"] = '{"n":9}'
    assert sinks.verify_chain(spark.createDataFrame(entries, j.schema)).count() == 1
    assert sinks.latest(a.unionByName(spark.createDataFrame([(1, "zz")], a.schema)), "k", "v").where("k = 1").first()["v"] == "zz"


def test_routed(spark, tmp_path):
    df = spark.createDataFrame([(1, 5), (2, 50), (3, None)], "k long, v int")
    sinks.routed(df, {"low": "v < 10", "high": "v >= 10"}, ["k"], str(tmp_path / "r"))
    got = spark.read.parquet(str(tmp_path / "r"))
    assert {r.k: r.route for r in got.collect()} == {1: "low", 2: "high", 3: "quarantine"}


def test_graph(spark):
    r = spark.createDataFrame([("a", "b"), ("b", "C"), ("x", "y"), ("y", "x"), ("m", "C"), ("m", "D"), ("n", "m"), ("q", "none")], "surface string, target string")
    got = {x.surface: (x.target, x.state) for x in graph.resolve_redirects(r, spark.createDataFrame([("C",), ("D",)], "title string")).collect()}
    assert got == {"a": ("C", "canonical"), "b": ("C", "canonical"), "x": (None, "redirect_cycle"), "y": (None, "redirect_cycle"), "m": (None, "ambiguous"), "n": (None, "ambiguous"), "q": (None, "missing")}
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "a long, b long")
    n = spark.range(1, 8).withColumnRenamed("id", "node")
    c = graph.components(e, n)
    assert {x.node: x.component for x in c.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7}
    shards = {x.component: x.shard for x in graph.shard_components(c, 2).collect()}
    assert sorted(shards.items()) == [(1, 0), (4, 1), (5, 0), (7, 1)]
    loop = spark.createDataFrame([(1, 2), (2, 1)], "parent long, child long")
    with pytest.raises(ValueError):
        graph.topological_depth(loop, n, most_depth=4)
    assert {x.node: x.depth for x in graph.traverse(spark.createDataFrame([(1,)], "node long"), e.toDF("source", "target"), 2).collect()} == {1: 0, 2: 1, 3: 2}


def test_isotonic(spark):
    b = spark.createDataFrame([(0, 0.1, 2), (1, 0.5, 1), (2, 0.2, 1), (3, 0.9, 4)], "bin long, accuracy double, n long")
    assert [round(r.fitted, 3) for r in evaluation.isotonic(b, "bin", "accuracy", "n").orderBy("bin").collect()] == [0.1, 0.35, 0.35, 0.9]


def test_sessions_of_many_frames_go_by_time(spark, tmp_path):
    """A user's events of one batch come in several frames when they are more than a batch holds."""
    import random

    from sievestone.streaming import events

    rng = random.Random(9)
    rows = [(i, 1_700_000_000 + i // 2, u, "abc"[rng.randrange(3)] if i < 2900 or u else "a") for u in (0, 1) for i in range(3000)]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "event_id long, at long, user_id long, event_type string").selectExpr("event_id", "timestamp_seconds(at) AS ts", "user_id", "event_type").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, 100)
    got = {r.user_id: (r.recent, r.stalls, r.n) for r in events.run_to_table(events.bounded_sessions(events.read_events(spark, str(tmp_path))), f"{tmp_path}/out", f"{tmp_path}/state", "update").collect()}
    spark.conf.set(key, was)
    for u in (0, 1):
        kinds = [r[3] for r in sorted(rows) if r[2] == u]
        run = next((k for k, x in enumerate(reversed(kinds)) if x != kinds[-1]), len(kinds))
        assert got[u] == (",".join(kinds[-16:]), run - 1, 3000)
