"""Corpus operators against SQL, brute force and the edge cases their docstrings define."""

from __future__ import annotations

import collections
import hashlib
import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievestone.llm import _common, bin_packing, chat_format, exact_dedup, language_id, license_scan, line_dedup, ngram_join, quality_rules, registry, source_mixing, substring_dedup

from ..duck import rows, same

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, id long, row string, host string, weight string, _digest0 string"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x20\x09-\x0d]+")


def edge(spark, n: int | None = None):
    """Nulls, empty and long texts, ties, repeated rows, and further columns with clashing names."""
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(400)]
    base = " ".join(rng.choice(vocab, 90))
    near = base.replace(base.split()[40], "changed", 1)
    long = " ".join(rng.choice(vocab, 30_000))
    line = "this line stands in many documents of the table"
    texts = [None, "", " \n ", base, base, base.upper(), near, long, f"{line}\n{base[:200]}\nx", f"  {line.title()} \nown words here", f"{line}\n{line}", "MIT License and the GNU General Public License", "ß ÄÖ ß", "a"]
    out = [(i, t, ["en", None, "de"][i % 3], ["s", None, "t"][i % 3], None, "d", i, "r", "h", "w", "z") for i, t in enumerate(texts)]
    out += [out[3], out[3], (None, base, None, None, None, *out[0][5:]), (None, None, None, None, None, *out[0][5:])]
    return spark.createDataFrame(out[:n] if n is not None else out, SCHEMA)


def brute_components(docs):
    sets = [(i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := WORD.findall((t or "").translate(FOLD))) else frozenset()) for i, t in docs]
    of = list(range(len(sets)))

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                of[find(a)] = find(b)
    least = {}
    for k, (i, s) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return collections.Counter((i, len(s), least.get(find(k)) if s else i) for k, (i, s) in enumerate(sets))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, sf_dir, name):
    same(registry.QUERIES[name](spark, sf_dir), registry.ORACLES[name], sf_dir)


def test_empty_tables(spark):
    d = edge(spark, 0)
    assert license_scan.labelled(license_scan.scan(d)).count() == 0
    assert ngram_join.join(d).count() == 0 and ngram_join.one_of_each(d).count() == 0
    assert bin_packing.pack_documents(d).count() == 0
    assert substring_dedup.repeated_spans(d).count() == 0
    assert language_id.identify(d, language_id.learn(d)).count() == 0
    assert line_dedup.deduplicate_lines(d).count() == 0
    assert quality_rules.judge(d).count() == 0
    assert exact_dedup.judged(d).count() == 0 and exact_dedup.deduplicate(d).count() == 0
    assert source_mixing.sample(d).count() == 0
    assert chat_format.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_license_scan(spark):
    d = edge(spark)
    got = {r.id: r for r in license_scan.labelled(license_scan.scan(d)).collect()}
    assert (got[11].n_base, got[11].first_word, got[11].last_word, got[11].base_labels) == (2, 0, 5, "gpl,mit")
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].labels, got[1].score) == (0, 0, None, "", 0.0)
    text = " junk ".join([license_scan.TEMPLATES["isc"], "x", license_scan.TEMPLATES["mit"][:300]])
    r = license_scan.labelled(license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert "isc" in r.labels.split(",") and r.score == 1.0 and r.n_base == 0


def test_license_scan_by_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_scan.op1_license_scan(spark, sf_dir).collect()}
    for r in docs:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", r.text.translate(FOLD))
        at = [(i, label) for p, label in license_scan.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        places = [i for i, _ in at]
        assert got[r.doc_id] == (len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at})))


def test_matching_statistics():
    s = license_scan.Scanner({}, {"t": "a b c d e f"}, 2, 3, 0.5)
    places, runs = s.matches("x b c d y e f a b".encode().split())
    assert places == [] and [(a, n) for a, n, _ in runs] == [(1, 3), (5, 2), (7, 2)]
    assert s.spans(runs) == [("t", 1, 7, 5 / 6)]


@pytest.mark.parametrize("small", [2, 8])
def test_ngram_join_by_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(ngram_join, "LEAST_IN_BATCH", 3)
    rng = np.random.default_rng(5)
    words = [f"v{i}" for i in range(3000)]
    docs = []
    for g in range(12):
        base = list(rng.choice(words, int(rng.integers(3, 120))))
        for _ in range(int(rng.integers(1, 14))):
            own = list(base)
            for _ in range(int(rng.integers(0, 4))):
                own[int(rng.integers(len(own)))] = str(rng.choice(words))
            docs.append(" ".join(own))
    hot = " ".join(rng.choice(words, 40))
    docs += [hot + " " + " ".join(rng.choice(words, int(rng.integers(1, 14)))) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string").repartition(2)
    got = collections.Counter((r.id, r.n_shingles, r.component_id) for r in ngram_join.join(df, small_group=small).collect())
    assert got == brute_components(list(enumerate(docs)))


def test_ngram_join_of_edge_cases(spark):
    d = edge(spark)
    got = collections.Counter((r.id, r.n_shingles, r.component_id) for r in ngram_join.join(d).collect())
    assert got == brute_components([(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()])
    kept = ngram_join.one_of_each(d)
    assert kept.columns == d.columns and {4, 5}.isdisjoint(r.doc_id for r in kept.collect())


def test_one_of_each_tells_rows_apart_by_id_and_text(spark):
    rng = np.random.default_rng(6)
    w = lambda: " ".join(f"u{x}" for x in rng.integers(0, 10**9, 60))
    copied, other, alone, null, shared = (w() for _ in range(5))
    d = spark.createDataFrame([(3, copied), (None, copied), (None, alone), (7, copied.upper()), (7, other), (8, other), (9, shared), (9, null), (9, null), (None, ""), (None, None)], "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.text) for r in ngram_join.one_of_each(d).collect())
    assert got == collections.Counter([(3, copied), (None, alone), (7, other), (9, shared), (9, null), (None, ""), (None, None)])


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(1)
    for n in (4, 30, 300, 5000):
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        for cut in (0, n // 12, n // 9):
            y = np.unique(np.concatenate([x[cut:], rng.integers(0, 2**63, cut).astype(np.uint64)]))
            both = len(np.intersect1d(x, y))
            if 100 * both >= 80 * (len(x) + len(y) - both):
                assert ngram_join.may_link(ngram_join.bitmap(x), len(x), ngram_join.bitmap(y), len(y))


def test_packing(spark):
    d = edge(spark)
    items = bin_packing.measured(d)
    got = bin_packing.pack(items, capacity=64, shard_docs=6, per_source=1).toPandas()
    tokens = collections.Counter()
    for r in items.collect():
        tokens[r.id] += r.n_tokens
    assert {(-1 if np.isnan(k) else k): v for k, v in got.fillna({"id": np.nan}).groupby("id", dropna=False).n_tokens.sum().items()} == {(-1 if k is None else k): v for k, v in tokens.items()}
    placed = got[got.bin.notna()]
    for _, b in placed.groupby(["shard", "bin"]):
        assert b.n_tokens.sum() <= 64 and not b.cluster.duplicated().any() and not b.source.duplicated().any()
        b = b.sort_values("bin_start")
        assert list(b.bin_start) == [0, *b.n_tokens.cumsum()[:-1]]


def test_best_fit_takes_the_tightest_compatible_bin():
    # residuals 3, 2 and 4; the tightest has the cluster, the next the source
    pieces = [(8, 0, 3), (7, 1, 4), (6, 2, 5)]
    assert bin_packing.best_fit([*pieces, (2, 7, 3)], 10, 1)[-1] == (1, 7)
    assert bin_packing.best_fit([*pieces, (2, 1, 3)], 10, 1)[-1] == (2, 6)
    assert bin_packing.best_fit([*pieces, (2, 1, 3)], 10, 2)[-1] == (1, 7)


def test_substrings(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = {r.doc_id for r in substring_dedup.op4_substring_dedup(spark, sf_dir).collect()}
    where = {n: collections.defaultdict(set) for n in (25, 51)}
    for r in docs.select("doc_id", "text").collect():
        h = _common.word_hashes(r.text.encode().translate(_common.FOLD).split())
        for n, own in where.items():
            for k in _common.shingle_sequence(h, n).tolist() if len(h) >= n else ():
                own[k].add(r.doc_id)
    shared = {n: set().union(*(v for v in own.values() if len(v) > 1)) for n, own in where.items()}
    assert shared[51] <= found


def test_substrings_of_edge_cases(spark):
    rng = np.random.default_rng(8)
    w = lambda n: " ".join(f"u{x}" for x in rng.integers(0, 10**9, n))
    passage, line = w(55), w(60)
    near = line.replace(line.split()[30], "other")
    d = spark.createDataFrame([(1, f"{w(40)} {passage} {w(30)}"), (2, f"{w(12)}\n{w(5)} {passage} {w(9)}"), (3, w(200)), (4, line), (5, f"{w(9)}\n{near}"), (6, None), (6, None), (7, "")], "doc_id long, text string")
    got = substring_dedup.repeated_spans(d).toPandas()
    assert set(got.id) == {1, 2, 4, 5} and set(got[got.removed].id) == {2, 5}
    kept = {r.id: r.kept_text for r in substring_dedup.remove_repeats(d).collect()}
    assert kept[1].count(" ") == 124 and len(kept[2].split()) <= 26 + 30 and kept[3].count(" ") == 199 and kept[6] == ""


def test_substrings_cover_the_whole_repeat(spark):
    rng = np.random.default_rng(9)
    w = lambda n: " ".join(f"u{x}" for x in rng.integers(0, 10**9, n))
    docs, planted = [], {}
    for k, n in enumerate((25, 30, 51, 55, 80, 200)):
        passage, before = w(n), int(rng.integers(5, 90))
        docs += [(2 * k, f"{w(33)} {passage} {w(21)}"), (2 * k + 1, f"{w(before)} {passage}\n{w(17)} {passage} {w(4)}")]
        planted |= {(2 * k, False): [(33, 33 + n)], (2 * k + 1, True): [(before, before + n), (before + n + 17, before + 2 * n + 17)]}
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = collections.defaultdict(list)
    for r in substring_dedup.repeated_spans(d).orderBy("first_word").collect():
        got[r.id, r.removed].append((r.first_word, r.end_word))
        assert r.kept_in == r.id // 2 * 2
    assert got == planted


def test_substrings_find_near_copies_inside_lines(spark):
    rng = np.random.default_rng(10)
    w = lambda n: [f"u{x}" for x in rng.integers(0, 10**9, n)]
    docs, want = [], {}
    for k in range(20):
        passage, before, at = w(60), int(rng.integers(5, 90)), int(rng.integers(25, 35))
        near = passage[:at] + [["other"], [], ["one", passage[at]]][k % 3] + passage[at + 1 :]
        docs += [(2 * k, " ".join(w(33) + passage + w(21))), (2 * k + 1, " ".join(w(before) + near + w(21)))]
        want[2 * k + 1] = (before, before + len(near), 2 * k)
    # two changed words: a similarity of 46/66, no repeat as a whole, and no run of 25 words
    far = w(60)
    docs += [(100, " ".join(w(30) + far + w(30))), (101, " ".join(w(30) + far[:20] + ["a"] + far[21:40] + ["b"] + far[41:] + w(30)))]
    # a near copy over short lines
    lines = w(80)
    docs += [(200, "\n".join(" ".join(lines[i : i + 8]) for i in range(0, 80, 8))), (201, " ".join(lines[:41] + ["c"] + lines[42:]))]
    want[201] = (0, 80, 200)
    got = substring_dedup.repeated_spans(spark.createDataFrame(docs, "doc_id long, text string")).where("removed").collect()
    assert {r.id: (r.first_word, r.end_word, r.kept_in) for r in got} == want and len(got) == len(want)


def test_chains_against_every_alignment():
    rng = np.random.default_rng(11)
    for _ in range(300):
        x = rng.integers(0, 2**62, 70).astype(np.uint64)
        a = int(rng.integers(1, 69))
        y = np.concatenate([x[:a], rng.integers(0, 2**62, int(rng.integers(0, 3))).astype(np.uint64), x[a + int(rng.integers(0, 2)) :]])
        own, other = _common.shingle_sequence(x), _common.shingle_sequence(y)
        if not substring_dedup.links(own, other, 80):
            continue
        width, among = substring_dedup.seed_shape(25, 80)
        seeds = [_common.shingle_sequence(v, width) for v in (x, y)]
        at = [{int(s[i]): i for i in substring_dedup.anchors(s, among).tolist()} for s in seeds]
        shifts = sorted({at[1][k] - i for k, i in at[0].items() if k in at[1]})
        found = substring_dedup.passages(own, other, shifts, 25, 80)
        same = np.isin(own, other)
        covered = np.zeros(len(own), dtype=bool)
        for p, n, *_ in found:
            covered[p : p + n - 4] = True
        assert shifts and (covered | ~same).sum() >= len(own) - 20


def test_language_id(spark, sf_dir):
    out = language_id.op5_language_id(spark, "/root/testdata/sf0.01").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas().merge(out, on="doc_id")
    held = docs[docs.held_out]
    assert len(held) > 150 and (held.lang == held.lang_pred).mean() > 0.95 and out.score.between(0, 1).all()
    learned = language_id.learn(language_id.training_rows(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")))
    d = edge(spark)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(d, learned).where("doc_id is not null").collect()}
    assert got[0] == got[1] == got[2] == ("und", 0.0) and got[12][0] != "und"
    assert language_id.accept(d, learned).columns == d.columns


@pytest.mark.parametrize("how", [{}, {"hot_keys": 4, "shard_keys": 16}])
def test_line_dedup(spark, sf_dir, how):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = line_dedup.deduplicate_lines(docs, **how)
    same(out.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")), line_dedup.OP6_SQL, sf_dir)


def test_line_dedup_of_edge_cases(spark):
    got = {r.id: r for r in line_dedup.deduplicate_lines(edge(spark)).where("id is not null").collect()}
    assert (got[0].n_lines, got[0].kept_text, got[1].kept_text) == (1, "", "")
    assert got[8].n_dropped == 1 and got[9].kept_text == "own words here" and got[10].n_dropped == 0


def test_perfect_hash():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64))
    h = line_dedup.PerfectHash.load(line_dedup.PerfectHash.build(keys, prints=keys * np.uint64(3), n=np.arange(len(keys))).dump())
    at = h.probe(keys, keys * np.uint64(3))
    assert sorted(at) == list(range(len(keys))) and (h.arrays["n"][at] == np.arange(len(keys))).all()
    other = keys + np.uint64(1)
    assert (h.probe(other, other) == -1).all()


def test_quality_rules_of_edge_cases(spark):
    site = "a navigation line of this host that all its documents share with each other and it has far more words than any of the rest"
    d = spark.createDataFrame([(i, f"{site}\nown{i}", "h") for i in range(30)] + [(99, " ".join(f"w{i}" for i in range(40)), "h"), (100, None, None), (None, "", "h")], "doc_id long, text string, source string")
    got = {r.id: r for r in quality_rules.judge(d).collect()}
    assert not got[0].kept and got[0].depleted and not got[0].base_failed and got[99].kept
    assert got[100].base_failed and got[None].base_failed and got[100].host is None
    assert quality_rules.judge(edge(spark)).count() == edge(spark).count()


def test_exact_dedup_of_edge_cases(spark):
    d = edge(spark)
    got = exact_dedup.judged(d, heavy=1)
    by = collections.defaultdict(list)
    for r in d.collect():
        by[hashlib.sha256((r.text or "").translate(FOLD).encode()).digest()].append(r.doc_id)
    for r in got.collect():
        own = by[bytes(r.digest)]
        assert r.group_size == len(own) and r.keep_id == max((x for x in own if x is not None), default=None)
    assert got.where("kept").count() == len(by)
    out = exact_dedup.deduplicate(d)
    assert out.count() == len(by) and out.columns == d.columns and rows(exact_dedup.judged(d, heavy=2).drop("digest").toPandas()) == rows(got.drop("digest").toPandas())


def mixed(spark, n=3000):
    rng = np.random.default_rng(0)
    docs = [(i, " ".join(["t"] * int(rng.integers(1, 60))), "ab"[int(rng.integers(10) > 7)], "xy"[int(rng.integers(10) > 6)]) for i in range(n)] + [(None, None, None, None)]
    return spark.createDataFrame(docs, "doc_id long, text string, source string, lang string")


def test_mixing_meets_its_targets(spark):
    d = mixed(spark)
    targets = {"source": {"a": 0.5, "b": 0.5}, "lang": 0.0, "topic": 1.0}
    rows = source_mixing.counted(d, [])
    cells = source_mixing.calibrated(rows, targets, keep=0.2)
    for r in source_mixing.residuals(cells, list(targets)).collect():
        assert r.residual < 1e-9
        assert abs(r.target - 0.5) < 1e-9 or r.dimension == "topic"
    assert cells.agg(F.max("probability")).first()[0] <= 0.2 * cells.agg(F.max("weight")).first()[0] + 1e-9
    assert 0 < source_mixing.sample(d, targets=targets, keep=0.2).count() < 3000


def test_sampled_marginals_at_production_parameters(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = source_mixing.counted(docs, [F.col("doc_id")])
    cells = source_mixing.calibrated(rows, source_mixing.TARGETS)
    assert cells.agg(F.max("probability")).first()[0] <= 1
    # no probability is cut, so the expected sample has the raked marginals
    expected = cells.withColumn("w", F.col("probability") * F.col("t"))
    assert all(r.residual < 1e-8 for r in source_mixing.residuals(expected, list(source_mixing.TARGETS)).collect())
    kept = rows.join(cells.drop("t"), ["_source", "_lang", "_topic"]).where(source_mixing.uniform(F.col("doc_id")) < F.col("probability")).toPandas()
    whole = kept._tokens.sum()
    for r in source_mixing.residuals(cells, ["lang"]).collect():
        assert abs(kept[kept._lang == r.category]._tokens.sum() / whole - r.target) < 0.05


def test_mixing_of_edge_cases(spark):
    d = edge(spark)
    out = source_mixing.sample(d, targets={"source": {"s": 0.5}, "lang": 0.0, "topic": 1.0}, most_rounds=8)
    assert out.columns == d.columns and out.count() <= d.count()
    # source a has only lang x: half of the one and a tenth of the other contradict each other
    clash = spark.createDataFrame([(1, "u v w", "a", "x"), (2, "u v", "b", "y")], "doc_id long, text string, source string, lang string")
    targets = {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.1, "y": 0.9}}
    assert source_mixing.sample(clash, targets=targets, most_rounds=8).count() <= 2
    with pytest.raises(ValueError, match="not met"):
        source_mixing.sample(clash, targets=targets, most_rounds=8, strict=True)
    named = source_mixing.sample(clash.withColumn("subject", F.lit("law")), topic_col="subject", targets={"topic": 1.0})
    assert named.columns[-1] == "subject" and set(r.subject for r in named.collect()) <= {"law"}


def test_chats(spark):
    call = lambda *c: json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in c]})
    answer = lambda i, c="r": json.dumps({"tool_call_id": i, "content": c})
    m = [
        (1, 0, "user", "hi"), (1, 1, "assistant", call(("a", "search", {"query": "x"}), ("b", "search", {"q": 1}))), (1, 2, "tool", answer("a")), (1, 0, "tool", answer("b", {"z": 1, "a": 2})), (1, 3, "tool", answer("zz")), (1, 4, "tool", answer("a")),
        (2, 0, "assistant", call(("c", "search", {"query": {"$result": "d"}}))), (2, 1, "assistant", call(("d", "nope", "{}"))), (2, 2, "tool", answer("d")), (2, 1, "tool", answer("c")),
        (3, 0, "assistant", call(("e", "search", {"query": {"$result": "e"}}))), (3, 1, "tool", answer("e")), (None, None, None, None), (4, 0, "assistant", "{broken"),
    ]
    out = chat_format.format_chats(spark.createDataFrame(m, "conv_id long, turn long, role string, text string")).orderBy("conv", "order_turn", "order_level", "turn").collect()
    assert [(r.conv, r.turn, r.kind) for r in out if r.conv in (1, 2)] == [(1, 0, "text"), (1, 1, "calls"), (1, 0, "result"), (1, 2, "result"), (1, 3, "orphan"), (1, 4, "repeat"), (2, 1, "calls"), (2, 2, "result"), (2, 0, "calls"), (2, 1, "result")]
    two = next(r for r in out if r.conv == 1 and r.kind == "calls")
    assert (two.n_calls, two.n_answered, two.n_invalid, two.errors) == (2, 2, 1, "b: $.query: missing; $.q: unknown")
    assert [r.cyclic for r in out if r.conv == 3] == [True, False] and next(r for r in out if r.conv == 4).kind == "text"
    assert all(r.json == json.dumps(json.loads(r.json), sort_keys=True, ensure_ascii=False, separators=(",", ":")) for r in out)


def naive_order(edges):
    """The definition of order_rows by closures."""
    turn = {r: t for x, tx, y, ty in edges for r, t in ((x, tx), (y, ty))}
    links, cut = {(x, y) for x, _, y, _ in edges}, set()

    def reach(links):
        out = {r: {r} for r in turn}
        for _ in turn:
            for x, y in links:
                out[x] |= out[y]
        return out

    while True:
        to = reach(links)
        ring = {r for r in turn if any((r, y) in links and r in to[y] for y in turn)}
        core = {r for r in turn if any(r in to[c] for c in ring) and any(c in to[r] for c in ring)}
        if not core:
            break
        first = min(core, key=lambda r: (turn[r], r))
        cut.add(first)
        links = {(x, y) for x, y in links if not (y == first and x in core)}
    at = {r: (t, 0) for r, t in turn.items()}
    for _ in turn:
        for x, y in links:
            at[y] = max(at[y], (at[x][0], at[x][1] + 1))
    return {r: (*at[r], r in cut) for r in turn}


def test_chat_order_by_brute_force():
    rng = np.random.default_rng(12)
    for _ in range(400):
        n = int(rng.integers(2, 9))
        turn = rng.integers(0, 5, n).tolist()
        pairs = {(int(x), int(y)) for x, y in rng.integers(0, n, (int(rng.integers(1, 12)), 2)) if x != y}
        edges = [(x, turn[x], y, turn[y]) for x, y in sorted(pairs)]
        assert chat_format.order_rows(edges) == naive_order(edges)


def test_chats_are_ordered_in_jobs_that_do_not_grow(spark):
    call = lambda *c: json.dumps({"tool_calls": [{"id": i, "name": "search", "arguments": a} for i, a in c]})
    answer = lambda i: json.dumps({"tool_call_id": i, "content": "r"})
    moved = [(c, t, r, x) for c in range(1000) for t, r, x in ((0, "tool", answer("a")), (1, "assistant", call(("a", {"query": "x"}))), (2, "user", "thanks"))]
    ring = [(5000, 0, "assistant", call(("e", {"query": {"$result": "e"}}))), (5000, 1, "tool", answer("e"))]
    # one long conversation: each call needs the result of the next, all out of order
    long = [m for k in range(300) for m in ((6000, 2 * k, "assistant", call((f"c{k}", {"query": {"$result": f"c{k + 1}"}}))), (6000, 2 * k + 1, "tool", answer(f"c{k}")))]

    def jobs(rows):
        tracker, group = spark.sparkContext.statusTracker(), f"chats-{len(rows)}"
        spark.sparkContext.setJobGroup(group, group)
        out = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return out, len(tracker.getJobIdsForGroup(group))

    few, n_few = jobs(moved[:30] + ring)
    out, n = jobs(moved + ring + long)
    assert n <= n_few + 4
    assert all((r.order_turn, r.order_level) == (1, 1) for r in out if r.conv < 1000 and r.kind == "result")
    assert [r.cyclic for r in sorted((r for r in out if r.conv == 5000), key=lambda r: r.turn)] == [True, False]
    place = {r.turn: (r.order_turn, r.order_level) for r in out if r.conv == 6000}
    assert all(place[2 * k] > place[2 * k + 3] > place[2 * k + 2] for k in range(299)) and not any(r.cyclic for r in out if r.conv == 6000)


def test_chats_of_edge_cases(spark):
    text = "x" * 2_000_000
    m = [(1, 0, "user", text, "a", 1, "r"), (1, 0, "user", text, "a", 1, "r"), (None, None, None, None, None, None, None), (2, 1, "assistant", json.dumps({"tool_calls": [{"id": "a", "name": "search", "arguments": {"query": "ü"}}]}), "k", 2, "j")]
    out = chat_format.format_chats(spark.createDataFrame(m, "conv_id long, turn long, role string, text string, kind string, row long, json string")).collect()
    assert len(out) == 4 and sum(len(r.json) > 2_000_000 for r in out) == 2 and sum(r.kind == "calls" for r in out) == 1
    long = [(7, t, "user", f"m{t}") for t in range(5000)]
    assert chat_format.format_chats(spark.createDataFrame(long, "conv_id long, turn long, role string, text string")).count() == 5000


def test_license_scan_finds_every_copy(spark):
    mit = license_scan.TEMPLATES["mit"]
    junk = " ".join(f"j{i}" for i in range(200))
    d = spark.createDataFrame([(1, f"{mit} {junk} {mit}"), (2, f"{mit} {mit}"), (3, " ".join(mit.split()[:30]))], "doc_id long, text string")
    got = {r.id: [(s.first, s.end) for s in r.spans if s.label == "mit"] for r in license_scan.scan(d).collect()}
    n = len(license_scan.words_of(mit.lower().encode()))
    assert got[1] == [(0, n), (n + 200, 2 * n + 200)] and got[2] == [(0, n), (n, 2 * n)] and got[3] == [(0, 30)]


def test_language_id_learns_every_language_from_whole_texts(spark):
    rows = [(i, f"{'filler ' * 40}zz{i % 90} only here", f"l{i % 90:02}") for i in range(900)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = dict(language_id.learn(d))
    assert len(learned) == 90 and all(b"only here" in t for t in learned.values())
    assert all(len(t) <= 500 for _, t in language_id.learn(d, dictionary_bytes=500)) and sum(len(t) for _, t in language_id.learn(d, all_bytes=9000)) <= 9000
    again = d.union(d.where("lang = 'l00'")).union(d.where("lang = 'l00'"))
    assert set(dict(language_id.learn(again))) == set(learned)


def test_quality_rules_clean(spark):
    site = "a navigation line of this host that all its documents share"
    d = spark.createDataFrame([(i, f"{site}\nown{i} text\n  {site.upper()} ", "h") for i in range(30)] + [(99, "other words", "h"), (100, None, None), (101, f"{site}", "g")], "doc_id long, text string, source string")
    got = {r.id: (r.kept_text, r.boilerplate_words) for r in quality_rules.clean(d).collect()}
    assert got == {**{i: (f"own{i} text", 22) for i in range(30)}, 99: ("other words", 0), 100: ("", 0), 101: (site, 0)}
    assert quality_rules.clean(edge(spark)).count() == edge(spark).count()


def naive_best_fit(pieces, capacity, per_source):
    bins, out = [], []
    for tokens, source, cluster in pieces:
        fit = [(capacity - sum(n for n, _, _ in b), k) for k, b in enumerate(bins) if sum(n for n, _, _ in b) + tokens <= capacity and sum(s == source for _, s, _ in b) < per_source and all(c != cluster for _, _, c in b)]
        k = min(fit)[1] if fit else len(bins)
        if not fit:
            bins.append([])
        out.append((k, sum(n for n, _, _ in bins[k])))
        bins[k].append((tokens, source, cluster))
    return out


def test_best_fit_by_brute_force():
    rng = np.random.default_rng(14)
    for _ in range(200):
        pieces = sorted(((int(n), int(s), 50 + int(c)) for n, s, c in zip(rng.integers(1, 30, 40), rng.integers(0, 5, 40), rng.integers(0, 12, 40), strict=True)), reverse=True)
        assert bin_packing.best_fit(pieces, 30, 2) == naive_best_fit(pieces, 30, 2)


def test_row_filter():
    rng = np.random.default_rng(15)
    keys = np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64))
    words = np.zeros((1 << 16) // 64, dtype=np.uint64)
    for at in _common._places(keys, 1 << 16).reshape(-1):
        words[at >> np.uint64(6)] |= np.uint64(1) << (at & np.uint64(63))
    assert _common.may_hold(words, keys).all() and _common.may_hold(words, keys + np.uint64(1)).mean() < 0.1


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (3, 2), (9, 8), (8, 7), (4, 4), *((100, i) for i in range(101, 140))], "a long, b long")
    got = {r.node: r.component for r in _common.connected_components(e).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, **{i: 100 for i in range(100, 140)}}
