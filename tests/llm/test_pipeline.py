"""The pipeline's stages against brute force."""

from __future__ import annotations

import collections
import hashlib

import corpus_pipeline
from sievestone.llm import language_id, source_mixing

from .test_operators import FOLD, WORD, brute_components, edge


def brute_sample(rows):
    """Ids that raking by dicts and md5 keeps."""
    topic = lambda t, n: "symbols" if 50 * sum(t.count(c) for c in "#*$%&|<>") > len(t) else "note" if n < 50 else "passage" if "\n" not in t else "article" if n < 500 else "long"
    tokens = [len(WORD.findall(r.text or "")) for r in rows]
    cell = [(r.source, r.lang, topic(r.text or "", n)) for r, n in zip(rows, tokens, strict=True)]
    t = collections.Counter()
    for c, n in zip(cell, tokens, strict=True):
        t[c] += n
    t = {c: n for c, n in t.items() if n}
    w, goals = dict(t), []
    for k, power in enumerate(source_mixing.TARGETS.values()):
        sums = collections.Counter()
        for c, n in t.items():
            sums[c[k]] += n
        goals.append({x: n**power / sum(v**power for v in sums.values()) for x, n in sums.items()})
    for _ in range(200):
        for k, goal in enumerate(goals):
            sums = collections.Counter()
            for c, x in w.items():
                sums[c[k]] += x
            w = {c: x * goal[c[k]] / sums[c[k]] for c, x in w.items()}
    weight = {c: x * sum(t.values()) / t[c] for c, x in w.items()}
    factor = min(source_mixing.KEEP, 1 / max(weight.values()))
    drawn = [int(hashlib.md5(f"{'' if r.doc_id is None else r.doc_id}#{source_mixing.SEED}".encode()).hexdigest()[:8], 16) / 2**32 for r in rows]
    return sorted((r.doc_id for r, c, u in zip(rows, cell, drawn, strict=True) if u < factor * weight.get(c, 0)), key=lambda i: (i is not None, i))


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "ngram_jaccard_join", "source_mixing", "best_fit_packing"]
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(corpus_pipeline.materialise(stage(spark, tables[-1], sf_dir), name))
    for t in tables[1:-1]:
        assert t.columns == docs.columns
    ids = [[r.doc_id for r in t.select("doc_id").collect()] for t in tables]
    one = language_id.Classifier(language_id.learn(language_id.training_rows(docs)))
    guess = {r.doc_id: one(r.text) for r in docs.collect()}
    assert sorted(ids[1]) == sorted(i for i, (lang, margin) in guess.items() if lang != "und" and margin >= language_id.LEAST_MARGIN)
    last = {}
    for r in tables[1].collect():
        key = r.text.translate(FOLD)
        last[key] = max(r.doc_id, last.get(key, r.doc_id))
    assert sorted(ids[2]) == sorted(last.values())
    parts = brute_components([(r.doc_id, r.text) for r in tables[2].collect()])
    assert sorted(ids[3]) == sorted(i for i, _, c in parts if i == c)
    assert sorted(ids[4]) == brute_sample(tables[3].collect())
    packed = collections.Counter()
    for r in tables[5].collect():
        packed[r.doc_id] += r.n_tokens
    assert dict(packed) == {r.doc_id: len(r.text.encode().split()) for r in tables[4].collect()}


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_run_of_edge_cases(spark, tmp_path):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names, an empty table."""
    d = edge(spark)
    more = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    whole = d.unionByName(more, allowMissingColumns=True)
    for name, docs in (("some", whole), ("none", whole.limit(0)), ("nulls", d.where("text is null"))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        tables = [spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")]
        for stage, fn in corpus_pipeline.STAGES:
            tables.append(corpus_pipeline.materialise(fn(spark, tables[-1], f"{tmp_path}/{name}"), stage))
        for t in tables[1:-1]:
            assert t.columns == docs.columns
        rows = [[tuple(r) for r in t.collect()] for t in tables[:-1]]
        for before, after in zip(rows, rows[1:], strict=False):
            assert not collections.Counter(after) - collections.Counter(before)
        texts = collections.Counter((r.text or "").translate(FOLD) for r in tables[2].collect())
        assert all(n == 1 for n in texts.values()) and set(texts) == {(r.text or "").translate(FOLD) for r in tables[1].collect()}
        parts = brute_components([(k, r.text) for k, r in enumerate(tables[2].collect())])
        assert tables[3].count() == len({c for _, _, c in parts})
        packed = collections.Counter()
        for r in tables[5].collect():
            packed[r.doc_id] += r.n_tokens
        assert packed == collections.Counter({i: sum(len(WORD.findall(r.text or "")) for r in tables[4].collect() if r.doc_id == i) for i in {r.doc_id for r in tables[4].collect()}})
