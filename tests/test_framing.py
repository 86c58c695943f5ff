"""Mentions, quotations, pronouns and beliefs against plain loops."""

from __future__ import annotations

import itertools
import math
import re

from pyspark.sql import functions as F

from sievestone.functions import text as T
from sievestone.operators import beliefs as B
from sievestone.operators import framing as Q


def test_mentions(spark):
    texts = ["Who met Anna of the North and Bob Lee in \"the old town\" or “Anna of the North”?", "", None, "x" * 5000 + " Ünal Oslo xOslo Rome-Paris's " * 700, "A B C D E F G H", "é Paris\u0001 Rome"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, q string")
    got = {r["i"]: [(m["char_start"], m["char_end"], m["surface"]) for m in r["m"]] for r in df.select("i", Q.mentions(F.col("q")).alias("m")).collect()}
    word = r"[A-Z][\w'-]*"
    for i, q in enumerate(texts):
        q = (q or "").replace("\u0001", " ")
        runs = [(*m.span(), m.group()) for m in re.finditer(rf"(?<![\w'-])(?:{word}(?:\s+(?:of|the|and|de|van)\s+|\s+)){{0,5}}{word}", q) if m.group().lower() not in Q.OPENERS]
        quoted = [(*m.span(1), m.group(1)) for m in re.finditer("[\"“]([^\"”]{2,200})[\"”]", q)]
        assert got[i] == sorted(runs + [x for x in quoted if not any(a <= x[0] and x[1] <= b for a, b, _ in runs)])
    assert got[0][-2:] == [(q0 := texts[0].index("the old town"), q0 + 12, "the old town"), (q1 := texts[0].rindex("Anna"), q1 + 17, "Anna of the North")] or len(got[0]) >= 3


def test_chunks_of_any_text(spark):
    texts = ["", None, "a\nb" * 400, "𝄞é" * 481, "x" * 480]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, q string")
    for r in df.select("i", T.chunks(F.col("q")).alias("c")).collect():
        q = texts[r["i"]]
        assert (r["c"] is None) == (q is None)
        assert [(c["ordinal"], c["char_start"], c["char_end"], c["text"]) for c in r["c"] or []] == [(k, a, min(a + 480, len(q)), q[a : a + 480]) for k, a in enumerate(range(0, len(q or ""), 480))]


def test_pronouns(spark):
    turns = [(1, 0, "It began", []), (1, 1, "Ada wrote", ["Ada"]), (1, 2, "did she or they", []), (1, 3, "Bo", ["Bo"]), (1, 4, "its hit", ["C", "D", "E"]), (1, 5, "he", []), (2, 0, "them", [])]
    df = spark.createDataFrame(turns, "chat int, turn int, q string, named array<string>")
    got = {(r["chat"], r["turn"], r["ordinal"]): (r["pronoun"], r["antecedents"], r["confidence"]) for r in Q.bind_pronouns(df, "chat", "turn", F.col("q"), "named").collect()}
    assert got == {
        (1, 0, 0): ("it", [], 0.45), (1, 2, 0): ("she", ["Ada"], 0.9), (1, 2, 1): ("they", ["Ada"], 0.9),
        (1, 4, 0): ("its", ["Ada", "Bo"], 0.45), (1, 5, 0): ("he", ["D", "E"], 0.45), (2, 0, 0): ("them", [], 0.45),
    }


def test_disagreement(spark):
    cases = {1: [{"a": 0.7, "b": 0.3}, {"a": 0.2, "b": 0.5, "c": 0.3}, {"c": 1.0}], 2: [{"a": 1.0}], 3: [{"a": 0.5, "b": 0.5}, {"a": 0.5, "b": 0.5}]}
    df = spark.createDataFrame([(k, e, x, p) for k, es in cases.items() for e, d in enumerate(es) for x, p in d.items()], "case int, expert int, label string, p double")
    got = {r["case"]: r.asDict() for r in B.disagreement(df).collect()}
    for k, es in cases.items():
        labels = sorted({x for d in es for x in d})
        full = [[max(d.get(x, 0), B.FLOOR) for x in labels] for d in es]
        full = [[v / sum(p) for v in p] for p in full]
        if len(es) < 2:
            assert got[k]["aggregate"] == 0
            continue
        mean = [sum(c) / len(es) for c in zip(*full, strict=True)]
        js = min(1, sum(v * math.log(v / m) for p in full for v, m in zip(p, mean, strict=True)) / len(es) / math.log(2))
        ranks = [{i: r for r, i in enumerate(sorted(range(len(labels)), key=lambda i: (-p[i], labels[i])))} for p in full]
        pairs = list(itertools.combinations(range(len(es)), 2))
        rank = sum(sum(abs(ranks[a][i] - ranks[b][i]) for i in range(len(labels))) / (len(labels) * max(1, len(labels) - 1)) for a, b in pairs) / len(pairs)
        top = [min(r, key=r.get) for r in ranks]
        against = max([min(full[a][top[a]], full[b][top[b]]) for a, b in pairs if top[a] != top[b]], default=0)
        h = [-sum(v * math.log(v) for v in p) / math.log(len(labels)) for p in full]
        want = {"js": js, "top1": (len(set(top)) - 1) / (len(es) - 1), "rank": min(1, rank), "entropy": max(h) - min(h), "contradiction": against}
        for name, v in (want | {"aggregate": max(want.values())}).items():
            assert abs(got[k][name] - v) < 1e-9, (k, name)
