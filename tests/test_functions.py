from __future__ import annotations

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievestone.functions import text as T


def one(spark, c, **values):
    return spark.range(1).select(c(*(F.lit(v) for v in values.values())).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("fn", "given_", "want"),
    [
        (T.normalize_text, "a b &amp; “c”—d", 'a b & "c"-d'),
        (T.normalize_surface, "  Straße_X ", "strasse x"),
        (T.normalize_fuzzy, "O’Neil, Jr.", "o'neil jr"),
        (T.plain_text, "{{cite}}[[A|b]] [[c]] <b>d</b>&nbsp;e", "b c d e"),
        (T.ascii_surface, " A_b  C ", "a b c"),
    ],
)
def test_normalise(spark, fn, given_, want):
    assert one(spark, fn, s=given_) == want
    assert spark.range(1).select(fn(F.lit(None).cast("string")).alias("x")).first()["x"] is None


def test_tokens_and_grams(spark):
    assert one(spark, T.content_tokens, s="The cat AND the cat sat on it") == ["cat", "sat"]
    assert one(spark, lambda c: T.ngrams(T.simple_tokens(c), 2), s="a b c") == ["a b", "b c"]
    assert one(spark, lambda c: T.ngrams(T.simple_tokens(c), 2), s="a") == []
    assert one(spark, T.gram_set, s="aab") == ["^aa", "aab", "ab$"]
    assert one(spark, lambda c: F.size(T.chunks(c, 4)), s="") == 0
    assert [(x.char_start, x.char_end, x.text) for x in one(spark, lambda c: T.chunks(c, 4), s="abcdefghi")] == [(0, 4, "abcd"), (4, 8, "efgh"), (8, 9, "i")]


def test_values(spark):
    assert str(one(spark, T.iso_date, s="January 5, 2020")) == "2020-01-05"
    assert str(one(spark, T.decimal_value, s="about 1,234.5 km")) == "1234.500000"
    assert [one(spark, T.value_kind, s=s) for s in ("2020-01-05", "12 kg", "x")] == ["date", "quantity", "text"]
    assert "ehtnic" in one(spark, T.edit_variants, s="ethnic") and sorted(one(spark, lambda c: T.deletions(c, 1), s="ab")) == ["a", "ab", "b"]


def test_osa():
    assert [T.osa_distance(*p, 3) for p in (("tehnic", "ethnic"), ("ca", "abc"), ("a", "a"), ("", "abcd"))] == [1, 3, 0, 4]


@given(st.text("ab", max_size=6), st.text("ab", max_size=6))
def test_osa_is_symmetric_and_bounded(a, b):
    d = T.osa_distance(a, b, 9)
    assert d == T.osa_distance(b, a, 9) and abs(len(a) - len(b)) <= d <= max(len(a), len(b)) and (d == 0) == (a == b)


def test_align():
    assert T.align("one two three", "two") == (4, 7)
    assert T.align("two two", "two") is None
    assert T.align("say “hello  there” now", '"hello there"') == (4, 18)
    assert T.align("abc", "x") is None


def test_grams_counted_inside_texts(spark):
    import time
    from collections import Counter

    from sievestone.operators import retrieval

    long = " ".join(f"w{i * i % 997}" for i in range(20_000))
    rows = [(1, "a b a b a"), (2, "One"), (3, None), (4, ""), (5, "a b"), (5, "b a b"), (None, "x y"), (None, "X y z"), (6, long)]
    want: Counter = Counter()
    for i, s in rows:
        w = (s or "").lower().split()
        want.update((f"{x} {y}", i) for x, y in zip(w, w[1:], strict=False))
    for held in (rows, [r for r in rows if r[0] not in (5, None)]):
        df = spark.createDataFrame(held, "doc_id long, text string")
        began = time.time()
        got = [tuple(r) for r in retrieval.gram_counts(df, "doc_id", "text", 2).collect()]
        assert time.time() - began < 20  # tokens were split anew for every gram of a text
        ids = {i for i, _ in held}
        assert len(got) == len({x[:2] for x in got}) and {x[:2]: x[2] for x in got} == {k: n for k, n in want.items() if k[1] in ids}
