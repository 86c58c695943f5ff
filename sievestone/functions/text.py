"""Text expressions: normalisation, tokens, grams, chunks, ids, typed values.

All are JVM expressions but for those that Spark has no built-in for (NFKC, casefold,
edit distance with transpositions, blake2), which are Arrow functions.
"""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no content in a question.
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "the", "to", "was", "were", "what", "when", "where", "which", "who", "with")
SIMPLE_TOKEN = "[a-z0-9]+"
WORD_TOKEN = r"[\p{L}\p{N}_'-]{2,}"
_PUNCTUATION = str.maketrans({"‘": "'", "’": "'", "“": '"', "”": '"', "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-"})


def _arrow(fn, kind: str):
    made = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "array<string>": pa.list_(pa.string())}[kind]

    def run(*columns: pa.Array) -> pa.Array:
        return pa.array([None if any(v is None for v in row) else fn(*row) for row in zip(*(c.to_pylist() for c in columns), strict=True)], made)

    shape = {1: lambda a: run(a), 2: lambda a, b: run(a, b)}[fn.__code__.co_argcount]  # Spark reads the arity from the signature
    return F.arrow_udf(shape, kind)


def normalize_text(c: Column) -> Column:
    """NFKC, entities resolved, quotes and dashes folded, white space collapsed."""
    return _arrow(lambda s: " ".join(unicodedata.normalize("NFKC", html.unescape(s)).translate(_PUNCTUATION).split()), "string")(c)


def normalize_surface(c: Column) -> Column:
    """NFKC, underscores to blanks, casefold, white space collapsed."""
    return _arrow(lambda s: " ".join(unicodedata.normalize("NFKC", s).replace("_", " ").casefold().split()), "string")(c)


def normalize_fuzzy(c: Column) -> Column:
    """The surface's word tokens, apostrophes folded, joined by a blank."""
    return F.array_join(F.regexp_extract_all(F.translate(normalize_surface(c), "‘’", "''"), F.lit(r"([\p{L}\p{N}']+)"), 1), " ")


def ascii_surface(c: Column) -> Column:
    """normalize_surface for text known to be ASCII, without leaving the JVM."""
    return F.lower(F.trim(F.regexp_replace(F.translate(c, "_", " "), r"\s+", " ")))


def simple_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(f"({SIMPLE_TOKEN})"), 1)


def word_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(f"({WORD_TOKEN})"), 1)


def content_tokens(c: Column) -> Column:
    """Distinct tokens of three letters or more that are no stop words."""
    return F.array_except(F.array_distinct(F.filter(simple_tokens(c), lambda x: F.length(x) > 2)), F.array(*map(F.lit, STOPWORDS)))


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of n tokens, joined by a blank, in order; none where the tokens are null.

    The tokens are bound once: named inside the inner lambda, their expression would be evaluated for every run.
    """

    def runs(w: Column) -> Column:
        last = F.coalesce(F.size(w), F.lit(0)) - (n - 1)
        return F.when(last < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " ")))

    return F.flatten(F.transform(F.array(tokens), runs))


def occurrences(values: Column) -> Column:
    """array<struct<value, n>> of the distinct values of an array without nulls, counted between the edges of its sorted form."""

    def count(s: Column) -> Column:
        last = F.size(s) - 1
        edges = F.when(last < 0, F.array().cast("array<int>")).otherwise(F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1))))
        of = lambda e: F.transform(e, lambda at, i: F.struct(F.get(s, at).alias("value"), (F.coalesce(F.get(e, i + 1), last + 1) - at).cast("long").alias("n")))
        return F.flatten(F.transform(F.array(edges), of))

    return F.flatten(F.transform(F.array(F.sort_array(values)), count))


def char_ngrams(c: Column, n: int = 3, left: str = "^", right: str = "$") -> Column:
    """Character n-grams of the framed text, in order, repeats kept."""
    framed = F.concat(F.lit(left), c, F.lit(right))
    last = F.length(framed) - (n - 1)
    return F.when(last < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(framed, i, F.lit(n))))


def gram_set(c: Column, n: int = 3, left: str = "^", right: str = "$") -> Column:
    return F.array_sort(F.array_distinct(char_ngrams(c, n, left, right)))


def chunks(c: Column, size: int = 480) -> Column:
    """array<struct<ordinal, char_start, char_end, text>> of fixed-size chunks over the whole text, cut in one pass."""
    return F.transform(
        F.regexp_extract_all(c, F.lit(f"((?s).{{1,{size}}})"), 1),
        lambda x, i: F.struct(i.cast("long").alias("ordinal"), (i * size).cast("long").alias("char_start"), (i * size + F.length(x)).cast("long").alias("char_end"), x.alias("text")),
    )


def spans(c: Column, pattern: str) -> Column:
    """array<struct<char_start, char_end, surface>> of a pattern's places, in order, without leaving the JVM.

    The pattern has three groups: before the surface, the surface, after it. Places are marked
    by two control characters, blanks in the text first, and counted from the marks, in blocks,
    so that no long array is copied for every place; a false place ends the text, so that no
    pattern looks for a mark in vain. Null or no place: an empty array.
    """
    clean = F.translate(F.coalesce(c, F.lit("")), "\u0001\u0002\u0003", "   ")
    marked = F.concat(F.regexp_replace(clean, pattern, "$1\u0001$2\u0002$3"), F.lit("\u0001\u0003\u0002"))
    blocks = F.regexp_extract_all(marked, F.lit("((?:[^\u0001]*\u0001[^\u0002]*\u0002){1,256})"), 1)
    span = lambda start, end, x: F.struct(start.cast("int").alias("char_start"), end.cast("int").alias("char_end"), x.cast("string").alias("surface"))

    def place(found: Column, piece: Column) -> Column:
        surface = F.substring_index(piece, "\u0001", -1)
        end = F.element_at(found, -1)["char_end"] + F.length(piece) - 1
        return F.concat(found, F.array(span(end - F.length(surface), end, surface)))

    def walk(done: Column, block: Column) -> Column:
        at = F.element_at(F.element_at(done, -1), -1)["char_end"]
        pieces = F.regexp_extract_all(block, F.lit("([^\u0001]*\u0001[^\u0002]*)\u0002"), 1)
        return F.concat(done, F.array(F.aggregate(pieces, F.array(span(at, at, F.lit(None))), place)))

    start = F.array(F.array(span(F.lit(0), F.lit(0), F.lit(None))))
    return F.filter(F.flatten(F.aggregate(blocks, start, walk)), lambda x: x["surface"] != "\u0003")


def sentences(c: Column) -> Column:
    # what follows the last end mark is cut first: from each of its places the pattern would scan to the text's end
    ended = F.reverse(F.regexp_replace(F.reverse(c), r"^[^.!?]+", ""))
    return F.transform(F.regexp_extract_all(ended, F.lit(r"([^.!?]+[.!?]+)"), 1), lambda x: F.trim(x))


def stable_id(kind: str, *parts: Column, length: int = 24) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.substring(F.sha2(F.concat_ws("\u001f", *parts), 256), 1, length))


def hash_bucket(c: Column, buckets: int) -> Column:
    """First 32 bits of SHA-256, modulo."""
    return F.conv(F.substring(F.sha2(c.cast("string"), 256), 1, 8), 16, 10).cast("long") % buckets


def semantic_key(tokens: Column) -> Column:
    """A key of the sorted distinct tokens."""
    return F.substring(F.sha2(F.array_join(F.array_sort(F.array_distinct(tokens)), " "), 256), 1, 16)


def plain_text(c: Column) -> Column:
    """Markup stripped: wiki templates and links, tags, entities for blanks and ampersands, spaces collapsed."""
    out = F.regexp_replace(c, r"(?s)\{\{[^{}]*\}\}", "")
    out = F.regexp_replace(out, r"\[\[[^\]|]*\|([^\]]*)\]\]", "$1")
    out = F.regexp_replace(out, r"\[\[([^\]]*)\]\]", "$1")
    out = F.regexp_replace(out, r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    out = F.regexp_replace(F.regexp_replace(out, "&nbsp;", " "), "&amp;", "&")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"'{2,}", ""), r"\s+", " "))


def years(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\b(1[0-9]{3}|20[0-9]{2})\b"), 1)


def numbers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"([0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?)"), 1)


def decimal_value(c: Column) -> Column:
    """The first number as a decimal, thousands separators dropped."""
    return F.regexp_replace(F.nullif(F.regexp_extract(c, r"([+-]?[0-9][0-9,]*(?:\.[0-9]+)?)", 1), F.lit("")), ",", "").cast("decimal(38,6)")


def iso_date(c: Column) -> Column:
    """A date written as 'January 5, 2020' or '5 January 2020'."""
    return F.coalesce(F.try_to_timestamp(c, F.lit("MMMM d, yyyy")), F.try_to_timestamp(c, F.lit("d MMMM yyyy"))).cast("date")


def value_kind(c: Column) -> Column:
    return F.when(c.rlike(r"^[0-9]{4}(-[0-9]{2}){0,2}$"), "date").when(c.rlike(r"^[+-]?[0-9][0-9,]*(\.[0-9]+)?( ?[A-Za-z%]+)?$"), "quantity").otherwise("text")


def osa_distance(a: str, b: str, most: int = 2) -> int:
    """Optimal string alignment distance, or most + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            now.append(d)
        if min(now) > most:
            return most + 1
        before, row = row, now
    return min(row[-1], most + 1)


def osa(a: Column, b: Column, most: int = 2) -> Column:
    return _arrow(lambda x, y: osa_distance(x, y, most), "int")(a, b)


def _places(c: Column, last: Column) -> Column:
    return F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))


def deletions(c: Column, depth: int = 2) -> Column:
    """All strings that up to `depth` deletions leave, the string itself among them."""
    without = lambda s: F.transform(_places(s, F.length(s)), lambda i: F.concat(F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1)))
    out = edge = F.array(c)
    for _ in range(depth):
        edge = F.array_distinct(F.flatten(F.transform(edge, without)))
        out = F.array_union(out, edge)
    return F.when(c.isNotNull(), out)


def edit_variants(c: Column) -> Column:
    """All strings of lower-case letters one edit away, transpositions included."""
    letters = F.array(*map(F.lit, "abcdefghijklmnopqrstuvwxyz"))
    n = F.length(c)
    left, right = lambda i: F.substr(c, F.lit(1), i - 1), lambda i: F.substr(c, i)
    swapped = F.transform(_places(c, n - 1), lambda i: F.concat(left(i), F.substr(c, i + 1, F.lit(1)), F.substr(c, i, F.lit(1)), right(i + 2)))
    replaced = F.flatten(F.transform(_places(c, n), lambda i: F.transform(letters, lambda x: F.concat(left(i), x, right(i + 1)))))
    inserted = F.flatten(F.transform(_places(c, n + 1), lambda i: F.transform(letters, lambda x: F.concat(left(i), x, right(i)))))
    return F.array_except(F.array_distinct(F.concat(deletions(c, 1), swapped, replaced, inserted)), F.array(c))


def blake2_bucket(c: Column, buckets: int = 4096) -> Column:
    """blake2s of two bytes, modulo."""
    return _arrow(lambda s: int.from_bytes(hashlib.blake2s(s.encode(), digest_size=2).digest(), "big") % buckets, "int")(c)


def align(source: str, surface: str) -> tuple[int, int] | None:
    """Where a surface stands in a source: as it is, else with white space and punctuation folded; None if nowhere or ambiguous."""
    if (at := source.find(surface)) >= 0:
        return (at, at + len(surface)) if source.find(surface, at + 1) < 0 else None
    spans = [(m.start(), m.end()) for m in re.finditer(r"\S+", source)]
    folded = [source[a:b].translate(_PUNCTUATION) for a, b in spans]
    wanted = surface.translate(_PUNCTUATION).split()
    hits = [i for i in range(len(folded) - len(wanted) + 1) if folded[i : i + len(wanted)] == wanted] if wanted else []
    return (spans[hits[0]][0], spans[hits[0] + len(wanted) - 1][1]) if len(hits) == 1 else None
