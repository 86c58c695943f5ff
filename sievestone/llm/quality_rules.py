"""Quality rules: lines that many documents of one host share do not count as content.

Each text yields its base measures and, per distinct normalised line (words joined by one
blank, A-Z lowered), a hash with the words that the line has in this text. Lines are
counted per host over documents that differ (equal texts of a host count once). A line
above `line_share` of the host's documents, and above `least_docs`, is boilerplate; a
document that loses `depleted` percent of its words or more to boilerplate is rejected,
as is one that fails the base rules.

Defined results: null or empty text has no word and fails the base rules; a null host is a
host of its own; every row is judged, rows of one id separately; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import FOLD, long_array, map_rows, materialise, possibly, shingle_sequence, text_bytes, texts, word_hashes

#: A line of more than this percentage of the host's different documents, and of more than so many, is boilerplate.
LINE_SHARE, LEAST_DOCS = 2, 10
#: A document is depleted when boilerplate has at least this percentage of its words.
DEPLETED = 80
#: Bound of the boilerplate lines that are broadcast.
HOT_LINES = 1 << 16
#: The base rules: fewest words, widest share of words in repeated windows (percent), words of a window.
FEWEST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8
SYMBOLS = b"#*$%&|<>"


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words that lie in a window of `width` words found twice or more."""
    n = len(words)
    if n <= width:
        return 0
    _, where, times = np.unique(shingle_sequence(word_hashes(words), width), return_inverse=True, return_counts=True)
    if len(times) == len(where):
        return 0
    edge = np.zeros(n + 1, dtype=np.int64)
    starts = np.flatnonzero(times[where] > 1)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return int((np.cumsum(edge[:n]) > 0).sum())


def _measure(batch: pa.RecordBatch) -> pa.RecordBatch:
    out = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content")}
    hashes, counts, sizes = [], [], [0]
    for text in texts(batch.column(2)):
        words = text.split()
        out["n_words"].append(len(words))
        chars = b"".join(words)
        out["word_chars"].append(len(chars) if chars.isascii() else len(chars.decode("utf-8", "replace")))
        out["n_symbols"].append(len(chars) - len(chars.translate(None, SYMBOLS)))
        out["n_repeat_words"].append(repeated_words(words))
        folded = text.translate(FOLD)
        out["content"].append(xxhash.xxh3_64_intdigest(folded))
        raw, again, own = set(), 0, {}
        for line, low in zip(text.split(b"\n"), folded.split(b"\n"), strict=True):
            if not (w := low.split()):
                continue
            if line in raw:
                again += 1
            else:
                raw.add(line)
            h = xxhash.xxh3_64_intdigest(b" ".join(w))
            own[h] = own.get(h, 0) + len(w)
        out["n_dup_lines"].append(again)
        hashes += own
        counts += own.values()
        sizes.append(len(hashes))
    content = long_array(np.array(out.pop("content"), dtype=np.uint64))
    offsets = pa.array(sizes, pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, x) for x in (long_array(np.array(hashes, dtype=np.uint64)), pa.array(counts, pa.int64()))]
    return pa.record_batch([batch.column(0), batch.column(1), *(pa.array(v, pa.int64()) for v in out.values()), content, *lists], ["id", "host", *out, "content", "lines", "line_words"])


def _surveyed(docs: DataFrame, text_col: str, id_col: str, host_col: str, line_share: int, least_docs: int) -> tuple[DataFrame, DataFrame]:
    """(measured rows, their lines (row, line, words) that are boilerplate of their host)."""
    measured = map_rows(
        docs, [F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), text_bytes(text_col).alias("text")], _measure,
        f"id {docs.schema[id_col].dataType.simpleString()}, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content long, lines array<long>, line_words array<long>",
    )
    measured = materialise(measured.withColumn("row", F.monotonically_increasing_id()).withColumn("host", F.coalesce(F.concat(F.lit("="), "host"), F.lit(""))), "measured")
    # one row of those alike in host and content; the same again as a semi-join, so that no array is shuffled
    first = measured.groupBy("host", "content").agg(F.min("row").alias("row"))
    different = first.groupBy("host").agg(F.count("*").alias("n_docs"))
    lines = measured.select("row", "host", F.explode("lines").alias("line"))
    common = lines.join(first.select("row"), "row", "left_semi").groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > least_docs)
    common = materialise(common.join(different, "host").where(100 * F.col("n") > line_share * F.col("n_docs")).select("host", "line", "n"), "boilerplate")
    cover = measured.select("row", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("x")).select("row", "host", F.col("x.lines").alias("line"), F.col("x.line_words").alias("words"))
    # the lines of most documents, of a bounded number, are matched where they lie; no other holds many rows of a task
    hot = materialise(common.orderBy(F.desc("n"), "host", "line").limit(HOT_LINES).select("host", "line"), "hot-lines")
    lost = cover.join(F.broadcast(hot), ["host", "line"])
    if common.count() > HOT_LINES:
        cold = common.select("host", "line").join(F.broadcast(hot), ["host", "line"], "left_anti")
        lost = lost.union(cover.join(F.broadcast(hot), ["host", "line"], "left_anti").join(cold, ["host", "line"]))
    return measured, lost.select("row", "line", "words")


def judge(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", host_col: str = "source", line_share: int = LINE_SHARE, least_docs: int = LEAST_DOCS, depleted: int = DEPLETED) -> DataFrame:
    """One row per row of docs: id, host, the measures, boilerplate_words, base_failed, depleted, kept."""
    measured, lines = _surveyed(docs, text_col, id_col, host_col, line_share, least_docs)
    lost = lines.groupBy("row").agg(F.sum("words").alias("boilerplate_words"))
    return _verdicts(measured.drop("lines", "line_words", "content").join(lost, "row", "left"), depleted).drop("row")


def _verdicts(rows: DataFrame, depleted: int) -> DataFrame:
    out = rows.fillna(0, "boilerplate_words")
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    bare = (F.col("boilerplate_words") > 0) & (100 * F.col("boilerplate_words") >= depleted * F.col("n_words"))
    out = out.withColumn("base_failed", failed).withColumn("depleted", bare).withColumn("kept", ~failed & ~bare)
    return out.withColumn("host", F.when(F.col("host") != "", F.expr("substring(host, 2)")))


def _without_lines(batch: pa.RecordBatch) -> pa.RecordBatch:
    kept = []
    for text, gone in zip(texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
        if gone:
            gone = set(gone)
            stay = []
            for line in text.split(b"\n"):
                w = line.translate(FOLD).split()
                if not w or int(np.uint64(xxhash.xxh3_64_intdigest(b" ".join(w))).view(np.int64)) not in gone:
                    stay.append(line)
            text = b"\n".join(stay)
        kept.append(text)
    return pa.record_batch([batch.column(0), pa.array(kept, pa.binary()).cast(pa.string()), *batch.columns[3:]], ["id", "kept_text", "boilerplate_words"])


def clean(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", host_col: str = "source", line_share: int = LINE_SHARE, least_docs: int = LEAST_DOCS) -> DataFrame:
    """One row per row of docs: id, kept_text (without its host's boilerplate lines), boilerplate_words (removed).

    Only texts that may have such a line are shuffled.
    """
    measured, lines = _surveyed(docs, text_col, id_col, host_col, line_share, least_docs)
    lost = lines.groupBy("row").agg(F.sum("words").alias("boilerplate_words"), F.collect_set("line").alias("gone"))
    # rows alike in id, host and content have the same lines
    host = F.when(F.col("host") != "", F.expr("substring(host, 2)"))
    found = measured.select("row", F.xxhash64("id", host, "content").alias("at")).join(lost, "row").groupBy("at").agg(F.first("boilerplate_words").alias("boilerplate_words"), F.first("gone").alias("gone"))
    found = materialise(found, "found")
    content = F.arrow_udf(_contents, "long")(text_bytes(text_col))
    d = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(host_col).cast("string"), content).alias("at"))
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, kept_text string, boilerplate_words long"
    none = [F.lit(None).cast("array<long>").alias("gone"), F.lit(0).cast("long").alias("boilerplate_words")]
    parts = possibly(d, found.select(F.col("at").alias("key")), F.col("at"))
    if parts is None:
        return d.select("id", "text", *none).mapInArrow(lambda batches: map(_without_lines, batches), schema)
    some, rest = parts
    some = some.join(found, "at", "left").select("id", "text", "gone", F.coalesce("boilerplate_words", F.lit(0).cast("long")).alias("boilerplate_words"))
    return some.union(rest.select("id", "text", *none)).mapInArrow(lambda batches: map(_without_lines, batches), schema)


def _contents(column: pa.Array) -> pa.Array:
    return long_array(np.array([xxhash.xxh3_64_intdigest(t.translate(FOLD)) for t in texts(column)], dtype=np.uint64))


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs).select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "boilerplate_words")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), f AS (
  SELECT *, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM d
), win AS (
  SELECT doc_id, p, array_to_string(list_slice(w, p, p + 7), ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS p FROM d WHERE len(w) >= 8)
), rep AS (
  SELECT doc_id, p FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1
), cov AS (
  SELECT doc_id, count(DISTINCT p + o) AS n_repeat_words FROM rep, range(8) AS r(o) GROUP BY doc_id
), l AS (
  SELECT doc_id, host, low, unnest(string_split(t, chr(10))) AS line, unnest(string_split(low, chr(10))) AS ll FROM f
), lw AS (
  SELECT doc_id, host, low, line, array_to_string(regexp_extract_all(ll, '[^\x20\x09-\x0D]+'), ' ') AS key, len(regexp_extract_all(ll, '[^\x20\x09-\x0D]+')) AS nw FROM l
), dup AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lw WHERE nw > 0 GROUP BY doc_id
), nd AS (
  SELECT host, count(DISTINCT low) AS n_docs FROM f GROUP BY host
), common AS (
  SELECT host, key FROM lw JOIN nd USING (host) WHERE nw > 0 GROUP BY host, key, n_docs
  HAVING count(DISTINCT low) > 10 AND 100 * count(DISTINCT low) > 2 * n_docs
), lost AS (
  SELECT doc_id, sum(nw) AS boilerplate_words FROM lw JOIN common USING (host, key) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(boilerplate_words, 0)::BIGINT AS boilerplate_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN lost USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, boilerplate_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT (boilerplate_words > 0 AND 100 * boilerplate_words >= 80 * n_words) AS kept
FROM m
"""
