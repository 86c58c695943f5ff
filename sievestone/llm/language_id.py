"""Language identification by compression.

One raw-content zstandard dictionary per language is filled from a bounded sample of
labelled texts. A text, A-Z and all other letters lowered, is cut into blocks over its
whole length; every block is compressed with every dictionary, and the language with the
smallest total wins. The margin is the share by which the runner-up is larger; texts with
a margin under `least_margin`, with no letter or with no text are rejected.

Bound of the sample (parameters): `dictionary_bytes` and `sample_docs` per language, and
`all_bytes` over all languages, which share it. All else covers all rows and whole texts.

Defined results: null text or text without letters gives `und` with score 0; a null id is
never learned from and never held out; with one learned language its score is 1; with
none (empty table, no labels) everything is `und`; repeated rows are judged alike; other
columns are carried or ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import lean_batches, materialise

#: Bounds of the training sample: rows and dictionary bytes a language, and bytes of all dictionaries, which are broadcast.
SAMPLE_DOCS, DICTIONARY_BYTES, ALL_BYTES = 800, 192 * 1024, 48 << 20
#: Bytes of a block, zstandard's level, and the margin below which a text is rejected.
BLOCK, LEVEL = 4096, 6
LEAST_MARGIN = 0.003
FOLDS, HELD_OUT = 4, 2


def fold(id_col: str) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS))


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_docs: int = SAMPLE_DOCS, dictionary_bytes: int = DICTIONARY_BYTES, all_bytes: int = ALL_BYTES) -> list[tuple[str, bytes]]:
    """(language, dictionary) of every language, from a sample that depends on ids and texts alone.

    Rows are drawn by a hash: first by a threshold on it from each language's count, so that
    about twice `sample_docs` rows a language are ranked, not all. Whole texts, smallest hash
    first, fill the dictionary until its bytes are reached; what is read back is bounded by
    the dictionaries' sizes.
    """
    named = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    usable = named.where(F.col("lang").isNotNull() & F.col("id").isNotNull() & (F.length("text") > 0))
    counts = materialise(usable.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    each = max(1, min(dictionary_bytes, all_bytes // max(1, counts.count())))
    h = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 40))
    drawn = usable.withColumn("h", h).join(F.broadcast(counts), "lang").where(F.col("h") * F.col("n") <= F.lit(float(2 * sample_docs + 100) * (1 << 40)))
    # characters, at least one byte each: a text longer than the dictionary fills it
    drawn = drawn.select("lang", "h", F.length("text").alias("size"), F.substring("text", 1, each).alias("text"))
    order = Window.partitionBy("lang").orderBy("h", "text")
    drawn = drawn.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= sample_docs)
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = drawn.withColumn("before", before).where(F.col("before") < 2 * each).orderBy("lang", "rank").select("lang", "text").collect()
    out: dict[str, bytes] = {}
    for r in rows:
        if len(out.setdefault(r["lang"], b"")) < each:
            out[r["lang"]] += letters(r["text"]) + b"\n"
    return [(lang, text[:each]) for lang, text in sorted(out.items()) if text.strip()]


_NO_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """The text lowered, with every run of characters other than letters cut to one blank."""
    return _NO_LETTERS.sub(" ", text.lower()).encode("utf-8", "replace")


class Classifier:
    def __init__(self, learned: list[tuple[str, bytes]]):
        self.languages = [lang for lang, _ in learned]
        self.compressors = []
        for _, text in learned:
            book = zstandard.ZstdCompressionDict(text, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            book.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=book, write_content_size=False, write_checksum=False, write_dict_id=False))

    def __call__(self, text: str | None) -> tuple[str, float]:
        """The language and its margin."""
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return "und", 0.0
        raw = letters(text)
        sizes = [0] * len(self.languages)
        for at in range(0, len(raw), BLOCK):
            block = raw[at : at + BLOCK]
            for k, c in enumerate(self.compressors):
                sizes[k] += len(c.compress(block))
        if len(sizes) == 1:
            return self.languages[0], 1.0
        best, second = sorted(range(len(sizes)), key=lambda k: (sizes[k], k))[:2]
        return self.languages[best], (sizes[second] - sizes[best]) / sizes[second]


def identify(docs: DataFrame, learned: list[tuple[str, bytes]], text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The carried columns of docs (all, if none are named) with lang_pred and score (the margin).

    Only the text travels to Python; no shuffle.
    """
    lean_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(learned)
    at: dict[str, Classifier] = {}

    def predict(column: pa.Array) -> pa.Array:
        if "it" not in at:
            at["it"] = Classifier(sent.value)
        found = [at["it"](t) for t in column.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())], ["lang", "score"])

    columns = [docs[c] for c in (docs.columns if carry is None else carry)]
    guess = F.arrow_udf(predict, "lang string, score double")(F.col(text_col).cast("string"))
    taken = {c for c in (docs.columns if carry is None else carry)}
    mark = next(m for i in range(len(taken) + 1) if (m := f"_guess{i}") not in taken)
    out = docs.select(*columns, guess.alias(mark))
    return out.select(*[out[c] for c in out.columns if c != mark], out[mark]["lang"].alias("lang_pred"), out[mark]["score"].alias("score"))


def accepted(least_margin: float = LEAST_MARGIN) -> Column:
    return (F.col("lang_pred") != "und") & (F.col("score") >= least_margin)


def accept(docs: DataFrame, learned: list[tuple[str, bytes]], text_col: str = "text", least_margin: float = LEAST_MARGIN) -> DataFrame:
    """The rows of docs that are not rejected, with their columns, whatever their names."""
    own = {c: f"_own{i}" for i, c in enumerate(docs.columns)}
    found = identify(docs.withColumnsRenamed(own), learned, own[text_col])
    return found.where(accepted(least_margin)).drop("lang_pred", "score").withColumnsRenamed({v: k for k, v in own.items()})


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return docs.where(fold(id_col) != HELD_OUT)


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    learned = learn(training_rows(docs))
    held = F.coalesce(fold("doc_id") == HELD_OUT, F.lit(False)).alias("held_out")
    out = identify(docs.select("doc_id", "text", held), learned, carry=["doc_id", "held_out"])
    return out.withColumn("accepted", accepted())
