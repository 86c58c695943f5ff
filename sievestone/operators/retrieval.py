"""Chunks, postings, lexical ranking and fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .storage import cut

#: Fixed values of the ranking formula.
K1, B = 1.2, 0.75


def chunk_table(docs: DataFrame, size: int = 480, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per chunk: doc_id, ordinal, chunk_id, char_start, char_end, chunk_text."""
    out = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.explode(T.chunks(F.col(text_col), size)).alias("c"))
    return out.select("doc_id", F.col("c.ordinal").alias("ordinal"), F.concat_ws("#", F.col("doc_id").cast("string"), F.col("c.ordinal").cast("string")).alias("chunk_id"), F.col("c.char_start").alias("char_start"), F.col("c.char_end").alias("char_end"), F.col("c.text").alias("chunk_text"))


def binding_checks(chunks: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Whether each chunk's slice and hash agree with its document."""
    whole = docs.select("doc_id", F.col(text_col).alias("whole"))
    sliced = F.expr("substring(whole, int(char_start) + 1, int(char_end - char_start))")
    return chunks.join(whole, "doc_id").select(
        "chunk_id", (sliced == F.col("chunk_text")).alias("slice_matches"), (F.sha2(sliced, 256) == F.sha2("chunk_text", 256)).alias("span_hash_matches"),
        (F.octet_length(sliced) == F.octet_length("chunk_text")).alias("byte_length_matches"),
    )


def term_counts(units: DataFrame, id_col: str, text_col: str, tokens=T.simple_tokens) -> DataFrame:
    """(id, term, tf); partial aggregation happens before the one shuffle."""
    return units.select(F.col(id_col), F.explode(tokens(F.col(text_col))).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))


def gram_counts(units: DataFrame, id_col: str, text_col: str, n: int, tokens=T.simple_tokens) -> DataFrame:
    """(term, id, tf) of runs of n tokens, counted inside each text, so that grams are not shuffled.

    Only ids that stand on several rows are added up over rows.
    """
    each = lambda df: df.select(F.col(id_col), F.explode(T.occurrences(T.ngrams(tokens(F.col(text_col)), n))).alias("_g")).select(F.col("_g.value").alias("term"), id_col, F.col("_g.n").alias("tf"))
    units = units.select(id_col, text_col)
    again = cut(units.groupBy(id_col).agg(F.count("*").alias("_n")).where("_n > 1").select(F.col(id_col).alias("_id")))
    if again.isEmpty():
        return each(units)
    same = F.col(id_col).eqNullSafe(F.col("_id"))
    return each(units.join(again, same, "left_anti")).unionByName(each(units.join(again, same, "left_semi")).groupBy("term", id_col).agg(F.sum("tf").alias("tf")))


def postings(units: DataFrame, id_col: str, terms: Column) -> DataFrame:
    """term -> sorted ids. For display and export: hot terms' lists grow with the corpus, joins use term_counts."""
    return units.select(F.col(id_col), F.explode(F.array_distinct(terms)).alias("term")).groupBy("term").agg(F.array_sort(F.collect_set(id_col)).alias("ids"), F.countDistinct(id_col).alias("df"))


def asked_terms(units: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf, len) of the wanted terms, stored; the empty term stands once for every unit.

    The units are read and split into tokens once: counts of units and their mean length come
    from the stored rows, and only wanted terms reach the shuffle.
    """
    split = units.select(F.col(id_col), T.simple_tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("_words"))
    terms = wanted.select("term").unionByName(units.sparkSession.createDataFrame([("",)], "term string")).distinct()
    spread = split.select(id_col, F.size("_words").alias("len"), F.explode(F.concat("_words", F.array(F.lit("")))).alias("term"))
    return cut(spread.join(terms, "term", "left_semi").groupBy(id_col, "term").agg(F.count("*").alias("tf"), F.first("len").alias("len")))


def bm25(units: DataFrame, queries: DataFrame, id_col: str, text_col: str, query_id: str, query_text: str, k1: float = K1, b: float = B) -> DataFrame:
    """(query, id, score) of all units that share a term with a query."""
    asked = queries.select(F.col(query_id), F.explode(F.array_distinct(T.simple_tokens(F.col(query_text)))).alias("term"))
    stored = asked_terms(units, asked, id_col, text_col)
    n, mean = stored.where("term = ''").agg(F.count("*"), F.avg("len")).first()
    tf = stored.where("term <> ''")
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(float(mean or 1))))
    return tf.join(df, "term").join(asked, "term").groupBy(query_id, id_col).agg(F.round(F.sum(part), 6).alias("score"))


def weighted_bm25(units: DataFrame, queries: DataFrame, id_col: str, fields: dict[str, float], query_id: str, query_text: str, k1: float = K1, b: float = B) -> DataFrame:
    """(query, id, score) over several columns of a unit, each with its weight.

    A term's frequency is the weighted sum over columns, a unit's length that of all columns
    together; a term in half of the units or more still counts a millionth. Units are read once, as in bm25.
    """
    asked = queries.select(F.col(query_id), F.explode(F.array_distinct(T.simple_tokens(F.col(query_text)))).alias("term"))

    def words(column: str, weight: float) -> Column:
        return F.transform(T.simple_tokens(F.coalesce(F.col(column), F.lit(""))), lambda x: F.struct(x.alias("term"), F.lit(float(weight)).alias("w")))

    split = units.select(F.col(id_col), F.concat(*(words(c, w) for c, w in fields.items())).alias("_words"))
    mark = F.array(F.struct(F.lit("").alias("term"), F.lit(0.0).alias("w")))
    spread = split.select(id_col, F.size("_words").alias("len"), F.inline(F.concat("_words", mark)))
    wanted = asked.select("term").unionByName(units.sparkSession.createDataFrame([("",)], "term string")).distinct()
    stored = cut(spread.join(wanted, "term", "left_semi").groupBy(id_col, "term").agg(F.sum("w").alias("tf"), F.first("len").alias("len")))
    n, mean = stored.where("term = ''").agg(F.count("*"), F.avg("len")).first()
    tf = stored.where("term <> ''")
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.greatest(F.lit(1e-6), F.log((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(float(mean or 1))))
    return tf.join(df, "term").join(asked, "term").groupBy(query_id, id_col).agg(F.round(F.sum(part), 6).alias("score"))


def restricted(scored: DataFrame, wanted: DataFrame, group: str, item: str) -> DataFrame:
    """The score of every wanted pair, 0 where it has none."""
    return wanted.select(group, item).join(scored.select(group, item, "score"), [group, item], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def top_k(scored: DataFrame, group: str | list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k of each group by a total order; Spark cuts groups before the shuffle."""
    w = Window.partitionBy(*([group] if isinstance(group, str) else group)).orderBy(*order)
    return scored.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def integer_fusion(features: DataFrame, weights: dict[str, int]) -> DataFrame:
    """fused = sum of integer features times integer weights."""
    return features.withColumn("fused", sum((F.col(c).cast("long") * F.lit(w) for c, w in weights.items()), F.lit(0).cast("long")))


def weighted_sum(weights: dict[str, float]) -> Column:
    return sum((F.col(c) * F.lit(float(w)) for c, w in weights.items()), F.lit(0.0))


def min_max(c: str, group: str) -> Column:
    """The column scaled to [0, 1] within its group, 1 where the group is level."""
    w = Window.partitionBy(group)
    lo, hi = F.min(c).over(w), F.max(c).over(w)
    return F.when(hi == lo, 1.0).otherwise((F.col(c) - lo) / (hi - lo))


def proximity(tokens: Column, terms: Column, slack: int = 4) -> Column:
    """Whether the first places of all terms lie within their number plus the slack."""
    places = F.transform(terms, lambda t: F.array_position(tokens, t))
    return (F.size(terms) > 0) & F.forall(places, lambda p: p > 0) & ((F.array_max(places) - F.array_min(places)) <= F.size(terms) + slack)


def round_robin(rows: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """Item i of every group before item i + 1 of any, k in all."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= k).orderBy("turn", group).limit(k)


def capped_prefix(rows: DataFrame, group: str, order: list[Column], cost: str, cap: int) -> DataFrame:
    """Rows while their running cost stays within the cap; saturated says whether the group was cut."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumn("running", F.sum(cost).over(w)).withColumn("saturated", F.sum(cost).over(Window.partitionBy(group)) > cap)
    return run.where(F.col("running") <= cap)


def priority_fill(channels: list[DataFrame], group: str, item: str, k: int) -> DataFrame:
    """Union of (group, item, score) channels in order of priority, first wins, one cap."""
    both = None
    for p, c in enumerate(channels):
        part = c.select(group, item, "score").withColumn("priority", F.lit(p))
        both = part if both is None else both.unionByName(part)
    first = both.groupBy(group, item).agg(F.min(F.struct("priority", (-F.col("score")).alias("s"))).alias("x"), F.max("score").alias("score"))
    return top_k(first.select(group, item, F.col("x.priority").alias("priority"), "score"), group, [F.col("priority"), F.desc("score"), F.col(item)], k)


def canonical_union(channels: dict[str, DataFrame], group: str, item: str, k: int) -> DataFrame:
    """Proposals of all channels joined by item, then exactly one cap; what is over it keeps retained = false."""
    both = None
    for name, c in channels.items():
        part = c.select(group, item, "score").withColumn("channel", F.lit(name))
        both = part if both is None else both.unionByName(part)
    merged = both.groupBy(group, item).agg(F.max("score").alias("score"), F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("channels"))
    w = Window.partitionBy(group).orderBy(F.desc("score"), F.col(item))
    return merged.withColumn("rank", F.row_number().over(w)).withColumn("retained", F.col("rank") <= k)
