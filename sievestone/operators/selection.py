"""Choice of evidence: features of a question and a candidate, two scores, gaps, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Words that carry nothing, words that ask who said it.
STOP = ("about", "after", "also", "and", "are", "article", "characterized", "discusses", "from", "identify", "into", "its", "related", "section", "starting", "that", "the", "their", "this", "through", "topic", "traverse", "what", "when", "where", "which", "whose", "with")
ATTRIBUTION = ("said", "says", "stated", "wrote", "quoted", "according", "attributed")
#: Features in order; weights of the plain sum; weights, scale and bias of the int8 reranker; the blend.
FEATURES = ("body", "title", "alias", "entity", "section", "position", "lexical", "time", "category", "link", "direct", "attribution", "answerable", "trigrams")
FUSION = (0.50, 0.02, 0.50, 0.05, 0.25, 0.00, 0.05, 0.05, 0.00, 0.00, 0.00, 0.25, 0.12, 0.00)
INT8, SCALE, BIAS = (0, 127, 64, -22, -125, -8, 27, -28, -4, 4, 0, -4, 47, 70), 0.05353113826893283, 0.0
BLEND = (0.45, 0.55)

WORD = r"([\p{L}\p{N}][\p{L}\p{N}_'-]*)"
NAMED = r"(?:^|[^\p{L}\p{N}_])([A-Z0-9][\p{L}\p{N}_'-]*(?:\s+[A-Z0-9][\p{L}\p{N}_'-]*)*)"
YEAR = r"\b(1[5-9][0-9]{2}|20[0-9]{2}|2100)\b"


def terms(c: Column) -> Column:
    """Distinct lower-case words of three letters or more that are no stop words."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit(WORD), 1), lambda x: (F.length(x) > 2) & ~x.isin(*STOP)))


def ratio(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1))


def trigram_cosine(a: Column, b: Column) -> Column:
    """Cosine of two texts' framed trigrams, as sets."""
    x, y = T.gram_set(F.lower(a)), T.gram_set(F.lower(b))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.sqrt(F.size(x) * F.size(y)))


def prepared(rows: DataFrame, question: str = "question", body: str = "body", title: str = "title", section: str = "section") -> DataFrame:
    """rows with the term sets that several features read, each made once."""
    names = F.array_join(F.regexp_extract_all(F.col(question), F.lit(NAMED), 1), " ")
    return rows.withColumns({
        "_q": terms(F.col(question)), "_b": terms(F.col(body)), "_t": terms(F.col(title)), "_s": terms(F.col(section)), "_e": terms(names),
        "_qy": F.array_distinct(F.regexp_extract_all(F.col(question), F.lit(YEAR), 1)), "_by": F.array_distinct(F.regexp_extract_all(F.col(body), F.lit(YEAR), 1)),
    })


def features(rows: DataFrame) -> DataFrame:
    """rows with the fourteen features, as columns.

    Needed: question, body, title, section, aliases (lower case), position (from 0), lexical
    (0 to 1), categories, asked_categories, link (0 to 1).
    """
    p = prepared(rows)
    plain = F.concat(F.lit(" "), F.regexp_replace(F.lower("question"), r"[^\p{L}\p{N}_'-]+", " "), F.lit(" "))
    said = F.array(*map(F.lit, ATTRIBUTION))
    seen = F.array_union("_b", "_t")
    body = ratio(F.col("_q"), F.col("_b"))
    whole = {
        "body": body, "title": ratio(F.col("_q"), F.col("_t")), "alias": F.exists("aliases", lambda a: plain.contains(F.concat(F.lit(" "), a, F.lit(" ")))).cast("double"),
        "entity": ratio(F.col("_e"), seen), "section": ratio(F.col("_q"), F.col("_s")), "position": 1 / (1 + F.col("position")), "lexical": F.col("lexical"),
        "time": F.when(F.size("_qy") == 0, 1.0).otherwise(ratio(F.col("_qy"), F.col("_by"))), "category": ratio(F.col("asked_categories"), F.col("categories")), "link": F.col("link").cast("double"),
        "direct": F.least(F.lit(1.0), body * F.when(F.length("body") <= 480, 1.0).otherwise(0.75)),
        "attribution": F.when(~F.arrays_overlap("_q", said), 1.0).otherwise((F.arrays_overlap("_b", said) | F.col("body").rlike("[\"“]")).cast("double")),
        "answerable": F.least(F.lit(1.0), 0.55 * body + 0.25 * ratio(F.col("_e"), seen) + 0.2 * F.col("body").rlike("[.!?]").cast("double")),
        "trigrams": trigram_cosine(F.col("question"), F.col("body")),
    }
    return p.withColumn("f", F.struct(*(whole[name].cast("double").alias(name) for name in FEATURES))).drop("_q", "_b", "_t", "_s", "_e", "_qy", "_by")


def scores(rows: DataFrame, fusion: tuple[float, ...] = FUSION, int8: tuple[int, ...] = INT8, scale: float = SCALE, bias: float = BIAS) -> DataFrame:
    """rows with deterministic, reranker (the logistic of the int8 model) and final, their blend."""
    plain = sum((F.col(f"f.{name}") * w for name, w in zip(FEATURES, fusion, strict=True)), F.lit(0.0))
    z = sum((F.col(f"f.{name}") * (w * scale) for name, w in zip(FEATURES, int8, strict=True)), F.lit(bias))
    out = rows.withColumns({"deterministic": plain, "reranker": 1 / (1 + F.exp(-z))})
    return out.withColumn("final", BLEND[0] * F.col("deterministic") + BLEND[1] * F.col("reranker"))


def missing_facets(scored: DataFrame, questions: DataFrame, key: str, rank: str = "rank", selected: int = 8) -> DataFrame:
    """(key, missing): what the selected evidence of every question lacks; source_support where there is none."""
    s = scored.where(F.col(rank) <= selected).groupBy(key).agg(F.max("f.time").alias("time"), F.max("f.entity").alias("entity"), F.max("f.attribution").alias("attribution"), F.min_by("f.answerable", rank).alias("answerable"))
    q = questions.select(key, (F.size(F.regexp_extract_all("question", F.lit(YEAR), 1)) > 0).alias("_y"), (F.size(terms(F.array_join(F.regexp_extract_all("question", F.lit(NAMED), 1), " "))) > 0).alias("_e"))
    gaps = F.array_compact(F.array(
        F.when(F.col("_y") & (F.col("time") == 0), "temporal_fit"), F.when(F.col("_e") & (F.col("entity") < 0.5), "entity_fit"),
        F.when(F.col("attribution") < 1, "attribution_fit"), F.when(F.col("answerable") < 0.45, "answerability"),
    ))
    return q.join(s, key, "left").select(key, F.when(F.col("answerable").isNull(), F.array(F.lit("source_support"))).otherwise(gaps).alias("missing"))


def evaluation(scored: DataFrame, gold: DataFrame, gaps: DataFrame, key: str, item: str, rank: str = "rank", at: tuple[int, ...] = (1, 3, 8), sure: float = 0.6) -> DataFrame:
    """One row: questions, recall at each k, answer rate and the share of answers without the gold item.

    A question is answered if its best candidate is sure and nothing is missing.
    """
    hit = scored.join(gold.select(key, F.col(item).alias("_gold")), key).groupBy(key).agg(F.min(F.when(F.col(item) == F.col("_gold"), F.col(rank))).alias("hit"), F.max(F.when(F.col(rank) == 1, F.col("final"))).alias("best"))
    each = gold.select(key).join(hit, key, "left").join(gaps, key)
    answered = (F.col("best") >= sure) & (F.size("missing") == 0)
    recalls = [F.avg(F.coalesce((F.col("hit") <= k).cast("double"), F.lit(0.0))).alias(f"recall_{k}") for k in at]
    n = F.count(F.when(answered, 1))
    return each.agg(F.count("*").alias("questions"), *recalls, (n / F.count("*")).alias("answer_rate"), F.coalesce(F.count(F.when(answered & (F.coalesce("hit", F.lit(0)) != 1), 1)) / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("unsupported_rate"))
