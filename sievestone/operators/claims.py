"""Claims and their order: filters, enumeration, temporal order, adjacent and comparable values.

A claim has claim_id, subject, relation, object, family and ts. Nothing here collects a
subject's claims into one row unless the result asks for it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def select_claims(claims: DataFrame, subjects: Sequence | None = None, relations: Sequence | None = None, sources: Sequence | None = None, times: Sequence[str] | None = None) -> DataFrame:
    """Claims whose subject, relation and source are wanted, and whose date holds one of the parts of dates in `times`."""
    for name, wanted in (("subject", subjects), ("relation", relations), ("family", sources)):
        if wanted is not None:
            claims = claims.where(F.col(name).isin(list(wanted)))
    if times is not None:
        day, any_ = F.date_format("ts", "yyyy-MM-dd"), F.lit(False)
        for part in times:
            any_ = any_ | day.contains(part)
        claims = claims.where(any_)
    return claims


def by_family(claims: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and family, the distinct claim ids in order."""
    return claims.groupBy(*keys, "family").agg(F.array_sort(F.collect_set("claim_id")).alias("claim_ids"))


def enumerated(claims: DataFrame, key: str, value: str) -> DataFrame:
    """The key's distinct values, numbered by first appearance: a row a value."""
    first = claims.groupBy(key, value).agg(F.min("claim_id").alias("first_id"))
    return first.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy("first_id", value)))


def extremes(claims: DataFrame, keys: list[str]) -> DataFrame:
    """The earliest and the latest claim of a key, ties by id, with map-side partial aggregates."""
    at = F.struct("ts", "claim_id", "object")
    out = claims.groupBy(*keys).agg(F.min(at).alias("a"), F.max(at).alias("b"))
    return out.select(*keys, F.col("a.claim_id").alias("earliest_id"), F.col("a.object").alias("earliest"), F.col("b.claim_id").alias("latest_id"), F.col("b.object").alias("latest"))


def ordered(claims: DataFrame, key: str) -> DataFrame:
    return claims.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("ts", "claim_id")))


def adjacent_pairs(claims: DataFrame, keys: list[str]) -> DataFrame:
    """Claims 2k and 2k + 1 of a key in temporal order whose values differ."""
    w = Window.partitionBy(*keys).orderBy("ts", "claim_id")
    out = claims.withColumn("r", F.row_number().over(w)).withColumn("next_id", F.lead("claim_id").over(w)).withColumn("next_object", F.lead("object").over(w))
    return out.where("r % 2 = 1 AND next_object <> object").select(*keys, "claim_id", "next_id", "object", "next_object")


def join_by_entity(claims: DataFrame, roles: Sequence[str], entities: DataFrame, relations: Sequence | None = None) -> DataFrame:
    """Claims that name one of the entities (entity) in any role; each once."""
    wanted = claims if relations is None else claims.where(F.col("relation").isin(list(relations)))
    named = wanted.select("claim_id", F.explode(F.array_distinct(F.array(*(F.col(r).cast("string") for r in roles)))).alias("entity"))
    return wanted.join(named.join(entities.select(F.col("entity").cast("string")).distinct(), "entity").select("claim_id").distinct(), "claim_id", "left_semi")


def compare_quantities(a: Column, unit_a: Column, b: Column, unit_b: Column) -> Column:
    """-1, 0 or 1; null where the units differ."""
    return F.when(unit_a == unit_b, F.signum(a - b).cast("int"))


def mode_disagreement(votes: DataFrame, key: str, choice: str) -> DataFrame:
    """1 less the share of the key's most frequent choice."""
    n = votes.groupBy(key, choice).agg(F.count("*").alias("n"))
    return n.groupBy(key).agg((1 - F.max("n") / F.sum("n")).alias("disagreement"), F.count("*").alias("choices"))


def trigram_cosine(a: Column, b: Column) -> Column:
    """Cosine of the counts of character trigrams, at most 1; 0 where a side has none."""

    def grams(x: Column) -> Column:
        low = F.lower(x)
        return F.when(F.length(x) >= 3, F.transform(F.sequence(F.lit(1), F.length(x) - 2), lambda i: F.substr(low, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))

    times = lambda xs, g: F.size(F.filter(xs, lambda y: y == g))
    total = lambda xs, f: F.aggregate(F.array_distinct(xs), F.lit(0.0), lambda s, g: s + f(g))
    x, y = grams(a), grams(b)
    dot = total(x, lambda g: times(x, g) * times(y, g))
    norm = F.sqrt(total(x, lambda g: times(x, g) * times(x, g)) * total(y, lambda g: times(y, g) * times(y, g)))
    return F.when(norm > 0, F.least(F.lit(1.0), dot / norm)).otherwise(0.0)
