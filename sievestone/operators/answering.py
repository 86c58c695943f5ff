"""Frames, claims and decisions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cues of answer shapes, first match wins.
SHAPE_CUES = {
    "date": r"\b(when|year|date)\b",
    "quantity": r"\b(how many|number|count|amount)\b",
    "person": r"\b(who|whom|whose)\b",
    "place": r"\b(where|city|country)\b",
    "statement": r"\b(is|are|was|were)\b",
}
#: Certified conversions (from, to): factor.
UNITS = {("kg", "g"): 1000.0, ("g", "kg"): 0.001, ("m", "cm"): 100.0, ("cm", "m"): 0.01, ("s", "ms"): 1000.0, ("ms", "s"): 0.001}


def answer_shape(text: Column) -> Column:
    out = F.lit("span")
    for shape, cue in reversed(SHAPE_CUES.items()):
        out = F.when(F.lower(text).rlike(cue), shape).otherwise(out)
    return out


def convert(value: Column, unit: Column, wanted: str) -> Column:
    """The value in the wanted unit; null where no conversion is certified."""
    out = F.when(unit == wanted, value.cast("double"))
    for (a, b), factor in UNITS.items():
        if b == wanted:
            out = out.when(unit == a, value * factor)
    return out


def contradictions(values: DataFrame) -> DataFrame:
    """Pairs of different objects of one (subject, relation) from unlike family sets, each pair once."""
    a = values.select("subject", "relation", F.col("object").alias("object_a"), F.col("fam").alias("fa"))
    b = values.select("subject", "relation", F.col("object").alias("object_b"), F.col("fam").alias("fb"))
    return a.join(b, ["subject", "relation"]).where("object_a < object_b AND fa <> fb").select("subject", "relation", "object_a", "object_b")


def greedy_diversity(rows: DataFrame, group: str, item: str, score: str, family: str, k: int, bonus: float = 0.06) -> DataFrame:
    """Greedy top k per group, where a family not chosen yet adds a bonus.

    Candidates are first cut, exactly, to the best k of each family, which is all that greedy
    choice can reach; families per group bound what a task holds.
    """
    best = rows.withColumn("_r", F.row_number().over(Window.partitionBy(group, family).orderBy(F.desc(score), item))).where(F.col("_r") <= k)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        left, seen, out = pdf.to_dict("records"), set(), []
        while left and len(out) < k:
            top = min(left, key=lambda r: (-(r[score] + (bonus if r[family] not in seen else 0)), r[item]))
            left.remove(top)
            seen.add(top[family])
            out.append({group: top[group], item: top[item], family: top[family], "step": len(out) + 1})
        return pd.DataFrame(out, columns=[group, item, family, "step"])

    kinds = dict(rows.dtypes)
    return best.select(group, item, score, family).groupBy(group).applyInPandas(choose, f"{group} {kinds[group]}, {item} {kinds[item]}, {family} {kinds[family]}, step long")
