"""Calibration, coverage and percentile measures."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut


def ece_bins(rows: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """(bin, n, mean_score, accuracy): equal width, the last bin closed."""
    b = F.least(F.lit(bins - 1), F.floor(F.col(score) * bins)).cast("long")
    return rows.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("accuracy"))


def equal_frequency_bins(rows: DataFrame, score: str, tie: str, label: str, bins: int = 10) -> DataFrame:
    """(bin, n, upper, accuracy) of slices b * n // bins of the rows in order of score.

    Rows are ranked across range partitions: no task sorts or numbers them all.
    """
    n = rows.count()
    ranked = global_rank(rows, [F.col(score), F.col(tie)])
    b = (F.ceil(F.col("rank") * bins / F.lit(n)) - 1).cast("long")
    return ranked.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.max(score).alias("upper"), F.avg(F.col(label).cast("double")).alias("accuracy"))


def dealt_by_range(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with _part, the range that holds them, stored.

    Ranges are drawn from a sample and then merged, both anew for every plan that reads them,
    so sizes and rows that are to agree must come from the same stored deal.
    """
    return cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


def global_rank(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with rank, from 1, in a total order: ranks within range partitions plus the sizes of those before.

    The only thing gathered is one count per partition.
    """
    dealt = dealt_by_range(rows, order)
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).alias("_before"))
    r = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("rank", r).join(F.broadcast(before), "_part").withColumn("rank", F.col("rank") + F.coalesce("_before", F.lit(0))).drop("_part", "_before")


def percentiles(rows: DataFrame, group: str, value: str, tie: str, p: float) -> DataFrame:
    """(group, nearest_rank, interpolated, rounded_index): three definitions of a percentile of a few groups.

    One sort across range partitions ranks all groups, however large, one after the other; a
    group's own ranks start after the sizes of the groups before it.
    """
    ranked = global_rank(rows, [F.col(group), F.col(value), F.col(tie)])
    sizes = rows.groupBy(group).agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    k, at = F.col("rank") - F.col("_before"), (F.col("_n") - 1) * p
    place = lambda i: F.max(F.when(k == i, F.col(value)))
    low, high = place(F.floor(at) + 1), place(F.ceil(at) + 1)
    return ranked.join(before, group).groupBy(group).agg(
        place(F.greatest(F.lit(1), F.ceil(F.round(F.col("_n") * p, 9)))).alias("nearest_rank"),
        (low + (high - low) * F.max(at - F.floor(at))).alias("interpolated"), place(1 + F.bround(at)).alias("rounded_index"),
    )


def risk_coverage(rows: DataFrame, score: str, tie: str, correct: str) -> DataFrame:
    """rows with rank, and the running accuracy of all at least as confident, over range partitions."""
    order = [F.desc(score), F.col(tie)]
    ranked = dealt_by_range(rows, order)
    sizes = ranked.groupBy("_part").agg(F.count("*").alias("_n"), F.sum(F.col(correct).cast("long")).alias("_c"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_c0"))
    own = Window.partitionBy("_part").orderBy(*order)
    out = ranked.withColumn("rank", F.row_number().over(own)).withColumn("_run", F.sum(F.col(correct).cast("long")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.join(F.broadcast(before), "_part").withColumn("rank", F.col("rank") + F.col("_n0"))
    return out.withColumn("accuracy", (F.col("_run") + F.col("_c0")) / F.col("rank")).drop("_part", "_n0", "_c0", "_run")


def isotonic(bins: DataFrame, order: str, value: str, weight: str) -> DataFrame:
    """Pool-adjacent-violators fit over bins (a bounded number of rows): fitted per row of `order`."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pools: list[list[float]] = []
        for v, w in zip(pdf[value], pdf[weight], strict=True):
            pools.append([v, w, 1])
            while len(pools) > 1 and pools[-2][0] > pools[-1][0]:
                v2, w2, n2 = pools.pop()
                v1, w1, n1 = pools.pop()
                pools.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
        return pd.DataFrame({order: pdf[order], "fitted": [p[0] for p in pools for _ in range(int(p[2]))]})

    one = bins.select(order, F.col(value).cast("double").alias(value), F.col(weight).cast("double").alias(weight), F.lit(0).alias("_all"))
    return one.groupBy("_all").applyInPandas(lambda pdf: fit(pdf.sort_values(order)), f"{order} long, fitted double")
