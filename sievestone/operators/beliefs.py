"""Beliefs of several experts over labels: their disagreement and their fusion.

Rows are (case, expert, label, p) with one gate and one precision an expert and case, and
priors (case, label, p). Labels an expert leaves out count with the floor; nothing is
gathered: each case's labels and experts are grouped by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the least probability of a label.
FLOOR = 1e-12


def aligned(beliefs: DataFrame, labels: DataFrame, by: list[str]) -> DataFrame:
    """Every expert's p over all labels of its case, floored and scaled to one."""
    experts = beliefs.select(*by).distinct()
    full = experts.join(labels, by[0]).join(beliefs.select(*by, "label", "p"), [*by, "label"], "left")
    p = F.greatest(F.coalesce("p", F.lit(0.0)), F.lit(FLOOR))
    return full.select(*by, "label", (p / F.sum(p).over(Window.partitionBy(*by))).alias("p"))


def softmax(logit: Column, by: str | list[str]) -> Column:
    w = Window.partitionBy(*([by] if isinstance(by, str) else by))
    e = F.exp(logit - F.max(logit).over(w))
    return e / F.sum(e).over(w)


def entropy(p: Column, n: Column) -> Column:
    """Entropy over the logarithm of the number of labels, 0 for one label."""
    return F.when(n > 1, -F.sum(p * F.log(p)) / F.log(n)).otherwise(0.0)


def disagreement(beliefs: DataFrame) -> DataFrame:
    """(case, js, top1, rank, entropy, contradiction, aggregate): 0 to 1 each, 0 for a lone expert; the aggregate is the largest.

    Pairs of experts are never formed but for their contradiction: the rank distance over
    pairs follows from each label's sorted ranks, and the two experts who contradict most are
    the surest of the two surest different labels.
    """
    labels = beliefs.select("case", "label").distinct()
    a = aligned(beliefs, labels, ["case", "expert"])
    a = a.withColumn("rank", F.row_number().over(Window.partitionBy("case", "expert").orderBy(F.desc("p"), "label")) - 1)
    own = Window.partitionBy("case", "label")
    a = a.withColumn("mean", F.avg("p").over(own)).withColumn("order", F.row_number().over(own.orderBy("rank"))).withColumn("m", F.count("*").over(own))
    per = a.groupBy("case", "expert").agg(
        F.sum(F.col("p") * F.log(F.col("p") / F.col("mean"))).alias("kl"), entropy(F.col("p"), F.count("*")).alias("h"),
        F.min_by("label", "rank").alias("top"), F.max("p").alias("sure"), F.count("*").alias("k"), F.max("m").alias("m"),
        F.sum(F.col("rank") * (2 * F.col("order") - F.col("m") - 1)).alias("spread"),
    )
    best = per.groupBy("case", "top").agg(F.max("sure").alias("sure"))
    best = best.withColumn("place", F.row_number().over(Window.partitionBy("case").orderBy(F.desc("sure"), "top")))
    against = best.groupBy("case").agg(F.coalesce(F.max(F.when(F.col("place") == 2, F.col("sure"))), F.lit(0.0)).alias("contradiction"), F.count("*").alias("tops"))
    one = per.groupBy("case").agg(F.avg("kl").alias("kl"), (F.max("h") - F.min("h")).alias("h"), F.first("k").alias("k"), F.first("m").alias("m"), F.sum("spread").alias("spread"))
    lone = F.col("m") < 2
    pairs = F.col("m") * (F.col("m") - 1) / 2
    out = one.join(against, "case").select(
        "case", F.when(lone, 0.0).otherwise(F.least(F.lit(1.0), F.col("kl") / F.log(F.lit(2.0)))).alias("js"), F.when(lone, 0.0).otherwise((F.col("tops") - 1) / (F.col("m") - 1)).alias("top1"),
        F.when(lone, 0.0).otherwise(F.least(F.lit(1.0), F.col("spread") / pairs / (F.col("k") * F.greatest(F.lit(1), F.col("k") - 1)))).alias("rank"),
        F.when(lone, 0.0).otherwise(F.least(F.lit(1.0), F.col("h"))).alias("entropy"), F.when(lone, 0.0).otherwise(F.col("contradiction")).alias("contradiction"),
    )
    return out.withColumn("aggregate", F.least(F.lit(1.0), F.greatest("js", "top1", "rank", "entropy", "contradiction")))


def fuse(prior: DataFrame, beliefs: DataFrame, experts: DataFrame, temperature: float = 1.0, particles: int = 8, learned: dict[str, float] | None = None) -> DataFrame:
    """(method, case, label, p) of weighted logits, a tempered product, precision-weighted residuals, learned gates and the best particles.

    experts: (case, expert, gate, precision). Each method is a sum of weighted log
    probabilities and a softmax; `particles` keeps that many labels, the rest is 'unresolved'.
    """
    w = {"prior": 1.0, "bias": 0.0, "reliability": 1.0, "entropy": -1.0, "disagreement": -1.0} | (learned or {})
    labels = prior.select("case", "label").unionByName(beliefs.select("case", "label")).distinct()
    p0 = aligned(prior.withColumn("_prior", F.lit(0)), labels, ["case", "_prior"]).select("case", "label", F.log("p").alias("l0"))
    a = aligned(beliefs, labels, ["case", "expert"])
    own = Window.partitionBy("case", "expert")
    h = F.when(F.count("*").over(own) > 1, -F.sum(F.col("p") * F.log("p")).over(own) / F.log(F.count("*").over(own))).otherwise(0.0)
    a = a.withColumn("h", h).join(experts, ["case", "expert"]).join(disagreement(beliefs).select("case", "aggregate"), "case")
    z = F.lit(w["bias"]) + w["reliability"] * F.col("precision") + w["entropy"] * F.col("h") + w["disagreement"] * F.col("aggregate")
    gate = F.col("gate") / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), z))))
    lp = F.log("p")
    s = a.groupBy("case", "label").agg(
        F.sum(F.col("gate") * lp).alias("plain"), F.sum(F.col("gate") * F.col("precision") * lp).alias("precise"), F.sum(F.col("gate") * F.col("precision")).alias("weight"), F.sum(gate * lp).alias("gated"),
    ).join(p0, ["case", "label"])
    methods = {
        "weighted_logit": F.col("l0") + F.col("plain"), "temperature_product": F.col("l0") + F.col("plain") / temperature,
        "precision_residual": (F.col("l0") + F.col("precise")) / (1 + F.col("weight")), "learned": w["prior"] * F.col("l0") + F.col("gated"),
    }
    methods["particle_top_k"] = methods["temperature_product"]
    long = s.select("case", "label", F.explode(F.create_map(*(x for k, c in methods.items() for x in (F.lit(k), c)))).alias("method", "logit"))
    out = long.select("method", "case", "label", softmax(F.col("logit"), ["method", "case"]).alias("p"))
    place = F.row_number().over(Window.partitionBy("method", "case").orderBy(F.desc("p"), "label"))
    over = (F.col("method") == "particle_top_k") & (F.col("place") > particles)
    return out.withColumn("place", place).groupBy("method", "case", F.when(over, "unresolved").otherwise(F.col("label")).alias("label")).agg(F.sum("p").alias("p"))
