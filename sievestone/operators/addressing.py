"""Addresses: which entity a mention names, which claims an entity has, how well both fit a question.

A frame is a question's reading: frame_id, entities, relations (arrays, empty for "any"),
shape ("unknown" for any), times (parts of dates) and attributed (whether it asks who said so).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Channels in order of trust; weights of a mention's hypothesis and of a claim's fit; thresholds.
CHANNELS = ("title", "redirect", "alias", "anchor")
HYPOTHESIS = {"name": 0.62, "type": 0.12, "relation": 0.16, "context": 0.10}
CLAIM_FIT = {"entity": 0.32, "relation": 0.27, "shape": 0.21, "time": 0.08, "attribution": 0.07, "confidence": 0.05}
LINK_THRESHOLD, LINK_MARGIN = 0.82, 0.08
LOOSE_SHAPES = ("entity", "definition", "list")
LIST_SHAPES = ("list", "entity", "definition", "date", "quantity")


def distributions(rows: DataFrame, retained: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hypotheses, masses) of mentions.

    rows: mention, entity (null where the target is unresolved), occurrences, documents, a row
    a target; retained: mention, entity, confidence, position of what a linker kept. A
    hypothesis joins the rows of one entity; what was kept only annotates it. masses has one
    row a mention of rows: its total, its unresolved share, its probability mass in all, its
    entropy over targets, and how many entities were kept without any support.
    """
    total = rows.groupBy("mention").agg(F.sum("occurrences").alias("total"))
    p = rows.join(total, "mention").withColumn("p", F.col("occurrences") / F.col("total"))
    joined = p.where("entity IS NOT NULL").groupBy("mention", "entity").agg(
        F.sum("p").alias("probability"), F.sum("occurrences").alias("occurrences"), F.max("documents").alias("documents"), F.max(F.col("documents") / F.col("occurrences")).alias("diversity"),
    )
    kept = retained.groupBy("mention", "entity").agg(F.min(F.struct("position", "confidence")).alias("x")).select("mention", "entity", F.col("x.position").alias("retained_rank"), F.col("x.confidence").alias("confidence"))
    rank = F.row_number().over(Window.partitionBy("mention").orderBy(F.desc(F.round("probability", 9)), "entity"))
    hypotheses = joined.withColumn("rank", rank).join(kept, ["mention", "entity"], "left")
    lost = kept.join(joined, ["mention", "entity"], "left_anti").groupBy("mention").agg(F.count("*").alias("unsupported"))
    masses = p.groupBy("mention").agg(
        F.first("total").alias("total"), F.coalesce(F.sum(F.when(F.col("entity").isNull(), F.col("p"))), F.lit(0.0)).alias("unresolved"), F.sum("p").alias("mass"), (-F.sum(F.col("p") * F.log("p"))).alias("entropy"),
    )
    return hypotheses, masses.join(lost, "mention", "left").fillna(0, ["unsupported"])


def channel_proposals(aliases: DataFrame, anchors: DataFrame) -> DataFrame:
    """A row a surface, entity and channel: support, provenance, ranks and score.

    aliases: surface, entity, kind, redirected, provenance; anchors: surface, entity,
    provenance; entities already resolved, null where they could not be. An anchor's score is its share of
    all the surface's anchors, resolved or not. channel_rank counts within a channel;
    entity_rank numbers entities by their first place in order of channel, support and id.
    """
    channel = F.when(F.col("redirected"), "redirect").when(F.col("kind") == "title", "title").otherwise("alias")
    both = aliases.select("surface", "entity", channel.alias("channel"), "provenance").unionByName(anchors.select("surface", "entity", F.lit("anchor").alias("channel"), "provenance"))
    grouped = both.where("entity IS NOT NULL").groupBy("surface", "entity", "channel").agg(F.count("*").alias("support"), F.countDistinct("provenance").alias("provenances"))
    n = anchors.groupBy("surface").agg(F.count("*").alias("_anchors"))
    order = F.array_position(F.array(*map(F.lit, CHANNELS)), F.col("channel"))
    all_ = Window.partitionBy("surface")
    placed = grouped.withColumn("_place", F.row_number().over(all_.orderBy(order, F.desc("support"), "entity")))
    placed = placed.withColumn("_first", F.min("_place").over(Window.partitionBy("surface", "entity")))
    ranked = placed.withColumn("entity_rank", F.dense_rank().over(all_.orderBy("_first"))).withColumn("channel_rank", F.row_number().over(Window.partitionBy("surface", "channel").orderBy(F.desc("support"), "entity")))
    score = F.when(F.col("channel") == "anchor", F.col("support") / F.col("_anchors")).otherwise(1.0)
    return ranked.join(n, "surface", "left").withColumn("channel_score", score).drop("_place", "_first", "_anchors")


def overlap_share(wanted: Column, have: Column) -> Column:
    """The share of the wanted values that are there; 1 where nothing is wanted."""
    w = F.array_distinct(wanted)
    return F.when(F.size(w) == 0, 1.0).otherwise(F.size(F.array_intersect(w, have)) / F.size(w))


def hypothesis_confidence(name: Column, expected_types: Column, types: Column, wanted_relations: Column, relations: Column, question: Column, context: Column) -> Column:
    """Confidence that a mention names an entity: its name, type, relations and context words, at most 1."""
    parts = {
        "name": name, "type": F.when(F.size(expected_types) == 0, 1.0).otherwise(F.arrays_overlap(expected_types, types).cast("double")), "relation": overlap_share(wanted_relations, relations),
        "context": F.size(F.array_intersect(question, context)) / F.greatest(F.size(F.array_distinct(context)), F.lit(1)),
    }
    return F.least(F.lit(1.0), sum((w * parts[k] for k, w in HYPOTHESIS.items()), F.lit(0.0)))


def linked(candidates: DataFrame, mention: str, entity: str, confidence: str, threshold: float = LINK_THRESHOLD, margin: float = LINK_MARGIN) -> DataFrame:
    """The best candidate of every mention and a decision: linked, ambiguous (the next is too near) or unknown (too weak)."""
    w = Window.partitionBy(mention).orderBy(F.desc(confidence), entity)
    best = candidates.withColumn("_rank", F.row_number().over(w)).withColumn("_next", F.lead(confidence).over(w)).where("_rank = 1")
    near = F.round(F.col(confidence) - F.coalesce("_next", F.lit(0.0)), 9) < margin
    return best.withColumn("decision", F.when(F.col(confidence) < threshold, "unknown").when(near, "ambiguous").otherwise("linked")).drop("_rank", "_next")


def shape_matches(asked: Column, found: Column) -> Column:
    """Whether a claim's shape can answer a frame's."""
    return (asked == "unknown") | (asked == found) | ((asked == "comparison") & (found == "quantity")) | ((asked == "list") & found.isin(*LIST_SHAPES))


def claim_lookup(frames: DataFrame, claims: DataFrame, limit: int = 16) -> DataFrame:
    """The claims at a frame's addresses, best `limit` first; eligible counts them before that cap.

    Without relations an entity's address holds all its claims; with relations it holds those
    only, and a relation that an entity lacks brings nothing. claims: claim_id, subject,
    relation, shape, confidence.
    """
    f = frames.select("frame_id", "shape", "relations", F.explode(F.array_distinct("entities")).alias("subject"))
    met = f.withColumnRenamed("shape", "_asked").join(claims, "subject")
    met = met.where(((F.size("relations") == 0) | F.array_contains("relations", F.col("relation"))) & shape_matches(F.col("_asked"), F.col("shape"))).drop("_asked", "relations")
    n = met.groupBy("frame_id").agg(F.count("*").alias("eligible"))
    w = Window.partitionBy("frame_id").orderBy(F.desc("confidence"), "subject", "relation", "claim_id")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).join(n, "frame_id")


def unresolved_addresses(frames: DataFrame, claims: DataFrame) -> DataFrame:
    """(frame_id, entities, relations): entities without claims, and relations that some entity with claims lacks, in order."""
    known = claims.select("subject", "relation").distinct()
    f = frames.select("frame_id", "relations", F.explode(F.array_distinct("entities")).alias("subject"))
    subjects = known.select("subject").distinct()
    lost = f.join(subjects, "subject", "left_anti").groupBy("frame_id").agg(F.array_sort(F.collect_set("subject")).alias("entities"))
    asked = f.join(subjects, "subject", "left_semi").select("frame_id", "subject", F.explode(F.array_distinct("relations")).alias("relation"))
    missing = asked.join(known, ["subject", "relation"], "left_anti").groupBy("frame_id").agg(F.array_sort(F.collect_set("relation")).alias("relations"))
    return frames.select("frame_id").join(lost, "frame_id", "left").join(missing, "frame_id", "left").select("frame_id", *(F.coalesce(c, F.array()).alias(c) for c in ("entities", "relations")))


def claim_fit() -> Column:
    """How well a claim fits a frame, 0 to 1.

    Read are the frame's entities, relations, asked (its shape), times and attributed, and the
    claim's subject, relation, shape, day (text), spoken (whether a speaker is known) and confidence.
    """
    loose = F.col("shape").isin(*LOOSE_SHAPES) & F.col("asked").isin(*LOOSE_SHAPES)
    parts = {
        "entity": ((F.size("entities") == 0) | F.array_contains("entities", F.col("subject"))).cast("double"),
        "relation": ((F.size("relations") == 0) | F.array_contains("relations", F.col("relation"))).cast("double"),
        "shape": F.when((F.col("asked") == "unknown") | (F.col("asked") == F.col("shape")), 1.0).when(loose, 0.2).otherwise(0.0),
        "time": ((F.size("times") == 0) | F.exists("times", lambda x: F.col("day").contains(x))).cast("double"),
        "attribution": (~F.col("attributed") | F.col("spoken")).cast("double"), "confidence": F.col("confidence"),
    }
    return sum((w * parts[k] for k, w in CLAIM_FIT.items()), F.lit(0.0))


def folded(c: Column) -> Column:
    """Lower case, white space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def attributed(claims: DataFrame, quotation: str, speaker: str = "speaker", quote: str = "quotation") -> DataFrame:
    """Claims with a speaker whose quotation holds the one asked for, case and white space aside."""
    return claims.where(F.col(speaker).isNotNull() & (F.col(quote) != "") & folded(F.col(quote)).contains(folded(F.lit(quotation))))


def binned(score: Column, edges: list[tuple[float, float]]) -> Column:
    """The value of the first bin whose upper edge reaches the score, else the last bin's; 0 without bins."""
    if not edges:
        return F.lit(0.0)
    bins = F.array(*(F.struct(F.lit(float(e)).alias("edge"), F.lit(float(v)).alias("value")) for e, v in edges))
    return F.coalesce(F.get(F.filter(bins, lambda b: score <= b["edge"]), 0)["value"], F.lit(float(edges[-1][1])))


def route_recall(hits: DataFrame, cases: DataFrame, key: str, rank: str = "rank", at: tuple[int, ...] = (1, 4, 8)) -> DataFrame:
    """One row: cases and the share of them whose first hit ranks within each k; hits has a row a hit."""
    first = hits.groupBy(key).agg(F.min(rank).alias("_first"))
    out = cases.select(key).join(first, key, "left")
    return out.agg(F.count("*").alias("cases"), *(F.coalesce(F.avg(F.coalesce((F.col("_first") <= k).cast("double"), F.lit(0.0))), F.lit(0.0)).alias(f"recall_{k}") for k in at))
