"""Bounded choices: experts under a budget, claims under limits, beams over a state graph."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut


def route_groups(proposals: list[dict], macs: float, reads: float, cycles: int, parallel: int) -> list[list[str]]:
    """Groups of experts to run one after the other: in each, those whose dependencies are done, by gain, as far as the budgets go.

    One that no longer fits is skipped, not a reason to stop; an empty group ends the route.
    """
    pending = {p["expert"]: p for p in proposals}
    done: set[str] = set()
    groups: list[list[str]] = []
    while pending and len(groups) < cycles:
        ready = sorted((p for p in pending.values() if done.issuperset(p["dependencies"] or ())), key=lambda p: (-p["gain"], p["macs"], p["reads"], p["expert"]))
        group = []
        for p in ready:
            if len(group) < parallel and p["macs"] <= macs and p["reads"] <= reads:
                group.append(p["expert"])
                macs, reads = macs - p["macs"], reads - p["reads"]
        if not group:
            break
        groups.append(group)
        done.update(group)
        for expert in group:
            del pending[expert]
    return groups


def budget_routes(proposals: DataFrame, macs: float, reads: float, cycles: int, parallel: int, least_gain: float) -> DataFrame:
    """(workspace, route, experts, reason): groups joined by ">", experts of a group by "+".

    proposals: workspace, expert, gain, macs, reads, dependencies (array). A workspace's
    proposals meet in one row: there is one an expert, and experts are few.
    """
    if cycles < 1:
        return proposals.select("workspace", F.lit("").alias("route"), F.lit(0).cast("long").alias("experts"), F.lit("cycle_bound_reached").alias("reason")).distinct()
    one = F.when(F.col("gain") >= least_gain, F.struct(F.col("expert").cast("string").alias("expert"), F.col("gain").cast("double").alias("gain"), F.col("macs").cast("double").alias("macs"), F.col("reads").cast("double").alias("reads"), F.col("dependencies").cast("array<string>").alias("dependencies")))
    grouped = proposals.groupBy("workspace").agg(F.collect_list(one).alias("offers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [route_groups(offers, macs, reads, cycles, parallel) for offers in batch.column("offers").to_pylist()]
            reasons = ["route_selected" if g else "compute_budget_exhausted" if n else "expected_gain_below_gate" for g, n in zip(found, batch.column("offers").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("workspace"), pa.array([">".join("+".join(g) for g in route) for route in found], pa.string()), pa.array([sum(map(len, route)) for route in found], pa.int64()), pa.array(reasons, pa.string())],
                ["workspace", "route", "experts", "reason"],
            )

    kind = proposals.schema["workspace"].dataType.simpleString()
    return grouped.mapInArrow(run, f"workspace {kind}, route string, experts long, reason string")


def bounded_fill(rows: DataFrame, group: str, item: str, order: list[Column], spans: str, entities: str, max_items: int = 32, max_spans: int = 48, max_entities: int = 24) -> DataFrame:
    """(group, items, spans, entities): items in order, each taken if its new spans and entities still fit; one that doesn't is skipped.

    Only the first max_items of a group are looked at, so a group's fold is bounded; it runs in the JVM.
    """
    w = Window.partitionBy(group).orderBy(*order)
    best = rows.select(group, F.col(item).alias("item"), F.array_distinct(spans).alias("s"), F.array_distinct(entities).alias("e"), F.row_number().over(w).alias("r")).where(F.col("r") <= max_items)
    listed = best.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("r", "item", "s", "e"))).alias("x"))
    types = {f.name: f.dataType for f in best.schema.fields}
    empty = lambda element: F.array().cast(f"array<{element}>")
    start = F.struct(empty(types["item"].simpleString()).alias("items"), empty(types["s"].elementType.simpleString()).alias("spans"), empty(types["e"].elementType.simpleString()).alias("entities"))

    def step(held: Column, x: Column) -> Column:
        s, e = F.array_union(held["spans"], x["s"]), F.array_union(held["entities"], x["e"])
        taken = F.struct(F.concat(held["items"], F.array(x["item"])).alias("items"), s.alias("spans"), e.alias("entities"))
        return F.when((F.size(s) <= max_spans) & (F.size(e) <= max_entities), taken).otherwise(held)

    return listed.select(group, F.aggregate("x", start, step).alias("f")).select(group, "f.*")


def beam(starts: DataFrame, edges: DataFrame, depth: int, width: int) -> DataFrame:
    """(case, depth, state, score, place): the states expanded or reached at every depth, `width` at most for a case.

    starts: case, state; edges: state, next, gain. Candidates of a case are ordered by score,
    then by where they came from; the first `width` stay, and of these a state that stands
    twice or was reached before is skipped. Every depth is stored before the next.
    """
    frontier = cut(starts.select("case", "state", F.lit(0.0).alias("score"), F.lit(1).alias("place")))
    seen, out = frontier.select("case", "state"), frontier.withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        step = frontier.withColumnsRenamed({"place": "_from", "score": "_so_far"}).join(edges, "state").select("case", F.col("next").alias("state"), F.round(F.col("_so_far") + F.col("gain"), 9).alias("score"), "_from")
        w = Window.partitionBy("case").orderBy(F.desc("score"), "_from", "state")
        kept = step.withColumn("place", F.row_number().over(w)).where(F.col("place") <= width)
        first = kept.withColumn("_copy", F.row_number().over(Window.partitionBy("case", "state").orderBy("place"))).where("_copy = 1")
        frontier = cut(first.join(seen, ["case", "state"], "left_anti").select("case", "state", "score", "place"))
        seen, out = seen.unionByName(frontier.select("case", "state")), out.unionByName(frontier.withColumn("depth", F.lit(d)))
    return out.select("case", "depth", "state", "score", "place")
