"""Links, redirects, paths and components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evaluation import dealt_by_range
from .storage import cut


def html_links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page, position, target, label) of every link, in order."""
    both = F.arrays_zip(
        F.regexp_extract_all(html_col, F.lit(r'<a href="([^"]*)"[^>]*>([^<]*)</a>'), 1).alias("target"), F.regexp_extract_all(html_col, F.lit(r'<a href="([^"]*)"[^>]*>([^<]*)</a>'), 2).alias("label")
    )
    x = pages.select(F.col(id_col), F.posexplode(both).alias("position", "x"))
    return x.select(id_col, F.col("position").cast("long").alias("position"), F.col("x.target").alias("target"), F.col("x.label").alias("label"))


def resolve_redirects(redirects: DataFrame, canonical: DataFrame, most_doublings: int = 40) -> DataFrame:
    """(surface, target, state, hops) of redirects (surface, target): canonical, missing, ambiguous or redirect_cycle.

    Targets are followed for all surfaces at once; a surface that several targets name is
    ambiguous and is not followed. Chains double their reach with every round, so a chain of
    n hops takes about log2(n) joins; whatever still moves after that is a cycle.
    """
    named = redirects.groupBy("surface").agg(F.countDistinct("target").alias("n"), F.min("target").alias("target"))
    hop = named.where("n = 1").select("surface", "target", F.lit(1).cast("long").alias("hops"))
    surfaces = named.count()
    for _ in range(most_doublings):
        nxt = hop.select(F.col("surface").alias("target"), F.col("target").alias("far"), F.col("hops").alias("more"))
        hop = cut(hop.join(nxt, "target", "left").select("surface", F.coalesce("far", "target").alias("target"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.col("far").isNotNull().alias("moved")))
        # a chain stops moving; on a cycle, hops come to exceed the number of surfaces
        open_ = hop.where("moved").agg(F.count("*"), F.min("hops")).first()
        hop = hop.drop("moved")
        if not open_[0] or open_[1] > surfaces:
            break
    inner = named.where("n = 1").select(F.col("surface").alias("target"), F.lit(True).alias("moves"))
    split = named.where("n > 1").select(F.col("surface").alias("target"), F.lit(True).alias("splits"))
    known = canonical.select(F.col("title").alias("target"), F.lit(True).alias("known")).distinct()
    out = hop.join(inner, "target", "left").join(split, "target", "left").join(known, "target", "left")
    state = F.when(F.col("moves"), "redirect_cycle").when(F.col("splits"), "ambiguous").when(F.col("known"), "canonical").otherwise("missing")
    own = named.where("n > 1").select("surface", F.lit(None).cast("string").alias("target"), F.lit("ambiguous").alias("state"), F.lit(0).cast("long").alias("hops"))
    return out.select("surface", F.when(state == "canonical", F.col("target")).alias("target"), state.alias("state"), F.when(state == "redirect_cycle", 0).otherwise(F.col("hops")).cast("long").alias("hops")).unionByName(own)


def fold_redirects(redirects: DataFrame, depth: int = 4) -> DataFrame:
    """(surface, target) after at most `depth` hops, where every surface has one target."""
    out = redirects.select("surface", "target")
    step = redirects.select(F.col("surface").alias("target"), F.col("target").alias("far"))
    for _ in range(depth - 1):
        out = out.join(step, "target", "left").select("surface", F.coalesce("far", "target").alias("target"))
    return out


def expand(frontier: DataFrame, links: DataFrame, visited: DataFrame, rank: Column | None = None, limit: int | None = None) -> DataFrame:
    """Nodes one hop from the frontier (node) over links (source, target) that were not visited, with the number of links."""
    out = links.join(frontier.select(F.col("node").alias("source")), "source", "left_semi").groupBy(F.col("target").alias("node")).agg(F.count("*").alias("n"))
    out = out.join(visited.select("node"), "node", "left_anti")
    return out if limit is None else out.orderBy(F.desc("n") if rank is None else rank, "node").limit(limit)


def traverse(seeds: DataFrame, links: DataFrame, hops: int, limit: int | None = None) -> DataFrame:
    """(node, depth) within `hops` of the seeds (node), breadth first. hops bounds the plan."""
    seen = seeds.select("node", F.lit(0).cast("long").alias("depth"))
    edge = seeds.select("node")
    for d in range(1, hops + 1):
        edge = expand(edge, links, seen, limit=limit).select("node")
        seen = seen.unionByName(edge.withColumn("depth", F.lit(d).cast("long")))
    return seen


def components(edges: DataFrame, nodes: DataFrame, node: str = "node", rounds: int = 64) -> DataFrame:
    """(node, component): the smallest node reachable over edges (a, b). Min-label rounds with pointer jumping.

    Labels are checkpointed every round to the shared folder that spark.checkpoint.dir names.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct()
    labels = nodes.select(F.col(node).alias("node"), F.col(node).alias("label"))
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("low"))
        new = labels.join(near, F.col("node") == F.col("a"), "left").select("node", F.least("label", F.coalesce("low", "label")).alias("new"), "label")
        jump = new.select(F.col("node").alias("at"), F.col("new").alias("far"))
        new = cut(new.join(jump, F.col("new") == F.col("at"), "left").select("node", F.least("new", F.coalesce("far", "new")).alias("new"), "label"))
        labels = new.select("node", F.col("new").alias("label"))
        if not new.where("new <> label").limit(1).count():
            break
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    return labels.withColumnRenamed("label", "component")


def topological_depth(edges: DataFrame, nodes: DataFrame, most_depth: int = 64) -> DataFrame:
    """(node, depth) with parents before children over edges (parent, child); a cycle is an error."""
    out, depth = nodes.select("node", F.lit(0).cast("long").alias("depth")), 0
    edge = nodes.select("node")
    while depth <= most_depth:
        edge = cut(edges.join(edge.withColumnRenamed("node", "parent"), "parent", "left_semi").select(F.col("child").alias("node")).distinct())
        if not edge.limit(1).count():
            return out.groupBy("node").agg(F.max("depth").alias("depth"))
        depth += 1
        out = out.unionByName(edge.withColumn("depth", F.lit(depth).cast("long")))
    raise ValueError("the graph has a cycle, or is deeper than most_depth")


def shard_components(labelled: DataFrame, shards: int) -> DataFrame:
    """Shard of every (node, component), components dealt round robin by their smallest node, none split.

    A component's place is its rank in a range-partitioned sort, so no single task ranks them all.
    """
    parts = dealt_by_range(labelled.select("component").distinct(), [F.col("component")]).withColumnRenamed("_part", "part")
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select(F.col("part").alias("p"), F.col("n").alias("m")).join(sizes.select("part"), F.col("p") < F.col("part"), "right").groupBy("part").agg(F.coalesce(F.sum("m"), F.lit(0)).alias("before"))
    placed = parts.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy("component"))).join(before, "part").select("component", ((F.col("before") + F.col("r") - 1) % shards).alias("shard"))
    return labelled.join(placed, "component")
