"""Queries of bounded choices and of cells told by hypervectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import addressing as A
from ..operators import hypervectors as H
from ..operators import routing as R
from ..operators.retrieval import top_k
from ..operators.storage import cut
from ._base import query
from .addressing import FRAMES, addressed_claims, frames


@query()
def budget_routes(t):
    """Lines of an order as proposals: the discount as gain, quantity and line as costs, every third line after the one before."""
    line = F.col("l_linenumber")
    p = t("lineitem").select(
        F.col("l_orderkey").alias("workspace"), line.cast("string").alias("expert"), (F.col("l_discount").cast("double") * 10).alias("gain"), F.col("l_quantity").cast("double").alias("macs"), line.cast("double").alias("reads"),
        F.when(line % 3 == 0, F.array((line - 1).cast("string"))).otherwise(F.array().cast("array<string>")).alias("dependencies"),
    )
    return R.budget_routes(p, macs=90, reads=12, cycles=3, parallel=2, least_gain=0.1)


@query(f"""
WITH RECURSIVE {FRAMES}, top AS (SELECT frame_id, claim_id, subject, row_number() OVER (PARTITION BY frame_id ORDER BY confidence DESC, claim_id) AS r FROM met QUALIFY r <= 32),
w AS (SELECT frame_id, 0::BIGINT AS r, []::BIGINT[] AS items, []::BIGINT[] AS spans, []::BIGINT[] AS entities FROM (SELECT DISTINCT frame_id FROM top)
UNION ALL SELECT w.frame_id, top.r, CASE WHEN ok THEN list_append(items, claim_id) ELSE items END, CASE WHEN ok THEN s ELSE spans END, CASE WHEN ok THEN e ELSE entities END
  FROM w JOIN top ON w.frame_id = top.frame_id AND top.r = w.r + 1, LATERAL (SELECT list_distinct(list_concat(w.spans, [claim_id % 11, claim_id % 7])) AS s, list_distinct(list_concat(w.entities, [subject, 1000 + claim_id % 9])) AS e), LATERAL (SELECT len(s) <= 8 AND len(e) <= 7 AS ok))
SELECT frame_id, array_to_string(items, ',') AS items, len(spans)::BIGINT AS n_spans, len(entities)::BIGINT AS n_entities FROM w QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY r DESC) = 1
""")
def bounded_fill(t):
    """Claims of a frame in order of confidence under limits of spans and entities; both are made from claim ids."""
    c = A.claim_lookup(frames(t), addressed_claims(t), 1_000_000_000).select("frame_id", "claim_id", "confidence", F.array(F.col("claim_id") % 11, F.col("claim_id") % 7).alias("spans"), F.array(F.col("subject"), 1000 + F.col("claim_id") % 9).alias("entities"))
    out = R.bounded_fill(c, "frame_id", "claim_id", [F.desc("confidence"), F.col("claim_id")], "spans", "entities", max_spans=8, max_entities=7)
    return out.select("frame_id", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"), F.size("spans").cast("long").alias("n_spans"), F.size("entities").cast("long").alias("n_entities"))


DEPTH, WIDTH = 3, 4


def beam_sql() -> str:
    parts = ["""st AS (SELECT event_type || '/' || (event_id % 5) AS state, user_id, ts, event_id FROM events), nx AS (SELECT state, lead(state) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM st),
en AS (SELECT state, next, count(*) AS n FROM nx WHERE next IS NOT NULL GROUP BY state, next), e AS (SELECT state, next, round(n / sum(n) OVER (PARTITION BY state), 6) AS gain FROM en),
f0 AS (SELECT DISTINCT event_type || '/0' AS "case", event_type || '/0' AS state, 0.0::DOUBLE AS score, 1::BIGINT AS place FROM events), seen0 AS (SELECT "case", state FROM f0)"""]
    for d in range(1, DEPTH + 1):
        parts.append(f"""k{d} AS (SELECT f."case", e.next AS state, round(f.score + e.gain, 9) AS score, row_number() OVER (PARTITION BY f."case" ORDER BY round(f.score + e.gain, 9) DESC, f.place, e.next) AS rk FROM f{d - 1} f JOIN e USING (state) QUALIFY rk <= {WIDTH}),
f{d} AS (SELECT "case", state, min_by(score, rk) AS score, min(rk) AS place FROM k{d} ANTI JOIN seen{d - 1} USING ("case", state) GROUP BY 1, 2), seen{d} AS (SELECT * FROM seen{d - 1} UNION ALL SELECT "case", state FROM f{d})""")
    whole = " UNION ALL ".join(f'SELECT "case", {d}::BIGINT AS depth, state, round(score, 6) AS score, place FROM f{d}' for d in range(DEPTH + 1))
    return f"WITH {', '.join(parts)} {whole}"


@query(beam_sql())
def beam_paths(t):
    """Likeliest walks over what users do next, a case for every type of event."""
    state = F.concat("event_type", F.lit("/"), (F.col("event_id") % 5).cast("string"))
    e = t("events").select("user_id", "ts", "event_id", state.alias("state"))
    n = e.withColumn("next", F.lead("state").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).where("next IS NOT NULL").groupBy("state", "next").agg(F.count("*").alias("n"))
    edges = cut(n.withColumn("gain", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("state")), 6)).drop("n"))
    starts = t("events").select(F.concat("event_type", F.lit("/0")).alias("case")).distinct().withColumn("state", F.col("case"))
    out = R.beam(starts, edges, DEPTH, WIDTH)
    return out.select("case", F.col("depth").cast("long").alias("depth"), "state", F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


@query()
def term_hypervectors(t):
    """Every question's bundle of words, in hexadecimal."""
    return t("benchmark").select("item_id", F.hex(H.encode_terms(T.simple_tokens(F.col("text")))).alias("code"))


@query()
def cell_routes(t):
    """Sources and languages as cells: a question's four best by shared words and similarity of vectors.

    A cell's words are its 64 most frequent ones, so what every question meets is bounded by the number of cells.
    """
    words = t("documents").select(F.concat_ws("/", "source", "lang").alias("cell"), F.explode(T.simple_tokens(F.col("text"))).alias("term")).groupBy("cell", "term").agg(F.count("*").alias("n"))
    best = top_k(words, "cell", [F.desc("n"), F.col("term")], 64)
    cells = best.groupBy("cell").agg(F.array_sort(F.collect_list("term")).alias("terms")).withColumn("signature", H.encode_terms(F.col("terms")))
    cells = cut(cells)
    q = t("benchmark").select("item_id", F.array_distinct(T.simple_tokens(F.col("text"))).alias("w")).withColumn("code", H.encode_terms(F.col("w")))
    asked = cut(q).select("item_id", "w", "code", F.explode("w").alias("term"))
    met = asked.join(cells.select("cell", F.explode("terms").alias("term")), "term").groupBy("item_id", "cell").agg(F.count("*").alias("both"), F.first("code").alias("code"), F.first(F.size("w")).alias("n"))
    scored = met.join(cells.select("cell", "signature"), "cell").withColumn("vector", H.similarity(F.col("code"), F.col("signature")))
    score = H.cell_score(F.lit(0.0), F.col("both") / F.col("n"), F.col("vector"), F.lit(False))
    out = scored.select("item_id", "cell", F.round(score, 6).alias("score"))
    return top_k(out, "item_id", [F.desc("score"), F.col("cell")], 4).withColumn("rank", F.col("rank").cast("long"))
