"""Ranked retrieval over documents and chunks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import retrieval as R
from ..operators.storage import cut
from ._base import query
from .corpus import CHUNKS

TERMS = "list_slice(list_sort(list_transform(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), lambda x: (-length(x), x))), 1, 7)"
ASKED = f"asked AS (SELECT item_id, struct_extract(unnest({TERMS}), 2) AS term FROM benchmark)"
SCORED = f"""{CHUNKS}, {ASKED},
w AS (SELECT chunk_id, len(regexp_extract_all(lower(chunk_text), '[a-z0-9]+')) AS len, regexp_extract_all(lower(chunk_text), '[a-z0-9]+') AS ws FROM c),
m AS (SELECT count(*)::DOUBLE AS n, avg(len) AS mean FROM w),
tf AS (SELECT chunk_id, len, term, count(*) AS tf FROM (SELECT chunk_id, len, unnest(ws) AS term FROM w) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT item_id, chunk_id, round(sum(ln(1 + (m.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / m.mean))), 6) AS score
  FROM tf JOIN df USING (term) JOIN asked USING (term), m GROUP BY ALL)"""


def longest_terms(c):
    """The seven longest distinct terms, ties by term."""
    by = F.array_sort(F.transform(F.array_distinct(T.simple_tokens(c)), lambda x: F.struct((-F.length(x)).alias("n"), x.alias("t"))))
    return F.transform(F.slice(by, 1, 7), lambda x: x["t"])


def questions(t):
    return t("benchmark").select("item_id", F.array_join(longest_terms(F.col("text")), " ").alias("q"))


def scored(t):
    return R.bm25(R.chunk_table(t("documents")), questions(t), "chunk_id", "chunk_text", "item_id", "q")


@query(f"WITH {SCORED} SELECT item_id, chunk_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) AS rank FROM s QUALIFY rank <= 8")
def bm25_search_topk(t):
    return R.top_k(scored(t), "item_id", [F.desc("score"), F.col("chunk_id")], 8).select("item_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"SELECT item_id, array_to_string(list_transform({TERMS}, lambda x: struct_extract(x, 2)), ' ') AS terms FROM benchmark")
def longest_term_selection(t):
    return t("benchmark").select("item_id", F.array_join(longest_terms(F.col("text")), " ").alias("terms"))


@query(f"""
WITH {SCORED}, p AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) AS r FROM s QUALIFY r <= 32)
SELECT item_id, chunk_id, r AS rank, round(CASE WHEN max(score) OVER g = min(score) OVER g THEN 1.0 ELSE (score - min(score) OVER g) / (max(score) OVER g - min(score) OVER g) END, 6) AS scaled, round(1.0 / r, 6) AS reciprocal
FROM p WINDOW g AS (PARTITION BY item_id)
""")
def score_normalisation(t):
    p = R.top_k(scored(t), "item_id", [F.desc("score"), F.col("chunk_id")], 32)
    return p.select("item_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round(R.min_max("score", "item_id"), 6).alias("scaled"), F.round(1 / F.col("rank"), 6).alias("reciprocal"))


WEIGHTS = {"overlap": 700, "exact": 250, "head": 120, "length": 90}


@query(f"""
WITH {SCORED}, p AS (SELECT item_id, chunk_id, score FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) <= 32),
q AS (SELECT item_id, list_transform({TERMS}, lambda x: struct_extract(x, 2)) AS terms FROM benchmark),
f AS (SELECT item_id, chunk_id, len(list_intersect(terms, ws)) AS overlap, (list_contains(ws, terms[1]))::BIGINT AS exact, (ordinal = 0)::BIGINT AS head, least(length(chunk_text) // 120, 4) AS length
  FROM p JOIN q USING (item_id) JOIN w USING (chunk_id) JOIN c USING (chunk_id)),
x AS (SELECT item_id, chunk_id, (700 * overlap + 250 * exact + 120 * head + 90 * length)::BIGINT AS fused FROM f)
SELECT item_id, chunk_id, fused, row_number() OVER (PARTITION BY item_id ORDER BY fused DESC, chunk_id) AS rank FROM x QUALIFY rank <= 8
""")
def integer_fusion_topk(t):
    chunks = R.chunk_table(t("documents"))
    pool = R.top_k(scored(t), "item_id", [F.desc("score"), F.col("chunk_id")], 32).select("item_id", "chunk_id")
    q = t("benchmark").select("item_id", longest_terms(F.col("text")).alias("terms"))
    full = pool.join(q, "item_id").join(chunks, "chunk_id").withColumn("ws", T.simple_tokens(F.col("chunk_text")))
    f = full.select(
        "item_id", "chunk_id", F.size(F.array_intersect("terms", "ws")).alias("overlap"), F.expr("array_contains(ws, terms[0])").cast("int").alias("exact"),
        (F.col("ordinal") == 0).cast("int").alias("head"), F.least(F.floor(F.length("chunk_text") / 120), F.lit(4)).alias("length"),
    )
    fused = R.integer_fusion(f, WEIGHTS).select("item_id", "chunk_id", "fused")
    return R.top_k(fused, "item_id", [F.desc("fused"), F.col("chunk_id")], 8).withColumn("rank", F.col("rank").cast("long"))


@query(f"""
WITH {SCORED}, p AS (SELECT item_id, chunk_id, score FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) <= 16),
q AS (SELECT item_id, list_slice(list_transform({TERMS}, lambda x: struct_extract(x, 2)), 1, 2) AS terms FROM benchmark),
k AS (SELECT item_id, chunk_id, len(terms) AS n, list_transform(terms, lambda x: coalesce(list_position(ws, x), 0)) AS ps FROM p JOIN q USING (item_id) JOIN w USING (chunk_id))
SELECT item_id, chunk_id, n > 0 AND list_min(ps) > 0 AND list_max(ps) - list_min(ps) <= n + 4 AS near FROM k
""")
def token_proximity(t):
    pool = R.top_k(scored(t), "item_id", [F.desc("score"), F.col("chunk_id")], 16).select("item_id", "chunk_id")
    q = t("benchmark").select("item_id", F.slice(longest_terms(F.col("text")), 1, 2).alias("terms"))
    full = pool.join(q, "item_id").join(R.chunk_table(t("documents")), "chunk_id")
    return full.select("item_id", "chunk_id", R.proximity(T.simple_tokens(F.col("chunk_text")), F.col("terms")).alias("near"))


@query(f"""
WITH {SCORED}, a AS (SELECT item_id, chunk_id, score, 0 AS pr FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) <= 4),
h AS (SELECT item_id, chunk_id, score, 1 AS pr FROM s JOIN c USING (chunk_id) WHERE ordinal = 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) <= 8),
u AS (SELECT item_id, chunk_id, min(pr) AS priority, max(score) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM h) GROUP BY ALL)
SELECT item_id, chunk_id, priority::INT AS priority, score, row_number() OVER (PARTITION BY item_id ORDER BY priority, score DESC, chunk_id) AS rank FROM u QUALIFY rank <= 8
""")
def priority_candidates(t):
    s = cut(scored(t))
    head = R.chunk_table(t("documents")).where("ordinal = 0").select("chunk_id")
    best = R.top_k(s, "item_id", [F.desc("score"), F.col("chunk_id")], 4)
    heads = R.top_k(s.join(head, "chunk_id", "left_semi"), "item_id", [F.desc("score"), F.col("chunk_id")], 8)
    return R.priority_fill([best, heads], "item_id", "chunk_id", 8).withColumn("rank", F.col("rank").cast("long"))


@query(f"""
WITH {SCORED}, d AS (SELECT item_id, doc_id, max(score) AS score FROM s JOIN c USING (chunk_id) GROUP BY ALL),
a AS (SELECT item_id, doc_id, score, 'body' AS ch FROM d QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 6),
b0 AS (SELECT item_id, doc_id, max(score) AS score FROM s JOIN c USING (chunk_id) WHERE ordinal = 0 GROUP BY ALL),
b AS (SELECT item_id, doc_id, score, 'lead' AS ch FROM b0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 6),
u AS (SELECT item_id, doc_id, max(score) AS score, string_agg(DISTINCT ch, ',' ORDER BY ch) AS channels FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 8 AS retained FROM u
""")
def union_by_canonical_id(t):
    s = cut(scored(t).join(R.chunk_table(t("documents")).select("chunk_id", "doc_id", "ordinal"), "chunk_id"))
    body = R.top_k(s.groupBy("item_id", "doc_id").agg(F.max("score").alias("score")), "item_id", [F.desc("score"), F.col("doc_id")], 6)
    lead = R.top_k(s.where("ordinal = 0").groupBy("item_id", "doc_id").agg(F.max("score").alias("score")), "item_id", [F.desc("score"), F.col("doc_id")], 6)
    return R.canonical_union({"body": body, "lead": lead}, "item_id", "doc_id", 8).withColumn("rank", F.col("rank").cast("long"))


@query("""
SELECT doc_id, lang, r AS turn FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256(doc_id::VARCHAR), doc_id) AS r FROM documents) ORDER BY r, lang LIMIT 100
""")
def round_robin_sample(t):
    d = t("documents").select("doc_id", "lang", F.sha2(F.col("doc_id").cast("string"), 256).alias("h"))
    return R.round_robin(d, "lang", [F.col("h"), F.col("doc_id")], 100).select("doc_id", "lang", F.col("turn").cast("long").alias("turn"))


@query(f"""
WITH {SCORED}, p AS (SELECT item_id, chunk_id, score, length(chunk_text) AS cost FROM s JOIN c USING (chunk_id) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) <= 16),
r AS (SELECT *, sum(cost) OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id)::BIGINT AS running, sum(cost) OVER (PARTITION BY item_id) > 3000 AS saturated FROM p)
SELECT item_id, chunk_id, running, saturated FROM r WHERE running <= 3000
""")
def budgeted_consumption(t):
    top = R.top_k(scored(t), "item_id", [F.desc("score"), F.col("chunk_id")], 16).join(R.chunk_table(t("documents")).select("chunk_id", F.length("chunk_text").alias("cost")), "chunk_id")
    return R.capped_prefix(top, "item_id", [F.desc("score"), F.col("chunk_id")], "cost", 3000).select("item_id", "chunk_id", "running", "saturated")


@query(f"""
WITH {SCORED}, g AS (SELECT chunk_id, item_id, count(DISTINCT term) AS n FROM tf JOIN asked USING (term) GROUP BY ALL), q AS (SELECT item_id, count(*) AS need FROM asked GROUP BY 1)
SELECT item_id, chunk_id FROM g JOIN q USING (item_id) WHERE n = need
""")
def all_terms_match(t):
    asked = questions(t).select("item_id", F.explode(F.split("q", " ")).alias("term"))
    need = asked.groupBy("item_id").agg(F.count("*").alias("need"))
    tf = R.term_counts(R.chunk_table(t("documents")), "chunk_id", "chunk_text")
    return tf.join(asked, "term").groupBy("item_id", "chunk_id").agg(F.count("*").alias("n")).join(need, "item_id").where("n = need").select("item_id", "chunk_id")


@query(f"""
WITH {SCORED}, p AS (SELECT item_id, doc_id, chunk_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) AS r FROM s JOIN c USING (chunk_id) QUALIFY r <= 8)
SELECT p.item_id, chunk_id, r AS rank, score, (SELECT count(DISTINCT x.doc_id) FROM p x WHERE x.item_id = p.item_id AND x.r < p.r) AS families_before FROM p
""")
def ranked_trace(t):
    """Rank, score and the number of different documents seen before."""
    p = R.top_k(scored(t).join(R.chunk_table(t("documents")).select("chunk_id", "doc_id"), "chunk_id"), "item_id", [F.desc("score"), F.col("chunk_id")], 8)
    w = Window.partitionBy("item_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    return p.select("item_id", "chunk_id", F.col("rank").cast("long").alias("rank"), "score", F.size(F.collect_set("doc_id").over(w)).cast("long").alias("families_before"))
