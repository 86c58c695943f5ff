"""Links, redirects, paths, intervals and as-of joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph as G
from ._base import query

LINKS = """l AS (SELECT page_id, i - 1 AS position, h[i] AS target, b[i] AS label FROM (
  SELECT page_id, h, b, unnest(range(1, len(h) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"[^>]*>([^<]*)</a>', 1) AS h, regexp_extract_all(html, '<a href="([^"]*)"[^>]*>([^<]*)</a>', 2) AS b FROM pages)))"""


@query(f"WITH {LINKS} SELECT * FROM l")
def link_edges(t):
    return G.html_links(t("pages"))


@query(f"WITH {LINKS} SELECT target, count(*) AS n_links, count(DISTINCT page_id) AS n_pages FROM l GROUP BY target ORDER BY n_links DESC, target LIMIT 20")
def link_inlink_topk(t):
    return G.html_links(t("pages")).groupBy("target").agg(F.count("*").alias("n_links"), F.countDistinct("page_id").alias("n_pages")).orderBy(F.desc("n_links"), "target").limit(20)


@query(f"WITH {LINKS}, r AS (SELECT target, count(DISTINCT page_id) AS n FROM l GROUP BY 1 HAVING count(DISTINCT page_id) BETWEEN 2 AND 8), e AS (SELECT DISTINCT page_id, target FROM l JOIN r USING (target)) SELECT a.page_id AS page_a, b.page_id AS page_b, count(*) AS shared FROM e a JOIN e b ON a.target = b.target AND a.page_id < b.page_id GROUP BY ALL")
def link_two_hop(t):
    """Pages two hops apart through a target that 2 to 8 pages name (a hybrid cell's size limits)."""
    e = G.html_links(t("pages")).select("page_id", "target").distinct()
    mid = e.groupBy("target").agg(F.count("*").alias("n")).where(F.col("n").between(2, 8)).select("target")
    e = e.join(mid, "target")
    a, b = e.select("target", F.col("page_id").alias("page_a")), e.select("target", F.col("page_id").alias("page_b"))
    return a.join(b, "target").where("page_a < page_b").groupBy("page_a", "page_b").agg(F.count("*").alias("shared"))


def nation_redirects(t):
    """Redirects among nations: a fixture with chains, cycles, ambiguous and missing ends, by key."""
    n = t("nation").select("n_nationkey", "n_name", "n_regionkey")
    k = F.col("n_nationkey")
    hop = n.select(F.concat(F.lit("r"), k).alias("surface"), F.when(k % 5 == 0, F.col("n_name")).when(k % 5 == 4, F.concat(F.lit("x"), k)).when(k == 8, F.lit("r7")).otherwise(F.concat(F.lit("r"), k - 1)).alias("target"))
    more = n.where("n_nationkey % 10 = 1").select(F.concat(F.lit("r"), k).alias("surface"), F.lit("r12").alias("target"))
    return hop.union(more), n.select(F.col("n_name").alias("title"))


@query("""
WITH RECURSIVE h AS (
  SELECT 'r' || n_nationkey AS surface, CASE WHEN n_nationkey % 5 = 0 THEN n_name WHEN n_nationkey % 5 = 4 THEN 'x' || n_nationkey WHEN n_nationkey = 8 THEN 'r7' ELSE 'r' || (n_nationkey - 1) END AS target FROM nation
  UNION ALL SELECT 'r' || n_nationkey, 'r12' FROM nation WHERE n_nationkey % 10 = 1),
g AS (SELECT surface, count(DISTINCT target) AS n, min(target) AS target FROM h GROUP BY 1),
w AS (SELECT surface, target, 1::BIGINT AS hops FROM g WHERE n = 1
  UNION ALL SELECT w.surface, g.target, hops + 1 FROM w JOIN g ON w.target = g.surface AND g.n = 1 WHERE hops < 40),
last AS (SELECT surface, max_by(target, hops) AS target, max(hops) AS hops FROM w GROUP BY 1)
SELECT surface, CASE WHEN hops >= 40 THEN NULL WHEN target IN (SELECT surface FROM g WHERE n > 1) THEN NULL WHEN target IN (SELECT n_name FROM nation) THEN target END AS target,
  CASE WHEN hops >= 40 THEN 'redirect_cycle' WHEN target IN (SELECT surface FROM g WHERE n > 1) THEN 'ambiguous' WHEN target IN (SELECT n_name FROM nation) THEN 'canonical' ELSE 'missing' END AS state,
  CASE WHEN hops >= 40 THEN 0 ELSE hops END AS hops FROM last
UNION ALL SELECT surface, NULL, 'ambiguous', 0 FROM g WHERE n > 1
""")
def redirect_resolution(t):
    return G.resolve_redirects(*nation_redirects(t))


@query("""
WITH p AS (SELECT doc_id, 480 * i AS cs, least(480 * (i + 1), length(text)) AS ce FROM (SELECT doc_id, text, unnest(range(0, ceil(length(text) / 480.0)::BIGINT)) AS i FROM documents)),
s AS (SELECT doc_id, instr(text, chr(10)) AS pos FROM documents WHERE instr(text, chr(10)) > 0)
SELECT doc_id, cs AS chunk_start, pos - 1 AS mark_start FROM p JOIN s USING (doc_id) WHERE cs <= pos - 1 AND ce >= pos
""")
def interval_containment(t):
    """The chunk that holds each document's first line break: equi-join on the document and its chunk number, no range scan."""
    d = t("documents").where("instr(text, '\n') > 0").select("doc_id", (F.instr("text", "\n") - 1).alias("at"), F.length("text").alias("n"))
    c = t("documents").select("doc_id", F.explode(F.when(F.length("text") > 0, F.sequence(F.lit(0), F.length("text") - 1, F.lit(480))).otherwise(F.array().cast("array<int>"))).alias("chunk_start"))
    return d.withColumn("chunk_start", (F.floor(F.col("at") / 480) * 480).cast("int")).join(c, ["doc_id", "chunk_start"]).select("doc_id", F.col("chunk_start").cast("long").alias("chunk_start"), F.col("at").cast("long").alias("mark_start"))


@query("""
SELECT e.event_id, coalesce((SELECT max(x.event_id) FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'purchase' AND (x.ts < e.ts OR (x.ts = e.ts AND x.event_id < e.event_id))), -1) AS last_purchase FROM events e
""")
def asof_last_purchase(t):
    """The user's latest earlier purchase: one pass over a window, no range join. Ids follow time in this table."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return t("events").select("event_id", F.coalesce(F.max(F.when(F.col("event_type") == "purchase", F.col("event_id"))).over(w), F.lit(-1)).alias("last_purchase"))


@query("""
WITH h AS (SELECT conv_id, turn, role, text FROM conversations)
SELECT conv_id, turn, coalesce((SELECT max(x.turn) FROM h x WHERE x.conv_id = h.conv_id AND x.role = 'user' AND x.turn <= h.turn), -1) AS heading_turn FROM h
""")
def asof_heading(t):
    """The last heading (user turn) at or before each row."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return t("conversations").select("conv_id", "turn", F.coalesce(F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w), F.lit(-1)).alias("heading_turn"))


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT s_nationkey AS a, (s_nationkey * 7) % 25 AS b FROM supplier),
b AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT n_nationkey AS node, n_nationkey AS seen FROM nation UNION SELECT r.node, b.b FROM r JOIN b ON r.seen = b.a)
SELECT node, min(seen) AS component FROM r GROUP BY node
""")
def connected_components(t):
    e = t("supplier").select(F.col("s_nationkey").alias("a"), ((F.col("s_nationkey") * 7) % 25).alias("b")).distinct()
    return G.components(e, t("nation").select(F.col("n_nationkey").alias("node")))


@query(f"""
WITH {LINKS}, s AS (SELECT DISTINCT page_id, target FROM l), seed AS (SELECT DISTINCT target FROM s WHERE page_id = 0),
p1 AS (SELECT DISTINCT page_id FROM s JOIN seed USING (target)), n1 AS (SELECT target, count(*) AS n FROM s JOIN p1 USING (page_id) WHERE target NOT IN (SELECT target FROM seed) GROUP BY 1 ORDER BY n DESC, target LIMIT 25)
SELECT target AS node, 0::BIGINT AS depth FROM seed UNION ALL SELECT target, 1 FROM n1
""")
def frontier_traversal(t):
    """Targets reached from page 0's own within one hop over pages, best 25."""
    s = G.html_links(t("pages")).select("page_id", "target").distinct()
    seeds = s.where("page_id = 0").select(F.col("target").alias("node"))
    pages = s.join(seeds, s["target"] == seeds["node"], "left_semi").select("page_id").distinct()
    edges = s.join(pages, "page_id").select("page_id", F.col("target").alias("node"))
    best = edges.join(seeds, "node", "left_anti").groupBy("node").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "node").limit(25)
    return seeds.select("node", F.lit(0).cast("long").alias("depth")).unionByName(best.select("node", F.lit(1).cast("long").alias("depth")))


@query(f"""
WITH {LINKS}, pg AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages), a AS (SELECT lower(label) AS k, min(page_id) AS label_page FROM l GROUP BY 1)
SELECT page_id, position, label_page, label_page IS NULL OR label_page = page_id AS own FROM l LEFT JOIN a ON lower(label) = a.k
""")
def link_target_resolution(t):
    """Each link's label resolved to the smallest page that uses it."""
    links = G.html_links(t("pages"))
    a = links.groupBy(F.lower("label").alias("k")).agg(F.min("page_id").alias("label_page"))
    return links.join(a, F.lower("label") == F.col("k"), "left").select("page_id", "position", "label_page", (F.col("label_page").isNull() | (F.col("label_page") == F.col("page_id"))).alias("own"))


@query(f"""
WITH {LINKS} SELECT lower(label) AS surface, count(DISTINCT target) AS n_targets, min(target) AS first_target FROM l GROUP BY 1 HAVING count(DISTINCT target) >= 2
""")
def ambiguous_surfaces(t):
    links = G.html_links(t("pages"))
    return links.groupBy(F.lower("label").alias("surface")).agg(F.countDistinct("target").alias("n_targets"), F.min("target").alias("first_target")).where("n_targets >= 2")


@query("""
SELECT page_id, heading, p.i AS paragraph, length(p.body) AS chars FROM (SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS heading, regexp_extract_all(html, '<p>([^<]*)', 1) AS ps FROM pages) x,
LATERAL (SELECT unnest(range(1, len(ps) + 1)) AS i, unnest(ps) AS body) p
""")
def section_paragraphs(t):
    p = t("pages").select("page_id", F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("heading"), F.posexplode(F.regexp_extract_all("html", F.lit("<p>([^<]*)"), 1)).alias("i", "body"))
    return p.select("page_id", "heading", (F.col("i") + 1).cast("long").alias("paragraph"), F.length("body").cast("long").alias("chars"))


@query("""
WITH RECURSIVE d AS (SELECT r_regionkey AS node, 0::BIGINT AS depth FROM region UNION ALL SELECT d.node + 5, depth + 1 FROM d WHERE d.node + 5 < 25) SELECT node, max(depth) AS depth FROM d GROUP BY node
""")
def topological_depths(t):
    nodes = t("nation").select(F.col("n_nationkey").alias("node"))
    return G.topological_depth(nodes.where("node >= 5").select((F.col("node") - 5).alias("parent"), F.col("node").alias("child")), nodes)
