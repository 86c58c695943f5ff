"""Queries over addresses: mentions, channels, claims of a frame, fits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import addressing as A
from ..operators import retrieval as R
from ..operators.storage import cut
from ._base import query
from .answering import claims
from .corpus import CHUNKS
from .evaluation import CASES, cases
from .framing import _sql
from .linking import OCC, occurrences
from .retrieval import SCORED, scored, questions

MENTIONS = f"""{OCC}, r AS (SELECT surface AS mention, CASE WHEN entity LIKE 'E0-%' THEN NULL ELSE entity END AS entity, count(*) AS occurrences, count(DISTINCT page_id) AS documents FROM o GROUP BY surface, entity, split),
kept AS (SELECT surface AS mention, entity, round(n / sum(n) OVER (PARTITION BY surface), 6) AS confidence, row_number() OVER (PARTITION BY surface ORDER BY n DESC, entity) AS retained_rank FROM (SELECT surface, entity, count(*) AS n FROM o WHERE split = 'fit' GROUP BY ALL)),
p AS (SELECT *, sum(occurrences) OVER (PARTITION BY mention)::BIGINT AS total, occurrences / sum(occurrences) OVER (PARTITION BY mention) AS p FROM r),
h AS (SELECT mention, entity, sum(p) AS probability, sum(occurrences)::BIGINT AS occurrences, max(documents) AS documents, max(documents / occurrences) AS diversity FROM p WHERE entity IS NOT NULL GROUP BY ALL)"""


def mention_rows(t):
    """(rows, retained): link targets of every surface by split, E0 entities unresolved; what a linker fitted on one split keeps."""
    o = occurrences(t)
    n = o.groupBy("surface", "entity", "split").agg(F.count("*").alias("occurrences"), F.countDistinct("page_id").alias("documents"))
    rows = n.select(F.col("surface").alias("mention"), F.when(~F.col("entity").startswith("E0-"), F.col("entity")).alias("entity"), "occurrences", "documents")
    w = Window.partitionBy("mention")
    fit = n.where("split = 'fit'").select(F.col("surface").alias("mention"), "entity", "occurrences")
    kept = fit.select("mention", "entity", F.round(F.col("occurrences") / F.sum("occurrences").over(w), 6).alias("confidence"), F.row_number().over(w.orderBy(F.desc("occurrences"), "entity")).cast("long").alias("position"))
    return rows, kept


@query(f"""
WITH {MENTIONS} SELECT mention, entity, round(probability, 6) AS probability, occurrences, documents, round(diversity, 6) AS diversity, row_number() OVER (PARTITION BY mention ORDER BY round(probability, 9) DESC, entity) AS rank, retained_rank, confidence
FROM h LEFT JOIN kept USING (mention, entity)
""")
def mention_distribution(t):
    h, _ = A.distributions(*mention_rows(t))
    return h.select("mention", "entity", F.round("probability", 6).alias("probability"), "occurrences", "documents", F.round("diversity", 6).alias("diversity"), F.col("rank").cast("long").alias("rank"), "retained_rank", "confidence")


@query(f"""
WITH {MENTIONS}, lost AS (SELECT mention, count(*) AS unsupported FROM kept ANTI JOIN h USING (mention, entity) GROUP BY mention)
SELECT mention, any_value(total) AS total, round(coalesce(sum(p) FILTER (entity IS NULL), 0), 6) AS unresolved, round(sum(p), 6) AS mass, round(-sum(p * ln(p)), 6) + 0.0 AS entropy, coalesce(any_value(unsupported), 0) AS unsupported FROM p LEFT JOIN lost USING (mention) GROUP BY mention
""")
def mention_masses(t):
    _, m = A.distributions(*mention_rows(t))
    return m.select("mention", "total", *(F.round(c, 6).alias(c) for c in ("unresolved", "mass")), (F.round("entropy", 6) + 0.0).alias("entropy"), "unsupported")


@query("""
WITH a AS (SELECT split_part(p_name, ' ', 1) AS surface, p_brand AS entity, CASE WHEN p_size % 5 = 0 THEN 'redirect' WHEN p_size % 3 = 0 THEN 'title' ELSE 'alias' END AS channel, p_partkey AS prov FROM part),
n AS (SELECT split_part(p_name, ' ', -1) AS surface, CASE WHEN p_size % 7 > 0 THEN p_brand END AS entity, 'anchor' AS channel, p_type AS prov FROM part),
g AS (SELECT surface, entity, channel, count(*) AS support, count(DISTINCT prov) AS provenances FROM (SELECT surface, entity, channel, prov::VARCHAR AS prov FROM a UNION ALL SELECT * FROM n) WHERE entity IS NOT NULL GROUP BY ALL),
x AS (SELECT *, row_number() OVER (PARTITION BY surface ORDER BY list_position(['title', 'redirect', 'alias', 'anchor'], channel), support DESC, entity) AS place, row_number() OVER (PARTITION BY surface, channel ORDER BY support DESC, entity) AS channel_rank FROM g),
y AS (SELECT *, min(place) OVER (PARTITION BY surface, entity) AS f FROM x), c AS (SELECT surface, count(*) AS n_anchors FROM n GROUP BY surface)
SELECT surface, entity, channel, support, provenances, dense_rank() OVER (PARTITION BY surface ORDER BY f) AS entity_rank, channel_rank, round(CASE WHEN channel = 'anchor' THEN support / n_anchors ELSE 1 END, 6) AS channel_score FROM y LEFT JOIN c USING (surface)
""")
def channel_proposals(t):
    """First words of part names stand for titles, aliases and redirects, last words for anchors, brands for entities."""
    p = t("part")
    aliases = p.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("surface"), F.col("p_brand").alias("entity"), F.when(F.col("p_size") % 3 == 0, "title").otherwise("alias").alias("kind"), (F.col("p_size") % 5 == 0).alias("redirected"), F.col("p_partkey").cast("string").alias("provenance"))
    anchors = p.select(F.split_part("p_name", F.lit(" "), F.lit(-1)).alias("surface"), F.when(F.col("p_size") % 7 > 0, F.col("p_brand")).alias("entity"), F.col("p_type").alias("provenance"))
    out = A.channel_proposals(aliases, anchors)
    return out.select("surface", "entity", "channel", "support", "provenances", F.col("entity_rank").cast("long").alias("entity_rank"), F.col("channel_rank").cast("long").alias("channel_rank"), F.round("channel_score", 6).alias("channel_score"))


H = A.HYPOTHESIS
CONTEXTS = f"""e AS (SELECT p_brand AS entity, list_distinct(list(p_type)) AS types, list_distinct(list(split_part(p_name, ' ', 1))) AS relations, list_distinct(list(split_part(p_name, ' ', -1))) AS context FROM part GROUP BY 1),
b AS (SELECT p_partkey, p_brand, p_type, string_split(p_name, ' ') AS w FROM part),
c AS (SELECT b.p_partkey, e.entity, round(least(1, {H["name"]} * CASE WHEN e.entity = b.p_brand THEN 1.0 ELSE 0.9 END + {H["type"]} * list_contains(e.types, b.p_type)::INT + {H["relation"]} * list_contains(e.relations, b.w[1])::INT + {H["context"]} * len(list_intersect(b.w, e.context)) / greatest(1, len(e.context))), 6) AS confidence
  FROM b JOIN e ON e.entity = b.p_brand OR e.entity = b.p_brand || '0')"""


def part_candidates(t):
    """Every part's brand and the brand of that name with a zero: two candidates at most, by equality."""
    p = t("part")
    last = F.split_part("p_name", F.lit(" "), F.lit(-1))
    e = p.groupBy(F.col("p_brand").alias("entity")).agg(F.collect_set("p_type").alias("types"), F.collect_set(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("relations"), F.collect_set(last).alias("context"))
    asked = p.select("p_partkey", "p_brand", "p_type", F.split("p_name", " ").alias("w")).withColumn("entity", F.explode(F.array("p_brand", F.concat("p_brand", F.lit("0")))))
    confidence = A.hypothesis_confidence(F.when(F.col("entity") == F.col("p_brand"), 1.0).otherwise(0.9), F.array("p_type"), F.col("types"), F.slice("w", 1, 1), F.col("relations"), F.col("w"), F.col("context"))
    return asked.join(e, "entity").select("p_partkey", "entity", F.round(confidence, 6).alias("confidence"))


@query(f"WITH {CONTEXTS} SELECT p_partkey, entity, confidence FROM c")
def hypothesis_confidences(t):
    return part_candidates(t)


@query(f"""
WITH {CONTEXTS}, r AS (SELECT *, row_number() OVER w AS k, lead(confidence) OVER w AS nxt FROM c WINDOW w AS (PARTITION BY p_partkey ORDER BY confidence DESC, entity))
SELECT p_partkey, entity, confidence, CASE WHEN confidence < 0.82 THEN 'unknown' WHEN round(confidence - coalesce(nxt, 0), 9) < 0.08 THEN 'ambiguous' ELSE 'linked' END AS decision FROM r WHERE k = 1
""")
def mention_decisions(t):
    return A.linked(part_candidates(t), "p_partkey", "entity", "confidence")


FRAMES = """fr AS (SELECT n_nationkey AS frame_id, [n_nationkey, n_nationkey + 25, n_nationkey + 1000000] AS entities, CASE n_nationkey % 3 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['click', 'purchase'] ELSE ['error', 'no such'] END AS relations,
  CASE n_nationkey % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'quantity' WHEN 2 THEN 'list' ELSE 'comparison' END AS asked, CASE n_nationkey % 2 WHEN 0 THEN ['-01-'] ELSE []::VARCHAR[] END AS times, n_nationkey % 5 = 0 AS attributed FROM nation),
ad AS (SELECT event_id AS claim_id, user_id AS subject, event_type AS relation, CASE round(value)::BIGINT % 3 WHEN 0 THEN 'quantity' WHEN 1 THEN 'date' ELSE 'statement' END AS shape, event_id % 10 / 10 AS confidence, strftime(ts, '%Y-%m-%d') AS day, event_id % 7 < 3 AS spoken FROM events),
met AS (SELECT fr.*, ad.* FROM (SELECT *, unnest(entities) AS subject FROM fr) fr JOIN ad USING (subject) WHERE (len(relations) = 0 OR list_contains(relations, relation))
  AND (asked = 'unknown' OR asked = shape OR (asked = 'comparison' AND shape = 'quantity') OR (asked = 'list' AND shape IN ('list', 'entity', 'definition', 'date', 'quantity'))))"""


def frames(t):
    k = F.col("n_nationkey")
    none = F.array().cast("array<string>")
    return t("nation").select(
        k.alias("frame_id"), F.array(*((k + i).cast("long") for i in (0, 25, 1_000_000))).alias("entities"), F.when(k % 3 == 0, none).when(k % 3 == 1, F.array(F.lit("click"), F.lit("purchase"))).otherwise(F.array(F.lit("error"), F.lit("no such"))).alias("relations"),
        F.when(k % 4 == 0, "unknown").when(k % 4 == 1, "quantity").when(k % 4 == 2, "list").otherwise("comparison").alias("shape"), F.when(k % 2 == 0, F.array(F.lit("-01-"))).otherwise(none).alias("times"), (k % 5 == 0).alias("attributed"),
    )


def addressed_claims(t):
    c = claims(t)
    o = F.col("object") % 3
    return c.select("claim_id", F.col("subject").cast("long").alias("subject"), "relation", F.when(o == 0, "quantity").when(o == 1, "date").otherwise("statement").alias("shape"), (F.col("claim_id") % 10 / 10).alias("confidence"), F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.col("family") < 3).alias("spoken"))


@query(f"""WITH {FRAMES} SELECT frame_id, claim_id, row_number() OVER (PARTITION BY frame_id ORDER BY confidence DESC, subject, relation, claim_id) AS rank, count(*) OVER (PARTITION BY frame_id) AS eligible FROM met QUALIFY rank <= 16""")
def claim_lookup(t):
    return A.claim_lookup(frames(t), addressed_claims(t)).select("frame_id", "claim_id", F.col("rank").cast("long").alias("rank"), "eligible")


@query(f"""
WITH {FRAMES}, k AS (SELECT DISTINCT subject, relation FROM ad), f AS (SELECT frame_id, unnest(entities) AS subject, relations FROM fr), s AS (SELECT *, subject IN (SELECT subject FROM k) AS known FROM f),
m AS (SELECT frame_id, unnest(relations) AS relation, subject FROM s WHERE known), l AS (SELECT DISTINCT frame_id, relation FROM m ANTI JOIN k USING (subject, relation))
SELECT frame_id, coalesce((SELECT string_agg(subject::VARCHAR, ',' ORDER BY subject) FROM s WHERE s.frame_id = fr.frame_id AND NOT known), '') AS entities, coalesce((SELECT string_agg(relation, ',' ORDER BY relation) FROM l WHERE l.frame_id = fr.frame_id), '') AS relations FROM fr
""")
def unresolved_addresses(t):
    out = A.unresolved_addresses(frames(t), addressed_claims(t))
    return out.select("frame_id", F.array_join(F.transform("entities", lambda x: x.cast("string")), ",").alias("entities"), F.array_join("relations", ",").alias("relations"))


C = A.CLAIM_FIT
LOOSE = _sql(A.LOOSE_SHAPES)


@query(f"""
WITH {FRAMES} SELECT frame_id, claim_id, round({C["entity"]} * list_contains(entities, subject)::INT + {C["relation"]} * (len(relations) = 0 OR list_contains(relations, relation))::INT
  + {C["shape"]} * CASE WHEN asked = 'unknown' OR asked = shape THEN 1.0 WHEN list_contains({LOOSE}, asked) AND list_contains({LOOSE}, shape) THEN 0.2 ELSE 0 END
  + {C["time"]} * (len(times) = 0 OR len(list_filter(times, lambda x: contains(day, x))) > 0)::INT + {C["attribution"]} * (NOT attributed OR spoken)::INT + {C["confidence"]} * confidence, 6) AS fit
FROM (SELECT *, unnest(entities) AS subject FROM fr) JOIN ad USING (subject)
""")
def claim_fits(t):
    """The fit of every claim of a frame's entities, whatever its relation and shape."""
    f = frames(t).withColumnRenamed("shape", "asked").withColumn("subject", F.explode("entities"))
    return f.join(addressed_claims(t), "subject").select("frame_id", "claim_id", F.round(A.claim_fit(), 6).alias("fit"))


@query("SELECT conv_id, turn, role AS speaker FROM conversations WHERE role IS NOT NULL AND text <> '' AND contains(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), 'the an')")
def quoted_claims(t):
    c = t("conversations").select("conv_id", "turn", F.col("role").alias("speaker"), F.col("text").alias("quotation"))
    return A.attributed(c, " THE \n an ").select("conv_id", "turn", "speaker")


EDGES = [(0.05, 0.1), (0.2, 0.35), (0.5, 0.7)]


@query(f"WITH {CASES} SELECT lang, CASE WHEN score <= 0.05 THEN 0.1 WHEN score <= 0.2 THEN 0.35 ELSE 0.7 END::DOUBLE AS calibrated, count(*) AS n FROM x GROUP BY ALL")
def binned_lookup(t):
    return cases(t).groupBy("lang", A.binned(F.col("score"), EDGES).alias("calibrated")).agg(F.count("*").alias("n"))


@query(f"""
WITH {SCORED}, g AS (SELECT item_id, chunk_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) AS rank FROM s),
h AS (SELECT item_id, min(rank) FILTER (doc_id % 10 = item_id % 10) AS f FROM g JOIN c USING (chunk_id) WHERE rank <= 8 GROUP BY 1)
SELECT count(*) AS cases, {", ".join(f"round(avg((coalesce(f, 99) <= {k})::INT), 6) AS recall_{k}" for k in (1, 4, 8))} FROM benchmark LEFT JOIN h USING (item_id)
""")
def route_recall(t):
    """How early the best chunks hold a document that ends in the question's digit: 1, 4 and 8 routes."""
    top = R.top_k(scored(t), "item_id", [F.desc("score"), F.col("chunk_id")], 8)
    hits = top.withColumn("doc_id", F.split_part("chunk_id", F.lit("#"), F.lit(1)).cast("long")).where("doc_id % 10 = item_id % 10")
    out = A.route_recall(hits, t("benchmark"), "item_id")
    return out.select("cases", *(F.round(f"recall_{k}", 6).alias(f"recall_{k}") for k in (1, 4, 8)))


FIELDS = {"title": 1.8, "section": 1.2, "body": 1.0}
WEIGHTED = f"""wi AS (SELECT chunk_id, regexp_extract_all(lower(coalesce(regexp_extract(text, '[A-Za-z0-9]+'), '')), '[a-z0-9]+') AS title, regexp_extract_all(lower(coalesce(source, '')), '[a-z0-9]+') AS section, regexp_extract_all(lower(chunk_text), '[a-z0-9]+') AS body FROM c JOIN documents USING (doc_id)),
wl AS (SELECT *, len(title) + len(section) + len(body) AS dl FROM wi), wm AS (SELECT count(*)::DOUBLE AS nn, avg(dl) AS md FROM wl),
wt AS (SELECT chunk_id, dl, term, sum(w) AS f FROM (SELECT chunk_id, dl, unnest(title) AS term, 1.8 AS w FROM wl UNION ALL SELECT chunk_id, dl, unnest(section), 1.2 FROM wl UNION ALL SELECT chunk_id, dl, unnest(body), 1.0 FROM wl) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
wd AS (SELECT term, count(*) AS d FROM wt GROUP BY term),
ws AS (SELECT item_id, chunk_id, round(sum(greatest(1e-6, ln((nn - d + 0.5) / (d + 0.5))) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / md))), 6) AS score FROM wt JOIN wd USING (term) JOIN asked USING (term), wm GROUP BY ALL)"""


def weighted(t):
    d = t("documents").select("doc_id", F.regexp_extract("text", "[A-Za-z0-9]+", 0).alias("title"), F.col("source").alias("section"))
    units = R.chunk_table(t("documents")).select("chunk_id", "doc_id", F.col("chunk_text").alias("body")).join(d, "doc_id")
    return R.weighted_bm25(units, questions(t), "chunk_id", FIELDS, "item_id", "q")


@query(f"WITH {CHUNKS}, asked AS (SELECT item_id, unnest(string_split(q, ' ')) AS term FROM (SELECT item_id, array_to_string(list_transform(list_slice(list_sort(list_transform(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), lambda x: (-length(x), x))), 1, 7), lambda x: struct_extract(x, 2)), ' ') AS q FROM benchmark)), {WEIGHTED} SELECT item_id, chunk_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) AS rank FROM ws QUALIFY rank <= 12")
def weighted_search_topk(t):
    return R.top_k(weighted(t), "item_id", [F.desc("score"), F.col("chunk_id")], 12).select("item_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"""
WITH {SCORED}, pool AS (SELECT item_id, chunk_id FROM asked JOIN benchmark USING (item_id), c WHERE doc_id = item_id GROUP BY ALL)
SELECT item_id, chunk_id, coalesce(score, 0) AS score FROM pool LEFT JOIN s USING (item_id, chunk_id)
""")
def restricted_scores(t):
    """Scores of given pairs only, here each question and the chunks of the document of its number; 0 where no term meets."""
    wanted = R.chunk_table(t("documents")).select(F.col("doc_id").alias("item_id"), "chunk_id").join(t("benchmark").select("item_id").where(F.size(R.T.simple_tokens(F.col("text"))) > 0), "item_id")
    return R.restricted(scored(t), cut(wanted), "item_id", "chunk_id")
