"""Mention linking: surfaces, priors, fuzzy and cascaded matches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph as G
from ..operators.storage import cut
from ._base import query
from .corpus import vocabulary_topk
from .graph import LINKS

SPLIT = "CASE WHEN b < 80 THEN 'fit' WHEN b < 90 THEN 'calibration' ELSE 'selection' END"
OCC = f"""{LINKS}, o AS (SELECT page_id, lower(target) AS surface, 'E' || (length(target) % 5) || '-' || (page_id % 3) AS entity, {SPLIT} AS split
  FROM (SELECT *, ('0x' || substr(sha256(page_id::VARCHAR), 1, 8))::BIGINT % 100 AS b FROM l) WHERE target LIKE '/%')"""


def occurrences(t):
    """(page, surface, entity, split): link occurrences; the fixture's entity is made from the link's shape."""
    b = T.hash_bucket(F.col("page_id"), 100)
    split = F.when(b < 80, "fit").when(b < 90, "calibration").otherwise("selection")
    links = G.html_links(t("pages")).where("target LIKE '/%'")
    return links.select("page_id", F.lower("target").alias("surface"), F.concat(F.lit("E"), F.length("target") % 5, F.lit("-"), F.col("page_id") % 3).alias("entity"), split.alias("split"))


@query(f"WITH {OCC} SELECT surface, entity, split, count(*) AS occurrences, count(DISTINCT page_id) AS n_documents FROM o GROUP BY ALL")
def occurrence_counts(t):
    return occurrences(t).groupBy("surface", "entity", "split").agg(F.count("*").alias("occurrences"), F.countDistinct("page_id").alias("n_documents"))


@query(f"""
WITH {OCC}, v AS (SELECT view, surface, entity, count(*) AS n FROM o, (VALUES ('fit'), ('fit_calibration'), ('all')) w(view)
  WHERE view = 'all' OR split = 'fit' OR (view = 'fit_calibration' AND split = 'calibration') GROUP BY ALL),
p AS (SELECT *, n / sum(n) OVER (PARTITION BY view, surface) AS p FROM v)
SELECT view, surface, sum(n)::BIGINT AS total, count(*) AS ambiguity, round(-sum(p * ln(p)), 6) + 0.0 AS entropy, string_agg(entity || ':' || n, ',' ORDER BY n DESC, entity) AS candidates FROM p GROUP BY ALL
""")
def surface_statistics_views(t):
    views = F.array(*(F.struct(F.lit(v).alias("view"), F.array(*map(F.lit, s)).alias("splits")) for v, s in (("fit", ["fit"]), ("fit_calibration", ["fit", "calibration"]), ("all", ["fit", "calibration", "selection"]))))
    o = occurrences(t).groupBy("surface", "entity", "split").agg(F.count("*").alias("n")).withColumn("v", F.explode(views)).where("array_contains(v.splits, split)")
    n = o.groupBy(F.col("v.view").alias("view"), "surface", "entity").agg(F.sum("n").alias("n"))
    p = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("view", "surface")))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "entity", "n")))
    return p.groupBy("view", "surface").agg(
        F.sum("n").alias("total"), F.count("*").alias("ambiguity"), (F.round(-F.sum(F.col("p") * F.log("p")), 6) + 0.0).alias("entropy"),
        F.array_join(F.transform(listed, lambda x: F.concat(x["entity"], F.lit(":"), x["n"])), ",").alias("candidates"),
    )


@query(f"""
WITH {OCC}, n AS (SELECT surface, entity, count(*) AS n FROM o WHERE split = 'fit' GROUP BY ALL), g AS (SELECT *, sum(n) OVER s AS total, count(*) OVER s AS amb FROM n WINDOW s AS (PARTITION BY surface))
SELECT surface, entity, round((n + 0.5) / (total + 0.5 * amb), 6) AS prior, row_number() OVER (PARTITION BY surface ORDER BY n DESC, entity) AS rank FROM g
""")
def smoothed_anchor_prior(t):
    n = occurrences(t).where("split = 'fit'").groupBy("surface", "entity").agg(F.count("*").alias("n"))
    s = Window.partitionBy("surface")
    g = n.withColumn("total", F.sum("n").over(s)).withColumn("amb", F.count("*").over(s))
    return g.select("surface", "entity", F.round((F.col("n") + 0.5) / (F.col("total") + 0.5 * F.col("amb")), 6).alias("prior"), F.row_number().over(s.orderBy(F.desc("n"), "entity")).cast("long").alias("rank"))


@query(f"""
WITH {OCC}, n AS (SELECT surface, entity, count(*) AS n FROM o GROUP BY ALL), r AS (SELECT *, n / sum(n) OVER (PARTITION BY surface) AS p, row_number() OVER (PARTITION BY surface ORDER BY n DESC, entity) AS k FROM n)
SELECT surface, round(sum(p) FILTER (k <= 2), 6) AS retained_mass, round(coalesce(sum(p) FILTER (k > 2), 0), 6) AS omitted_mass, abs(sum(p) - 1) < 1e-12 AS whole FROM r GROUP BY surface
""")
def omitted_mass(t):
    s = Window.partitionBy("surface")
    n = occurrences(t).groupBy("surface", "entity").agg(F.count("*").alias("n"))
    r = n.withColumn("p", F.col("n") / F.sum("n").over(s)).withColumn("k", F.row_number().over(s.orderBy(F.desc("n"), "entity")))
    return r.groupBy("surface").agg(F.round(F.sum(F.when(F.col("k") <= 2, F.col("p"))), 6).alias("retained_mass"), F.round(F.coalesce(F.sum(F.when(F.col("k") > 2, F.col("p"))), F.lit(0.0)), 6).alias("omitted_mass"), (F.abs(F.sum("p") - 1) < 1e-12).alias("whole"))


GRAMS = "list_distinct(list_transform(range(1, length(f) - 1), lambda i: substr(f, i, 3)))"


@query(f"""
WITH s AS (SELECT p_partkey AS id, '^' || p_name || '$' AS f, p_name FROM part), g AS (SELECT id, p_name, {GRAMS} AS g FROM s),
q AS (SELECT DISTINCT p_name || 's' AS q FROM part), qg AS (SELECT q, {GRAMS.replace('f)', "('^' || q || '$'))").replace('substr(f', "substr('^' || q || '$'")} AS qs FROM q),
n AS (SELECT DISTINCT p_name, g FROM g), m AS (SELECT q, p_name, len(list_intersect(qs, g)) AS shared, len(qs) AS a, len(g) AS b FROM qg, n WHERE len(list_intersect(qs, g)) > 0),
x AS (SELECT q, p_name AS surface, round(0.7 * (2.0 * shared / (a + b)) + 0.3 * (shared / least(a, b)), 6) AS score FROM m)
SELECT q, surface, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, surface) AS rank FROM x WHERE score >= 0.52 QUALIFY rank <= 5
""")
def trigram_dice_topk(t):
    """Names against misspelt names by shared framed trigrams: postings meet postings, only pairs that share a gram exist."""
    names = t("part").select(F.col("p_name").alias("surface")).distinct()
    gram = names.select("surface", T.gram_set(F.col("surface")).alias("g"))
    ask = names.select(F.concat("surface", F.lit("s")).alias("q")).select("q", T.gram_set(F.col("q")).alias("g"))
    left = ask.select("q", F.size("g").alias("a"), F.explode("g").alias("gram"))
    right = gram.select("surface", F.size("g").alias("b"), F.explode("g").alias("gram"))
    m = left.join(right, "gram").groupBy("q", "surface", "a", "b").agg(F.count("*").alias("both"))
    score = F.round(0.7 * (2.0 * F.col("both") / (F.col("a") + F.col("b"))) + 0.3 * (F.col("both") / F.least("a", "b")), 6)
    w = Window.partitionBy("q").orderBy(F.desc("score"), "surface")
    return m.select("q", "surface", score.alias("score")).where("score >= 0.52").withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 5")


@query("""
WITH a AS (SELECT DISTINCT p_name AS n FROM part), q AS (SELECT n AS w, substr(n, 1, 3) || substr(n, 5) AS q FROM a)
SELECT q.q, a.n AS name, levenshtein(q.q, a.n)::BIGINT AS distance, round(1 - levenshtein(q.q, a.n) / greatest(length(q.q), length(a.n)), 6) AS similarity
FROM q JOIN a ON substr(q.q, 1, 1) = substr(a.n, 1, 1) AND length(a.n) BETWEEN length(q.q) - 2 AND length(q.q) + 2 WHERE levenshtein(q.q, a.n) <= 2
""")
def levenshtein_blocked(t):
    """Edit distance of two at most, within blocks of first letter and length band.

    Two edits leave one of a name's three parts whole: it stands in the question within two
    places of where it stands in the name, so names and questions meet on parts only.
    """
    a = t("part").select(F.col("p_name").alias("name")).distinct()
    q = a.select(F.concat(F.substring("name", 1, 3), F.expr("substring(name, 5)")).alias("q"))
    third = lambda n, i: F.floor(i * n / 3).cast("int")
    start, width = third(F.col("len"), F.col("i")), third(F.col("len"), F.col("i") + 1) - third(F.col("len"), F.col("i"))
    thirds = F.explode(F.sequence(F.lit(0), F.lit(2)))
    parts = a.withColumn("len", F.length("name")).withColumn("i", thirds).select("name", F.substring("name", 1, 1).alias("first"), "len", "i", F.substr("name", start + 1, width).alias("part"))
    band = q.withColumn("len", F.explode(F.sequence(F.greatest(F.length("q") - 2, F.lit(0)), F.length("q") + 2))).withColumn("i", thirds)
    at = band.withColumn("at", F.explode(F.sequence(F.greatest(start - 2, F.lit(0)), start + 2))).where(F.col("at") + width <= F.length("q"))
    asked = at.select("q", F.substring("q", 1, 1).alias("first"), "len", "i", F.substr("q", F.col("at") + 1, width).alias("part")).distinct()
    pairs = parts.join(asked, ["first", "len", "i", "part"]).select("q", "name").distinct()
    d = F.levenshtein("q", "name", 2)
    return pairs.withColumn("d", d).where("d >= 0").select("q", "name", F.col("d").cast("long").alias("distance"), F.round(1 - F.col("d") / F.greatest(F.length("q"), F.length("name")), 6).alias("similarity"))


@query()
def osa_correction(t):
    """Words of the documents with their first letters swapped, corrected by the vocabulary.

    Symmetric-delete candidates verified by optimal string alignment (transpositions cost one;
    SQL has no such distance); the vocabulary is that of vocabulary_topk.
    """
    vocab = cut(vocabulary_topk(t).select(F.col("term").alias("token"), "freq"))
    ask = vocab.select(F.concat(F.substring("token", 2, 1), F.substring("token", 1, 1), F.expr("substring(token, 3)")).alias("q")).distinct()
    left, right = ask.select("q", F.explode(T.deletions(F.col("q"), 1)).alias("v")), vocab.select("token", "freq", F.explode(T.deletions(F.col("token"), 1)).alias("v"))
    pairs = left.join(right, "v").select("q", "token", "freq").distinct().withColumn("distance", T.osa(F.col("q"), F.col("token")))
    w = Window.partitionBy("q").orderBy("distance", F.desc("freq"), "token")
    return pairs.where("distance <= 2").withColumn("rank", F.row_number().over(w)).where("rank = 1")


@query("""
WITH q AS (SELECT n_nationkey AS id, CASE n_nationkey % 4 WHEN 0 THEN n_name WHEN 1 THEN lower(n_name) WHEN 2 THEN n_name || 'x' ELSE 'zz' || n_nationkey END AS mention FROM nation),
c AS (SELECT id, mention, n_name AS entity, 1 AS level, 1.0 AS score FROM q JOIN nation ON mention = n_name
UNION ALL SELECT id, mention, n_name, 2, 0.97 FROM q JOIN nation ON lower(mention) = lower(n_name)
UNION ALL SELECT id, mention, n_name, 3, round(0.88 * (1 - levenshtein(lower(mention), lower(n_name)) / greatest(length(mention), length(n_name))), 6) FROM q JOIN nation ON substr(lower(mention), 1, 1) = substr(lower(n_name), 1, 1) AND levenshtein(lower(mention), lower(n_name)) <= 2),
b AS (SELECT * FROM c QUALIFY level = min(level) OVER (PARTITION BY id)), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, entity) AS k, lead(score) OVER (PARTITION BY id ORDER BY score DESC, entity) AS nxt FROM b)
SELECT q.id, q.mention, r.entity, coalesce(r.level, 0) AS level, coalesce(r.score, 0.0)::DOUBLE AS score, CASE WHEN r.id IS NULL THEN 'unknown' WHEN r.score < 0.7 THEN 'unknown' WHEN r.score - coalesce(nxt, 0) < 0.08 THEN 'ambiguous' ELSE 'linked' END AS decision
FROM q LEFT JOIN r ON q.id = r.id AND r.k = 1
""")
def cascade_link(t):
    """Exact, folded, then fuzzy matches; a later level only where the earlier ones are empty; then threshold and margin."""
    n = t("nation").select(F.col("n_name").alias("entity"))
    k = F.col("n_nationkey") % 4
    q = t("nation").select(F.col("n_nationkey").alias("id"), F.when(k == 0, F.col("n_name")).when(k == 1, F.lower("n_name")).when(k == 2, F.concat("n_name", F.lit("x"))).otherwise(F.concat(F.lit("zz"), "n_nationkey")).alias("mention"))
    exact = q.join(n, F.col("mention") == F.col("entity")).select("id", "entity", F.lit(1).alias("level"), F.lit(1.0).alias("score"))
    folded = q.join(n, F.lower("mention") == F.lower("entity")).select("id", "entity", F.lit(2).alias("level"), F.lit(0.97).alias("score"))
    d = F.levenshtein(F.lower("mention"), F.lower("entity"), 2)
    fuzzy = q.join(n, F.substring(F.lower("mention"), 1, 1) == F.substring(F.lower("entity"), 1, 1)).withColumn("d", d).where("d >= 0")
    fuzzy = fuzzy.select("id", "entity", F.lit(3).alias("level"), F.round(0.88 * (1 - F.col("d") / F.greatest(F.length("mention"), F.length("entity"))), 6).alias("score"))
    c = exact.unionByName(folded).unionByName(fuzzy)
    best = c.withColumn("least", F.min("level").over(Window.partitionBy("id"))).where("level = least")
    w = Window.partitionBy("id").orderBy(F.desc("score"), "entity")
    r = best.withColumn("k", F.row_number().over(w)).withColumn("nxt", F.lead("score").over(w)).where("k = 1").drop("k", "least")
    out = q.join(r, "id", "left")
    decision = F.when(F.col("score").isNull() | (F.col("score") < 0.7), "unknown").when(F.col("score") - F.coalesce("nxt", F.lit(0.0)) < 0.08, "ambiguous").otherwise("linked")
    return out.select("id", "mention", "entity", F.coalesce("level", F.lit(0)).alias("level"), F.coalesce("score", F.lit(0.0)).alias("score"), decision.alias("decision"))


@query("""
SELECT c_custkey, c_name FROM customer WHERE c_name >= 'Customer#0000001' AND c_name < 'Customer#0000001' || chr(1114111)
""")
def prefix_range(t):
    return t("customer").where(F.col("c_name").startswith("Customer#0000001")).select("c_custkey", "c_name")


@query("""
WITH x AS (SELECT vec_id, label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), m AS (SELECT vec_id, max(v) AS m FROM x GROUP BY 1)
SELECT vec_id, i, round(exp((v - m) / 0.5) / sum(exp((v - m) / 0.5)) OVER (PARTITION BY vec_id), 6) AS p FROM x JOIN m USING (vec_id)
""")
def softmax_temperature(t):
    x = t("embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).select("vec_id", (F.col("i") + 1).cast("long").alias("i"), F.col("v").cast("double").alias("v"))
    w = Window.partitionBy("vec_id")
    e = F.exp((F.col("v") - F.max("v").over(w)) / 0.5)
    return x.withColumn("e", e).select("vec_id", "i", F.round(F.col("e") / F.sum("e").over(w), 6).alias("p"))


@query("""
WITH p AS (SELECT user_id, event_type, count(*)::DOUBLE AS n FROM events GROUP BY ALL), q AS (SELECT user_id, event_type, n / sum(n) OVER (PARTITION BY user_id) AS p FROM p)
SELECT user_id, round(-sum(p * ln(p)), 6) AS entropy, round(CASE WHEN count(*) > 1 THEN -sum(p * ln(p)) / ln(count(*)) ELSE 0 END, 6) AS normalised, round(1 - max(p), 6) AS disagreement FROM q GROUP BY user_id
""")
def entropy_and_disagreement(t):
    p = t("events").groupBy("user_id", "event_type").agg(F.count("*").cast("double").alias("n"))
    q = p.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("user_id")))
    h = -F.sum(F.col("p") * F.log("p"))
    return q.groupBy("user_id").agg(F.round(h, 6).alias("entropy"), F.round(F.when(F.count("*") > 1, h / F.log(F.count("*"))).otherwise(0.0), 6).alias("normalised"), F.round(1 - F.max("p"), 6).alias("disagreement"))
