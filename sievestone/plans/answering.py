"""Frames, claims, comparison, decision and verification over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answering as A
from ._base import query

SHAPE = """CASE WHEN regexp_matches(q, '\\b(when|year|date)\\b') THEN 'date' WHEN regexp_matches(q, '\\b(how many|number|count|amount)\\b') THEN 'quantity' WHEN regexp_matches(q, '\\b(who|whom|whose)\\b') THEN 'person'
  WHEN regexp_matches(q, '\\b(where|city|country)\\b') THEN 'place' WHEN regexp_matches(q, '\\b(is|are|was|were)\\b') THEN 'statement' ELSE 'span' END"""


@query(f"SELECT item_id, {SHAPE} AS shape FROM (SELECT item_id, lower(text) AS q FROM benchmark)")
def frame_answer_shape(t):
    return t("benchmark").select("item_id", A.answer_shape(F.col("text")).alias("shape"))


@query("""
SELECT conv_id, turn, coalesce(lag(text) OVER w, '') <> '' AS has_previous, coalesce(length(lag(text) OVER w), 0) AS previous_chars, row_number() OVER w AS position, count(*) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS context
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
""")
def previous_turn_context(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    before = F.lag("text").over(w)
    return t("conversations").select(
        "conv_id", "turn", (F.coalesce(before, F.lit("")) != "").alias("has_previous"), F.coalesce(F.length(before), F.lit(0)).cast("long").alias("previous_chars"), F.row_number().over(w).cast("long").alias("position"),
        F.count("*").over(w.rowsBetween(-2, -1)).alias("context"),
    )


CLAIMS = "cl AS (SELECT event_id AS claim_id, user_id AS subject, event_type AS relation, round(value)::BIGINT AS object, event_id % 7 AS family, ts FROM events)"


def claims(t):
    return t("events").select(F.col("event_id").alias("claim_id"), F.col("user_id").alias("subject"), F.col("event_type").alias("relation"), F.round("value").cast("long").alias("object"), (F.col("event_id") % 7).alias("family"), "ts")


@query(f"""
WITH {CLAIMS}, d AS (SELECT subject, relation, object, min(claim_id) AS claim_id, list_sort(list_distinct(list(family))) AS fam FROM cl GROUP BY ALL)
SELECT a.subject, a.relation, a.object AS object_a, b.object AS object_b FROM d a JOIN d b ON a.subject = b.subject AND a.relation = b.relation AND a.object < b.object AND a.fam <> b.fam
""")
def contradiction_pairs(t):
    """Values of one subject and relation that differ, from different families; values are grouped before they are paired."""
    d = claims(t).groupBy("subject", "relation", "object").agg(F.array_sort(F.collect_set("family")).alias("fam"))
    return A.contradictions(d)


@query(f"WITH {CLAIMS} SELECT subject, relation, count(DISTINCT object) AS n_values, count(DISTINCT family) AS n_families, min(object) AS least, max(object) AS most FROM cl GROUP BY ALL")
def value_summaries(t):
    return claims(t).groupBy("subject", "relation").agg(F.countDistinct("object").alias("n_values"), F.countDistinct("family").alias("n_families"), F.min("object").alias("least"), F.max("object").alias("most"))


@query(f"""
WITH {CLAIMS}, f AS (SELECT *, row_number() OVER (PARTITION BY subject, relation, family ORDER BY ts, claim_id) AS r FROM cl) SELECT claim_id, subject, relation, family FROM f WHERE r = 1
""")
def lineage_dedup(t):
    w = Window.partitionBy("subject", "relation", "family").orderBy("ts", "claim_id")
    return claims(t).withColumn("r", F.row_number().over(w)).where("r = 1").select("claim_id", "subject", "relation", "family")


@query(f"""
WITH {CLAIMS}, s AS (SELECT subject, relation, claim_id, object, row_number() OVER (PARTITION BY relation ORDER BY object DESC, claim_id) AS r FROM cl)
SELECT a.relation, a.subject AS subject_a, b.subject AS subject_b, sign(a.object - b.object)::INT AS direction FROM s a JOIN s b ON a.relation = b.relation AND a.r < b.r AND a.subject <> b.subject WHERE a.r <= 4 AND b.r <= 4
QUALIFY row_number() OVER (PARTITION BY a.relation ORDER BY a.r, b.r) = 1
""")
def comparison_pairs(t):
    """The first compatible pair of different subjects among each relation's best four claims."""
    w = Window.partitionBy("relation").orderBy(F.desc("object"), "claim_id")
    s = claims(t).withColumn("r", F.row_number().over(w)).where("r <= 4")
    a = s.select("relation", F.col("subject").alias("subject_a"), F.col("object").alias("oa"), F.col("r").alias("ra"))
    b = s.select("relation", F.col("subject").alias("subject_b"), F.col("object").alias("ob"), F.col("r").alias("rb"))
    pairs = a.join(b, "relation").where("ra < rb AND subject_a <> subject_b").withColumn("k", F.row_number().over(Window.partitionBy("relation").orderBy("ra", "rb"))).where("k = 1")
    return pairs.select("relation", "subject_a", "subject_b", F.signum(F.col("oa") - F.col("ob")).cast("int").alias("direction"))


@query("""
SELECT l.doc_id, CASE WHEN d.text = '' THEN 'empty' WHEN toxic = 1 THEN 'refuse' WHEN quality = 0 AND n_chars < 200 THEN 'clarify' WHEN quality = 0 THEN 'abstain' WHEN n_chars > 8000 THEN 'partial' WHEN lang <> 'en' THEN 'translate' ELSE 'answer' END AS disposition
FROM labels l JOIN documents d USING (doc_id)
""")
def disposition_ladder(t):
    x = t("labels").join(t("documents"), "doc_id")
    ladder = F.when(F.col("text") == "", "empty").when(F.col("toxic") == 1, "refuse").when((F.col("quality") == 0) & (F.col("n_chars") < 200), "clarify").when(F.col("quality") == 0, "abstain").when(F.col("n_chars") > 8000, "partial").when(F.col("lang") != "en", "translate").otherwise("answer")
    return x.select("doc_id", ladder.alias("disposition"))


@query("""
SELECT p_partkey, round(0.35 * (1 - p_size / 50.0) + 0.25 * (p_retailprice / 2000.0) + 0.2 * (p_type = 'ECONOMY')::INT + 0.2 * (p_brand LIKE '%1%')::INT, 8) AS score FROM part
""")
def evidence_score(t):
    return t("part").select("p_partkey", F.round(0.35 * (1 - F.col("p_size") / 50.0) + 0.25 * (F.col("p_retailprice") / 2000.0) + 0.2 * (F.col("p_type") == "ECONOMY").cast("int") + 0.2 * F.col("p_brand").contains("1").cast("int"), 8).alias("score"))


@query()
def greedy_diversity(t):
    """The best three parts per size, a new brand raising a part's score at every step (sequential: no SQL form)."""
    s = evidence_score(t).join(t("part").select("p_partkey", "p_size", "p_brand"), "p_partkey")
    return A.greedy_diversity(s, "p_size", "p_partkey", "score", "p_brand", 3)


@query("""
WITH s AS (SELECT o_custkey, o_orderkey, o_totalprice, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS run FROM orders)
SELECT o_custkey, o_orderkey FROM s WHERE run <= 500000
""")
def skip_fill_cheapest(t):
    """Rows in order of cost within a budget. In order of cost, skipping and stopping agree, so a window does it."""
    w = Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")
    return t("orders").withColumn("run", F.sum("o_totalprice").over(w)).where("run <= 500000").select("o_custkey", "o_orderkey")


@query("""
WITH s AS (SELECT o_custkey, o_orderkey, o_orderdate, o_orderpriority FROM orders), f AS (SELECT *, lag(o_orderpriority) OVER w AS was FROM s WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_custkey, count(*) AS n, coalesce(sum((o_orderpriority = was)::INT), 0)::BIGINT AS repeats FROM f GROUP BY 1
""")
def progress_ledger(t):
    """Repeated actions in a row per key: the stall counter of a session."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    f = t("orders").withColumn("was", F.lag("o_orderpriority").over(w))
    return f.groupBy("o_custkey").agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("o_orderpriority") == F.col("was")).cast("long")), F.lit(0)).alias("repeats"))


@query("""
SELECT doc_id, length(text) = n_chars AS length_ok, strlen(text) >= n_chars AS bytes_ok, sha256(text) = sha256(substr(text, 1, n_chars)) AS hash_ok, lang IN ('en', 'de', 'fr', 'es') AS lang_ok, source LIKE 'src%' AS source_ok,
  CASE WHEN length(text) <> n_chars THEN 'FAIL' WHEN n_chars < 40 THEN 'REVIEW' ELSE 'PASS' END AS verdict FROM documents
""")
def validator_checks(t):
    """Named checks per record and the worst verdict."""
    return t("documents").select(
        "doc_id", (F.length("text") == F.col("n_chars")).alias("length_ok"), (F.octet_length("text") >= F.col("n_chars")).alias("bytes_ok"), (F.sha2("text", 256) == F.sha2(F.expr("substring(text, 1, int(n_chars))"), 256)).alias("hash_ok"),
        F.col("lang").isin("en", "de", "fr", "es").alias("lang_ok"), F.col("source").startswith("src").alias("source_ok"), F.when(F.length("text") != F.col("n_chars"), "FAIL").when(F.col("n_chars") < 40, "REVIEW").otherwise("PASS").alias("verdict"),
    )


@query("""
WITH w AS (SELECT unnest(range(0, 4)) AS k), b AS (SELECT n_nationkey, n_name, k, CASE k WHEN 0 THEN n_name WHEN 1 THEN upper(n_name) || '!' WHEN 2 THEN replace(n_name, 'A', 'B') ELSE n_name || ' ' || (n_nationkey + 1) END AS mutated FROM nation, w)
SELECT k, count(*) AS n, count(*) FILTER (mutated IS DISTINCT FROM n_name) AS rejected FROM b GROUP BY k
""")
def mutation_rejection(t):
    """An exact verifier against corrupted copies: how many of each kind it rejects."""
    k = F.col("k")
    b = t("nation").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    m = F.when(k == 0, F.col("n_name")).when(k == 1, F.concat(F.upper("n_name"), F.lit("!"))).when(k == 2, F.replace(F.col("n_name"), F.lit("A"), F.lit("B"))).otherwise(F.concat_ws(" ", "n_name", (F.col("n_nationkey") + 1).cast("string")))
    return b.groupBy("k").agg(F.count("*").alias("n"), F.count(F.when(~m.eqNullSafe(F.col("n_name")), 1)).alias("rejected"))


@query("""
WITH f AS (SELECT l_shipdate AS d, l_quantity AS q, CASE l_linenumber % 3 WHEN 0 THEN 'kg' WHEN 1 THEN 'g' ELSE 'm' END AS unit, l_orderkey, l_linenumber FROM lineitem)
SELECT l_orderkey, l_linenumber, round(CASE unit WHEN 'kg' THEN q * 1000 WHEN 'g' THEN q END, 6) AS grams FROM f WHERE unit <> 'm'
""")
def unit_conversion(t):
    m = F.col("l_linenumber") % 3
    unit = F.when(m == 0, "kg").when(m == 1, "g").otherwise("m")
    f = t("lineitem").select("l_orderkey", "l_linenumber", A.convert(F.col("l_quantity"), unit, "g").alias("grams"))
    return f.where("grams IS NOT NULL").select("l_orderkey", "l_linenumber", F.round("grams", 6).alias("grams"))


@query("""
WITH d AS (SELECT * FROM documents), g AS (SELECT d.doc_id, coalesce(l.quality, -1) AS q, coalesce(l.toxic, -1) AS x, n_chars FROM d LEFT JOIN labels l USING (doc_id))
SELECT CASE WHEN q = -1 THEN 'unlabelled' WHEN x = 1 THEN 'toxic' WHEN q = 0 THEN 'poor' WHEN n_chars < 100 THEN 'short' ELSE 'good' END AS stage, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM g GROUP BY 1
""")
def stage_attribution(t):
    """The first stage at which a document is lost."""
    g = t("documents").join(t("labels"), "doc_id", "left")
    stage = F.when(F.col("quality").isNull(), "unlabelled").when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("n_chars") < 100, "short").otherwise("good")
    return g.groupBy(stage.alias("stage")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("""
SELECT s_suppkey, n_name AS entity, CASE WHEN s_acctbal < 0 THEN 'REFUTED' WHEN s_acctbal > 5000 THEN 'SUPPORTED' ELSE 'UNKNOWN' END AS verdict FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_regionkey > 1)
""")
def premise_evaluation(t):
    n = t("nation").join(t("region").where("r_regionkey > 1"), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    v = F.when(F.col("s_acctbal") < 0, "REFUTED").when(F.col("s_acctbal") > 5000, "SUPPORTED").otherwise("UNKNOWN")
    return t("supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("entity"), v.alias("verdict"))


@query("""
(SELECT DISTINCT c_nationkey AS k, 'both' AS side FROM customer INTERSECT SELECT DISTINCT s_nationkey, 'both' FROM supplier)
UNION ALL (SELECT DISTINCT n_nationkey, 'no supplier' FROM nation EXCEPT SELECT DISTINCT s_nationkey, 'no supplier' FROM supplier WHERE s_acctbal < 0)
""")
def set_differences(t):
    c, s = t("customer").select(F.col("c_nationkey").alias("k")), t("supplier").select(F.col("s_nationkey").alias("k"), "s_acctbal")
    both = c.intersect(s.select("k")).withColumn("side", F.lit("both"))
    only = t("nation").select(F.col("n_nationkey").alias("k")).exceptAll(s.where("s_acctbal < 0").select("k").distinct()).withColumn("side", F.lit("no supplier"))
    return both.unionByName(only)


@query("""
SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS path, list_aggregate(list_distinct(list(role)), 'count') AS n_roles, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id
""")
def session_paths(t):
    listed = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return t("conversations").groupBy("conv_id").agg(F.array_join(F.transform(listed, lambda x: x["role"]), ">").alias("path"), F.countDistinct("role").alias("n_roles"), F.sum(F.length("text")).cast("long").alias("chars"))
