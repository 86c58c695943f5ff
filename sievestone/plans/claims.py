"""Queries over claims in time, and summaries of workloads, depths and channels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import claims as C
from ._base import query
from .answering import CLAIMS, claims
from .evaluation import CASES, cases


@query(f"WITH {CLAIMS} SELECT claim_id, subject, relation, family FROM cl WHERE relation IN ('click', 'purchase') AND family IN (1, 2, 3) AND (strftime(ts, '%Y-%m-%d') LIKE '%-01-%' OR strftime(ts, '%Y-%m-%d') LIKE '%-15%')")
def claim_filters(t):
    return C.select_claims(claims(t), relations=["click", "purchase"], sources=[1, 2, 3], times=["-01-", "-15"]).select("claim_id", "subject", "relation", "family")


@query(f"WITH {CLAIMS} SELECT subject, family, string_agg(DISTINCT claim_id::VARCHAR, ',' ORDER BY claim_id::VARCHAR) AS claim_ids FROM cl GROUP BY ALL")
def claims_by_family(t):
    out = C.by_family(claims(t).withColumn("claim_id", F.col("claim_id").cast("string")), ["subject"])
    return out.select("subject", "family", F.array_join("claim_ids", ",").alias("claim_ids"))


@query(f"WITH {CLAIMS}, f AS (SELECT subject, relation, min(claim_id) AS first_id FROM cl GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY subject ORDER BY first_id, relation) AS position FROM f")
def relation_enumeration(t):
    return C.enumerated(claims(t), "subject", "relation").withColumn("position", F.col("position").cast("long"))


@query(f"""WITH {CLAIMS} SELECT subject, relation, first(claim_id ORDER BY ts, claim_id) AS earliest_id, first(object ORDER BY ts, claim_id) AS earliest, last(claim_id ORDER BY ts, claim_id) AS latest_id, last(object ORDER BY ts, claim_id) AS latest FROM cl GROUP BY ALL""")
def temporal_extremes(t):
    return C.extremes(claims(t), ["subject", "relation"])


@query(f"WITH {CLAIMS} SELECT subject, claim_id, row_number() OVER (PARTITION BY subject ORDER BY ts, claim_id) AS place FROM cl")
def temporal_order(t):
    return C.ordered(claims(t), "subject").select("subject", "claim_id", F.col("place").cast("long").alias("place"))


@query(f"""WITH {CLAIMS}, r AS (SELECT *, row_number() OVER w AS r, lead(claim_id) OVER w AS next_id, lead(object) OVER w AS next_object FROM cl WINDOW w AS (PARTITION BY subject, relation ORDER BY ts, claim_id))
SELECT subject, relation, claim_id, next_id, object, next_object FROM r WHERE r % 2 = 1 AND next_object <> object""")
def adjacent_claim_pairs(t):
    return C.adjacent_pairs(claims(t), ["subject", "relation"])


@query(f"WITH {CLAIMS} SELECT claim_id, subject, relation, object FROM cl WHERE relation IN ('view', 'purchase') AND (subject IN (SELECT n_nationkey FROM nation) OR object IN (SELECT n_nationkey FROM nation))")
def claims_of_entities(t):
    return C.join_by_entity(claims(t), ["subject", "object"], t("nation").select(F.col("n_nationkey").alias("entity")), ["view", "purchase"]).select("claim_id", "subject", "relation", "object")


@query("""SELECT a.l_orderkey, CASE WHEN a.l_linestatus = b.l_linestatus THEN sign(a.l_quantity - b.l_quantity)::INT END AS comparison
FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber = 2""")
def quantity_comparison(t):
    one = lambda n, s: t("lineitem").where(F.col("l_linenumber") == n).select("l_orderkey", F.col("l_quantity").alias(f"q{s}"), F.col("l_linestatus").alias(f"u{s}"))
    return one(1, "a").join(one(2, "b"), "l_orderkey").select("l_orderkey", C.compare_quantities(F.col("qa"), F.col("ua"), F.col("qb"), F.col("ub")).alias("comparison"))


@query("""WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, round(1 - max(n) / sum(n), 6) AS disagreement, count(*) AS choices FROM n GROUP BY user_id""")
def channel_disagreement(t):
    return C.mode_disagreement(t("events"), "user_id", "event_type").withColumn("disagreement", F.round("disagreement", 6))


@query(f"WITH {CASES} SELECT least(floor(score * 10)::INT, 9) AS bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(correct::INT), 6) AS accuracy FROM x GROUP BY 1")
def binned_correctness(t):
    bin_ = F.least(F.floor(F.col("score") * 10), F.lit(9)).cast("int").alias("bin")
    return cases(t).groupBy(bin_).agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.avg(F.col("correct").cast("int")), 6).alias("accuracy"))


@query("SELECT source, count(*) AS n, max(n_chars) AS most, sum(n_chars)::BIGINT AS total, quantile_disc(n_chars, 0.5) AS p50, quantile_disc(n_chars, 0.95) AS p95 FROM documents GROUP BY source")
def workload_profile(t):
    return t("documents").groupBy("source").agg(F.count("*").alias("n"), F.max("n_chars").alias("most"), F.sum("n_chars").cast("long").alias("total"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY n_chars)").cast("long").alias("p50"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY n_chars)").cast("long").alias("p95"))


@query("WITH d AS (SELECT conv_id, max(turn) AS depth FROM conversations GROUP BY 1) SELECT depth, count(*) AS n FROM d GROUP BY depth")
def depth_distribution(t):
    return t("conversations").groupBy("conv_id").agg(F.max("turn").alias("depth")).groupBy("depth").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT n_nationkey, lower(n_name) AS a, lower(r_name) AS b FROM nation JOIN region ON n_regionkey = r_regionkey),
x AS (SELECT n_nationkey, g, count(*) AS c FROM (SELECT n_nationkey, unnest(list_transform(range(1, greatest(length(a) - 1, 1)), lambda i: substr(a, i, 3))) AS g FROM p) GROUP BY ALL),
y AS (SELECT n_nationkey, g, count(*) AS c FROM (SELECT n_nationkey, unnest(list_transform(range(1, greatest(length(b) - 1, 1)), lambda i: substr(b, i, 3))) AS g FROM p) GROUP BY ALL),
d AS (SELECT x.n_nationkey, sum(x.c * y.c) AS dot FROM x JOIN y USING (n_nationkey, g) GROUP BY 1), nx AS (SELECT n_nationkey, sum(c * c) AS s FROM x GROUP BY 1), ny AS (SELECT n_nationkey, sum(c * c) AS s FROM y GROUP BY 1)
SELECT n_nationkey, round(least(1.0, coalesce(dot / sqrt(nx.s * ny.s), 0)), 6) AS similarity FROM p LEFT JOIN d USING (n_nationkey) LEFT JOIN nx USING (n_nationkey) LEFT JOIN ny USING (n_nationkey)""")
def trigram_cosine(t):
    p = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))  # regions: five rows
    return p.select("n_nationkey", F.round(C.trigram_cosine(F.col("n_name"), F.col("r_name")), 6).alias("similarity"))
