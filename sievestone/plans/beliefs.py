"""Beliefs about a user's events: each quarter of the day is an expert, event types are labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import beliefs as B
from ._base import query

BELIEFS = """n AS (SELECT user_id AS case_id, hour(ts) // 6 AS expert, event_type AS label, count(*) AS n FROM events GROUP BY ALL),
b AS (SELECT *, n / sum(n) OVER (PARTITION BY case_id, expert) AS p FROM n),
x AS (SELECT case_id, expert, sum(n)::DOUBLE / sum(sum(n)) OVER (PARTITION BY case_id) AS gate, ln(1 + sum(n)) AS prec FROM n GROUP BY case_id, expert),
seen AS (SELECT DISTINCT case_id, label FROM b), every AS (SELECT DISTINCT case_id, t.label FROM b, (SELECT DISTINCT label FROM n) t)"""


def aligned_sql(name: str, labels: str) -> str:
    return f"""{name}0 AS (SELECT e.case_id, e.expert, l.label, greatest(coalesce(b.p, 0), 1e-12) AS p FROM x e JOIN {labels} l USING (case_id) LEFT JOIN b ON b.case_id = e.case_id AND b.expert = e.expert AND b.label = l.label),
{name}1 AS (SELECT case_id, expert, label, p / sum(p) OVER (PARTITION BY case_id, expert) AS p FROM {name}0),
{name} AS (SELECT *, avg(p) OVER (PARTITION BY case_id, label) AS mean, row_number() OVER (PARTITION BY case_id, expert ORDER BY p DESC, label) - 1 AS rk FROM {name}1)"""


DISAGREEMENT = f"""{BELIEFS}, {aligned_sql("a", "seen")},
per AS (SELECT case_id, expert, sum(p * ln(p / mean)) AS kl, CASE WHEN count(*) > 1 THEN -sum(p * ln(p)) / ln(count(*)) ELSE 0 END AS h, arg_min(label, rk) AS top, max(p) AS sure, count(*) AS k FROM a GROUP BY ALL),
pairs AS (SELECT l.case_id, l.expert, r.expert AS other, sum(abs(l.rk - r.rk)) AS d FROM a l JOIN a r ON l.case_id = r.case_id AND l.label = r.label AND l.expert < r.expert GROUP BY ALL),
dist AS (SELECT case_id, avg(d) AS d FROM pairs GROUP BY 1),
con AS (SELECT l.case_id, max(least(l.sure, r.sure)) AS c FROM per l JOIN per r ON l.case_id = r.case_id AND l.top <> r.top GROUP BY 1),
one AS (SELECT case_id, avg(kl) / ln(2.0) AS js, (count(DISTINCT top) - 1) / (count(*) - 1) AS top1, max(h) - min(h) AS h, any_value(k) AS k, count(*) AS m FROM per GROUP BY 1),
d AS (SELECT case_id, CASE WHEN m < 2 THEN 0 ELSE least(1, js) END AS js, CASE WHEN m < 2 THEN 0 ELSE top1 END AS top1, CASE WHEN m < 2 THEN 0 ELSE least(1, d / (k * greatest(1, k - 1))) END AS rank,
  CASE WHEN m < 2 THEN 0 ELSE least(1, h) END AS entropy, coalesce(c, 0) AS contradiction FROM one LEFT JOIN dist USING (case_id) LEFT JOIN con USING (case_id)),
dis AS (SELECT *, least(1, greatest(js, top1, rank, entropy, contradiction)) AS aggregate FROM d)"""


def beliefs(t):
    """(beliefs, experts, prior) of all events."""
    e = t("events").select(F.col("user_id").alias("case"), F.floor(F.hour("ts") / 6).alias("expert"), F.col("event_type").alias("label"))
    n = e.groupBy("case", "expert", "label").agg(F.count("*").alias("n"))
    total = n.groupBy("case", "expert").agg(F.sum("n").alias("total"))
    whole = n.groupBy("case").agg(F.sum("n").alias("whole"))
    experts = total.join(whole, "case").select("case", "expert", (F.col("total") / F.col("whole")).alias("gate"), F.log1p("total").alias("precision"))
    b = n.join(total, ["case", "expert"]).select("case", "expert", "label", (F.col("n") / F.col("total")).alias("p"))
    types = t("events").groupBy(F.col("event_type").alias("label")).agg(F.count("*").alias("c"))
    shares = F.broadcast(types.crossJoin(types.agg(F.sum("c").alias("all"))).select("label", (F.col("c") / F.col("all")).alias("p")))  # one row an event type
    return b, experts, whole.select("case").crossJoin(shares)


@query(f"""WITH {DISAGREEMENT} SELECT case_id, round(js, 6) + 0.0 AS js, round(top1, 6) + 0.0 AS top1, round(rank, 6) + 0.0 AS rank, round(entropy, 6) + 0.0 AS entropy, round(contradiction, 6) + 0.0 AS contradiction, round(aggregate, 6) + 0.0 AS aggregate FROM dis""")
def expert_disagreement(t):
    out = B.disagreement(beliefs(t)[0])
    return out.select(F.col("case").alias("case_id"), *((F.round(c, 6) + 0.0).alias(c) for c in ("js", "top1", "rank", "entropy", "contradiction", "aggregate")))


@query(f"""
WITH {DISAGREEMENT}, {aligned_sql("f", "every")},
pr AS (SELECT event_type AS label, count(*) / sum(count(*)) OVER () AS p FROM events GROUP BY 1),
hh AS (SELECT case_id, expert, CASE WHEN count(*) > 1 THEN -sum(p * ln(p)) / ln(count(*)) ELSE 0 END AS h FROM f GROUP BY ALL),
g AS (SELECT case_id, expert, gate, prec, gate / (1 + exp(-greatest(-60, least(60, prec - h - aggregate)))) AS lg FROM x JOIN hh USING (case_id, expert) JOIN dis USING (case_id)),
s AS (SELECT case_id, label, sum(gate * ln(p)) AS plain, sum(gate * prec * ln(p)) AS precise, sum(gate * prec) AS weight, sum(lg * ln(p)) AS gated FROM f JOIN g USING (case_id, expert) GROUP BY ALL),
l AS (SELECT method, case_id, label, CASE method WHEN 'weighted_logit' THEN ln(p) + plain WHEN 'precision_residual' THEN (ln(p) + precise) / (1 + weight) WHEN 'learned' THEN ln(p) + gated ELSE ln(p) + plain / 2 END AS z
  FROM s JOIN pr USING (label), (VALUES ('weighted_logit'), ('temperature_product'), ('precision_residual'), ('learned'), ('particle_top_k')) m(method)),
e AS (SELECT *, exp(z - max(z) OVER (PARTITION BY method, case_id)) AS ez FROM l),
q AS (SELECT method, case_id, label, ez / sum(ez) OVER (PARTITION BY method, case_id) AS p FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY method, case_id ORDER BY round(p, 9) DESC, label) AS place FROM q)
SELECT method, case_id, CASE WHEN method = 'particle_top_k' AND place > 2 THEN 'unresolved' ELSE label END AS label, round(sum(p), 6) + 0.0 AS p FROM r GROUP BY ALL
""")
def belief_fusion(t):
    b, experts, prior = beliefs(t)
    out = B.fuse(prior, b, experts, temperature=2.0, particles=2)
    return out.select("method", F.col("case").alias("case_id"), "label", (F.round("p", 6) + 0.0).alias("p"))
