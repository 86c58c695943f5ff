"""Choice of evidence among the best chunks of every question."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..operators import selection as S
from ..operators.storage import cut
from ._base import query
from .framing import _sql
from .retrieval import SCORED, scored


def terms_sql(c: str) -> str:
    word = S.WORD.replace("'", "''")
    return f"list_distinct(list_filter(regexp_extract_all(lower({c}), '{word}', 1), lambda x: length(x) > 2 AND NOT list_contains({_sql(S.STOP)}, x)))"


def ratio_sql(a: str, b: str) -> str:
    return f"(len(list_intersect({a}, {b}))::DOUBLE / greatest(len({a}), 1))"


NAMED = S.NAMED.replace("'", "''")
GRAMS = "list_distinct(list_transform(range(1, length('^' || lower({c}) || '$') - 1), lambda i: substr('^' || lower({c}) || '$', i, 3)))"
CANDIDATES = f"""{SCORED}, pool AS (SELECT item_id, chunk_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) - 1 AS position FROM s QUALIFY position < 12),
x0 AS (SELECT item_id, p.chunk_id, c.doc_id, position, CASE WHEN max(score) OVER g = min(score) OVER g THEN 1.0 ELSE (score - min(score) OVER g) / (max(score) OVER g - min(score) OVER g) END AS lexical,
  b.text AS question, c.chunk_text AS body, regexp_extract(d.text, '{S.WORD.replace("'", "''")}', 1) AS title, coalesce(d.source, '') AS section, coalesce(d.lang, '') AS lang
  FROM pool p JOIN benchmark b USING (item_id) JOIN c USING (chunk_id) JOIN documents d ON d.doc_id = c.doc_id WINDOW g AS (PARTITION BY item_id)),
x1 AS (SELECT *, max(CASE WHEN position = 0 THEN lang END) OVER g AS asked, max(CASE WHEN position = 0 THEN section END) OVER g AS home, {terms_sql("question")} AS q, {terms_sql("body")} AS bd, {terms_sql("title")} AS tt, {terms_sql("section")} AS sc,
  {terms_sql(f"array_to_string(regexp_extract_all(question, '{NAMED}', 1), ' ')")} AS en, list_distinct(regexp_extract_all(question, '{S.YEAR}', 1)) AS qy, list_distinct(regexp_extract_all(body, '{S.YEAR}', 1)) AS yb,
  {GRAMS.format(c="question")} AS gq, {GRAMS.format(c="body")} AS gb FROM x0 WINDOW g AS (PARTITION BY item_id)),
f AS (SELECT item_id, chunk_id, doc_id, en, qy, {ratio_sql("q", "bd")} AS f_body, {ratio_sql("q", "tt")} AS f_title,
  contains(' ' || regexp_replace(lower(question), '[^\\p{{L}}\\p{{N}}_''-]+', ' ', 'g') || ' ', ' ' || lower(title) || ' ')::INT::DOUBLE AS f_alias, {ratio_sql("en", "list_concat(bd, tt)")} AS f_entity, {ratio_sql("q", "sc")} AS f_section,
  1.0 / (1 + position) AS f_position, lexical AS f_lexical, CASE WHEN len(qy) = 0 THEN 1.0 ELSE {ratio_sql("qy", "yb")} END AS f_time, (asked = lang)::INT::DOUBLE AS f_category, (home = section)::INT::DOUBLE AS f_link,
  least(1, {ratio_sql("q", "bd")} * CASE WHEN length(body) <= 480 THEN 1.0 ELSE 0.75 END) AS f_direct,
  CASE WHEN list_has_any(q, {_sql(S.ATTRIBUTION)}) THEN (list_has_any(bd, {_sql(S.ATTRIBUTION)}) OR regexp_matches(body, '["“]'))::INT::DOUBLE ELSE 1.0 END AS f_attribution,
  least(1, 0.55 * {ratio_sql("q", "bd")} + 0.25 * {ratio_sql("en", "list_concat(bd, tt)")} + 0.2 * regexp_matches(body, '[.!?]')::INT) AS f_answerable, len(list_intersect(gq, gb)) / sqrt(len(gq) * len(gb)) AS f_trigrams FROM x1),
y0 AS (SELECT *, {" + ".join(f"{w} * f_{n}::DOUBLE" for n, w in zip(S.FEATURES, S.FUSION, strict=True))} AS deterministic, 1 / (1 + exp(-({" + ".join(f"({w} * {S.SCALE!r}::DOUBLE) * f_{n}::DOUBLE" for n, w in zip(S.FEATURES, S.INT8, strict=True))}))) AS reranker FROM f),
y AS (SELECT *, round(0.45 * deterministic + 0.55 * reranker, 6) AS final FROM y0),
z AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY final DESC, chunk_id) AS rank FROM y),
gap0 AS (SELECT item_id, any_value(len(qy)) AS nq, any_value(len(en)) AS ne, max(f_time) AS t, max(f_entity) AS e, max(f_attribution) AS a, arg_min(f_answerable, rank) AS w FROM z WHERE rank <= 8 GROUP BY 1),
gaps AS (SELECT b.item_id, CASE WHEN w IS NULL THEN ['source_support'] ELSE list_filter([CASE WHEN nq > 0 AND t = 0 THEN 'temporal_fit' END, CASE WHEN ne > 0 AND e < 0.5 THEN 'entity_fit' END, CASE WHEN a < 1 THEN 'attribution_fit' END, CASE WHEN w < 0.45 THEN 'answerability' END], lambda x: x IS NOT NULL) END AS missing
  FROM benchmark b LEFT JOIN gap0 USING (item_id))"""


def candidates(t):
    """The twelve best chunks of every question, with features and scores, ranked by the final score."""
    pool = R.top_k(scored(t), "item_id", [F.desc("score"), F.col("chunk_id")], 12).select("item_id", "chunk_id", (F.col("rank") - 1).alias("position"), R.min_max("score", "item_id").alias("lexical"))
    chunks = R.chunk_table(t("documents")).select("chunk_id", "doc_id", F.col("chunk_text").alias("body"))
    found = pool.join(chunks, "chunk_id")
    d = t("documents").select("doc_id", F.regexp_extract("text", S.WORD, 1).alias("title"), F.coalesce("source", F.lit("")).alias("section"), F.coalesce("lang", F.lit("")).alias("lang"))
    rows = found.join(d, "doc_id").join(t("benchmark").select("item_id", F.col("text").alias("question")), "item_id")
    first = rows.where("position = 0").select("item_id", F.col("lang").alias("_asked"), F.col("section").alias("_home"))
    rows = rows.join(first, "item_id").withColumns({
        "aliases": F.array(F.lower("title")), "categories": F.array("lang"), "asked_categories": F.array("_asked"), "link": (F.col("_home") == F.col("section")).cast("double"),
    })
    out = S.scores(cut(S.features(rows).drop("question", "body"))).withColumn("final", F.round("final", 6))
    return R.top_k(out, "item_id", [F.desc("final"), F.col("chunk_id")], 12)


@query(f"WITH {CANDIDATES} SELECT item_id, chunk_id, {', '.join(f'round(f_{n}::DOUBLE, 6) AS {n}_fit' for n in S.FEATURES)} FROM z")
def feature_vectors(t):
    return candidates(t).select("item_id", "chunk_id", *(F.round(f"f.{n}", 6).alias(f"{n}_fit") for n in S.FEATURES))


@query(f"WITH {CANDIDATES} SELECT item_id, chunk_id, rank, round(deterministic, 6) AS deterministic, round(reranker, 6) AS reranker, final FROM z")
def reranked_evidence(t):
    return candidates(t).select("item_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("deterministic", 6).alias("deterministic"), F.round("reranker", 6).alias("reranker"), "final")


@query(f"WITH {CANDIDATES} SELECT item_id, array_to_string(missing, ',') AS missing FROM gaps")
def missing_facets(t):
    questions = t("benchmark").select("item_id", F.col("text").alias("question"))
    return S.missing_facets(candidates(t), questions, "item_id").select("item_id", F.array_join("missing", ",").alias("missing"))


@query(f"""
WITH {CANDIDATES}, gold AS (SELECT item_id, doc_id FROM x0 WHERE position = 0),
h AS (SELECT g.item_id, min(CASE WHEN z.doc_id = g.doc_id THEN rank END) AS hit, max(CASE WHEN rank = 1 THEN final END) AS best FROM gold g JOIN z USING (item_id) GROUP BY 1),
e AS (SELECT hit, best >= 0.6 AND len(missing) = 0 AS answered FROM h JOIN gaps USING (item_id))
SELECT count(*) AS questions, {", ".join(f"round(avg((coalesce(hit, 99) <= {k})::INT), 6) AS recall_{k}" for k in (1, 3, 8))}, round(avg(answered::INT), 6) AS answer_rate, coalesce(round(avg((coalesce(hit, 0) <> 1)::INT) FILTER (answered), 6), 0) AS unsupported_rate FROM e
""")
def selector_evaluation(t):
    """How often the reranked evidence still holds the document that the lexical search puts first."""
    c = cut(candidates(t))
    questions = t("benchmark").select("item_id", F.col("text").alias("question"))
    out = S.evaluation(c, c.where("position = 0").select("item_id", "doc_id"), S.missing_facets(c, questions, "item_id"), "item_id", "doc_id")
    return out.select("questions", *(F.round(x, 6).alias(x) for x in ("recall_1", "recall_3", "recall_8", "answer_rate", "unsupported_rate")))
