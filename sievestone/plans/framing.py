"""Framing of every turn of the conversations as if it were a question."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answering as A
from ..operators import framing as Q
from ._base import query


def _sql(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


MARKED = "regexp_replace(translate({c}, chr(1) || chr(2), '  '), '{p}', '\\1' || chr(1) || '\\2' || chr(2) || '\\3', 'g')"
PIECES = "regexp_extract_all({m}, '([^\\x01]*\\x01[^\\x02]*)\\x02', 1)"


def span_sql(name: str, pattern: str, c: str = "text") -> str:
    """A table of the pattern's places in the turns: conv_id, turn, i, surface, char_start, char_end."""
    pieces = PIECES.format(m=MARKED.format(c=c, p=pattern.replace("'", "''")))
    return f"""{name}_p AS (SELECT conv_id, turn, unnest(range(len(ps))) AS i, unnest(ps) AS piece FROM (SELECT conv_id, turn, {pieces} AS ps FROM conversations)),
{name}_e AS (SELECT conv_id, turn, i, split_part(piece, chr(1), 2) AS surface, (sum(length(piece) - 1) OVER (PARTITION BY conv_id, turn ORDER BY i))::BIGINT AS char_end FROM {name}_p),
{name} AS (SELECT *, char_end - length(surface) AS char_start FROM {name}_e)"""


CAPITALISED = span_sql("cap", Q.CAPITALISED)
MENTIONS = f"""{CAPITALISED}, {span_sql("quo", Q.QUOTED)},
runs AS (SELECT * FROM cap WHERE NOT list_contains({_sql(Q.OPENERS)}, lower(surface))),
mentions AS (SELECT conv_id, turn, surface, char_start, char_end FROM runs UNION ALL
  SELECT conv_id, turn, surface, char_start, char_end FROM quo q WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.conv_id = q.conv_id AND r.turn = q.turn AND r.char_start <= q.char_start AND q.char_end <= r.char_end))"""


@query(f"""
SELECT conv_id, turn, array_to_string(list_filter({_sql(Q.RELATION_CUES)}, lambda x: CASE x
{" ".join(f"WHEN '{k}' THEN " + " OR ".join(f"contains(lower(text), '{c}')" for c in v) for k, v in Q.RELATION_CUES.items())} END), ',') AS relations FROM conversations
""")
def relation_cue_tags(t):
    return t("conversations").select("conv_id", "turn", F.array_join(Q.relation_tags(F.col("text")), ",").alias("relations"))


@query(f"""
WITH s AS (SELECT item_id, CASE {" ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{k}'" for k, p in A.SHAPE_CUES.items())} ELSE 'span' END AS shape FROM benchmark)
SELECT item_id, shape, 'source_support,entity_resolution,' || CASE shape {" ".join(f"WHEN '{k}' THEN '{','.join(v)}'" for k, v in Q.SHAPE_FACETS.items())} END AS facets FROM s
""")
def facets_for_shape(t):
    shaped = t("benchmark").select("item_id", A.answer_shape(F.col("text")).alias("shape"))
    return shaped.select("item_id", "shape", F.array_join(Q.facets_for_shape(F.col("shape")), ",").alias("facets"))


@query(f"WITH {MENTIONS} SELECT * FROM mentions")
def mention_spans(t):
    out = t("conversations").select("conv_id", "turn", F.explode(Q.mentions(F.col("text"))).alias("m"))
    return out.select("conv_id", "turn", F.col("m.surface").alias("surface"), F.col("m.char_start").cast("long").alias("char_start"), F.col("m.char_end").cast("long").alias("char_end"))


@query(f"""
WITH {MENTIONS}, {span_sql("pro", Q.PRONOUN.replace("(?![", "([^").replace("])()", "]|$)"), "regexp_replace(lower(text), '([^\\p{L}\\p{N}_''-])', '\\1\\1', 'g')")},
n AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, char_start, char_end, surface) AS k, surface FROM mentions),
h AS (SELECT c.conv_id, c.turn, coalesce(max(k), 0) AS known FROM conversations c LEFT JOIN n ON n.conv_id = c.conv_id AND n.turn < c.turn GROUP BY ALL)
SELECT p.conv_id, p.turn, p.i AS ordinal, p.surface AS pronoun, concat_ws(' | ', a.surface, b.surface) AS antecedents, CASE WHEN known = 1 THEN 0.9 ELSE 0.45 END AS confidence
FROM pro p JOIN h USING (conv_id, turn) LEFT JOIN n a ON a.conv_id = p.conv_id AND a.k = known - 1 LEFT JOIN n b ON b.conv_id = p.conv_id AND b.k = known
""")
def pronoun_antecedents(t):
    turns = t("conversations").select("conv_id", "turn", "text", F.transform(Q.mentions(F.col("text")), lambda m: m["surface"]).alias("named"))
    out = Q.bind_pronouns(turns, "conv_id", "turn", F.col("text"), "named")
    return out.withColumn("ordinal", F.col("ordinal").cast("long")).withColumn("antecedents", F.array_join("antecedents", " | "))


@query(f"""
WITH {CAPITALISED}, f AS (SELECT conv_id, turn, surface, min(i) AS i FROM cap WHERE NOT list_contains({_sql(Q.QUESTION_WORDS)}, lower(surface)) GROUP BY ALL),
e AS (SELECT conv_id, turn, string_agg(surface, '|' ORDER BY i) AS entities FROM f GROUP BY ALL),
w AS (SELECT conv_id, turn, text, regexp_extract_all(text, '([\\p{{L}}\\p{{N}}_''-]+)', 1) AS ws FROM conversations),
l AS (SELECT *, list_transform(ws, lambda x: lower(x)) AS low FROM w)
SELECT conv_id, turn, CASE WHEN list_has_any(low, ['compare', 'difference', 'versus']) THEN 'compare' {" ".join(f"WHEN low[1] = '{k}' THEN '{v}'" for k, v in Q.GOALS.items())} ELSE 'verify' END AS goal,
  CASE WHEN list_contains({_sql(Q.QUESTION_WORDS)}, low[1]) THEN low[1] ELSE 'verification' END AS information_type, coalesce(entities, '') AS entities,
  array_to_string(list_filter(low, lambda x: list_contains({_sql(Q.PRONOUNS)}, x)), '|') AS unresolved,
  array_to_string(regexp_extract_all(text, '\\b(1[5-9][0-9]{{2}}|20[0-9]{{2}}|2100)\\b', 1), '|') AS years,
  CASE WHEN entities IS NULL THEN 'source_support' ELSE 'source_support|entity_resolution' END AS facets,
  array_to_string(list_filter(ws, lambda x: length(x) > 2 AND NOT list_contains({_sql(Q.EMPTY_WORDS)}, lower(x))), '|') AS unknown
FROM l LEFT JOIN e USING (conv_id, turn)
""")
def question_interpretation(t):
    parts = Q.interpretation(F.col("text"))
    lists = ("entities", "unresolved", "years", "facets", "unknown")
    return t("conversations").select("conv_id", "turn", *((F.array_join(c, "|") if k in lists else c).alias(k) for k, c in parts.items()))
