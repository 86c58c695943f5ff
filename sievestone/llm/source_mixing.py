"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. The cells' token weights are
raked: round after round, dimension by dimension, they are scaled so that the dimension's
sums meet its targets, until every marginal is met within `tolerance`. A document is then
sampled by a hash of its id, with a probability in proportion to its cell's weight; the
factor is `keep`, or less where a probability would exceed 1, so that the sample's expected
marginals are the targets. Only DataFrame operations.

Cells are summed map-side and written once; tokens are counted once and carried. A few
rounds of window sums form one plan, without joins and broadcasts; up to `small_cells`
cells lie in one partition, so that these plans shuffle nothing. Tables between steps are
deleted as soon as nothing reads them.

Targets of a dimension: a power (0: all categories alike, 1: as they are, in between
tempered), or a dict of shares by category; categories that a dict leaves out divide the
rest by their tokens. The topic is a column, or the text's form where the table has none.

Defined results: a null category is a category of its own; null or empty text has no
tokens and takes its cell's probability, or 0 in a cell without tokens; a null id hashes
as an empty one; rows of one id are kept or dropped alike if their cells' probabilities
agree; targets that contradict each other (some marginal is not met after `most_rounds`)
give the last round's weights, or with `strict` a ValueError that names the residuals; an
empty table gives an empty table; other columns, whatever their names, are carried or
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import discard, materialise

KEEP, SMALL_CELLS, SEED = 0.7, 100_000, "mix-1"
#: Rounds of one plan, all rounds, and the widest relative distance of a marginal from its target.
PLAN_ROUNDS, MOST_ROUNDS, TOLERANCE = 4, 120, 1e-10
WORDS = r"[^\x20\x09-\x0D]+"
#: Production targets: powers of the natural shares.
TARGETS = {"source": 0.5, "lang": 0.7, "topic": 0.8}


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def form_topic(text: Column, n_tokens: Column) -> Column:
    """The topic where the table has none: the text's form."""
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    return (
        F.when(50 * symbols > F.length(text), "symbols").when(n_tokens < 50, "note").when(F.instr(text, "\n") == 0, "passage").when(n_tokens < 500, "article").otherwise("long")
    )


def _category(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def counted(docs: DataFrame, columns: list[Column], text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None) -> DataFrame:
    """The columns, with _tokens and the categories _source, _lang and _topic; the text is scanned once."""
    text = F.coalesce(F.col("_mixed.text"), F.lit(""))
    topic = form_topic(text, F.col("_tokens")) if topic_col is None else F.col("_mixed.topic")
    inner = F.struct(F.col(text_col).cast("string").alias("text"), F.col(source_col).alias("source"), F.col(lang_col).alias("lang"), (F.lit(None) if topic_col is None else F.col(topic_col)).cast("string").alias("topic"))
    rows = docs.select(F.struct(*columns).alias("_own"), inner.alias("_mixed")).withColumn("_tokens", tokens_of(F.col("_mixed.text")))
    return rows.select("_own.*", _category(F.col("_mixed.source")).alias("_source"), _category(F.col("_mixed.lang")).alias("_lang"), _category(topic).alias("_topic"), "_tokens")


def _named(key: str, target: dict[str | None, float]) -> Column:
    if sum(target.values()) > 1 + 1e-9 or min(target.values(), default=0) < 0:
        raise ValueError(f"targets of {key} must not be negative or exceed 1 in sum")
    named = F.lit(None).cast("double")
    for name, share in target.items():
        named = F.when(F.col(key) == ("" if name is None else f"={name}"), F.lit(float(share))).otherwise(named)
    return named


def with_targets(cells: DataFrame, targets: dict[str, float | dict]) -> DataFrame:
    """cells (keys, t) with g_key, each category's target share, and w, the tokens."""
    out = cells.withColumn("t", F.col("t").cast("double"))
    for k in targets:
        out = out.withColumn(f"s_{k}", F.sum("t").over(Window.partitionBy(f"_{k}")))
    # of every category one unit, spread over its cells: sums over cells are sums over categories
    one = {k: F.col("t") / F.col(f"s_{k}") for k in targets}
    sums = []
    for k, target in targets.items():
        if isinstance(target, dict):
            named = _named(f"_{k}", target)
            sums += [F.coalesce(F.sum(named * one[k]), F.lit(0.0)).alias(f"taken_{k}"), F.coalesce(F.sum(F.when(named.isNull(), F.col("t"))), F.lit(0.0)).alias(f"free_{k}")]
        else:
            sums.append(F.sum(F.pow(f"s_{k}", F.lit(float(target))) * one[k]).alias(f"power_{k}"))
    whole = out.agg(*sums).first()
    for k, target in targets.items():
        if not isinstance(target, dict):
            goal = F.pow(f"s_{k}", F.lit(float(target))) / F.lit(whole[f"power_{k}"])
        else:
            taken, free = whole[f"taken_{k}"], whole[f"free_{k}"]
            # where every category is named, the shares of those that exist are scaled to one
            rest = (1 - taken) * F.col(f"s_{k}") / F.lit(free) if free else F.lit(0.0)
            goal = F.coalesce(_named(f"_{k}", target) / F.lit(1.0 if free or not taken else taken), rest)
        out = out.withColumn(f"g_{k}", goal)
    return out.select(*(f"_{k}" for k in targets), "t", *(f"g_{k}" for k in targets), F.col("t").alias("w"))


def residuals(raked: DataFrame, dims: list[str]) -> DataFrame:
    """(dimension, category, target, share, residual) of raked cells; residual: the share's relative distance from its target."""
    total = raked.agg(F.sum("w")).first()[0] or 1.0
    out = None
    for k in dims:
        part = raked.groupBy(F.col(f"_{k}").alias("category")).agg(F.first(f"g_{k}").alias("target"), (F.sum("w") / F.lit(total)).alias("share")).select(F.lit(k).alias("dimension"), "category", "target", "share")
        out = part if out is None else out.union(part)
    return out.withColumn("residual", F.when(F.col("target") > 0, F.abs(F.col("share") / F.col("target") - 1)).otherwise(F.col("share")))


def _round(cells: DataFrame, dims: list[str]) -> DataFrame:
    for k in dims:
        own = F.sum("w").over(Window.partitionBy(f"_{k}"))
        cells = cells.withColumn("w", F.when(own > 0, F.col("w") * F.col(f"g_{k}") / own).otherwise(0.0))
    return cells


def _farthest(dims: list[str]) -> Column:
    """Per cell, the widest relative distance of its categories' sums from their targets."""
    apart = [F.abs(F.sum("w").over(Window.partitionBy(f"_{k}")) - F.col(f"g_{k}")) / F.when(F.col(f"g_{k}") > 0, F.col(f"g_{k}")).otherwise(1.0) for k in dims]
    return F.greatest(*apart) if len(apart) > 1 else apart[0]


def rake(cells: DataFrame, dims: list[str], tolerance: float = TOLERANCE, most_rounds: int = MOST_ROUNDS, strict: bool = False) -> DataFrame:
    """with_targets()'s cells, w raked to shares of all tokens; written in the shared folder."""
    columns, rounds, before = cells.columns, 0, None
    while True:
        for _ in range(PLAN_ROUNDS):
            cells = _round(cells, dims)
        cells = materialise(cells.withColumn("apart", _farthest(dims)), "raked")
        if before is not None:
            discard(before)
        before, rounds = cells, rounds + PLAN_ROUNDS
        apart = cells.agg(F.max("apart")).first()[0]
        if apart is None or apart <= tolerance:
            return cells
        if rounds >= most_rounds:
            if strict:
                worst = residuals(cells, dims).orderBy(F.desc("residual")).limit(10).collect()
                raise ValueError(f"targets not met after {rounds} rounds: " + "; ".join(f"{r.dimension} {r.category}: {r.share:.6g}, not {r.target:.6g}" for r in worst))
            return cells
        # back in one partition where the cells are few
        cells = _together(cells.select(*columns), cells.count())


def _together(cells: DataFrame, n: int, small_cells: int = SMALL_CELLS) -> DataFrame:
    return cells.coalesce(1) if n <= small_cells else cells


def calibrated(rows: DataFrame, targets: dict[str, float | dict], keep: float = KEEP, tolerance: float = TOLERANCE, most_rounds: int = MOST_ROUNDS, small_cells: int = SMALL_CELLS, strict: bool = False) -> DataFrame:
    """Per cell of rows (_dims, _tokens): its tokens t, weight (1: as it is), and the probability that calibrates the sample."""
    dims = list(targets)
    cells = materialise(rows.groupBy(*(f"_{k}" for k in dims)).agg(F.sum("_tokens").alias("t")).where("t > 0"), "cells")
    raked = rake(with_targets(_together(cells, cells.count(), small_cells), targets), dims, tolerance, most_rounds, strict)
    total, most = raked.agg(F.sum("t"), F.max(F.col("w") / F.col("t"))).first()
    factor = min(keep, 1 / (most * total)) if most else 0.0
    weight = F.col("w") * F.lit(float(total or 0)) / F.col("t")
    out = materialise(raked.select(*(f"_{k}" for k in dims), "t", *(f"g_{k}" for k in dims), "w", weight.alias("weight"), F.least(F.lit(1.0), F.lit(float(factor)) * weight).alias("probability")), "calibrated")
    discard(cells, raked)
    return out


def uniform(id_col: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) by the id."""
    h = F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(f"#{seed}")).cast("binary"))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _placed(rows: DataFrame, cells: DataFrame, dims: list[str], small_cells: int) -> DataFrame:
    keys = [f"_{k}" for k in dims]
    cells = cells.select(*keys, "weight", "probability")
    if cells.count() <= small_cells:
        cells = F.broadcast(cells)
    return rows.join(cells, keys, "left").fillna(0.0, ["weight", "probability"])


def sample(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None,
    targets: dict | None = None, keep: float = KEEP, seed: str = SEED, tolerance: float = TOLERANCE, most_rounds: int = MOST_ROUNDS, small_cells: int = SMALL_CELLS, strict: bool = False,
) -> DataFrame:
    """The sampled rows of docs, with their columns. No text is shuffled while cells are few."""
    targets = targets or TARGETS
    own = {c: f"_own{i}" for i, c in enumerate(docs.columns)}
    d = docs.withColumnsRenamed(own)
    rows = counted(d, [F.col(c) for c in d.columns], own[text_col], own[source_col], own[lang_col], topic_col and own[topic_col])
    rows = materialise(rows, "counted")
    out = _placed(rows, calibrated(rows, targets, keep, tolerance, most_rounds, small_cells, strict), list(targets), small_cells)
    out = out.where(uniform(F.col(own[id_col]), seed) < F.col("probability"))
    return out.select(*(F.col(v).alias(k) for k, v in own.items()))


def op10_source_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = materialise(counted(docs, [F.col("doc_id")]), "counted")
    out = _placed(rows, calibrated(rows, TARGETS), list(TARGETS), SMALL_CELLS)
    return out.select(
        "doc_id", F.expr("substring(_topic, 2)").alias("topic"), F.col("_tokens").alias("n_tokens"), F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"),
        (uniform(F.col("doc_id")) < F.col("probability")).alias("kept"),
    )


#: Rounds of the SQL, which has no loop: more than the tables at hand need to come within TOLERANCE.
SQL_ROUNDS = 30


def _sql() -> str:
    ctes = [
        rf"""d AS (SELECT doc_id, coalesce('=' || source, '') AS source, coalesce('=' || lang, '') AS lang, coalesce(text, '') AS x, len(regexp_extract_all(coalesce(text, ''), '{WORDS}')) AS n FROM documents)""",
        r"""k AS (SELECT doc_id, source, lang, n, CASE WHEN 50 * length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) > length(x) THEN 'symbols' WHEN n < 50 THEN 'note'
            WHEN instr(x, chr(10)) = 0 THEN 'passage' WHEN n < 500 THEN 'article' ELSE 'long' END AS topic FROM d)""",
        "c0 AS MATERIALIZED (SELECT source, lang, topic, sum(n)::DOUBLE AS t, sum(n)::DOUBLE AS w FROM k GROUP BY ALL HAVING sum(n) > 0)",
    ]
    for d, power in TARGETS.items():
        ctes.append(f"g_{d} AS MATERIALIZED (SELECT {d}, pow(sum(t), {power}) / sum(pow(sum(t), {power})) OVER () AS g FROM c0 GROUP BY {d})")
    n = 0
    for _ in range(SQL_ROUNDS):
        for d in TARGETS:
            ctes.append(f"c{n + 1} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, c.t, c.w * g.g / sum(c.w) OVER (PARTITION BY c.{d}) AS w FROM c{n} c JOIN g_{d} g USING ({d}))")
            n += 1
    ctes.append(f"f AS (SELECT source, lang, topic, w * (SELECT sum(t) FROM c0) / t AS weight FROM c{n})")
    ctes.append(f"p AS (SELECT *, least(1.0, least({KEEP}, 1 / (SELECT max(weight) FROM f)) * weight) AS probability FROM f)")
    body = ", ".join(ctes)
    return f"""WITH {body}
SELECT doc_id, k.topic AS topic, n AS n_tokens, round(coalesce(weight, 0), 6) AS weight, round(coalesce(probability, 0), 6) AS probability,
       ('0x' || substr(md5(doc_id::VARCHAR || '#{SEED}'), 1, 8))::BIGINT / 4294967296.0 < coalesce(probability, 0) AS kept
FROM k LEFT JOIN p ON k.source = p.source AND k.lang = p.lang AND k.topic = p.topic"""


OP10_SQL = _sql()
