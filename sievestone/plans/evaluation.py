"""Measures over labels, events and orders: calibration, marginals, percentiles, routes, samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluation as E
from ._base import query

CASES = "x AS (SELECT l.doc_id, d.lang, d.source, l.quality, l.toxic, least(1.0, d.n_chars / 8000.0) AS score, (l.quality = 1 AND l.toxic = 0) AS correct FROM labels l JOIN documents d USING (doc_id))"


def cases(t):
    """Labelled documents with a score from their length and an outcome."""
    d = t("documents").select("doc_id", "lang", "source", F.least(F.lit(1.0), F.col("n_chars") / 8000.0).alias("score"))
    return t("labels").join(d, "doc_id").withColumn("correct", (F.col("quality") == 1) & (F.col("toxic") == 0))


def rounded(name: str, places: int = 6):
    """A column of doubles as the SQL rounds them: scaled, rounded to a whole number, scaled back.

    F.round goes by a double's decimal digits instead and differs where those end in a 5 just
    past the last place: 41 / 640 is 0.0640625, but its double times a million is below 64062.5.
    """
    scale = F.lit(10.0**places)
    return (F.round(F.col(name) * scale) / scale).alias(name)


@query(f"""WITH {CASES} SELECT least(9, floor(score * 10))::BIGINT AS bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(correct::INT), 6) AS accuracy FROM x GROUP BY 1""")
def ece_bins(t):
    return E.ece_bins(cases(t), "score", "correct").select("bin", "n", F.round("mean_score", 6).alias("mean_score"), F.round("accuracy", 6).alias("accuracy"))


@query(f"""WITH {CASES}, b AS (SELECT least(9, floor(score * 10)) AS bin, count(*) AS n, abs(avg(score) - avg(correct::INT)) AS gap FROM x GROUP BY 1)
SELECT round(sum(n * gap) / sum(n), 6) AS ece, (SELECT round(avg((score - correct::INT) ** 2), 6) FROM x) AS brier, (SELECT round(-avg(ln(greatest(1e-6, CASE WHEN correct THEN score ELSE 1 - score END))), 6) FROM x) AS nll FROM b""")
def calibration_summary(t):
    x = cases(t)
    b = E.ece_bins(x, "score", "correct").agg(F.round(F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("accuracy"))) / F.sum("n"), 6).alias("ece"))
    hit = F.when(F.col("correct"), F.col("score")).otherwise(1 - F.col("score"))
    rest = x.agg(F.round(F.avg(F.pow(F.col("score") - F.col("correct").cast("int"), F.lit(2))), 6).alias("brier"), F.round(-F.avg(F.log(F.greatest(F.lit(1e-6), hit))), 6).alias("nll"))
    return b.join(rest)


@query(f"""WITH {CASES} SELECT doc_id, row_number() OVER o AS rank, round(avg(correct::INT) OVER (o ROWS UNBOUNDED PRECEDING), 6) AS accuracy FROM x WINDOW o AS (ORDER BY score DESC, doc_id)""")
def risk_coverage(t):
    return E.risk_coverage(cases(t), "score", "doc_id", "correct").select("doc_id", F.col("rank").cast("long").alias("rank"), F.round("accuracy", 6).alias("accuracy"))


@query(f"""WITH {CASES}, h AS (SELECT unnest([0.05, 0.1, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS threshold)
SELECT threshold, count(*) FILTER (score >= threshold) AS retained, round(count(*) FILTER (score >= threshold) / count(*), 6) AS coverage, round(coalesce(avg(correct::INT) FILTER (score >= threshold), 0), 6) AS accuracy FROM x, h GROUP BY threshold""")
def risk_at_thresholds(t):
    x = cases(t).withColumn("threshold", F.explode(F.array(*map(F.lit, (0.05, 0.1, 0.25, 0.5, 0.75, 1.0)))))
    kept = F.when(F.col("score") >= F.col("threshold"), F.col("correct").cast("int"))
    return x.groupBy("threshold").agg(F.count(kept).alias("retained"), F.round(F.count(kept) / F.count("*"), 6).alias("coverage"), F.round(F.coalesce(F.avg(kept), F.lit(0.0)), 6).alias("accuracy"))


@query(f"""WITH {CASES}, r AS (SELECT *, ceil(row_number() OVER (ORDER BY score, doc_id) * 10.0 / (SELECT count(*) FROM x))::BIGINT - 1 AS bin FROM x)
SELECT bin, count(*) AS n, round(max(score), 6) AS upper, round(avg(correct::INT), 6) AS accuracy FROM r GROUP BY bin""")
def equal_freq_bins(t):
    return E.equal_frequency_bins(cases(t), "score", "doc_id", "correct").select("bin", "n", rounded("upper"), rounded("accuracy"))


@query()
def isotonic_calibration(t):
    """Pool adjacent violators over the ten equal-frequency bins (iterative: no SQL form)."""
    return E.isotonic(E.equal_frequency_bins(cases(t), "score", "doc_id", "correct"), "bin", "accuracy", "n")


@query(f"""WITH {CASES}, c AS (SELECT *, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'poor' ELSE 'good' END AS class FROM x)
SELECT coalesce(lang, '*') AS lang, coalesce(source, '*') AS source, class, count(*) AS n FROM c GROUP BY GROUPING SETS ((class), (lang, class), (source, class))""")
def failure_marginals(t):
    c = cases(t).withColumn("class", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").otherwise("good"))
    out = c.groupingSets([["class"], ["lang", "class"], ["source", "class"]], "lang", "source", "class").agg(F.count("*").alias("n"))
    return out.select(F.coalesce("lang", F.lit("*")).alias("lang"), F.coalesce("source", F.lit("*")).alias("source"), "class", "n")


@query(f"""WITH {CASES}, p AS (SELECT lang, quality AS gold, (score > 0.1)::INT AS pred FROM x)
SELECT lang, gold, pred, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY lang, gold), 6) AS recall, round(count(*) / sum(count(*)) OVER (PARTITION BY lang, pred), 6) AS precision FROM p GROUP BY lang, gold, pred""")
def confusion_matrix(t):
    n = cases(t).groupBy("lang", F.col("quality").alias("gold"), (F.col("score") > 0.1).cast("int").alias("pred")).agg(F.count("*").alias("n"))
    return n.select("lang", "gold", "pred", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("lang", "gold")), 6).alias("recall"), F.round(F.col("n") / F.sum("n").over(Window.partitionBy("lang", "pred")), 6).alias("precision"))


@query(f"""WITH {CASES} SELECT lang, round(avg(correct::INT), 6) AS accuracy, round(avg((score >= 0.1)::INT), 6) AS activation, round(sum((correct AND score >= 0.1)::INT) / nullif(sum((score >= 0.1)::INT), 0), 6) AS precision_,
  round(sum((correct AND score >= 0.1)::INT) / nullif(sum(correct::INT), 0), 6) AS recall_, quantile_disc(score, 0.5) AS p50, quantile_disc(score, 0.95) AS p95 FROM x GROUP BY lang""")
def ablation_matrix(t):
    on, ok = F.col("score") >= 0.1, F.col("correct")
    num = lambda c: c.cast("int")
    disc = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY score)")
    return cases(t).groupBy("lang").agg(
        F.round(F.avg(num(ok)), 6).alias("accuracy"), F.round(F.avg(num(on)), 6).alias("activation"), F.round(F.sum(num(ok & on)) / F.nullif(F.sum(num(on)), F.lit(0)), 6).alias("precision_"),
        F.round(F.sum(num(ok & on)) / F.nullif(F.sum(num(ok)), F.lit(0)), 6).alias("recall_"), disc(0.5).alias("p50"), disc(0.95).alias("p95"),
    )


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, quantile_disc(value, 0.95) AS nearest_rank, round(quantile_cont(value, 0.95), 6) AS interpolated, max(value) FILTER (r = 1 + round_even((n - 1) * 0.95, 0)::BIGINT) AS rounded_index FROM r GROUP BY event_type""")
def percentile_trio(t):
    """Three definitions that must not be confused: nearest rank, linear interpolation, rounded index."""
    e = t("events").select("event_type", "value", "event_id").where("value IS NOT NULL")
    out = E.percentiles(e, "event_type", "value", "event_id", 0.95)
    return out.select("event_type", "nearest_rank", F.round("interpolated", 6).alias("interpolated"), "rounded_index")


@query("""WITH m AS (SELECT min(value) AS lo, max(value) AS hi FROM events)
SELECT CASE WHEN hi = lo THEN 0 ELSE least(19, floor((value - lo) / (hi - lo) * 20)) END::BIGINT AS bin, count(*) AS n FROM events, m GROUP BY 1""")
def histogram_equal_width(t):
    lo, hi = t("events").agg(F.min("value"), F.max("value")).first()
    b = F.lit(0) if hi == lo else F.least(F.lit(19), F.floor((F.col("value") - F.lit(lo)) / F.lit((hi or 0) - (lo or 0)) * 20))
    return t("events").groupBy(b.cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean_value, quantile_disc(value, 0.95) AS p95, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY user_id),
t AS (SELECT user_id, max(a) - min(a) AS spread FROM (SELECT user_id, event_type, round(avg(value), 6) AS a FROM events GROUP BY ALL) GROUP BY user_id) SELECT r.*, round(spread, 6) AS spread FROM r JOIN t USING (user_id)""")
def route_analysis(t):
    e = t("events")
    r = e.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"), F.count(F.when(F.col("event_type") == "error", 1)).alias("errors"))
    a = e.groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 6).alias("a")).groupBy("user_id").agg(F.round(F.max("a") - F.min("a"), 6).alias("spread"))
    return r.join(a, "user_id")


@query("""WITH s AS (SELECT DISTINCT user_id, date_trunc('day', ts) AS day, event_type FROM events)
SELECT a.event_type AS first_type, b.event_type AS second_type, count(*) AS n FROM s a JOIN s b ON a.user_id = b.user_id AND a.day = b.day AND a.event_type <= b.event_type GROUP BY ALL""")
def coactivation(t):
    """Pairs of types on one user's day; a day's types are first cut to a set, so its pairs are bounded by the number of types."""
    s = t("events").groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(F.array_sort(F.collect_set("event_type")).alias("types"))
    x = s.select(F.posexplode("types").alias("i", "first_type"), "types").select("first_type", F.explode(F.expr("slice(types, i + 1, size(types))")).alias("second_type"))
    return x.groupBy("first_type", "second_type").agg(F.count("*").alias("n"))


@query("""SELECT event_id, user_id, (event_type = 'error' OR value < 2 OR row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 OR ('0x' || substr(sha256(event_id::VARCHAR), 1, 8))::BIGINT < 429496730) AS sampled FROM events""")
def sampling_decision(t):
    """Failure, uncertainty, novelty or a tenth by hash."""
    e = t("events")
    novel = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")) == 1
    h = F.conv(F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 8), 16, 10).cast("long")
    return e.select("event_id", "user_id", ((F.col("event_type") == "error") | (F.col("value") < 2) | novel | (h < 429496730)).alias("sampled"))


@query("""SELECT user_id, max_by(event_id, (ts, event_id)) AS last_event, max_by(event_type, (ts, event_id)) AS last_type, min_by(event_id, (ts, event_id)) AS first_event FROM events GROUP BY user_id""")
def latest_per_key(t):
    by = F.struct("ts", "event_id")
    return t("events").groupBy("user_id").agg(F.max_by("event_id", by).alias("last_event"), F.max_by("event_type", by).alias("last_type"), F.min_by("event_id", by).alias("first_event"))


@query("""WITH h AS (SELECT user_id, event_id, row_number() OVER w AS seq, sha256(user_id || ':' || event_id || ':' || event_type) AS entry, lag(sha256(user_id || ':' || event_id || ':' || event_type)) OVER w AS previous FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, count(*) AS entries, bool_and(seq = 1 OR previous IS NOT NULL) AS linked, bool_and(length(entry) = 64) AS well_formed, max(seq) = count(*) AS contiguous, sha256(string_agg(substr(entry, 1, 8), '' ORDER BY seq)) AS chain FROM h GROUP BY user_id""")
def hash_chain_check(t):
    """Per user's journal: contiguous sequence, links and a hash over the chain."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    h = t("events").withColumn("entry", F.sha2(F.concat_ws(":", F.col("user_id").cast("string"), F.col("event_id").cast("string"), "event_type"), 256))
    h = h.select("user_id", F.row_number().over(w).alias("seq"), "entry", F.lag("entry").over(w).alias("previous"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.substring("entry", 1, 8).alias("e")))), lambda x: x["e"]), "")
    return h.groupBy("user_id").agg(F.count("*").alias("entries"), F.bool_and((F.col("seq") == 1) | F.col("previous").isNotNull()).alias("linked"), F.bool_and(F.length("entry") == 64).alias("well_formed"), (F.max("seq") == F.count("*")).alias("contiguous"), F.sha2(listed, 256).alias("chain"))


@query("""WITH s AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
k AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM s) SELECT user_id, session::BIGINT AS session, count(*) AS n, round(sum(value), 6) AS total FROM k GROUP BY ALL""")
def sessionisation(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    s = t("events").withColumn("before", F.lag("ts").over(w)).withColumn("fresh", F.when(F.col("before").isNull() | (F.col("ts") > F.col("before") + F.expr("INTERVAL 6 HOURS")), 1).otherwise(0))
    return s.withColumn("session", F.sum("fresh").over(w)).groupBy("user_id", "session").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("""WITH a AS (SELECT event_type, count(*) AS n, avg(value) AS m FROM events GROUP BY 1), t AS (SELECT event_type, n, m, row_number() OVER (ORDER BY n, event_type) AS tier FROM a)
SELECT event_type, round(m - lag(m, 1, m) OVER (ORDER BY tier), 6) AS delta, round(coalesce((m - lag(m) OVER (ORDER BY tier)) / nullif(log10(n) - log10(lag(n) OVER (ORDER BY tier)), 0), 0), 4) AS per_decade FROM t""")
def scale_erosion(t):
    """Tiers are aggregates, one row per type; the unpartitioned window sees only those."""
    a = t("events").groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("m"))
    w = Window.orderBy("n", "event_type")
    step = F.nullif(F.log10("n") - F.log10(F.lag("n").over(w)), F.lit(0.0))
    return a.select("event_type", F.round(F.col("m") - F.coalesce(F.lag("m").over(w), F.col("m")), 6).alias("delta"), F.round(F.coalesce((F.col("m") - F.lag("m").over(w)) / step, F.lit(0.0)), 4).alias("per_decade"))


@query("""SELECT e.event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k_sum, count(DISTINCT json_extract_string(props, '$.k')) AS k_distinct FROM events e GROUP BY 1""")
def json_access(t):
    k = F.get_json_object("props", "$.k")
    return t("events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k.cast("long")).alias("k_sum"), F.countDistinct(k).alias("k_distinct"))


@query("""WITH a AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1), b AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN b.n IS NULL THEN 'removed' WHEN a.n IS NULL THEN 'added' WHEN a.n <> b.n THEN 'changed' ELSE 'same' END AS change, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta FROM a FULL JOIN b ON a.user_id = b.user_id""")
def matched_delta(t):
    """Full outer comparison of two keyed tables: added, removed, changed."""
    e = t("events")
    a = e.where("event_type = 'click'").groupBy("user_id").agg(F.count("*").alias("a"))
    b = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.count("*").alias("b"))
    j = a.join(b, "user_id", "full")
    change = F.when(F.col("b").isNull(), "removed").when(F.col("a").isNull(), "added").when(F.col("a") != F.col("b"), "changed").otherwise("same")
    return j.select("user_id", change.alias("change"), (F.coalesce("b", F.lit(0)) - F.coalesce("a", F.lit(0))).alias("delta"))


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(t):
    return t("lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz")).groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey = 1 GROUP BY n_name""")
def regional_revenue(t):
    """Dimensions first, so that the small sides cut the large ones before they are shuffled."""
    c = t("customer").join(t("nation").join(t("region").where("r_regionkey = 1"), F.col("n_regionkey") == F.col("r_regionkey")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    o = t("orders").select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey"))
    return t("lineitem").select("l_orderkey", "l_extendedprice", "l_discount").join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.countDistinct("o_orderkey").alias("orders"))
