"""Models fitted on the embeddings: clusters, codebooks, axes, classifiers, temperatures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import learning as L
from ._base import query

CLUSTERS, PARTS, CENTROIDS = 6, 8, 16


@query()
def farthest_first_clusters(t):
    """Every vector's cluster; brute force holds it in the tests."""
    e = t("embeddings")
    return L.assign(e, L.k_means(e, L.farthest_first(e, CLUSTERS), 20))


@query()
def product_quantizer_fit(t):
    """Codebooks by passes over all vectors: part, centroid, values."""
    e = t("embeddings")
    books = L.fit_product_quantizer(e, PARTS, CENTROIDS)
    rows = [(p, c, [round(float(v), 6) for v in books[p][c]]) for p in range(len(books)) for c in range(len(books[p]))]
    return e.sparkSession.createDataFrame(rows, "part long, centroid long, centre array<double>").select("part", "centroid", F.array_join(F.transform("centre", lambda x: x.cast("string")), ",").alias("centre"))


@query()
def product_quantizer_search(t):
    """The eight nearest by asymmetric distances, for every vector whose id is divisible by 100."""
    e = t("embeddings")
    out = L.asymmetric_distances(e, e.where("vec_id % 100 = 0"), L.fit_product_quantizer(e, PARTS, CENTROIDS))
    return out.withColumn("rank", F.col("rank").cast("long"))


@query()
def principal_axes(t):
    """Share of the variance that each of four axes explains, and the axis."""
    fit = L.principal_axes(t("embeddings"), 4)
    rows = [(i, round(float(fit["eigenvalues"][i]), 6), round(float(fit["explained"][i]), 6)) for i in range(len(fit["axes"]))]
    return t("embeddings").sparkSession.createDataFrame(rows, "axis long, eigenvalue double, explained double")


@query()
def reduced_codes(t):
    """Every vector on eight principal axes, in eight bits each."""
    codes, _ = L.reduced_int8(t("embeddings"), 8)
    return codes.select("vec_id", F.array_join(F.transform("codes", lambda x: x.cast("string")), ",").alias("codes"))


@query()
def softmax_classifier(t):
    """Labels told from vectors by a multinomial logistic model; the fit sees all labelled rows. A class is a label that a vector has."""
    e = t("embeddings")
    labels = sorted(r["label"] for r in e.where("embedding IS NOT NULL AND label IS NOT NULL").select("label").distinct().collect())
    known = F.array(*map(F.lit, labels)).cast("array<long>")
    placed = e.where("label IS NOT NULL").withColumn("label", F.array_position(known, F.col("label").cast("long")) - 1)
    out = L.predict(e, L.fit_softmax(placed, "embedding", "label", len(labels), iterations=40), "vec_id", "embedding")
    out = out.withColumn("predicted", F.get(known, F.col("predicted").cast("int")))
    return out.join(e.select("vec_id", "label"), "vec_id").select("vec_id", "predicted", F.round("confidence", 6).alias("confidence"), (F.col("predicted") == F.col("label")).alias("correct"))


@query("""
WITH e AS (SELECT label, embedding::DOUBLE[] AS z FROM embeddings WHERE label IS NOT NULL), g AS (SELECT * FROM e, (VALUES (0.5), (0.75), (1.0), (1.5), (2.0)) t(temperature)),
l AS (SELECT temperature::DOUBLE AS temperature, round(avg(ln(list_sum(list_transform(z, lambda x: exp(x / temperature::DOUBLE)))) - z[label + 1] / temperature::DOUBLE), 6) AS loss FROM g GROUP BY 1)
SELECT temperature, loss, temperature = (SELECT arg_min(temperature, (loss, temperature)) FROM l) AS chosen FROM l
""")
def temperature_selection(t):
    """The temperature of least loss, each vector's values read as the logits of classes."""
    e = t("embeddings").where("label IS NOT NULL").select(F.col("embedding").cast("array<double>").alias("z"), "label")
    return L.select_temperature(e, "z", "label")
