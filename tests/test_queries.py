from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sievestone.plans.registry import ORACLES, QUERIES

from .duck import same


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert len(set(df.columns)) == len(df.columns)
    if name in ORACLES:
        same(df, ORACLES[name], sf_dir)
    else:
        assert df.count() > 0


def test_entry_works_without_the_corpus_operators(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_equal_freq_bins_round_as_the_sql(spark, tmp_path):
    """Bins of 640 rows, where 41, 323 and 333 right ones make shares that end in a 5 past the sixth decimal."""
    i = F.col("id")
    right = F.element_at(F.array(*map(F.lit, (41, 323, 333))), (F.floor(i / 640) % 3 + 1).cast("int"))
    d = spark.range(6400)
    d.select(i.alias("doc_id"), F.lit("en").alias("lang"), F.lit("web").alias("source"), i.alias("n_chars")).write.parquet(f"{tmp_path}/documents.parquet")
    d.select(i.alias("doc_id"), (i % 640 < right).cast("int").alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    same(QUERIES["equal_freq_bins"](spark, str(tmp_path)), ORACLES["equal_freq_bins"], str(tmp_path))
