"""Claims of wiki pages against hand-made cases and plain loops."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from sievestone.operators import extraction as X

BOX = "Intro {{note|x}}\n{{ Infobox town\n| Name = Oslo\n| founded = 1040\n| population_total = 700,000\n| image_map = a.svg\n| mayor = [[Ada Lie|Ada]]\n| area = {{convert|454|km2}}\n| motto = \"Unanimiter et constanter\"\n| birth place = Here\n| none = N/A\n| ref = <ref name=a/>\n| blank =\n}}\n| late = 1\n"
TEXT = "'''Oslo''' is the capital. More here.\nBergen was a town of old.\nThe fair began in 1987 with 30 people.\nOn 5 May 1999 and June 2001 it rained 12.5 mm; 3 km; 4 kg; 5 days.\nHe said \"so it goes on\" and “who knows it”. 2100 3000 1555.\n"


def pages(spark):
    rows = [(1, "Oslo", BOX + TEXT), (2, "Open", "{{Infobox x\n| a = b\n"), (3, "Moved", "#REDIRECT [[Oslo]] is was."), (4, "Empty", ""), (5, "Null", None), (6, "Many", "{{Infobox x\n" + "".join(f"| f{i} = v{i}\n" for i in range(50)) + "}}")]
    return spark.createDataFrame(rows, "id long, title string, text string")


def test_infobox(spark):
    f = X.infobox_fields(pages(spark), "id", "text").withColumn("kind", X.field_kind(F.col("field"), F.col("value"))).withColumn("shown", X.visible(F.col("value"))).collect()
    got = [(r["field"], r["shown"], r["kind"]) for r in sorted(f, key=lambda r: r["ordinal"]) if r["id"] == 1]
    assert got == [
        ("name", "Oslo", "text"), ("founded", "1040", "date"), ("population total", "700,000", "quantity"), ("mayor", "Ada", "entity"), ("area", "{{convert|454|km2}}", "quantity"),
        ("motto", '"Unanimiter et constanter"', "quotation"), ("birth place", "Here", "location"),
    ]
    assert all(BOX[r["char_start"] : r["char_end"]] == r["value"] for r in f if r["id"] == 1)
    assert {r["id"] for r in f} == {1, 6}


def test_sentences(spark):
    whole = BOX + TEXT
    got = [r for r in X.sentence_claims(pages(spark), "id", "text", "title").collect() if r["id"] == 1]
    assert all(whole[r["char_start"] : r["char_end"]] == r["value"] for r in got)
    by = lambda name: [r["value"] for r in sorted(got, key=lambda r: r["ordinal"]) if r["relation"] == name]
    assert by("definition") == ["'''Oslo''' is the capital."]
    assert by("event") == ["The fair began in 1987 with 30 people."]
    assert by("date mentioned") == ["5 May 1999", "June 2001"]
    assert by("year mentioned") == re.findall(rf"(?<!\w){X.YEAR}(?!\w)", whole)[:3]
    assert by("quantity mentioned") == ["30 people", "12.5 mm", "3 km"]
    assert by("quotation") == ["Unanimiter et constanter", "so it goes on"]


def test_page_claims(spark):
    got = X.page_claims(pages(spark), "id", "text", "title").collect()
    assert {r["id"] for r in got} == {1, 6}
    assert [r["value"] for r in sorted(got, key=lambda r: r["place"]) if r["id"] == 6] == [f"v{i}" for i in range(32)]
    assert X.page_claims(pages(spark).limit(0), "id", "text").count() == 0


def test_long_text(spark):
    text = "a 1999 b " * 20000 + "x" * 100000
    df = spark.createDataFrame([(1, text)], "id long, text string")
    assert X.sentence_claims(df, "id", "text").where("relation = 'year mentioned'").count() == 3


def test_context(spark):
    df = spark.createDataFrame([("abcdefghij", 4, 5)], "t string, a int, b int")
    assert df.select(X.context(F.col("t"), F.col("a"), F.col("b"), 2), X.context(F.col("t"), F.col("a"), F.col("b"))).first()[:] == ("cdefg", "abcdefghij")
