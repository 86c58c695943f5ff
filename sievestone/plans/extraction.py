"""Claims out of pages written from the parts table, and typed mentions of all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extraction as X
from ._base import query


def part_pages(t):
    """A wiki page of every part: an infobox with a nested template, a link, fields without a fact, and a lead."""
    p = t("part")
    price = F.col("p_retailprice").cast("decimal(12,2)").cast("string")
    box = F.concat(
        F.lit("{{Infobox part\n| name = "), "p_name", F.lit("\n| image = a.png\n| Weight = "), F.col("p_size").cast("string"), F.lit(" kg\n| made_by = [[Maker|"), "p_type",
        F.lit("]]\n| note = {{nowrap|"), "p_brand", F.lit("}}\n| price = "), price, F.lit("\n| empty = -\n}}\n| outside = 1\n"),
    )
    lead = F.concat(F.initcap("p_name"), F.lit(" is a part of "), F.col("p_size").cast("string"), F.lit(" kg. It has a name.\nThe "), "p_brand", F.lit(" was launched in 1998 and sold.\n"))
    return p.select("p_partkey", F.initcap("p_name").alias("title"), F.concat(box, lead).alias("text"))


PAGES = """p AS (SELECT p_partkey, p_name, p_type, p_brand, p_size, p_retailprice::DECIMAL(12,2)::VARCHAR AS price FROM part),
h AS (SELECT *, '{{Infobox part\n| name = ' AS h1, p_name || '\n| image = a.png\n| Weight = ' AS h2, p_size || ' kg\n| made_by = ' AS h3, '[[Maker|' || p_type || ']]\n| note = ' AS h4, '{{nowrap|' || p_brand || '}}\n| price = ' AS h5 FROM p),
o AS (SELECT *, length(h1) AS s1, length(h1 || h2) AS s2, length(h1 || h2 || h3) AS s3, length(h1 || h2 || h3 || h4) AS s4, length(h1 || h2 || h3 || h4 || h5) AS s5 FROM h)"""


@query(f"""
WITH {PAGES} SELECT p_partkey, ordinal, field, value, kind, shown, char_start, char_start + length(value) AS char_end FROM (
SELECT p_partkey, 0 AS ordinal, 'name' AS field, p_name AS value, 'text' AS kind, p_name AS shown, s1 AS char_start FROM o UNION ALL
SELECT p_partkey, 1, 'weight', p_size || ' kg', 'quantity', p_size || ' kg', s2 FROM o UNION ALL
SELECT p_partkey, 2, 'made by', '[[Maker|' || p_type || ']]', 'entity', p_type, s3 FROM o UNION ALL
SELECT p_partkey, 3, 'note', '{{{{nowrap|' || p_brand || '}}}}', 'text', '{{{{nowrap|' || p_brand || '}}}}', s4 FROM o UNION ALL
SELECT p_partkey, 4, 'price', price, CASE WHEN regexp_matches(price, '^(1[0-9]{{3}}|20[0-9]{{2}}|2100)$') THEN 'date' ELSE 'text' END, price, s5 FROM o)
""")
def infobox_claims(t):
    f = X.infobox_fields(part_pages(t), "p_partkey", "text")
    return f.withColumn("kind", X.field_kind(F.col("field"), F.col("value"))).withColumn("shown", X.visible(F.col("value")))


@query("""
WITH p AS (SELECT p_partkey, p_size || ' kg' AS w, list_reduce(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), lambda a, b: a || ' ' || b) AS title, p_name, p_type, p_brand, p_retailprice::DECIMAL(12,2)::VARCHAR AS price FROM part),
u AS (SELECT p_partkey, 'infobox name' AS relation, p_name AS value FROM p UNION ALL SELECT p_partkey, 'infobox weight', w FROM p UNION ALL SELECT p_partkey, 'infobox made by', p_type FROM p
  UNION ALL SELECT p_partkey, 'infobox note', '{{nowrap|' || p_brand || '}}' FROM p UNION ALL SELECT p_partkey, 'infobox price', price FROM p UNION ALL SELECT p_partkey, 'definition', title || ' is a part of ' || w || '.' FROM p
  UNION ALL SELECT p_partkey, 'event', 'The ' || p_brand || ' was launched in 1998 and sold.' FROM p UNION ALL SELECT p_partkey, 'year mentioned', '1998' FROM p
  UNION ALL SELECT p_partkey, 'year mentioned', split_part(price, '.', 1) FROM p WHERE regexp_matches(price, '^(1[0-9]{3}|20[0-9]{2}|2100)[.]') UNION ALL SELECT p_partkey, 'quantity mentioned', w FROM p, range(2))
SELECT p_partkey, relation, value, count(*) AS n FROM u GROUP BY ALL
""")
def page_claims(t):
    """Claims of every page; a value stated twice is two claims of different places."""
    return X.page_claims(part_pages(t), "p_partkey", "text", "title").groupBy("p_partkey", "relation", "value").agg(F.count("*").alias("n"))


def first_sql(relation: str) -> str:
    pattern = X.PATTERNS[relation].replace("((?![\\p{L}\\p{N}_]))", "([^\\p{L}\\p{N}_]|$)").replace("'", "''")
    text = "regexp_replace(text, '([^\\p{L}\\p{N}_])', '\\1\\1', 'g')" if "mentioned" in relation else "text"
    return f"SELECT doc_id, '{relation}' AS relation, list_slice(regexp_extract_all({text}, '{pattern}', 2), 1, {X.MENTIONS[relation][1]}) AS vs FROM documents"


@query(f"""
WITH u AS ({first_sql("year mentioned")} UNION ALL {first_sql("quotation")}) SELECT doc_id, relation, unnest(range(len(vs))) AS ordinal, trim(unnest(vs)) AS value FROM u
""")
def typed_mentions(t):
    """The first years and quotations of every whole document."""
    out = X.sentence_claims(t("documents"), "doc_id", "text").where("relation IN ('year mentioned', 'quotation')")
    return out.select("doc_id", "relation", "ordinal", "value")
