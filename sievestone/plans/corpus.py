"""Corpus tables: statistics, splits, chunks, bindings, postings, typed values."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import retrieval as R
from ..operators.evaluation import global_rank
from ._base import query


@query("""
SELECT 'documents' AS tbl, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages
UNION ALL SELECT 'conversations', count(*) FROM conversations UNION ALL SELECT 'benchmark', count(*) FROM benchmark
""")
def corpus_stats(t):
    parts = [t(n).agg(F.count("*").alias("n")).select(F.lit(n).alias("tbl"), "n") for n in ("documents", "pages", "conversations", "benchmark")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("""
WITH g AS (SELECT sha256(text) AS h, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1)
SELECT count(*) AS n_groups, coalesce(sum(n), 0)::BIGINT AS n_documents, coalesce(max(n), 0) AS largest FROM g
""")
def duplicate_text_groups(t):
    g = t("documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.count("*").alias("n")).where("n > 1")
    return g.agg(F.count("*").alias("n_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_documents"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))


@query("""
SELECT doc_id, CASE WHEN b < 80 THEN 'fit' WHEN b < 90 THEN 'calibration' ELSE 'selection' END AS split
FROM (SELECT doc_id, ('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT % 100 AS b FROM documents)
""")
def hash_split_80_10_10(t):
    b = T.hash_bucket(F.col("doc_id"), 100)
    return t("documents").select("doc_id", F.when(b < 80, "fit").when(b < 90, "calibration").otherwise("selection").alias("split"))


@query("""
SELECT item_id, CASE WHEN b < 20 THEN 'tuning' WHEN b < 35 THEN 'development' WHEN b < 80 THEN 'evaluation' ELSE 'final_held' END AS part
FROM (SELECT item_id, ('0x' || substr(sha256(item_id::VARCHAR), 1, 8))::BIGINT % 100 AS b FROM benchmark)
""")
def case_partition(t):
    b = T.hash_bucket(F.col("item_id"), 100)
    return t("benchmark").select("item_id", F.when(b < 20, "tuning").when(b < 35, "development").when(b < 80, "evaluation").otherwise("final_held").alias("part"))


@query("""
SELECT doc_id, CASE WHEN r <= 100 THEN 'tuning' WHEN r <= 350 THEN 'evaluation' WHEN r <= 500 THEN 'held' ELSE 'unassigned' END AS part
FROM (SELECT doc_id, row_number() OVER (ORDER BY sha256(doc_id::VARCHAR), doc_id) AS r FROM documents)
""")
def partition_plan_sha(t):
    """Every document's place in a plan of 100, 250 and 150 ids in order of their hash, ranked across range partitions."""
    ids = t("documents").select("doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("h"))
    r = F.col("rank")
    return global_rank(ids, [F.col("h"), F.col("doc_id")]).select("doc_id", F.when(r <= 100, "tuning").when(r <= 350, "evaluation").when(r <= 500, "held").otherwise("unassigned").alias("part"))


CHUNKS = """c AS (
  SELECT doc_id, i AS ordinal, doc_id || '#' || i AS chunk_id, 480 * i AS char_start, least(480 * (i + 1), length(text)) AS char_end, substr(text, 480 * i + 1, 480) AS chunk_text
  FROM (SELECT doc_id, text, unnest(range(0, ceil(length(text) / 480.0)::BIGINT)) AS i FROM documents)
)"""


@query(f"WITH {CHUNKS} SELECT doc_id, ordinal, chunk_id, char_start, char_end, substr(sha256(chunk_text), 1, 16) AS digest FROM c")
def chunk_480(t):
    return R.chunk_table(t("documents")).select("doc_id", "ordinal", "chunk_id", "char_start", "char_end", F.substring(F.sha2("chunk_text", 256), 1, 16).alias("digest"))


@query(f"""
WITH {CHUNKS} SELECT chunk_id, substr(d.text, (char_start + 1)::BIGINT, (char_end - char_start)::BIGINT) = chunk_text AS slice_matches,
  sha256(substr(d.text, (char_start + 1)::BIGINT, (char_end - char_start)::BIGINT)) = sha256(chunk_text) AS span_hash_matches,
  strlen(substr(d.text, (char_start + 1)::BIGINT, (char_end - char_start)::BIGINT)) = strlen(chunk_text) AS byte_length_matches
FROM c JOIN documents d USING (doc_id)
""")
def span_binding_check(t):
    return R.binding_checks(R.chunk_table(t("documents")), t("documents"))


@query("""
SELECT term, count(*) AS df, min(doc_id) AS first_id, max(doc_id) AS last_id, sum(tf)::BIGINT AS occurrences
FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY ALL) GROUP BY term
""")
def lexical_postings(t):
    tf = R.term_counts(t("documents"), "doc_id", "text")
    return tf.groupBy("term").agg(F.count("*").alias("df"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.sum("tf").alias("occurrences"))


@query("""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
b AS (SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM d WHERE len(w) > 1)
SELECT term, doc_id, count(*) AS tf FROM b GROUP BY ALL
""")
def bigram_postings(t):
    """A row a posting, so that no bigram's documents gather in one row."""
    return R.gram_counts(t("documents"), "doc_id", "text", 2)


@query("""
SELECT term, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}]{4,}')) AS term FROM documents)
GROUP BY term HAVING count(*) >= 3 ORDER BY freq DESC, term LIMIT 120000
""")
def vocabulary_topk(t):
    words = t("documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}]{4,})"), 1)).alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("freq")).where("freq >= 3").orderBy(F.desc("freq"), "term").limit(120_000)


@query("""
SELECT doc_id, len(regexp_extract_all(text, '[^.!?]+[.!?]+')) AS n_sentences, trim(coalesce(regexp_extract_all(text, '[^.!?]+[.!?]+')[1], '')) AS summary FROM documents
""")
def sentence_summaries(t):
    s = F.col("s")
    return t("documents").select("doc_id", T.sentences(F.col("text")).alias("s")).select("doc_id", F.size(s).cast("long").alias("n_sentences"), F.coalesce(F.get(s, 0), F.lit("")).alias("summary"))


@query("""
SELECT item_id, 'question:' || substr(sha256('q' || chr(31) || text), 1, 24) AS stable_id,
  substr(sha256(array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))), ' ')), 1, 16) AS semantic_key FROM benchmark
""")
def stable_ids(t):
    return t("benchmark").select("item_id", T.stable_id("question", F.lit("q"), F.col("text")).alias("stable_id"), T.semantic_key(T.simple_tokens(F.col("text"))).alias("semantic_key"))


@query("""
SELECT doc_id, len(y)::BIGINT AS n_years, coalesce(y[1], '') AS first_year, len(n)::BIGINT AS n_numbers, coalesce(list_max(list_transform(n, lambda x: length(x))), 0) AS longest
FROM (SELECT doc_id, regexp_extract_all(text, '\\b(1[0-9]{3}|20[0-9]{2})\\b') AS y, regexp_extract_all(text, '[0-9]+(?:,[0-9]{3})*(?:\\.[0-9]+)?') AS n FROM documents)
""")
def value_extraction(t):
    d = t("documents").select("doc_id", T.years(F.col("text")).alias("y"), T.numbers(F.col("text")).alias("n"))
    return d.select("doc_id", F.size("y").cast("long").alias("n_years"), F.coalesce(F.get("y", 0), F.lit("")).alias("first_year"), F.size("n").cast("long").alias("n_numbers"), F.coalesce(F.array_max(F.transform("n", F.length)), F.lit(0)).cast("long").alias("longest"))


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN regexp_matches(v, '^[0-9]{4}(-[0-9]{2}){0,2}$') THEN 'date' WHEN regexp_matches(v, '^[+-]?[0-9][0-9,]*(\\.[0-9]+)?( ?[A-Za-z%]+)?$') THEN 'quantity' ELSE 'text' END AS kind
FROM (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN strftime(l_shipdate, '%Y-%m-%d') WHEN 1 THEN l_partkey::VARCHAR WHEN 2 THEN l_suppkey || ' kg' ELSE l_returnflag END AS v FROM lineitem)
""")
def value_kinds(t):
    m = F.col("l_linenumber") % 4
    v = F.when(m == 0, F.date_format("l_shipdate", "yyyy-MM-dd")).when(m == 1, F.col("l_partkey").cast("string")).when(m == 2, F.concat(F.col("l_suppkey").cast("string"), F.lit(" kg"))).otherwise(F.col("l_returnflag"))
    return t("lineitem").select("l_orderkey", "l_linenumber", T.value_kind(v).alias("kind"))


@query("""
SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<p>'))::BIGINT AS n_paragraphs,
  length(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&nbsp;', ' ', 'g'), '&amp;', '&', 'g'), '\\s+', ' ', 'g'))) AS plain_chars FROM pages
""")
def page_plain_text(t):
    """Titles and text of pages; the fixture has no wiki markup, so the tag rules alone decide."""
    h = F.regexp_replace("html", r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " ")
    h = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(h, "<[^>]*>", " "), "&nbsp;", " "), "&amp;", "&"), r"\s+", " ")
    return t("pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit("(<p>)"), 1)).cast("long").alias("n_paragraphs"), F.length(F.trim(h)).cast("long").alias("plain_chars"))


@query("""
SELECT p_partkey, len(g)::BIGINT AS n_grams, g[1] AS first_gram, g[-1] AS last_gram FROM (
  SELECT p_partkey, list_sort(list_distinct(list_transform(range(1, length(f) - 1), lambda i: substr(f, i, 3)))) AS g FROM (SELECT p_partkey, '^' || p_name || '$' AS f FROM part))
""")
def framed_trigrams(t):
    g = t("part").select("p_partkey", T.gram_set(F.col("p_name")).alias("g"))
    return g.select("p_partkey", F.size("g").cast("long").alias("n_grams"), F.element_at("g", 1).alias("first_gram"), F.element_at("g", -1).alias("last_gram"))


@query(f"""
WITH {CHUNKS}, h AS (SELECT *, regexp_extract(chunk_text, '[0-9]{{4,}}', 0) AS v FROM c)
SELECT doc_id, chunk_id, v AS value FROM h WHERE v <> '' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) = 1
""")
def first_typed_match(t):
    c = R.chunk_table(t("documents")).withColumn("value", F.regexp_extract("chunk_text", "[0-9]{4,}", 0)).where("value <> ''")
    return R.top_k(c, "doc_id", [F.col("ordinal")], 1).select("doc_id", "chunk_id", "value")


@query("""
SELECT doc_id, batch, pos FROM (SELECT doc_id, source, (r - 1) // 8 AS batch, (r - 1) % 8 AS pos, count(*) OVER (PARTITION BY source, (r - 1) // 8) AS n
  FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents)) WHERE n = 8
""")
def fixed_batches(t):
    """Groups of eight per source, an incomplete tail dropped. A source's count comes from an aggregate, not from a second window."""
    r = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    d = t("documents").select("doc_id", "source", r.alias("r"))
    n = t("documents").groupBy("source").agg(F.count("*").alias("n"))
    return d.join(n, "source").where(F.floor((F.col("r") - 1) / 8) < F.floor(F.col("n") / 8)).select("doc_id", F.floor((F.col("r") - 1) / 8).alias("batch"), ((F.col("r") - 1) % 8).cast("long").alias("pos"))


@query("""
SELECT source, lang, count(*) AS n_docs, sum(n_chars)::BIGINT AS chars, min(substr(sha256(array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))), ' ')), 1, 16)) AS least_key, count(*) BETWEEN 2 AND 100000 AS hybrid
FROM documents GROUP BY ALL
""")
def category_cells(t):
    d = t("documents").select("source", "lang", "n_chars", T.semantic_key(T.simple_tokens(F.col("text"))).alias("k"))
    return d.groupBy("source", "lang").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("chars"), F.min("k").alias("least_key"), F.count("*").between(2, 100000).alias("hybrid"))


@query("""
WITH o AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL)
SELECT count(*) AS n_cells, round(avg(n), 6) AS mean_size, max(n) AS max_size, round(sum(n) / (SELECT count(*) FROM documents), 6) AS overlap_factor FROM o
""")
def topology_metrics(t):
    cells = t("documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    total = t("documents").count()
    return cells.agg(F.count("*").alias("n_cells"), F.round(F.avg("n"), 6).alias("mean_size"), F.max("n").alias("max_size"), F.round(F.sum("n") / F.lit(float(total)), 6).alias("overlap_factor"))
