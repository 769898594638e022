"""Queries of numbering, references, fingerprints and consistency."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import corpus, references
from textloom.sources.tables import lines, table

from .catalogue import LINES, SPACES, _docs, query

HEADINGS = f"(SELECT doc_id, line_no, CASE WHEN length(line) % 5 = 0 THEN 1 WHEN length(line) % 5 < 3 THEN 2 ELSE 3 END AS level FROM {LINES})"


@query(
    f"WITH a AS (SELECT *, sum(CASE WHEN level = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS x FROM {HEADINGS}), b AS (SELECT *, sum(CASE WHEN level = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, x ORDER BY line_no) AS y FROM a),"
    " c AS (SELECT *, sum(CASE WHEN level = 3 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, x, y ORDER BY line_no) AS z FROM b)"
    " SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, CAST(x AS VARCHAR) || CASE WHEN level >= 2 THEN '.' || CAST(y AS VARCHAR) ELSE '' END || CASE WHEN level = 3 THEN '.' || CAST(z AS VARCHAR) ELSE '' END AS number FROM c"
)
def section_numbers(spark, sf):
    n = F.length("line") % 5
    rows = lines(_docs(spark, sf)).select("doc_id", "line_no", F.when(n == 0, 1).when(n < 3, 2).otherwise(3).alias("level"))
    return references.section_numbers(rows, "doc_id", "line_no", "level")


@query(
    "WITH r AS (SELECT doc_id, unnest(range(3)) AS pos, CAST((doc_id + unnest(range(3)) * 7) % 90 AS VARCHAR) AS label FROM documents), l AS (SELECT CAST(item_id AS VARCHAR) AS label, item_id * 2 AS number FROM benchmark)"
    " SELECT doc_id, CASE WHEN bool_and(number IS NOT NULL) THEN '[' || string_agg(CAST(number AS VARCHAR), ', ' ORDER BY pos) || ']' END AS printed FROM r LEFT JOIN l USING (label) GROUP BY doc_id"
)
def label_resolution(spark, sf):
    r = _docs(spark, sf).select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("pos")).withColumn("label", ((F.col("doc_id") + F.col("pos") * 7) % 90).cast("string"))
    labels = table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("label"), (F.col("item_id") * 2).alias("number"), F.col("item_id").alias("place"))
    return references.resolve(r, labels, ["doc_id"])


@query("SELECT doc_id, CASE WHEN count(*) OVER (PARTITION BY source, n_chars // 100) > 1 THEN chr(CAST(97 + (row_number() OVER (PARTITION BY source, n_chars // 100 ORDER BY doc_id) - 1) % 26 AS INTEGER)) END AS letter FROM documents")
def year_letters(spark, sf):
    rows = _docs(spark, sf).select("doc_id", "source", F.floor(F.col("n_chars") / 100).alias("year"))
    return references.year_letters(rows, ["source", "year"], "doc_id").select("doc_id", "letter")


@query(r"SELECT page_id, len(regexp_extract_all(b, '(?i)<tr[ >]')) AS n_rows, len(regexp_extract_all(b, '(?i)<t[dh][ >]')) AS n_cells, coalesce(array_to_string(list_sort(regexp_extract_all(regexp_replace(b, '<[^>]*>', ' ', 'g'), '\d+(?:[.,]\d+)*')), '|'), '') AS numbers FROM (SELECT page_id, array_to_string(regexp_extract_all(html, '(?is)<table.*?</table>'), ' ') AS b FROM pages)")
def table_fingerprint(spark, sf):
    return table(spark, sf, "pages").select("page_id", references.table_fingerprint(F.col("html")).alias("x")).select("page_id", "x.*")


_PAIRS = "(SELECT lower(lang) AS term, lower(source) AS gloss FROM documents)"


@query(f"SELECT term, count(DISTINCT gloss) AS n_renderings FROM {_PAIRS} GROUP BY term HAVING count(DISTINCT gloss) > 1")
def gloss_conflicts(spark, sf):
    return references.conflicts(_docs(spark, sf).select(F.col("lang").alias("term"), F.col("source").alias("gloss")), "term", "gloss")


@query("SELECT doc_id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT DISTINCT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def anti_joins_index(spark, sf):
    return references.both_anti(_docs(spark, sf), table(spark, sf, "labels"), "doc_id")


@query(r"SELECT source, row_number() OVER (PARTITION BY lower(left(source, 3)) ORDER BY lower(regexp_extract(source, '^\D+')), CAST(regexp_extract(source, '\d+') AS INTEGER)) AS place FROM (SELECT DISTINCT source FROM documents)")
def natural_order(spark, sf):
    w = Window.partitionBy(F.lower(F.left("source", F.lit(3)))).orderBy(T.natural_key(F.col("source")))
    return _docs(spark, sf).select("source").distinct().select("source", F.row_number().over(w).cast("long").alias("place"))


@query("WITH n AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, count(*) OVER (PARTITION BY conv_id) AS c FROM conversations) SELECT conv_id, turn FROM n WHERE c < 5 OR k IN (0, (c - 1) // 4, 2 * (c - 1) // 4, 3 * (c - 1) // 4, c - 1)")
def even_sample(spark, sf):
    return corpus.even_sample(table(spark, sf, "conversations").select("conv_id", "turn"), "conv_id", "turn")


@query("SELECT source, count(doc_id) AS n, max(doc_id) AS last, count(DISTINCT nullif(text, '')) AS papers FROM documents WHERE source IS NOT NULL GROUP BY source")
def advisor_summary(spark, sf):
    """All documents and distinct papers of every source that has any; advisor_totals takes the known sources from a list."""
    d = _docs(spark, sf)
    return references.totals(d, d.select("source").where("source IS NOT NULL").distinct(), "source", "doc_id", "text")


@query("SELECT s.source, count(d.doc_id) AS n, max(d.doc_id) AS last, count(DISTINCT nullif(d.text, '')) AS papers FROM (SELECT 'src' || CAST(n_nationkey AS VARCHAR) AS source FROM nation) s LEFT JOIN documents d ON s.source = d.source GROUP BY s.source")
def advisor_totals(spark, sf):
    """Rows, last row and distinct papers of every known source, those without a document too."""
    known = table(spark, sf, "nation").select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("source"))
    return references.totals(_docs(spark, sf), known, "source", "doc_id", "text")


@query("SELECT doc_id, sha256(regexp_replace(" + "replace(" * len(T.TYPOGRAPHY) + "text" + "".join(", '{}', '{}')".format(a, b.replace("'", "''")) for a, b in T.TYPOGRAPHY.items()) + ", '-{2,}', '-', 'g')) AS folded_sha256 FROM documents")
def typography_fold(spark, sf):
    return _docs(spark, sf).select("doc_id", F.sha2(T.fold_typography(F.col("text")), 256).alias("folded_sha256"))


@query("SELECT book, doc_id, lang AS a, lang2 AS b FROM (SELECT source AS book, doc_id, lang, lead(lang) OVER (PARTITION BY source ORDER BY doc_id) AS lang2 FROM documents) WHERE lang <> lang2")
def term_drift(spark, sf):
    w = Window.partitionBy("book").orderBy("doc_id")
    return _docs(spark, sf).select(F.col("source").alias("book"), "doc_id", F.col("lang").alias("a")).withColumn("b", F.lead("a").over(w)).where("a <> b")


_FLAT = f"trim(regexp_replace(text, '{SPACES}', ' ', 'g'))"


@query(f"SELECT source AS book, bool_and(same) AS passthrough FROM (SELECT source, {_FLAT} = output AS same, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM (SELECT doc_id, source, text, lead({_FLAT}) OVER (PARTITION BY source ORDER BY doc_id) AS output FROM documents)) WHERE k <= 3 GROUP BY source")
def passthrough(spark, sf):
    """White space doesn't matter; prints of the texts meet in the window, not the texts."""
    w = Window.partitionBy("source").orderBy("doc_id")
    rows = _docs(spark, sf).select("source", "doc_id", F.sha2(T.flatten_space(F.col("text")), 256).alias("print"))
    rows = rows.withColumn("same", F.col("print") == F.lead("print").over(w)).withColumn("k", F.row_number().over(w)).where("k <= 3")
    return rows.groupBy(F.col("source").alias("book")).agg(F.bool_and("same").alias("passthrough"))


@query()
def page_number_lines(spark, sf):
    """Digit lines that are page numbers; joined to the count of lines so that every document has a row."""
    d = _docs(spark, sf)
    found = references.drop_page_numbers(d).groupBy("doc_id").agg(F.count("*").alias("n"))
    return d.select("doc_id").join(found, "doc_id", "left").fillna(0)
