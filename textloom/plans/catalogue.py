"""All queries of the engine's own operators and the SQL that states the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import blocks, corpus, gates, glossary, incremental
from textloom.plans import fixtures
from textloom.sources.tables import lines, pairs, table
from textloom.streaming import journal

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


# --- what the queries pair and split, in both dialects

PAIRS = "(SELECT conv_id, turn, source, output FROM (SELECT conv_id, turn, role, text AS source, lead(text) OVER w AS output, lead(role) OVER w AS answers FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND answers = 'assistant')"
NEXT = "(SELECT * FROM (SELECT doc_id, source AS book, text AS source, lead(text) OVER (PARTITION BY source ORDER BY doc_id) AS output FROM documents) WHERE output IS NOT NULL UNION ALL SELECT * FROM " + fixtures.PAIRS_SQL + ")"
LINES = "(SELECT doc_id, unnest(range(len(x))) AS line_no, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))"
SPACES = r"[\s\x{00A0}]+"
MARKERS = {"paragraph": "<p[ >]", "link": "<a ", "script": "<script", "heading": "<h[1-6][ >]", "list": "<(?:ul|ol)[ >]", "table": "<table", "image": "<img", "nav": "<nav", "blink": "<blink"}


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    return pairs(table(spark, sf, "conversations"))


def _next(spark: SparkSession, sf: str) -> DataFrame:
    """Consecutive documents of a source as source and output, and the invented pairs; only ids meet in the window, texts by their id."""
    w = Window.partitionBy("source").orderBy("doc_id")
    docs = _docs(spark, sf)
    ids = docs.select("doc_id", F.col("source").alias("book"), F.lead("doc_id").over(w).alias("_next")).where("_next IS NOT NULL")
    own, then = docs.select("doc_id", F.col("text").alias("source")), docs.select(F.col("doc_id").alias("_next"), F.col("text").alias("output"))
    return ids.join(own, "doc_id").join(then.where("output IS NOT NULL"), "_next").select("doc_id", "book", "source", "output").unionByName(fixtures.pairs(spark))


def _count(pattern: str, text: str = "text") -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


# --- lines and text


@query(f"SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, CAST(length(line) AS BIGINT) AS n_chars FROM {LINES}")
def line_explode(spark, sf):
    return lines(_docs(spark, sf)).select("doc_id", "line_no", F.length("line").cast("long").alias("n_chars"))


@query(f"SELECT doc_id, sha256(trim(regexp_replace(text, '{SPACES}', ' ', 'g'))) AS flat_sha256 FROM documents")
def flatten_hash(spark, sf):
    return _docs(spark, sf).select("doc_id", F.sha2(T.flatten_space(F.col("text")), 256).alias("flat_sha256"))


@query(r"SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text || chr(13) || chr(10) || '# x' || chr(13) || chr(10), '\r\n?', chr(10), 'g'), '(?m)^(#+ )', '\\\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS clean_sha256 FROM documents")
def clean_lines(spark, sf):
    """One kind of line end, headings escaped, no run of blank lines; every text gets a heading after a foreign line end."""
    text = F.concat("text", F.lit("\r\n# x\r\n"))
    return _docs(spark, sf).select("doc_id", F.sha2(T.collapse_blank_runs(T.escape_hashes(T.normalize_newlines(text))), 256).alias("clean_sha256"))


@query(r"SELECT doc_id, sha256(regexp_replace(regexp_replace(t, '(?s)\\begin\{comment\}.*?\\end\{comment\}', '', 'g'), '(?m)^((?:[^\\%\n]|\\[^\n])*)%[^\n]*', '\1', 'g')) AS bare_sha256 FROM (SELECT doc_id, text || ' 5\% of it % gone' || chr(10) || '\begin{comment}' || text || '\end{comment}' AS t FROM documents)")
def comment_strip(spark, sf):
    """Every text gets an escaped sign, a comment and a comment environment, for few hold any."""
    text = F.concat("text", F.lit(" 5\\% of it % gone\n\\begin{comment}"), "text", F.lit("\\end{comment}"))
    return _docs(spark, sf).select("doc_id", F.sha2(T.strip_comments(text), 256).alias("bare_sha256"))


@query("SELECT doc_id, sha256(CAST(to_json({'doc_id': doc_id, 'lang': lang, 'n_chars': n_chars, 'source': source, 'text': text}) AS VARCHAR)) AS json_sha256 FROM documents")
def canonical_hash(spark, sf):
    return _docs(spark, sf).select("doc_id", F.sha2(T.canonical_json(["text", "source", "doc_id", "lang", "n_chars"]), 256).alias("json_sha256"))


@query(r"SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '([\p{L}])-\n([\p{Ll}])', '\1\2', 'g'), '([^.!?:;\n])\n([\p{Ll}(])', '\1 \2', 'g')) AS whole_sha256 FROM documents")
def hyphen_unwrap(spark, sf):
    return _docs(spark, sf).select("doc_id", F.sha2(T.rejoin_hyphens(F.col("text")), 256).alias("whole_sha256"))


@query("SELECT doc_id, CAST(i AS BIGINT) AS place, s AS sentence FROM (SELECT doc_id, unnest(range(len(x))) AS i, unnest(x) AS s FROM (SELECT doc_id, string_split(text, '. ') AS x FROM documents)) WHERE length(s) BETWEEN 60 AND 200 AND length(s) - length(replace(s, ' ', '')) >= 8")
def evidence_sentences(spark, sf):
    rows = _docs(spark, sf).select("doc_id", F.posexplode(F.split("text", r"\. ")).alias("place", "sentence"))
    spaces = F.length("sentence") - F.length(F.replace("sentence", F.lit(" "), F.lit("")))
    return rows.where(F.length("sentence").between(60, 200) & (spaces >= 8)).select("doc_id", F.col("place").cast("long").alias("place"), "sentence")


@query(
    "WITH s AS (SELECT doc_id, book, output, i, x FROM (SELECT doc_id, book, output, unnest(range(len(y))) AS i, unnest(y) AS x FROM (SELECT doc_id, book, output, string_split(source, '. ') AS y FROM " + NEXT + ")) WHERE length(x) BETWEEN 60 AND 200),"
    " k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM s) SELECT doc_id, count(*) AS n, avg(CASE WHEN contains(output, x) THEN 1.0 ELSE 0.0 END) AS fidelity FROM k WHERE r <= 12 GROUP BY doc_id"
)
def sentence_fidelity(spark, sf):
    rows = _next(spark, sf).select("doc_id", "output", F.posexplode(F.split("source", r"\. ")).alias("i", "x")).where(F.length("x").between(60, 200))
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy("i"))).where("r <= 12")
    return first.groupBy("doc_id").agg(F.count("*").alias("n"), F.avg(F.when(F.contains("output", "x"), 1.0).otherwise(0.0)).alias("fidelity"))


@query(
    f"WITH l AS (SELECT d.source AS book, x.doc_id, trim(regexp_replace(trim(line), '[0-9]+', '#', 'g')) AS key FROM {LINES} x JOIN documents d ON x.doc_id = d.doc_id),"
    " p AS (SELECT book, count(DISTINCT doc_id) AS pages FROM l GROUP BY book), f AS (SELECT book, key, count(DISTINCT doc_id) AS n_pages FROM l WHERE key <> '' GROUP BY book, key)"
    " SELECT f.book, f.key, n_pages FROM f JOIN p ON f.book = p.book WHERE n_pages >= greatest(3.0, pages * 0.05)"
)
def furniture_lines(spark, sf):
    rows = _docs(spark, sf).select(F.col("source").alias("book"), "doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return corpus.furniture(rows, "book", "doc_id", share=0.05)


VISIBLE = r"regexp_replace(regexp_replace(html, '(?is)<(?:script|style|annotation)[^>]*>.*?</(?:script|style|annotation)>', ' ', 'g'), '<[^>]*>', ' ', 'g')"
for _a, _b in T.ENTITIES.items():
    VISIBLE = "replace(" + VISIBLE + f", '{_a}', '" + _b.replace("'", "''") + "')"


@query(f"SELECT page_id, sha256(trim(regexp_replace({VISIBLE}, '{SPACES}', ' ', 'g'))) AS visible_sha256 FROM pages")
def visible_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.sha2(T.visible_text(F.col("html")), 256).alias("visible_sha256"))


@query("SELECT page_id, " + ", ".join(f"{_count(p, 'html')} AS n_{m}" for m, p in MARKERS.items()) + " FROM pages")
def html_inventory(spark, sf):
    return table(spark, sf, "pages").select("page_id", *(T.count_matches(F.col("html"), p).alias(f"n_{m}") for m, p in MARKERS.items()))


SLUG = r"regexp_replace(regexp_replace(regexp_replace(lower(line), '[^\p{L}\p{N}_\s-]', '', 'g'), '[\s-]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query(f"WITH s AS (SELECT doc_id, line_no, CASE WHEN {SLUG} = '' THEN 'heading' ELSE {SLUG} END AS slug FROM {LINES}), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, slug ORDER BY line_no) AS k FROM s) SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, CASE WHEN k = 1 THEN slug ELSE slug || '-' || CAST(k - 1 AS VARCHAR) END AS heading_id FROM r")
def heading_ids(spark, sf):
    rows = lines(_docs(spark, sf)).withColumn("slug", T.heading_slug(F.col("line")))
    k = F.row_number().over(Window.partitionBy("doc_id", "slug").orderBy("line_no"))
    return rows.withColumn("k", k).select("doc_id", "line_no", F.when(F.col("k") == 1, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), (F.col("k") - 1).cast("string"))).alias("heading_id"))


@query(r"SELECT token, count(*) AS n FROM (SELECT unnest(string_split_regex(text, '[ \n]+')) AS token FROM documents) WHERE regexp_matches(token, '[{}<>$&|^~`\\]') GROUP BY token")
def leak_tokens(spark, sf):
    rows = _docs(spark, sf).select(F.explode(F.split("text", r"[ \n]+")).alias("token"))
    return rows.where(F.col("token").rlike(r"[{}<>$&|^~`\\]")).groupBy("token").agg(F.count("*").alias("n"))


# --- gates

K = ["doc_id"]


def _gate_sql(check: str, severity: str, detail: str, rows: str) -> str:
    return f"SELECT doc_id, '{check}' AS \"check\", {severity} AS severity, {detail} AS detail FROM {rows}"


@query(" UNION ALL ".join(_gate_sql("structure", f"'{s}'", f"'{k}'", f"{NEXT} WHERE {_count('(?m)' + p, 'output')} < {_count('(?m)' + p, 'source')}") for k, p, s in gates.STRUCTURE))
def structure_gate(spark, sf):
    return gates.structure(_next(spark, sf), K)


@query(_gate_sql("fences", "'fail'", "'odd'", f"{NEXT} WHERE {_count('(?m)' + gates.FENCE, 'output')} % 2 = 1"))
def fence_gate(spark, sf):
    return gates.fences(_next(spark, sf), K)


_ANY = lambda part, pattern: "len(list_filter({}, lambda x: regexp_matches(x, '{}'))) > 0".format(part, pattern.replace("'", "''"))


@query(
    f"WITH b AS (SELECT conv_id, turn, regexp_replace(output, '^\\s+|\\s+$', '', 'g') AS bare FROM {PAIRS} UNION ALL SELECT doc_id, CAST(0 AS INTEGER), regexp_replace(output, '^\\s+|\\s+$', '', 'g') FROM {fixtures.PAIRS_SQL}), l AS (SELECT *, string_split(bare, chr(10)) AS x FROM b)"
    f" SELECT conv_id, turn, 'commentary' AS \"check\", 'fail' AS severity, detail FROM (SELECT conv_id, turn, 'opener' AS detail FROM l WHERE {_ANY('x[1:3]', gates.OPENER)} UNION ALL SELECT conv_id, turn, 'note' FROM l WHERE {_ANY('x[-3:]', gates.NOTE)}"
    " UNION ALL SELECT conv_id, turn, 'fenced' FROM l WHERE bare LIKE '```%' AND bare LIKE '%```' AND length(bare) - length(replace(bare, '```', '')) = 6)"
)
def commentary_gate(spark, sf):
    made = fixtures.pairs(spark).select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), "source", "output")
    return gates.commentary(_turns(spark, sf).unionByName(made), ["conv_id", "turn"])


#: RE2 looks neither ahead nor behind, so numerals are cut out as runs first; a percent sign before a word character is none.
_W = r"\p{L}\p{N}_"


@query(
    f"WITH p AS (SELECT doc_id, source, output, regexp_replace(source, '%([{_W}])', '; \\1', 'g') AS t FROM {NEXT}), u AS (SELECT doc_id, output, source, unnest(regexp_extract_all(t, '[{_W}.,]+%?')) AS run FROM p),"
    f" w AS (SELECT doc_id, output, regexp_extract(run, '^([0-9]+[.,][0-9]+)(?:[^0-9.,]|$)', 1) AS n FROM u UNION SELECT doc_id, output, regexp_extract(run, '^([0-9]+(?:[.,][0-9]+)?(?:%|ms|GB|Hz))(?:[^{_W}]|$)', 1) FROM u),"
    f" m AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(source, '(?i)(?:^|[^{_W}.,])([0-9]+(?:[.,][0-9]+)?)\\s*(?:million|billion|trillion|thousand|hundred)\\b', 1)) AS n FROM p)"
    " SELECT doc_id, 'numerals' AS \"check\", 'fail' AS severity, n AS detail FROM w WHERE n <> '' AND NOT contains(output, n) AND (doc_id, n) NOT IN (SELECT doc_id, n FROM m)"
)
def numeral_gate(spark, sf):
    return gates.numerals(_next(spark, sf), K)


_FOUND = lambda c, sign: " UNION ALL ".join("SELECT doc_id, '{}' AS kind, unnest(regexp_extract_all({}, '{}', 1)) AS image, {} AS n FROM {}".format(k, c, q.replace("'", "''"), sign, NEXT) for k, q in gates.IMAGES)


@query(f"SELECT doc_id, 'images' AS \"check\", CASE WHEN s > 0 THEN 'fail' ELSE 'warn' END AS severity, kind, image AS detail, abs(s) AS n FROM (SELECT doc_id, kind, image, CAST(sum(n) AS BIGINT) AS s FROM ({_FOUND('source', 1)} UNION ALL {_FOUND('output', -1)}) GROUP BY doc_id, kind, image) WHERE s <> 0")
def image_gate(spark, sf):
    return gates.images(_next(spark, sf), K)


_ENTRIES = lambda c: f"regexp_replace(regexp_replace({c}, '^\\s*#{{1,6}}[^\\n]*\\n', ''), '^\\s+|\\s+$', '', 'g')"


@query(_gate_sql("reference_verbatim", "'fail'", "CAST(abs(length(a) - length(b)) AS VARCHAR)", f"(SELECT doc_id, {_ENTRIES('source')} AS a, {_ENTRIES('output')} AS b FROM {NEXT}) WHERE a <> b"))
def reference_verbatim_gate(spark, sf):
    return gates.reference_verbatim(_next(spark, sf), K)


FLAT = lambda c: f"trim(regexp_replace({c}, '{SPACES}', ' ', 'g'))"


@query(_gate_sql("untranslated", "'fail'", "'identical'", f"{NEXT} WHERE {FLAT('source')} = {FLAT('output')} AND regexp_matches(source, '\\p{{L}}')"))
def untranslated_gate(spark, sf):
    return gates.untranslated(_next(spark, sf), K)


@query(
    f"WITH s AS (SELECT doc_id, book, length(regexp_replace(source, '{SPACES}', '', 'g')) AS a, length(regexp_replace(output, '{SPACES}', '', 'g')) AS b FROM {NEXT}), r AS (SELECT *, b / a AS ratio FROM s WHERE a >= 200),"
    " m AS (SELECT book, CASE WHEN count(*) >= 3 THEN list_sort(list(ratio))[1 + count(*) // 2] END AS med FROM r GROUP BY book),"
    " j AS (SELECT doc_id, r.book, CASE WHEN ratio < CASE WHEN med IS NULL THEN 0.35 ELSE greatest(0.20, 0.55 * med) END THEN 'fail' WHEN ratio > 2.5 THEN 'warn' END AS severity FROM r JOIN m ON r.book = m.book)"
    " SELECT book, doc_id, 'length' AS \"check\", severity, CASE WHEN severity = 'fail' THEN 'short' ELSE 'long' END AS detail FROM j WHERE severity IS NOT NULL"
)
def length_gate(spark, sf):
    return gates.lengths(_next(spark, sf), ["doc_id", "book"], "book")


@query("SELECT *, CASE WHEN target + latin > 0 THEN target / (target + latin) END AS ratio FROM (SELECT doc_id, length(regexp_replace(text, '[^\\x{00C0}-\\x{024F}]', '', 'g')) AS target, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS latin FROM documents)")
def script_ratio(spark, sf):
    return gates.script_ratio(_docs(spark, sf), K, "text", r"\x{00C0}-\x{024F}")


@query(f"SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, n_words FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM (SELECT doc_id, line_no, line, {_count('[A-Za-z]+', 'line')} AS n_words FROM {LINES}) WHERE n_words >= 14 AND NOT regexp_matches(line, '[\\x{{AC00}}-\\x{{D7A3}}]')) WHERE k <= 5")
def untranslated_blocks(spark, sf):
    return gates.untranslated_lines(lines(_docs(spark, sf)))


def _diff_sql(pattern: str, check: str) -> str:
    side = lambda c, n: f"(SELECT doc_id, token, count(*) AS {n} FROM (SELECT doc_id, unnest(regexp_extract_all({c}, '{pattern}')) AS token FROM {NEXT}) GROUP BY doc_id, token)"
    return f"SELECT doc_id, '{check}' AS \"check\", token, CASE WHEN n_output = 0 THEN 'missing' WHEN n_source = 0 THEN 'foreign' WHEN n_output > n_source THEN 'repeated' ELSE 'fewer' END AS kind, n_source, n_output FROM (SELECT doc_id, token, coalesce(n_source, 0) AS n_source, coalesce(n_output, 0) AS n_output FROM {side('source', 'n_source')} FULL JOIN {side('output', 'n_output')} USING (doc_id, token)) WHERE n_source <> n_output"


@query(_diff_sql("[A-Z][a-z]+ice[a-z]*|[0-9]{4,}", "placeholders"))
def placeholder_diff(spark, sf):
    return gates.token_diff(_next(spark, sf), K, "[A-Z][a-z]+ice[a-z]*|[0-9]{4,}", "placeholders")


@query(_diff_sql("[0-9]+", "numbers"))
def multiset_diff(spark, sf):
    return gates.token_diff(_next(spark, sf), K, "[0-9]+", "numbers")


@query("SELECT conv_id, turn, right(lag(text) OVER w, 300) AS before, left(lead(text) OVER w, 300) AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def neighbor_context(spark, sf):
    return gates.neighbour_context(table(spark, sf, "conversations"), "conv_id", "turn", "text")


@query(
    "WITH n AS (SELECT conv_id, turn, source, output, right(lag(source) OVER (PARTITION BY conv_id ORDER BY turn), 180) AS near FROM " + PAIRS + ")"
    " SELECT conv_id, turn, 'neighbor_leak' AS \"check\", 'fail' AS severity, 'before' AS detail FROM n WHERE length(near) >= 60 AND len(list_filter(range(1, length(near) - 58, 30), lambda k: contains(output, substr(near, k, 60)) AND NOT contains(source, substr(near, k, 60)))) > 0"
)
def neighbor_leak(spark, sf):
    """Only the source before, as it is written; neighbor_leak_sides is the whole gate."""
    return gates.neighbour_leak(_turns(spark, sf), "conv_id", "turn", "source", "output")


@query(
    f"WITH f AS (SELECT conv_id, turn, {FLAT('source')} AS own, {FLAT('output')} AS made FROM {PAIRS}), n AS (SELECT *, right(lag(own) OVER w, 180) AS b, left(lead(own) OVER w, 180) AS a FROM f WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),"
    " s AS (SELECT conv_id, turn, own, made, 'before' AS detail, b AS near FROM n UNION ALL SELECT conv_id, turn, own, made, 'after', a FROM n)"
    " SELECT conv_id, turn, 'neighbor_leak' AS \"check\", 'fail' AS severity, detail FROM s WHERE length(near) >= 60 AND len(list_filter(range(1, length(near) - 58, 30), lambda k: contains(made, substr(near, k, 60)) AND NOT contains(own, substr(near, k, 60)))) > 0"
)
def neighbor_leak_sides(spark, sf):
    return gates.neighbour_leaks(_turns(spark, sf), "conv_id", "turn", "source", "output")


# --- references: gaps and islands

REF = "[0-9]{3}|token"


@query(
    f"WITH f AS (SELECT doc_id, line_no, regexp_matches(line, '{REF}') AS ref FROM {LINES} WHERE trim(line) <> ''), g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - row_number() OVER (PARTITION BY doc_id, ref ORDER BY line_no) AS run FROM f),"
    " r AS (SELECT doc_id, ref, run, count(*) AS n, min(line_no) AS lo, max(line_no) AS hi FROM g GROUP BY doc_id, ref, run), x AS (SELECT *, lag(ref) OVER w AS a, lead(ref) OVER w AS b FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY lo))"
    " SELECT doc_id, CAST(lo AS BIGINT) AS first_line, CAST(hi AS BIGINT) AS last_line, n, CASE WHEN ref THEN 'reference' WHEN n <= 3 AND a AND b THEN 'filled' ELSE 'prose' END AS kind FROM x"
)
def reference_gap_fill(spark, sf):
    f = lines(_docs(spark, sf)).where("trim(line) <> ''").withColumn("ref", F.col("line").rlike(REF))
    run = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")) - F.row_number().over(Window.partitionBy("doc_id", "ref").orderBy("line_no"))
    r = f.withColumn("run", run).groupBy("doc_id", "ref", "run").agg(F.count("*").alias("n"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))
    w = Window.partitionBy("doc_id").orderBy("first_line")
    kind = F.when(F.col("ref"), "reference").when((F.col("n") <= 3) & F.lag("ref").over(w) & F.lead("ref").over(w), "filled").otherwise("prose")
    return r.withColumn("kind", kind).select("doc_id", "first_line", "last_line", "n", "kind")


# --- glossary

TERM_ROWS = ", ".join("('{}', '{}', '{}', '{}', [{}]::VARCHAR[])".format(a, b, c, d, ", ".join(f"'{x}'" for x in e)) for a, b, c, d, e in glossary.TERMS)
TERMS_SQL = f"(SELECT * FROM (VALUES {TERM_ROWS}) AS t(id, source, target, category, aliases) UNION ALL SELECT 'n' || k, CAST(k AS VARCHAR), 'no. ' || k, 'number', []::VARCHAR[] FROM range({glossary.NUMBERS}) AS r(k))"
TOKENS = r"[\p{L}\p{N}_]+"
#: Whole words of a term count as tokens; a form of two words as two tokens in a row.
FREQ = (
    f"s AS (SELECT id, unnest(list_concat([source], aliases)) AS surface FROM {TERMS_SQL}), w AS (SELECT doc_id, unnest(regexp_extract_all(text, '{TOKENS}')) AS token FROM documents),"
    " one AS (SELECT doc_id, id, count(*) AS n FROM w JOIN s ON token = surface GROUP BY doc_id, id),"
    " two AS (SELECT doc_id, id, len(regexp_extract_all(' ' || regexp_replace(text, '[^\\p{L}\\p{N}_ -]', '  ', 'g') || ' ', ' MIT[ -]+License ')) AS n FROM documents, s WHERE surface = 'MIT License'),"
    " local AS (SELECT doc_id, id, CAST(sum(n) AS BIGINT) AS n FROM (SELECT * FROM one UNION ALL SELECT * FROM two WHERE n > 0) GROUP BY doc_id, id)"
)


def _local(spark, sf):
    return glossary.frequencies(_docs(spark, sf), glossary.surfaces(glossary.terms(spark)), ["doc_id"])


@query(f"WITH {FREQ} SELECT doc_id, id, n FROM local")
def term_frequency(spark, sf):
    return _local(spark, sf)


@query(
    f"WITH {FREQ}, f AS (SELECT t.id, t.source, CAST(coalesce(sum(n), 0) AS BIGINT) AS freq FROM {TERMS_SQL} t LEFT JOIN local ON t.id = local.id GROUP BY t.id, t.source),"
    " d AS (SELECT x.doc_id, f.id, f.source, freq, local.id IS NOT NULL AS own FROM documents x CROSS JOIN f LEFT JOIN local ON local.doc_id = x.doc_id AND local.id = f.id),"
    " g AS (SELECT *, row_number() OVER (PARTITION BY doc_id, own ORDER BY freq DESC, source, id) AS k FROM d), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY own DESC, k) AS rank FROM g WHERE own OR k <= 20)"
    " SELECT doc_id, rank, id, own, freq FROM r WHERE rank <= 50"
)
def term_selection(spark, sf):
    return glossary.select_terms(_docs(spark, sf), _local(spark, sf), glossary.terms(spark), ["doc_id"])


_BODY = r"regexp_replace(output, '!\[[^\]]*\]\([^)]*\)|<img[^>]*>|https?://\S+|`[^`\n]+`', ' ', 'g')"


@query(f"SELECT DISTINCT doc_id, 'glossary' AS \"check\", 'fail' AS severity, t.id AS detail FROM (SELECT doc_id, source, output, unnest(regexp_extract_all({_BODY}, '{TOKENS}')) AS token FROM {NEXT}) p JOIN {TERMS_SQL} t ON token = t.source WHERE contains(p.source, t.source) AND NOT contains(output, t.target) AND t.target <> t.source")
def glossary_gate(spark, sf):
    return glossary.left_untranslated(_next(spark, sf), glossary.terms(spark), K)


_FOLD = lambda c: "regexp_replace(" + "replace(" * len(T.TYPOGRAPHY) + FLAT(c) + "".join(", '{}', '{}')".format(a, b.replace("'", "''")) for a, b in T.TYPOGRAPHY.items()) + ", '-{2,}', '-', 'g')"
#: Every document offers its first 60 characters, as its chunk has them, and the same reversed.
_QUOTES = "(SELECT doc_id, 'conflicts' AS field, left(text, 60) AS quote, text AS source FROM documents UNION ALL SELECT doc_id, 'new_entities', reverse(left(text, 60)), text FROM documents)"


@query(f"SELECT doc_id, field, 'meta_evidence' AS \"check\", 'fail' AS severity, left(quote, 100) AS detail FROM {_QUOTES} WHERE length({_FOLD('quote')}) >= 8 AND NOT contains({_FOLD('source')}, {_FOLD('quote')})")
def evidence_gate(spark, sf):
    d = _docs(spark, sf)
    head = F.left("text", F.lit(60))
    quotes = d.select("doc_id", F.lit("conflicts").alias("field"), head.alias("quote")).unionByName(d.select("doc_id", F.lit("new_entities").alias("field"), F.reverse(head).alias("quote")))
    return gates.evidence(quotes, d.select("doc_id", F.col("text").alias("source")), K)


@query(f"SELECT id, sha256(source || '→' || target || '|' || category || CASE WHEN len(aliases) > 0 THEN '|aliases=[' || array_to_string(list_transform(list_sort(aliases), lambda x: chr(34) || replace(replace(x, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34)) || chr(34)), ', ') || ']' ELSE '' END) AS term_hash FROM {TERMS_SQL}")
def term_hash(spark, sf):
    return glossary.terms(spark).select("id", glossary.term_hash().alias("term_hash"))


@query(f"SELECT surface, n_terms FROM (SELECT surface, count(DISTINCT id) AS n_terms FROM (SELECT id, unnest(list_concat([source, target], aliases)) AS surface FROM {TERMS_SQL}) GROUP BY surface) WHERE n_terms > 1")
def surface_violations(spark, sf):
    named = glossary.terms(spark).withColumn("aliases", F.concat(F.array("target"), "aliases"))
    return glossary.surface_violations(named)


@query("SELECT doc_id, g AS gloss, CAST(k AS BIGINT) AS first_place FROM (SELECT doc_id, g, min(k) AS k FROM (SELECT doc_id, unnest(x) AS g, unnest(range(len(x))) AS k FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda z: lower(z)) AS x FROM documents)) GROUP BY doc_id, g)")
def gloss_first_use(spark, sf):
    return glossary.first_uses(_docs(spark, sf))


# --- entities, manifests and plans

OBSERVED = "(SELECT doc_id AS chunk, source, lang AS target, CASE WHEN n_chars > 1500 THEN 'long' ELSE 'short' END AS category FROM documents)"


@query(f"SELECT source, n_pairs, n_evidence, first_target, CASE WHEN n_pairs = 1 THEN 'auto' ELSE 'conflict' END AS decision, CASE WHEN n_evidence >= 3 THEN 'high' WHEN n_evidence = 2 THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT source, count(DISTINCT (target, category)) AS n_pairs, count(DISTINCT chunk) AS n_evidence, min(target) AS first_target FROM {OBSERVED} GROUP BY source)")
def merge_proposals(spark, sf):
    d = _docs(spark, sf).select(F.col("doc_id").alias("chunk"), "source", F.col("lang").alias("target"), F.when(F.col("n_chars") > 1500, "long").otherwise("short").alias("category"))
    return incremental.proposals(d)


ALIASES = "('a', 'b'), ('b', 'c'), ('c', 'd'), ('x', 'y'), ('y', 'x'), ('q', 'r')"


@query(f"WITH RECURSIVE e AS (SELECT * FROM (VALUES {ALIASES}) AS t(variant, form)), r AS (SELECT variant, form, 1 AS depth FROM e UNION SELECT r.variant, e.form, depth + 1 FROM r JOIN e ON r.form = e.variant WHERE depth < 8) SELECT variant, form, CAST(min(depth) AS BIGINT) AS depth FROM r GROUP BY variant, form")
def alias_closure(spark, sf):
    return spark.sql(f"WITH RECURSIVE e AS (SELECT * FROM VALUES {ALIASES} AS t(variant, form)), r AS (SELECT variant, form, 1 AS depth FROM e UNION ALL SELECT r.variant, e.form, depth + 1 FROM r JOIN e ON r.form = e.variant WHERE depth < 8) SELECT variant, form, CAST(min(depth) AS BIGINT) AS depth FROM r GROUP BY variant, form")


@query("SELECT conv_id, turn, sha256(coalesce(text, '')) AS source_hash FROM conversations")
def manifest_hashes(spark, sf):
    return incremental.manifest(table(spark, sf, "conversations"), "conv_id", "turn", "text")


STATE = "(SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 11 = 1 THEN '' WHEN doc_id % 11 = 2 THEN '  ' ELSE text END AS output, sha256(text) AS source_hash, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN sha256(lang) ELSE sha256(text) END AS recorded_source, sha256(lang) AS term_hash, CASE WHEN doc_id % 3 = 0 THEN sha256(source) ELSE sha256(lang) END AS recorded_terms, sha256(text) AS output_hash, CASE WHEN doc_id % 2 = 0 THEN sha256('x') ELSE sha256(text) END AS recorded_output FROM documents)"
_rule = lambda at: "CASE " + " ".join(f"WHEN {r[0]} THEN '{r[at]}'" for r in incremental.RULES) + f" ELSE '{('unchanged', 'none')[at - 1]}' END"


@query(f"SELECT doc_id, {_rule(1)} AS reason, {_rule(2)} AS action FROM {STATE}")
def plan_actions(spark, sf):
    _docs(spark, sf).createOrReplaceTempView("_plan_documents")
    state = spark.sql("SELECT * FROM " + STATE.replace("sha256(", "sha2_256(").replace("FROM documents", "FROM _plan_documents").replace("sha2_256(text)", "sha2(text, 256)").replace("sha2_256(lang)", "sha2(lang, 256)").replace("sha2_256(source)", "sha2(source, 256)").replace("sha2_256('x')", "sha2('x', 256)"))
    return incremental.plan(state, K)


@query("SELECT * FROM (SELECT doc_id, CASE WHEN source IS NULL THEN 'missing_source' WHEN output IS NULL THEN 'missing_output' WHEN output = '' THEN 'empty' WHEN trim(output) = '' THEN 'blank' WHEN octet_length(encode(output)) * 10 < octet_length(encode(source)) THEN 'small' END AS problem, CASE WHEN source IS NOT NULL AND output IS NOT NULL AND trim(output) <> '' THEN 'warn' ELSE 'error' END AS severity FROM " + NEXT + ") WHERE problem IS NOT NULL")
def merge_validation(spark, sf):
    return incremental.validate_merge(_next(spark, sf), K)


# --- censuses, histories, search

_CENSUS = "(" + " UNION ALL ".join(f"SELECT page_id, '{m}' AS marker, {_count(p, 'html')} AS n FROM pages" for m, p in MARKERS.items()) + ")"


def _census(spark, sf):
    return corpus.census(table(spark, sf, "pages"), "page_id", "html", MARKERS)


@query(f"SELECT * FROM {_CENSUS} WHERE n > 0")
def census_markers(spark, sf):
    return _census(spark, sf)


@query(f"SELECT marker, count(DISTINCT page_id) AS n_docs, CAST(sum(n) AS BIGINT) AS total FROM {_CENSUS} WHERE n > 0 GROUP BY marker")
def census_digest(spark, sf):
    return corpus.digest(_census(spark, sf), "page_id")


@query(f"SELECT DISTINCT marker FROM {_CENSUS} WHERE marker NOT IN (SELECT marker FROM {_CENSUS} WHERE n > 0)")
def never_seen(spark, sf):
    return corpus.never_seen(_census(spark, sf), spark.createDataFrame([(m,) for m in MARKERS], "marker string"))


@query(f"WITH c AS (SELECT * FROM {_CENSUS} WHERE n > 0), o AS (SELECT page_id, marker, n + 1 AS n FROM c WHERE page_id % 3 > 0), w AS (SELECT * FROM c WHERE page_id % 3 < 2) SELECT page_id, marker, coalesce(w.n, o.n) AS n FROM o FULL JOIN w USING (page_id, marker)")
def census_merge(spark, sf):
    c = _census(spark, sf)
    return corpus.merge_census(c.where("page_id % 3 > 0").withColumn("n", F.col("n") + 1), c.where("page_id % 3 < 2"), "page_id")


_RUNS = "SELECT user_id AS edition, event_type AS \"check\", count(*) AS n FROM events GROUP BY user_id, event_type"


@query(
    f"WITH r AS ({_RUNS}), o AS (SELECT edition, CAST(sum(n) AS BIGINT) AS \"of\" FROM r GROUP BY edition), c AS (SELECT \"check\", count(*) AS runs FROM r GROUP BY \"check\"), j AS (SELECT edition, r.\"check\", n, \"of\", runs, CASE WHEN n / \"of\" >= 0.30 AND n > 1 THEN 'brief' WHEN runs >= 3 THEN 'chronic' END AS verdict FROM r JOIN o USING (edition) JOIN c ON r.\"check\" = c.\"check\") SELECT * FROM j WHERE verdict IS NOT NULL"
)
def judge_flags(spark, sf):
    rows = table(spark, sf, "events").groupBy(F.col("user_id").alias("edition"), F.col("event_type").alias("check")).agg(F.count("*").alias("n"))
    rows = rows.join(rows.groupBy("edition").agg(F.sum("n").alias("of")), "edition")
    return corpus.judge(rows, rows.select("edition", "check").limit(0))


@query("SELECT event_type AS \"check\", count(DISTINCT user_id) AS n_chunks, CASE WHEN bool_or(value > 100) THEN 'fail' ELSE 'warn' END AS severity FROM events GROUP BY event_type")
def worst_severity(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_type").alias("check"), F.col("user_id").alias("chunk"), F.when(F.col("value") > 100, "fail").otherwise("warn").alias("severity"))
    return corpus.worst_severity(rows)


@query("SELECT conv_id, turn, role FROM conversations WHERE (conv_id, turn) NOT IN (SELECT conv_id, turn FROM conversations WHERE role = 'user') UNION ALL SELECT conv_id, turn, 'rerun' FROM conversations WHERE role = 'user'")
def history_upsert(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return corpus.upsert(c, c.where("role = 'user'").withColumn("role", F.lit("rerun")), ["conv_id", "turn"])


@query("SELECT id, score FROM (SELECT id, CAST(sum(s) AS BIGINT) AS score FROM (SELECT source || ':' || CAST(doc_id AS VARCHAR) AS id, (CASE WHEN source || ':' || CAST(doc_id AS VARCHAR) = w THEN 20 ELSE 0 END) + (CASE WHEN contains(lower(lang), w) THEN 5 ELSE 0 END) + (CASE WHEN list_contains(string_split(lower(text), ' '), w) THEN 3 ELSE 0 END) + (CASE WHEN contains(lower(text), w) THEN 1 ELSE 0 END) AS s FROM documents, (VALUES ('license'), ('en'), ('clown')) AS t(w)) GROUP BY id) WHERE score > 0 ORDER BY score DESC, id LIMIT 5")
def ranked_search(spark, sf):
    d = _docs(spark, sf).select(F.concat("source", F.lit(":"), F.col("doc_id").cast("string")).alias("id"), F.col("lang").alias("title"), F.split(F.lower("text"), " ").alias("tokens"), F.col("text").alias("body"))
    return corpus.ranked_search(d, ["license", "en", "clown"])


@query("SELECT conv_id, sha256(m) AS merged_sha256, length(m) AS n_chars FROM (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS m FROM conversations GROUP BY conv_id)")
def ordered_merge(spark, sf):
    return corpus.ordered_merge(table(spark, sf, "conversations"), "conv_id", "turn", "text")


# --- stack-shaped text: rows only here, literals in the tests


@query()
def chunk_pack(spark, sf):
    return blocks.chunks(_docs(spark, sf), target=1500)


@query("SELECT doc_id, sha256(text) AS restored_sha256 FROM documents")
def protect_restore(spark, sf):
    """Opaque spans become tokens and come back: every text is whole again."""
    return blocks.protected(_docs(spark, sf)).select("doc_id", F.sha2("restored", 256).alias("restored_sha256"))


@query("SELECT doc_id, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM " + LINES + " WHERE trim(line) <> '' GROUP BY doc_id")
def packed_lines(spark, sf):
    """Packing keeps every line that isn't blank, in whichever chunk."""
    rows = blocks.chunks(_docs(spark, sf)).select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where("trim(line) <> ''")
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


# --- streams over the events


@query("SELECT event_type AS \"check\", CAST(max(CASE WHEN value > 100 THEN 2 ELSE 1 END) AS INTEGER) AS worst, count(*) AS n FROM events GROUP BY event_type")
def journal_stream(spark, sf):
    s = journal.events(spark, sf).select(F.col("event_type").alias("check"), F.when(F.col("value") > 100, "fail").otherwise("warn").alias("severity"))
    return journal.drained(journal.journal(s), "journal_stream", "complete")


@query("SELECT event_id, event_type FROM events")
def stream_dedup(spark, sf):
    s = journal.events(spark, sf)
    return journal.drained(journal.once(s.unionByName(s), "event_id").select("event_id", "event_type"), "stream_dedup", "append")


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def events_tumbling(spark, sf):
    return journal.drained(journal.tumbling(journal.events(spark, sf)), "events_tumbling", "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))

from . import editions as _editions  # noqa: E402,F401  adds its queries
from . import references as _references  # noqa: E402,F401  adds its queries
