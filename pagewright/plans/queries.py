"""A query for each page operator over the tables, and the DuckDB SQL that gives the same rows.

The tables hold no PDFs, images, fonts or word boxes. What stands in for them is synthetic: computed from ids by
the same arithmetic on both sides, over all rows. ``conversations`` are multi-page files, a turn a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import codes as C
from pagewright.functions import text as T
from pagewright.operators import cache, escalate, geometry, pagesets, probe, quality, render

from .registry import query


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- text -------------------------------------------------------------------------------------------------------

NOISE = "concat('{f}rst  ', replace(replace(text, 'th', '{l}'), ' of ', '-' || chr(10) || '  of  '), chr(7), chr(10), chr(10), chr(10), chr(10), '  end', chr(9), chr(160))".format(f=chr(0xFB01), l=chr(0xFB02))


def _noisy() -> Column:
    return F.expr(NOISE)


@query("nonspace_bytes", f"SELECT doc_id, {T.nonspace_bytes_sql('text')}::BIGINT AS chars FROM documents")
def nonspace_bytes(spark, d):
    return table(spark, d, "documents").select("doc_id", T.nonspace_bytes("text").alias("chars"))


@query("readability_counts", f"SELECT doc_id, {T.readability_counts_sql('text')} FROM documents")
def readability_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", T.readability_counts("text").alias("c")).select("doc_id", "c.*")


_RATIOS = "CASE WHEN chars > 0 THEN round(alnum / chars, 4) ELSE 0.0 END AS letter_digit_ratio, CASE WHEN tokens > 0 THEN round(wordlike / tokens, 4) ELSE 0.0 END AS word_score, CASE WHEN chars > 0 THEN round(bad / chars, 4) ELSE 0.0 END AS replacement_ratio"


@query("readability", f"SELECT doc_id, {_RATIOS} FROM (SELECT doc_id, {T.readability_counts_sql('text')} FROM documents)")
def readability(spark, d):
    return table(spark, d, "documents").select("doc_id", T.readability("text").alias("r")).select("doc_id", "r.*")


@query(
    "readability_gate",
    f"""SELECT doc_id, line_no, letter_digit_ratio >= 0.55 AND word_score >= 0.5 AND replacement_ratio <= 0.05 AS readable FROM (SELECT doc_id, line_no, {_RATIOS} FROM (
SELECT doc_id, line_no, {T.readability_counts_sql("line")} FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS line_no FROM (SELECT doc_id, {T.lines_sql("text")} AS ls FROM documents))))""",
)
def readability_gate(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(T.lines("text")).alias("line_no", "line"))
    r = rows.select("doc_id", F.col("line_no").cast("bigint"), T.readability("line").alias("r"))
    return r.select("doc_id", "line_no", ((F.col("r.letter_digit_ratio") >= 0.55) & (F.col("r.word_score") >= 0.5) & (F.col("r.replacement_ratio") <= 0.05)).alias("readable"))


@query("cleanup_text", f"SELECT doc_id, {T.cleanup_sql('noisy')} AS clean FROM (SELECT doc_id, {NOISE} AS noisy FROM documents)")
def cleanup_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.cleanup(_noisy()).alias("clean"))


_MARKDOWN = "concat('# ', n_name, chr(10), chr(10), '| *key* | name |', chr(10), '|---|:--|', chr(10), '| ', n_nationkey, ' | [', n_name, '](http://x/', n_nationkey, ') |', chr(10), '|| ', n_regionkey, ' |', chr(13), chr(10), '## `', n_name, '` ~~old~~', chr(10), '![pic](y.png) __', n_name, '__', chr(10))"


@query("markdown_to_text", f"SELECT n_nationkey, {T.markdown_to_text_sql('m')} AS plain FROM (SELECT n_nationkey, {_MARKDOWN} AS m FROM nation)")
def markdown_to_text(spark, d):
    return table(spark, d, "nation").select("n_nationkey", T.markdown_to_text(F.expr(_MARKDOWN)).alias("plain"))


@query("markdown_documents", f"SELECT doc_id, {T.markdown_to_text_sql('m')} AS plain FROM (SELECT doc_id, concat('## ', replace(text, '. ', '.' || chr(10) || '| **')) AS m FROM documents)")
def markdown_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", T.markdown_to_text(F.expr("concat('## ', replace(text, '. ', '.' || chr(10) || '| **'))")).alias("plain"))


@query("joined_markdown", "SELECT conv_id, array_to_string(list(trim(array_to_string([role, text], chr(10)), chr(10) || ' ') ORDER BY turn), chr(10) || chr(10)) AS markdown FROM conversations GROUP BY conv_id")
def joined_markdown(spark, d):
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda p: F.array(p["role"], p["text"]))
    return table(spark, d, "conversations").groupBy("conv_id").agg(parts.alias("p")).select("conv_id", T.joined_markdown("p").alias("markdown"))


@query("prompt", f"SELECT event_id, CASE WHEN trim(p) = '' THEN '{T.DEFAULT_PROMPT}' ELSE p END AS prompt FROM (SELECT event_id, CASE WHEN event_type = 'view' THEN '  ' ELSE event_type || ' ' END AS p FROM events)")
def prompt(spark, d):
    return table(spark, d, "events").select("event_id", T.prompt(F.when(F.col("event_type") == "view", "  ").otherwise(F.concat("event_type", F.lit(" ")))).alias("prompt"))


_CHECKS = [("a", "contains", "the", []), ("b", "contains_any", None, ["worthless", "ción", "ung."]), ("c", "min_length", "1000", [])]


@query(
    "text_checks",
    "SELECT doc_id, unnest(['a', 'b', 'c']) AS assertion, unnest([contains(text, 'the'), contains(text, 'worthless') OR contains(text, 'ción') OR contains(text, 'ung.'), length(text) >= 1000]) AS passed FROM documents",
)
def text_checks(spark, d):
    rules = spark.createDataFrame(_CHECKS, "assertion string, kind string, value string, options array<string>")
    return table(spark, d, "documents").crossJoin(F.broadcast(rules)).select("doc_id", "assertion", T.checks("text", "kind", "value", "options").alias("passed"))


# --- codes ------------------------------------------------------------------------------------------------------

_SUFFIX = "CASE page_id % 7 WHEN 0 THEN '.PDF' WHEN 1 THEN '.Jpeg' WHEN 2 THEN '.tar.gz' WHEN 3 THEN '/.pdf' WHEN 4 THEN '.heic' WHEN 5 THEN '' ELSE '.pdf' END"
_IMAGES = ", ".join(f"'{s}'" for s in C.IMAGE_SUFFIXES)


@query("classify_input", f"SELECT page_id, CASE WHEN s = '.pdf' THEN 'pdf' WHEN s IN ({_IMAGES}) THEN 'image' ELSE 'unsupported' END AS input_type FROM (SELECT page_id, lower(regexp_extract(url || {_SUFFIX}, '[^/](\\.[^./]+)$', 1)) AS s FROM pages)")
def classify_input(spark, d):
    return table(spark, d, "pages").select("page_id", C.classify(F.expr(f"url || {_SUFFIX}")).alias("input_type"))


def _case(x: str, table_: dict[str, str], default: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table_.items()) + f" ELSE {default} END"


_SCRIPTS = "CASE lang WHEN 'en' THEN 'Latin' WHEN 'de' THEN 'Cyrillic ' WHEN 'fr' THEN 'Han' ELSE 'Runic' END"


@query("script_lang", f"SELECT doc_id, CASE WHEN (doc_id % 4) * 0.5 >= 1.0 AND l <> 'eng' THEN l || '+eng' ELSE 'eng' END AS ocr_lang FROM (SELECT doc_id, {_case(f'lower(trim({_SCRIPTS}))', C.SCRIPT_LANG, chr(39) + 'eng' + chr(39))} AS l FROM documents)")
def script_lang(spark, d):
    return table(spark, d, "documents").select("doc_id", C.script_lang(F.expr(_SCRIPTS), F.expr("(doc_id % 4) * 0.5")).alias("ocr_lang"))


_LANGS = "CASE lang WHEN 'en' THEN ' ENG ' WHEN 'de' THEN 'deu+eng' WHEN 'fr' THEN 'fra' ELSE 'auto' END"


@query("paddle_lang", f"SELECT doc_id, {_case(f'lower(trim(split_part({_LANGS}, chr(43), 1)))', C.PADDLE_LANG, chr(39) + 'en' + chr(39))} AS paddle_lang FROM documents")
def paddle_lang(spark, d):
    return table(spark, d, "documents").select("doc_id", C.paddle_lang(F.expr(_LANGS)).alias("paddle_lang"))


_KIND = "CASE WHEN doc_id % 3 = 0 THEN 'image' ELSE 'pdf' END"


@query("auto_dpi", f"SELECT doc_id, CASE WHEN k = 'image' OR w > 1000 THEN 150 WHEN w > 700 THEN 200 ELSE 300 END AS dpi FROM (SELECT doc_id, coalesce(nullif(n_chars % 1400, 0), 595) AS w, {_KIND} AS k FROM documents)")
def auto_dpi(spark, d):
    return table(spark, d, "documents").select("doc_id", C.auto_dpi(F.expr("nullif(n_chars % 1400, 0)"), F.expr(_KIND)).alias("dpi"))


@query("preprocess_level", f"SELECT doc_id, CASE WHEN l <> 'auto' THEN l WHEN k = 'image' THEN 'none' WHEN o AND e THEN 'enhanced' ELSE 'basic' END AS preprocess FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'deskew' ELSE 'auto' END AS l, {_KIND} AS k, n_chars < 2000 AS o, doc_id % 2 = 0 AS e FROM documents)")
def preprocess_level(spark, d):
    return table(spark, d, "documents").select("doc_id", C.preprocess_level(F.expr("CASE WHEN doc_id % 5 = 0 THEN 'deskew' ELSE 'auto' END"), F.expr(_KIND), F.expr("n_chars < 2000"), F.expr("doc_id % 2 = 0")).alias("preprocess"))


@query("media_type", "SELECT vec_id, CASE vec_id % 4 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/webp' ELSE 'image/png' END AS media_type FROM embeddings")
def media_type(spark, d):
    head = F.expr("CASE vec_id % 4 WHEN 0 THEN X'FFD8FFE000104A4649460001' WHEN 1 THEN X'89504E470D0A1A0A0000000D' WHEN 2 THEN X'524946460000000057454250' ELSE X'524946460000000041564920' END")
    return table(spark, d, "embeddings").select("vec_id", C.media_type(head).alias("media_type"))


@query("page_base64", "SELECT doc_id, to_base64(encode(text)) AS data FROM documents")
def page_base64(spark, d):
    return table(spark, d, "documents").select("doc_id", C.page_base64(F.encode("text", "utf-8")).alias("data"))


_KEY = "concat_ws('|', '/in/' || doc_id || '.pdf', '1.5', n_chars, 'tesseract', 300, 'basic', lang, 'pages=all', 'schema=3')"


@query("cache_key", f"SELECT doc_id, sha1({_KEY} || CASE WHEN doc_id % 2 = 0 THEN '|engine_context=' || source ELSE '' END) AS cache_key FROM documents")
def cache_key(spark, d):
    context = F.when(F.col("doc_id") % 2 == 0, F.col("source"))
    return table(spark, d, "documents").select("doc_id", C.cache_key(F.expr("'/in/' || doc_id || '.pdf'"), F.lit("1.5"), "n_chars", F.lit("tesseract"), F.lit(300), F.lit("basic"), "lang", F.lit("all"), context).alias("cache_key"))


@query("workflow_key", """SELECT doc_id, sha1('{"lang":"' || lang || '","n_chars":' || n_chars || ',"source":"' || source || '"}') AS workflow_key FROM documents""")
def workflow_key(spark, d):
    return table(spark, d, "documents").select("doc_id", C.workflow_key("source", "lang", "n_chars").alias("workflow_key"))


@query("poly_bbox", "SELECT l_orderkey, l_linenumber, l_quantity::INT AS bbox_left, least(l_quantity::INT, l_linenumber) AS bbox_top, l_partkey::INT AS width, abs(l_linenumber - l_quantity::INT) AS height FROM lineitem")
def poly_bbox(spark, d):
    x, y = F.col("l_quantity"), F.col("l_linenumber").cast("double")
    poly = F.array(F.array(x + 0.25, y), F.array(x + F.col("l_partkey"), x))
    b = C.poly_bbox(poly)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", b[0].alias("bbox_left"), b[1].alias("bbox_top"), b[2].alias("width"), b[3].alias("height"))


# --- page sets --------------------------------------------------------------------------------------------------

_SPEC = "CASE conv_id % 6 WHEN 0 THEN '1-3,5' WHEN 1 THEN '3-1,2' WHEN 2 THEN '2, 2 ,1' WHEN 3 THEN '4-99' WHEN 4 THEN '1' ELSE '' END"
_SPEC_PAGES = "CASE conv_id % 6 WHEN 0 THEN [1, 2, 3, 5] WHEN 1 THEN [2] WHEN 2 THEN [2, 2, 1] WHEN 3 THEN range(4, 100) WHEN 4 THEN [1] END"


@query("page_range", f"SELECT conv_id, unnest(list_filter({_SPEC_PAGES}, lambda n: n <= total))::INT AS n FROM (SELECT conv_id, count(*) AS total FROM conversations GROUP BY conv_id)")
def page_range(spark, d):
    files = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").cast("int").alias("total"))
    return files.where(F.expr(_SPEC) != "").select("conv_id", F.explode(pagesets.parse_range(F.expr(_SPEC), "total")).alias("n"))


@query("page_cap", "SELECT conv_id, unnest(CASE WHEN conv_id % 3 = 0 THEN [1, 1, 1][:2] WHEN conv_id % 3 = 1 THEN range(1, least(total, 2) + 1) ELSE range(1, total + 1) END)::INT AS n FROM (SELECT conv_id, count(*) AS total FROM conversations GROUP BY conv_id)")
def page_cap(spark, d):
    files = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").cast("int").alias("total"))
    spec, most = F.expr("CASE WHEN conv_id % 3 = 0 THEN '1,1-1,1' ELSE '' END"), F.expr("CASE WHEN conv_id % 3 = 2 THEN 0 ELSE 2 END")
    return files.select("conv_id", F.explode(pagesets.selected(pagesets.resolve_range(spec, "total", most), "total")).alias("n"))


# --- probe ------------------------------------------------------------------------------------------------------


def conversation_pages(spark, d) -> DataFrame:
    return table(spark, d, "conversations").select(F.expr("'conv/' || conv_id || '.pdf'").alias("path"), F.col("conv_id"), (F.col("turn") + 1).cast("int").alias("n"), "text", "role")


PAGES_SQL = f"SELECT 'conv/' || conv_id || '.pdf' AS path, conv_id, (turn + 1)::INT AS n, text, role, {T.nonspace_bytes_sql('text')} AS chars FROM conversations"


@query("median_density", f"WITH p AS ({PAGES_SQL}) SELECT path, count(*)::INT AS pages, (list(chars ORDER BY chars))[count(*) // 2 + 1]::BIGINT AS median_chars FROM p GROUP BY path")
def median_density(spark, d):
    return probe.files(conversation_pages(spark, d)).select("path", "pages", "median_chars")


SAMPLE_SQL = f"SELECT path, {T.strip_sql('array_to_string(list(text ORDER BY chars DESC, n), chr(10))')} AS sample FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY chars DESC, n) AS r FROM ({PAGES_SQL})) WHERE r <= 3 GROUP BY path"


@query("densest_sample", SAMPLE_SQL)
def densest_sample(spark, d):
    return probe.files(conversation_pages(spark, d)).select("path", "sample")


_SIGNALS = {"encrypted": "conv_id % 11 = 0", "total_fonts": "CASE WHEN conv_id % 7 = 0 THEN NULL ELSE (conv_id % 5)::INT END", "non_unicode_fonts": "CASE WHEN conv_id % 7 = 0 THEN NULL ELSE least(conv_id % 5, conv_id % 3)::INT END", "image_count": "(conv_id % 9)::INT", "smask_count": "(conv_id % 6)::INT"}


def _signals(spark, d) -> DataFrame:
    files = conversation_pages(spark, d).select("path", "conv_id").distinct()
    return files.select("path", *(F.expr(v).alias(k) for k, v in _SIGNALS.items()))


_PLAIN = "regexp_replace(regexp_replace(({x})::DECIMAL(5,4)::VARCHAR, '(\\.\\d*?)0+$', '\\1'), '\\.$', '.0')"
PROBE_SQL = f"""WITH p AS ({PAGES_SQL}),
f AS (SELECT path, min(conv_id) AS conv_id, count(*)::INT AS pages, (list(chars ORDER BY chars))[count(*) // 2 + 1]::BIGINT AS median_chars FROM p GROUP BY path),
s AS (SELECT f.*, sample, {", ".join(f"{v} AS {k}" for k, v in _SIGNALS.items())} FROM f JOIN ({SAMPLE_SQL}) USING (path)),
r AS (SELECT *, {_RATIOS} FROM (SELECT s.*, {T.readability_counts_sql("sample")} FROM s)),
q AS (SELECT *, total_fonts IS NOT NULL AND (total_fonts = 0 OR non_unicode_fonts > 0) AS suspected, smask_count >= 3 AS covered, median_chars >= 30 AS dense,
  sample = '' OR (letter_digit_ratio >= 0.55 AND word_score >= 0.5 AND replacement_ratio <= 0.05) AS good FROM r),
u AS (SELECT *, NOT encrypted AND dense AND good AND NOT (suspected AND covered) AS usable, NOT encrypted AND dense AND NOT good AS rejected FROM q)
SELECT path, pages, median_chars, CASE WHEN encrypted THEN 'blocked' ELSE 'ready' END AS status, usable AS has_text_layer, NOT encrypted AND NOT usable AS needs_ocr, rejected AS text_layer_rejected,
suspected AS suspected_rasterized_text, covered AS high_image_coverage, CASE WHEN total_fonts > 0 THEN round((total_fonts - non_unicode_fonts) / total_fonts, 4) END AS font_unicode_coverage,
concat_ws('; ', CASE WHEN encrypted THEN 'PDF is encrypted; decrypt it before processing' WHEN usable THEN 'median ' || median_chars || ' chars/page; usable text layer'
  WHEN rejected THEN 'unreadable text layer (letters=' || {_PLAIN.format(x="letter_digit_ratio")} || ', words=' || {_PLAIN.format(x="word_score")} || ', repl=' || {_PLAIN.format(x="replacement_ratio")} || ')'
  ELSE 'median ' || median_chars || ' non-space chars/page (threshold: 30)' END,
  CASE WHEN rejected AND total_fonts > 0 AND non_unicode_fonts = total_fonts THEN 'all fonts non-Unicode (no ToUnicode map)' END,
  CASE WHEN suspected THEN CASE WHEN total_fonts = 0 THEN 'no fonts found' ELSE non_unicode_fonts || '/' || total_fonts || ' fonts non-Unicode' END END,
  CASE WHEN covered THEN smask_count || ' image masks detected' END) AS reason FROM u"""
_PROBE_COLUMNS = ["path", "pages", "median_chars", "status", "has_text_layer", "needs_ocr", "text_layer_rejected", "suspected_rasterized_text", "high_image_coverage", "font_unicode_coverage", "reason"]


@query("probe_decision", PROBE_SQL)
def probe_decision(spark, d):
    return probe.probe_pdfs(conversation_pages(spark, d), _signals(spark, d)).select(_PROBE_COLUMNS)


_GARBLED = "regexp_replace(text, '[aeiou]', '#{')"


@query("probe_garbled", PROBE_SQL.replace("n, text, role", f"n, regexp_replace(text, '[aeiou]', '#{{', 'g') AS text, role").replace(T.nonspace_bytes_sql("text"), T.nonspace_bytes_sql("regexp_replace(text, '[aeiou]', '#{', 'g')")))
def probe_garbled(spark, d):
    pages = conversation_pages(spark, d).withColumn("text", F.regexp_replace("text", "[aeiou]", "#{"))
    return probe.probe_pdfs(pages, _signals(spark, d)).select(_PROBE_COLUMNS)


@query("probe_inputs", "SELECT 'scan/' || page_id || '.png' AS path, 'image' AS input_type, 1 AS pages, true AS needs_ocr, 'ready' AS status FROM pages UNION ALL SELECT path, 'pdf', pages, needs_ocr, status FROM (" + PROBE_SQL.replace(_SIGNALS["encrypted"] + " AS", "false AS").replace(_SIGNALS["total_fonts"], "NULL::INT").replace(_SIGNALS["non_unicode_fonts"], "NULL::INT").replace(_SIGNALS["smask_count"] + " AS", "NULL::INT AS").replace("smask_count >= 3 AS covered", "false AS covered") + ")")
def probe_inputs(spark, d):
    pages = conversation_pages(spark, d).select("path", "n", "text")
    paths = pages.select("path").distinct().unionByName(table(spark, d, "pages").select(F.expr("'scan/' || page_id || '.png'").alias("path")))
    return probe.probe_inputs(paths, pages).select("path", "input_type", "pages", "needs_ocr", "status")


_LISTING = "concat('name type encoding emb sub uni object', chr(10), '----', chr(10), array_join(transform(sequence(1, 1 + doc_id % 4), i -> concat('F', i, ' Type1 Custom yes yes ', CASE WHEN (doc_id + i) % 3 = 0 THEN 'No' ELSE 'yes' END, ' 1 0')), chr(10)), chr(10))"


@query("font_signals", "SELECT doc_id, (1 + doc_id % 4)::INT AS total_fonts, len(list_filter(range(1, 2 + doc_id % 4), lambda i: (doc_id + i) % 3 = 0))::INT AS non_unicode_fonts FROM documents")
def font_signals(spark, d):
    return table(spark, d, "documents").select("doc_id", probe.font_signals(F.expr(_LISTING)).alias("s")).select("doc_id", "s.*")


_MASKS = "concat('page num type', chr(10), '----', chr(10), array_join(transform(sequence(1, 1 + doc_id % 5), i -> concat('1 ', i, CASE WHEN (doc_id + i) % 2 = 0 THEN ' smask' ELSE ' image' END)), chr(10)), chr(10))"


@query("mask_signals", "SELECT doc_id, (1 + doc_id % 5)::INT AS image_count, len(list_filter(range(1, 2 + doc_id % 5), lambda i: (doc_id + i) % 2 = 0))::INT AS smask_count FROM documents")
def mask_signals(spark, d):
    return table(spark, d, "documents").select("doc_id", probe.mask_signals(F.expr(_MASKS)).alias("s")).select("doc_id", "s.*")


@query("document_info", "SELECT doc_id, (1 + doc_id % 9)::INT AS pages, doc_id % 2 = 0 AS encrypted FROM documents")
def document_info(spark, d):
    text = F.expr("concat('Title: x', chr(10), 'Pages:          ', 1 + doc_id % 9, chr(10), 'Encrypted:      ', CASE WHEN doc_id % 2 = 0 THEN 'yes (print:yes)' ELSE 'no' END, chr(10))")
    return table(spark, d, "documents").select("doc_id", probe.document_info(text).alias("i")).select("doc_id", "i.*")


@query("skip_ocr_rows", f"WITH d AS ({PROBE_SQL}) SELECT path, unnest(range(1, pages + 1))::INT AS n, 'skipped' AS source, true AS skipped FROM d WHERE needs_ocr")
def skip_ocr_rows(spark, d):
    return pagesets.skipped_rows(probe.probe_pdfs(conversation_pages(spark, d), _signals(spark, d))).select("path", "n", "source", "skipped")


@query("text_layer_pages", f"WITH d AS ({PROBE_SQL}) SELECT path, n, 'text_layer' AS source, 100.0::DOUBLE AS mean_conf, {T.cleanup_sql('text')} AS text FROM ({PAGES_SQL}) JOIN d USING (path) WHERE has_text_layer")
def text_layer_pages(spark, d):
    from .recognize import text_layer_branch

    pages = conversation_pages(spark, d).select("path", "n", "text")
    return text_layer_branch(pages, probe.probe_pdfs(pages, _signals(spark, d))).select("path", "n", "source", "mean_conf", "text")


# --- words ------------------------------------------------------------------------------------------------------

_CONF, _LEFT, _TOP = "(conv_id * 7 + n * 13 + i * 29) % 101", "(i % (2 + conv_id % 6)) * (40 + (n % 3) * 60)", "12 * (i // (2 + conv_id % 6))"


def with_words(pages: DataFrame) -> DataFrame:
    """Synthetic word boxes: the page's tokens laid out in 2 to 7 columns by id, confidences by id and place."""
    conf, left, top = _CONF, _LEFT, "12 * floor(i / (2 + conv_id % 6))"
    return pages.withColumn("words", F.expr(f"transform(split(text, ' '), (w, i) -> named_struct('text', w, 'conf', CAST({conf} AS INT), 'bbox', array(CAST({left} AS INT), CAST({top} AS INT), 30, 10)))"))


WORDS_SQL = f"SELECT path, conv_id, n, w, i, ({_CONF})::INT AS conf, ({_LEFT})::INT AS l, ({_TOP})::INT AS t FROM (SELECT *, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT *, string_split(text, ' ') AS ws FROM ({PAGES_SQL})))"
CONF_SQL = f"SELECT path, n, coalesce(avg(conf) FILTER (WHERE trim(w) <> ''), 0.0) AS mean_conf, count(*) AS n_words FROM ({WORDS_SQL}) GROUP BY path, n"
TABLE_SQL = f"""SELECT path, n, any_value(c) >= 9 AND count(*) FILTER (WHERE k >= 3 AND m >= 4) >= 3 AS tabular FROM (
SELECT path, n, any_value(c) AS c, t // 10 AS y, count(DISTINCT l // zone) AS k, count(*) AS m FROM (
SELECT *, greatest((max(l) OVER p - min(l) OVER p + 1) // 6, 50) AS zone, count(*) OVER p AS c FROM ({WORDS_SQL}) WINDOW p AS (PARTITION BY path, n)) GROUP BY path, n, y) GROUP BY path, n"""


@query("mean_conf", f"SELECT path, n, round(mean_conf, 6) AS mean_conf FROM ({CONF_SQL})")
def mean_conf(spark, d):
    return with_words(conversation_pages(spark, d)).select("path", "n", F.round(quality.mean_conf("words"), 6).alias("mean_conf"))


@query("looks_tabular", TABLE_SQL)
def looks_tabular(spark, d):
    return with_words(conversation_pages(spark, d)).select("path", "n", geometry.looks_tabular("words").alias("tabular"))


@query("reading_order", f"SELECT path, n, array_to_string(list(w ORDER BY t, l, i), '|') AS words FROM ({WORDS_SQL}) GROUP BY path, n")
def reading_order(spark, d):
    shuffled = F.reverse("words")  # ties are unique here, so the order given can't matter
    return with_words(conversation_pages(spark, d)).select("path", "n", F.array_join(F.transform(geometry.reading_order(shuffled), lambda w: w["text"]), "|").alias("words"))


FLAG_SQL = f"SELECT path, n, mean_conf, n_words, tabular, concat_ws(',', CASE WHEN mean_conf < 60 THEN 'low_confidence' END, CASE WHEN tabular THEN 'table_like_unstructured' END) AS issues FROM ({CONF_SQL}) JOIN ({TABLE_SQL}) USING (path, n)"


@query("quality_issues", f"SELECT path, n, issues, CASE WHEN issues <> '' THEN 'review-vision' END AS flag FROM ({FLAG_SQL})")
def quality_issues(spark, d):
    got = with_words(conversation_pages(spark, d)).withColumn("issues", quality.issues(quality.mean_conf("words"), "words"))
    return got.select("path", "n", F.array_join("issues", ",").alias("issues"), quality.flag("issues").alias("flag"))


@query("stamped_issues", f"SELECT path, n, concat_ws(',', nullif(issues, ''), CASE WHEN n % 2 = 0 THEN 'text_layer_rejected' END) AS issues, CASE WHEN issues <> '' THEN issues ELSE '' END AS reasons FROM ({FLAG_SQL})")
def stamped_issues(spark, d):
    got = with_words(conversation_pages(spark, d)).withColumn("conf", quality.mean_conf("words")).withColumn("issues", quality.issues("conf", "words"))
    reasons = quality.flag_reasons(F.array().cast("array<string>"), "conf", "words", quality.flag("issues"))
    return got.select("path", "n", F.array_join(quality.stamp_rejected("issues", F.expr("n % 2 = 0")), ",").alias("issues"), F.array_join(reasons, ",").alias("reasons"))


@query("tsv_words", f"SELECT path, n, count(*) FILTER (WHERE trim(w) <> '') AS words, coalesce(round(avg(conf) FILTER (WHERE trim(w) <> ''), 6), 0.0) AS mean_conf, coalesce(sum(l) FILTER (WHERE trim(w) <> ''), 0)::BIGINT AS lefts FROM ({WORDS_SQL.replace('string_split(text', chr(115) + 'tring_split(replace(text, chr(10), chr(32))')}) GROUP BY path, n")
def tsv_words(spark, d):
    pages = with_words(conversation_pages(spark, d).withColumn("text", F.expr("replace(text, chr(10), ' ')")))
    line = lambda w: F.concat_ws("\t", *[F.lit("5")] * 6, *(w["bbox"][i].cast("string") for i in range(4)), w["conf"].cast("string"), w["text"])
    tsv = F.concat(F.lit("head\n"), F.array_join(F.transform("words", line), "\n"), F.lit("\nshort\trow\n"))
    got = pages.select("path", "n", tsv.alias("tsv")).select("path", "n", geometry.tsv_words("tsv").alias("w"), F.round(geometry.tsv_mean("tsv"), 6).alias("mean_conf"))
    return got.select("path", "n", F.size("w").cast("bigint").alias("words"), "mean_conf", F.aggregate("w", F.lit(0).cast("bigint"), lambda a, w: a + w["bbox"][0]).alias("lefts"))


@query("line_words", f"SELECT path, n, array_to_string(list(w ORDER BY t, l, i) FILTER (WHERE trim(w) <> ''), '|') AS words, coalesce(round(avg(conf) FILTER (WHERE trim(w) <> ''), 6), 0.0) AS mean_conf FROM ({WORDS_SQL}) GROUP BY path, n")
def line_words(spark, d):
    got = with_words(conversation_pages(spark, d))
    texts, scores = F.transform("words", lambda w: w["text"]), F.transform("words", lambda w: w["conf"] / F.lit(100.0))
    polys = F.transform("words", lambda w: F.array(F.array(w["bbox"][0], w["bbox"][1]), F.array(w["bbox"][0] + 30, w["bbox"][1] + 10)))
    got = got.select("path", "n", texts.alias("t"), scores.alias("s"), polys.alias("p"))
    return got.select("path", "n", F.nullif(F.array_join(F.transform(geometry.line_words("t", "s", "p"), lambda w: w["text"]), "|"), F.lit("")).alias("words"), F.round(geometry.line_mean("t", "s"), 6).alias("mean_conf"))


# --- escalation -------------------------------------------------------------------------------------------------

_ENGINES = ["tesseract", "vision", "easyocr", "paddleocr"]
_ATTEMPTS = """SELECT 'conv/' || conv_id || '.pdf' AS path, (turn + 1)::INT AS n, i::INT AS i, CASE (i + CASE WHEN i > 0 THEN conv_id % 3 ELSE 0 END) % 4 WHEN 0 THEN CASE WHEN i = 0 THEN 'tesseract' ELSE 'paddleocr' END WHEN 1 THEN 'vision' WHEN 2 THEN 'easyocr' ELSE 'paddleocr-vl-mlx' END AS engine,
CASE WHEN (conv_id + turn * 3 + i * 5) % 4 < 2 THEN 'review-vision' END AS flag, CASE WHEN (conv_id + i) % 7 = 0 THEN NULL ELSE ((conv_id * 7 + turn * 13 + i * 31) % 101)::DOUBLE END AS mean_conf, ((turn * 17 + i * 3) % 50)::INT AS n_words
FROM conversations, (SELECT unnest([0, 1, 2, 3]) AS i)"""


def attempts(spark, d) -> DataFrame:
    sql = _ATTEMPTS.replace("FROM conversations, (SELECT unnest([0, 1, 2, 3]) AS i)", "").replace("SELECT ", "", 1)
    base = table(spark, d, "conversations").withColumn("i", F.explode(F.array(*map(F.lit, range(4)))))
    parts, depth, at = [], 0, 0
    for p, ch in enumerate(sql):  # the select list, parted at its outer commas
        depth += ch == "("
        depth -= ch == ")"
        if ch == "," and not depth:
            parts.append(sql[at:p])
            at = p + 1
    return base.selectExpr(*parts, sql[at:])


_SELECT_SQL = f"""WITH a AS ({_ATTEMPTS}), s AS (SELECT *, engine IN ('vision', 'paddleocr-vl-mlx') AS st, {{'ok': flag IS NULL, 'c': coalesce(mean_conf, 0.0), 'w': n_words}} AS score FROM a),
b AS (SELECT *, max(CASE WHEN NOT st OR i = 0 THEN score END) OVER (PARTITION BY path, n ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM s)"""


@query("escalation_select", f"{_SELECT_SQL} SELECT path, n, max(i) FILTER (WHERE i = 0 OR st OR score > best) AS selected_i, arg_max(engine, i) FILTER (WHERE i = 0 OR st OR score > best) AS selected FROM b GROUP BY path, n")
def escalation_select(spark, d):
    return escalate.select(attempts(spark, d), ["path", "n"]).select("path", "n", "selected_i", "selected")


@query("escalation_decision", f"{_SELECT_SQL} SELECT path, n, arg_min(engine, i) AS baseline, array_to_string(list(engine || ':' || coalesce(mean_conf::INT::VARCHAR, '') ORDER BY i), ',') AS attempts FROM b GROUP BY path, n")
def escalation_decision(spark, d):
    tried = F.array_join(F.transform("attempts", lambda a: F.concat(a["engine"], F.lit(":"), F.coalesce(a["mean_conf"].cast("int").cast("string"), F.lit("")))), ",")
    return escalate.select(attempts(spark, d), ["path", "n"]).select("path", "n", "baseline", tried.alias("attempts"))


@query("merge_selected", f"{_SELECT_SQL}, p AS (SELECT path, n, max(i) FILTER (WHERE i = 0 OR st OR score > best) AS i FROM b GROUP BY path, n) SELECT path, n, b.engine AS source, b.mean_conf FROM b JOIN p USING (path, n, i)")
def merge_selected(spark, d):
    tried = attempts(spark, d)
    base = tried.where("i = 0").select("path", "n", F.col("engine").alias("source"), "mean_conf", "flag")
    chosen = escalate.select(tried, ["path", "n"]).select("path", "n", F.col("selected_i").alias("i")).join(tried, ["path", "n", "i"]).withColumn("source", F.col("engine"))
    return escalate.merge_selected(base, chosen, ["path", "n"], ["source", "mean_conf"]).select("path", "n", "source", "mean_conf")


@query("better_retry", "SELECT path, n, b.n_words > a.n_words OR (b.n_words > 0 AND b.c > a.c + 5) AS retry FROM (SELECT path, n, n_words, coalesce(mean_conf, 0.0) AS c FROM (%s) WHERE i = 0) a JOIN (SELECT path, n, n_words, coalesce(mean_conf, 0.0) AS c FROM (%s) WHERE i = 2) b USING (path, n)" % (_ATTEMPTS, _ATTEMPTS))
def better_retry(spark, d):
    words = F.array_repeat(F.lit("w"), F.col("n_words"))
    got = attempts(spark, d).groupBy("path", "n").agg(*(F.max(F.when(F.col("i") == k, F.struct(F.coalesce("mean_conf", F.lit(0.0)).alias("c"), words.alias("w")))).alias(f"a{k}") for k in (0, 2)))
    return got.select("path", "n", geometry.better_retry("a0.c", "a0.w", "a2.c", "a2.w").alias("retry"))


# --- cache ------------------------------------------------------------------------------------------------------

_CACHED = "SELECT doc_id FROM documents WHERE n_chars < 2000"


@query("cache_misses", f"SELECT doc_id FROM documents WHERE doc_id NOT IN ({_CACHED})")
def cache_misses(spark, d):
    docs = table(spark, d, "documents").withColumn("key", F.sha1(F.col("doc_id").cast("string")))
    kept = docs.where("n_chars < 2000").select("key", F.col("source").alias("pages"))
    return cache.misses(docs.select("doc_id", "key"), kept).select("doc_id")


@query("cache_hits", "SELECT doc_id, source AS pages FROM documents WHERE n_chars < 2000")
def cache_hits(spark, d):
    docs = table(spark, d, "documents").withColumn("key", F.sha1(F.col("doc_id").cast("string")))
    kept = docs.where("n_chars < 2000").select("key", F.col("source").alias("pages"))
    return cache.hits(docs.select("doc_id", "key"), kept).select("doc_id", "pages")


# --- documents --------------------------------------------------------------------------------------------------

_BODY = T.strip_sql("text")


@query("doc_markdown", f"SELECT path, '# ' || conv_id || '.pdf' || chr(10) || chr(10) || array_to_string(list('## Page ' || n || chr(10) || chr(10) || {_BODY} || chr(10) ORDER BY n), chr(10)) AS markdown FROM ({PAGES_SQL}) GROUP BY path, conv_id")
def doc_markdown(spark, d):
    return render.to_markdown(conversation_pages(spark, d))


@query("doc_markdown_whole", f"SELECT 'doc/' || doc_id AS path, '# ' || doc_id || chr(10) || chr(10) || {_BODY} || chr(10) AS markdown FROM documents")
def doc_markdown_whole(spark, d):
    docs = table(spark, d, "documents").select(F.expr("'doc/' || doc_id").alias("path"), F.lit(0).alias("n"), "text")
    return render.to_markdown(docs)


@query("doc_text", f"SELECT path, array_to_string(list('----- Page ' || n || ' -----' || chr(10) || {_BODY} || chr(10) ORDER BY n), chr(10)) AS text FROM ({PAGES_SQL}) GROUP BY path")
def doc_text(spark, d):
    return render.to_text(conversation_pages(spark, d))


def _flagged(spark, d) -> DataFrame:
    got = with_words(conversation_pages(spark, d)).withColumn("conf", quality.mean_conf("words"))
    return got.select("path", "n", F.round("conf", 1).alias("mean_conf"), quality.flag(quality.issues("conf", "words")).alias("flag"), "text")


@query("doc_report", f"SELECT path, count(*)::INT AS total_pages, array_to_string(list(n ORDER BY n) FILTER (WHERE round(mean_conf, 1) < 60), ',') AS low_conf_pages, array_to_string(list(n ORDER BY n) FILTER (WHERE issues <> ''), ',') AS recommend_vision FROM ({FLAG_SQL}) GROUP BY path")
def doc_report(spark, d):
    got = render.report(_flagged(spark, d))
    return got.select("path", "total_pages", *(F.nullif(F.array_join(F.col(c).cast("array<string>"), ","), F.lit("")).alias(c) for c in ("low_conf_pages", "recommend_vision")))


_LIST = "coalesce(string_agg(n::VARCHAR, ',' ORDER BY n) FILTER (WHERE {}), '')"
_PAGE_JSON = """'{"n":' || n || ',"mean_conf":' || to_json(round(mean_conf, 1)) || CASE WHEN issues <> '' THEN ',"flag":"review-vision"' ELSE '' END || ',"text":' || to_json(text) || '}'"""


@query(
    "doc_json",
    f"""SELECT path, '{{"file":' || to_json(path) || ',"engine":"tesseract","lang":"eng","dpi":300,"preprocess":"auto","pages":[' || string_agg({_PAGE_JSON}, ',' ORDER BY n)
|| '],"report":{{"total_pages":' || count(*) || ',"low_conf_pages":[' || {_LIST.format("round(mean_conf, 1) < 60")} || '],"recommend_vision":[' || {_LIST.format("issues <> ''")} || ']}}}}' AS json
FROM ({FLAG_SQL}) JOIN (SELECT path, n, text FROM ({PAGES_SQL})) USING (path, n) GROUP BY path""",
)
def doc_json(spark, d):
    return render.to_json(_flagged(spark, d), {"engine": "tesseract", "lang": "eng", "dpi": 300})


@query("doc_totals", "SELECT 'conv/' || conv_id || '.pdf' AS path, count(*) AS pages, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id")
def doc_totals(spark, d):
    return render.totals(conversation_pages(spark, d))


@query("manifest", f"SELECT path, 'Pages to be read by eye' || chr(10) || chr(10) || 'Prompt:' || chr(10) || '{T.DEFAULT_PROMPT}' || chr(10) || chr(10) || 'Pages:' || chr(10) || array_to_string(list('  Page ' || n || ': /img/' || n || '.png' ORDER BY n), chr(10)) AS manifest FROM ({PAGES_SQL}) GROUP BY path")
def manifest(spark, d):
    return render.manifest(conversation_pages(spark, d).withColumn("image", F.expr("'/img/' || n || '.png'")), T.prompt(F.lit("")))


@query("frame_sink", "SELECT user_id, count(*)::INT AS frames, array_to_string(list(event_type || ' ' || props ORDER BY idx), chr(10) || chr(10)) AS text, array_to_string(list('## Frame ' || (idx + 1) || chr(10) || chr(10) || '# ' || event_type || chr(10) ORDER BY idx), chr(10) || chr(10)) AS markdown FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events) GROUP BY user_id")
def frame_sink(spark, d):
    from pyspark.sql.window import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    frames = table(spark, d, "events").select("user_id", (F.row_number().over(order) - 1).alias("index"), F.expr("event_type || ' ' || props").alias("text"), F.expr("'# ' || event_type || chr(10)").alias("markdown"))
    return render.frames_document(frames, ["user_id"])


@query("duplicate_stems", "SELECT stem, count(*) AS inputs FROM (SELECT lower(regexp_extract(split_part(url, '?', 1), '([^/#]*?)(\\.[^./#]*)?(#.*)?$', 1)) AS stem FROM pages) GROUP BY stem HAVING count(*) > 1")
def duplicate_stems(spark, d):
    stem = F.lower(F.regexp_extract(F.split("url", r"\?")[0], r"([^/#]*?)(\.[^./#]*)?(#.*)?$", 1))
    return table(spark, d, "pages").groupBy(stem.alias("stem")).agg(F.count("*").alias("inputs")).where("inputs > 1")


@query("ordered_distinct", "SELECT user_id, array_to_string(list(event_type ORDER BY f), ',') AS kinds FROM (SELECT user_id, event_type, min({'t': ts, 'e': event_id}) AS f FROM events GROUP BY user_id, event_type) GROUP BY user_id")
def ordered_distinct(spark, d):
    seen = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda e: e["event_type"])
    return table(spark, d, "events").groupBy("user_id").agg(F.array_join(F.array_distinct(seen), ",").alias("kinds"))


@query("gate_vs_labels", f"SELECT quality, toxic, letter_digit_ratio >= 0.55 AND word_score >= 0.5 AND replacement_ratio <= 0.05 AS readable, count(*) AS documents FROM (SELECT doc_id, {_RATIOS} FROM (SELECT doc_id, {T.readability_counts_sql('text')} FROM documents)) JOIN labels USING (doc_id) GROUP BY ALL")
def gate_vs_labels(spark, d):
    r = readability(spark, d).select("doc_id", ((F.col("letter_digit_ratio") >= 0.55) & (F.col("word_score") >= 0.5) & (F.col("replacement_ratio") <= 0.05)).alias("readable"))
    return r.join(table(spark, d, "labels"), "doc_id").groupBy("quality", "toxic", "readable").agg(F.count("*").alias("documents"))


_STUB_WORDS = f"list_filter(regexp_split_to_array(text, '{T.WS_D}+'), lambda t: t <> '')"
_STUB_CONF = "coalesce(list_avg(list_transform(range(c), lambda k: (31 * k + 7 * n) % 60 + {shift})), 0.0)"
# rows of eleven words, of which five reach the third zone
_STUB_ISSUES = "concat_ws(',', CASE WHEN {conf} < 60 THEN 'low_confidence' END, CASE WHEN c // 11 + (c % 11 >= 5)::INT >= 3 THEN 'table_like_unstructured' END)"
STUB_SQL = f"""WITH d AS ({PROBE_SQL.replace(_SIGNALS["encrypted"] + " AS encrypted", "FALSE AS encrypted")}),
p AS (SELECT path, n, {T.cleanup_sql("text")} AS text, len({_STUB_WORDS})::INT AS c, has_text_layer AS layer, text_layer_rejected AS rejected FROM ({PAGES_SQL}) JOIN d USING (path)),
q AS (SELECT *, {_STUB_CONF.format(shift=25)} AS m0, {_STUB_CONF.format(shift=40)} AS m1 FROM p),
r AS (SELECT *, {_STUB_ISSUES.format(conf="m0")} AS i0, {_STUB_ISSUES.format(conf="m1")} AS i1, NOT layer AND i0 <> '' AS again FROM q)
SELECT path, n, CASE WHEN layer THEN 'text_layer' WHEN again THEN 'stub-clean' ELSE 'stub' END AS source, CASE WHEN layer THEN 100.0 ELSE round(CASE WHEN again THEN m1 ELSE m0 END, 1) END::DOUBLE AS mean_conf,
CASE WHEN again AND i1 <> '' THEN 'review-vision' END AS flag, text, CASE WHEN layer THEN '' ELSE concat_ws(',', CASE WHEN again AND i1 <> '' THEN i1 END, CASE WHEN rejected THEN 'text_layer_rejected' END) END AS issues,
CASE WHEN layer THEN 0 ELSE c END::INT AS n_words, CASE WHEN again THEN 'stub' END AS baseline, CASE WHEN again THEN 'stub-clean' END AS selected, CASE WHEN again THEN i0 END AS reasons,
CASE WHEN again THEN 'stub:completed:' || round(m0 * 10)::INT || ',stub-clean:completed:' || round(m1 * 10)::INT END AS attempts FROM r"""


@query("recognize_stub", STUB_SQL)
def recognize_stub(spark, d):
    """The whole workflow with the stub engine: triage, text layer, recognition, flags, escalation."""
    from .recognize import Options, recognize

    pages = conversation_pages(spark, d).select("path", "n", "text")
    got = recognize(pages, Options(engine="stub", auto_escalate=("stub-clean",)), _signals(spark, d).withColumn("encrypted", F.lit(False)))
    tried = F.transform("decision.attempts", lambda a: F.concat_ws(":", a["engine"], a["status"], F.round(a["mean_conf"] * 10).cast("int").cast("string")))
    return got.select(
        "path", "n", "source", "mean_conf", "flag", "text", F.array_join("issues", ",").alias("issues"), F.size("words").alias("n_words"),
        F.col("decision.baseline").alias("baseline"), F.col("decision.selected").alias("selected"), F.array_join("decision.flag_reason", ",").alias("reasons"), F.array_join(tried, ",").alias("attempts"),
    )
