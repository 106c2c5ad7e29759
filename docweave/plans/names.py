"""Queries of the name rules over words, titles and addresses of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.functions import fixed_values as V
from docweave.functions import names, prompts
from docweave.functions import text as T
from docweave.operators import tables
from docweave.operators.ranking import numbered
from docweave.sources import files

from .base import registry, spread, table

QUERIES, SQL, query = registry()
_HOST = r"^[a-z]+://([^/]+)"
_WAY = r"^[a-z]+://[^/]+(/[^?#]*)"
_ANY = "|".join
_LIST = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _words(spark, sf):
    """(word, n): the words of whole texts, each once."""
    each = spread(table(spark, sf, "documents")).select(F.explode(F.split("text", r"[ \t\n\r\f]+")).alias("word"))
    return each.groupBy("word").agg(F.count("*").alias("n"))


_WORDS = r"w AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '[ \t\n\r\f]+')) AS word FROM documents) GROUP BY 1)"


@query(rf"""
WITH a AS (SELECT url, regexp_extract(url, '{_WAY}', 1) AS way, regexp_extract(url, '{_HOST}', 1) AS host, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages),
n AS (SELECT unnest(['url', 'way', 'host', 'relative', 'up', 'title', 'drive', 'share', 'file']) AS kind,
        unnest([url, way, host || way, substring(way, 2), '..' || way, title, 'C:' || replace(way, '/', chr(92)), '//' || host || way, split_part(title, ' ', 1) || '.pdf']) AS name FROM a),
c AS (SELECT kind, regexp_replace(trim(name), '^["''`]+|["''`]+$', '', 'g') AS c FROM n),
s AS (SELECT *, list_filter(list_transform(regexp_split_to_array(c, '[\\/]+'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM c)
SELECT kind, CASE WHEN c = '' THEN 'empty' WHEN regexp_matches(c, '^[a-zA-Z][a-zA-Z0-9+.-]*://') THEN 'url_scheme_whitelist'
  WHEN regexp_matches(c, '\\\(|\\\)|\\\[|\\\]|\$[^$]+\$') THEN 'math_whitelist' WHEN lower(c) IN {_LIST(V.SLASH_PHRASES)} OR regexp_matches(c, '^[A-Za-z]/[A-Za-z]$') THEN 'slash_phrase_whitelist'
  WHEN regexp_matches(c, '^[A-Za-z]:[\\/]') THEN 'win_abs' WHEN regexp_matches(c, '^(?:\\\\|//)[^\\/\s]+[\\/][^\\/\s]+') THEN 'unc_abs' WHEN starts_with(c, '/') THEN 'posix_abs'
  WHEN regexp_matches(c, '^(?:\.{{1,2}}|~)[\\/]') THEN 'relative_prefix'
  WHEN regexp_matches(c, '[\\/]') AND len(parts) >= 3 AND len(list_filter(parts, lambda x: NOT (x IN ('.', '..', '~') OR (NOT ends_with(x, ':') AND regexp_matches(x, '^[\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}.\- ]+$'))))) = 0 THEN 'relative_multisegment'
  WHEN regexp_matches(c, '(?i)^[^\s\\/]*\.(?:{_ANY(V.FILE_EXTENSIONS)})$') THEN 'bare_filename' ELSE 'not_path' END AS reason, count(*) AS n
FROM s GROUP BY 1, 2""")
def path_reasons(spark, sf):
    """Why addresses of pages, parts of them and titles are paths or not, by what they are."""
    way, host, title = F.regexp_extract("url", _WAY, 1), F.regexp_extract("url", _HOST, 1), F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    of = {
        "url": F.col("url"), "way": way, "host": F.concat(host, way), "relative": way.substr(F.lit(2), F.length(way)), "up": F.concat(F.lit(".."), way), "title": title,
        "drive": F.concat(F.lit("C:"), F.translate(way, "/", "\\")), "share": F.concat(F.lit("//"), host, way), "file": F.concat(F.split_part(title, F.lit(" "), F.lit(1)), F.lit(".pdf")),
    }
    rows = spread(table(spark, sf, "pages")).select(F.explode(F.create_map(*(x for k, c in of.items() for x in (F.lit(k), c)))).alias("kind", "name"))
    return rows.groupBy("kind", names.path_reason(F.col("name")).alias("reason")).agg(F.count("*").alias("n"))


@query(rf"""
WITH {_WORDS}, c AS (SELECT word, n, trim(word) AS c, trim(regexp_replace(trim(word), '(?i)\s*\((?:table|image|equation)\)$', '')) AS bare FROM w),
k AS (SELECT *, trim(regexp_replace(lower(bare), '[\s_-]+', ' ', 'g')) AS key FROM c)
SELECT CASE WHEN word = '' THEN 'empty' WHEN regexp_matches(bare, '(?i){V.LOCATOR_WITH_TITLE}') THEN 'locator_with_semantic_title'
  WHEN regexp_matches(bare, '(?i){V.REFERENCE_BRACKET}') OR regexp_matches(bare, '(?i){V.BARE_LOCATOR}') THEN 'bare_locator_label' WHEN key IN {_LIST(V.LAYOUT_WORDS)} THEN 'layout_metadata'
  WHEN key IN {_LIST(V.AMBIGUOUS_WORDS)} THEN 'ambiguous_reference' WHEN key IN {_LIST(V.NOISE_WORDS)} THEN 'generic_noise' WHEN regexp_matches(c, '(?i)^image(?:_|-)[a-z0-9]{{4,}}$') THEN 'image_stem_no_ext'
  WHEN length(key) <= 2 AND regexp_matches(key, '^\p{{L}}+$') THEN 'short_alpha_noise' ELSE 'ok' END AS reason, CAST(sum(n) AS BIGINT) AS n, count(*) AS words
FROM k GROUP BY 1""")
def name_reasons(spark, sf):
    """Why the words of all texts would be kept as entities or not."""
    return _words(spark, sf).groupBy(names.quality_reason(F.col("word")).alias("reason")).agg(F.sum("n").alias("n"), F.count("*").alias("words"))


@query(rf"""
WITH {_WORDS}, q AS (SELECT word AS raw, n FROM w UNION ALL SELECT '“' || word || '”', n FROM w WHERE contains(word, '.')),
t AS (SELECT raw, n, translate(regexp_replace(raw, '</p\s*>|<p\s*>|<p/>|</br\s*>|<br\s*>|<br/>', '', 'gi'), '{T.WIDE}', '{T.NARROW}') AS a FROM q),
u AS (SELECT raw, n, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(a, '^"([^"]*)"$', '\1'), '^''([^'']*)''$', '\1'), '^“([^“”]*)”$', '\1'), '^‘([^‘’]*)’$', '\1')) AS b FROM t),
r AS (SELECT raw, n, CASE WHEN regexp_matches(b, '^[0-9]{{1,2}}$') OR (regexp_matches(b, '^[0-9.]{{1,5}}$') AND contains(b, '.')) THEN '' ELSE b END AS name FROM u)
SELECT name, count(*) AS spellings, CAST(sum(n) AS BIGINT) AS n FROM r WHERE name <> raw GROUP BY 1""")
def names_normalized(spark, sf):
    """Words of all texts, and those with a point in quotes too, that their surface form differs from: tags, widths, quotes, bare numbers."""
    w = _words(spark, sf)
    raw = w.select(F.col("word").alias("raw"), "n").unionByName(w.where(F.contains("word", F.lit("."))).select(F.concat(F.lit("“"), "word", F.lit("”")).alias("raw"), "n"))
    named = raw.withColumn("name", T.normalize_name(F.col("raw")))
    return named.where("name <> raw").groupBy("name").agg(F.count("*").alias("spellings"), F.sum("n").alias("n"))


@query("""
WITH e AS (SELECT 'json' AS kind, CAST(CAST(props->>'$.k' AS BIGINT) = 1 AS INTEGER) AS score FROM events
  UNION ALL SELECT 'named', CAST(l_linenumber = 1 AS INTEGER) FROM lineitem
  UNION ALL SELECT 'alone', CASE WHEN c_nationkey = 1 THEN 1 ELSE 0 END FROM customer)
SELECT kind, score, count(*) AS n FROM e GROUP BY 1, 2""")
def answer_scores(spark, sf):
    """Zeros and ones of judges' texts, made of columns: JSON, a named number, a number that stands alone."""
    json = table(spark, sf, "events").select(F.lit("json").alias("kind"), F.replace("props", F.lit('"k"'), F.lit('"accuracy"')).alias("text"))
    named = table(spark, sf, "lineitem").select(F.lit("named").alias("kind"), F.concat(F.lit("ACCURACY = "), "l_linenumber", F.lit(" at a discount of "), "l_discount").alias("text"))
    alone = table(spark, sf, "customer").select(F.lit("alone").alias("kind"), F.concat(F.lit("The verdict of "), "c_mktsegment", F.lit(" is "), "c_nationkey").alias("text"))
    every = json.unionByName(named).unionByName(alone)
    return every.groupBy("kind", T.answer_score(F.col("text")).alias("score")).agg(F.count("*").alias("n"))


@query("""
WITH d AS (SELECT doc_id, lang || '.txt' AS name, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 + CAST(lang = 'de' AS INTEGER) AS k, lang FROM documents)
SELECT doc_id, CASE WHEN k = 0 THEN name WHEN k <= 999 THEN lang || '_' || lpad(CAST(k AS VARCHAR), 3, '0') || '.txt' ELSE lang || '_17_' || (k - 999) || '.txt' END AS file_name FROM d""")
def file_names_free(spark, sf):
    """Names of documents by language, made unique as files are: numbers, then the time; one of the names is taken."""
    d = table(spark, sf, "documents").select("doc_id", F.concat("lang", F.lit(".txt")).alias("name"))
    return files.unique_names(d, "name", ["doc_id"], 17, d.where("name = 'de.txt'").select("name").distinct()).select("doc_id", "file_name")


@query("""
WITH s AS (SELECT conv_id, turn, CASE WHEN role = 'user' AND turn > 0 THEN '[image' || sum(CASE WHEN role = 'user' AND turn > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) || ']' ELSE text END AS t FROM conversations)
SELECT conv_id, substring(string_agg(t, chr(10) ORDER BY turn), 1, 400) AS text FROM s GROUP BY 1""")
def document_texts(spark, sf):
    """Conversations as one text each, later turns of users as images, 400 characters at most."""
    c = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("position"), F.when((F.col("role") == "user") & (F.col("turn") > 0), "image").otherwise("text").alias("type"), "text")
    return prompts.document_text(c, 400, "conv_id").select("conv_id", "text")


@query("SELECT name, CAST(row_number() OVER (ORDER BY name COLLATE de) AS INTEGER) AS place FROM (SELECT DISTINCT lower(word) AS name FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM documents)) WHERE length(name) > 12")
def collated_names(spark, sf):
    """Long words of all texts in a language's order."""
    w = spread(table(spark, sf, "documents")).select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"))).alias("w")).select(F.lower("w").alias("name")).where("length(name) > 12").distinct()
    return numbered(w, [tables.collated(F.col("name"), "de"), F.col("name")], "place")
