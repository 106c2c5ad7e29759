"""Queries over strings: ids, cleaning, names, extraction records."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.functions import extraction, names
from docweave.functions import text as T

from .base import registry, spread, table

QUERIES, SQL, query = registry()
_D = "<|#|>"


@query("""
SELECT s_suppkey, 'ent-' || md5(s_name) AS entity_id, 'rel-' || md5(least(s_name, n_name) || greatest(s_name, n_name)) AS relation_id,
       least(s_name, n_name) || '<SEP>' || greatest(s_name, n_name) AS pair_key
FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def md5_ids(spark, sf):
    """Content ids of entities and of pairs in either order."""
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    a, b = F.col("s_name"), F.col("n_name")
    return s.select("s_suppkey", T.content_id("ent-", a).alias("entity_id"), T.pair_id(b, a).alias("relation_id"), T.pair_key(b, a).alias("pair_key"))


@query("""
WITH k AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN event_type ELSE event_type || ':extract:' || md5(CAST(event_id AS VARCHAR)) || ':x' END AS key FROM events)
SELECT split_part(key, ':', 1) AS mode, split_part(key, ':', 2) AS cache_type, count(*) AS n,
       min(split_part(key, ':', 3) || ':x') AS least FROM k WHERE contains(key, ':') GROUP BY ALL""")
def cache_key_parse(spark, sf):
    """Keys of three parts taken apart; the third keeps its colons. Others are no cache keys."""
    e = table(spark, sf, "events")
    key = F.when(F.col("event_id") % 10 == 0, F.col("event_type")).otherwise(T.cache_key(F.col("event_type"), F.lit("extract"), F.concat(F.md5(F.col("event_id").cast("string")), F.lit(":x"))))
    k = e.select(T.parse_cache_key(key).alias("k")).where("k is not null")
    return k.groupBy("k.mode", "k.cache_type").agg(F.count("*").alias("n"), F.min("k.digest").alias("least"))


@query(r"""
WITH t AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '<think>why' || chr(10) || 'not</think> ' || source WHEN 1 THEN 'lost</think>' || source ELSE source || ' <think>kept' END AS t FROM documents)
SELECT doc_id, trim(regexp_replace(t, '^(<think>.*?</think>|.*</think>)', '', 's')) AS answer FROM t""")
def think_tag_strip(spark, sf):
    d, s = table(spark, sf, "documents"), F.col("source")
    t = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("<think>why\nnot</think> "), s)).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("lost</think>"), s)).otherwise(F.concat(s, F.lit(" <think>kept")))
    return d.select("doc_id", T.strip_think(t).alias("answer"))


_BROKEN = ("<|##|>", "<|\\#|>", "<|>", "<||>", "<X|#|>", "<#>", "<|#>", "<X#|>", "<|#|", "<|#:", "<||#>", "|#|>", "||#||", "<|#|>")


@query("""
SELECT p_partkey, 'entity<|#|>' || p_name || '<|#|>' || p_brand AS record FROM part""")
def delimiter_repair(spark, sf):
    """Each way a delimiter breaks, made whole."""
    broken = F.element_at(F.array(*map(F.lit, _BROKEN)), (F.col("p_partkey") % len(_BROKEN) + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", T.repair_delimiters(F.concat(F.lit("entity<|#|>"), F.col("p_name"), broken, F.col("p_brand"))).alias("record"))


@query("""
SELECT p_partkey, p_name || '/' || p_brand || '/' || p_type AS words FROM part""")
def split_markers(spark, sf):
    """Parts between any of several markers, blanks dropped."""
    joined = F.concat("p_name", F.lit(" | "), "p_brand", F.lit(" ;; "), "p_type")
    return table(spark, sf, "part").select("p_partkey", F.array_join(T.split_markers(joined, ["|", ";"]), "/").alias("words"))


def _answers(spark, sf):
    """An extraction answer a part: two entities and a relation, noise, one record without a description, one loop."""
    ps = spread(table(spark, sf, "part")).select(F.col("p_partkey").alias("l_partkey"), (F.col("p_partkey") % 100).alias("l_suppkey"))
    part, supp = F.concat(F.lit("Part "), F.col("l_partkey")), F.concat(F.lit("Supplier "), F.col("l_suppkey"))
    line = lambda *f: F.concat_ws(_D, *(F.lit(x) if isinstance(x, str) else x for x in f))
    text = F.concat_ws(
        "\n", line("entity", part, "Product", F.concat(F.lit("A part, number "), F.col("l_partkey"))), line("entity", supp, "Organi zation", F.concat(F.lit("Supplies "), part)),
        line("entity", F.lit("the"), "Product", "noise"), line("entity", part, "Product", ""), line("relation", part, supp, "supply,trade", F.concat(supp, F.lit(" delivers "), part)),
        line("relation", part, part, "self", "a loop"), F.lit("<|COMPLETE|>"),
    )
    return ps.select(F.concat("l_partkey", F.lit("-"), "l_suppkey").alias("chunk_id"), text.alias("text"))


_SUPPLY = "p AS (SELECT p_partkey AS p, p_partkey % 100 AS s FROM part)"


@query(f"""
WITH {_SUPPLY}
SELECT p || '-' || s AS chunk_id, CAST(0 AS INTEGER) AS record_order, 'Part ' || p AS entity_name, 'product' AS entity_type, 'A part, number ' || p AS description FROM p
UNION ALL SELECT p || '-' || s, 1, 'Supplier ' || s, 'organization', 'Supplies Part ' || p FROM p""")
def record_parse_entities(spark, sf):
    """Entity rows of extraction answers: noise names and records with a field too few are dropped."""
    return extraction.entities(extraction.records(_answers(spark, sf)))


@query(f"""
WITH {_SUPPLY}
SELECT p || '-' || s AS chunk_id, CAST(4 AS INTEGER) AS record_order, 'Part ' || p AS src_id, 'Supplier ' || s AS tgt_id, 'supply,trade' AS keywords,
       'Supplier ' || s || ' delivers Part ' || p AS description, CAST(1.0 AS DOUBLE) AS weight FROM p""")
def record_parse_relations(spark, sf):
    """Relation rows of extraction answers; loops are dropped, and a description that is no number gives weight 1."""
    return extraction.relations(extraction.records(_answers(spark, sf)))


_PATHS = ("https://a.b/c", "and/or", "a/b", r"C:\x", r"\\h\s", "/etc/x", "./x", "a/b/c d", "fig.png", "plain name", r"\alpha x", "")
_REASONS = ("url_scheme_whitelist", "slash_phrase_whitelist", "slash_phrase_whitelist", "win_abs", "unc_abs", "posix_abs", "relative_prefix", "relative_multisegment", "bare_filename", "not_path", "math_whitelist", "empty")


@query(f"""
SELECT {list(_REASONS)}[1 + page_id % 12] AS reason, count(*) AS n FROM pages GROUP BY 1""")
def path_classifier(spark, sf):
    """Why names are paths or not."""
    name = F.element_at(F.array(*map(F.lit, _PATHS)), (F.col("page_id") % 12 + 1).cast("int"))
    return table(spark, sf, "pages").groupBy(names.path_reason(name).alias("reason")).agg(F.count("*").alias("n"))


@query("""
SELECT CASE WHEN regexp_matches(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://') THEN 'url_scheme_whitelist' ELSE 'other' END AS reason, count(*) AS n FROM pages GROUP BY 1""")
def path_classifier_urls(spark, sf):
    """Addresses of pages are no paths."""
    r = names.path_reason(F.col("url"))
    return table(spark, sf, "pages").groupBy(F.when(r == "url_scheme_whitelist", r).otherwise("other").alias("reason")).agg(F.count("*").alias("n"))


_NAMES = ("Table 7: Results", "Table 7", "Image Path: x", "footer content", "they", "the", "page 12", "coordinates [1, 2]", "image_ab12", "published by x", "ab", "Transformer", "bounding box at [1, 2, 3]")
_QUALITY = ("locator_with_semantic_title", "bare_locator_label", "image_path_label", "layout_metadata", "ambiguous_reference", "generic_noise", "bare_locator_label", "coordinate_label", "image_stem_no_ext", "publisher_phrase_noise", "short_alpha_noise", "ok", "coordinate_metadata")


@query(f"""
SELECT {list(_QUALITY)}[1 + doc_id % 13] AS reason, count(*) AS n FROM documents GROUP BY 1""")
def entity_quality(spark, sf):
    """Why names are kept as entities or not."""
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("doc_id") % 13 + 1).cast("int"))
    return table(spark, sf, "documents").groupBy(names.quality_reason(name).alias("reason")).agg(F.count("*").alias("n"))


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN lower(replace(p_type, ' ', '')) WHEN 1 THEN lower(replace(p_brand, ' ', '')) WHEN 2 THEN NULL ELSE 'a' END AS entity_type FROM part""")
def entity_type_validity(spark, sf):
    """Types in their stored form; null for what is no type."""
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, F.col("p_type")).when(k == 1, F.concat(F.lit(" , "), "p_brand", F.lit(",x"))).when(k == 2, F.lit("a|b")).otherwise(F.lit("A"))
    return table(spark, sf, "part").select("p_partkey", names.entity_type(raw).alias("entity_type"))


@query("""
SELECT c_custkey, lower(regexp_replace(c_name || '__' || c_mktsegment || ' -x', '[_\\s-]+', ' ', 'g')) AS key FROM customer""".replace("\\\\", "\\"))
def lexical_keys(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", T.lexical_key(F.concat("c_name", F.lit("__"), "c_mktsegment", F.lit(" -x"))).alias("key"))


@query("""
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'a/' || source || '.png;b ' || lang || '.JPG' END AS paths FROM documents""")
def image_paths(spark, sf):
    """Distinct image paths of chunk texts, in order."""
    line = lambda *x: F.concat(F.lit("Image Path: "), *x, F.lit("\n"))
    a, b = line(F.lit("a/"), F.col("source"), F.lit(".png")), line(F.lit("b "), F.col("lang"), F.lit(".JPG"))
    text = F.when(F.col("doc_id") % 3 == 0, F.lit("Image Path: none\n")).otherwise(F.concat(a, b, a))
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.image_paths(text), ";").alias("paths"))


@query("""
SELECT CASE event_type WHEN 'view' THEN 'table' WHEN 'click' THEN 'equation' WHEN 'error' THEN 'image' WHEN 'signup' THEN 'generic' ELSE 'query' END AS task, count(*) AS n FROM events GROUP BY 1""")
def task_routing(spark, sf):
    kind, asked = F.col("event_type"), F.lit("Response must be a valid JSON object. ")
    prompt = F.when(kind == "view", F.concat(asked, F.lit("a Table"))).when(kind == "click", F.concat(asked, F.lit("LaTeX"))).when(kind == "error", F.concat(asked, F.lit("image"))).when(kind == "signup", asked).otherwise(F.lit("a table?"))
    return table(spark, sf, "events").groupBy(T.task_type(F.lit(None).cast("string"), prompt).alias("task")).agg(F.count("*").alias("n"))


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS shown, CAST(epoch(o_orderdate) AS BIGINT) AS seconds FROM orders""")
def epoch_format(spark, sf):
    """Epoch seconds and their text."""
    s = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    return table(spark, sf, "orders").select("o_orderkey", F.date_format(F.timestamp_seconds(s), "yyyy-MM-dd HH:mm:ss").alias("shown"), s.alias("seconds"))


@query("""
SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events WHERE CAST(props->>'$.k' AS BIGINT) >= 50""")
def json_props(spark, sf):
    """A field of JSON metadata, null where there is none."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf, "events").select("event_id", k.alias("k")).where("k >= 50")


@query("""
WITH t AS (SELECT page_id, trim(regexp_replace(html, '</p\\s*>|<p\\s*>|<p/>|</br\\s*>|<br\\s*>|<br/>', '', 'gi')) AS t FROM pages)
SELECT page_id, length(t) AS n FROM t""".replace("\\\\", "\\"))
def normalize_tags(spark, sf):
    """Paragraph and line-break tags taken out of pages."""
    return table(spark, sf, "pages").select("page_id", F.length(T.strip(F.regexp_replace("html", r"(?i)</p\s*>|<p\s*>|<p/>|</br\s*>|<br\s*>|<br/>", ""))).cast("long").alias("n"))


@query("""
WITH t AS (SELECT doc_id % 8 AS k FROM documents)
SELECT ['name', 'ABC123', '中文', '中文ab', 'x "y" z', '', '', '12.34.56'][1 + k] AS name, count(*) AS n FROM t GROUP BY 1""")
def normalize_names(spark, sf):
    """Surfaces of extracted names."""
    raw = ('"name"', "ＡＢＣ１２３", "中 文", "中文 ab", 'x "y" z', "12", "1.2.3", "12.34.56")
    name = F.element_at(F.array(*map(F.lit, raw)), (F.col("doc_id") % 8 + 1).cast("int"))
    return table(spark, sf, "documents").groupBy(T.normalize_name(name).alias("name")).agg(F.count("*").alias("n"))


@query("""
SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: CASE WHEN regexp_matches(w, '^[a-z]{2,5}$') AND NOT regexp_matches(w, '[aeiou]') THEN upper(w)
  ELSE upper(substring(w, 1, 1)) || substring(w, 2) END), ' ') AS surface FROM part""")
def surface_forms(spark, sf):
    """Shown forms of lower-case names of parts."""
    return table(spark, sf, "part").select("p_partkey", names.surface_form(F.lower("p_name")).alias("surface"))
