"""Knowledge graphs from and to tables: Parquet, JSON key-value files, GraphML, bulk loads, exports."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions.fixed_values import FIELD_SEPARATOR
from docweave.functions.text import content_id, pair_id, strip
from docweave.operators.graph import canonical, export_pairs


def read_parquet_graph(spark: SparkSession, entities: str, relationships: str) -> tuple[DataFrame, DataFrame]:
    """entities (id) and relationships (source, target, weight?); missing ends become nodes, a missing weight is 1."""
    n = spark.read.parquet(entities).select(F.col("id").cast("string").alias("entity_id"))
    r = spark.read.parquet(relationships)
    weight = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in r.columns else F.lit(1.0)
    e = r.select(F.col("source").cast("string").alias("src"), F.col("target").cast("string").alias("tgt"), weight.alias("weight"))
    ends = e.select(F.explode(F.array("src", "tgt")).alias("entity_id"))
    return n.unionByName(ends).distinct(), canonical(e)


def read_json_kv(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    """One JSON object of id -> row as a table (id, ...)."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,struct<{value_schema}>>").alias("m"))
    return whole.select(F.explode("m").alias("id", "v")).select("id", "v.*")


def read_vector_json(spark: SparkSession, path: str) -> DataFrame:
    """(vec_id, embedding, row): a vector file of JSON: `data` rows with `__id__`, and `matrix`, their vectors as base64 of 32-bit floats."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "embedding_dim int, data array<map<string,string>>, matrix string").alias("m"))

    @F.pandas_udf("array<array<float>>")
    def rows(dims: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(bytes(x), "<f4").reshape(-1, d).tolist() for d, x in zip(dims, data, strict=True)])

    zipped = whole.select(F.col("m.data").alias("row"), rows("m.embedding_dim", F.unbase64("m.matrix")).alias("embedding"))
    each = zipped.select(F.explode(F.arrays_zip("row", "embedding")).alias("x"))
    return each.select(F.col("x.row")["__id__"].alias("vec_id"), "x.embedding", "x.row")


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (entity_id, attributes) and edges (src, tgt, attributes) of a GraphML file, or of a folder of parts of one; attributes by the names of their keys."""
    # Elements are looked for one by one, as a folder's parts are no whole documents each.
    read = lambda tag: spark.read.format("xml").option("rowTag", tag).option("useLegacyXMLParser", True).option("ignoreSurroundingSpaces", False)
    keys = {r["_id"]: r["_attr.name"] for r in read("key").schema("`_id` string, `_attr.name` string").load(path).collect()}  # the header
    data = "data array<struct<_VALUE:string,_key:string>>"
    names = F.create_map(*(F.lit(x) for kv in keys.items() for x in kv)) if keys else F.create_map(F.lit(""), F.lit(""))
    attributes = F.map_from_entries(F.transform(F.coalesce("data", F.array().cast("array<struct<_VALUE:string,_key:string>>")), lambda d: F.struct(F.coalesce(F.try_element_at(names, d["_key"]), d["_key"]), d["_VALUE"]))).alias("attributes")
    nodes = read("node").schema(f"_id string, {data}").load(path).select(F.col("_id").alias("entity_id"), attributes)
    edges = read("edge").schema(f"_source string, _target string, {data}").load(path).select(F.col("_source").alias("src"), F.col("_target").alias("tgt"), attributes)
    return nodes, canonical(edges)


GRAPHML_TYPES = {"tinyint": "int", "smallint": "int", "int": "int", "bigint": "long", "float": "float", "double": "double", "boolean": "boolean"}


def _xml(c: Column) -> Column:
    """A text as XML holds it: without the characters that it can't hold, markup escaped, and what parsers would make a space or leave out by number."""
    c = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\uFFFE\uFFFF]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\t", "&#9;"), ("\n", "&#10;"), ("\r", "&#13;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """nodes (entity_id, ...) and edges (src, tgt, ...) as GraphML: a folder whose parts, one after the other by name, are one valid document.

    A header of keys, nodes by id, edges by ends, a footer: rows are sorted by ranges, so parts are written by many tasks
    and committed once by Spark. Lists are joined; nulls have no entry. Nodes and edges without an id or an end are left out.
    """
    def entries(df: DataFrame, key: list[str], of: str) -> tuple[list[str], Column]:
        names = [c for c in df.columns if c not in key]
        ids = {c: f"{of[0]}{i}" for i, c in enumerate(names)}
        quoted = lambda c: c.replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")
        heads = [f'<key id="{ids[c]}" for="{of}" attr.name="{quoted(c)}" attr.type="{GRAPHML_TYPES.get(dict(df.dtypes)[c], "string")}"/>' for c in names]
        value = lambda c: F.array_join(c, FIELD_SEPARATOR) if dict(df.dtypes)[c].startswith("array") else F.col(c).cast("string")
        data = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f'<data key="{ids[c]}">'), _xml(value(c)), F.lit("</data>"))) for c in names]
        return heads, F.concat_ws("", *data) if data else F.lit("")

    node_heads, node_data = entries(nodes, ["entity_id"], "node")
    edge_heads, edge_data = entries(edges, ["src", "tgt"], "edge")
    n = nodes.where("entity_id is not null").select(F.lit(1).alias("kind"), F.col("entity_id").alias("a"), F.lit("").alias("b"), F.concat(F.lit('<node id="'), _xml(F.col("entity_id")), F.lit('">'), node_data, F.lit("</node>")).alias("value"))
    e = edges.where("src is not null and tgt is not null").select(F.lit(2).alias("kind"), F.col("src").alias("a"), F.col("tgt").alias("b"), F.concat(F.lit('<edge source="'), _xml(F.col("src")), F.lit('" target="'), _xml(F.col("tgt")), F.lit('">'), edge_data, F.lit("</edge>")).alias("value"))
    head = "\n".join(['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', *node_heads, *edge_heads, '<graph edgedefault="undirected">'])
    ends = nodes.sparkSession.createDataFrame([(0, "", "", head), (3, "", "", "</graph>\n</graphml>")], "kind int, a string, b string, value string")
    every = n.unionByName(e).unionByName(ends)
    every.repartitionByRange("kind", "a", "b").sortWithinPartitions("kind", "a", "b").select("value").write.text(path)


def load_custom(chunks: DataFrame, entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A bulk load: chunks (content, source_id, position), entities and relations by source_id, with ids and missing ends.

    A source_id stands for the last chunk that has it; unknown ones are UNKNOWN, and so are the types of ends that are
    no entities, which take their relation's description.
    """
    c = chunks.withColumn("content", strip(F.col("content"))).withColumn("chunk_id", content_id("chunk-", F.col("content")))
    last = c.groupBy("source_id").agg(F.max_by("chunk_id", "position").alias("__chunk"))
    mapped = lambda df: df.join(last, "source_id", "left").withColumn("source_id", F.coalesce("__chunk", F.lit("UNKNOWN"))).drop("__chunk")
    n = mapped(entities).withColumnRenamed("entity_name", "entity_id")
    e = canonical(mapped(relations).withColumnsRenamed({"src_id": "src", "tgt_id": "tgt"})).withColumn("id", pair_id(F.col("src"), F.col("tgt")))
    ends = e.select(F.explode(F.array("src", "tgt")).alias("entity_id"), "description", "source_id").groupBy("entity_id").agg(F.min(F.struct("description", "source_id")).alias("x"))
    ends = ends.join(n.select("entity_id"), "entity_id", "left_anti").select("entity_id", F.lit("UNKNOWN").alias("entity_type"), "x.description", "x.source_id")
    n = n.unionByName(ends, allowMissingColumns=True).withColumn("id", content_id("ent-", F.col("entity_id")))
    return c.dropDuplicates(["chunk_id"]), n, e


def load_chunks(documents: DataFrame) -> DataFrame:
    """Documents (doc_id, text_chunks array) as chunks with ids and their order."""
    rows = documents.select("doc_id", F.posexplode("text_chunks").alias("chunk_order_index", "content")).withColumn("content", strip(F.col("content")))
    return rows.where("content != ''").withColumn("chunk_id", content_id("chunk-", F.col("content")))


def unique_contexts(lines: DataFrame) -> DataFrame:
    """Distinct contexts (context, position) in the order they are first seen."""
    return lines.groupBy("context").agg(F.min("position").alias("position")).orderBy("position")


def export(nodes: DataFrame, edges: DataFrame, path: str, kind: str = "csv") -> None:
    """Entities, and relations in both directions, as csv, json, parquet, md or txt below a path."""
    for name, df in (("entities", nodes), ("relations", export_pairs(edges))):
        flat = df.select(*(F.array_join(c, FIELD_SEPARATOR).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes))
        to = f"{path}/{name}"
        if kind == "csv":
            flat.write.csv(to, header=True, escape='"')
        elif kind in ("json", "parquet"):
            getattr(flat.write, kind)(to)
        elif kind in ("md", "txt"):
            cells = [F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"[\r\n]+", " "), F.lit("")) for c in flat.columns]
            flat.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")) if kind == "md" else F.concat_ws("\t", *cells)).write.text(to)
        else:
            raise ValueError(f"no export as {kind}")


def without_xml_controls(df: DataFrame) -> DataFrame:
    """String columns without the characters that XML can't hold."""
    return df.select(*(F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\uFFFE\uFFFF]", "").alias(c) if t == "string" else F.col(c) for c, t in df.dtypes))
