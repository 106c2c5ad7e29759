"""The undirected property graph: nodes(entity_id, ...) and edges(src, tgt, ...), edges stored once with src < tgt."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.fixed_values import BELONGS_TO_KEYWORDS, BELONGS_TO_WEIGHT, MAX_FILE_PATHS, MAX_SOURCE_IDS

from .components import components
from .provenance import limit_ids, truncation_mark
from .ranking import numbered
from .scratch import shared_dir, written
from .tables import merge_columns

#: Links (edges both ways) of a graph that one task searches, and searches of 64 nodes that it makes at most; beyond them every step is a join. Long paths looked for then.
LINKS, SEARCHES, SWEEPS = 1 << 20, 512, 2


def canonical(df: DataFrame, src: str = "src", tgt: str = "tgt") -> DataFrame:
    """Endpoints in order, self loops dropped."""
    df = df.where(F.col(src) != F.col(tgt))
    return df.withColumns({src: F.least(src, tgt), tgt: F.greatest(src, tgt)})


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge from either end, as (entity_id, other, ...)."""
    rest = [c for c in edges.columns if c not in ("src", "tgt")]
    ends = F.explode(F.array(F.struct(F.col("src").alias("entity_id"), F.col("tgt").alias("other")), F.struct(F.col("tgt").alias("entity_id"), F.col("src").alias("other"))))
    return edges.select(ends.alias("__e"), *rest).select("__e.entity_id", "__e.other", *rest)


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("entity_id").agg(F.count("*").alias("degree"))


def with_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with their degree, zero if they have no edge."""
    return nodes.join(degrees(edges), "entity_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def with_degrees_of(some: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows with entity_id and the degree of it, zero without an edge; only the edges of these nodes are counted."""
    d = both_ways(edges.select("src", "tgt")).join(some.select("entity_id").distinct(), "entity_id", "left_semi").groupBy("entity_id").agg(F.count("*").alias("degree"))
    return some.join(d, "entity_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def edge_degrees_of(some: DataFrame, edges: DataFrame) -> DataFrame:
    """As edge_degrees, of some of the edges."""
    ends = some.select(F.explode(F.array("src", "tgt")).alias("entity_id")).distinct()
    d = with_degrees_of(ends, edges)
    a, b = (d.select(F.col("entity_id").alias(c), F.col("degree").alias(f"__{c}")) for c in ("src", "tgt"))
    return some.join(a, "src").join(b, "tgt").withColumn("degree", F.col("__src") + F.col("__tgt")).drop("__src", "__tgt")


def edge_degrees(edges: DataFrame) -> DataFrame:
    """Edges with the sum of their ends' degrees."""
    d = degrees(edges)
    a, b = d.select(F.col("entity_id").alias("src"), F.col("degree").alias("__a")), d.select(F.col("entity_id").alias("tgt"), F.col("degree").alias("__b"))
    return edges.join(a, "src", "left").join(b, "tgt", "left").withColumn("degree", F.coalesce("__a", F.lit(0)) + F.coalesce("__b", F.lit(0))).drop("__a", "__b")


def described(records: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct descriptions of each key, a row each: by time, then longest first, then as seen (`position` from 1)."""
    first = records.groupBy(*keys, "description").agg(F.min(F.struct("seq", "ts")).alias("x")).select(*keys, "description", "x.ts", "x.seq")
    over = Window.partitionBy(*keys).orderBy("ts", F.desc(F.length("description")), "seq", "description")
    return first.withColumn("position", F.row_number().over(over)).select(*keys, "description", "position")


def _merged(records: DataFrame, keys: list[str], existing: DataFrame | None, limit: int, method: str, own: str, texts_too: bool = True, paths_too: bool = True) -> DataFrame:
    """source_ids, file_paths and descriptions of each key, those of `existing` first, up to the limits, and what `own` makes.

    own: `entity_type`, whose most frequent value is taken, or `keywords`, whose words are, and weights added up. Records
    are told apart into values of four kinds; each value of a key is counted once for all, sources and paths are cut
    before they meet, and one aggregate by key puts the kinds together.
    """
    none, weighted = F.array().cast("array<string>"), own == "keywords"
    weight = F.col("weight") if weighted else F.lit(None).cast("double")
    kinds = {"source": "source_id", "own": own} | ({"path": "file_path"} if paths_too else {}) | ({"text": "description"} if texts_too else {})
    listed = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("value")) for k, c in kinds.items()))).alias("x")
    rows = records.select(*keys, "seq", "ts", F.lit(0).alias("late"), weight.alias("weight"), listed).select(*keys, "x.kind", "x.value", "late", "seq", "ts", "weight")
    if existing is not None:
        seq, ts = (F.lit(None).cast(records.schema[c].dataType).alias(c) for c in ("seq", "ts"))
        rows = rows.unionByName(existing.select(*keys, F.lit("own").alias("kind"), F.col(own).alias("value"), F.lit(1).alias("late"), seq, ts, weight.alias("weight")))
    short = F.col("kind").isin("source", "path")
    first = rows.where(~short | (F.col("value") != "")).groupBy(*keys, "kind", "value").agg(F.min(F.struct("late", "seq", "ts")).alias("f"), F.count("*").alias("n"), F.sum("weight").alias("w"))
    cut = first.where(short)
    if existing is not None:  # values that are there already don't count
        known = existing.select(*keys, F.explode(F.array(F.struct(F.lit("source").alias("kind"), F.col("source_ids").alias("v")), F.struct(F.lit("path").alias("kind"), F.col("file_paths").alias("v")))).alias("x"))
        cut = cut.join(known.select(*keys, "x.kind", F.explode("x.v").alias("value")), [*keys, "kind", "value"], "left_anti")
    order = F.col("f.seq").asc() if method.upper() == "KEEP" else F.col("f.seq").desc()
    rank = F.row_number().over(Window.partitionBy(*keys, "kind").orderBy(order, "value"))
    cut = cut.withColumn("rank", rank).where(F.col("rank") <= max(limit, MAX_FILE_PATHS + 1, 0))
    every = cut.unionByName(first.where(~short).withColumn("rank", F.lit(0)))
    seen = lambda kind, most: F.transform(F.array_sort(F.collect_list(F.when((F.col("kind") == kind) & (F.col("rank") <= most), F.struct("f.seq", "value")))), lambda x: x["value"])
    texts = F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "text", F.struct("f.ts", (-F.length("value")).alias("size"), "f.seq", "value")))), lambda x: x["value"])
    mine = F.col("kind") == "own"
    made = [F.min_by(F.when(mine, F.col("value")), F.when(mine, F.struct(-F.col("n"), "f.late", "f.seq"))).alias(own)]
    if weighted:
        made = [F.sum(F.when(mine, F.col("w"))).alias("weight"), F.array_join(keyword_tokens(F.collect_set(F.when(mine, F.col("value")))), ",").alias("keywords")]
    out = every.groupBy(*keys).agg(seen("source", limit).alias("source_ids"), seen("path", MAX_FILE_PATHS).alias("file_paths"), F.count_if(F.col("kind") == "path").alias("__paths"), texts.alias("descriptions"), *made)
    if existing is not None:
        out = out.join(existing.select(*keys, F.col("source_ids").alias("__s"), F.col("file_paths").alias("__p"), F.col("descriptions").alias("__d")), keys, "left")
        out = out.withColumn("__paths", F.col("__paths") + F.size(F.coalesce("__p", none)))
        for old, c in (("__s", "source_ids"), ("__p", "file_paths")):
            out = out.withColumn(c, F.array_distinct(F.concat(F.coalesce(old, none), c)))
        out = out.withColumn("descriptions", F.concat(F.coalesce("__d", none), "descriptions")).drop("__s", "__p", "__d")
    paths = limit_ids(F.col("file_paths"), MAX_FILE_PATHS, method)
    marked = F.when(F.col("__paths") > MAX_FILE_PATHS, F.concat(paths, F.array(F.lit(truncation_mark(method))))).otherwise(paths)
    return out.withColumns({"source_ids": limit_ids(F.col("source_ids"), limit, method), "file_paths": marked}).drop("__paths")


def merge_nodes(records: DataFrame, existing: DataFrame | None = None, limit: int = MAX_SOURCE_IDS, method: str = "FIFO", by: str = "entity_id", texts: bool = True) -> DataFrame:
    """Extracted records (entity_id, entity_type, description, source_id, file_path, ts, seq) merged by entity.

    Sources and paths in order of seq, existing ones first, up to the limits, which cut before a hub's values meet. The
    type is the most frequent, of those tied the first seen; an existing node's type counts as seen after the new ones.
    New descriptions, each once, by time and then longest first, come after the existing ones, which stay as they are. A
    hub's are as many as its records give: with texts=False they are left out, for described() and models.summarized().
    """
    out = _merged(records, [by], existing, limit, method, "entity_type", texts)
    return out.select(by, "source_ids", "file_paths", "descriptions", "entity_type")


def keyword_tokens(keywords: Column) -> Column:
    """Distinct comma-separated keywords of a list of keyword strings, sorted."""
    parts = F.flatten(F.transform(keywords, lambda k: F.transform(F.split(k, ","), lambda w: F.trim(w))))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != "")))


def merge_edges(records: DataFrame, existing: DataFrame | None = None, limit: int = MAX_SOURCE_IDS, method: str = "FIFO", texts: bool = True, paths: bool = True) -> DataFrame:
    """Extracted relations (src, tgt, weight, keywords, description, source_id, file_path, ts, seq) merged by pair.

    Weights add up, also to that of an existing edge; keywords are the sorted words of all. Lists as in merge_nodes; with
    paths=False those of paths are left out too, for callers that have no use for them.
    """
    out = _merged(canonical(records), ["src", "tgt"], existing and canonical(existing), limit, method, "keywords", texts, paths)
    return out.select("src", "tgt", "weight", "keywords", "source_ids", "file_paths", "descriptions")


def missing_endpoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ends of edges that are no nodes, typed UNKNOWN, with the description of the first of their edges."""
    ends = both_ways(edges).groupBy("entity_id").agg(F.min_by("description", F.struct("other")).alias("description"))
    return ends.join(nodes.select("entity_id"), "entity_id", "left_anti").select("entity_id", F.lit("UNKNOWN").alias("entity_type"), "description")


def rank_edges(edges: DataFrame, scores: DataFrame, by: list[str] = ()) -> DataFrame:
    """Edges of scored nodes, best first: greatest score of an end, weight, degree; `rank` from 1 (in each group of `by`). `edges` has degree."""
    s = scores.select(*by, "entity_id", "score")
    end = lambda c, name: s.select(*by, F.col("entity_id").alias(c), F.col("score").alias(name))
    e = edges.join(end("src", "__a"), [*by, "src"], "left").join(end("tgt", "__b"), [*by, "tgt"], "left")
    e = e.withColumn("relevance", F.greatest("__a", "__b")).where(F.col("relevance").isNotNull()).drop("__a", "__b")
    return numbered(e, [F.desc("relevance"), F.desc("weight"), F.desc("degree"), F.col("src"), F.col("tgt")], "rank", by)


def popular_labels(edges: DataFrame, limit: int = 300) -> DataFrame:
    return degrees(edges).orderBy(F.desc("degree"), "entity_id").limit(limit)


def search_labels(nodes: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Labels that hold the query in any case: equal 1000, a prefix 500, else 100 less the length, 50 more behind a space or underscore."""
    q = query.strip().lower()
    low = F.lower("entity_id")
    inside = 100 - F.length("entity_id") + F.when(low.contains(f" {q}") | low.contains(f"_{q}"), 50).otherwise(0)
    score = F.when(low == q, 1000).when(low.startswith(q), 500).otherwise(inside)
    return nodes.where(low.contains(q) if q else F.lit(False)).select("entity_id", score.alias("score")).orderBy(F.desc("score"), "entity_id").limit(limit)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in nodes."""
    ids = nodes.select("entity_id")
    return edges.join(ids.withColumnRenamed("entity_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("entity_id", "tgt"), "tgt", "left_semi")


def top_subgraph(nodes: DataFrame, edges: DataFrame, most: int = 1000) -> tuple[DataFrame, DataFrame]:
    """The nodes of highest degree and the edges between them."""
    top = with_degree(nodes, edges).orderBy(F.desc("degree"), "entity_id").limit(most)
    return top, induced(edges, top)


def neighbourhood(nodes: DataFrame, edges: DataFrame, label: str, depth: int = 3, most: int | None = 1000) -> tuple[DataFrame, DataFrame, bool]:
    """Nodes reached from a label level by level (entity_id, level), those of higher degree first, up to `most`; edges between; whether cut short.

    Frontiers are tables; degrees are counted for the nodes found only. most=None: no bound.
    """
    around = both_ways(edges.select("src", "tgt").distinct())
    seen = written(nodes.where(F.col("entity_id") == label).select("entity_id").distinct().withColumn("level", F.lit(0)))
    frontier, cut, count = seen, False, seen.count()
    for step in range(1, depth + 1):
        found = around.join(frontier.select("entity_id"), "entity_id", "left_semi").select(F.col("other").alias("entity_id")).distinct()
        found = found.join(seen, "entity_id", "left_anti").join(nodes.select("entity_id").distinct(), "entity_id", "left_semi")
        frontier = written(found.withColumn("level", F.lit(step)))
        n = frontier.count()
        if not n or count == most:
            cut = n > 0
            break
        if most is not None and count + n > most:
            degree = around.join(frontier, "entity_id", "left_semi").groupBy("entity_id").agg(F.count("*").alias("degree"))
            frontier = written(frontier.join(degree, "entity_id").orderBy(F.desc("degree"), "entity_id").limit(most - count).drop("degree"))
            cut, n = True, most - count
        seen, count = written(seen.unionByName(frontier)), count + n
        if cut:
            break
    return seen, induced(edges, seen), cut


def label_subgraph(nodes: DataFrame, edges: DataFrame, query: str, depth: int = 2, most: int = 1000) -> tuple[DataFrame, DataFrame, bool]:
    """What lies around the label that matches a query best; for `*`, or if none does, around the nodes of highest degree."""
    best = None if query.strip() == "*" else search_labels(nodes.select("entity_id"), query, 1).first()
    if best is None:
        top, links = top_subgraph(nodes.select("entity_id"), edges, most)
        return top.select("entity_id", F.lit(0).alias("level")), links, False
    return neighbourhood(nodes, edges, best.entity_id, depth, most)


def rename(nodes: DataFrame, edges: DataFrame, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    """An entity under another name, in nodes and incident edges; fails if the name is taken or the entity isn't there."""
    taken = {r.entity_id for r in nodes.where(F.col("entity_id").isin(old, new)).select("entity_id").collect()}
    if old not in taken or new in taken:
        raise ValueError(f"{old!r} is not there" if old not in taken else f"{new!r} is there already")
    name = lambda c: F.when(F.col(c) == old, F.lit(new)).otherwise(F.col(c))
    return nodes.withColumn("entity_id", name("entity_id")), canonical(edges.withColumns({"src": name("src"), "tgt": name("tgt")}))


def merge_entities(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges with sources mapped to targets (source, target): loops dropped, pairs that meet merged; weights the maximum."""
    m = names.select("source", "target")
    e = edges.join(m.select(F.col("source").alias("src"), F.col("target").alias("__s")), "src", "left").join(m.select(F.col("source").alias("tgt"), F.col("target").alias("__t")), "tgt", "left")
    e = canonical(e.withColumns({"src": F.coalesce("__s", "src"), "tgt": F.coalesce("__t", "tgt")}).drop("__s", "__t"))
    return e.groupBy("src", "tgt").agg(F.max("weight").alias("weight"), F.array_join(keyword_tokens(F.collect_set("keywords")), ",").alias("keywords"), F.array_join(F.array_sort(F.collect_set("description")), "<SEP>").alias("description"))


def merge_entity_nodes(nodes: DataFrame, names: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Nodes with sources made one with their targets (source, target), each column by its rule; a target that is a node takes part first."""
    m = names.select(F.col("source").alias("entity_id"), "target")
    merged = nodes.join(m, "entity_id", "left").withColumn("__k", F.struct(F.col("target").isNotNull().alias("late"), F.col("entity_id").alias("name"))).withColumn("entity_id", F.coalesce("target", "entity_id"))
    touched = merged.join(names.select(F.col("target").alias("entity_id")).distinct(), "entity_id", "left_semi")
    alone = merged.join(names.select(F.col("target").alias("entity_id")).distinct(), "entity_id", "left_anti").select("entity_id", *rules)
    return merge_attributes(touched, "entity_id", "__k", rules).unionByName(alone)


def has_nodes(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """ids (entity_id) and whether they are nodes."""
    return ids.join(nodes.select("entity_id").distinct().withColumn("found", F.lit(True)), "entity_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def get_edges(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """The edges of pairs (src, tgt), given in either direction."""
    return edges.join(canonical(pairs.select("src", "tgt")).distinct(), ["src", "tgt"])


def node_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(entity_id, other, ...): the edges of each of the ids."""
    return both_ways(edges).join(ids.select("entity_id").distinct(), "entity_id", "left_semi")


def entity_info(nodes: DataFrame, edges: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """Nodes with their degree and, if there is one, their vector (vec_id, embedding)."""
    out = with_degrees_of(nodes, edges)
    return out if vectors is None else out.join(vectors.select(F.col("vec_id").alias("entity_id"), "embedding"), "entity_id", "left")


def relation_info(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """Edges and, if there is one, their vector (src, tgt, embedding)."""
    return edges.join(canonical(vectors).select("src", "tgt", "embedding"), ["src", "tgt"], "left")


def create_entities(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """nodes and new ones; fails if one is there already."""
    there = new.join(nodes.select("entity_id"), "entity_id", "left_semi").select("entity_id").first()
    if there:
        raise ValueError(f"{there.entity_id!r} is there already")
    return nodes.unionByName(new, allowMissingColumns=True)


def create_relations(nodes: DataFrame, edges: DataFrame, new: DataFrame) -> DataFrame:
    """edges and new ones; fails if one is there already or an end is no node."""
    new = canonical(new)
    there = new.join(edges.select("src", "tgt"), ["src", "tgt"], "left_semi").first()
    loose = new.select(F.explode(F.array("src", "tgt")).alias("entity_id")).join(nodes.select("entity_id"), "entity_id", "left_anti").first()
    if there or loose:
        raise ValueError(f"{there.src!r} and {there.tgt!r} have a relation already" if there else f"{loose.entity_id!r} is not there")
    return edges.unionByName(new, allowMissingColumns=True)


def edit(rows: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Nodes or edges with the columns that `changes` gives for their keys; nulls change nothing. Fails if a key is not there."""
    lost = changes.join(rows.select(*key), key, "left_anti").first()
    if lost:
        raise ValueError(f"{[lost[k] for k in key]} is not there")
    return merge_columns(rows, changes, key)


def names_by_doc(records: DataFrame, added: DataFrame | None = None) -> DataFrame:
    """(full_doc_id, names): the entities of each document, those that were added for its relations too."""
    every = records.select("full_doc_id", "entity_id")
    every = every if added is None else every.unionByName(added.select("full_doc_id", "entity_id"))
    return every.distinct().groupBy("full_doc_id").agg(F.array_sort(F.collect_list("entity_id")).alias("names"))


def merge_attributes(df: DataFrame, key: str, order: str, rules: dict[str, str]) -> DataFrame:
    """A row a key, each column by its rule: concatenate, keep_first, keep_last, join_unique, join_unique_comma, max."""
    def ordered(c: str) -> Column:
        kept = F.filter(F.array_sort(F.collect_list(F.struct(order, F.col(c).cast("string").alias("v")))), lambda x: x["v"].isNotNull() & (x["v"] != ""))
        return F.transform(kept, lambda x: x["v"])

    def commas(c: str) -> Column:
        parts = F.flatten(F.transform(ordered(c), lambda s: F.transform(F.split(s, ","), lambda w: F.trim(w))))
        return F.array_join(F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != ""))), ",")

    by = {
        "concatenate": lambda c: F.array_join(ordered(c), "\n"), "keep_first": lambda c: F.get(ordered(c), F.lit(0)), "keep_last": lambda c: F.element_at(F.when(F.size(ordered(c)) > 0, ordered(c)), -1),
        "join_unique": lambda c: F.array_join(F.array_distinct(ordered(c)), "<SEP>"), "join_unique_comma": commas, "max": F.max,
    }
    return df.groupBy(key).agg(*(by[rule](c).alias(c) for c, rule in rules.items()))


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the nodes of gone (entity_id) and their edges."""
    g = gone.select("entity_id").distinct()
    left = edges.join(g.withColumnRenamed("entity_id", "src"), "src", "left_anti").join(g.withColumnRenamed("entity_id", "tgt"), "tgt", "left_anti")
    return nodes.join(g, "entity_id", "left_anti"), left


def delete_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the edges of gone (src, tgt), given in either direction."""
    return edges.join(canonical(gone.select("src", "tgt")).distinct(), ["src", "tgt"], "left_anti")


def classify_deletion(owned: DataFrame, gone: DataFrame, key: list[str], chunk: str = "chunk_id") -> DataFrame:
    """What removing chunks does to each owner of (key, chunk): delete if none is left, rebuild if fewer, keep if all."""
    marked = owned.join(gone.select(chunk).distinct().withColumn("__gone", F.lit(1)), chunk, "left")
    counts = marked.groupBy(*key).agg(F.count("*").alias("n_before"), (F.count("*") - F.count("__gone")).alias("n_after"))
    return counts.withColumn("action", F.when(F.col("n_after") == 0, "delete").when(F.col("n_after") < F.col("n_before"), "rebuild").otherwise("keep"))


def belongs_to(entities: DataFrame, main: DataFrame) -> DataFrame:
    """Edges from each entity of a chunk to the chunk's main entity: entities(chunk_id, entity_name), main(chunk_id, main)."""
    e = entities.select("chunk_id", "entity_name").distinct().join(main.select("chunk_id", "main"), "chunk_id").where("entity_name != main")
    return e.select(F.col("entity_name").alias("src"), F.col("main").alias("tgt"), F.lit(BELONGS_TO_WEIGHT).alias("weight"), F.lit(BELONGS_TO_KEYWORDS).alias("keywords"), "chunk_id")


def _components(edges: DataFrame) -> DataFrame:
    """(entity_id, component): a number for each component, for every node of an edge."""
    ids = both_ways(edges.select("src", "tgt")).select("entity_id").distinct().withColumn("node", F.xxhash64("entity_id"))
    root = components(edges.select(F.xxhash64("src").alias("a"), F.xxhash64("tgt").alias("b")))
    return ids.join(root, "node", "left").select("entity_id", F.coalesce("root", "node").alias("component"))


def metrics(nodes: DataFrame, edges: DataFrame, with_diameter: bool = True) -> DataFrame:
    """One row of twenty measures of the graph: sizes, degrees, density, components, clustering, diameter.

    Means of component sizes leave isolated nodes out; the trimmed one the least and the greatest size too. The mean
    clustering is over nodes of two edges or more. The diameter of a graph of several components is infinite; of a
    connected one takes several searches, so it can be left out (null).
    Triangles are counted over edges directed from the lower degree to the higher, which bounds what a hub gives rise to.
    """
    e = written(canonical(edges.select("src", "tgt")).distinct())
    d = written(with_degree(nodes.select("entity_id").distinct(), e))
    comp = _components(e)
    sizes = written(d.join(comp, "entity_id", "left").groupBy(F.coalesce("component", F.xxhash64("entity_id")).alias("component")).agg(F.count("*").alias("size")))
    a, b = d.select(F.col("entity_id").alias("src"), F.col("degree").alias("da")), d.select(F.col("entity_id").alias("tgt"), F.col("degree").alias("db"))
    directed = e.join(a, "src").join(b, "tgt")
    forward = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("src") < F.col("tgt")))
    directed = directed.select(F.when(forward, F.col("src")).otherwise(F.col("tgt")).alias("x"), F.when(forward, F.col("tgt")).otherwise(F.col("src")).alias("y"))
    wedge = directed.join(directed.withColumnRenamed("y", "z"), "x").where("y < z")
    closed = wedge.join(e.withColumnsRenamed({"src": "y", "tgt": "z"}), ["y", "z"])
    triangles = closed.select(F.explode(F.array("x", "y", "z")).alias("entity_id")).groupBy("entity_id").agg(F.count("*").alias("triangles"))
    wedges = F.col("degree") * (F.col("degree") - 1)
    local = d.join(triangles, "entity_id", "left").withColumn("local", F.when(F.col("degree") > 1, 2 * F.coalesce("triangles", F.lit(0)) / wedges))
    nodes_row = local.agg(
        F.count("*").alias("num_nodes"), (F.coalesce(F.sum("degree"), F.lit(0)) / 2).cast("long").alias("num_edges"), F.coalesce(F.avg("degree"), F.lit(0.0)).alias("average_degree"),
        F.avg("local").alias("average_clustering"), F.count_if(F.col("degree") == 0).alias("isolated"), F.count_if(F.col("degree") > 0).alias("num_nodes_excluding_isolated"),
        *(F.count_if(F.col("degree") > k).alias(f"degree_over_{k}") for k in (1, 2, 3)),
    )
    real = F.when(F.col("size") > 1, F.col("size"))
    sizes_row = sizes.agg(
        F.count("*").alias("num_components"), F.coalesce(F.max("size"), F.lit(0)).alias("giant_size"), F.count(real).alias("num_components_excluding_isolated"), F.avg(real).alias("mean_size"), F.median(real).alias("median_size"),
        F.try_divide(F.sum(real) - F.max(real) - F.min(real), F.count(real) - 2).alias("__trimmed"), F.exp(F.avg(F.log(real))).alias("geometric_mean_size"), F.try_divide(F.count(real), F.sum(1 / real)).alias("harmonic_mean_size"),
    )
    trimmed = F.when(F.col("num_components_excluding_isolated") > 2, F.col("__trimmed")).otherwise(F.col("mean_size"))
    sizes_row = sizes_row.withColumn("trimmed_mean_size", trimmed).drop("__trimmed")
    for c in ("mean_size", "median_size", "trimmed_mean_size", "geometric_mean_size", "harmonic_mean_size"):
        sizes_row = sizes_row.withColumn(c, F.coalesce(F.col(c), F.lit(0.0)))
    sizes_row = written(sizes_row)  # one row
    above = sizes.join(F.broadcast(sizes_row.select("mean_size"))).agg(F.count_if((F.col("size") > 1) & (F.col("size") > F.col("mean_size"))).alias("num_components_above_mean"))
    row = nodes_row.join(F.broadcast(sizes_row)).join(F.broadcast(above))
    n = F.col("num_nodes")
    connected = sizes_row.first()["num_components"] == 1
    far = F.lit(float(diameter(e)) if connected else float("inf")) if with_diameter or not connected else F.lit(None).cast("double")
    return row.withColumn("density", F.when(n > 1, 2 * F.col("num_edges") / (n * (n - 1))).otherwise(0.0)).withColumn("diameter", far)


def _linked(edges: DataFrame) -> DataFrame:
    """(u, v): edges both ways between numbers of their nodes, from 1."""
    around = both_ways(edges.select("src", "tgt").distinct())
    names = written(numbered(around.select("entity_id").distinct(), [F.col("entity_id")], "n", kind="long"))
    return around.join(names.select("entity_id", F.col("n").alias("u")), "entity_id").join(names.select(F.col("entity_id").alias("other"), F.col("n").alias("v")), "other").select("u", "v")


def _longest(u: np.ndarray, v: np.ndarray, searches: int) -> int | None:
    """The diameter of a connected graph with links both ways, as diameter(); none if it takes more than some searches of 64 nodes."""
    names, u = np.unique(u, return_inverse=True)
    order = np.argsort(u, kind="stable")
    v, degree = np.searchsorted(names, v[order]), np.bincount(u, minlength=len(names))
    first = np.cumsum(degree) - degree
    more = np.zeros(len(names), np.uint64)

    def search(sources: np.ndarray) -> tuple[int, np.ndarray]:
        """The greatest distance from any source, and of each node the last step at which a source reached it."""
        seen, level, step = np.zeros(len(names), np.uint64), np.zeros(len(names), np.int64), 0
        front, bits = sources, np.uint64(1) << np.arange(len(sources), dtype=np.uint64)
        seen[front] = bits
        while True:
            n = degree[front]
            to = v[np.arange(n.sum()) + np.repeat(first[front] - (np.cumsum(n) - n), n)]
            np.bitwise_or.at(more, to, np.repeat(bits, n))
            to = np.unique(to)
            bits, more[to] = more[to] & ~seen[to], 0
            front, bits = to[bits != 0], bits[bits != 0]
            if not len(front):
                return step, level
            step += 1
            seen[front] |= bits
            level[front] = step

    best, middle, levels = -1, 0, None
    while True:
        around = search(np.array([middle]))[1]
        if levels is None or around.max() < levels.max():
            levels = around
        one = search(np.array([around.argmax()]))[1]
        if one.max() <= best:
            break
        best = int(one.max())
        two = search(np.array([one.argmax()]))[1]
        middle = np.flatnonzero((one + two == best) & (one == best // 2))[0]
    for i in range(int(levels.max()), 0, -1):
        at = np.flatnonzero(levels == i)
        for k in range(0, len(at), 64):
            if best >= 2 * i:
                return best
            if searches == 0:
                return None
            best, searches = max(best, search(at[k : k + 64])[0]), searches - 1
    return best


def _distances(link: DataFrame, starts: DataFrame, graph: str) -> DataFrame:
    """(graph, v, level) from a node (graph, v) of each graph, a level at a time. What a level is next to is in it, before it or behind it, so only two are held against what is found."""
    spark, path, step = link.sparkSession, shared_dir(link.sparkSession), 0
    columns = f"`{graph}` {starts.schema[graph].dataType.simpleString()}, v long"
    frontier, before = starts.select(graph, F.col("v").cast("long").alias("v")), None
    while True:
        frontier.write.parquet(f"{path}/level={step}")
        frontier = spark.read.schema(columns).parquet(f"{path}/level={step}")
        if frontier.isEmpty():
            return spark.read.schema(f"{columns}, level int").parquet(path)
        known = frontier if before is None else frontier.unionByName(before)
        found = link.join(frontier.select(F.col("v").alias("u")), "u", "left_semi").select(graph, "v").distinct().join(known.select("v"), "v", "left_anti")
        before, frontier, step = frontier, found.select(graph, "v"), step + 1


def _eccentricities(link: DataFrame, sources: DataFrame, graph: str) -> DataFrame:
    """(graph, far): the greatest distance of any node from any of a graph's sources (graph, v): searches from all at once, 64 of them in the bits of a number."""
    spark, path, step, keys = link.sparkSession, shared_dir(link.sparkSession), 1, [graph, "part", "v"]
    at = F.col("__n") - 1
    fresh = written(numbered(sources, [F.col("v")], "__n", [graph]).select(graph, F.floor(at / 64).alias("part"), "v", F.expr("shiftleft(1L, cast((__n - 1) % 64 as int))").alias("bits")))
    columns, before = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fresh.schema), None
    while True:
        moved = fresh.withColumnRenamed("v", "u").join(link.drop(graph), "u").groupBy(*keys).agg(F.bit_or("bits").alias("more"))
        known = fresh if before is None else fresh.unionByName(before).groupBy(*keys).agg(F.bit_or("bits").alias("bits"))
        joined = moved.join(known, keys, "left").withColumn("bits", F.col("more").bitwiseAND(F.bitwise_not(F.coalesce("bits", F.lit(0).cast("long")))))
        joined.select(*keys, "bits").where("bits <> 0").write.parquet(f"{path}/step={step}")
        before, fresh = fresh, spark.read.schema(columns).parquet(f"{path}/step={step}")
        if fresh.isEmpty():
            return spark.read.schema(f"{columns}, step int").parquet(path).groupBy(graph).agg(F.max("step").alias("far"))
        step += 1


def _diameters(link: DataFrame, graph: str, sources: int = 4096) -> DataFrame:
    """(graph, diameter) of connected graphs of two nodes or more: link (graph, u, v) has edges both ways between numbers of nodes that no two graphs share.

    As diameter(). A graph of up to LINKS links is searched by one task, unless that takes more than SEARCHES searches;
    of all others each step is a join, graphs side by side, `sources` nodes of each at a time.
    """
    name = link.schema[graph].dataType.simpleString()
    few = link.groupBy(graph).agg(F.count("*").alias("__links")).where(F.col("__links") <= LINKS).select(graph)
    searches = SEARCHES

    def search(t: pa.Table) -> pa.Table:
        far = _longest(t.column("u").to_numpy(), t.column("v").to_numpy(), searches)
        return pa.table([t.column(graph).slice(0, 1), pa.array([far], pa.int32())], names=[graph, "diameter"])

    found = written(link.join(few, graph, "left_semi").groupBy(graph).applyInArrow(search, f"`{graph}` {name}, diameter int").where("diameter is not null"))
    link = link.join(found, graph, "left_anti")
    if link.isEmpty():
        return found
    link = written(link)

    def farthest(levels: DataFrame) -> DataFrame:
        last = levels.groupBy(graph).agg(F.max(F.struct("level", (-F.col("v")).alias("w"))).alias("x"))
        return written(last.select(graph, (-F.col("x.w")).alias("v"), F.col("x.level").alias("diameter")))

    best = written(link.groupBy(graph).agg(F.min("u").alias("v")).withColumn("diameter", F.lit(0)))  # and the middle of what is longest
    for _ in range(SWEEPS):
        one = _distances(link, farthest(_distances(link, best.select(graph, "v"), graph)), graph)
        other = farthest(one)
        two, far = _distances(link, other, graph).withColumnRenamed("level", "back"), other.select(graph, F.col("diameter").alias("__far"))
        middle = (F.col("level") + F.col("back") == F.col("__far")) & (F.col("level") == F.floor(F.col("__far") / 2))
        path = one.join(two, [graph, "v"]).join(far, graph).where(middle).groupBy(graph).agg(F.min("v").alias("__v"), F.first("__far").alias("__far"))
        longer = F.col("__far") > F.col("diameter")
        best = written(best.join(path, graph).select(graph, F.when(longer, F.col("__v")).otherwise(F.col("v")).alias("v"), F.greatest("__far", "diameter").alias("diameter")))
    levels, best = _distances(link, best.select(graph, "v"), graph), best.select(graph, "diameter")
    for i in range(levels.agg(F.max("level")).first()[0], 0, -1):
        at = levels.where(F.col("level") == i).join(best.where(F.col("diameter") < 2 * i), graph, "left_semi")
        parts = at.groupBy(graph).agg(F.ceil(F.count("*") / sources).alias("__parts"))
        dealt = written(at.join(parts, graph).select(graph, "v", F.pmod(F.xxhash64("v"), F.col("__parts")).alias("__part")))
        for part in range((dealt.agg(F.max("__part")).first()[0] or 0) + 1):
            some = written(dealt.where(F.col("__part") == part).join(best.where(F.col("diameter") < 2 * i), graph, "left_semi").select(graph, "v"))
            if some.isEmpty():
                continue
            far = _eccentricities(link, some, graph)
            best = written(best.join(far, graph, "left").select(graph, F.greatest("diameter", F.coalesce("far", F.lit(0))).alias("diameter")))
        if best.where(F.col("diameter") < 2 * (i - 1)).isEmpty():
            break
    return found.unionByName(best)


def diameter(edges: DataFrame, sources: int = 4096) -> int:
    """The longest of the shortest paths of a connected graph, exact, by a few searches (iFUB; Crescenzi et al., 2013).

    Two searches find a long path, whose length is a lower bound, and a node in its middle; from there again, while paths get
    longer (where searches are joins, once more), so a start among hubs does no harm. Nodes at most i steps from
    there are at most 2 i from each other, so levels are taken from the outside in, `sources` nodes at a time, until the
    longest path found is as long as those within the next level can be.
    """
    far = _diameters(written(_linked(edges).select(F.lit(0).alias("graph"), "u", "v")), "graph", sources).first()
    return far.diameter if far else 0


#: The measures of many graphs, all numbers.
MEASURES = ("num_nodes", "num_edges", "average_degree", "density", "average_clustering", "isolated", "num_components", "giant_size", "mean_size", "diameter")


def many_metrics(nodes: DataFrame, edges: DataFrame, graph: str = "graph") -> DataFrame:
    """A row of MEASURES for each of many graphs (nodes: graph, entity_id; edges: graph, src, tgt), and `error`, all in one job.

    Nodes of all graphs are numbered together, so graphs of any number and size lie side by side. A graph that has an edge
    with a null or unknown end has no measures but what is wrong with it. The diameter of a graph of several components is
    infinite; that of a connected one takes a few searches, as in diameter(). Others as in metrics().
    """
    n0 = nodes.select(graph, "entity_id").distinct()
    ends = edges.select(graph, F.explode(F.array("src", "tgt")).alias("entity_id")).distinct()
    known = n0.withColumn("__known", F.lit(True))
    loose = ends.join(known, [graph, "entity_id"], "left").where("__known is null").groupBy(graph).agg(F.count_if(F.col("entity_id").isNull()).alias("__null"), F.min("entity_id").alias("__least"))
    wrong = written(loose.select(graph, F.when(F.col("__null") > 0, "an edge has no end").otherwise(F.concat(F.lit("an edge ends in no node: "), "__least")).alias("error")))
    n = n0.where("entity_id is not null").join(wrong.select(graph), graph, "left_anti")
    n = written(numbered(n, [F.col(graph), F.col("entity_id")], "node", kind="long"))
    a, b = (n.select(graph, F.col("entity_id").alias(end), F.col("node").alias(c)) for end, c in (("src", "a"), ("tgt", "b")))
    e = written(canonical(edges.select(graph, "src", "tgt")).join(a, [graph, "src"]).join(b, [graph, "tgt"]).select(graph, "a", "b").distinct())  # graphs with errors have no numbers
    link = e.select(graph, F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("x")).select(graph, "x.u", "x.v")
    d = written(n.select(graph, "node").join(link.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("degree")), "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0))))
    # Triangles over edges directed to the higher degree.
    da, db = (d.select(F.col("node").alias(c), F.struct("degree", "node").alias(f"d{c}")) for c in ("a", "b"))
    forward = F.col("da") < F.col("db")
    directed = written(e.select("a", "b").join(da, "a").join(db, "b").select(F.when(forward, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(forward, F.col("b")).otherwise(F.col("a")).alias("y")))
    closed = directed.join(directed.withColumnRenamed("y", "z"), "x").where("y < z").join(e.select(F.col("a").alias("y"), F.col("b").alias("z")), ["y", "z"])
    triangles = closed.select(F.explode(F.array("x", "y", "z")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))
    wedges = F.col("degree") * (F.col("degree") - 1)
    local = d.join(triangles, "node", "left").withColumn("local", F.when(F.col("degree") > 1, 2 * F.coalesce("triangles", F.lit(0)) / wedges))
    by_node = local.groupBy(graph).agg(F.count("*").alias("num_nodes"), (F.sum("degree") / 2).cast("long").alias("num_edges"), F.avg("degree").alias("average_degree"), F.avg("local").alias("average_clustering"), F.count_if(F.col("degree") == 0).alias("isolated"))
    sizes = d.join(components(e), "node", "left").groupBy(graph, F.coalesce("root", "node").alias("root")).agg(F.count("*").alias("size"))
    by_size = written(sizes.groupBy(graph).agg(F.count("*").alias("num_components"), F.max("size").alias("giant_size"), F.coalesce(F.avg(F.when(F.col("size") > 1, F.col("size"))), F.lit(0.0)).alias("mean_size")))
    far = _diameters(written(link.join(by_size.where("num_components = 1").select(graph), graph, "left_semi")), graph)
    out = by_node.join(by_size, graph).join(far, graph, "left")
    out = out.withColumn("density", F.when(F.col("num_nodes") > 1, 2 * F.col("num_edges") / (F.col("num_nodes") * (F.col("num_nodes") - 1))).otherwise(0.0))
    out = out.withColumn("diameter", F.when(F.col("num_components") > 1, float("inf")).otherwise(F.coalesce("diameter", F.lit(0)).cast("double")))
    return out.select(graph, *MEASURES, F.lit(None).cast("string").alias("error")).unionByName(wrong, allowMissingColumns=True)


def mean_metrics(measures: DataFrame, columns: list[str]) -> DataFrame:
    """The mean of each measure over graphs (a row each); an infinite one makes its mean infinite."""
    return measures.agg(F.count("*").alias("graphs"), *(F.avg(F.col(c).cast("double")).alias(c) for c in columns))


def export_pairs(edges: DataFrame) -> DataFrame:
    """Edges in both directions, as exports list them."""
    rest = [c for c in edges.columns if c not in ("src", "tgt")]
    return edges.select("src", "tgt", *rest).unionByName(edges.select(F.col("tgt").alias("src"), F.col("src").alias("tgt"), *rest))
