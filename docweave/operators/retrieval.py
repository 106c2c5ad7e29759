"""From ranked hits to context: local, global and mixed retrieval.

Everything is for many requests at once: `by` names the columns that tell requests apart (none: a single request), and
ranked lists of a request are ordered within them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import json_line

from . import graph, provenance, vector
from .ranking import numbered


def ranked_nodes(hits: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Hits (by, entity_id, score, rank) that are nodes, in their order, with degree (zero without an edge)."""
    return graph.with_degrees_of(hits.join(nodes, "entity_id"), edges)


def local(hits: DataFrame, nodes: DataFrame, edges: DataFrame, by: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Nodes of the hits, and their edges ranked by the best score of an end, weight and degree.

    The edges of the hits are found first, so degrees are counted for their ends only.
    """
    names = hits.select("entity_id").distinct()
    near = edges.join(names.withColumnRenamed("entity_id", "src"), "src", "left_semi").unionByName(edges.join(names.withColumnRenamed("entity_id", "tgt"), "tgt", "left_semi").select(edges.columns))
    near = graph.edge_degrees_of(near.dropDuplicates(["src", "tgt"]), edges)
    if by:
        ends = near.select("src", "tgt", F.explode(F.array("src", "tgt")).alias("entity_id")).join(hits.select(*by, "entity_id"), "entity_id")
        near = near.join(ends.select(*by, "src", "tgt").distinct(), ["src", "tgt"])
    return ranked_nodes(hits, nodes, edges), graph.rank_edges(near, hits, by)


def global_(hits: DataFrame, nodes: DataFrame, edges: DataFrame, by: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Edges of relation hits (by, src, tgt, score, rank) in their order, and their ends as they are first seen (`position`)."""
    found = graph.canonical(hits).join(edges, ["src", "tgt"])
    ends = found.select(*by, "rank", F.posexplode(F.array("src", "tgt")).alias("end", "entity_id"))
    first = ends.groupBy(*by, "entity_id").agg(F.min(F.struct("rank", "end")).alias("f")).join(nodes, "entity_id")
    return found, numbered(first, [F.col("f.rank"), F.col("f.end"), F.col("entity_id")], "position", by).drop("f")


def related_chunks(items: DataFrame, owned: DataFrame, item: str, most: int, method: str = "WEIGHT", exclude: DataFrame | None = None, by: list[str] = (), vectors: DataFrame | None = None, queries: DataFrame | None = None) -> DataFrame:
    """Chunks of ranked items (by, item, item_rank from 0) by their sources (item, position, chunk_id), in the order of `pick`.

    WEIGHT: quotas that fall with the rank. VECTOR: by similarity to the request (vectors: vec_id, embedding; queries:
    by, query), most * items / 2 of them; requests that lack a vector of one of their chunks fall back to WEIGHT. Chunks of
    exclude (by, chunk_id) are left out, as those that entities gave already.
    """
    own = items.select(*by, item, "item_rank").join(owned, item)
    if exclude is not None:
        own = own.join(exclude.select(*by, "chunk_id"), [*by, "chunk_id"], "left_anti")
    counted = provenance.occurrences(own, "item_rank", "position", "chunk_id", by)
    # In an item, chunks that more items have come first.
    placed = numbered(counted, [F.desc("occurrences"), F.col("position"), F.col("chunk_id")], "place", [*by, "item_rank"])
    if method.upper() != "VECTOR" or vectors is None or queries is None:
        return provenance.weighted_polling(placed, "item_rank", "place", "chunk_id", most, by=by)
    scored = placed.join(vectors.select(F.col("vec_id").alias("chunk_id"), "embedding"), "chunk_id", "left").join(queries.select(*by, "query"), list(by))
    scored = scored.withColumn("score", vector.cosine(F.col("embedding"), F.col("query"))).drop("embedding", "query")
    facts = scored.groupBy(*by).agg(F.count_if(F.col("score").isNull()).alias("__lacking"), F.floor(F.lit(most) * F.countDistinct("item_rank") / 2).alias("__most"))
    picked = numbered(scored.join(facts.where("__lacking = 0"), list(by)), [F.desc("score"), F.col("chunk_id")], "pick", by)
    picked = picked.where("pick <= __most").drop("__lacking", "__most", "score")
    rest = placed.join(facts.where("__lacking > 0").select(*by), list(by), "left_semi")
    return picked.unionByName(provenance.weighted_polling(rest, "item_rank", "place", "chunk_id", most, by=by).select(picked.columns))


def chunk_cost(content: Column, file_path: Column, chunk_id: Column, tokens: Callable[[Column], Column] = F.length) -> Column:
    """What a chunk takes of a budget: the tokens of the line of JSON of its whole row, two fields of it as they are without images."""
    line = json_line(content=content, file_path=file_path, chunk_id=chunk_id)
    return tokens(F.concat(line, F.lit(', "is_multimodal": false, "page_idx": null')))


def context(chunks: DataFrame, budget: int | Column, top_k: int | None = None, least_score: float = 0.0, by: list[str] = (), cost: Column | None = None) -> DataFrame:
    """Ranked chunks (by, chunk_id, content, file_path, position, rerank_score?) that a token budget holds, with DC ids and reference ids."""
    if "rerank_score" in chunks.columns:
        chunks = chunks.where(F.coalesce("rerank_score", F.lit(1.0)) >= least_score)
    chunks = numbered(chunks, [F.col("position"), F.col("chunk_id")], "n", by)
    chunks = chunks if top_k is None else chunks.where(F.col("n") <= top_k)
    kept = provenance.within_budget(chunks, F.length("content") if cost is None else cost, [F.col("n")], budget, by)
    refs = provenance.reference_list(kept, "file_path", "n", by).select(*by, "file_path", "reference_id")
    out = kept.join(refs, [*by, "file_path"], "left").withColumn("reference_id", F.coalesce("reference_id", F.lit("")))
    return out.withColumn("id", F.concat(F.lit("DC"), F.col("n"))).drop("n")
