"""Queries of what goes into models and comes out of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.functions import prompts

from .base import registry, spread, table

QUERIES, SQL, query = registry()


@query(r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents)
SELECT doc_id, md5(CASE WHEN lang = 'es' THEN '\alpha ' ELSE '' END || text) AS description, source AS entity_name, lang AS entity_type, substring(text, 1, 100) AS summary FROM d
""")
def modal_answers(spark, sf):
    """Answers in JSON about all documents, which models break in one way a language: commas before ends, prose with braces, fences, bare backslashes."""
    c = lambda name: F.coalesce(F.col(name), F.lit(""))
    info = F.struct(c("source").alias("entity_name"), c("lang").alias("entity_type"), F.substring(c("text"), 1, 100).alias("summary"))
    whole = F.to_json(F.struct(c("text").alias("detailed_description"), info.alias("entity_info")))
    broken = (
        F.when(F.col("lang") == "de", F.concat(F.left(whole, F.length(whole) - 1), F.lit(",\n}")))
        .when(F.col("lang") == "fr", F.concat(F.lit("<think>{}</think> In {braces}: ```json\n"), whole, F.lit("\n``` and {more}")))
        .when(F.col("lang") == "es", F.replace(whole, F.lit('{"detailed_description":"'), F.lit('see { {"detailed_description":"\\alpha ')))
        .otherwise(F.concat(F.lit("Here: "), whole, F.lit(" }")))
    )
    x = prompts.parsed_modal_answer(broken)
    found = spread(table(spark, sf, "documents")).select("doc_id", x.alias("x"))
    return found.select("doc_id", F.md5("x.detailed_description").alias("description"), "x.entity_name", "x.entity_type", "x.summary")


@query(r"""
WITH l AS (SELECT conv_id, turn, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM conversations)
SELECT conv_id, CAST(turn + 1 AS INTEGER) AS number, string_agg(trim(CASE WHEN i = 1 THEN (turn + 1) || '. ' || line ELSE line END, E' \t\r\n'), '' ORDER BY i) AS answer FROM l GROUP BY conv_id, turn
""")
def answers_numbered(spark, sf):
    """The turns of all conversations, a numbered answer each, read back from the conversation's lines."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "line"))
    said = F.when(F.col("i") == 0, F.concat((F.col("turn") + 1).cast("string"), F.lit(". "), "line")).otherwise(F.col("line"))
    lines = c.select("conv_id", F.struct("turn", "i").alias("line"), said.alias("text"))
    return prompts.numbered_answers(lines, ["conv_id"])


@query(r"""
WITH q AS (SELECT conv_id, turn + 1 AS turn, text AS question FROM conversations WHERE role = 'user'),
a AS (SELECT c.conv_id, c.turn, trim(coalesce(text, ''), E' \t\r\n') AS context, trim(coalesce(question, ''), E' \t\r\n') AS question FROM conversations c JOIN q USING (conv_id, turn))
SELECT conv_id, turn, 'Answer as conversation ' || conv_id || ' does.' || chr(10) || 'Additional Instructions: turn ' || turn AS system,
       '---Context---' || CASE WHEN context = '' THEN '' ELSE chr(10) || context END || CASE WHEN question = '' THEN '' ELSE chr(10) || chr(10) || 'User Question: ' || question || chr(10) || chr(10) || 'Please answer based on the context provided.' END AS "user"
FROM a
""")
def messages_repacked(spark, sf):
    """What follows a user's turn as the context of a system prompt, with the user's turn as its question: taken apart anew."""
    c = table(spark, sf, "conversations")
    asked = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    head = F.concat(F.lit("Answer as conversation "), "conv_id", F.lit(" does.\n2. Additional Instructions: None\nAdditional Instructions: turn "), "turn")
    stale = F.concat(F.lit("\nUser Query: "), F.split(F.coalesce("question", F.lit("")), "\n")[0], F.lit("\nPlease answer based on the context and images provided.\n---User Query---\n"), F.coalesce("question", F.lit("")))
    system = F.concat(head, F.lit("\n---Context---\n"), F.coalesce("text", F.lit("")), stale)
    rows = c.join(asked, ["conv_id", "turn"]).select("conv_id", "turn", prompts.repacked(system, F.col("question")).alias("x"))
    return rows.select("conv_id", "turn", "x.system", "x.user")
