"""Roll-ups of judged answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranking import numbered

#: Groups of question types, and the first file of each domain.
TYPE_GROUPS = {"text-only": "Txt.", "multimodal-f": "Mm.", "multimodal-t": "Mm.", "meta-data": "Mm.", "una-web": "Una.", "unanswerable": "Una."}
OFFICIAL_GROUPS = {"text-only": "text", "multimodal-f": "mm", "multimodal-t": "mm", "multimodal": "mm", "meta-data": "meta"}
DOMAINS = ((0, 48, "aca"), (49, 88, "fin"), (89, 132, "gov"), (133, 178, "law"), (179, 228, "new"))


def domain(file_no: Column) -> Column:
    """The domain of a file number by its range, the first that holds."""
    out = F.lit(None).cast("string")
    for first, last, name in reversed(DOMAINS):
        out = F.when(file_no.between(first, last), F.lit(name)).otherwise(out)
    return out


def type_group(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, group in TYPE_GROUPS.items():
        out = F.when(kind == name, F.lit(group)).otherwise(out)
    return out


def accuracy(df: DataFrame, levels: list[str], score: str = "score") -> DataFrame:
    """Accuracy in per cent overall and by each level: level, value, correct, total. Rows without a value don't count for a level."""
    whole = F.struct(F.lit("overall").alias("level"), F.lit("all").alias("value"))
    each = [F.struct(F.lit(c).alias("level"), F.col(c).alias("value")) for c in levels]
    long = df.select(F.explode(F.array(whole, *each)).alias("k"), F.col(score).alias("s")).where(F.col("k.value").isNotNull())
    out = long.groupBy(F.col("k.level").alias("level"), F.col("k.value").alias("value")).agg(F.sum(F.col("s").cast("long")).alias("correct"), F.count("*").alias("total"))
    return out.withColumn("accuracy", F.round(100.0 * F.col("correct") / F.col("total"), 6))


def official(df: DataFrame, verdict: str = "eval", kind: str = "type") -> DataFrame:
    """The published score: a share of verdicts with a 1 in their first 20 characters overall; by type one less the share with a 0."""
    head = F.substring(verdict, 1, 20)
    all_ = df.agg(F.lit("micro").alias("kind"), F.avg(head.contains("1").cast("double")).alias("accuracy"), F.count("*").alias("total"))
    group = F.lit("una")
    for name, g in OFFICIAL_GROUPS.items():
        group = F.when(F.col(kind) == name, F.lit(g)).otherwise(group)
    by = df.groupBy(group.alias("kind")).agg((1 - F.sum(head.contains("0").cast("long")) / F.count("*")).alias("accuracy"), F.count("*").alias("total"))
    return all_.unionByName(by).withColumn("accuracy", F.round("accuracy", 6))


def nan_means(df: DataFrame, columns: list[str]) -> DataFrame:
    """Of each measure the mean of what is a number, rounded to four digits, least, greatest, and how many were."""
    real = lambda c: F.when(~F.isnan(c) & F.col(c).isNotNull(), F.col(c))
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("measure"), real(c).alias("v")) for c in columns))).alias("x"))
    return long.groupBy(F.col("x.measure").alias("measure")).agg(F.round(F.avg("x.v"), 4).alias("mean"), F.min("x.v").alias("least"), F.max("x.v").alias("greatest"), F.count("x.v").alias("n"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Lines of JSON (question, answer, type, evidence) with the file they are of and their line, from 1."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")).alias("line", "value"))
    return lines.select("path", (F.col("line") + 1).alias("line"), F.from_json("value", "question string, answer string, type string, evidence string").alias("q")).select("path", "line", "q.*")


def by_line(questions: DataFrame, answers: DataFrame, key: list[str], order: str) -> DataFrame:
    """Questions and the answers of the same place, by the order of each in its file; those without a partner fall out."""
    q, a = (numbered(df, [F.col(order)], "line", key).drop(order) for df in (questions, answers))
    return q.join(a, [*key, "line"])


def export_scores(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Rows of scores as csv or json; numbers that are none are empty."""
    flat = df.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes))
    if kind == "csv":
        flat.write.csv(path, header=True, escape='"')
    else:
        flat.write.json(path)
