"""Full-text search over labels: posting lists of words and of pairs of CJK characters, BM25, an early stop by lists' maxima."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import written

K1, B = 1.2, 0.75
#: Words are runs of letters and digits outside of CJK; a run of CJK characters gives its pairs, a lone one itself.
_CJK = r"぀-ヿ㐀-䶿一-鿿가-힯"
_WORD, _RUN = rf"[\p{{L}}\p{{N}}&&[^{_CJK}]]+", rf"[{_CJK}]+"


def tokens(text: Column) -> Column:
    """array<string>: the words of a text in lower case, repeats included, then the pairs of its CJK runs."""
    low = F.lower(text)
    words = F.regexp_extract_all(low, F.lit(f"({_WORD})"))
    pairs = F.transform(F.regexp_extract_all(low, F.lit(f"({_RUN})")), lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: r.substr(i, F.lit(2)))))
    return F.concat(words, F.flatten(pairs))


class LabelIndex:
    """Postings below a path: (bucket, token, label, weight), and facts of each token's list. Buckets are partitions by a hash of the token."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _bucket(self, token: Column) -> Column:
        return F.pmod(F.xxhash64(token), F.lit(self.buckets)).cast("int")

    def build(self, labels: DataFrame, label: str = "entity_id") -> LabelIndex:
        """Indexes distinct labels. A posting has its BM25 weight, so a search adds up weights; a list has its greatest one.

        A token that a third of all labels have is spread over tasks: counts have partial sums, weights come by a join.
        """
        each = written(labels.select(F.col(label).alias("label")).where("label is not null").distinct().withColumn("t", tokens(F.col("label"))))
        whole = each.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("mean"))
        tf = each.select("label", F.size("t").alias("len"), F.explode("t").alias("token")).groupBy("label", "len", "token").agg(F.count("*").alias("tf"))
        df = tf.groupBy("token").agg(F.count("*").alias("df"))
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
        rows = tf.join(df, "token").join(F.broadcast(whole)).select("token", "label", weight.alias("weight"), self._bucket(F.col("token")).alias("bucket"))
        rows.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/postings")
        stored = self.spark.read.parquet(f"{self.path}/postings")
        stored.groupBy("bucket", "token").agg(F.max("weight").alias("most"), F.count("*").alias("n")).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/lists")
        return self

    def _of(self, table: str, words: list[str]) -> DataFrame:
        read = self.spark.read.parquet(f"{self.path}/{table}")
        buckets = [r[0] for r in self.spark.createDataFrame([(w,) for w in words], "w string").select(self._bucket(F.col("w"))).distinct().collect()]  # of one query's words
        return read.where(F.col("bucket").isin(buckets) & F.col("token").isin(words))

    def search(self, query: str, limit: int = 50) -> DataFrame:
        """(label, score): the labels of greatest BM25 score, ties to the lesser label; of at least one word of the query.

        The lists of greatest maxima come first. What they give is a lower bound of the limit-th score; lists whose
        maxima cannot reach it together are then read for the labels found so far only. The result is that of all lists.
        """
        words = sorted(set(self.spark.range(1).select(F.explode(tokens(F.lit(query)))).toPandas().iloc[:, 0])) if query.strip() else []
        facts = sorted(((r.most, r.token) for r in self._of("lists", words).collect()), reverse=True) if words else []  # a row a word of the query
        empty = self.spark.createDataFrame([], "label string, score double")
        if not facts:
            return empty
        first, rest = self._split(facts, limit)
        posts = self._of("postings", [t for _, t in first])
        found = posts.groupBy("label").agg(F.sum("weight").alias("score"))
        if rest:
            more = self._of("postings", [t for _, t in rest]).select("label", "weight")
            known = more.join(found.select("label"), "label", "left_semi")
            found = found.unionByName(known.select("label", F.col("weight").alias("score"))).groupBy("label").agg(F.sum("score").alias("score"))
        # Sums of one set of weights differ in their last digits with the order of adding; ties are ties of nine places.
        return found.withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "label").limit(limit)

    def _split(self, facts: list[tuple[float, str]], limit: int) -> tuple[list, list]:
        """The lists that any result must be in one of, and those that only add to a score."""
        top = self._of("postings", [facts[0][1]]).orderBy(F.desc("weight"), "label").limit(limit).select("weight").collect()
        bound = top[-1].weight if len(top) == limit else 0.0
        rest: list[tuple[float, str]] = []
        for most, token in reversed(facts[1:]):
            if sum(m for m, _ in rest) + most >= bound - 1e-6:
                break
            rest.append((most, token))
        return facts[: len(facts) - len(rest)], rest


def search_many(index: LabelIndex, queries: DataFrame, limit: int = 50) -> DataFrame:
    """(query_id, label, score, rank) of many queries (query_id, query) by one join with the postings."""
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("token")).withColumn("bucket", index._bucket(F.col("token")))
    read = index.spark.read.parquet(f"{index.path}/postings")
    found = read.join(asked, ["bucket", "token"]).groupBy("query_id", "label").agg(F.sum("weight").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "label"))
    found = found.withColumn("score", F.round("score", 9))
    return found.withColumn("rank", rank).where(F.col("rank") <= limit)
