"""Inverted lists: boolean and ranked retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import stage

#: BM25 parameters, and the least weight of a term.
B, K1, LEAST_IDF = 0.5, 1.2, 1e-6


def terms(column: str):
    """Words of a text, runs of letters of any script, in lower case."""
    return F.regexp_extract_all(F.lower(column), F.lit(r"(\p{L}+)"), 1)


def kept(documents: DataFrame, id_column: str = "doc_id", text: str = "text", at: str | None = None) -> DataFrame:
    """``postings`` as a written table, in the folder ``at`` for later sessions (where it is there already it is only read), else in the session's shared folder.

    Everything that is asked of an index reads its lists several times; written once, texts are cut into words once.
    """
    if at is None:
        return stage(postings(documents, id_column, text))
    spark = documents.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{at.rstrip('/')}/_SUCCESS")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        postings(documents, id_column, text).write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def postings(documents: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """term, doc_id, freq. Null texts and ids give none."""
    words = documents.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("doc_id"), F.explode(terms(text)).alias("term"))
    return words.groupBy("term", "doc_id").agg(F.count("*").alias("freq"))


def query_terms(queries: DataFrame, id_column: str, text: str) -> DataFrame:
    """Queries as rows: qid, term, times (how often the query has the term)."""
    return postings(queries, id_column, text).select(F.col("doc_id").alias("qid"), "term", F.col("freq").alias("times"))


def lengths(index: DataFrame) -> DataFrame:
    """doc_id, norm: a document's length over the mean length."""
    each = index.groupBy("doc_id").agg(F.sum("freq").alias("len"))
    return each.select("doc_id", (F.col("len") / each.agg(F.avg("len")).scalar()).alias("norm"))


def weights(index: DataFrame) -> DataFrame:
    """term, df, idf."""
    df = index.groupBy("term").agg(F.count("*").alias("df")).withColumn("n", index.agg(F.countDistinct("doc_id")).scalar())
    return df.select("term", "df", F.greatest(F.lit(LEAST_IDF), F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("idf"))


def matching_all(index: DataFrame, queries: DataFrame) -> DataFrame:
    """qid, n: how many documents have every term of a query."""
    need = queries.groupBy("qid").agg(F.count("*").alias("need"))
    hits = queries.join(index, "term").groupBy("qid", "doc_id").agg(F.count("*").alias("have"))
    found = hits.join(need, "qid").where("have = need").groupBy("qid").agg(F.count("*").alias("n"))
    return need.join(found, "qid", "left").select("qid", F.coalesce("n", F.lit(0)).alias("n"))


def matching_any(index: DataFrame, queries: DataFrame) -> DataFrame:
    """qid, n: how many documents have a term of a query."""
    hits = queries.join(index, "term").select("qid", "doc_id").distinct().groupBy("qid").agg(F.count("*").alias("n"))
    return queries.select("qid").distinct().join(hits, "qid", "left").select("qid", F.coalesce("n", F.lit(0)).alias("n"))


def contributions(index: DataFrame, queries: DataFrame) -> DataFrame:
    """qid, doc_id, term, score: what each term adds."""
    part = queries.join(index, "term").join(weights(index), "term").join(lengths(index), "doc_id")
    f = F.col("freq")
    return part.select("qid", "doc_id", "term", (F.col("times") * F.col("idf") * f / (f + K1 * (1 - B + B * F.col("norm")))).alias("score"))


def ranked(index: DataFrame, queries: DataFrame, k: int = 10, every_term: bool = False) -> DataFrame:
    """The k best documents of each query by BM25: qid, rank, doc_id, score (to 6 places; ties by doc_id). ``every_term``: of those with all terms."""
    parts = contributions(index, queries)
    total = parts.groupBy("qid", "doc_id").agg(F.round(F.sum("score"), 6).alias("score"), F.count("*").alias("have"))
    if every_term:
        total = total.join(queries.groupBy("qid").agg(F.count("*").alias("need")), "qid").where("have = need")
    by = Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    return total.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("qid", "rank", "doc_id", "score")


def best_weights(index: DataFrame) -> DataFrame:
    """term, best: the largest score that a document has for a term asked once."""
    f = F.col("freq")
    each = index.join(lengths(index), "doc_id").join(weights(index), "term")
    return each.groupBy("term").agg(F.round(F.max(F.col("idf") * f / (f + K1 * (1 - B + B * F.col("norm")))), 6).alias("best"))


def long_lists(index: DataFrame, more_than: int) -> DataFrame:
    """term, n of the lists that are longer."""
    return index.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") > more_than)


def known_queries(queries: DataFrame, index: DataFrame) -> DataFrame:
    """The terms of queries that the index has."""
    return queries.join(index.select("term").distinct(), "term", "left_semi").select("qid", "term", "times")


def by_size(queries: DataFrame, most: int = 5) -> DataFrame:
    """terms, queries: how many queries have so many different terms; the last class has ``most`` or more."""
    each = queries.groupBy("qid").agg(F.count("*").alias("t"))
    return each.groupBy(F.least("t", F.lit(most)).alias("terms")).agg(F.count("*").alias("queries"))
