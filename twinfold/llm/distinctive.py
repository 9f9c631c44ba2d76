"""How distinctive a term is per record (problem 6), by divergence from randomness (model G L 2).

Information content of the normalised term frequency under a geometric collection model, times the
Laplace after-effect gain; the term frequency is normalised by the record's length against the mean.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.functions.text import words
from twinfold.operators.skew import HEAVY_SHARE


def terms(df: DataFrame, id_col: str = "id", q1: str = "question1", q2: str = "question2") -> DataFrame:
    """(id, term, tf, length, shared): the distinct words of each record; shared if in both questions. Null questions have no words."""
    none = F.array().cast("array<string>")
    t = df.select(F.col(id_col).alias("id"), F.coalesce(words(F.col(q1)), none).alias("w1"), F.coalesce(words(F.col(q2)), none).alias("w2"))
    once = (F.size(F.array_distinct("w1")) == F.size("w1")) & (F.size(F.array_distinct("w2")) == F.size("w2"))
    t = t.select("id", F.concat("w1", "w2").alias("w"), F.array_intersect("w1", "w2").alias("both"), once.alias("once"))
    t = t.select("id", "w", "both", "once", F.size("w").alias("length"), F.explode(F.array_distinct("w")).alias("term"))
    shared = F.array_contains("both", F.col("term"))
    counted = F.col("length") - F.size(F.array_remove("w", F.col("term")))  # only where a question repeats a word
    return t.select("id", "term", F.when(F.col("once"), 1 + shared.cast("int")).otherwise(counted).alias("tf"), "length", shared.alias("shared"))


def scores(df: DataFrame, id_col: str = "id", q1: str = "question1", q2: str = "question2", c: float = 1.0) -> DataFrame:
    """(id, term, n_rows, shared, score) for every distinct word of every record.

    n_rows: records that hold the word in either question. Counts are over all records, those with a null
    question too; a record without words has no rows, nor has an empty table. Two records under one id each
    have rows. The counts of a word are combined before the shuffle. Words in more than a thousandth of
    the records, of which there are at most a thousand times the mean words of a record, are joined where their rows are;
    only the rows of rarer words are shuffled.
    """
    t = terms(df, id_col, q1, q2)
    n = df.count()
    stats = t.groupBy("term").agg(F.count("*").alias("n_rows"), F.sum("tf").alias("freq"))
    frequent = F.broadcast(stats.filter(F.col("n_rows") > F.lit(HEAVY_SHARE * n)))
    j = t.join(frequent, "term").unionByName(t.join(frequent.select("term"), "term", "left_anti").join(stats, "term"))
    total = F.broadcast(stats.agg((F.sum("freq") / F.lit(float(max(n, 1)))).alias("mean")))  # one row
    j = j.crossJoin(total)
    rate = F.col("freq") / F.lit(float(max(n, 1)))
    tfn = F.col("tf") * F.log2(1 + F.lit(c) * F.col("mean") / F.col("length"))
    score = (F.log2(1 + rate) + tfn * F.log2((1 + rate) / rate)) / (1 + tfn)
    return j.select("id", "term", "n_rows", "shared", score.alias("score"))


def p6_scores(spark: SparkSession, d: str) -> DataFrame:
    return scores(spark.read.parquet(f"{d}/train.parquet")).withColumn("score", F.round("score", 6))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return scores(spark.read.parquet(f"{d}/train.parquet")).filter("shared and n_rows <= 3").select("id", "term")


_T = r"""w AS (SELECT id, regexp_extract_all(lower(coalesce(question1, '')), '[\p{L}\p{N}]+') AS w1, regexp_extract_all(lower(coalesce(question2, '')), '[\p{L}\p{N}]+') AS w2 FROM train),
t AS (SELECT id, term, count(*) AS tf, bool_or(side = 1) AND bool_or(side = 2) AS shared, any_value(length) AS length FROM (SELECT id, unnest(w1) AS term, 1 AS side, len(w1) + len(w2) AS length FROM w UNION ALL SELECT id, unnest(w2), 2, len(w1) + len(w2) FROM w) GROUP BY id, term),
s AS (SELECT term, count(*) AS n_rows, sum(tf) AS freq FROM t GROUP BY term)"""
SQL = {
    "p6_found": f"WITH {_T} SELECT id, term FROM t JOIN s USING (term) WHERE shared AND n_rows <= 3",
    "p6_scores": f"WITH {_T}, k AS (SELECT count(*) AS n, sum(len(w1) + len(w2)) / count(*) AS mean FROM w), j AS (SELECT id, term, n_rows, shared, freq / n AS rate, tf * log2(1 + mean / length) AS tfn FROM t JOIN s USING (term), k) SELECT id, term, n_rows, shared, round((log2(1 + rate) + tfn * log2((1 + rate) / rate)) / (1 + tfn), 6) AS score FROM j",
}
QUERIES = {"p6_found": p6_found, "p6_scores": p6_scores}
