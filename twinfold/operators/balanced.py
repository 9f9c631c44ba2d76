"""Rows per hashed-frequency value (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.operators.skew import dense_counts

FIELDS = ["question1_hash_count", "question2_hash_count"]


def value_keys(df: DataFrame) -> DataFrame:
    """Values times 10,000, rounded half up to long; null and NaN give null."""
    return df.select(*(F.when(~F.isnan(f), F.round(F.col(f) * 10000).cast("long")).alias(f) for f in FIELDS))


def frequency_values(df: DataFrame) -> DataFrame:
    """(field_name, value_key, n_rows): rows of every value of both fields, rows counted as they stand."""
    return dense_counts(value_keys(df), FIELDS).drop("total")


def p5_values(spark: SparkSession, d: str) -> DataFrame:
    return frequency_values(spark.read.parquet(f"{d}/train_hashed_idf.parquet"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Values that hold a twentieth of a field's rows or more. The totals are two rows, made from the per-value counts."""
    counts = p5_values(spark, d)
    totals = counts.groupBy("field_name").agg(F.sum("n_rows").alias("n"))
    return counts.join(F.broadcast(totals), "field_name").filter(F.col("n_rows") * 20 >= F.col("n")).select("field_name", "value_key")


_KEYED = " UNION ALL ".join(f"SELECT '{f}' AS field_name, CAST(round({f} * 10000) AS BIGINT) AS value_key FROM train_hashed_idf WHERE {f} IS NOT NULL AND NOT isnan({f})" for f in FIELDS)
SQL = {
    "p5_values": f"SELECT field_name, value_key, count(*) AS n_rows FROM ({_KEYED}) GROUP BY 1, 2",
    "p5_found": f"WITH k AS ({_KEYED}), n AS (SELECT field_name, count(*) AS n FROM k GROUP BY 1), c AS (SELECT field_name, value_key, count(*) AS n_rows FROM k GROUP BY 1, 2) SELECT c.field_name, c.value_key FROM c JOIN n USING (field_name) WHERE c.n_rows * 20 >= n.n",
}
QUERIES = {"p5_found": p5_found, "p5_values": p5_values}
