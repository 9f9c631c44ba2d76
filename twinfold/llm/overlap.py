"""Same or near-same records across splits (problem 1).

Records are canonicalised (case, punctuation, white space, order of the two questions) and hashed;
evaluation hashes are joined with training hashes. For records that are only almost the same, the hashes
of the canonical record's rare words take the place of the hash of the whole (module matching): two
matching records share one of them, whatever the edit; the words themselves then decide.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.llm import matching as M
from twinfold.llm.matching_sql import matching_sql
from twinfold.operators.skew import salted_join
from twinfold.session import cut


def _same(h: np.ndarray) -> np.ndarray:
    return h


def class_overlaps(a: DataFrame, b: DataFrame, split_above: int = M.SPLIT_ABOVE) -> DataFrame:
    """(a, b): classes of the two tables that match."""
    ha, hb = M.with_hashes(a), M.with_hashes(b)
    rare = M.rarity(ha.withColumn("side", F.lit(0)).union(hb.withColumn("side", F.lit(1))), M.n_blocks(a.count() + b.count()), sided=True)
    found = cut(M.candidates(M.band_keys(ha, rare, split_above, _same), M.band_keys(hb, rare, split_above, _same), False))
    return cut(M.confirmed(M.with_texts(found, a, b)).union(M.same_root(a, b, False)).distinct())


def overlaps(train: DataFrame, test: DataFrame, train_id: str = "id", test_id: str = "test_id", q1: str = "question1", q2: str = "question2", split_above: int = M.SPLIT_ABOVE) -> DataFrame:
    """(id, test_id): every record of ``train`` and of ``test`` that match, copies included.

    Records with a null, empty or wordless question match nothing; if either table is empty there are no rows.
    """
    rows_a, a = M.prepared(train, train_id, q1, q2)
    rows_b, b = M.prepared(test, test_id, q1, q2)
    pairs = class_overlaps(a, b, split_above)
    ma, mb = cut(M.members(rows_a, a)), cut(M.members(rows_b, b))
    return M.spread(M.spread(pairs, "a", "id", ma, pairs), "b", "test_id", mb, pairs).select("id", "test_id")


def overlap_counts(train: DataFrame, test: DataFrame, train_id: str = "id", test_id: str = "test_id", q1: str = "question1", q2: str = "question2", split_above: int = M.SPLIT_ABOVE) -> DataFrame:
    """(test_id, n): per record of ``test`` that overlaps, the records of ``train`` that match it, counted by classes: no pair of records is made."""
    _, a = M.prepared(train, train_id, q1, q2)
    rows_b, b = M.prepared(test, test_id, q1, q2)
    pairs = class_overlaps(a, b, split_above)
    sized = salted_join(pairs, a.select(F.col("cid").alias("a"), "n"), ["a"], M.hubs(pairs, "a"), ["b"])
    per = sized.groupBy("b").agg(F.sum("n").alias("n"))
    return M.spread(per, "b", "test_id", cut(M.members(rows_b, b)))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return overlaps(spark.read.parquet(f"{d}/train.parquet"), spark.read.parquet(f"{d}/test.parquet"))


def report(per: DataFrame, test: DataFrame, by: tuple[str, ...] = ("split_name", "source")) -> DataFrame:
    """Per split and source: test rows, overlapping test rows, and overlapping pairs. Null split or source is a group of its own."""
    t = test.select("test_id", *by).join(per, "test_id", "left")
    return t.groupBy(*by).agg(F.count("*").alias("n_rows"), F.count("n").alias("n_overlapping"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    train, test = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("train", "test"))
    return report(overlap_counts(train, test), test)


_FOUND = matching_sql(("train", "id"), ("test", "test_id"), ("id", "test_id"))
SQL = {
    "p1_found": _FOUND,
    "p1_report": f"WITH o AS ({_FOUND}), k AS (SELECT test_id, count(*) AS n FROM o GROUP BY test_id) SELECT split_name, source, count(*) AS n_rows, count(n) AS n_overlapping, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_pairs FROM test LEFT JOIN k USING (test_id) GROUP BY 1, 2",
}
QUERIES = {"p1_found": p1_found, "p1_report": p1_report}
