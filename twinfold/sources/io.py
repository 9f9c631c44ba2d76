"""Readers and writers: pair files, rules, embeddings, patterns, indexes, folds, submissions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRAIN_SCHEMA = "id long, qid1 long, qid2 long, question1 string, question2 string, is_duplicate int"
TEST_SCHEMA = "test_id long, question1 string, question2 string"


def read_pairs(spark: SparkSession, path: str, schema: str = TRAIN_SCHEMA, header: bool = True, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """A pair file with quoted, possibly many-line fields; columns by a declared schema, rows that don't fit become null."""
    return spark.read.csv(path, schema=schema, header=header, sep=sep, quote='"', escape='"', multiLine=True, encoding=encoding)


def union_splits(train: DataFrame, test: DataFrame) -> DataFrame:
    """Train and test in one table with column ``split``; columns that one of them lacks are null."""
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")), allowMissingColumns=True)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """(wrong, right) from lines ``wrong->right``; lines without an arrow are left out."""
    t = spark.read.text(path).filter(F.contains("value", F.lit("->")))
    return t.select(F.trim(F.split_part("value", F.lit("->"), F.lit(1))).alias("wrong"), F.trim(F.split_part("value", F.lit("->"), F.lit(2))).alias("right"))


def apply_rules(df: DataFrame, col: str, rules: DataFrame, most: int = 100_000) -> DataFrame:
    """Whole-word rewriting of a token column by a rule table, of which at most ``most`` rules are broadcast; larger ones are joined.

    Both ways give the same rows: repeated rows stay apart, a null list stays null, an empty one empty. Of several rules for a
    word the first by its right side counts.
    """
    once = rules.filter("wrong IS NOT NULL").groupBy("wrong").agg(F.min("right").alias("right"))
    if rules.limit(most + 1).count() <= most:
        table = F.broadcast(once.agg(F.map_from_entries(F.collect_list(F.struct("wrong", "right"))).alias("__rules")))
        return df.crossJoin(table).withColumn(col, F.transform(col, lambda w: F.coalesce(F.element_at("__rules", w), w))).drop("__rules")  # one row
    from twinfold.session import cut

    t = cut(df.withColumn("__row", F.monotonically_increasing_id()))  # written, so that a row keeps its number
    each = t.select("__row", F.posexplode(col).alias("__pos", "__w"))
    got = each.join(once.select(F.col("wrong").alias("__w"), F.col("right").alias("__r")), "__w", "left").select("__row", F.struct("__pos", F.coalesce("__r", "__w").alias("w")).alias("__x"))
    lists = got.groupBy("__row").agg(F.array_sort(F.collect_list("__x")).alias("__ws"))
    return t.join(lists, "__row", "left").select(*(F.when(F.col("__ws").isNotNull(), F.transform("__ws", lambda x: x["w"])).otherwise(F.col(c)).alias(c) if c == col else F.col(c) for c in df.columns))


def read_embeddings(spark: SparkSession, path: str, size: int) -> DataFrame:
    """(word, vec) from lines ``word f1 ... fn``; a header and lines of another length or with bad numbers are left out."""
    t = spark.read.text(path).select(F.split(F.trim("value"), " ").alias("p")).filter(F.size("p") == size + 1)
    t = t.select(F.element_at("p", 1).alias("word"), F.expr("transform(slice(p, 2, size(p) - 1), x -> try_cast(x AS FLOAT))").alias("vec"))
    return t.filter(~F.exists("vec", lambda x: x.isNull()))


def binary_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contents of binary vector files from (word, vec): one for every batch."""
    import numpy as np

    for b in batches:
        if b.num_rows:
            vecs = [np.asarray(v, np.float32) for v in b.column(1).to_pylist()]
            body = b"".join(w.encode() + b" " + v.tobytes() + b"\n" for w, v in zip(b.column(0).to_pylist(), vecs))
            yield pa.RecordBatch.from_arrays([pa.array([f"{b.num_rows} {len(vecs[0])}\n".encode() + body], pa.binary())], names=["content"])


def parse_word2vec_binary(files: DataFrame) -> DataFrame:
    """(word, vec) from a column ``content`` with whole binary vector files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            for data in b.column(0).to_pylist():
                head, _, rest = data.partition(b"\n")
                n, size = map(int, head.split())
                words, vecs, at = [], [], 0
                for _ in range(n):
                    end = rest.index(b" ", at)
                    words.append(rest[at:end].strip().decode("utf-8", "replace"))
                    at = end + 1 + 4 * size
                    vecs.append(np.frombuffer(rest[end + 1 : at], np.float32))
                yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(vecs, pa.list_(pa.float32()))], names=["word", "vec"])

    return files.select("content").mapInArrow(run, "word string, vec array<float>")


def read_word2vec_binary(spark: SparkSession, path: str) -> DataFrame:
    """(word, vec) from binary vector files; a file is parsed in one task, so large tables should come in several files."""
    return parse_word2vec_binary(spark.read.format("binaryFile").load(path))


def read_vector_pairs(spark: SparkSession, one: str, two: str, schema: str = "id bigint, v array<double>") -> DataFrame:
    """(id, v1, v2): the vectors of two tables that belong to the same id."""
    a, b = (spark.read.schema(schema).parquet(p).select("id", F.col("v").alias(f"v{k}")) for k, p in ((1, one), (2, two)))
    return a.join(b, "id")


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """(n, prefix) from lines ``count TAB prefix``."""
    return spark.read.csv(path, sep="\t", schema="n long, prefix string")


def read_features(spark: SparkSession, key: DataFrame, paths: list[str], on: str = "id") -> DataFrame:
    """Feature tables joined to ``key`` by id; missing features are 0."""
    out = key
    for p in paths:
        out = out.join(spark.read.parquet(p), on, "left")
    return out.fillna(0)


def filled(df: DataFrame, columns: list[str], value: float = 0.0) -> DataFrame:
    """Null, NaN and infinite numbers replaced by ``value``."""
    good = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != F.lit(float("inf")))
    return df.withColumns({c: F.when(good(c), F.col(c)).otherwise(F.lit(value)) for c in columns})


def write_csv(df: DataFrame, path: str, quote_all: bool = False, sep: str = ",", header: bool = True) -> None:
    df.write.mode("overwrite").csv(path, header=header, sep=sep, quote='"', escape='"', quoteAll=quote_all, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_shards(df: DataFrame, path: str, rows: int = 400_000) -> None:
    """Parquet files of at most ``rows`` rows."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(path)


def write_folds(df: DataFrame, path: str, *by: str) -> None:
    """One folder per value of the columns ``by``, ``fold`` by default."""
    df.write.mode("overwrite").partitionBy(*(by or ("fold",))).parquet(path)


def write_submission(df: DataFrame, path: str) -> None:
    """test_id and is_duplicate, raw and with the prior shifted."""
    df.select("test_id", F.col("p").alias("is_duplicate"), F.col("adjusted").alias("is_duplicate_adjusted")).write.mode("overwrite").csv(path, header=True)
