"""Every reader and writer against tables: what is written to the shared folder comes back as it was."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.operators.encode import _FOLD, fold_of
from twinfold.operators.pairs import PAIR_SQL, pair_rows
from twinfold.session import scratch_dir
from twinfold.sources import io

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def place(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{scratch_dir(spark)}/twinfold-files-{uuid.uuid4().hex}"


_PAIRS = "SELECT id, qid1, qid2, nullif(question1, '') AS question1, nullif(question2, '') AS question2, is_duplicate FROM train"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """The pair columns; files can't tell an empty text from a missing one."""
    t = spark.read.parquet(f"{d}/train.parquet")
    return t.select("id", "qid1", "qid2", F.nullif("question1", F.lit("")).alias("question1"), F.nullif("question2", F.lit("")).alias("question2"), "is_duplicate")


@query(_PAIRS)
def csv_with_header(spark: SparkSession, d: str) -> DataFrame:
    path = place(spark)
    io.write_csv(_pairs(spark, d), path)
    return io.read_pairs(spark, path)


@query(_PAIRS)
def csv_all_quoted(spark: SparkSession, d: str) -> DataFrame:
    path = place(spark)
    io.write_csv(_pairs(spark, d), path, quote_all=True)
    return io.read_pairs(spark, path)


@query(_PAIRS)
def csv_by_position(spark: SparkSession, d: str) -> DataFrame:
    """Without a header, columns by their place."""
    path = place(spark)
    io.write_csv(_pairs(spark, d), path, header=False)
    return io.read_pairs(spark, path, header=False)


@query("SELECT question1, count(*) AS n FROM (SELECT nullif(question1, '') AS question1 FROM train) GROUP BY question1")
def csv_column_of_file(spark: SparkSession, d: str) -> DataFrame:
    """A subset of a file's columns."""
    path = place(spark)
    io.write_csv(_pairs(spark, d), path)
    return io.read_pairs(spark, path).select("question1").groupBy("question1").agg(F.count("*").alias("n"))


@query("SELECT id, qid1, qid2, is_duplicate FROM train WHERE id >= 100")
def tsv_from_offset(spark: SparkSession, d: str) -> DataFrame:
    """A tab-separated file of pairs, read on from a row."""
    path = place(spark)
    io.write_csv(_pairs(spark, d).select("id", "qid1", "qid2", "is_duplicate"), path, sep="\t", header=False)
    return io.read_pairs(spark, path, "id long, qid1 long, qid2 long, is_duplicate int", header=False, sep="\t").filter("id >= 100")


@query(f"WITH {PAIR_SQL}, s AS (SELECT unnest(a) AS w FROM p UNION ALL SELECT unnest(b) FROM p), c AS (SELECT w, count(*) AS freq FROM s GROUP BY w), t AS (SELECT * FROM c ORDER BY freq DESC, w LIMIT 5000) SELECT row_number() OVER (ORDER BY freq DESC, w) AS idx, w FROM t")
def vocabulary_file(spark: SparkSession, d: str) -> DataFrame:
    """Number and word in a tab-separated file."""
    from twinfold.operators.corpus import vocab_topk

    path = place(spark)
    io.write_csv(vocab_topk(spark, d).select("idx", "w"), path, sep="\t", header=False)
    return spark.read.csv(path, sep="\t", schema="idx long, w string", quote='"', escape='"')


@query("SELECT doc_id, text, lang FROM documents")
def parquet_shards(spark: SparkSession, d: str) -> DataFrame:
    """Part files of at most 400 rows, read as one table."""
    path = place(spark)
    io.write_shards(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang"), path, 400)
    return spark.read.parquet(path)


@query(f"SELECT id, is_duplicate, {_FOLD} AS fold, CASE WHEN {_FOLD} = 0 THEN 'valid' ELSE 'train' END AS part FROM train WHERE is_duplicate IS NOT NULL")
def fold_folders(spark: SparkSession, d: str) -> DataFrame:
    """A folder per fold and part: fold 0 is held out."""
    path, fold = place(spark), fold_of(F.col("id"))
    t = spark.read.parquet(f"{d}/train.parquet").filter("is_duplicate IS NOT NULL").select("id", "is_duplicate", fold.alias("fold"))
    io.write_folds(t.withColumn("part", F.when(F.col("fold") == 0, "valid").otherwise("train")), path, "fold", "part")
    return spark.read.parquet(path)


_P = "SELECT test_id, avg(is_duplicate) AS p FROM predictions WHERE is_duplicate IS NOT NULL GROUP BY test_id"


@query(f"WITH s AS ({_P}) SELECT test_id, round(p, 9) AS is_duplicate, round({0.173 / 0.369} * p / ({0.173 / 0.369} * p + {(1 - 0.173) / (1 - 0.369)} * (1 - p)), 9) AS is_duplicate_adjusted FROM s")
def submission_file(spark: SparkSession, d: str) -> DataFrame:
    from twinfold.operators.encode import averaged, prior_shifted

    path = place(spark)
    io.write_submission(averaged(spark, d).select("test_id", "p", prior_shifted(F.col("p"), 0.369, 0.173).alias("adjusted")), path)
    t = spark.read.csv(path, header=True, schema="test_id long, is_duplicate double, is_duplicate_adjusted double")
    return t.select("test_id", *(F.round(c, 9).alias(c) for c in t.columns[1:]))


@query(f"WITH {PAIR_SQL}, u AS (SELECT DISTINCT id, w FROM (SELECT id, unnest(a) AS w FROM p UNION ALL SELECT id, unnest(b) FROM p)) SELECT w, count(*) AS df, CAST(sum(id) AS BIGINT) AS id_sum FROM u GROUP BY w")
def index_file(spark: SparkSession, d: str) -> DataFrame:
    """The inverted index, written in parts of lists and read back for counting."""
    from twinfold.operators.corpus import postings

    path = place(spark)
    postings(pair_rows(spark, d)).write.parquet(path)
    t = spark.read.schema("w string, part bigint, ids array<bigint>").parquet(path)
    return t.groupBy("w").agg(F.sum(F.size("ids").cast("long")).alias("df"), F.sum(F.aggregate("ids", F.lit(0).cast("long"), lambda s, x: s + x)).alias("id_sum"))


_E = "e AS (SELECT qid1 AS a, qid2 AS b FROM train WHERE qid1 <> qid2 UNION SELECT qid2, qid1 FROM train WHERE qid1 <> qid2)"


@query(f"WITH {_E}, r AS (SELECT a, b, (row_number() OVER (PARTITION BY a ORDER BY b) - 1) // 1000 AS part FROM e) SELECT a AS question, string_agg(CAST(b AS VARCHAR), ' ' ORDER BY b) AS ids FROM r GROUP BY a, part")
def adjacency_file(spark: SparkSession, d: str) -> DataFrame:
    """Neighbour lists as lines ``question,ids``; more than 1,000 neighbours take several lines."""
    from twinfold.operators.order import neighbour_documents

    path = place(spark)
    io.write_csv(neighbour_documents(spark, d).select(F.col("node").alias("question"), "ids"), path)
    return spark.read.csv(path, header=True, schema="question long, ids string")


@query("SELECT vec_id, len(embedding) AS size, round(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE))), 4) AS total FROM embeddings")
def vectors_as_text(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as lines ``word f1 ... fn``, with a header that the reader leaves out."""
    path = place(spark)
    t = spark.read.parquet(f"{d}/embeddings.parquet").select(F.concat_ws(" ", F.col("vec_id").cast("string"), F.array_join(F.transform("embedding", lambda v: v.cast("string")), " ")).alias("value"))
    spark.createDataFrame([("500 64",)], "value string").union(t).write.text(path)
    got = io.read_embeddings(spark, path, 64)
    return got.select(F.col("word").cast("long").alias("vec_id"), F.size("vec").alias("size"), F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query("SELECT vec_id, len(embedding) AS size, round(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE))), 4) AS total FROM embeddings")
def vectors_as_binary(spark: SparkSession, d: str) -> DataFrame:
    """Vectors in the binary format: every partition's file is encoded where its rows are, then parsed as the reader parses a file."""
    t = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("word"), F.col("embedding").cast("array<float>").alias("vec"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from io.binary_vectors(batches)

    files = t.mapInArrow(encode, "content binary")
    got = io.parse_word2vec_binary(files)
    return got.select(F.col("word").cast("long").alias("vec_id"), F.size("vec").alias("size"), F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


RULES = [("wich", "which"), ("teh", "the"), ("dont", "do not"), ("what", "which"), ("best", "good"), ("how", "in what way")]


@query(f"WITH {PAIR_SQL}, r(wrong, good) AS (VALUES {', '.join(repr(r) for r in RULES)}), x AS (SELECT id, unnest(a) AS w, unnest(range(0, len(a))) AS pos FROM p) SELECT p.id, coalesce(t, '') AS ruled FROM p LEFT JOIN (SELECT id, string_agg(coalesce(good, w), ' ' ORDER BY pos) AS t FROM x LEFT JOIN r ON w = wrong GROUP BY id) AS g USING (id)")
def rule_file(spark: SparkSession, d: str) -> DataFrame:
    """Rewriting rules from lines ``wrong->right``, applied to whole words."""
    path = place(spark)
    spark.createDataFrame([(f"{a}->{b}",) for a, b in RULES] + [("no rule",)], "value string").coalesce(1).write.text(path)
    return io.apply_rules(pair_rows(spark, d).select("id", "a"), "a", io.read_rules(spark, path)).select("id", F.array_join("a", " ").alias("ruled"))


def _pattern_sql() -> str:
    from twinfold.operators.corpus import _PREFIX, PREFIXES

    return _PREFIX + " " + " UNION ALL ".join(f"SELECT n, prefix FROM k{k}" for k in range(1, PREFIXES + 1))


@query(_pattern_sql())
def pattern_file(spark: SparkSession, d: str) -> DataFrame:
    """Patterns as lines ``count TAB prefix``."""
    from twinfold.operators.corpus import prefix_levels

    path = place(spark)
    io.write_csv(prefix_levels(pair_rows(spark, d)).select("n", "prefix"), path, sep="\t", header=False)
    return io.read_patterns(spark, path)


@query("WITH v AS (SELECT vec_id AS id, list_sum(list_transform(embedding, lambda z: CAST(z AS DOUBLE) * z)) AS xx FROM embeddings) SELECT a.id, round(sqrt(a.xx), 4) AS norm1, round(sqrt(b.xx), 4) AS norm2 FROM v AS a JOIN v AS b ON b.id = a.id + 1")
def vector_files_joined(spark: SparkSession, d: str) -> DataFrame:
    """Two files of vectors, one for either question, joined by id instead of read in step."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    one, two = place(spark), place(spark)
    e.write.parquet(one)
    e.withColumn("id", F.col("id") - 1).write.parquet(two)
    schema = "id bigint, v array<double>"
    return io.read_vector_pairs(spark, one, two, schema).select("id", *(F.round(F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x)), 4).alias(f"norm{k}") for k, c in ((1, "v1"), (2, "v2"))))


@query(f"WITH {PAIR_SQL} SELECT id, CAST(len(a) AS INT) AS n1, CASE WHEN id % 3 = 0 THEN CAST(len(b) AS INT) ELSE 0 END AS n2 FROM p")
def feature_folder(spark: SparkSession, d: str) -> DataFrame:
    """Feature tables of a folder joined to the ids; what a table lacks is 0. One of the two features is only made for some rows."""
    df, paths = pair_rows(spark, d), [place(spark), place(spark)]
    df.select("id", F.size("a").alias("n1")).write.parquet(paths[0])
    df.filter("id % 3 = 0").select("id", F.size("b").alias("n2")).write.parquet(paths[1])
    return io.read_features(spark, df.select("id"), paths)


@query("WITH v AS (SELECT test_id, CASE WHEN is_duplicate IS NULL OR isnan(is_duplicate) THEN 0 ELSE is_duplicate END AS v FROM predictions) SELECT test_id, round(sum(v), 9) AS total, count(*) AS n FROM v GROUP BY 1")
def filled_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Null, NaN and infinite numbers are 0."""
    t = io.filled(spark.read.parquet(f"{d}/predictions.parquet").select("test_id", "is_duplicate"), ["is_duplicate"])
    return t.groupBy("test_id").agg(F.round(F.sum("is_duplicate"), 9).alias("total"), F.count("*").alias("n"))


@query()
def saved_models(spark: SparkSession, d: str) -> DataFrame:
    """Scores of a regression and word vectors, by models that were written and loaded again: ``same`` says that they score as before."""
    from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
    from pyspark.ml.feature import Word2Vec, Word2VecModel
    from pyspark.ml.functions import vector_to_array

    from twinfold.operators.models import assembled, questions

    t, path = assembled(spark, d), place(spark)
    model = LogisticRegression(maxIter=5, regParam=0.001, featuresCol="x", labelCol="y").fit(t)
    model.write().save(path + "/lr")
    q = questions(pair_rows(spark, d))
    words = Word2Vec(vectorSize=8, minCount=5, maxIter=1, seed=7, inputCol="tokens", outputCol="v").fit(q)
    words.write().save(path + "/w2v")
    score = lambda m, n: m.transform(t).select("id", vector_to_array("probability")[1].alias(n))
    vector = lambda m, n: m.transform(q.filter("side = 1")).select("id", vector_to_array("v").alias(n))
    again, words_again = LogisticRegressionModel.load(path + "/lr"), Word2VecModel.load(path + "/w2v")
    j = score(model, "p").join(score(again, "p2"), "id").join(vector(words, "v").join(vector(words_again, "v2"), "id"), "id")
    return j.select("id", F.round("p", 6).alias("p"), ((F.col("p") == F.col("p2")) & (F.col("v") == F.col("v2"))).alias("same"))
