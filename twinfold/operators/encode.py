"""Folds, out-of-fold target encoding, vocabularies and padded sequences, metrics and calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.operators.corpus import sided
from twinfold.operators.pairs import PAIR_SQL, pair_rows
from twinfold.operators.skew import HEAVY_SHARE, salted_join

QUERIES, SQL = {}, {}
FOLDS = 5


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def fold_of(c: Column, folds: int = FOLDS, seed: int = 1024) -> Column:
    """A fold from a digest of the key and a seed: the same on every engine, at any size, without a sort."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", c.cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long"), F.lit(folds)).cast("int")


_FOLD = "CAST(CAST('0x' || substr(md5(CAST(id AS VARCHAR) || ':1024'), 1, 8) AS BIGINT) % 5 AS INT)"


@query(f"""WITH {PAIR_SQL}, l AS (SELECT *, {_FOLD} AS fold FROM p), w AS (SELECT DISTINCT id, fold, y, unnest(list_filter(a, lambda t: NOT list_contains(b, t))) AS w FROM l UNION SELECT id, fold, y, unnest(list_filter(b, lambda t: NOT list_contains(a, t))) FROM l),
g AS (SELECT w, fold, sum(y) AS s FROM w WHERE y IS NOT NULL GROUP BY 1, 2), t AS (SELECT w, sum(s) AS s FROM g GROUP BY 1), n AS (SELECT fold, count(*) AS n FROM l WHERE y IS NOT NULL GROUP BY 1), m AS (SELECT sum(n) AS m FROM n),
e AS (SELECT w.id, CASE WHEN w.y IS NULL THEN coalesce(t.s, 0) / m ELSE (coalesce(t.s, 0) - coalesce(g.s, 0)) / (m - n.n) END AS v FROM w LEFT JOIN t USING (w) LEFT JOIN g ON g.w = w.w AND g.fold = w.fold JOIN n ON n.fold = w.fold, m)
SELECT id, round(min(v), 7) AS enc_min, round(max(v), 7) AS enc_max, round(avg(v), 7) AS enc_mean, count(*) AS n_terms FROM e GROUP BY id""")
def oof_target_encoding(spark: SparkSession, d: str) -> DataFrame:
    """Words of one question only, encoded by the label sum of the other folds over their rows; unlabelled rows use all folds.

    One aggregation per word gives the sums of all folds as columns, so a row's own fold is subtracted after
    a single join.
    """
    df = pair_rows(spark, d).withColumn("fold", fold_of(F.col("id")))
    only = F.array_distinct(F.concat(F.array_except("a", "b"), F.array_except("b", "a")))
    w = df.select("id", "fold", "y", F.explode(only).alias("w"))
    per = [F.coalesce(F.sum(F.when(F.col("fold") == k, F.col("y"))), F.lit(0)).alias(f"s{k}") for k in range(FOLDS)]
    sums = w.groupBy("w").agg(F.coalesce(F.sum("y"), F.lit(0)).alias("s"), F.count("*").alias("freq"), *per)
    sizes = {r.fold: r.n for r in df.filter("y IS NOT NULL").groupBy("fold").agg(F.count("*").alias("n")).collect()}  # one row per fold
    rows = sum(sizes.values())
    heavy = sums.filter(F.col("freq") > F.lit(max(100.0, rows * HEAVY_SHARE))).select("w")
    j = salted_join(w, sums, ["w"], heavy, ["id"])
    own = F.element_at(F.array(*(F.col(f"s{k}") for k in range(FOLDS))), F.col("fold") + 1)
    size = F.element_at(F.array(*(F.lit(float(rows - sizes.get(k, 0))) for k in range(FOLDS))), F.col("fold") + 1)
    v = F.when(F.col("y").isNull(), F.col("s") / F.lit(float(max(rows, 1)))).otherwise((F.col("s") - own) / size)
    return j.withColumn("v", v).groupBy("id").agg(F.round(F.min("v"), 7).alias("enc_min"), F.round(F.max("v"), 7).alias("enc_max"), F.round(F.avg("v"), 7).alias("enc_mean"), F.count("*").alias("n_terms"))


@query("SELECT is_duplicate, count(*) AS n, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM train WHERE is_duplicate IS NOT NULL), 9) AS share, round((SELECT count(*) FROM train WHERE is_duplicate IS NOT NULL) / (2.0 * count(*)), 9) AS weight FROM train WHERE is_duplicate IS NOT NULL GROUP BY 1")
def class_balance(spark: SparkSession, d: str) -> DataFrame:
    """Rows, share and balancing weight per label."""
    t = spark.read.parquet(f"{d}/train.parquet").filter("is_duplicate IS NOT NULL")
    g = t.groupBy("is_duplicate").agg(F.count("*").alias("n"))
    total = g.agg(F.sum("n").alias("m"))
    return g.crossJoin(F.broadcast(total)).select("is_duplicate", "n", F.round(F.col("n") / F.col("m"), 9).alias("share"), F.round(F.col("m") / (2.0 * F.col("n")), 9).alias("weight"))  # one row


@query(f"SELECT is_duplicate, count(*) AS n FROM (SELECT id, is_duplicate FROM train WHERE is_duplicate IS NOT NULL UNION ALL SELECT id, is_duplicate FROM train WHERE is_duplicate = 1 AND {_FOLD} < 2) GROUP BY 1")
def oversample_counts(spark: SparkSession, d: str) -> DataFrame:
    """Label counts after the positives of two folds are repeated."""
    t = spark.read.parquet(f"{d}/train.parquet").select("id", "is_duplicate").filter("is_duplicate IS NOT NULL")
    more = t.filter((F.col("is_duplicate") == 1) & (fold_of(F.col("id")) < 2))
    return t.union(more).groupBy("is_duplicate").agg(F.count("*").alias("n"))


_LAST = "s AS (SELECT test_id, avg(is_duplicate) AS p, count(*) AS n_scores FROM predictions WHERE is_duplicate IS NOT NULL GROUP BY test_id)"


def averaged(spark: SparkSession, d: str) -> DataFrame:
    """(test_id, p, n_scores): mean of all scores of a pair."""
    p = spark.read.parquet(f"{d}/predictions.parquet").filter("is_duplicate IS NOT NULL")
    return p.groupBy("test_id").agg(F.avg("is_duplicate").alias("p"), F.count("*").alias("n_scores"))


def prior_shifted(p: Column, train: float, test: float) -> Column:
    """Probability under another prior: a p / (a p + b (1 - p)), a and b the ratios of the priors; 0 and 1 stay."""
    a, b = test / train, (1 - test) / (1 - train)
    return a * p / (a * p + b * (1 - p))


@query(f"WITH {_LAST} SELECT test_id, round(p, 9) AS p, round({0.173 / 0.369} * p / ({0.173 / 0.369} * p + {(1 - 0.173) / (1 - 0.369)} * (1 - p)), 9) AS adjusted, n_scores FROM s")
def prior_shift(spark: SparkSession, d: str) -> DataFrame:
    return averaged(spark, d).select("test_id", F.round("p", 9).alias("p"), F.round(prior_shifted(F.col("p"), 0.369, 0.173), 9).alias("adjusted"), "n_scores")


_LL = "-(y * ln(greatest(least(p, 1 - 1e-15), 1e-15)) + (1 - y) * ln(greatest(least(1 - p, 1 - 1e-15), 1e-15)))"


@query(f"""WITH {PAIR_SQL}, x AS (SELECT y, CASE WHEN len(a) + len(b) > 0 THEN (1 + CAST(len(list_intersect(a, b)) AS DOUBLE)) / (2 + len(list_distinct(concat(a, b)))) ELSE 0.5 END AS p FROM p WHERE y IS NOT NULL)
SELECT y, count(*) AS n, round(avg({_LL}), 8) AS logloss, round(avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END), 8) AS accuracy FROM x GROUP BY y""")
def logloss(spark: SparkSession, d: str) -> DataFrame:
    """Log-loss and accuracy, per label, of the smoothed word overlap taken as a probability."""
    df = pair_rows(spark, d).filter("y IS NOT NULL")
    p = F.when(F.size("a") + F.size("b") > 0, (1.0 + F.size(F.array_intersect("a", "b"))) / (2 + F.size(F.array_distinct(F.concat("a", "b"))))).otherwise(0.5)
    return df.select("y", p.alias("p")).groupBy("y").agg(F.count("*").alias("n"), F.round(F.avg(F.expr(_LL)), 8).alias("logloss"), F.round(F.avg(F.expr("CASE WHEN (p >= 0.5D) = (y = 1) THEN 1.0D ELSE 0.0D END")), 8).alias("accuracy"))


@query("SELECT model_name, count(*) AS n, round(avg(is_duplicate), 9) AS mean_score, round(stddev_pop(is_duplicate), 9) AS std_score, round(corr(is_duplicate, CAST(test_id AS DOUBLE)), 6) AS drift FROM predictions WHERE is_duplicate IS NOT NULL GROUP BY model_name")
def model_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores per model, and their Pearson correlation with the pair's number."""
    p = spark.read.parquet(f"{d}/predictions.parquet").filter("is_duplicate IS NOT NULL")
    return p.groupBy("model_name").agg(F.count("*").alias("n"), F.round(F.avg("is_duplicate"), 9).alias("mean_score"), F.round(F.stddev_pop("is_duplicate"), 9).alias("std_score"), F.round(F.corr("is_duplicate", F.col("test_id").cast("double")), 6).alias("drift"))


@query("WITH v AS (SELECT test_id, CAST(is_duplicate >= 0.5 AS INT) AS vote FROM predictions WHERE is_duplicate IS NOT NULL) SELECT test_id, CAST(sum(vote) * 2 > count(*) AS INT) AS majority, count(*) AS votes FROM v GROUP BY test_id")
def majority_vote(spark: SparkSession, d: str) -> DataFrame:
    v = spark.read.parquet(f"{d}/predictions.parquet").filter("is_duplicate IS NOT NULL").select("test_id", (F.col("is_duplicate") >= 0.5).cast("int").alias("vote"))
    return v.groupBy("test_id").agg((F.sum("vote") * 2 > F.count("*")).cast("int").alias("majority"), F.count("*").alias("votes"))


def padded(ids: Column, length: int, post: bool = False) -> Column:
    """Cut to ``length`` and filled with 0; before the ids (and cut at the front), or behind them."""
    fill = F.array_repeat(F.lit(0), F.greatest(F.lit(length) - F.size(ids), F.lit(0)))
    if post:
        return F.concat(F.slice(ids, 1, length), fill)
    return F.concat(fill, F.slice(ids, F.greatest(F.size(ids) - length + 1, F.lit(1)), length))


#: Words that get a number of their own in ``padded_sequences_both``.
VOCABULARY = 200_000
_FILL = "list_transform(range(0, n - len(ids{k})), lambda z: CAST(0 AS BIGINT))"


@query(f"""WITH {PAIR_SQL}, s AS (SELECT unnest(a) AS w FROM p UNION ALL SELECT unnest(b) FROM p), c AS (SELECT w, count(*) AS freq FROM s GROUP BY w), t AS (SELECT * FROM c ORDER BY freq DESC, w LIMIT {VOCABULARY}), v AS (SELECT w, row_number() OVER (ORDER BY freq DESC, w) + 1 AS idx FROM t),
x AS (SELECT id, 1 AS side, unnest(a) AS w, unnest(range(0, len(a))) AS pos FROM p UNION ALL SELECT id, 2, unnest(b), unnest(range(0, len(b))) FROM p), i AS (SELECT id, side, list(coalesce(idx, 1) ORDER BY pos) AS ids FROM x LEFT JOIN v USING (w) GROUP BY id, side),
m AS (SELECT greatest(max(len(a)), max(len(b))) AS n FROM p), j AS (SELECT p.id, coalesce(i1.ids, CAST([] AS BIGINT[])) AS ids1, coalesce(i2.ids, CAST([] AS BIGINT[])) AS ids2, n FROM p LEFT JOIN i AS i1 ON i1.id = p.id AND i1.side = 1 LEFT JOIN i AS i2 ON i2.id = p.id AND i2.side = 2, m)
SELECT id, """ + ", ".join(f"array_to_string(concat({_FILL.replace('{k}', k)}, ids{k}), ' ') AS pre{k}, array_to_string(concat(ids{k}, {_FILL.replace('{k}', k)}), ' ') AS post{k}" for k in "12") + " FROM j")
def padded_sequences_both(spark: SparkSession, d: str) -> DataFrame:
    """Word numbers of both questions, padded to the longest question, so that no word is cut off.

    The vocabulary of 200,000 words is joined by key, frequent words salted; 1 for words outside it.
    """
    from pyspark.sql import Window

    from twinfold.operators.corpus import heavy_words, token_freq

    df = pair_rows(spark, d)
    freq = token_freq(sided(df))
    first = F.row_number().over(Window.orderBy(F.desc("freq"), "w")) + 1  # over 200,000 rows
    vocab = freq.orderBy(F.desc("freq"), "w").limit(VOCABULARY).select("w", first.cast("int").alias("idx"))
    longest, rows = df.agg(F.max(F.greatest(F.size("a"), F.size("b"))), F.count("*")).first()
    each = [df.select("id", F.lit(k).alias("side"), F.posexplode_outer(c).alias("pos", "w")) for k, c in ((1, "a"), (2, "b"))]
    j = salted_join(each[0].union(each[1]), vocab, ["w"], heavy_words(freq, rows), ["id", "side", "pos"], how="left")
    word = F.when(F.col("w").isNotNull(), F.struct("side", "pos", F.coalesce("idx", F.lit(1)).alias("idx")))
    j = j.groupBy("id").agg(F.array_sort(F.collect_list(word)).alias("ws"))
    j = j.select("id", *(F.expr(f"transform(filter(ws, x -> x.side = {k}), x -> x.idx)").alias(f"ids{k}") for k in (1, 2)))
    return j.select("id", *(F.array_join(padded(F.col(f"ids{k}"), longest or 0, post), " ").alias(f"{name}{k}") for k in (1, 2) for name, post in (("pre", False), ("post", True))))


@query(f"WITH {PAIR_SQL} SELECT id, array_to_string(list_transform(a, lambda w: CASE WHEN list_contains(b, w) THEN '0' ELSE '1' END), '') AS only1, array_to_string(list_transform(b, lambda w: CASE WHEN list_contains(a, w) THEN '1' ELSE '0' END), '') AS shared2 FROM p")
def diff_masks(spark: SparkSession, d: str) -> DataFrame:
    """Masks of question1's words that question2 lacks, and of question2's words that question1 has."""
    one = F.transform("a", lambda w: F.when(F.array_contains("b", w), "0").otherwise("1"))
    two = F.transform("b", lambda w: F.when(F.array_contains("a", w), "1").otherwise("0"))
    return pair_rows(spark, d).select("id", F.array_join(one, "").alias("only1"), F.array_join(two, "").alias("shared2"))


@query(f"WITH {PAIR_SQL} SELECT CAST(max(greatest(len(a), len(b))) AS INT) AS longest, count(DISTINCT id) AS n, round(avg(len(a) + len(b)), 6) AS mean_tokens FROM p")
def corpus_shape(spark: SparkSession, d: str) -> DataFrame:
    df = pair_rows(spark, d)
    return df.agg(F.max(F.greatest(F.size("a"), F.size("b"))).cast("int").alias("longest"), F.countDistinct("id").alias("n"), F.round(F.avg(F.size("a") + F.size("b")), 6).alias("mean_tokens"))


__all__ = ["QUERIES", "SQL", "averaged", "fold_of", "padded", "prior_shifted", "sided"]
