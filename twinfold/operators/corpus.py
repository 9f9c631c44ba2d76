"""Corpus statistics joined back to pairs: frequencies, IDF, entropy, mutual information, inverted index, patterns.

Dictionaries (word or question to number) are joined by key; words and questions that hold more than a
thousandth of the rows are salted, so a word in every row doesn't land in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinfold.operators.pairs import PAIR_SQL, pair_rows
from twinfold.operators.skew import HEAVY_SHARE, salted_join
from twinfold.session import cut

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def sided(df: DataFrame) -> DataFrame:
    """(id, side, pos, w, y): every token of both questions."""
    a = df.select("id", F.lit(1).alias("side"), F.posexplode("a").alias("pos", "w"), "y")
    return a.union(df.select("id", F.lit(2).alias("side"), F.posexplode("b").alias("pos", "w"), "y"))


_SIDED = """s AS (SELECT id, 1 AS side, unnest(a) AS w, unnest(range(0, len(a))) AS pos, y FROM p UNION ALL SELECT id, 2, unnest(b), unnest(range(0, len(b))), y FROM p)"""


def token_freq(tokens: DataFrame) -> DataFrame:
    """(w, freq): every occurrence counts, duplicates within a row too."""
    return tokens.groupBy("w").agg(F.count("*").alias("freq"))


def heavy_words(freq: DataFrame, rows: int) -> DataFrame:
    return freq.filter(F.col("freq") > F.lit(max(100.0, 2 * rows * HEAVY_SHARE))).select("w")


def idf(n, count):
    """Smoothed inverse frequency of ``count`` among n."""
    return F.log((1 + F.lit(n)) / (1 + count))


@query(f"WITH {PAIR_SQL}, {_SIDED} SELECT w, count(*) AS freq, round(ln((1.0 + 2 * (SELECT count(*) FROM p)) / (1 + count(*))), 6) AS idf FROM s GROUP BY w")
def idf_table(spark: SparkSession, d: str) -> DataFrame:
    df = pair_rows(spark, d)
    return token_freq(sided(df)).withColumn("idf", F.round(idf(2.0 * df.count(), F.col("freq")), 6))


def with_freq(df: DataFrame) -> DataFrame:
    tokens = sided(df)
    freq = token_freq(tokens)
    return salted_join(tokens, freq, ["w"], heavy_words(freq, df.count()), ["id", "pos"])


@query(f"""WITH {PAIR_SQL}, {_SIDED}, f AS (SELECT w, ln((1.0 + 2 * (SELECT count(*) FROM p)) / (1 + count(*))) AS v FROM s GROUP BY w)
SELECT id, side, round(min(v), 6) AS idf_min, round(max(v), 6) AS idf_max, round(avg(v), 6) AS idf_mean, round(sqrt(greatest(avg(v * v) - avg(v) * avg(v), 0)), 5) AS idf_std, round(sum(v), 6) AS idf_sum FROM s JOIN f USING (w) GROUP BY id, side""")
def pair_idf_stats(spark: SparkSession, d: str) -> DataFrame:
    df = pair_rows(spark, d)
    v = idf(2.0 * df.count(), F.col("freq"))
    t = with_freq(df).withColumn("v", v)
    std = F.sqrt(F.greatest(F.avg(F.col("v") * F.col("v")) - F.avg("v") * F.avg("v"), F.lit(0.0)))
    return t.groupBy("id", "side").agg(F.round(F.min("v"), 6).alias("idf_min"), F.round(F.max("v"), 6).alias("idf_max"), F.round(F.avg("v"), 6).alias("idf_mean"), F.round(std, 5).alias("idf_std"), F.round(F.sum("v"), 6).alias("idf_sum"))


@query(f"""WITH {PAIR_SQL}, {_SIDED}, f AS (SELECT w, CAST(count(*) AS DOUBLE) / (2 * (SELECT count(*) FROM p)) AS v FROM s GROUP BY w)
SELECT id, round(sum(CASE WHEN side = 1 THEN -v * ln(v) ELSE 0 END), 6) AS entropy1, round(sum(CASE WHEN side = 2 THEN -v * ln(v) ELSE 0 END), 6) AS entropy2 FROM s JOIN f USING (w) GROUP BY id""")
def pair_entropy(spark: SparkSession, d: str) -> DataFrame:
    df = pair_rows(spark, d)
    p = F.col("freq") / F.lit(2.0 * df.count())
    t = with_freq(df).withColumn("v", -p * F.log(p))
    return t.groupBy("id").agg(*(F.round(F.sum(F.when(F.col("side") == k, F.col("v")).otherwise(0.0)), 6).alias(f"entropy{k}") for k in (1, 2)))


@query(f"""WITH {PAIR_SQL}, {_SIDED}, f AS (SELECT w, CASE WHEN count(*) < 2 THEN 0.0 ELSE 1.0 / (count(*) + 10000) END AS v FROM s GROUP BY w),
u AS (SELECT DISTINCT id, side, w FROM s), g AS (SELECT id, w, count(*) AS k FROM u GROUP BY id, w)
SELECT id, round(CASE WHEN sum(v * k) > 0 THEN sum(CASE WHEN k = 2 THEN v * 2 ELSE 0 END) / sum(v * k) ELSE 0 END, 6) AS weighted_share FROM g JOIN f USING (w) GROUP BY id""")
def pair_weighted_share(spark: SparkSession, d: str) -> DataFrame:
    """Share of the words' weights that falls on words of both questions; a word's weight falls with its frequency."""
    df = pair_rows(spark, d)
    u = df.select("id", F.explode(F.array_distinct(F.concat("a", "b"))).alias("w"), "a", "b")
    u = u.select("id", "w", (F.array_contains("a", F.col("w")).cast("int") + F.array_contains("b", F.col("w")).cast("int")).alias("k"))
    freq = token_freq(sided(df))
    t = salted_join(u, freq, ["w"], heavy_words(freq, df.count()), ["id"])
    v = F.when(F.col("freq") < 2, 0.0).otherwise(1.0 / (F.col("freq") + 10000))
    both, every = F.sum(F.when(F.col("k") == 2, v * 2).otherwise(0.0)), F.sum(v * F.col("k"))
    return t.groupBy("id").agg(F.round(F.when(every > 0, both / every).otherwise(0.0), 6).alias("weighted_share"))


_Q = "q AS (SELECT question1 AS q FROM train UNION ALL SELECT question2 FROM train UNION ALL SELECT question1 FROM test UNION ALL SELECT question2 FROM test), c AS (SELECT q, count(*) AS n FROM q WHERE q IS NOT NULL GROUP BY q)"


def question_counts(spark: SparkSession, d: str) -> DataFrame:
    """(q, n): questions of both columns of train and test."""
    parts = [spark.read.parquet(f"{d}/{t}.parquet").select(F.explode(F.array("question1", "question2")).alias("q")) for t in ("train", "test")]
    return parts[0].union(parts[1]).filter("q IS NOT NULL").groupBy("q").agg(F.count("*").alias("n"))


def with_counts(pairs: DataFrame, counts: DataFrame, rows: int) -> DataFrame:
    """Left joins of the counts to question1 (n1) and question2 (n2); frequent questions are salted."""
    heavy = counts.filter(F.col("n") > F.lit(max(100.0, rows * HEAVY_SHARE)))
    for k in (1, 2):
        q = f"question{k}"
        pairs = salted_join(pairs, counts.select(F.col("q").alias(q), F.col("n").alias(f"n{k}")), [q], heavy.select(F.col("q").alias(q)), ["id"], how="left")
    return pairs


@query(f"WITH {_Q}, m AS (SELECT avg(n) AS mean, max(n) AS top FROM c), j AS (SELECT id, coalesce(c1.n, 0) AS n1, coalesce(c2.n, 0) AS n2 FROM train LEFT JOIN c AS c1 ON question1 = c1.q LEFT JOIN c AS c2 ON question2 = c2.q) SELECT id, n1, n2, least(n1, n2) AS n_min, greatest(n1, n2) AS n_max, abs(n1 - n2) AS n_diff, CASE WHEN greatest(n1, n2) > 0 THEN round(CAST(least(n1, n2) AS DOUBLE) / greatest(n1, n2), 6) ELSE CAST(0 AS DOUBLE) END AS n_ratio, round(n1 / mean, 6) AS n1_mean, round(CAST(n1 AS DOUBLE) / top, 6) AS n1_top FROM j, m")
def question_frequency(spark: SparkSession, d: str) -> DataFrame:
    counts = question_counts(spark, d)
    train = spark.read.parquet(f"{d}/train.parquet").select("id", "question1", "question2")
    got = with_counts(train, counts, train.count()).crossJoin(F.broadcast(counts.agg(F.avg("n").alias("mean"), F.max("n").alias("top"))))  # one row
    lo, hi = F.least("n1", "n2"), F.greatest("n1", "n2")
    got = got.fillna(0, ["n1", "n2"])
    return got.select("id", "n1", "n2", lo.alias("n_min"), hi.alias("n_max"), F.abs(F.col("n1") - F.col("n2")).alias("n_diff"), F.when(hi > 0, F.round(lo / hi, 6)).otherwise(0.0).alias("n_ratio"), F.round(F.col("n1") / F.col("mean"), 6).alias("n1_mean"), F.round(F.col("n1") / F.col("top"), 6).alias("n1_top"))


@query(f"WITH {_Q}, r AS (SELECT 'train' AS split, 1 AS side, id, question1 AS q FROM train UNION ALL SELECT 'train', 2, id, question2 FROM train UNION ALL SELECT 'test', 1, test_id, question1 FROM test UNION ALL SELECT 'test', 2, test_id, question2 FROM test) SELECT split, side, id, n, count(*) OVER (PARTITION BY split, side ORDER BY n RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rank_max FROM r JOIN c USING (q)")
def dup_rank_sides(spark: SparkSession, d: str) -> DataFrame:
    """Rank (ties get the largest) of the counts of both questions within their split and side.

    Ranked over the histogram of counts, of which there are few, not over the rows: no window holds a whole split.
    """
    counts = question_counts(spark, d)
    rows = None
    for t, i in (("train", "id"), ("test", "test_id")):
        sides = F.explode(F.array(*(F.struct(F.lit(k).alias("side"), F.col(f"question{k}").alias("q")) for k in (1, 2)))).alias("s")
        part = spark.read.parquet(f"{d}/{t}.parquet").select(F.lit(t).alias("split"), F.col(i).alias("id"), sides).select("split", "s.side", "id", "s.q")
        rows = part if rows is None else rows.union(part)
    heavy = counts.filter(F.col("n") > F.lit(max(100.0, rows.count() * HEAVY_SHARE))).select("q")
    r = salted_join(rows, counts, ["q"], heavy, ["id"])
    levels = r.groupBy("split", "side", "n").agg(F.count("*").alias("k"))
    ranks = levels.withColumn("rank_max", F.sum("k").over(Window.partitionBy("split", "side").orderBy("n"))).drop("k")
    return r.join(ranks, ["split", "side", "n"]).select("split", "side", "id", "n", "rank_max")


@query("WITH h AS (SELECT question1_hash AS h FROM train_hashed UNION ALL SELECT question2_hash FROM train_hashed), c AS (SELECT h, count(*) AS n FROM h WHERE h IS NOT NULL GROUP BY h) SELECT h, n, round(ln((1.0 + 2 * (SELECT count(*) FROM train_hashed)) / (1 + n)), 6) AS idf FROM c")
def question_hash_idf(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/train_hashed.parquet")
    c = t.select(F.explode(F.array("question1_hash", "question2_hash")).alias("h")).filter("h IS NOT NULL").groupBy("h").agg(F.count("*").alias("n"))
    return c.withColumn("idf", F.round(idf(2.0 * t.count(), F.col("n")), 6))


@query(f"WITH {PAIR_SQL}, {_SIDED}, c AS (SELECT w, count(*) AS freq FROM s GROUP BY w), t AS (SELECT * FROM c ORDER BY freq DESC, w LIMIT 5000) SELECT w, freq, row_number() OVER (ORDER BY freq DESC, w) AS idx FROM t")
def vocab_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 5,000 most frequent words with their numbers (a vocabulary cap is the feature); ties by the word. 0 and PAD are free."""
    top = token_freq(sided(pair_rows(spark, d))).orderBy(F.desc("freq"), "w").limit(5000)
    return top.withColumn("idx", F.row_number().over(Window.orderBy(F.desc("freq"), "w")).cast("long"))  # over 5,000 rows


@query(f"WITH {PAIR_SQL}, u AS (SELECT DISTINCT id, w FROM (SELECT id, unnest(a) AS w FROM p UNION ALL SELECT id, unnest(b) FROM p)) SELECT w, count(*) AS df, min(id) AS first_id, max(id) AS last_id FROM u GROUP BY w")
def inverted_index(spark: SparkSession, d: str) -> DataFrame:
    """Document frequency and span of every term's postings."""
    u = pair_rows(spark, d).select("id", F.explode(F.array_distinct(F.concat("a", "b"))).alias("w"))
    return u.groupBy("w").agg(F.count("*").alias("df"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query(f"WITH {PAIR_SQL}, u AS (SELECT DISTINCT id, w FROM (SELECT id, unnest(a) AS w FROM p UNION ALL SELECT id, unnest(b) FROM p)) SELECT w, count(*) AS df FROM u GROUP BY w ORDER BY df DESC, w LIMIT 100")
def inverted_index_topk(spark: SparkSession, d: str) -> DataFrame:
    return inverted_index(spark, d).select("w", "df").orderBy(F.desc("df"), "w").limit(100)


def postings(df: DataFrame, block: int = 100_000) -> DataFrame:
    """(w, part, ids): sorted posting lists in parts of about ``block`` ids by hash, so that no list is one row without bound."""
    u = df.select("id", F.explode(F.array_distinct(F.concat("a", "b"))).alias("w"))
    parts = max(1, -(-df.count() // block))
    return u.groupBy("w", F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part")).agg(F.array_sort(F.collect_list("id")).alias("ids"))


@query(f"""WITH {PAIR_SQL}, u AS (SELECT DISTINCT id, w FROM (SELECT id, unnest(a) AS w FROM p UNION ALL SELECT id, unnest(b) FROM p)) SELECT w, count(*) AS df, CAST(sum(id) AS BIGINT) AS id_sum FROM u GROUP BY w""")
def posting_lists(spark: SparkSession, d: str) -> DataFrame:
    p = postings(pair_rows(spark, d))
    return p.groupBy("w").agg(F.sum(F.size("ids").cast("long")).alias("df"), F.sum(F.aggregate("ids", F.lit(0).cast("long"), lambda s, x: s + x)).alias("id_sum"))


_MI = f"""WITH {PAIR_SQL}, f AS (SELECT * FROM p WHERE y = 1), x AS (SELECT DISTINCT id, unnest(a) AS w FROM f), z AS (SELECT DISTINCT id, unnest(b) AS w FROM f), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM f),
c1 AS (SELECT w, count(*) AS c FROM x GROUP BY w), c2 AS (SELECT w, count(*) AS c FROM z GROUP BY w), c12 AS (SELECT x.w AS u, z.w AS v, count(*) AS c FROM x JOIN z USING (id) GROUP BY 1, 2)"""


@query(f"{_MI} SELECT u, v, c12.c AS n_uv, round(c12.c / n * ln(c12.c * n / (c1.c * c2.c)), 6) + 0 AS mi FROM c12 JOIN c1 ON u = c1.w JOIN c2 ON v = c2.w, n WHERE c12.c >= 3")
def term_mutual_information(spark: SparkSession, d: str) -> DataFrame:
    """p12 log(p12 / p1 p2) of a word of question1 and a word of question2 over duplicate rows, for pairs seen three times."""
    f = pair_rows(spark, d).filter("y = 1").select("id", F.array_distinct("a").alias("a"), F.array_distinct("b").alias("b"))
    n = F.lit(float(f.count()))
    c1 = f.select(F.explode("a").alias("u")).groupBy("u").agg(F.count("*").alias("c1")).filter("c1 >= 3")
    c2 = f.select(F.explode("b").alias("v")).groupBy("v").agg(F.count("*").alias("c2")).filter("c2 >= 3")
    c12 = f.select(F.explode("a").alias("u"), "b").select("u", F.explode("b").alias("v")).groupBy("u", "v").agg(F.count("*").alias("n_uv")).filter("n_uv >= 3")
    j = c12.join(c1, "u").join(c2, "v")
    return j.select("u", "v", "n_uv", (F.round(F.col("n_uv") / n * F.log(F.col("n_uv") * n / (F.col("c1") * F.col("c2"))), 6) + 0.0).alias("mi"))


PREFIXES, TOP_PREFIXES = 5, 50
_PREFIX = f"WITH {PAIR_SQL}, t AS (SELECT a AS t FROM p WHERE len(a) > 0 UNION ALL SELECT b FROM p WHERE len(b) > 0)" + "".join(
    f", k{k} AS (SELECT array_to_string(t[1:{k}], ' ') AS prefix, count(*) AS n FROM t WHERE len(t) >= {k}" + (f" AND array_to_string(t[1:{k - 1}], ' ') IN (SELECT prefix FROM k{k - 1})" if k > 1 else "") + f" GROUP BY 1 ORDER BY n DESC, prefix LIMIT {TOP_PREFIXES})"
    for k in range(1, PREFIXES + 1)
)


def prefix_levels(df: DataFrame) -> DataFrame:
    """(k, prefix, n): for k = 1 to 5 the 50 most frequent prefixes of k words whose parent is among the 50 of its level."""
    starts = df.select(F.explode(F.array(F.slice("a", 1, PREFIXES), F.slice("b", 1, PREFIXES))).alias("t")).filter(F.size("t") > 0)
    t = cut(starts.groupBy("t").agg(F.count("*").alias("n")))  # texts are read once; questions share their beginnings
    got, parent = None, None
    for k in range(1, PREFIXES + 1):
        rows = t.filter(F.size("t") >= k)
        if parent is not None:
            rows = rows.withColumn("prefix", F.array_join(F.slice("t", 1, k - 1), " ")).join(F.broadcast(parent), "prefix", "left_semi").drop("prefix")  # at most 50 rows
        level = rows.groupBy(F.array_join(F.slice("t", 1, k), " ").alias("prefix")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "prefix").limit(TOP_PREFIXES)
        parent = level.select("prefix")
        part = level.select(F.lit(k).alias("k"), "prefix", "n")
        got = part if got is None else got.union(part)
    return got


@query(_PREFIX + " " + " UNION ALL ".join(f"SELECT {k} AS k, prefix, n FROM k{k}" for k in range(1, PREFIXES + 1)))
def prefix_levels_table(spark: SparkSession, d: str) -> DataFrame:
    return prefix_levels(pair_rows(spark, d))


_CLOSED = ", l AS (" + " UNION ALL ".join(f"SELECT {k} AS k, prefix, n FROM k{k}" for k in range(1, PREFIXES + 1)) + "), c AS (SELECT k, prefix, n FROM l AS u WHERE NOT (k >= 3 AND EXISTS (SELECT 1 FROM l AS v WHERE v.k = u.k + 1 AND starts_with(v.prefix, u.prefix || ' ') AND v.n > 0.8 * u.n)))"


def closed_prefixes(levels: DataFrame) -> DataFrame:
    """Drops a prefix of three words or more that one child nearly always continues (over 0.8)."""
    child = levels.select((F.col("k") - 1).alias("k"), F.regexp_replace("prefix", " [^ ]+$", "").alias("prefix"), F.col("n").alias("m")).groupBy("k", "prefix").agg(F.max("m").alias("m"))
    return levels.join(child, ["k", "prefix"], "left").filter("k < 3 OR m IS NULL OR m <= 0.8 * n").select("k", "prefix", "n")


@query(_PREFIX + _CLOSED + " SELECT k, prefix, n FROM c")
def prefix_patterns(spark: SparkSession, d: str) -> DataFrame:
    return closed_prefixes(prefix_levels(pair_rows(spark, d)))


@query(_PREFIX + _CLOSED + ", g AS (SELECT list(prefix) AS g FROM c WHERE k >= 2) SELECT id, CAST(NOT m1 AND NOT m2 AS INT) AS neither, CAST(m1 AND m2 AS INT) AS both_match, CAST(m1 <> m2 AS INT) AS any_different FROM (SELECT id, len(list_filter(g, lambda x: contains(array_to_string(a, ' '), x))) > 0 AS m1, len(list_filter(g, lambda x: contains(array_to_string(b, ' '), x))) > 0 AS m2 FROM p, g)")
def pattern_flags(spark: SparkSession, d: str) -> DataFrame:
    """Whether neither, both, or just one of the questions contains a pattern of two words or more (at most 200 patterns)."""
    df = pair_rows(spark, d)
    found = F.broadcast(closed_prefixes(prefix_levels(df)).filter("k >= 2").agg(F.collect_list("prefix").alias("g")))
    t = df.select("id", F.array_join("a", " ").alias("s"), F.array_join("b", " ").alias("t")).crossJoin(found)  # one row
    t = t.select("id", F.expr("exists(g, x -> contains(s, x))").alias("m1"), F.expr("exists(g, x -> contains(t, x))").alias("m2"))
    return t.select("id", (~F.col("m1") & ~F.col("m2")).cast("int").alias("neither"), (F.col("m1") & F.col("m2")).cast("int").alias("both_match"), (F.col("m1") != F.col("m2")).cast("int").alias("any_different"))


@query("SELECT CAST(doc_id % 1000 AS BIGINT) AS part, count(*) AS n, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars FROM documents GROUP BY 1")
def shard_sizes(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/documents.parquet")
    return t.groupBy((F.col("doc_id") % 1000).alias("part")).agg(F.count("*").alias("n"), F.sum(F.length(F.coalesce("text", F.lit("")))).cast("long").alias("chars"))


@query("SELECT qid, count(*) AS n_docs, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars, min(doc_id) AS first_doc FROM documents WHERE qid IS NOT NULL GROUP BY qid")
def thread_sizes(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/documents.parquet").filter("qid IS NOT NULL")
    return t.groupBy("qid").agg(F.count("*").alias("n_docs"), F.sum(F.length(F.coalesce("text", F.lit("")))).cast("long").alias("chars"), F.min("doc_id").alias("first_doc"))


@query(f"""{_MI}, m AS (SELECT u, v, c12.c / n * ln(c12.c * n / (c1.c * c2.c)) AS mi FROM c12 JOIN c1 ON u = c1.w JOIN c2 ON v = c2.w, n WHERE c12.c >= 3),
k AS (SELECT id, list_distinct(list_filter(a, lambda w: NOT list_contains(b, w))) AS a, list_distinct(list_filter(b, lambda w: NOT list_contains(a, w))) AS b FROM p), x2 AS (SELECT id, unnest(a) AS u, b FROM k), y2 AS (SELECT id, u, unnest(b) AS v FROM x2)
SELECT id, round(sum(mi), 7) AS mi_sum, count(*) AS n_known FROM y2 JOIN m USING (u, v) GROUP BY id""")
def pair_mutual_information(spark: SparkSession, d: str) -> DataFrame:
    """Summed mutual information of the word pairs (word only in question1, word only in question2) that the table knows."""
    df = pair_rows(spark, d)
    f = df.filter("y = 1").select("id", F.array_distinct("a").alias("a"), F.array_distinct("b").alias("b"))
    n = F.lit(float(f.count()))
    c1 = f.select(F.explode("a").alias("u")).groupBy("u").agg(F.count("*").alias("c1")).filter("c1 >= 3")
    c2 = f.select(F.explode("b").alias("v")).groupBy("v").agg(F.count("*").alias("c2")).filter("c2 >= 3")
    c12 = f.select(F.explode("a").alias("u"), "b").select("u", F.explode("b").alias("v")).groupBy("u", "v").agg(F.count("*").alias("c12")).filter("c12 >= 3")
    m = c12.join(c1, "u").join(c2, "v").select("u", "v", "c12", (F.col("c12") / n * F.log(F.col("c12") * n / (F.col("c1") * F.col("c2")))).alias("mi"))
    only = df.select("id", F.array_distinct(F.array_except("a", "b")).alias("a"), F.array_distinct(F.array_except("b", "a")).alias("b"))
    each = only.select("id", F.explode("a").alias("u"), "b").select("id", "u", F.explode("b").alias("v"))
    heavy = m.filter(F.col("c12") > F.lit(max(100.0, df.count() * HEAVY_SHARE))).select("u", "v")
    j = salted_join(each, m, ["u", "v"], heavy, ["id"])
    return j.groupBy("id").agg(F.round(F.sum("mi"), 7).alias("mi_sum"), F.count("*").alias("n_known"))


_ON = "array_to_string(list_filter(list_transform(range(1, len(g) + 1), lambda i: CASE WHEN contains({s}, g[i]) THEN CAST(i AS VARCHAR) END), lambda z: z IS NOT NULL), ' ')"


@query(_PREFIX + _CLOSED + f", g AS (SELECT list(prefix ORDER BY prefix) AS g FROM c WHERE k >= 2) SELECT id, {_ON.replace('{s}', 's')} AS on1, {_ON.replace('{s}', 't')} AS on2 FROM (SELECT id, array_to_string(a, ' ') AS s, array_to_string(b, ' ') AS t FROM p), g")
def pattern_one_hot_both(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of the patterns (at most 200, in their order) that each question contains: the set places of both halves of the one-hot row."""
    df = pair_rows(spark, d)
    found = F.broadcast(closed_prefixes(prefix_levels(df)).filter("k >= 2").agg(F.array_sort(F.collect_list("prefix")).alias("g")))
    t = df.select("id", F.array_join("a", " ").alias("s"), F.array_join("b", " ").alias("t")).crossJoin(found)  # one row
    on = "array_join(filter(transform(g, (x, i) -> CASE WHEN contains({s}, x) THEN CAST(i + 1 AS STRING) END), z -> z IS NOT NULL), ' ')"
    return t.select("id", *(F.expr(on.replace("{s}", c)).alias(f"on{k}") for k, c in ((1, "s"), (2, "t"))))


@query(f"WITH {_Q.split(', c AS')[0].split(' UNION ALL SELECT question1 FROM test')[0]}), c AS (SELECT q, count(*) AS n FROM q WHERE q IS NOT NULL GROUP BY q), b AS (SELECT least(question1, question2) AS lo, greatest(question1, question2) AS hi, count(*) AS both_n FROM train WHERE question1 IS NOT NULL AND question2 IS NOT NULL AND question1 <> question2 GROUP BY 1, 2) SELECT id, c1.n + c2.n - both_n - 1 AS row_degree FROM train JOIN c AS c1 ON question1 = c1.q JOIN c AS c2 ON question2 = c2.q JOIN b ON lo = least(question1, question2) AND hi = greatest(question1, question2)")
def row_graph_degree(spark: SparkSession, d: str) -> DataFrame:
    """Other rows that share a question with a row, counted from question counts; rows with equal or null questions are left out.

    The row graph itself, quadratic in a question's rows, is never made.
    """
    t = spark.read.parquet(f"{d}/train.parquet").select("id", "question1", "question2")
    counts = t.select(F.explode(F.array("question1", "question2")).alias("q")).filter("q IS NOT NULL").groupBy("q").agg(F.count("*").alias("n"))
    r = t.filter("question1 != question2").withColumns({"lo": F.least("question1", "question2"), "hi": F.greatest("question1", "question2")})
    both = r.groupBy("lo", "hi").agg(F.count("*").alias("both_n"))
    rows = t.count()
    heavy = both.filter(F.col("both_n") > F.lit(max(100.0, rows * HEAVY_SHARE))).select("lo", "hi")
    j = with_counts(salted_join(r, both, ["lo", "hi"], heavy, ["id"]), counts, rows)
    return j.select("id", (F.col("n1") + F.col("n2") - F.col("both_n") - 1).alias("row_degree"))
