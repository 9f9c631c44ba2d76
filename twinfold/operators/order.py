"""Operators that depend on an order of all rows, without a window over all rows.

Rows are cut into ranges of the order, whose bounds Spark samples; a group of any size may span many ranges.
Every range is numbered or scanned by itself, and what a range needs to know of the ones before it is a
few values per range: counts to add, or a last row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinfold.operators.encode import FOLDS
from twinfold.operators.pairs import PAIR_SQL
from twinfold.session import cut

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """A written table of the rows with ``__range``, the number of their range of the order: ranges ascend, none is larger than a partition."""
    return cut(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))


def rank_in_order(df: DataFrame, group: list[str], order: list[str], out: str = "rank") -> DataFrame:
    """Adds the rank, from 1, of every row among those of its group; ``order`` should have no ties. Null groups and values come first.

    A group's rows may be in any number of ranges. The offsets are one row per group and range that meet: at most
    the groups and the ranges together, joined by key.
    """
    t = ranged(df, [*group, *order])
    per = t.groupBy("__range", *group).agg(F.count("*").alias("__n"))
    firsts = per.groupBy(*group).agg(F.count("*").alias("__k")) if group else None
    split = per if firsts is None else per.join(firsts.filter("__k > 1").drop("__k"), _same(per, firsts, group), "left_semi")
    before = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # over one row per range
    offsets = split.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).select(*(F.col(g).alias(f"__g{i}") for i, g in enumerate(group)), F.col("__range").alias("__r"), "__before")
    own = F.row_number().over(Window.partitionBy("__range", *group).orderBy(*order))
    ranked = t.withColumn("__own", own)
    on = ranked["__range"] == offsets["__r"]
    for i, g in enumerate(group):
        on = on & ranked[g].eqNullSafe(offsets[f"__g{i}"])
    # groups that span ranges are at most as many as ranges: a small table
    joined = ranked.join(F.broadcast(offsets), on, "left")
    return joined.select(*df.columns, (F.col("__own") + F.coalesce("__before", F.lit(0))).cast("long").alias(out))


def _same(a: DataFrame, b: DataFrame, cols: list[str]) -> Column:
    on = F.lit(True)
    for c in cols:
        on = on & a[c].eqNullSafe(b[c])
    return on


def carry_last(df: DataFrame, order: list[str], value: str, out: str, default: Column) -> DataFrame:
    """Adds the last value that isn't null of this or any row before in the order, else ``default``.

    Of every range only its last value is needed by later ones: one row per range.
    """
    t = ranged(df, order)
    own = F.last(value, ignorenulls=True).over(Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    ends = t.groupBy("__range").agg(F.max(F.when(F.col(value).isNotNull(), F.struct(*order, value)))[value].alias("__end"))
    before = F.last("__end", ignorenulls=True).over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    carried = F.broadcast(ends.select("__range", before.alias("__carried")))  # one row per range
    return t.withColumn("__own", own).join(carried, "__range", "left").select(*df.columns, F.coalesce("__own", "__carried", default).alias(out))


def lag_in_order(df: DataFrame, group: list[str], order: list[str], values: dict[str, str]) -> DataFrame:
    """Adds, as ``values[name]``, the value of ``name`` in the row before within the group; null for its first row.

    Only the first row of a range may need a row of another range: the last one of the range before, if its group is the same.
    """
    t = ranged(df, [*group, *order])
    w = Window.partitionBy("__range", *group).orderBy(*order)
    row = F.struct(*group, *order, *(F.col(v).alias(f"__v{i}") for i, v in enumerate(values)))
    ends = t.groupBy("__range").agg(F.max(row).alias("__end"))
    carried = F.broadcast(ends.select("__range", F.lag("__end").over(Window.orderBy("__range")).alias("__end")))  # one row per range
    same = F.lit(True)
    for g in group:
        same = same & F.col(f"__end.{g}").eqNullSafe(F.col(g))
    first = (F.row_number().over(w) == 1) & F.col("__end").isNotNull()
    got = t.join(carried, "__range", "left").withColumn("__first", first)
    return got.select(*df.columns, *(F.when(F.col("__first"), F.when(same, F.col(f"__end.__v{i}"))).otherwise(F.lag(v).over(w)).alias(n) for i, (v, n) in enumerate(values.items())))


_SPANS = """WITH s AS (SELECT doc_id, qid, epoch_us(posted_at) AS s, epoch_us(received_at) AS e FROM documents WHERE qid IS NOT NULL AND received_at > posted_at),
k AS (SELECT doc_id, qid, s, e, lag(s) OVER w AS ps, lag(e) OVER w AS pe FROM s WINDOW w AS (PARTITION BY qid ORDER BY s, doc_id))"""


@query(_SPANS + """ SELECT doc_id, CAST(coalesce(s < pe AND ps < e, false) AS INT) AS overlaps, CAST(coalesce(ps <= s AND pe >= e, false) AS INT) AS inside_previous, CAST(coalesce(pe <= s, false) AS INT) AS previous_before,
CASE WHEN coalesce(s < pe AND ps < e, false) THEN least(e, pe) - greatest(s, ps) ELSE 0 END AS degree_us FROM k""")
def span_relations(spark: SparkSession, d: str) -> DataFrame:
    """Overlap, containment, precedence and degree of overlap between a document's way (posted to received) and that of the one before in its thread.

    Threads are of any size; a tenth of all documents may be one.
    """
    t = spark.read.parquet(f"{d}/documents.parquet").filter("qid IS NOT NULL AND received_at > posted_at")
    t = t.select("doc_id", "qid", F.unix_micros(F.col("posted_at").cast("timestamp")).alias("s"), F.unix_micros(F.col("received_at").cast("timestamp")).alias("e"))
    k = lag_in_order(t, ["qid"], ["s", "doc_id"], {"s": "ps", "e": "pe"})
    over = F.coalesce((F.col("s") < F.col("pe")) & (F.col("ps") < F.col("e")), F.lit(False))
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return k.select("doc_id", over.cast("int").alias("overlaps"), yes((F.col("ps") <= F.col("s")) & (F.col("pe") >= F.col("e"))).alias("inside_previous"), yes(F.col("pe") <= F.col("s")).alias("previous_before"), F.when(over, F.least("e", "pe") - F.greatest("s", "ps")).otherwise(0).alias("degree_us"))


@query(_SPANS + " SELECT doc_id, CAST(coalesce(s < pe AND ps < e, false) AS INT) AS overlaps_previous, CASE WHEN coalesce(s < pe AND ps < e, false) THEN least(e, pe) - greatest(s, ps) ELSE 0 END AS degree_us FROM k")
def span_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Whether a document's way (posted to received) overlaps that of the one before in its thread, and by how much."""
    return span_relations(spark, d).select("doc_id", F.col("overlaps").alias("overlaps_previous"), F.col("degree_us").cast("long").alias("degree_us"))


_KEY = "md5(CAST(id AS VARCHAR) || ':1024')"


@query(f"SELECT id, is_duplicate, CAST((row_number() OVER (PARTITION BY is_duplicate ORDER BY {_KEY}, id) - 1) % {FOLDS} AS INT) AS fold FROM train WHERE is_duplicate IS NOT NULL")
def stratified_fold_ids(spark: SparkSession, d: str) -> DataFrame:
    """Exactly stratified folds: the rows of every label, shuffled by a digest, are dealt out in turn."""
    t = spark.read.parquet(f"{d}/train.parquet").filter("is_duplicate IS NOT NULL").select("id", "is_duplicate", F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit("1024"))).alias("h"))
    return rank_in_order(t, ["is_duplicate"], ["h", "id"]).select("id", "is_duplicate", ((F.col("rank") - 1) % FOLDS).cast("int").alias("fold"))


@query("WITH q AS (SELECT qid1 AS q FROM train UNION SELECT qid2 FROM train) SELECT q AS qid, row_number() OVER (ORDER BY q) - 1 AS code FROM q WHERE q IS NOT NULL")
def label_codes(spark: SparkSession, d: str) -> DataFrame:
    """Consecutive numbers of all question ids, in their order."""
    q = spark.read.parquet(f"{d}/train.parquet").select(F.explode(F.array("qid1", "qid2")).alias("qid")).filter("qid IS NOT NULL").distinct()
    return rank_in_order(q, [], ["qid"]).select("qid", (F.col("rank") - 1).alias("code"))


BATCH = 128


@query(f"WITH r AS (SELECT id, row_number() OVER (ORDER BY {_KEY}, id) - 1 AS k FROM train) SELECT id, k // {BATCH} AS batch, CAST(k % {BATCH} AS INT) AS place FROM r")
def training_batches(spark: SparkSession, d: str) -> DataFrame:
    """The epoch's shuffled order in batches of 128 rows; another seed in the digest gives another epoch."""
    t = spark.read.parquet(f"{d}/train.parquet").select("id", F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit("1024"))).alias("h"))
    k = F.col("rank") - 1
    return rank_in_order(t, [], ["h", "id"]).select("id", F.floor(k / BATCH).alias("batch"), (k % BATCH).cast("int").alias("place"))


DOC = 1000


@query(f"WITH e AS (SELECT qid1 AS a, qid2 AS b FROM train WHERE qid1 <> qid2 UNION SELECT qid2, qid1 FROM train WHERE qid1 <> qid2), r AS (SELECT a, b, (row_number() OVER (PARTITION BY a ORDER BY b) - 1) // {DOC} AS part FROM e) SELECT a AS node, part, string_agg(CAST(b AS VARCHAR), ' ' ORDER BY b) AS ids FROM r GROUP BY a, part")
def neighbour_documents(spark: SparkSession, d: str) -> DataFrame:
    """A question's neighbours as text, joined by blanks in parts of 1,000: a document for training node vectors, or an adjacency file."""
    t = spark.read.parquet(f"{d}/train.parquet").filter("qid1 != qid2")
    e = t.select(F.explode(F.array(F.struct(F.col("qid1").alias("node"), F.col("qid2").alias("nb")), F.struct(F.col("qid2").alias("node"), F.col("qid1").alias("nb")))).alias("e")).select("e.*").distinct()
    r = rank_in_order(e, ["node"], ["nb"]).withColumn("part", F.floor((F.col("rank") - 1) / DOC))
    ids = F.transform(F.array_sort(F.collect_list("nb")), lambda x: x.cast("string"))  # 1,000 at most
    return r.groupBy("node", "part").agg(F.array_join(ids, " ").alias("ids"))


_TOPICS = f"""WITH {PAIR_SQL}, s AS (SELECT unnest(list_distinct(list_intersect(a, b))) AS w FROM p), g AS (SELECT w, count(*) AS n FROM s WHERE length(w) > 4 GROUP BY w ORDER BY n DESC, w LIMIT 30), k AS (SELECT w, row_number() OVER (ORDER BY n DESC, w) AS r FROM g),
m AS (SELECT p.id, arg_min(k.w, k.r) AS topic FROM (SELECT id, unnest(list_intersect(a, b)) AS w FROM p) AS p JOIN k USING (w) GROUP BY p.id), t AS (SELECT p.id, topic FROM p LEFT JOIN m USING (id))"""


@query(_TOPICS + " SELECT id, coalesce(last_value(topic IGNORE NULLS) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'default') AS topic FROM t")
def sticky_topic(spark: SparkSession, d: str) -> DataFrame:
    """The first of 30 frequent shared words that both questions have; without one, the topic of the last row that had one, however far before."""
    from twinfold.operators.structure import own_topics

    return carry_last(own_topics(spark, d), ["id"], "topic", "carried", F.lit("default")).select("id", F.col("carried").alias("topic"))
