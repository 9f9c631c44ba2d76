"""Graph measures brought to the rows of pairs: neighbour sets, node scalars, keyword sets of components, more neighbour metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.functions.text import clean_tokens
from twinfold.operators import graph
from twinfold.operators.edits import EDIT_SUMS, edit_of_cell, edit_of_lists
from twinfold.operators.graph import _QE, _UE, _neighbour_pairs_sql, _whole_sql, both_ways, degrees, hubs, neighbour_pairs_agg, neighbour_texts, question_edges, triangles, whole_neighbour_agg
from twinfold.operators.order import carry_last
from twinfold.operators.pairs import _TOK, PAIR_SQL, pair_rows
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


def with_nodes(pairs: DataFrame, nodes: DataFrame, values: list[str]) -> DataFrame:
    """Left joins of node values to both ends of (id, qid1, qid2), as value1 and value2; ends in very many rows are salted. ``pairs`` is a written table."""
    for k in "12":
        q = f"qid{k}"
        pairs = salted_join(pairs, nodes.select(F.col("node").alias(q), *(F.col(v).alias(f"{v}{k}") for v in values)), [q], hubs(pairs.select(q), q), ["id"], how="left")
    return pairs


def _ids(spark: SparkSession, d: str) -> DataFrame:
    return cut(spark.read.parquet(f"{d}/train.parquet").filter("qid1 != qid2").select("id", "qid1", "qid2"))


def combined(name: str) -> list[Column]:
    """Least, largest, difference, mean, ratio and sum of a value of the two ends."""
    x, y = F.col(f"{name}1"), F.col(f"{name}2")
    lo, hi = F.least(x, y), F.greatest(x, y)
    return [F.round(lo, 6).alias(f"{name}_min"), F.round(hi, 6).alias(f"{name}_max"), F.round(F.abs(x - y), 6).alias(f"{name}_diff"), F.round((x + y) / 2, 6).alias(f"{name}_mean"), F.round(F.when(hi > 0, lo / hi).otherwise(0.0), 6).alias(f"{name}_ratio"), F.round(x + y, 6).alias(f"{name}_sum")]


def _combined_sql(name: str, x: str, y: str) -> str:
    return f"round(least({x}, {y}), 6) AS {name}_min, round(greatest({x}, {y}), 6) AS {name}_max, round(abs({x} - {y}), 6) AS {name}_diff, round(({x} + {y}) / 2, 6) AS {name}_mean, round(CASE WHEN greatest({x}, {y}) > 0 THEN least({x}, {y}) / greatest({x}, {y}) ELSE 0 END, 6) AS {name}_ratio, round({x} + {y}, 6) AS {name}_sum"


@query(f"""WITH {_QE}, g AS (SELECT src AS node, CAST(count(*) AS DOUBLE) AS degree FROM u GROUP BY src), m AS (SELECT u.src AS node, avg(g.degree) AS near FROM u JOIN g ON g.node = u.dst GROUP BY u.src)
SELECT id, {_combined_sql('degree', 'g1.degree', 'g2.degree')}, {_combined_sql('near', 'm1.near', 'm2.near')} FROM train JOIN g AS g1 ON g1.node = qid1 JOIN g AS g2 ON g2.node = qid2 JOIN m AS m1 ON m1.node = qid1 JOIN m AS m2 ON m2.node = qid2 WHERE qid1 <> qid2""")
def pair_node_scalars(spark: SparkSession, d: str) -> DataFrame:
    """Degree, and mean degree of the neighbours, of the two questions of a row, combined in six ways."""
    e = cut(question_edges(spark, d))
    g = degrees(e).withColumn("degree", F.col("degree").cast("double"))
    u = both_ways(e)
    near = salted_join(u, g.withColumnRenamed("node", "dst"), ["dst"], hubs(u, "dst"), ["src"]).groupBy(F.col("src").alias("node")).agg(F.avg("degree").alias("near"))
    t = with_nodes(_ids(spark, d), cut(g.join(near, "node")), ["degree", "near"])
    return t.select("id", *combined("degree"), *combined("near"))


_NODES = f"""{_QE}, o AS (SELECT q, count(*) AS df FROM (SELECT qid1 AS q FROM train UNION ALL SELECT qid2 FROM train) WHERE q IS NOT NULL GROUP BY q), g AS (SELECT src AS node, count(*) AS degree FROM u GROUP BY src), k AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM g),
h AS (SELECT node, degree, -(df / n) * ln(df / n) AS h, power(ln((1 + n) / (1 + degree)) + 1, 2) AS w FROM g JOIN o ON q = node, k), s AS (SELECT u.src AS node, count(*) AS degree, sum(h.h) AS h, sum(h.w) AS w FROM u JOIN h ON h.node = u.dst GROUP BY u.src),
c AS (SELECT e.src, e.dst, count(*) AS n, sum(h.h) AS h, sum(h.w) AS w FROM e JOIN u AS x ON x.src = e.src JOIN u AS y ON y.src = e.dst AND y.dst = x.dst JOIN h ON h.node = x.dst GROUP BY 1, 2)"""


@query(f"""WITH {_NODES} SELECT t.id, round(greatest(a.h, b.h), 6) + 0 AS max_entropy, round(least(a.h, b.h), 6) + 0 AS min_entropy, round(coalesce(c.n, 0) / CAST(a.degree + b.degree - coalesce(c.n, 0) AS DOUBLE), 6) AS jaccard, coalesce(c.n, 0) AS shared, round(coalesce(c.h, 0), 6) + 0 AS shared_entropy, round(coalesce(c.w, 0) / sqrt(a.w * b.w), 6) AS bag_cosine
FROM train AS t JOIN s AS a ON a.node = qid1 JOIN s AS b ON b.node = qid2 LEFT JOIN c ON c.src = least(qid1, qid2) AND c.dst = greatest(qid1, qid2) WHERE qid1 <> qid2""")
def neighbour_sets(spark: SparkSession, d: str) -> DataFrame:
    """The neighbours of the two questions of a row as sets: entropies, intersection, Jaccard, and cosine of their TF-IDF bags.

    What two questions share are the third corners of triangles, which are found from the end of lower degree; neighbour
    lists are never made.
    """
    train = spark.read.parquet(f"{d}/train.parquet")
    e = cut(question_edges(spark, d))
    df = train.select(F.explode(F.array("qid1", "qid2")).alias("node")).filter("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("df"))
    g = cut(degrees(e).join(df, "node"))
    n = F.lit(float(max(g.count(), 1)))
    p = F.col("df") / n
    h = cut(g.select("node", "degree", (-p * F.log(p)).alias("h"), F.pow(F.log((1 + n) / (1 + F.col("degree"))) + 1, F.lit(2.0)).alias("w")))
    u = cut(both_ways(e))
    sums = salted_join(u, h.select(F.col("node").alias("dst"), "h", "w"), ["dst"], hubs(u, "dst"), ["src"]).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"), F.sum("h").alias("h"), F.sum("w").alias("w"))
    corner = F.explode(F.array(*(F.struct(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"), F.col(c).alias("node")) for a, b, c in (("x", "y", "z"), ("x", "z", "y"), ("y", "z", "x")))))
    thirds = cut(triangles(e).select(corner.alias("t")).select("t.*"))
    shared = salted_join(thirds, h.select("node", "h", "w"), ["node"], hubs(thirds.select("node"), "node"), ["src", "dst"]).groupBy("src", "dst").agg(F.count("*").alias("cn"), F.sum("h").alias("ch"), F.sum("w").alias("cw"))
    t = with_nodes(_ids(spark, d), cut(sums), ["degree", "h", "w"]).withColumns({"src": F.least("qid1", "qid2"), "dst": F.greatest("qid1", "qid2")})
    t = t.join(shared, ["src", "dst"], "left")
    c = F.coalesce("cn", F.lit(0))
    return t.select(
        "id", (F.round(F.greatest("h1", "h2"), 6) + 0.0).alias("max_entropy"), (F.round(F.least("h1", "h2"), 6) + 0.0).alias("min_entropy"), F.round(c / (F.col("degree1") + F.col("degree2") - c), 6).alias("jaccard"), c.alias("shared"),
        (F.round(F.coalesce("ch", F.lit(0.0)), 6) + 0.0).alias("shared_entropy"), F.round(F.coalesce("cw", F.lit(0.0)) / F.sqrt(F.col("w1") * F.col("w2")), 6).alias("bag_cosine"),
    )


@query("""WITH r AS (SELECT id, qid1, qid2 FROM train WHERE qid1 IS NOT NULL AND qid2 IS NOT NULL), h AS (SELECT qid1 AS q, id FROM r UNION SELECT qid2, id FROM r), p1 AS (SELECT DISTINCT h.q, r.qid1 AS x FROM h JOIN r USING (id)), p2 AS (SELECT DISTINCT h.q, r.qid2 AS x FROM h JOIN r USING (id)),
c1 AS (SELECT p1.q, count(DISTINCT h.id) AS n FROM p1 JOIN h ON h.q = p1.x GROUP BY 1), c2 AS (SELECT p2.q, count(DISTINCT h.id) AS n FROM p2 JOIN h ON h.q = p2.x GROUP BY 1), f AS (SELECT r.id, a.n AS q1_q1, d.n AS q2_q2, c.n AS q1_q2, b.n AS q2_q1 FROM r JOIN c1 AS a ON a.q = qid1 JOIN c1 AS b ON b.q = qid2 JOIN c2 AS c ON c.q = qid1 JOIN c2 AS d ON d.q = qid2)
SELECT *, least(q1_q1, q2_q2, q1_q2, q2_q1) AS d2_min, greatest(q1_q1, q2_q2, q1_q2, q2_q1) AS d2_max, round(CAST(least(q1_q1, q2_q2, q1_q2, q2_q1) AS DOUBLE) / greatest(q1_q1, q2_q2, q1_q2, q2_q1), 6) AS d2_ratio FROM f""")
def two_hop_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows reached from a row in two steps: over the rows of one of its questions to their first (or second) questions, and to all rows of these.

    Reached rows are counted, not gathered: the rows of all reached questions, less those that hold two of them. The latter are edges between two
    reached questions, which are triangles with the question, or edges of the question itself if it is reached.
    """
    rows = cut(spark.read.parquet(f"{d}/train.parquet").filter("qid1 IS NOT NULL AND qid2 IS NOT NULL").select("id", "qid1", "qid2"))
    ends = rows.select(F.explode(F.array_distinct(F.array("qid1", "qid2"))).alias("node"), "qid1", "qid2")
    nodes = cut(ends.groupBy("node").agg(F.count("*").alias("n"), F.max((F.col("node") == F.col("qid1")).cast("long")).alias("f1"), F.max((F.col("node") == F.col("qid2")).cast("long")).alias("f2")))
    up = F.col("qid1") < F.col("qid2")
    e = cut(rows.filter("qid1 != qid2").groupBy(F.least("qid1", "qid2").alias("src"), F.greatest("qid1", "qid2").alias("dst")).agg(F.sum(up.cast("long")).alias("fw"), F.sum((~up).cast("long")).alias("bw")))
    # (q, v): v is the first, or the second, question of a row of both; w rows hold both
    near = cut(e.select(F.explode(F.array(
        F.struct(F.col("src").alias("q"), F.col("dst").alias("v"), (F.col("bw") > 0).cast("long").alias("one"), (F.col("fw") > 0).cast("long").alias("two"), (F.col("fw") + F.col("bw")).alias("w")),
        F.struct(F.col("dst").alias("q"), F.col("src").alias("v"), (F.col("fw") > 0).cast("long").alias("one"), (F.col("bw") > 0).cast("long").alias("two"), (F.col("fw") + F.col("bw")).alias("w")),
    )).alias("x")).select("x.*"))
    sized = salted_join(near, nodes.select(F.col("node").alias("v"), "n"), ["v"], hubs(near.select("v"), "v"), ["q"])
    s = lambda x: F.sum(F.expr(x))
    sums = sized.groupBy(F.col("q").alias("node")).agg(s("one * n").alias("s1"), s("two * n").alias("s2"), s("one * w").alias("w1"), s("two * w").alias("w2"))
    corner = F.explode(F.array(*(F.struct(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"), F.col(c).alias("q")) for a, b, c in (("x", "y", "z"), ("x", "z", "y"), ("y", "z", "x")))))
    t = triangles(e.select("src", "dst")).select(corner.alias("t")).select("t.*").join(e.select("src", "dst", (F.col("fw") + F.col("bw")).alias("w")), ["src", "dst"])
    for end, k in (("src", "a"), ("dst", "b")):
        t = t.join(near.select("q", F.col("v").alias(end), F.col("one").alias(f"one_{k}"), F.col("two").alias(f"two_{k}")), ["q", end])
    inner = t.groupBy(F.col("q").alias("node")).agg(s("w * one_a * one_b").alias("t1"), s("w * two_a * two_b").alias("t2"))
    got = nodes.join(sums, "node", "left").join(inner, "node", "left").fillna(0)
    per = cut(got.select("node", F.expr("f1 * n + s1 - f1 * w1 - t1").alias("one"), F.expr("f2 * n + s2 - f2 * w2 - t2").alias("two")))
    r = with_nodes(rows, per, ["one", "two"])
    c = [F.col(x) for x in ("one1", "two2", "two1", "one2")]
    lo, hi = F.least(*c), F.greatest(*c)
    return r.select("id", *(x.alias(n) for x, n in zip(c, ("q1_q1", "q2_q2", "q1_q2", "q2_q1"))), lo.alias("d2_min"), hi.alias("d2_max"), F.round(lo / hi, 6).alias("d2_ratio"))


def _words_of_questions() -> str:
    tok = lambda c: _TOK.replace("{c}", c)
    return f"q AS (SELECT q, min(t) AS t FROM (SELECT qid1 AS q, question1 AS t FROM train UNION ALL SELECT qid2, question2 FROM train) WHERE q IS NOT NULL AND t IS NOT NULL GROUP BY q), w AS (SELECT q, unnest(list_distinct({tok('t')})) AS w FROM q)"


_KEYS = f"WITH {PAIR_SQL}, {_words_of_questions()}, r AS ({graph.SQL['components']}), f AS (SELECT root, w, any_value(n_nodes) AS n_nodes, count(*) AS n FROM r JOIN w ON w.q = r.node WHERE n_nodes > 2 GROUP BY root, w), k AS (SELECT root, list(w ORDER BY w) AS ws FROM f WHERE n = n_nodes GROUP BY root)"


@query(_KEYS + " SELECT root, array_to_string(ws, '_') AS keywords, CAST(len(ws) AS INT) AS n_words FROM k")
def component_keywords(spark: SparkSession, d: str) -> DataFrame:
    """The words that all questions of a component of more than two have; components without such a word are left out."""
    return keyword_sets(spark, d).select("root", F.array_join("ws", "_").alias("keywords"), F.size("ws").alias("n_words"))


def keyword_sets(spark: SparkSession, d: str) -> DataFrame:
    """(root, ws): sorted words that all questions of a component share. A word's questions are counted before the shuffle, whatever the size of the component."""
    t = spark.read.parquet(f"{d}/train.parquet")
    ends = t.select(F.explode(F.array(F.struct(F.col("qid1").alias("node"), F.col("question1").alias("t")), F.struct(F.col("qid2").alias("node"), F.col("question2").alias("t")))).alias("e")).select("e.*")
    texts = ends.filter("node IS NOT NULL AND t IS NOT NULL").groupBy("node").agg(F.min("t").alias("t"))
    r = graph.components(spark, d).filter("n_nodes > 2").select("node", "root", "n_nodes")
    words = r.join(texts, "node").select("root", "n_nodes", F.explode(F.array_distinct(clean_tokens(F.col("t")))).alias("w"))
    every = words.groupBy("root", "n_nodes", "w").agg(F.count("*").alias("n")).filter("n = n_nodes")
    return every.groupBy("root").agg(F.array_sort(F.collect_list("w")).alias("ws"))  # no more than a question's words


_FIRST = ", m AS (SELECT p.id, arg_min(array_to_string(ws, '_'), root) AS topic FROM (SELECT id, list_intersect(a, b) AS shared FROM p) AS p JOIN k ON len(list_intersect(shared, ws)) = len(ws) GROUP BY p.id), t AS (SELECT p.id, topic FROM p LEFT JOIN m USING (id))"


@query(_KEYS + _FIRST + " SELECT id, coalesce(last_value(topic IGNORE NULLS) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'default') AS topic FROM t")
def keyword_topics(spark: SparkSession, d: str) -> DataFrame:
    """A pair's topic is the first keyword set, by its component, that its shared words contain; without one, that of the last pair that had one.

    A set can only be contained where its rarest word is: that word is the key of the join, and containment is tested on what meets.
    """
    sets = cut(keyword_sets(spark, d).groupBy("ws").agg(F.min("root").alias("root")))  # of equal sets only the first can be a topic
    df = cut(pair_rows(spark, d).select("id", F.array_intersect("a", "b").alias("both")))
    each = df.select("id", "both", F.explode("both").alias("w"))
    often = cut(each.groupBy("w").agg(F.count("*").alias("n")))
    own = sets.select("root", "ws", F.explode("ws").alias("w")).join(often, "w").groupBy("root").agg(F.min(F.struct("n", "w"))["w"].alias("w"), F.first("ws").alias("ws"))
    least = max(100.0, (often.agg(F.sum("n")).first()[0] or 0) * HEAVY_SHARE)
    met = salted_join(each, own, ["w"], often.filter(F.col("n") > F.lit(least)).select("w"), ["id"])
    held = met.filter(F.size(F.array_intersect("both", "ws")) == F.size("ws"))
    first = held.groupBy("id").agg(F.min_by(F.array_join("ws", "_"), "root").alias("topic"))
    return carry_last(df.select("id").join(first, "id", "left"), ["id"], "topic", "carried", F.lit("default")).select("id", F.col("carried").alias("topic"))


_CLIQUES = f"""WITH RECURSIVE {_UE}, adj AS (SELECT src AS node, list(dst) AS near FROM u GROUP BY src),
c(nodes, last) AS (SELECT [src, dst], dst FROM e UNION ALL SELECT list_append(c.nodes, e.dst), e.dst FROM c JOIN e ON e.src = c.last JOIN adj ON adj.node = e.dst WHERE len(list_intersect(adj.near, c.nodes)) = len(c.nodes)),
x AS (SELECT c.nodes, f.node AS extra FROM c JOIN u ON u.src = c.nodes[1] JOIN adj AS f ON f.node = u.dst WHERE len(list_intersect(f.near, c.nodes)) = len(c.nodes)), m AS (SELECT nodes FROM c WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.nodes = c.nodes)), y AS (SELECT unnest(nodes) AS node, len(nodes) AS n FROM m)"""
#: SQL of ``graph.clique_stats``: cliques grown node by node, those that nothing extends kept.
CLIQUE_SQL = _CLIQUES + " SELECT node, count(*) AS n_cliques, CAST(max(n) AS INT) AS largest, round(avg(n), 6) AS mean_size, round(stddev_pop(n), 6) AS std_size FROM y GROUP BY node"
graph.SQL["clique_stats"] = CLIQUE_SQL


def _bigram_set(t: Column) -> Column:
    n = F.size(t)
    return F.array_sort(F.array_distinct(F.when(n < 2, t).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat_ws("_", F.get(t, i - 1), F.get(t, i))))))


def dice(x: Column, y: Column) -> Column:
    return F.when(F.size(x) + F.size(y) > 0, 2 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))).otherwise(0.0)


_BI = "CASE WHEN len({c}) < 2 THEN {c} ELSE list_transform(range(1, len({c})), lambda i: concat({c}[i], '_', {c}[i + 1])) END"
_DICE = "CASE WHEN len(a) + len(t) > 0 THEN CAST(2 * len(list_intersect(a, t)) AS DOUBLE) / (len(list_distinct(a)) + len(list_distinct(t))) ELSE 0.0 END"
_JAC = "CASE WHEN len({a}) + len({t}) > 0 THEN CAST(len(list_intersect({a}, {t})) AS DOUBLE) / (len(list_distinct({a})) + len(list_distinct({t})) - len(list_intersect({a}, {t}))) ELSE 0.0 END"
_difference: Callable[[Column, Column], Column] = lambda x, y: F.abs(x - y).cast("double")
_chars = lambda t: F.length(F.array_join(t, ""))
_unique = lambda t: F.size(F.array_distinct(t))
_first = lambda t: F.size(F.filter(t, lambda w: F.length(w) > 3))
#: name: (what is read of a text, its comparison, the comparison of counts in cells, SQL over token lists a and t)
METRICS = {
    "dice": (graph._token_set, dice, lambda both, of: 2 * both / of, _DICE),
    "bigram": (_bigram_set, graph.jaccard, None, _JAC.format(a=f"({_BI.format(c='a')})", t=f"({_BI.format(c='t')})")),
    "chars": (_chars, _difference, None, "CAST(abs(length(array_to_string(a, '')) - length(array_to_string(t, ''))) AS DOUBLE)"),
    "unique": (_unique, _difference, None, "CAST(abs(len(list_distinct(a)) - len(list_distinct(t))) AS DOUBLE)"),
    "long_words": (_first, _difference, None, "CAST(abs(len(list_filter(a, lambda w: length(w) > 3)) - len(list_filter(t, lambda w: length(w) > 3))) AS DOUBLE)"),
}


def _register() -> None:
    for name, (profile, metric, cell, sql) in METRICS.items():
        for mode in ("own", "cross"):

            def run(spark: SparkSession, d: str, profile=profile, metric=metric, cell=cell, mode=mode) -> DataFrame:
                return whole_neighbour_agg(spark, d, profile, metric, mode, cell)

            QUERIES[f"neighbour_{name}_{mode}"] = run
            SQL[f"neighbour_{name}_{mode}"] = _whole_sql(mode, sql)

    def length_own(spark: SparkSession, d: str) -> DataFrame:
        return whole_neighbour_agg(spark, d, F.size, _difference, "own")

    QUERIES["neighbour_length_own"] = length_own
    SQL["neighbour_length_own"] = _whole_sql("own", "CAST(abs(len(a) - len(t)) AS DOUBLE)")
    ascii_ = lambda t: F.regexp_replace(F.array_join(t, " "), "[^a-z0-9 ]", "")
    edit = lambda x, y: F.levenshtein(ascii_(x), ascii_(y)) / F.greatest(F.length(ascii_(x)), F.length(ascii_(y)), F.lit(1))

    def edit_between(spark: SparkSession, d: str) -> DataFrame:
        return neighbour_pairs_agg(*neighbour_texts(spark, d), edit, "between")

    x, y = (f"regexp_replace(array_to_string({t}.t, ' '), '[^a-z0-9 ]', '', 'g')" for t in "xy")
    QUERIES["neighbour_edit_between"] = edit_between
    SQL["neighbour_edit_between"] = _neighbour_pairs_sql("between", f"CAST(levenshtein({x}, {y}) AS DOUBLE) / greatest(length({x}), length({y}), 1)")


_register()

#: Different texts of a node up to which all its pairs are compared in one task; above it they are compared in cells of two blocks, of about as many texts at least.
EDIT_BLOCK = 1024
#: Blocks of a node, where that makes none smaller, and texts of a block above which there are more: a text is sent once for every block of its node.
EDIT_BLOCKS, EDIT_SIDE = 10, 8192
_PLAIN = f"regexp_replace(array_to_string({_TOK.replace('{c}', 'text')}, ' '), '[^a-z0-9 ]', '', 'g')"


@query(f"""WITH t AS (SELECT * FROM train WHERE qid1 <> qid2 AND question1 IS NOT NULL AND question2 IS NOT NULL), e AS (SELECT qid1 AS node, qid2 AS nb, question2 AS text FROM t UNION ALL SELECT qid2, qid1, question1 FROM t),
o AS (SELECT node, nb, min(text) AS text FROM e GROUP BY 1, 2), f AS (SELECT node, nb, {_PLAIN} AS s FROM o WHERE node IN (SELECT qid1 FROM t)),
v AS (SELECT x.node, CAST(levenshtein(x.s, y.s) AS DOUBLE) / greatest(length(x.s), length(y.s), 1) AS v FROM f AS x JOIN f AS y ON x.node = y.node AND y.nb > x.nb),
g AS (SELECT node, count(*) AS n, round(avg(v), 7) AS self_mean, round(max(v), 7) AS self_max, round(min(v), 7) AS self_min FROM v GROUP BY node) SELECT id, n, self_mean, self_max, self_min FROM t JOIN g ON node = qid1""")
def neighbour_edit_self(spark: SparkSession, d: str) -> DataFrame:
    """Edit distance, as a share of the longer text, over all pairs of question1's neighbours: their number, mean, largest and smallest.

    Compared once a node, whatever its rows; equal texts once, with their number. Nodes of many texts are cut into cells of two blocks of texts, so no
    task holds a hub; all its pairs are compared all the same.
    """
    t = spark.read.parquet(f"{d}/train.parquet").filter("qid1 != qid2 AND question1 IS NOT NULL AND question2 IS NOT NULL")
    rows = cut(t.select("id", F.col("qid1").alias("node")))
    end = lambda node, nb, text, first: F.struct(F.col(node).alias("node"), F.col(nb).alias("nb"), F.col(text).alias("text"), F.lit(first).alias("first"))
    ends = t.select(F.explode(F.array(end("qid1", "qid2", "question2", True), end("qid2", "qid1", "question1", False))).alias("e")).select("e.*")
    once = ends.groupBy("node", "nb").agg(F.min("text").alias("text"), F.max("first").alias("first"))
    plain = F.regexp_replace(F.array_join(clean_tokens(F.col("text")), " "), "[^a-z0-9 ]", "")
    near = cut(once.groupBy("node", plain.alias("s")).agg(F.count("*").alias("c"), F.max("first").alias("first")))
    sizes = near.groupBy("node").agg(F.count("*").alias("m"), F.sum("c").alias("n"), F.max("first").alias("first")).filter("first AND n > 1").drop("first")
    large = cut(sizes.filter(F.col("m") > EDIT_BLOCK).withColumn("blocks", F.greatest(F.ceil(F.col("m") / EDIT_SIDE), F.least(F.lit(EDIT_BLOCKS), F.ceil(F.col("m") / EDIT_BLOCK))).cast("int")))
    wanted = near.select("node", "s", "c").join(F.broadcast(large.select("node", "blocks")), "node", "left")
    few = wanted.filter("blocks IS NULL").groupBy("node").agg(F.collect_list(F.struct("s", "c")).alias("ts"), F.sum("c").alias("n")).filter("n > 1").select("node", "ts").join(rows.select("node").distinct(), "node", "left_semi")
    block = F.pmod(F.xxhash64("s"), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = wanted.filter("blocks IS NOT NULL").select("node", "s", "c", block.alias("own"), every.alias("other"))
    cells = cells.select("node", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "s", "c")
    parts = few.mapInArrow(edit_of_lists, EDIT_SUMS)
    number = large.agg(F.sum(F.expr("blocks * (blocks + 1) div 2"))).first()[0]
    if number:
        # a partition for a cell or two: by their bytes many cells would be one task
        parts = parts.union(cells.repartition(min(2 * number, 4096), "node", "i", "j").groupBy("node", "i", "j").applyInArrow(edit_of_cell, EDIT_SUMS))
    stats = parts.groupBy("node").agg(F.sum("total").alias("total"), F.max("most").alias("most"), F.min("least").alias("least")).join(sizes.select("node", "n"), "node")
    n = F.expr("n * (n - 1) div 2")
    per = stats.select("node", n.alias("n"), F.round(F.col("total") / n, 7).alias("self_mean"), F.round("most", 7).alias("self_max"), F.round("least", 7).alias("self_min"))
    return salted_join(rows, per, ["node"], hubs(rows, "node"), ["id"]).select("id", "n", "self_mean", "self_max", "self_min")


__all__ = ["HEAVY_SHARE", "QUERIES", "SQL", "component_keywords", "keyword_topics", "neighbour_edit_self", "neighbour_sets", "pair_node_scalars"]
