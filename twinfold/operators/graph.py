"""Graphs of related items: degrees, neighbours, components, PageRank, k-core, cliques, two-hop reach.

Edges are undirected and simple: (src, dst) with src < dst, distinct. Iterative operators cut their lineage
with written tables. ``both_ways`` gives every edge in both directions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinfold.operators.skew import HEAVY_SHARE, salted_join
from twinfold.session import cut, drop_cut

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def simple_edges(df: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct undirected edges without loops and null ends."""
    return df.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).distinct()


def user_edges(spark: SparkSession, d: str) -> DataFrame:
    """Users with consecutive purchases on one day."""
    from twinfold.operators.order import lag_in_order

    e = spark.read.parquet(f"{d}/events.parquet").filter("event_type = 'purchase'").select("ts", "event_id", "user_id", F.to_date("ts").alias("day"))
    return simple_edges(lag_in_order(e, ["day"], ["ts", "event_id"], {"user_id": "before"}), "before", "user_id")


def question_edges(spark: SparkSession, d: str) -> DataFrame:
    return simple_edges(spark.read.parquet(f"{d}/train.parquet"), "qid1", "qid2")


def both_ways(e: DataFrame) -> DataFrame:
    return e.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select("e.src", "e.dst")


_UE = """v AS (SELECT user_id AS a, lead(user_id) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS b FROM events WHERE event_type = 'purchase'),
e AS (SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst FROM v WHERE a <> b), u AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e)"""
_QE = "e AS (SELECT DISTINCT least(qid1, qid2) AS src, greatest(qid1, qid2) AS dst FROM train WHERE qid1 <> qid2), u AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e)"


def degrees(e: DataFrame) -> DataFrame:
    """(node, degree)."""
    return both_ways(e).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))


def hubs(e: DataFrame, key: str) -> DataFrame:
    """(key): nodes with more than a thousandth of the edges, a thousand at most."""
    n = e.count()
    return e.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > F.lit(max(100.0, n * HEAVY_SHARE))).select(key)


@query(f"WITH {_QE} SELECT src AS node, count(*) AS degree, min(dst) AS first_neighbour, max(dst) AS last_neighbour FROM u GROUP BY src")
def question_degree(spark: SparkSession, d: str) -> DataFrame:
    u = both_ways(question_edges(spark, d))
    return u.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"), F.min("dst").alias("first_neighbour"), F.max("dst").alias("last_neighbour"))


@query(f"WITH {_QE} SELECT u.src AS node, round(avg(g.n), 6) AS mean_degree FROM u JOIN (SELECT src, count(*) AS n FROM u GROUP BY src) AS g ON g.src = u.dst GROUP BY u.src")
def avg_neighbour_degree(spark: SparkSession, d: str) -> DataFrame:
    """Every directed edge (n to v) carries v's degree; the edges of a hub are combined before the shuffle."""
    e = question_edges(spark, d)
    u, g = cut(both_ways(e)), degrees(e)
    return salted_join(u, g.withColumnRenamed("node", "dst"), ["dst"], hubs(u, "dst"), ["src"]).groupBy(F.col("src").alias("node")).agg(F.round(F.avg("degree"), 6).alias("mean_degree"))


@query(f"WITH {_UE} SELECT e.src, e.dst, count(x.dst) AS common FROM e LEFT JOIN u AS x ON x.src = e.src LEFT JOIN u AS y ON y.src = e.dst AND y.dst = x.dst WHERE y.dst IS NOT NULL GROUP BY 1, 2")
def common_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours that both ends of an edge have (edges with at least one): triangles, found by orienting edges to the end of higher degree.

    The out-degree of an oriented edge list is at most the square root of twice its edges, so a hub opens few wedges.
    """
    e = user_edges(spark, d)
    t = triangles(e)
    sides = t.select(F.explode(F.array(*(F.struct(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")) for a, b in (("x", "y"), ("x", "z"), ("y", "z"))))).alias("s"))
    return sides.groupBy("s.src", "s.dst").agg(F.count("*").alias("common"))


def oriented(e: DataFrame) -> DataFrame:
    """(x, y): every edge from its end of lower degree to the other, ties by id."""
    g = degrees(e)
    j = e.join(g.withColumnRenamed("node", "src").withColumnRenamed("degree", "gs"), "src").join(g.withColumnRenamed("node", "dst").withColumnRenamed("degree", "gd"), "dst")
    up = (F.col("gs") < F.col("gd")) | ((F.col("gs") == F.col("gd")) & (F.col("src") < F.col("dst")))
    return j.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("x"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("y"), F.when(up, F.struct(F.col("gd").alias("g"), F.col("dst").alias("v"))).otherwise(F.struct(F.col("gs").alias("g"), F.col("src").alias("v"))).alias("__r"))


def triangles(e: DataFrame) -> DataFrame:
    """(x, y, z), each triangle once."""
    o = oriented(e)
    a, b = o.select("x", F.col("y"), F.col("__r").alias("ry")), o.select("x", F.col("y").alias("z"), F.col("__r").alias("rz"))
    wedge = a.join(b, "x").filter(F.col("ry") < F.col("rz")).select("x", "y", "z")
    closing = o.select(F.col("x").alias("y"), F.col("y").alias("z"))
    return wedge.join(closing, ["y", "z"]).select("x", "y", "z")


@query(f"WITH {_UE} SELECT count(*) AS triangles FROM e AS a JOIN e AS b ON a.dst = b.src JOIN e AS c ON c.src = a.src AND c.dst = b.dst")
def triangle_count(spark: SparkSession, d: str) -> DataFrame:
    return triangles(user_edges(spark, d)).agg(F.count("*").alias("triangles"))


def connected(e: DataFrame, most: int = 60) -> DataFrame:
    """(node, root), root the smallest node of the component, by alternating large-star and small-star steps until the edges stand still.

    The stars of a hub are made from its smallest neighbour, a combined minimum, so a hub's
    edges are never gathered in a task. Raises if ``most`` rounds don't suffice (they grow with the log of the nodes).
    """
    stars = cut(e.select(F.col("dst").alias("a"), F.col("src").alias("b")))  # a > b
    seen = None
    for _ in range(most):
        u = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = u.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = u.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b"), "m").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        old, stars = stars, cut(small.distinct())
        drop_cut(old)
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            roots = stars.select("b").distinct()
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("b", "b"))
        seen = now
    raise RuntimeError(f"components not whole after {most} rounds")


@query(f"""WITH RECURSIVE q AS (SELECT qid1 AS a, qid2 AS b FROM train WHERE is_duplicate = 1 AND qid1 <> qid2), e AS (SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst FROM q), u AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e),
w(node, seen) AS (SELECT src, src FROM u UNION SELECT u.dst, w.seen FROM w JOIN u ON u.src = w.node WHERE w.seen < u.dst), r AS (SELECT node, min(seen) AS root FROM w GROUP BY node),
n AS (SELECT root, count(*) AS n_nodes FROM r GROUP BY root), m AS (SELECT root, count(*) AS n_edges FROM e JOIN r ON r.node = e.src GROUP BY root) SELECT node, root, n_nodes, n_edges FROM r JOIN n USING (root) JOIN m USING (root)""")
def components(spark: SparkSession, d: str) -> DataFrame:
    """Nodes and edges of every question's component, over rows marked as duplicates."""
    e = simple_edges(spark.read.parquet(f"{d}/train.parquet").filter("is_duplicate = 1"), "qid1", "qid2")
    r = cut(connected(e))
    n = r.groupBy("root").agg(F.count("*").alias("n_nodes"))
    m = e.join(r.withColumnRenamed("node", "src"), "src").groupBy("root").agg(F.count("*").alias("n_edges"))
    return r.join(n, "root").join(m, "root").select("node", "root", "n_nodes", "n_edges")


def pagerank(arcs: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """(node, rank) after ``rounds`` steps from the uniform start; the mass of nodes without arcs is spread evenly. Cut every third step."""
    nodes = arcs.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    out = arcs.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out"))
    nodes = cut(nodes.join(out, "node", "left"))
    n = nodes.count()
    heavy = cut(hubs(arcs, "src"))
    ranks = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for k in range(rounds if n else 0):
        parts = ranks.filter("out IS NOT NULL").select(F.col("node").alias("src"), (F.col("rank") / F.col("out")).alias("part"))
        sent = salted_join(arcs, parts, ["src"], heavy, ["dst"]).groupBy(F.col("dst").alias("node")).agg(F.sum("part").alias("got"))
        loose = ranks.agg(F.coalesce(F.sum(F.when(F.col("out").isNull(), F.col("rank"))), F.lit(0.0)).alias("loose"))  # one row
        rank = ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("loose") / n)).alias("rank")
        ranks = nodes.join(sent, "node", "left").crossJoin(F.broadcast(loose)).select("node", "out", rank)
        if k % 3 == 2:
            ranks = cut(ranks)
    return ranks.select("node", "rank")


#: Arcs on which the last steps of a PageRank are made in one task; more are stepped as tables.
CORE_ARCS = 2_000_000


def pagerank_converged(arcs: DataFrame, damping: float = 0.85, tolerance: float = 1e-8, most: int = 1000, together: int = 6) -> DataFrame:
    """(node, rank) when ranks stand still: ``together`` steps move them by less than ``tolerance`` in sum. Raises if ``most`` steps don't suffice.

    Where the mass of nodes without arcs is spread evenly, ranks are in proportion to x = 1 + damping * (sum of x / out over the arcs that come in), so
    a step needs no sum over all nodes; the scale is set at the end. A step sends on only what the step before added. A node that got nothing gets
    nothing later, so its arcs are dropped; once CORE_ARCS are left, of however many, one task makes the steps that remain.
    """
    heavy = cut(hubs(arcs, "src"))
    out = arcs.groupBy("src").agg(F.count("*").alias("out"))
    live = cut(salted_join(arcs, out, ["src"], heavy, ["dst"]).select("src", "dst", (F.lit(damping) / F.col("out")).alias("w")))
    added = cut(arcs.select(F.explode(F.array("src", "dst")).alias("node")).distinct().select("node", F.lit(1.0).alias("x")))
    n, steps = added.count(), 0
    held, total, moved = [added], float(n), []
    while n and (left := live.count()) > CORE_ARCS:
        if len(moved) >= together and sum(moved[-together:]) < tolerance * total:
            left = 0
            break
        if steps >= most:
            raise RuntimeError(f"ranks still move after {most} steps")
        sent = salted_join(live, added.withColumnRenamed("node", "src"), ["src"], heavy, ["dst"])
        added, steps = cut(sent.groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("x") * F.col("w")).alias("x"))), steps + 1
        held.append(added)
        moved.append(added.agg(F.coalesce(F.sum("x"), F.lit(0.0))).first()[0])
        total += moved[-1]
        if (now := added.count()) < 0.9 * n:
            n, old = now, live
            live = cut(salted_join(live, added.select(F.col("node").alias("src")), ["src"], heavy, ["dst"]))
            drop_cut(old)
        if len(held) > together:
            tables, held = held, []
            held = [cut(_sums(tables[:-1])), added]
            for t in tables[:-1]:
                drop_cut(t)
    if n and left:
        both = live.select("src", "dst", "w").union(added.join(live.select(F.col("src").alias("node")).distinct(), "node", "left_semi").select("node", F.lit(None).cast("long"), "x"))
        run = _last_steps(total, moved, tolerance, most - steps, together)
        rest = cut(both.repartition(1).mapInArrow(run, "node long, x double"))
        got = rest.agg(F.sum("x"), F.count(F.when(F.col("node").isNull(), 1))).first()
        if got[1]:
            raise RuntimeError(f"ranks still move after {most} steps")
        held.append(rest)
        total += got[0] or 0.0
    return _sums(held).select("node", (F.col("x") / F.lit(total)).alias("rank"))


def _sums(tables: list[DataFrame]) -> DataFrame:
    """(node, x): x summed by node over tables."""
    return reduce(DataFrame.union, tables).groupBy("node").agg(F.sum("x").alias("x"))


def _last_steps(total: float, moved: list[float], tolerance: float, most: int, together: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Steps of ``pagerank_converged`` over arcs (src, dst, w) and the last addition (node, null, x), till they move little: what they add by node; with a row without a node, if ``most`` steps don't suffice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches), schema=pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("w", pa.float64())]))
        arc = np.asarray(t["dst"].is_valid())
        a, x = t.filter(pa.array(arc)), t.filter(pa.array(~arc))
        ids, code = np.unique(np.concatenate([a["src"].to_numpy(), a["dst"].to_numpy(), x["src"].to_numpy()]), return_inverse=True)
        src, dst, w = code[: len(a)], code[len(a) : 2 * len(a)], a["w"].to_numpy()
        now, sums, last, whole = np.bincount(code[2 * len(a) :], weights=x["w"].to_numpy(), minlength=len(ids)), np.zeros(len(ids)), list(moved), total
        for _ in range(most):
            now = np.bincount(dst, weights=now[src] * w, minlength=len(ids))
            sums += now
            last.append(now.sum())
            whole += last[-1]
            if not last[-1] or len(last) >= together and sum(last[-together:]) < tolerance * whole:
                break
        else:
            yield pa.RecordBatch.from_pydict({"node": pa.array([None], pa.int64()), "x": pa.array([0.0])})
        for lo in range(0, len(ids), 1 << 16):
            yield pa.RecordBatch.from_pydict({"node": pa.array(ids[lo : lo + (1 << 16)], pa.int64()), "x": pa.array(sums[lo : lo + (1 << 16)])})

    return run


def _pagerank_sql(source: str, arcs: str, rounds: int = 10, damping: float = 0.85) -> str:
    s = f"WITH {source}, arcs AS ({arcs}), nodes AS (SELECT src AS node FROM arcs UNION SELECT dst FROM arcs), o AS (SELECT src, count(*) AS n FROM arcs GROUP BY src), k AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM nodes), r0 AS (SELECT node, 1 / n AS rank FROM nodes, k)"
    for i in range(rounds):
        s += f", g{i} AS MATERIALIZED (SELECT dst AS node, sum(rank / o.n) AS got FROM arcs JOIN r{i} ON src = node JOIN o ON o.src = arcs.src GROUP BY dst), l{i} AS MATERIALIZED (SELECT coalesce(sum(rank), 0) AS loose FROM r{i} WHERE node NOT IN (SELECT src FROM o)), r{i + 1} AS MATERIALIZED (SELECT node, {1 - damping} / n + {damping} * (coalesce(got, 0) + loose / n) AS rank FROM nodes LEFT JOIN g{i} USING (node), l{i}, k)"
    return s + f" SELECT node, round(rank, 9) AS rank FROM r{rounds}"


@query(_pagerank_sql(_UE, "SELECT src, dst FROM u"))
def pagerank_10it(spark: SparkSession, d: str) -> DataFrame:
    return pagerank(cut(both_ways(user_edges(spark, d)))).withColumn("rank", F.round("rank", 9))


@query(_pagerank_sql("x AS (SELECT 1)", "SELECT DISTINCT qid1 AS src, qid2 AS dst FROM train WHERE qid1 <> qid2", 5, 0.9))
def pagerank_directed(spark: SparkSession, d: str) -> DataFrame:
    arcs = spark.read.parquet(f"{d}/train.parquet").filter("qid1 != qid2").select(F.col("qid1").alias("src"), F.col("qid2").alias("dst")).distinct()
    return pagerank(cut(arcs), 5, 0.9).withColumn("rank", F.round("rank", 9))


@query()
def pagerank_directed_converged(spark: SparkSession, d: str) -> DataFrame:
    """PageRank of the directed question graph when its ranks stand still (``pagerank_directed`` gives the fifth step)."""
    arcs = spark.read.parquet(f"{d}/train.parquet").filter("qid1 != qid2").select(F.col("qid1").alias("src"), F.col("qid2").alias("dst")).distinct()
    return pagerank_converged(cut(arcs), 0.9)


def core_numbers(e: DataFrame, most: int = 1000) -> DataFrame:
    """(node, core): the largest k whose k-core holds the node, by h-index iteration.

    Every node takes the largest h such that h neighbours have at least h; from the degrees on, this falls
    to the core numbers. A node's neighbour values are first counted by value (at most the node's own value, larger
    ones are cut to it), so a hub's neighbours are combined before the shuffle.
    """
    u = cut(both_ways(e))
    core = cut(degrees(e).withColumnRenamed("degree", "core"))
    heavy = cut(hubs(u, "src"))
    for _ in range(most):
        seen = salted_join(u, core.withColumnRenamed("node", "src").withColumnRenamed("core", "own"), ["src"], heavy, ["dst"])
        seen = salted_join(seen, core.withColumnRenamed("node", "dst").withColumnRenamed("core", "other"), ["dst"], heavy.withColumnRenamed("src", "dst"), ["src"])
        counts = seen.groupBy("src", "own", F.least("own", "other").alias("v")).agg(F.count("*").alias("n"))
        above = F.sum("n").over(Window.partitionBy("src").orderBy(F.desc("v")))
        nxt = counts.withColumn("above", above).groupBy(F.col("src").alias("node")).agg(F.max(F.least("v", "above")).alias("core"), F.max("own").alias("own"))
        nxt = cut(nxt)
        moved = nxt.filter("core != own").limit(1).count()
        core = nxt.select("node", "core")
        if not moved:
            return core
    raise RuntimeError(f"core numbers not found after {most} rounds")


@query()
def kcore(spark: SparkSession, d: str) -> DataFrame:
    return core_numbers(user_edges(spark, d))


_CORES = 4


@query(f"WITH {_UE}, c1 AS (SELECT * FROM u)" + "".join(f", c{k}_0 AS (SELECT * FROM c{k - 1})" + "".join(f", c{k}_{i} AS MATERIALIZED (SELECT * FROM c{k}_{i - 1} WHERE src IN (SELECT src FROM c{k}_{i - 1} GROUP BY src HAVING count(*) >= {k}) AND dst IN (SELECT src FROM c{k}_{i - 1} GROUP BY src HAVING count(*) >= {k}))" for i in range(1, 9)) + f", c{k} AS (SELECT * FROM c{k}_8)" for k in range(2, _CORES + 1)) + " SELECT node, CAST(max(k) AS INT) AS core4 FROM (" + " UNION ALL ".join(f"SELECT src AS node, {k} AS k FROM c{k}" for k in range(1, _CORES + 1)) + ") GROUP BY node")
def kcore_up_to_4(spark: SparkSession, d: str) -> DataFrame:
    """The core numbers, cut to 4."""
    return core_numbers(user_edges(spark, d)).select("node", F.least("core", F.lit(_CORES)).cast("int").alias("core4"))


@query(f"WITH {_UE}, t AS (SELECT DISTINCT a.src, b.dst FROM u AS a JOIN u AS b ON a.dst = b.src WHERE a.src <> b.dst) SELECT src AS node, count(*) AS two_hop FROM t GROUP BY src")
def two_hop(spark: SparkSession, d: str) -> DataFrame:
    """Different nodes reached in exactly two steps (direct neighbours too, if a second path leads there)."""
    u = both_ways(user_edges(spark, d))
    t = u.join(u.select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst").filter("src != far").select("src", "far").distinct()
    return t.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("two_hop"))


def maximal_cliques(e: DataFrame) -> DataFrame:
    """(clique): maximal cliques of two nodes or more, as sorted arrays.

    Every node gathers its later neighbours in a degree order (at most the square root of twice the edges), with
    their edges to its other neighbours; Bron-Kerbosch with pivot then gives the cliques of which it is the first node.
    """
    o = cut(oriented(e).select("x", "y"))
    later = o.groupBy("x").agg(F.sort_array(F.collect_list("y")).alias("later"))
    near = both_ways(e).select(F.col("src").alias("x"), F.col("dst").alias("n"))
    candidates = o.select("x", F.col("y").alias("n"))
    # adjacency between each later neighbour and every neighbour of x
    inner = candidates.join(near.withColumnRenamed("n", "m"), "x").filter("n != m").join(near.select(F.col("x").alias("n"), F.col("n").alias("m")), ["n", "m"]).select("x", "n", "m")
    links = inner.groupBy("x").agg(F.collect_list(F.struct("n", "m")).alias("links"))
    per = later.join(links, "x", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for x, late, link in zip(pdf["x"], pdf["later"], pdf["links"]):
                near_of: dict[int, set[int]] = {v: set() for v in late}
                for p in link if link is not None else ():
                    near_of[p["n"]].add(p["m"])
                first = set().union(*near_of.values()) - set(late)  # before x, and next to it and to one of the later ones
                stack = [((x,), set(late), first)]
                while stack:
                    held, cand, gone = stack.pop()
                    if not cand:
                        if not gone and len(held) > 1:
                            out.append(sorted(held))
                        continue
                    pivot = max(cand, key=lambda v: len(near_of[v] & cand))
                    for v in list(cand - near_of[pivot]):
                        stack.append(((*held, v), cand & near_of[v], gone & near_of[v]))
                        cand.remove(v)
                        gone.add(v)
            yield pd.DataFrame({"clique": out})

    return per.mapInPandas(run, "clique array<long>")


@query()
def clique_stats(spark: SparkSession, d: str) -> DataFrame:
    """Per node: number of maximal cliques, their largest and mean size and the deviation of sizes."""
    c = maximal_cliques(user_edges(spark, d)).select(F.explode("clique").alias("node"), F.size("clique").alias("n"))
    return c.groupBy("node").agg(F.count("*").alias("n_cliques"), F.max("n").alias("largest"), F.round(F.avg("n"), 6).alias("mean_size"), F.round(F.stddev_pop("n"), 6).alias("std_size"))


#: A node's first neighbours that metrics between two neighbours read: the number is part of their definition.
NEIGHBOURS = 20


def neighbour_texts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(id, question ids and tokens) of every pair, and (node, k, tokens) of the first 20 neighbours of a question by their ids."""
    from twinfold.functions.text import clean_tokens

    t = spark.read.parquet(f"{d}/train.parquet").filter("qid1 != qid2 AND question1 IS NOT NULL AND question2 IS NOT NULL")
    pairs = t.select("id", "qid1", "qid2", clean_tokens(F.col("question1")).alias("a"), clean_tokens(F.col("question2")).alias("b"))
    ends = t.select(F.explode(F.array(F.struct(F.col("qid1").alias("node"), F.col("qid2").alias("nb"), F.col("question2").alias("text")), F.struct(F.col("qid2").alias("node"), F.col("qid1").alias("nb"), F.col("question1").alias("text")))).alias("e")).select("e.*")
    # the first 20 of a part, then of all: a hub's neighbours never meet in one task
    part = F.pmod(F.xxhash64("nb"), F.lit(64))
    once = ends.groupBy("node", "nb").agg(F.min("text").alias("text"))
    first = once.withColumn("part", part).withColumn("k", F.row_number().over(Window.partitionBy("node", "part").orderBy("nb"))).filter(F.col("k") <= NEIGHBOURS)
    k = F.row_number().over(Window.partitionBy("node").orderBy("nb"))
    return pairs, first.withColumn("k", k).filter(F.col("k") <= NEIGHBOURS).select("node", "nb", clean_tokens(F.col("text")).alias("t"))


def jaccard(x: Column, y: Column) -> Column:
    both = F.size(F.array_intersect(x, y))
    return F.when(F.size(x) + F.size(y) > 0, both / (F.size(F.array_distinct(x)) + F.size(F.array_distinct(y)) - both)).otherwise(0.0)


_J = "CASE WHEN len(a) + len(t) > 0 THEN CAST(len(list_intersect(a, t)) AS DOUBLE) / (len(list_distinct(a)) + len(list_distinct(t)) - len(list_intersect(a, t))) ELSE 0.0 END"


def neighbour_pairs_agg(pairs: DataFrame, near: DataFrame, metric: Callable[[Column, Column], Column], mode: str) -> DataFrame:
    """Statistics of a metric over pairs of neighbours: ``self`` (two of question1), ``between`` (one of either question); at most 20 x 20 a row."""
    lists = near.groupBy("node").agg(F.collect_list(F.struct("nb", "t")).alias("ts"))
    j, rows = pairs.select("id", "qid1", "qid2"), pairs.count()
    for k in ("1", "2") if mode == "between" else ("1",):
        q = f"qid{k}"
        heavy = pairs.groupBy(q).agg(F.count("*").alias("n")).filter(F.col("n") > F.lit(max(100.0, rows * HEAVY_SHARE))).select(q)
        j = salted_join(j, lists.select(F.col("node").alias(q), F.col("ts").alias(f"t{k}")), [q], heavy, ["id"])
    if mode == "between":
        v = F.flatten(F.transform("t1", lambda x: F.transform("t2", lambda y: metric(x["t"], y["t"]))))
    else:
        v = F.flatten(F.transform("t1", lambda x: F.transform(F.filter("t1", lambda y: y["nb"] > x["nb"]), lambda y: metric(x["t"], y["t"]))))
    j = j.select("id", v.alias("v"))
    n = F.size("v")
    mean = F.aggregate("v", F.lit(0.0), lambda s, x: s + x) / n
    return j.filter(n > 0).select("id", n.alias("n"), F.round(mean, 7).alias(f"{mode}_mean"), F.round(F.array_max("v"), 7).alias(f"{mode}_max"), F.round(F.array_min("v"), 7).alias(f"{mode}_min"))


def _neighbour_pairs_sql(mode: str, value: str | None = None) -> str:
    from twinfold.operators.pairs import _TOK

    tok = lambda c: _TOK.replace("{c}", c)
    value = value or _J.replace("(a", "(x.t").replace(", t)", ", y.t)").replace("len(t)", "len(y.t)").replace("distinct(t)", "distinct(y.t)")
    join = "p JOIN f AS x ON x.node = p.qid1 JOIN f AS y ON y.node = p.qid2" if mode == "between" else "p JOIN f AS x ON x.node = p.qid1 JOIN f AS y ON y.node = p.qid1 AND y.nb > x.nb"
    return f"""WITH t AS (SELECT * FROM train WHERE qid1 <> qid2 AND question1 IS NOT NULL AND question2 IS NOT NULL), e AS (SELECT qid1 AS node, qid2 AS nb, question2 AS text FROM t UNION ALL SELECT qid2, qid1, question1 FROM t),
o AS (SELECT node, nb, min(text) AS text FROM e GROUP BY 1, 2), f AS (SELECT node, nb, {tok('text')} AS t FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY nb) AS k FROM o) WHERE k <= {NEIGHBOURS}),
p AS (SELECT id, qid1, qid2 FROM t), v AS (SELECT id, {value} AS v FROM {join}) SELECT id, CAST(count(*) AS INT) AS n, round(avg(v), 7) AS {mode}_mean, round(max(v), 7) AS {mode}_max, round(min(v), 7) AS {mode}_min FROM v GROUP BY id"""


@query(_neighbour_pairs_sql("self"))
def neighbour_jaccard_self(spark: SparkSession, d: str) -> DataFrame:
    return neighbour_pairs_agg(*neighbour_texts(spark, d), jaccard, "self")


@query(_neighbour_pairs_sql("between"))
def neighbour_jaccard_between(spark: SparkSession, d: str) -> DataFrame:
    return neighbour_pairs_agg(*neighbour_texts(spark, d), jaccard, "between")


#: Pairs (a question's text with a neighbour's text) of a node up to which they are joined row by row; above it they are compared in cells.
FEW_PAIRS = 4096
#: Texts of questions and of neighbours that meet in one cell, on average.
CELL = (4096, 32768)


def _jaccard_of(both, of):
    """From the shared and the summed sizes of two sets."""
    return both / (of - both)


def _jaccard_cell(a: list, t: list, c: list, value: Callable = _jaccard_of) -> Iterator[list[tuple[float, int]]]:
    """Per token set of ``a`` the (value, number) of its similarities to the sets of ``t``, each ``c`` times.

    Frequent words are counted by a matrix product, rare ones through their lists of sets; the sums are exact.
    """
    import numpy as np

    na, nt = np.array([len(x) for x in a]), np.array([len(x) for x in t])
    code, names = pd.factorize(np.array([w for x in (*a, *t) for w in x], dtype=object))
    ca, ct = code[: na.sum()], code[na.sum() :]
    ra, rt = np.repeat(np.arange(len(a)), na), np.repeat(np.arange(len(t)), nt)
    k, c = len(names), np.asarray(c, float)
    frequency = np.bincount(ct, minlength=k)
    place = np.full(k, -1)
    often = np.flatnonzero(frequency > max(32, len(t) // 256))
    place[often] = np.arange(len(often))
    dense = np.zeros((len(often), len(t)), np.float32)
    keep = place[ct] >= 0
    dense[place[ct[keep]], rt[keep]] = 1
    order = np.argsort(ct, kind="stable")
    lists, start = rt[order], np.cumsum(frequency) - frequency
    step = max(1, 2_000_000 // max(len(t), 1))
    for lo in range(0, len(a), step):
        n = min(step, len(a) - lo)
        mine = (ra >= lo) & (ra < lo + n)
        r, w = ra[mine] - lo, ca[mine]
        x = np.zeros((n, len(often)), np.float32)
        in_dense = place[w] >= 0
        x[r[in_dense], place[w[in_dense]]] = 1
        both = (x @ dense).astype(np.int64)
        r, w = r[~in_dense], w[~in_dense]
        each = frequency[w]
        at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(start[w], each)
        both += np.bincount(np.repeat(r, each) * len(t) + lists[at], minlength=n * len(t)).reshape(n, len(t))
        total = na[lo : lo + n, None] + nt[None, :]
        width, height_ = int(total.max()) + 1, int(both.max()) + 1
        bins = both * width + total
        for i in range(n):
            seen = np.bincount(bins[i], weights=c, minlength=height_ * width)
            at = np.flatnonzero(seen)
            inter, of = at // width, at % width
            yield [(float(v), int(m)) for v, m in zip(np.where(of > 0, value(inter, np.maximum(of, 1)), 0.0), seen[at])]


def _weighted(hs: Column, mode: str) -> list[Column]:
    """Mean, deviation, largest, smallest and median of ``hs``, an array of (v, c): value and how often."""
    n = F.aggregate(hs, F.lit(0).cast("long"), lambda s, h: s + h["c"])
    mean = F.aggregate(hs, F.lit(0.0), lambda s, h: s + h["v"] * h["c"]) / n
    square = F.aggregate(hs, F.lit(0.0), lambda s, h: s + h["v"] * h["v"] * h["c"]) / n
    vs = F.transform(hs, lambda h: h["v"])

    def at(place: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("cum"), F.lit(0.0).alias("v"))
        step = lambda s, h: F.struct((s["cum"] + h["c"]).alias("cum"), F.when(s["cum"] <= place, h["v"]).otherwise(s["v"]).alias("v"))
        return F.aggregate(F.array_sort(hs), zero, step, lambda s: s["v"])

    median = (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2
    out = {"mean": F.round(mean, 7), "std": F.round(F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))), 5), "max": F.round(F.array_max(vs), 7), "min": F.round(F.array_min(vs), 7), "median": F.round(median, 7)}
    return [v.alias(f"{mode}_{k}") for k, v in out.items()]


def whole_neighbour_agg(spark: SparkSession, d: str, profile: Callable[[Column], Column], metric: Callable[[Column, Column], Column], mode: str, cell: Callable | None = None) -> DataFrame:
    """Five statistics of a metric between question1 and all different neighbours of question1 (``own``) or question2 (``cross``).

    ``profile`` is what the metric reads of a text's tokens: a token set, or a number of few values; ``cell`` is the metric of two sets from
    their shared and summed sizes, Jaccard by default. Neighbours of one
    profile are compared once, with their number; at nodes of many pairs the questions' profiles too, and token sets are
    cut into cells of bounded size in both directions.
    """
    from twinfold.functions.text import clean_tokens

    t = spark.read.parquet(f"{d}/train.parquet").filter("qid1 != qid2 AND question1 IS NOT NULL AND question2 IS NOT NULL")
    key = {"own": "qid1", "cross": "qid2"}[mode]
    rows = cut(t.select("id", F.col(key).alias("node"), profile(clean_tokens(F.col("question1"))).alias("a")))
    ends = t.select(F.explode(F.array(F.struct(F.col("qid1").alias("node"), F.col("qid2").alias("nb"), F.col("question2").alias("text")), F.struct(F.col("qid2").alias("node"), F.col("qid1").alias("nb"), F.col("question1").alias("text")))).alias("e")).select("e.*")
    once = ends.groupBy("node", "nb").agg(F.min("text").alias("text"))
    near = cut(once.groupBy("node", profile(clean_tokens(F.col("text"))).alias("t")).agg(F.count("*").alias("c")))
    sizes = rows.groupBy("node").agg(F.count("*").alias("g")).join(near.groupBy("node").agg(F.count("*").alias("m")), "node")
    large = cut(sizes.filter(F.col("g") * F.col("m") > FEW_PAIRS))
    least = max(100.0, rows.count() * HEAVY_SHARE)
    heavy = cut(large.filter(F.greatest("g", "m") > F.lit(least)).select("node"))

    def sized(x: DataFrame, by: str) -> DataFrame:
        return salted_join(x, large.select("node", F.lit(True).alias("large")), ["node"], heavy, [by], how="left")

    def compared(a: DataFrame, b: DataFrame, by: str) -> DataFrame:
        pairs = a.join(b, "node").select("node", by, F.struct(metric(F.col("a"), F.col("t")).alias("v"), "c").alias("h"))
        return pairs.groupBy("node", by).agg(F.collect_list("h").alias("hs")).select("node", by, *_weighted(F.col("hs"), mode))

    a, b = sized(rows, "id"), sized(near, "t")
    out = compared(a.filter("large IS NULL").drop("large"), b.filter("large IS NULL").drop("large"), "id").drop("node")
    if not large.limit(1).count():
        return out
    a, b = cut(a.filter("large").drop("large")), b.filter("large").drop("large")
    kind = dict(rows.dtypes)["a"]
    mine = cut(a.groupBy("node", "a").agg(F.count("*").alias("n")))
    if kind.startswith("array"):
        cells = mine.groupBy("node").agg(F.count("*").alias("g")).join(large.select("node", "m"), "node").select("node", *(F.ceil(F.col(c) / size).cast("int").alias(c) for c, size in (("g", CELL[0]), ("m", CELL[1]))))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        x, y = (salted_join(t, cells, ["node"], heavy, [by]) for t, by in ((mine, "a"), (b, "t")))
        x = x.select("node", "a", F.pmod(F.xxhash64("a"), F.col("g")).cast("int").alias("i"), every("m").alias("j"))
        y = y.select("node", "t", "c", F.pmod(F.xxhash64("t"), F.col("m")).cast("int").alias("j"), every("g").alias("i"))

        def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
            hs = [[{"v": v, "c": n} for v, n in h] for h in _jaccard_cell(list(x["a"]), list(y["t"]), list(y["c"]), cell or _jaccard_of)] if len(x) and len(y) else [[]] * len(x)
            return pd.DataFrame({"node": x["node"], "a": x["a"], "hs": pd.Series(hs, index=x.index, dtype=object)})

        parts = x.groupBy("node", "i", "j").cogroup(y.groupBy("node", "i", "j")).applyInPandas(run, f"node long, a {kind}, hs array<struct<v:double,c:bigint>>")
        stats = parts.groupBy("node", "a").agg(F.flatten(F.collect_list("hs")).alias("hs")).select("node", "a", *_weighted(F.col("hs"), mode))
    else:
        stats = compared(mine.drop("n"), b, "a")
    often = mine.filter(F.col("n") > F.lit(least)).select("node", "a")
    return out.union(salted_join(a, stats, ["node", "a"], often, ["id"]).select(out.columns))


def _whole_sql(mode: str, value: str) -> str:
    from twinfold.operators.pairs import _TOK

    tok = lambda c: _TOK.replace("{c}", c)
    key = {"own": "qid1", "cross": "qid2"}[mode]
    return f"""WITH t AS (SELECT * FROM train WHERE qid1 <> qid2 AND question1 IS NOT NULL AND question2 IS NOT NULL), e AS (SELECT qid1 AS node, qid2 AS nb, question2 AS text FROM t UNION ALL SELECT qid2, qid1, question1 FROM t),
o AS (SELECT node, nb, min(text) AS text FROM e GROUP BY 1, 2), f AS (SELECT node, {tok('text')} AS t FROM o), p AS (SELECT id, {key} AS node, {tok('question1')} AS a FROM t), v AS (SELECT id, {value} AS v FROM p JOIN f USING (node))
SELECT id, round(avg(v), 7) AS {mode}_mean, round(sqrt(greatest(avg(v * v) - avg(v) * avg(v), 0)), 5) AS {mode}_std, round(max(v), 7) AS {mode}_max, round(min(v), 7) AS {mode}_min, round(median(v), 7) AS {mode}_median FROM v GROUP BY id"""


def _token_set(tokens: Column) -> Column:
    return F.array_sort(F.array_distinct(tokens))


@query(_whole_sql("own", _J))
def neighbour_jaccard_own_all(spark: SparkSession, d: str) -> DataFrame:
    """Jaccard similarities of question1 to all neighbours of its own."""
    return whole_neighbour_agg(spark, d, _token_set, jaccard, "own")


@query(_whole_sql("cross", _J))
def neighbour_jaccard_cross_all(spark: SparkSession, d: str) -> DataFrame:
    """Jaccard similarities of question1 to all neighbours of question2."""
    return whole_neighbour_agg(spark, d, _token_set, jaccard, "cross")


@query(_whole_sql("cross", "CAST(abs(len(a) - len(t)) AS DOUBLE)"))
def neighbour_length_cross_all(spark: SparkSession, d: str) -> DataFrame:
    """Differences in length to all neighbours of question2."""
    return whole_neighbour_agg(spark, d, F.size, lambda x, y: F.abs(x - y).cast("double"), "cross")
