"""Consolidating pairwise matches into groups (problem 3).

Union-find within edge partitions; only spanning forests are kept, and forests are merged in partitions
of bounded size until the components are whole. While the forests together exceed one task, a round
contracts every node to a neighbour, the first by a hashed order that changes from round to round, and the
forests of the smaller graph take their place. A hashed order, unlike that of the ids, can't run along a
chain: about half the nodes of a chain go in every round, and all but the roots of a star.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.functions.text import bare
from twinfold.operators.skew import HEAVY_SHARE, salted_join
from twinfold.session import cut, drop_cut

#: Edges that one task may hold.
PER_TASK = 2_000_000
#: Rounds of contraction, and the share of the edges that two rounds must take off: beyond that the merge fails loudly.
MOST_ROUNDS, LEAST_GAIN = 60, 0.1
STARS = "node long, root long, rank long"


def ranks(nodes: np.ndarray, seed: int) -> np.ndarray:
    """A hashed order of nodes, another one for every seed."""
    z = nodes.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (2 * seed + 1) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))).view(np.int64)


def roots(a: np.ndarray, b: np.ndarray, seed: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over edges: all nodes, and for each the first node of its tree, by id or by the hashed order of ``seed``."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    if seed is not None:
        order = np.lexsort((nodes, ranks(nodes, seed)))
        place = np.empty(len(nodes), np.int64)
        place[order] = np.arange(len(nodes))
        nodes, at = nodes[order], place[at]
    up = list(range(len(nodes)))
    n = len(a)
    for x, y in zip(at[:n].tolist(), at[n:].tolist()):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        while up[y] != y:
            up[y] = up[up[y]]
            y = up[y]
        if x < y:
            up[y] = x
        elif y < x:
            up[x] = y
    top = np.array(up, np.int64)
    while len(top) and (nxt := top[top]) is not None and (nxt != top).any():
        top = nxt
    return nodes, nodes[top]


def _forest(limit: int, seed: int | None):
    """Stars of a partition's trees, (node, root, rank of the root); held edges are contracted at every ``limit``, and sent on if still more.

    Without a seed roots are the smallest nodes, and have a row of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out(nodes: np.ndarray, root: np.ndarray) -> Iterator[pa.RecordBatch]:
            if seed is not None:
                keep = nodes != root
                nodes, root = nodes[keep], root[keep]
            rank = ranks(root, seed or 0)
            for k in range(0, len(nodes), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 100_000]) for x in (nodes, root, rank)], names=["node", "root", "rank"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
            size += batch.num_rows
            if size > 2 * limit:
                held = [roots(*map(np.concatenate, zip(*held)), seed)]
                size = len(held[0][0])
                if size > limit and seed is not None:
                    yield from out(*held[0])
                    held, size = [], 0
        if held:
            yield from out(*roots(*map(np.concatenate, zip(*held)), seed))

    return run


def components(edges: DataFrame, per_task: int = PER_TASK, sizes: list[int] | None = None) -> DataFrame:
    """(node, root): every node of ``edges`` (two long columns) with the smallest node of its component.

    Null ends and loops are left out; repeated edges don't matter; no edges give no rows. ``sizes`` is given the number
    of forest edges before every round. Raises if rounds don't get on, which a hashed order makes as good as impossible.

    In a round, a node's row per partition names its root there, which comes before it in the hashed order; the node is
    contracted to the first of these roots, as is the root to its own. So a node has a row per partition at most,
    while a root may have any number of nodes: rows of such roots are salted.
    """
    a, b = (F.col(c) for c in edges.columns[:2])
    e = edges.select(a.cast("long").alias("a"), b.cast("long").alias("b")).filter("a != b")
    forest = cut(e.mapInArrow(_forest(per_task, 0), STARS))
    levels: list[DataFrame] = []
    sizes = [] if sizes is None else sizes
    while (n := forest.count()) > per_task:
        sizes.append(n)
        if len(sizes) > MOST_ROUNDS or (len(sizes) > 2 and n > (1 - LEAST_GAIN) * sizes[-3]):
            raise RuntimeError(f"forests aren't merged after {len(sizes)} rounds: {sizes[-3:]} edges")
        per_node = cut(forest.groupBy("node").agg(F.min(F.struct("rank", "root"))["root"].alias("up"), F.collect_set("root").alias("roots")))
        up = per_node.select("node", "up")
        levels.append(up)
        edges_left = per_node.select("up", F.explode("roots").alias("root"))
        heavy = _hubs(edges_left, "root", n)
        moved = salted_join(edges_left, up.withColumnRenamed("node", "root").withColumnRenamed("up", "to"), ["root"], heavy, ["up"], how="left")
        rest = moved.select(F.col("up").alias("a"), F.coalesce("to", "root").alias("b")).filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        smaller = cut(rest.mapInArrow(_forest(per_task, len(sizes)), STARS))
        drop_cut(forest)
        forest = smaller
    sizes.append(n)
    found = forest.select("node", "root").coalesce(1).mapInArrow(_forest(per_task, None), STARS).select("node", "root")
    if not levels:
        return found
    for up in reversed(levels):
        found = cut(found)
        own = salted_join(up, found.withColumnRenamed("node", "up"), ["up"], _hubs(up, "up", n), ["node"], how="left").select("node", F.coalesce("root", "up").alias("root"))
        tops = up.select(F.col("up").alias("node")).distinct().join(up.select("node"), "node", "left_anti")  # contracted to, but not themselves
        tops = tops.join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
        rest = found.join(up.select("node"), "node", "left_anti").join(tops.select("node"), "node", "left_anti")
        found = own.union(tops).union(rest)
    found = cut(found)
    least = found.groupBy("root").agg(F.min("node").alias("least"), F.count("*").alias("k"))
    heavy = least.filter(F.col("k") > F.lit(max(1000.0, HEAVY_SHARE * found.count()))).select("root")
    return salted_join(found, least.select("root", "least"), ["root"], heavy, ["node"]).select("node", F.col("least").alias("root"))


def _hubs(df: DataFrame, key: str, n: int) -> DataFrame:
    """Keys with more than a thousandth of the n rows."""
    return df.groupBy(key).agg(F.count("*").alias("k")).filter(F.col("k") > F.lit(max(1000.0, HEAVY_SHARE * n))).select(key)


def question_links(df: DataFrame, label: str = "is_duplicate") -> DataFrame:
    """(a, b): qids linked by a row marked as duplicate, or by equal bare forms (each with the smallest such qid)."""
    t = df.select("qid1", "qid2", F.col(label).alias("y"), bare(F.col("question1")).alias("b1"), bare(F.col("question2")).alias("b2"))
    marked = t.filter("y = 1 and b1 != '' and b2 != ''").select(F.col("qid1").alias("a"), F.col("qid2").alias("b"))
    ends = t.select(F.explode(F.array(F.struct(F.col("qid1").alias("qid"), F.col("b1").alias("b")), F.struct(F.col("qid2").alias("qid"), F.col("b2").alias("b")))).alias("e"))
    forms = ends.select("e.qid", "e.b").filter("b != '' and qid is not null").select("qid", F.unhex(F.md5("b")).alias("form")).distinct()
    sets = forms.groupBy("form").agg(F.min("qid").alias("first"), F.count("*").alias("n")).filter("n > 1")
    heavy = sets.filter(F.col("n") > F.lit(max(1000.0, HEAVY_SHARE * df.count()))).select("form")
    same = salted_join(forms, sets, ["form"], heavy, ["qid"]).filter("qid != first").select(F.col("first").alias("a"), F.col("qid").alias("b"))
    return marked.union(same)


def question_groups(df: DataFrame, label: str = "is_duplicate", per_task: int = PER_TASK) -> DataFrame:
    """(group_qid, qid): every question of a group but its smallest qid, with that qid.

    Blank questions and null qids are in no group; null labels mark nothing; contradicting labels don't unmark.
    """
    return components(question_links(df, label), per_task).filter("node != root").select(F.col("root").alias("group_qid"), F.col("node").alias("qid"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return question_groups(spark.read.parquet(f"{d}/train.parquet"))


_BARE = r"regexp_replace(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}]+', '', 'g')"
SQL = {
    "p3_found": f"""WITH RECURSIVE t AS (SELECT qid1, qid2, is_duplicate AS y, {_BARE.format('question1')} AS b1, {_BARE.format('question2')} AS b2 FROM train),
f AS (SELECT qid1 AS q, b1 AS b FROM t WHERE b1 <> '' UNION SELECT qid2, b2 FROM t WHERE b2 <> ''),
m AS (SELECT q, min(q) OVER (PARTITION BY b) AS r FROM f),
e AS (SELECT qid1 AS a, qid2 AS b FROM t WHERE y = 1 AND b1 <> '' AND b2 <> '' UNION SELECT q, r FROM m WHERE q <> r),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
w(node, seen) AS (SELECT a, a FROM u UNION SELECT u.b, w.seen FROM w JOIN u ON u.a = w.node WHERE w.seen < u.b)
SELECT min(seen) AS group_qid, node AS qid FROM w GROUP BY node HAVING min(seen) <> node"""
}
QUERIES = {"p3_found": p3_found}
