"""Node vectors from random walks, made in tasks of whole components: skip-gram with negative sampling, in numpy over co-occurrences of bounded chunks of walks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.operators.graph import hubs
from twinfold.operators.skew import salted_join
from twinfold.session import cut

#: Edges of a component up to which one task walks it; edges above which a component has a task of its own; edges of small components to a task.
MOST_EDGES, OWN_EDGES, TASK_EDGES = 2_000_000, 50_000, 60_000
#: Nodes whose walks are counted together; nodes whose vectors are moved together.
CHUNK, STEP = 1 << 15, 1 << 13
#: Window of the co-occurrences, passes over a chunk's, nodes drawn against a step's, drawn nodes a pair, first step of a vector.
WINDOW, PASSES, DRAWN, AGAINST, RATE = 4, 3, 64, 5, 0.1


def _mixed(*values) -> np.ndarray:
    """A hash of whole numbers, by splitmix64."""
    h = np.uint64(0)
    for v in values:
        h = (np.asarray(v).astype(np.int64).astype(np.uint64) ^ h) + np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h = h ^ (h >> np.uint64(31))
    return h


class Graph:
    """Neighbours of numbered nodes, from edges that are there once each; nodes and neighbours in the order of their ids."""

    def __init__(self, src: np.ndarray, dst: np.ndarray):
        self.ids, code = np.unique(np.concatenate([src, dst]), return_inverse=True)
        a, b = code[: len(src)], code[len(src) :]
        key = np.sort(np.concatenate([a * len(self.ids) + b, b * len(self.ids) + a]))
        self.near = (key % len(self.ids)).astype(np.int32)
        self.size = np.bincount(key // len(self.ids), minlength=len(self.ids))
        self.start = np.cumsum(self.size) - self.size

    def walks(self, lo: int, hi: int, steps: int, each: int) -> np.ndarray:
        """``each`` walks from every node from lo to hi: a row each, its nodes in their order."""
        first, k = np.repeat(np.arange(lo, hi), each), np.tile(np.arange(each), hi - lo)
        out = np.empty((len(first), steps + 1), np.int64)
        out[:, 0] = at = first
        for step in range(steps):
            drawn = (_mixed(self.ids[first], k, np.full(len(k), step)) % self.size[at].astype(np.uint64)).astype(np.int64)
            out[:, step + 1] = at = self.near[self.start[at] + drawn]
        return out


def _together(walks: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(u, v, weight), ordered by u: nodes at most WINDOW steps apart in a walk; nearer ones weigh more, as with windows of random width."""
    keys, weights = [], []
    for o in range(1, min(WINDOW, walks.shape[1] - 1) + 1):
        x, y = walks[:, :-o].ravel(), walks[:, o:].ravel()
        keys += [x * n + y, y * n + x]
        weights += [np.full(2 * len(x), (WINDOW + 1 - o) / WINDOW)]
    key, weight = np.concatenate(keys), np.concatenate(weights)
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[first] // n, key[first] % n, np.add.reduceat(weight[order], first)


def _move(x: np.ndarray, held: np.ndarray, at: np.ndarray, by: np.ndarray) -> None:
    """Adds to rows ``at`` (different ones) what their gradients say, the less the more they were moved before."""
    held[at] += (by * by).mean(1)
    x[at] += RATE * by / np.sqrt(held[at] + 1e-8)[:, None]


def node_vectors(g: Graph, steps: int, each: int, size: int, seed: int = 7) -> np.ndarray:
    """A row of numbers for every node: near to those of nodes it meets on walks, far from those of nodes drawn by degree."""
    n, rng = len(g.ids), np.random.default_rng(seed)
    x = ((_mixed(np.repeat(g.ids, size), np.tile(np.arange(size), n), np.full(n * size, seed)) >> np.uint64(40)).astype(np.float32) / (1 << 24) - 0.5).reshape(n, size) / size
    y, held_x, held_y = np.zeros((n, size), np.float32), np.zeros(n, np.float32), np.zeros(n, np.float32)
    share = np.cumsum(g.size**0.75)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for lo in range(0, n, CHUNK):
        u, v, weight = _together(g.walks(lo, min(lo + CHUNK, n), steps, each), n)
        firsts = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
        edges = np.r_[firsts[::STEP], len(u)]
        orders = [np.argsort(v[a:b], kind="stable") for a, b in zip(edges[:-1], edges[1:])]
        for _ in range(PASSES):
            for order, a, b in zip(orders, edges[:-1], edges[1:]):
                p, q, w = u[a:b], v[a:b], weight[a:b].astype(np.float32)
                first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
                own, xs, ys = p[first], x[p], y[q]
                pull = (w * sigmoid(-np.einsum("ij,ij->i", xs, ys)))[:, None]
                drawn = np.searchsorted(share, rng.random(DRAWN) * share[-1], side="right").clip(max=n - 1)
                push = sigmoid(x[own] @ y[drawn].T) * (np.add.reduceat(w, first) * (AGAINST / DRAWN))[:, None]
                by = np.add.reduceat(pull * ys, first) - push @ y[drawn]
                away = push.T @ x[own]
                t = q[order]
                there = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
                near = np.add.reduceat((pull * xs)[order], there)
                place, back = np.unique(drawn, return_inverse=True)
                less = np.zeros((len(place), size), np.float32)
                np.add.at(less, back, away)
                _move(x, held_x, own, by)
                _move(y, held_y, t[there], near)
                _move(y, held_y, place, -less)
    return x


DISTANCES = "src long, dst long, distance double"


def _trained(steps: int, each: int, size: int, norms: bool) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        src, dst = t["src"].to_numpy(), t["dst"].to_numpy()
        g = Graph(src, dst)
        x = node_vectors(g, steps, each, size)
        far = np.empty(len(src))
        for lo in range(0, len(src), CHUNK):
            a, b = (np.searchsorted(g.ids, v[lo : lo + CHUNK]) for v in (src, dst))
            far[lo : lo + CHUNK] = np.linalg.norm(x[a].astype(np.float64) - x[b], axis=1)
        if norms:
            src, dst, far = np.r_[src, g.ids], np.r_[dst, g.ids], np.r_[far, np.linalg.norm(x.astype(np.float64), axis=1)]
        return pa.table({"src": src, "dst": dst, "distance": far})

    return run


def edge_distances(e: DataFrame, steps: int, each: int, size: int, larger: Callable[[DataFrame], DataFrame], norms: bool = False) -> DataFrame:
    """(src, dst, distance) of the vectors of both ends of every simple edge; with ``norms`` also (node, node, its vector's length).

    A walk stays in its component, so components are trained apart, and no vector leaves its task: small ones together in tasks of about TASK_EDGES
    edges, those above OWN_EDGES in tasks of their own. Components above MOST_EDGES, if any, are left to ``larger``, which gives (node, v) for their edges.
    Nodes are drawn among those of a task.
    """
    from twinfold.llm.groups import components

    roots = components(e)
    tagged = cut(salted_join(e, roots.withColumnRenamed("node", "src"), ["src"], hubs(e, "src"), ["dst"]))
    sizes = cut(tagged.groupBy("root").agg(F.count("*").alias("m")).filter(F.col("m") > OWN_EDGES))  # at most edges / OWN_EDGES
    tasks = max(1, -(-tagged.count() // TASK_EDGES))
    t = tagged.join(F.broadcast(sizes), "root", "left")
    small = F.when(F.col("m").isNull(), F.pmod(F.xxhash64("root"), F.lit(tasks)))
    within = t.filter(F.coalesce("m", F.lit(0)) <= MOST_EDGES).select(F.when(F.col("m").isNotNull(), F.col("root")).alias("own"), small.alias("part"), "src", "dst")
    got = within.groupBy("own", "part").applyInArrow(_trained(steps, each, size, norms), DISTANCES)
    if sizes.filter(F.col("m") > MOST_EDGES).limit(1).count():
        big = cut(t.filter(F.col("m") > MOST_EDGES).select("src", "dst"))
        v, far = cut(larger(big)), big
        for k, q in (("x", "src"), ("y", "dst")):
            far = salted_join(far, v.select(F.col("node").alias(q), F.col("v").alias(k)), [q], hubs(big, q), ["src", "dst"])
        apart = F.sqrt(F.expr("aggregate(zip_with(x, y, (s, t) -> (s - t) * (s - t)), 0D, (m, z) -> m + z)"))
        got = got.union(far.select("src", "dst", apart.alias("distance")))
        if norms:
            got = got.union(v.select("node", "node", F.sqrt(F.expr("aggregate(v, 0D, (m, z) -> m + z * z)"))))
    return cut(got)
