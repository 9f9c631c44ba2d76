"""Operators without SQL against numpy, invariants and brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinfold.operators import embed, graph, models, order, vectors

from .conftest import SMALL


@pytest.fixture(scope="module")
def sparse(spark):
    """40 sparse rows of 30 columns, with their dense form."""
    rng = np.random.default_rng(1)
    x = np.where(rng.random((40, 30)) < 0.3, rng.random((40, 30)), 0.0)
    x[5] = 0
    rows = [(i, 1, np.flatnonzero(r).tolist(), r[r > 0].tolist()) for i, r in enumerate(x)]
    return x, spark.createDataFrame(rows, "id long, side int, js array<int>, vs array<double>").repartition(3).cache()


def test_svd_is_numpy_s(sparse):
    x, rows = sparse
    got = {r.id: r.svd for r in models.truncated_svd(rows, 4).collect()}
    values = np.linalg.svd(x, compute_uv=False)
    s = np.array([got[i] for i in range(40)])
    assert np.allclose(np.linalg.norm(s, axis=0), values[:4], rtol=1e-3)  # a coordinate's norm is its singular value
    assert np.abs(s.T @ s - np.diag(np.diag(s.T @ s))).max() < 1e-2 and not s[5].any()
    v = models.right_vectors(rows, 4)
    assert np.allclose(v.T @ v, np.eye(4), atol=1e-8) and np.allclose(x @ v, s)


@pytest.mark.parametrize("numbers", [4_000_000, 60])
def test_latent_cosines_without_a_whole_matrix(spark, sparse, monkeypatch, numbers):
    """Slices of two columns and of all give the cosines of numpy's standardised coordinates; no task or message has more columns than a slice."""
    x, rows = sparse
    monkeypatch.setattr(models, "SLICE", numbers)
    monkeypatch.setattr(models, "BLOCK", 1)  # blocks of 16 rows
    sent, once = [], models._gram_times
    monkeypatch.setattr(models, "_gram_times", lambda r, q: sent.append(q.size) or once(r, q))
    r = {i: (js, vs) for i, _, js, vs in rows.collect()}
    pairs = spark.createDataFrame([(k, *r[2 * k], *r[2 * k + 1]) for k in range(20)], "id long, js1 array<int>, vs1 array<double>, js2 array<int>, vs2 array<double>")
    got = {p.id: p.lsi for p in models.latent_cosines(pairs, 4).collect()}
    c = x @ models.right_vectors(rows, 4)
    z = (c - c.mean(0)) / c.std(0, ddof=1)
    a, b = z[::2], z[1::2]
    want = (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))
    assert [got[k] for k in range(20)] == pytest.approx(want.tolist(), abs=1e-4) and max(sent) <= numbers


def test_nmf_comes_near(sparse):
    x, rows = sparse
    w = {r.id: r.w for r in models.nmf(rows, 6, 12).collect()}
    w = np.array([w[i] for i in range(40)])
    assert (w >= 0).all() and not w[5].any()
    h = np.linalg.lstsq(w, x, rcond=None)[0]
    best = np.sqrt((np.linalg.svd(x, compute_uv=False)[6:] ** 2).sum())
    assert np.linalg.norm(x - w @ h) < 1.5 * best < np.linalg.norm(x)


def test_topics_are_shares(spark):
    got = models.lda_topics(spark, SMALL).collect()
    assert len(got) == 800 and {r.side for r in got} == {1, 2}
    sums = [sum(r.topics) for r in got]  # questions without a counted word have no topic
    assert all(abs(s - 1) < 1e-6 or s == 0 for s in sums) and sum(s > 0 for s in sums) > 700 and all(min(r.topics) >= 0 for r in got)


def test_scores_come_from_other_folds(spark):
    """A label that nothing foretells but the row's own number: models that see a row's fold would know it, others can't."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rng = random.Random(2)
    rows = [(i, float(rng.random() < 0.5), i % 5, *(1.0 if i % 5 == k else 0.0 for k in range(5))) for i in range(200)]
    t = VectorAssembler(inputCols=[f"c{k}" for k in range(5)], outputCol="x").transform(spark.createDataFrame(rows, "id long, y double, fold int, " + ", ".join(f"c{k} double" for k in range(5))))
    got = {r.id: r.p for r in models.out_of_fold(t, LogisticRegression(featuresCol="x", labelCol="y", regParam=0.0), "p").collect()}
    assert len(got) == 200
    for k in range(5):  # the fold's own indicator was 0 in its training rows, so all its rows get one score, near the others' mean
        own = {round(got[i], 9) for i in range(200) if i % 5 == k}
        assert len(own) == 1


def test_stacking_blends(spark):
    got = models.stacking(spark, SMALL).collect()
    names = list(models.learners())
    assert got and all(0 <= r.p <= 1 and 0 <= r.adjusted <= 1 for r in got) and set(names) <= set(got[0].asDict())
    y, p = np.array([r.y for r in got]), np.array([r.p for r in got])
    assert p[y == 1].mean() > p[y == 0].mean() + 0.1
    assert [r.id for r in got] == list(dict.fromkeys(r.id for r in got))


def test_redundant_features(spark):
    got = models.feature_correlation(spark, SMALL).collect()
    assert len(got) == 28 and all(abs(r.rho) <= 1 + 1e-9 and r.redundant == (abs(r.rho) > 0.8) for r in got)
    assert next(r.rho for r in got if {r.feature, r.earlier} == {"dice", "jaccard_distance"}) < -0.99


def test_subspaces(spark):
    names = list("abcdefgh")
    bags = models.column_bags(names, times=40)
    assert len(bags) == 40 and all(len(b) == len(set(b)) == 6 for b in bags) and {x for b in bags for x in b} == set(names)
    assert all(0 <= r.p <= 1 for r in models.random_subspaces(spark, SMALL).collect())


def test_word_vectors(spark):
    got = models.word2vec_similarity(spark, SMALL).collect()
    assert len(got) == 400 and all(-1.001 <= r.cosine <= 1.001 and r.distance >= 0 for r in got)
    g = {r.w: np.array(r.vec) for r in models.glove_vectors(spark, SMALL).collect()}
    assert len(g) > 100 and all(v.shape == (16,) and np.isfinite(v).all() for v in g.values())


def test_factorisation_in_bounded_blocks(spark, monkeypatch):
    """Blocks grow with the entries, to a bound; nothing between the steps is kept in memory."""
    for entries, blocks in ((0, 10), (30_000_001, 11), (10**9, models.MOST_BLOCKS)):
        a = models.als(entries)
        assert a.getNumUserBlocks() == a.getNumItemBlocks() == blocks
        assert a.getIntermediateStorageLevel() == a.getFinalStorageLevel() == "DISK_ONLY"
    asked, als = [], models.als
    monkeypatch.setattr(models, "als", lambda n: asked.append(n) or als(n))
    assert models.glove_vectors(spark, SMALL).count() > 100 and asked[0] > 1000


def test_walks_follow_edges(spark):
    e = [(1, k) for k in range(2, 40)] + [(2, 3), (50, 51)]
    u = graph.both_ways(spark.createDataFrame(e, "src long, dst long"))
    near = {}
    for a, b in e:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    walks = [r.walk for r in models.random_walks(u, 4, 2).collect()]
    assert len(walks) == 2 * len(near) and all(len(w) == 5 for w in walks)
    assert all(b in near[a] for w in walks for a, b in zip(w, w[1:]))
    assert len({w[1] for w in walks if w[0] == 1} | {w[3] for w in walks}) > 5


def test_walk_vectors_of_whole_components(spark, monkeypatch):
    """Every node has a vector, whatever the size of its component; nodes of one ring are nearer to each other than to the other ring's; no vocabulary on the driver."""
    from twinfold.operators import walks

    ring = lambda lo, n: [(lo + k, lo + (k + j) % n) for k in range(n) for j in (1, 2, 3)]
    e = [(min(p), max(p)) for p in ring(0, 40) + ring(100, 40)] + [(1000 + 2 * k, 1001 + 2 * k) for k in range(30)]
    df = spark.createDataFrame(e, "src long, dst long")
    g = walks.Graph(*np.array(e).T)
    near = {(g.ids[u], v) for u in range(len(g.ids)) for v in g.ids[g.near[g.start[u] : g.start[u] + g.size[u]]]}
    assert near == {p for a, b in e for p in ((a, b), (b, a))}
    w = g.ids[g.walks(0, len(g.ids), 6, 3)]
    assert len(w) == 3 * len(g.ids) and all((a, b) in near for r in w for a, b in zip(r, r[1:]))

    def larger(edges):
        asked.append(sorted(tuple(r) for r in edges.collect()))
        return spark.createDataFrame([(n, [3.0, n % 2 * 4.0]) for n in {n for p in asked[-1] for n in p}], "node long, v array<double>")

    x = walks.node_vectors(g, 6, 3, 16)
    far = lambda a, b: np.mean([np.linalg.norm(p - q) for p in x[a : a + 40] for q in x[b : b + 40]])
    assert np.isfinite(x).all() and max(far(0, 0), far(40, 40)) < 0.9 * far(0, 40)
    for most, own in ((2_000_000, 50_000), (200, 100), (100, 50)):
        monkeypatch.setattr(walks, "MOST_EDGES", most), monkeypatch.setattr(walks, "OWN_EDGES", own)
        asked = []
        got = {(r.src, r.dst): r.distance for r in walks.edge_distances(df, 6, 3, 16, larger, True).collect()}
        assert set(got) == {*e, *((n, n) for n in g.ids)} and all(v >= 0 for v in got.values())
        assert asked == ([sorted(p for p in e if p[0] < 1000)] if most == 100 else [])
        if most > 200:
            at = {n: k for k, n in enumerate(g.ids)}
            assert all(v == pytest.approx(np.linalg.norm(x[at[a]] - x[at[b]]) if a != b else np.linalg.norm(x[at[a]]), abs=1e-5) for (a, b), v in got.items())
        elif most == 100:
            assert got[0, 1] == 4 and got[0, 2] == 0 and got[1, 1] == 5 and got[0, 0] == 3


def test_walk_distance_of_odd_pairs(spark, tmp_path):
    """Equal and missing questions beside pairs: a row each; a missing one is at zero."""
    spark.createDataFrame([(1, 10, 11), (2, 11, 10), (3, 10, 10), (4, None, 10), (5, None, None), (6, 99, None)], "id long, qid1 long, qid2 long").write.parquet(f"{tmp_path}/train.parquet")
    got = {r["id"]: r.distance for r in models.pair_walk_distance(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6} and got[1] == got[2] > 0 and got[4] > 0 and got[3] == got[5] == got[6] == 0


def test_saved_models(spark):
    from twinfold.operators import files

    assert files.saved_models(spark, SMALL).filter("NOT same").count() == 0


def test_order_over_ranges(spark):
    """Ranks, carried values and rows before, with groups that span ranges, nulls, and one group with most rows."""
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "a", "a", "b", None, f"g{rng.randrange(20)}"]), rng.choice([None, None, None, f"v{i}"])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, g string, v string").repartition(7)
    place, last, want_rank, want_lag = {}, None, {}, {}
    for i, g, v in rows:
        want_rank[i] = place[g] = place.get(g, 0) + 1
    seen = {}
    carried = {}
    for i, g, v in rows:
        want_lag[i] = seen.get(g)
        seen[g] = i
        last = v or last
        carried[i] = last or "none"
    assert {r.id: r["rank"] for r in order.rank_in_order(df, ["g"], ["id"]).collect()} == want_rank
    assert {r.id: r["rank"] for r in order.rank_in_order(df, [], ["id"]).collect()} == {i: i + 1 for i in range(500)}
    assert {r.id: r.before for r in order.lag_in_order(df, ["g"], ["id"], {"id": "before"}).collect()} == want_lag
    assert {r.id: r.now for r in order.carry_last(df, ["id"], "v", "now", F.lit("none")).collect()} == carried
    for empty in (order.rank_in_order(df.limit(0), ["g"], ["id"]), order.lag_in_order(df.limit(0), ["g"], ["id"], {"id": "b"}), order.carry_last(df.limit(0), ["id"], "v", "w", F.lit("x"))):
        assert empty.count() == 0


def test_fuzzy_ratios():
    assert vectors.fuzzy_ratios("", "a") == (0.0, 0.0, 0.0, 0.0)
    assert vectors.fuzzy_ratios("A b!", "a  B")[0] == 1.0 and vectors.fuzzy_ratios("b a", "a b")[1] == 1.0
    quick, _, part_set, weighted = vectors.fuzzy_ratios("new york mets", "the wonderful new york mets of old times, again and again and again")
    assert part_set == 1.0 and quick < weighted < 1


def test_vectors_of_odd_texts(spark):
    table = spark.sparkContext.broadcast(embed.Words(["a", "b"], np.array([[1.0, 0.0], [0.0, 2.0]]), np.array([1.0, 0.5])))
    rows = [(1, ["a", "zz"], ["b"]), (2, [], ["a"]), (3, [], []), (4, ["a"] * 5000, ["a", "b"]), (5, ["zz"], ["a"])]
    df = spark.createDataFrame(rows, "id long, a array<string>, b array<string>")
    got = {r.id: r for r in embed.compared(df, table).collect()}
    assert got[1].cosine == 0 and got[1].coverage1 == 0.5 and got[3].importance == 0 and abs(got[4].cosine - 1 / np.sqrt(5)) < 1e-12
    w = {r.id: r for r in embed.word_by_word_features(df, table).collect()}
    assert w[2].sim_mean == -1 == w[3].relaxed_distance == w[5].sim_max and w[4].sim_mean == 0.5 and w[4].self1_mean == 1 and w[1].self1_mean == -1
    assert embed.compared(df.limit(0), table).count() == 0 == embed.word_by_word_features(df.limit(0), table).count()


def test_fuzzy_rows_are_those_of_single_pairs(monkeypatch):
    """Compared together as pair by pair: texts of odd letters, around 64 characters, equal, empty and very long ones; difflib is left to the last."""
    from twinfold.operators import blocks

    rng = random.Random(6)
    words = ["ab", "abc", "b", "cab?", "é", "\U0001f600x", "the", "the", "A1!"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    pairs = [(text(rng.choice([0, 1, 2, 9, 15, 17, 20, 40])), text(rng.choice([0, 1, 2, 9, 15, 17, 20, 40]))) for _ in range(150)] + [("", ""), ("?", "?"), ("same text", "same text"), ("x" * 70, "x" * 130), (text(450), text(5))]
    rows = [(k, s.lower(), t.lower(), re.sub(r"[!?]", "", s.lower()).split(), re.sub(r"[!?]", "", t.lower()).split()) for k, (s, t) in enumerate(pairs)]
    want = []
    for _, s, t, a, b in rows:
        base, one, two = vectors._sorted_sides(a, b)
        sort, most = vectors._ratio(" ".join(sorted(a)), " ".join(sorted(b))), max(vectors._ratio(base, one), vectors._ratio(base, two), vectors._ratio(one, two))
        c = vectors._common_substring(s, t)
        want.append((vectors._ratio(s, t), vectors._partial(s, t), sort, most, c, vectors._bleu(a, b, 1), vectors._bleu(a, b, 2), vectors._packed_distance(s, t), *vectors.fuzzy_ratios(s, t), c / max(len(s), len(t), 1)))
    calls, real = [], blocks.difflib.SequenceMatcher
    monkeypatch.setattr(blocks.difflib, "SequenceMatcher", lambda *x, **y: calls.append(x) or real(*x, **y))
    got = vectors.fuzzy_rows(rows)
    assert [(*r[1:9], *r[11:]) for r in got] == want and len(calls) < 30
    assert got[152][9:11] == (0, 0) and all(0 <= r[9] <= 64 and 0 <= r[10] <= 64 for r in got)
