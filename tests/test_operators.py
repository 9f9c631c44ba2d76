import itertools
import random
import statistics
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from twinfold.functions import text
from twinfold.operators import corpus, encode, graph, graph_pairs, pairs, skew, structure, vectors
from twinfold.sources import io


def one(spark, expr, **cols):
    df = spark.range(1)
    for k, v in cols.items():
        df = df.withColumn(k, F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v))
    return df.select(F.expr(expr) if isinstance(expr, str) else expr).first()[0]


WORDS = "I am Denny boy ha".split()


@pytest.mark.parametrize(("n", "want"), [(1, WORDS), (2, ["I_am", "am_Denny", "Denny_boy", "boy_ha"]), (3, ["I_am_Denny", "am_Denny_boy", "Denny_boy_ha"]), (4, ["I_am_Denny_boy", "am_Denny_boy_ha"])])
def test_grams(spark, n, want):
    assert one(spark, pairs.grams("a", n)[0], a=WORDS) == want


def test_short_grams_fall_back(spark):
    assert one(spark, pairs.grams("a", 2)[0], a=["x"]) == ["x"]
    assert one(spark, pairs.grams("a", 4)[0], a=["x", "y"]) == ["x_y"]
    assert one(spark, pairs._terms("a", None)[0], a=WORDS) == ["_".join(p) for p in itertools.combinations(WORDS, 2)]


def test_spans(spark):
    c = lambda *x: [F.lit(v) for v in x]
    assert one(spark, structure.spans_overlap(*c(0, 10, 9, 10))) is True
    assert one(spark, structure.spans_overlap(*c(0, 10, 10, 11))) is False
    assert one(spark, structure.span_degree(*c(0, 10, 8, 11))) == 2
    assert one(spark, structure.span_degree(*c(0, 5, -1, 10))) == 5


def test_isa():
    up = structure.isa(structure.ABOVE)
    assert "arg" in up["agent"] and "dep" in up["ref"] and "mod" in up["predet"]
    assert "dep" in up["dep"] and "agent" not in up["dep"]


def test_words(spark):
    cases = {None: None, "": [], " ?! ": [], "Héllo, wörld-42 _x": ["héllo", "wörld", "42", "x"], "日本 ok": ["日本", "ok"]}
    for t, want in cases.items():
        df = spark.createDataFrame([(t,)], "t string")
        assert df.select(text.words(F.col("t"))).first()[0] == want
        assert df.select(text.bare(F.col("t"))).first()[0] == "".join(want or [])


def test_dense_counts_match_and_bear_skew_nulls_and_emptiness(spark):
    rng = random.Random(1)
    rows = [(rng.choice([5, 5, 5, 10**12, -7, None, rng.randint(0, 10**6)]), rng.choice([None, 1, 2])) for _ in range(5000)]
    df = spark.createDataFrame(rows, "a long, b long").repartition(7)
    got = {(r.field_name, r.value_key): r.n_rows for r in skew.dense_counts(df, ["a", "b"]).collect()}
    want = {}
    for r in rows:
        for f, v in zip("ab", r):
            if v is not None:
                want[f, v] = want.get((f, v), 0) + 1
    assert got == want
    assert skew.dense_counts(df.limit(0), ["a"]).count() == 0


def test_salted_join(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else str(i)) for i in range(300)] + [(300, None)], "id long, k string")
    right = spark.createDataFrame([("hot", 1), ("3", 2), ("x", 3)], "k string, v int")
    heavy = right.filter("k = 'hot'").select("k")
    inner = skew.salted_join(left, right, ["k"], heavy, ["id"])
    assert sorted((r.id, r.v) for r in inner.collect()) == sorted((r.id, r.v) for r in left.join(right, "k").collect())
    assert skew.salted_join(left, right, ["k"], heavy, ["id"], how="left").count() == 301


def random_edges(spark, n, m, seed):
    rng = random.Random(seed)
    e = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)}
    return e, spark.createDataFrame(sorted(e), "src long, dst long")


def test_connected(spark):
    e, df = random_edges(spark, 200, 140, 3)
    e |= {(1000 + i, 1001 + i) for i in range(40)}
    df = spark.createDataFrame(sorted(e), "src long, dst long")
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in e:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    assert {r.node: r.root for r in graph.connected(df).collect()} == {v: find(v) for p in e for v in p}


def test_cores_and_cliques(spark):
    e, df = random_edges(spark, 30, 130, 5)
    near = {}
    for a, b in e:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    core = {}
    for k in range(1, 30):
        left = set(near)
        while drop := {v for v in left if len(near[v] & left) < k}:
            left -= drop
        core |= dict.fromkeys(left, k)
    assert {r.node: r.core for r in graph.core_numbers(df).collect()} == core
    cliques = set()

    def grow(r, p, x):
        if not p and not x:
            cliques.add(tuple(sorted(r)))
        for v in list(p):
            grow(r | {v}, p & near[v], x & near[v])
            p = p - {v}
            x = x | {v}

    grow(set(), set(near), set())
    assert {tuple(r.clique) for r in graph.maximal_cliques(df).collect()} == cliques


def test_encoding_never_sees_its_own_fold(spark, tmp_path):
    rows = [(i, "alpha beta", f"gamma w{i}", i % 2) for i in range(50)]
    spark.createDataFrame(rows, "id long, question1 string, question2 string, is_duplicate int").write.parquet(f"{tmp_path}/train.parquet")
    got = {r.id: r for r in encode.oof_target_encoding(spark, str(tmp_path)).collect()}
    assert all(r.enc_min == 0 for r in got.values())  # the word of one row only has no label elsewhere


def test_calibration(spark):
    p = lambda x: one(spark, encode.prior_shifted(F.lit(x), 0.369, 0.173))
    assert p(0.0) == 0 and p(1.0) == 1 and 0 < p(0.3) < p(0.6) < 0.6


def test_fuzzy_pieces():
    assert vectors._common_substring("abcdef", "zcdez") == 3
    assert vectors._bleu("a b c".split(), "a b c".split(), 2) == 1
    assert vectors._partial("abc", "xxabcxx") == 1
    known = "caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster motoring motor sing sing conflated conflat hopping hop falling fall filing file happy happi sky sky relational relat rational ration valenci valenc digitizer digit radically radic triplicate triplic hopeful hope goodness good revival reviv allowance allow inference infer adjustable adjust replacement replac adoption adopt effective effect probate probat rate rate cease ceas controll control roll roll oscillators oscil generalizations gener".split()
    for word, want in zip(known[::2], known[1::2]):
        assert structure.stem(word) == want, word


def test_padding(spark):
    ids = F.array(F.lit(1), F.lit(2), F.lit(3))
    assert one(spark, encode.padded(ids, 5)) == [0, 0, 1, 2, 3]
    assert one(spark, encode.padded(ids, 2)) == [2, 3]
    assert one(spark, encode.padded(ids, 5, post=True)) == [1, 2, 3, 0, 0]


def test_weighted_centroids(spark):
    t = spark.createDataFrame([(1, 1, "a", 2.0), (1, 1, "b", 1.0), (1, 1, "zz", 5.0), (2, 1, "zz", 1.0)], "id long, side int, w string, weight double")
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 3.0])], "w string, vec array<double>")
    got = {r.id: r for r in vectors.weighted_centroids(t, v, v.filter("w = 'a'").select("w")).collect()}
    assert got[1].centre == [2 / 3, 1.0] and got[1].coverage == pytest.approx(2 / 3) and got[2].centre is None and got[2].coverage == 0


def test_cuts_can_be_dropped(spark):
    from twinfold import session

    session.drop_cuts(spark)
    t = session.cut(spark.range(5))
    assert t.count() == 5 and session.drop_cuts(spark) == 1 and session.drop_cuts(spark) == 0


def test_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,qid1,qid2,question1,question2,is_duplicate\n1,2,3,"a ""x"", b\nc",d,1\n')
    r = io.read_pairs(spark, str(tmp_path / "t.csv")).first()
    assert (r.question1, r.is_duplicate) == ('a "x", b\nc', 1)
    (tmp_path / "r.rule").write_text("teh->the\nnonsense\n wich -> which\n")
    rules = io.read_rules(spark, str(tmp_path / "r.rule"))
    df = spark.createDataFrame([(1, ["teh", "wich", "ok"]), (2, []), (3, None)], "id int, t array<string>")
    twice = df.union(df.limit(1))
    for most in (10, 0):
        assert [r.t for r in io.apply_rules(df, "t", rules, most).orderBy("id").collect()] == [["the", "which", "ok"], [], None]
        assert sorted(map(str, io.apply_rules(twice, "t", rules, most).collect())) == sorted(map(str, [*io.apply_rules(df, "t", rules, most).collect(), io.apply_rules(df, "t", rules, most).filter("id = 1").first()]))
    (tmp_path / "e.txt").write_text("2 2\na 1 2\nb x 2\nc 3 4\n")
    assert {r.word for r in io.read_embeddings(spark, str(tmp_path / "e.txt"), 2).collect()} == {"a", "c"}
    (tmp_path / "w.bin").write_bytes(b"1 2\nhi " + struct.pack("<2f", 1, 2) + b"\n")
    assert io.read_word2vec_binary(spark, str(tmp_path / "w.bin")).first().vec == [1, 2]
    io.write_shards(spark.range(10).coalesce(1), str(tmp_path / "s"), 4)
    assert len(list((tmp_path / "s").glob("*.parquet"))) == 3
    io.write_csv(spark.createDataFrame([('a"b', 1)], "x string, y int"), str(tmp_path / "q"), quote_all=True)
    assert io.read_pairs(spark, str(tmp_path / "q"), "x string, y int").first().x == 'a"b'


def test_llm_is_not_imported():
    import subprocess
    import sys

    code = "import sys; import twinfold.plans.registry, twinfold.sources.io; assert not [m for m in sys.modules if m.startswith('twinfold.llm')]"
    assert subprocess.run([sys.executable, "-c", code]).returncode == 0


@pytest.mark.parametrize("few", [4096, 0])
def test_all_neighbours_count(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW_PAIRS", few)
    monkeypatch.setattr(graph, "CELL", (2, 7))
    rng = random.Random(3)
    text_of = {q: " ".join(rng.choices("how do we learn to sing in a big old town".split(), k=rng.randint(1, 8))) for q in range(40)}
    text_of[39] = text_of[0] = "what is the whole of it"  # the neighbour that a cap by id would drop
    arcs = [(0, q) for q in range(1, 40)] + [(q, 0) for q in range(1, 40, 3)] + [(5, 6), (6, 7)]
    spark.createDataFrame([(i, a, b, text_of[a], text_of[b], 0) for i, (a, b) in enumerate(arcs)], "id long, qid1 long, qid2 long, question1 string, question2 string, is_duplicate int").write.parquet(f"{tmp_path}/train.parquet")
    near = {}
    for a, b in arcs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    words = {q: set(t.split()) for q, t in text_of.items()}
    for mode, query in (("own", graph.neighbour_jaccard_own_all), ("cross", graph.neighbour_jaccard_cross_all)):
        got = {r["id"]: r for r in query(spark, str(tmp_path)).collect()}
        assert len(got) == len(arcs)
        for i, (a, b) in enumerate(arcs):
            v = [len(words[a] & words[n]) / len(words[a] | words[n]) for n in near[a if mode == "own" else b]]
            want = (statistics.mean(v), statistics.pstdev(v), max(v), min(v), statistics.median(v))
            assert [got[i][f"{mode}_{k}"] for k in ("mean", "std", "max", "min", "median")] == pytest.approx(want, abs=6e-6)
    assert {r["id"]: r.own_max for r in graph.neighbour_jaccard_own_all(spark, str(tmp_path)).collect()}[0] == 1.0


def test_pagerank_converges(spark, tmp_path):
    rng = random.Random(4)
    arcs = {(a, b) for a, b in ((rng.randrange(40), rng.randrange(30)) for _ in range(90)) if a != b} | {(k, k + 1) for k in range(50, 75)}
    spark.createDataFrame([(a, b) for a, b in sorted(arcs)], "qid1 long, qid2 long").write.parquet(f"{tmp_path}/train.parquet")
    nodes = sorted({n for p in arcs for n in p})
    out = {n: [b for a, b in arcs if a == n] for n in nodes}
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(400):
        nxt = dict.fromkeys(nodes, 0.1 / len(nodes) + 0.9 * sum(rank[n] for n in nodes if not out[n]) / len(nodes))
        for a, b in arcs:
            nxt[b] += 0.9 * rank[a] / len(out[a])
        rank = nxt
    got = {r.node: r["rank"] for r in graph.pagerank_directed_converged(spark, str(tmp_path)).collect()}
    assert got == pytest.approx(rank, rel=1e-5)
    with pytest.raises(RuntimeError):
        graph.pagerank_converged(spark.createDataFrame(sorted(arcs), "src long, dst long"), 0.9, 1e-12, 6)


@pytest.mark.parametrize("most", [0, 60, 2_000_000])
def test_pagerank_sends_on_additions(spark, monkeypatch, most):
    """Steps as tables, in one task, or both, on cycles with chains and a star; plans stay of one size and arcs that carry nothing are dropped."""
    monkeypatch.setattr(graph, "CORE_ARCS", most)
    arcs = [(1, 2), (2, 3), (3, 1), (3, 4), *((k, k + 1) for k in range(4, 20)), *((30, k) for k in range(31, 80)), (79, 1), (5, 79)]
    written, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: written.append(len(df._jdf.queryExecution().optimizedPlan().toString())) or cut(df))
    got = {r.node: r["rank"] for r in graph.pagerank_converged(spark.createDataFrame(arcs, "src long, dst long").repartition(2), 0.5).collect()}
    nodes = {n for a in arcs for n in a}
    out, x = {n: sum(a == n for a, _ in arcs) for n in nodes}, dict.fromkeys(nodes, 1.0)
    for _ in range(200):
        nxt = dict.fromkeys(nodes, 1.0)
        for a, b in arcs:
            nxt[b] += 0.5 * x[a] / out[a]
        x = nxt
    assert got == pytest.approx({n: v / sum(x.values()) for n, v in x.items()}, rel=1e-6)
    assert max(written) < 6000


def test_patterns_of_question2(spark, tmp_path):
    rows = [(i, "how do i sing", "what is it", 0) for i in range(5)] + [(9, "", "so how do i sing", 0)]
    spark.createDataFrame(rows, "id long, question1 string, question2 string, is_duplicate int").write.parquet(f"{tmp_path}/train.parquet")
    got = {r["id"]: r for r in corpus.pattern_one_hot_both(spark, str(tmp_path)).collect()}
    assert got[9].on1 == "" and got[9].on2 and set(got[0].on1.split()) <= set(got[9].on2.split())
    assert got[0].on2 and not set(got[0].on1.split()) & set(got[0].on2.split())


def test_padding_keeps_all_words_of_both_questions(spark, tmp_path):
    long = " ".join(f"w{i:02}" for i in range(40))
    spark.createDataFrame([(1, long, "w01 w00", 0), (2, None, "w00", 1)], "id long, question1 string, question2 string, is_duplicate int").write.parquet(f"{tmp_path}/train.parquet")
    got = {r["id"]: r for r in encode.padded_sequences_both(spark, str(tmp_path)).collect()}
    order = ["w00", "w01", *(f"w{i:02}" for i in range(2, 40))]  # by frequency, then by the word
    number = {w: str(i + 2) for i, w in enumerate(order)}
    assert got[1].pre1.split() == got[1].post1.split() == [number[w] for w in long.split()]
    assert got[1].post2.split() == [number["w01"], number["w00"], *["0"] * 38]
    assert got[2].pre1.split() == ["0"] * 40 and got[2].pre2.split() == [*["0"] * 39, number["w00"]]


def _levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distances_of_many_pairs():
    from twinfold.operators import edits

    rng = random.Random(8)
    texts = ["", "a", *("".join(rng.choice("ab c9") for _ in range(n)) for n in (1, 63, 64, 65, 100, 127, 128, 129, 191, 192, 193, 260, *(rng.randrange(150) for _ in range(15))))]
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(texts)), np.arange(len(texts))))
    assert edits.edit_distances(edits.Texts(texts), a, b).tolist() == [_levenshtein(texts[i], texts[j]) for i, j in zip(a, b)]


def test_edit_distances_of_lanes(monkeypatch):
    """Texts that begin alike share cells: the distances are the same, whatever the strips, and so are the sums of cells of two blocks or of one."""
    from twinfold.operators import edits

    monkeypatch.setattr(edits, "LANES", 64)
    monkeypatch.setattr(edits, "STEP", 50)
    rng = random.Random(10)
    texts = sorted({"", "a", "stone", *(("", "what is ", "stone river ")[n % 3] + "".join(rng.choice("ab c9") for _ in range(rng.randrange(1 + n))) for n in range(150))})
    want = [[_levenshtein(x, y) for y in texts] for x in texts]
    for strip in (1, 8, 16):
        monkeypatch.setattr(edits, "STRIP", strip)
        number, d = edits.lane_distances(edits.Lanes(texts), texts)
        assert sorted(number) == list(range(len(texts))) and d.tolist() == [want[k] for k in number]
    c = [1 + k % 2 for k in range(len(texts))]
    cut = len(texts) // 3
    for i, j, pairs in ((0, 0, [(x, y) for y in range(len(texts)) for x in range(y)]), (0, 1, [(x, y) for x in range(cut) for y in range(cut, len(texts))])):
        own = [int(j and k >= cut) for k in range(len(texts))]
        cell = pa.table({"node": [7] * len(texts), "i": [i] * len(texts), "j": [j] * len(texts), "own": own, "s": texts, "c": c})
        got = edits.edit_of_cell(cell).to_pylist()[0]
        v = [want[x][y] / max(len(texts[x]), len(texts[y])) for x, y in pairs]
        assert got == {"node": 7, "total": pytest.approx(sum(a * c[x] * c[y] for a, (x, y) in zip(v, pairs))), "most": max(v), "least": min(v) if j else 0.0}


def test_large_nodes_are_cut_into_few_blocks(spark, tmp_path, monkeypatch):
    """A node's cells take a partition each or so, whatever their bytes, and a text isn't sent to more blocks than its node needs."""
    monkeypatch.setattr(graph_pairs, "EDIT_BLOCK", 4)
    monkeypatch.setattr(graph_pairs, "EDIT_BLOCKS", 3)
    monkeypatch.setattr(graph_pairs, "EDIT_SIDE", 20)
    rng = random.Random(11)
    texts = ["".join(rng.choice("abc") for _ in range(9)) for _ in range(50)]
    spark.createDataFrame([(k, 1, 100 + k, "first text", x) for k, x in enumerate(texts)], "id long, qid1 long, qid2 long, question1 string, question2 string").write.parquet(f"{tmp_path}/train.parquet")
    seen, cut = [], graph_pairs.cut
    monkeypatch.setattr(graph_pairs, "cut", lambda df: seen.append(cut(df)) or seen[-1])
    out = graph_pairs.neighbour_edit_self(spark, str(tmp_path))
    v = [_levenshtein(x, y) / 9 for k, x in enumerate(texts) for y in texts[:k]]
    assert {(r.n, r.self_mean) for r in out.collect()} == {(1225, round(sum(v) / 1225, 7))}
    assert [r.blocks for t in seen if "blocks" in t.columns for r in t.collect()] == [3]
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("block", [1024, 8])
def test_edits_of_all_neighbours(spark, tmp_path, monkeypatch, block):
    """25 neighbours, equal texts among them: no number of neighbours is left out, in one task or in cells."""
    monkeypatch.setattr(graph_pairs, "EDIT_BLOCK", block)
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["stone", "river", "cloud", "paper", "green"]) for _ in range(1 + k % 4)) for k in range(25)]
    spark.createDataFrame([(k, 1, 100 + k, "first text", x) for k, x in enumerate(texts)] + [(90, 1, 100, "first text", texts[0]), (91, 300, 301, "lonely", "other")], "id long, qid1 long, qid2 long, question1 string, question2 string").write.parquet(f"{tmp_path}/train.parquet")
    got = {r["id"]: r for r in graph_pairs.neighbour_edit_self(spark, str(tmp_path)).collect()}
    v = [_levenshtein(x, y) / max(len(x), len(y)) for k, x in enumerate(texts) for y in texts[:k]]
    assert set(got) == {*range(25), 90}
    for r in got.values():
        assert r.n == 300 and [r.self_mean, r.self_max, r.self_min] == pytest.approx([sum(v) / 300, max(v), min(v)], abs=1e-6)


def test_keyword_sets_are_compared_once(spark, tmp_path, monkeypatch):
    """Three components with equal keywords: the first is the topic, one set is written, and no table has a pair's words again with each word."""
    rows = [(10 * c + k, 10 * c + k, 10 * c + k + 1, "red stone", "red stone", 1) for c in (1, 2, 3) for k in (0, 1)] + [(90, 90, 91, "blue sky", "green sky", 0)]
    spark.createDataFrame(rows, "id long, qid1 long, qid2 long, question1 string, question2 string, is_duplicate int").write.parquet(f"{tmp_path}/train.parquet")
    written, cut = [], graph_pairs.cut
    monkeypatch.setattr(graph_pairs, "cut", lambda df: written.append(cut(df)) or written[-1])
    got = {r["id"]: r.topic for r in graph_pairs.keyword_topics(spark, str(tmp_path)).collect()}
    assert set(got.values()) == {"red_stone"} and len(got) == 7
    assert not any({"both", "w"} <= set(t.columns) for t in written)
    assert [[r.root for r in t.collect()] for t in written if "ws" in t.columns] == [[10]]
