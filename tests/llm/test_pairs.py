import random
import re

import pytest
from pyspark.sql import functions as F

from twinfold.llm import copies, distinctive, groups, matching, near, overlap, queries, together

from ..conftest import SMALL

W = re.compile(r"[^\W_]+")
TRAIN = "id long, qid1 long, qid2 long, question1 string, question2 string, is_duplicate int, source string, n int, a string, k1 string"


def texts(n, seed):
    """Pairs full of copies, edits, crossed orders, split words, nulls and blanks, with one pair that a third of the rows share."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    made, out = [], []
    for _ in range(n):
        r = rng.random()
        if r < 0.33:
            q = ["What should I know before asking?", "How do I stop wasting time?"]
        elif r < 0.5 or not made:
            q = [" ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 5, 9, 12]))) for _ in "12"]
        else:
            q = list(rng.choice(made))
            for _ in range(rng.randint(0, 3)):
                k = rng.randrange(2)
                w = q[k].split()
                rng.choice([lambda: w.insert(rng.randint(0, len(w)), rng.choice(vocabulary)), lambda: w.pop() if len(w) > 1 else None, lambda: rng.shuffle(w)])()
                q[k] = " ".join(w)
        made.append(q)
        q = [x.upper() if rng.random() < 0.2 else x + " !?" if rng.random() < 0.2 else x.replace(" ", "") if rng.random() < 0.05 else x for x in q]
        if rng.random() < 0.3:
            q.reverse()
        if rng.random() < 0.06:
            q[rng.randrange(2)] = rng.choice([None, "", " ", "??"])
        out.append(q)
    return out


def train_rows(n, seed, first=0):
    rng = random.Random(seed + 1)
    qids = {}
    qid = lambda t: qids.setdefault(t, len(qids))
    return [(first + i, qid(a), qid(b), a, b, rng.choice([0, 0, 0, 1, None]), None, 1, "x", "y") for i, (a, b) in enumerate(texts(n, seed))]


def known(rows):
    out = {}
    for r in rows:
        x, y = (W.findall((t or "").lower()) for t in r[3:5])
        if x and y:
            out[r[0]] = (set(x), set(y), "".join(x), "".join(y))
    return out


def match(x, y):
    def near_by(a, b):
        return 10 * len(a & b) >= 7 * len(a | b)

    return (x[2:] in (y[2:], y[:1:-1])) or (near_by(x[0], y[0]) and near_by(x[1], y[1])) or (near_by(x[0], y[1]) and near_by(x[1], y[0]))


@pytest.mark.parametrize("split_above", [4000, 3])
def test_matching_pairs(spark, split_above):
    rows = train_rows(250, 4)
    k = known(rows)
    want = {(a, b) for a in k for b in k if a < b and match(k[a], k[b])}
    got = near.matching_pairs(spark.createDataFrame(rows, TRAIN), split_above=split_above).collect()
    assert len(got) == len(want) and {(r.id_a, r.id_b) for r in got} == want


@pytest.mark.parametrize("split_above", [4000, 3])
def test_overlaps(spark, split_above):
    a, b = train_rows(200, 6), train_rows(150, 6, 10_000)
    ka, kb = known(a), known(b)
    want = {(x, y) for x in ka for y in kb if match(ka[x], kb[y])}
    test = spark.createDataFrame(b, TRAIN).withColumnRenamed("id", "test_id")
    got = overlap.overlaps(spark.createDataFrame(a, TRAIN), test, split_above=split_above).collect()
    assert len(got) == len(want) and {(r.id, r.test_id) for r in got} == want


def test_long_questions(spark):
    rng = random.Random(2)
    base = [f"t{i}" for i in range(400)]
    rows = []
    for i in range(4):
        w = base[:]
        for _ in range(30 * i):
            w[rng.randrange(400)] = f"u{rng.random()}"
        rows.append((i, i, 10 + i, " ".join(w), "short one here", 0, None, 1, "x", "y"))
    k = known(rows)
    want = {(a, b) for a in k for b in k if a < b and match(k[a], k[b])}
    assert want and {tuple(r) for r in near.matching_pairs(spark.createDataFrame(rows, TRAIN)).collect()} == want


def test_classes(spark):
    rows = train_rows(120, 8)
    k = known(rows)
    form = {i: tuple(sorted(" ".join(W.findall(t.lower())) for t in r[3:5])) for r in rows for i in [r[0]] if i in k}
    size, first = {}, {}
    for i, f in sorted(form.items()):
        size[f] = size.get(f, 0) + 1
        first.setdefault(f, i)
    links = {f: sum(g != f and match(k[first[f]], k[first[g]]) for g in first) for f in first}
    got = near.class_links(spark.createDataFrame(rows, TRAIN)).collect()
    assert {r.id: (r.class_id, r.n_copies, r.n_links) for r in got} == {i: (first[f], size[f], links[f]) for i, f in form.items()} and len(got) == len(form)


def test_hot_classes_are_split(spark, monkeypatch):
    """A class with a third of the rows, and one with very many links, in parts."""
    monkeypatch.setattr(matching, "HEAVY_SHARE", 1e-9)
    real = max
    monkeypatch.setattr(matching, "max", lambda *x: real(*(5.0 if v == 1000.0 else v for v in x)), raising=False)
    rows = train_rows(200, 4)
    k = known(rows)
    want = sorted((a, b) for a in k for b in k if a < b and match(k[a], k[b]))
    assert sorted((r.id_a, r.id_b) for r in near.matching_pairs(spark.createDataFrame(rows, TRAIN)).collect()) == want
    m = spark.createDataFrame([(1, i, 50) for i in range(50)] + [(2, i, 2) for i in (60, 61)], "cid long, id long, n long")
    got = sorted((r.x, r.y) for r in matching.within(m, 7).collect())
    assert got == [(a, b) for a in range(50) for b in range(a + 1, 50)] + [(60, 61)]


def test_estimate_decides(spark):
    """Pairs that share a band and pass the signatures, but whose sketches are too different, go no further."""
    import numpy as np

    rng = random.Random(3)
    made = []
    for i in range(150):
        w = [f"w{rng.randrange(60)}" for _ in range(12)]
        made += [(2 * i, " ".join(w), "a fixed second question"), (2 * i + 1, " ".join(w[:8] + [f"w{rng.randrange(60)}" for _ in range(4)]), "a fixed second question")]
    df = spark.createDataFrame(made, "id long, question1 string, question2 string")
    _, reps = matching.prepared(df, "id")
    sets = matching.with_hashes(reps)
    keys = matching.band_keys(sets, matching.rarity(sets, 1), 4000, near.registers)
    texts = matching.with_texts(near.cut(matching.candidates(keys, keys, True)), reps, reps)
    kept = near.estimated(texts)
    exact = matching.confirmed(texts)
    assert exact.count() == matching.confirmed(kept).count() <= kept.count() < texts.count()
    # shadowed words widen the margin: with few buckets estimates alone would lose pairs, with their margins they don't
    h = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 30)
    h[:3] = (h[:3].view(np.uint64) & np.uint64((1 << 48) - 1)).view(np.int64)  # three words in bucket 0
    x, y = near.sketches(h, np.array([30])), near.sketches(np.r_[h[1:], h[:1]], np.array([30]))
    assert x[1][0] == 28 and x[2][0] == 2 and len(x[0]) == 28
    estimate, margin = near.jaccard_estimate(x, y)
    assert abs(estimate[0] - 1) < 1e-6 and margin[0] >= 4 / 28
    z = near.sketches(np.r_[h[2:], np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 10)], np.array([38]))
    estimate, margin = near.jaccard_estimate(x, z)
    assert estimate[0] <= 28 / 38 + 0.03 and estimate[0] + margin[0] >= 28 / 40


def test_empty_tables(spark):
    none = spark.createDataFrame([], TRAIN)
    some = spark.createDataFrame(train_rows(20, 1), TRAIN)
    blank = spark.createDataFrame([(1, 1, 2, None, "", 1, None, 1, "x", "y")], TRAIN)
    for df in (none, blank):
        assert near.matching_pairs(df).count() == 0
        assert overlap.overlaps(df, some.withColumnRenamed("id", "test_id")).count() == 0
        assert copies.copies(df).count() == 0
        assert groups.question_groups(df).count() == 0
        assert together.pair_surprise(df).count() == 0
        assert distinctive.scores(df).count() == 0


def test_copies_and_their_heavy_group(spark):
    rows = train_rows(3000, 9)
    sets = {}
    for i, v in known(rows).items():
        sets.setdefault(tuple(sorted(v[2:])), []).append(i)
    want = {(min(s), i) for s in sets.values() for i in s if i != min(s)}
    got = copies.copies(spark.createDataFrame(rows, TRAIN).repartition(9)).collect()
    assert len(got) == len(want) and {(r.keep_id, r.id) for r in got} == want
    assert {r.keep_id: r.n_copies for r in got} == {min(s): len(s) for s in sets.values() if len(s) > 1}


@pytest.mark.parametrize("per_task", [2_000_000, 25])
def test_components(spark, per_task):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(90)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    df = spark.createDataFrame([*edges, (None, 1), (2, 2)], "a long, b long").repartition(5)
    got = {r.node: r.root for r in groups.components(df, per_task).collect()}
    assert got == {x: find(x) for x in root if find(x) != x or any(find(y) == x and y != x for y in list(root))}


@pytest.mark.parametrize("kind", ["chain", "star"])
def test_forests_merge_in_few_rounds(spark, kind):
    """Far more edges than a task may hold, none of them merged by small partitions: every round takes off a good part of them."""
    rng = random.Random(4)
    n, per_task = 800, 150
    edges = {"chain": [(i, i + 1) for i in range(n)], "star": [(n // 2, i) for i in range(n) if i != n // 2]}[kind]
    rng.shuffle(edges)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    try:
        sizes = []
        got = groups.components(spark.createDataFrame(edges, "a long, b long").repartition(6), per_task, sizes).collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert {r.node: r.root for r in got} == dict.fromkeys({x for e in edges for x in e}, 0) and len(got) == len({x for e in edges for x in e})
    assert all(b <= 0.75 * a for a, b in zip(sizes, sizes[1:])) and 2 <= len(sizes) <= 8


def test_terms(spark):
    rows = [(1, "a a b", "b c"), (2, None, "a"), (3, "", None), (4, "z", "Z z")]
    got = {(r.id, r.term): r for r in distinctive.scores(spark.createDataFrame(rows, "id long, question1 string, question2 string")).collect()}
    assert set(got) == {(1, "a"), (1, "b"), (1, "c"), (2, "a"), (4, "z")}
    assert got[1, "a"].n_rows == 2 and not got[1, "a"].shared and got[1, "b"].shared and got[4, "z"].shared
    assert got[1, "c"].score > 0 and got[1, "b"].score > 0


def test_pairs_of_words(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(" ".join(rng.choices("abcdefgh", k=3)) + " x" * (i % 3 == 0), " ".join(rng.choices("abcdefgh", k=3)) + " y" * (i % 3 == 0)) for i in range(300)] + [(None, "a"), ("", "a b")]
    want, single, n = {}, {}, 0
    for q in rows:
        if None in q:
            continue
        n += 1
        x, y = (set(t.split()) for t in q)
        for w in x | y:
            single[w] = single.get(w, 0) + 1
        for p in {tuple(sorted((u, v))) for u in x for v in y if u != v}:
            want[p] = want.get(p, 0) + 1
    df = spark.createDataFrame(rows, "question1 string, question2 string")
    seen = []
    for size in (200_000, 3):
        monkeypatch.setattr(together, "SLICE", size)
        monkeypatch.setattr(together, "HELD", 50)
        got = together.pair_surprise(df).collect()
        assert {(r.term_a, r.term_b): (r.n_ab, r.n_a, r.n_b, r.n) for r in got} == {p: (c, single[p[0]], single[p[1]], n) for p, c in want.items() if c >= 6}
        assert len({(r.term_a, r.term_b) for r in got}) == len(got)
        seen.append(sorted((r.term_a, r.term_b, r.n_ab, round(r.expected, 9), round(r.p_value, 12)) for r in got))
        assert min(got, key=lambda r: r.p_value)[:2] == ("x", "y")
        assert all(0 <= r.p_value <= 1 and r.p_value <= r.q_value + 1e-12 for r in got)
    assert seen[0] == seen[1]


def test_rare_pairs_of_words_are_kept(spark, tmp_path):
    rng = random.Random(6)
    rows = [(" ".join(rng.choices("abcdefgh", k=3)), " ".join(rng.choices("abcdefgh", k=3)), 1) for _ in range(400)] + [("rare", "thing", 1)] * 3
    spark.createDataFrame(rows, "question1 string, question2 string, is_duplicate int").write.parquet(f"{tmp_path}/train.parquet")
    want = {}
    for a, b, _ in rows:
        for p in {tuple(sorted((u, v))) for u in a.split() for v in b.split() if u != v}:
            want[p] = want.get(p, 0) + 1
    got = {(r.term_a, r.term_b): r for r in together.p4_pairs(spark, str(tmp_path)).collect()}
    assert {k: r.n_ab for k, r in got.items()} == want
    assert got["rare", "thing"].q_value < 0.01
    assert got["rare", "thing"].q_value >= got["rare", "thing"].p_value * 45  # ten words have 45 pairs


def test_nested_records(spark):
    kind = "id long, r struct<name:string,tags:array<string>,m:map<string,struct<x:int,y:string>>>, z string"
    rows = [
        (1, ("Ann Lee", ["a b", "C"], {"k": (1, "u"), "l": (2, None)}), "q"),
        (2, ("ann-lee!", ["A  B", "c"], {"L": (2, ""), "K": (1, "U ")}), "Q?"),  # case, blanks, punctuation, order of a map
        (3, ("Ann Lee", ["C", "a b"], {"k": (1, "u"), "l": (2, None)}), "q"),  # an array keeps its order
        (4, ("Ann Lee", ["a bC"], {"k": (1, "u"), "l": (2, None)}), "q"),
        (5, None, None),
        (6, (None, [], {}), " "),
    ]
    df = spark.createDataFrame(rows, kind)
    got = {r.keep_id: r.n_copies for r in copies.nested_collapsed(df).collect()}
    assert got == {1: 2, 3: 1, 4: 1, 5: 2}
    turned = df.select("id", "z", F.struct(F.col("r.m").alias("M"), F.col("r.tags").alias("tags"), F.col("r.name").alias("NAME")).alias("R"))
    both = copies.nested_collapsed(df).select("root").union(copies.nested_collapsed(turned).select("root"))
    assert both.distinct().count() == 4  # the order and the case of field names don't matter
    assert copies.nested_collapsed(df.limit(0)).count() == 0


def test_false_discoveries_under_the_null(spark):
    """Words drawn independently: next to no pair is surprising, however many are tested."""
    rng = random.Random(12)
    words_, weights = [f"w{i}" for i in range(300)], [1 / (i + 3) for i in range(300)]
    rows = [tuple(" ".join(rng.choices(words_, weights, k=rng.randint(2, 9))) for _ in "12") for _ in range(1500)]
    got = together.pair_surprise(spark.createDataFrame(rows, "question1 string, question2 string"), least=1, share=0)
    n, found = got.agg(F.count("*"), F.sum((F.col("q_value") <= 0.1).cast("int"))).first()
    assert n > 10_000 and found <= 2
    with pytest.warns(UserWarning):
        import numpy as np

        together.fit(np.array([1.0, 30.0]), np.array([50.0, 2.0]), np.array([1.0, 9.0]), np.array([40.0, 8.0]), 1)


def test_null_keeps_frequencies_and_sizes():
    import numpy as np

    f, k, s, n = np.array([1.0, 5.0, 40.0]), np.array([30.0, 6.0, 1.0]), np.array([1.0, 2.0, 4.0]), np.array([20.0, 25.0, 7.5])
    n[2] = (f @ k - s[:2] @ n[:2]) / 4
    x, y = together.fit(f, k, s, n, 5000)
    p = np.outer(x, y) / (1 + np.outer(x, y))
    assert np.allclose(p @ n, f, rtol=1e-4) and np.allclose(k @ p, s, rtol=1e-4)


def test_tail_against_exact():
    import numpy as np

    p, numbers = np.array([[0.02, 0.3]]), np.array([40.0, 25.0])
    exact = np.array([1.0])
    for q, n in zip(p[0], numbers):
        for _ in range(int(n)):
            exact = np.convolve(exact, [1 - q, q])
    for seen in (11, 13, 16):
        _, tail = together.upper_tail(np.array([float(seen)]), p, numbers)
        assert abs(tail[0] / exact[seen:].sum() - 1) < 0.05


def test_signatures_bound_and_registers():
    import numpy as np

    h = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 5000)
    r = near.registers(h)
    assert len(np.unique(r)) > 4990 and (near.registers(h) == r).all()
    assert near.registers(np.array([0])).shape == (1,)
    assert matching.signatures(np.array([3, 61]), np.array([0, 1]), np.array([1, 0, 1]))[1] == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(same, name):
    same(queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SMALL).count() > 0


def test_report(spark):
    r = overlap.p1_report(spark, SMALL)
    assert r.agg(F.sum("n_pairs")).first()[0] == overlap.p1_found(spark, SMALL).count()


def test_more_words_than_the_filter_holds(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(matching, "BLOCK_BITS", 16)
    monkeypatch.setattr(matching, "BLOCK_CELLS", 2)
    rows = train_rows(150, 7)
    k = known(rows)
    want = sorted((a, b) for a in k for b in k if a < b and match(k[a], k[b]))
    assert sorted((r.id_a, r.id_b) for r in near.matching_pairs(spark.createDataFrame(rows, TRAIN)).collect()) == want
    assert matching.Rarity(np.zeros((2, 4), np.uint8), 16).levels(np.arange(9)).tolist() == [1] * 9


def test_filter_holds_all_shared_words(spark):
    import numpy as np

    sets = spark.createDataFrame([(1, ["a", "b", "c"], ["c", "d"]), (2, ["b", "x"], ["y"]), (3, ["c"], ["z", "b"])], "cid long, t1 array<string>, t2 array<string>")
    sets = sets.select("cid", *(F.transform(t, lambda w: F.xxhash64(w)).alias(h) for t, h in (("t1", "h1"), ("t2", "h2"))))
    of = {r.w: r.h for r in spark.createDataFrame([(w,) for w in "abcdxyz"], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    for blocks in (1, 8):
        got = dict(zip(of, matching.rarity(sets, blocks).levels(np.array(list(of.values()), np.int64)).tolist()))
        assert got == {"a": 1, "b": 3, "c": 2, "d": 1, "x": 1, "y": 1, "z": 1}
    assert [matching.n_blocks(n) for n in (0, 1, 100_000, 10**7, 10**12)] == [1, 1, 8, 1024, 2048]
