import random

import pytest
from pyspark.sql import functions as F

from twinfold.llm import bpe, language, packing

from ..conftest import SMALL


def test_encoding_is_the_library_s(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.default_vocabulary())
    t.encode_special_tokens = True
    rng = random.Random(1)
    letters = ["etaoin shrdlu", "a", "=-_ ", "ab\n\t é日本語😀́я", "0123456789,. ", "<|endoftext|>'s "]
    made = ["".join(rng.choice(rng.choice(letters)) for _ in range(rng.randint(0, 80))) for _ in range(2000)]
    made += ["a" * k for k in range(70)] + [" " * k + "x" for k in range(70)] + ["", None, "<|endoftext|>", "word " * 20_000, "z" * 3000, "\x00�"]
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = {r.doc_id: r.ids for r in bpe.encoded(df).collect()}
    want = [x.ids for x in t.encode_batch([x or "" for x in made], add_special_tokens=False)]
    assert [got[i] for i in range(len(made))] == want
    back = {r.doc_id: r.text for r in bpe.decoded(bpe.encoded(df)).collect()}
    assert all(back[i] == (x or "") for i, x in enumerate(made))
    assert bpe.encoded(df.limit(0)).count() == 0


def check_packing(rows, capacity, sizes):
    held, docs = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        if r.size:
            held.setdefault(r.container, []).append((r.position, r.size))
        else:
            assert r.container is None and r.position is None
    for i, n in sizes.items():
        own = sorted(docs[i], key=lambda r: r.piece)
        assert sum(r.size for r in own) == (n or 0) and [r.piece for r in own] == list(range(len(own)))
        assert len(own) == 1 or (n > capacity and all(r.size == capacity for r in own[:-1]))
    assert sorted(held) == list(range(len(held)))
    for c in held.values():
        at = 0
        for position, size in sorted(c):
            assert position == at
            at += size
        assert at <= capacity
    return len(held)


@pytest.mark.parametrize("ranked", [100_000, 40])
def test_packing(spark, monkeypatch, ranked):
    monkeypatch.setattr(packing, "RANKED", ranked)
    rng = random.Random(2)
    sizes = {i: rng.choice([0, None, 7, 7, 7, 100, 101, 250, 1000, rng.randint(1, 99)]) for i in range(700)}
    df = spark.createDataFrame(list(sizes.items()), "doc_id long, n_tokens int").repartition(5)
    n = check_packing(packing.packed(df, 100).collect(), 100, sizes)
    assert n <= 1.05 * sum(v or 0 for v in sizes.values()) / 100 + 1
    assert packing.packed(df.limit(0), 100).count() == 0


def test_pattern_counts():
    h = {2048: 3, 1500: 10, 600: 4, 500: 9, 48: 100, 1: 30}
    packs = packing.patterns(h, 2048)
    placed = {}
    for count, sizes in packs:
        assert sum(sizes) <= 2048
        for s in sizes:
            placed[s] = placed.get(s, 0) + count
    assert placed == h and packing.patterns({}, 2048) == []


@pytest.fixture(scope="module")
def model(spark):
    docs, reference = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "lang_reference"))
    return language.fitted(reference, docs), language.notations(reference)


def test_scores_sum_over_segmentations(model):
    import numpy as np

    m = model[0]

    def brute(w):
        if not w:
            return np.ones(m.p.shape[1])
        return sum((m.p[m.rows[w[:k]]] * brute(w[k:]) for k in range(1, len(w) + 1) if w[:k] in m.rows), np.zeros(m.p.shape[1]))

    for w in ("cat", "schön", "日本"):
        assert np.allclose(m.scores([w])[0], np.log(brute(language._raw(w))))
    assert np.allclose(m.p.sum(0), 1)


def test_long_words_are_scored_whole(model):
    """A word of 200 bytes and more against plain sums in exact numbers; pieces of any length count."""
    from fractions import Fraction

    import numpy as np

    m = model[0]
    for w in ("donaudampfschifffahrts" * 10, "日本語の文章" * 15, "x" * 300):
        raw = language._raw(w)
        assert len(raw) > 200
        got = m.scores([w, "short"])[0]
        for lang in (0, m.p.shape[1] - 1):
            a = [Fraction(1)] + [Fraction(0)] * len(raw)
            for e in range(1, len(raw) + 1):
                for k in range(1, min(e, 130) + 1):
                    r = m.rows.get(raw[e - k : e])
                    if r is not None:
                        a[e] += a[e - k] * Fraction(float(m.p[r, lang]))
            want = _log(a[-1])
            assert abs(got[lang] - want) < 1e-9 * abs(want)
    assert max(map(len, m.rows)) > 12


def _log(x):
    """Natural logarithm of a fraction too small for a float."""
    import math

    shift = x.denominator.bit_length() - x.numerator.bit_length()
    return math.log(float(x * 2**shift)) - shift * math.log(2)


def test_confidence_is_that_of_the_judged_language():
    import numpy as np

    total = np.array([[0.0, -30.0, -40.0], [-2.0, 0.0, -40.0], [0.0, -30.0, -40.0]])
    judged = language.smoothed(total[:, :2].argmax(1), total)
    assert judged.tolist() == [0, 0, 0]  # the change costs more than the middle sentence gains
    sure = language.confidence(total, judged)
    assert sure[0] > 0.99 and abs(sure[1] - np.exp(-2) / (1 + np.exp(-2))) < 1e-9
    assert language.confidence(np.zeros((0, 3)), np.zeros(0, int)).shape == (0,)
    assert language.confidence(total, np.array([-1, 1, 0]))[0] == 0


def test_fit_raises_the_chance_of_what_it_saw(model):
    from collections import Counter

    m = language.Model(["a", "b"], language.default_vocabulary())
    seen = [Counter({"donaudampfschifffahrtsgesellschaft" * 4: 3, "das": 5}), Counter({"日本語の文章" * 9: 2, "the": 5})]
    m.fit(seen, 2)
    s = m.scores(list(seen[0]) + list(seen[1]))
    assert (s[:2, 0] > s[:2, 1] + 1).all() and (s[2:, 1] > s[2:, 0] + 1).all()


GERMAN = "Ich habe das letztes Jahr schon gefragt und niemand hat geantwortet. Das ist vielleicht bei euch anders. Wir haben dafür bezahlt und würden das nie wieder machen."
ENGLISH = "They told us that it would be ready before the winter. Nobody could tell me why. My neighbour uses it every morning and is very happy with it."


def test_languages(spark, model):
    m, known = model
    rows = [(1, ENGLISH, "en"), (2, GERMAN, "de-AT"), (3, ENGLISH + " " + GERMAN, "en"), (4, None, "en"), (5, "", None), (6, "12 34 == <b> x = f(a[3]) + 7", "en"), (7, ENGLISH + ' She said "das ist nicht mein Haus" again.', " ENGLISH "), (8, (ENGLISH + "\n") * 2000, None), (9, "Это было в прошлом году, и никто не ответил. Я не знаю почему.", "xx"), (9, "去年同じことを聞きましたが返事がありませんでした。ありがとうございます。", "jpn")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("segments", F.lit(0))
    got = sorted(language.languages(df, m).withColumn("named", language.label_language(F.col("label"), known)).collect(), key=lambda r: (r.doc_id, r.label or ""))
    langs = [(r.doc_id, r.main, sorted(x.lang for x in r.langs), r.named) for r in got]
    assert langs == [
        (1, "en", ["en"], "en"),
        (2, "de", ["de"], "de"),
        (3, langs[2][1], ["de", "en"], "en"),
        (4, None, [], "en"),
        (5, None, [], None),
        (6, None, [], "en"),
        (7, "en", ["en"], "en"),
        (8, "en", ["en"], None),
        (9, "ja", ["ja"], "ja"),
        (9, "ru", ["ru"], None),
    ]
    assert all(0 <= x.confidence <= 1 + 1e-9 for r in got for x in r.langs)
    assert language.languages(df.limit(0), m).count() == 0


def test_held_out_labels(spark, model):
    """Against labels that name a language, of documents with one language and more than a few words: nearly all agree."""
    m, known = model
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter(F.length("text") > 60)
    j = language.languages(docs, m).filter("size(langs) = 1").withColumn("named", language.label_language(F.col("label"), known)).filter("named IS NOT NULL")
    n, right = j.agg(F.count("*"), F.sum((F.col("named") == F.col("main")).cast("int"))).first()
    assert right / n > 0.93  # some labels are wrong on purpose
