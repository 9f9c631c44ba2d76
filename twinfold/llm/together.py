"""Items that appear together (problem 4): exact pair counts against a fitted bipartite configuration null.

Baskets are the two questions of a record, items their distinct words; two words occur together in a
record if one is in one question and the other in the other. The null model gives word i a chance
x_i y_s / (1 + x_i y_s) of being in a basket of size s, fitted so that expected word frequencies and basket
sizes are the observed ones. Counts are then Poisson-binomial; upper tails come from the saddle-point
approximation and are controlled for the false-discovery rate over all pairs of the words, seen together or not.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.functions.text import words
from twinfold.session import cut

#: Words held in one dictionary; larger vocabularies are counted slice against slice.
SLICE = 200_000
#: Different pairs that a task holds before it sends partial counts.
HELD = 2_000_000


def baskets(df: DataFrame, q1: str = "question1", q2: str = "question2") -> DataFrame:
    """(w1, w2): distinct words of the two questions of every record without a null question."""
    return df.filter(F.col(q1).isNotNull() & F.col(q2).isNotNull()).select(F.array_distinct(words(F.col(q1))).alias("w1"), F.array_distinct(words(F.col(q2))).alias("w2"))


def item_rows(b: DataFrame) -> DataFrame:
    """(term, n, m): records that hold the word in either question, and baskets that hold it."""
    both = F.array_intersect("w1", "w2")
    t = b.select(both.alias("both"), F.explode(F.array_distinct(F.concat("w1", "w2"))).alias("term"))
    return t.groupBy("term").agg(F.count("*").alias("n"), (F.count("*") + F.sum(F.array_contains("both", F.col("term")).cast("long"))).alias("m"))


def coarse(c, exact: int, digits: int):
    """Whole numbers as they are up to ``exact``, above it with so many significant digits: a bounded number of classes."""
    unit = F.pow(F.lit(10.0), F.floor(F.log10(F.greatest(c, F.lit(1)))) - (digits - 1))
    return F.when(c <= exact, c.cast("double")).otherwise(F.round(c / unit) * unit)


def _codes(col: pa.ListArray, index: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of the dictionary's words, ascending by row."""
    flat = col.flatten().dictionary_encode()
    of = np.array([index.get(w, -1) for w in flat.dictionary.to_pylist()] or [-1], np.int64)
    code = of[flat.indices.to_numpy()] if len(flat) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(col)), np.diff(col.offsets.to_numpy()))
    keep = code >= 0
    return row[keep], code[keep]


def _count(shared, own: bool):
    """Partial counts of a partition, (a, b, n): codes of two words and the records that hold them together.

    ``shared`` holds the words and their slices. ``own``: pairs within the one slice; else only pairs across the two.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, part = shared.value
        index = {w: i for i, w in enumerate(names)}
        k = len(names)
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out(a, b, n):
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["a", "b", "n"])

        for batch in batches:
            (r1, c1), (r2, c2) = _codes(batch.column(0), index), _codes(batch.column(1), index)
            n2 = np.bincount(r2, minlength=batch.num_rows)
            start = np.cumsum(n2) - n2
            each, at = n2[r1], 0
            total = np.cumsum(each)
            fresh = [(keys, sums)]
            while at < len(r1):
                end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + HELD, "right")))
                if end < len(r1) and r1[end - 1] == r1[end] and (cut_at := np.searchsorted(r1, r1[end])) > at:
                    end = int(cut_at)  # the pairs of a record stay together
                ia = np.repeat(np.arange(at, end), each[at:end])
                ib = np.arange(len(ia)) - np.repeat(np.cumsum(each[at:end]) - each[at:end], each[at:end]) + start[r1[ia]]
                x, y, r = c1[ia], c2[ib], r1[ia]
                keep = (x != y) if own else (part[x] != part[y])
                lo, hi, r = np.minimum(x, y)[keep], np.maximum(x, y)[keep], r[keep]
                code = lo * k + hi
                order = np.lexsort((code, r))
                code, r = code[order], r[order]
                first = np.r_[True, (code[1:] != code[:-1]) | (r[1:] != r[:-1])][: len(code)]
                fresh.append(np.unique(code[first], return_counts=True))
                at = end
            both, sums_in = np.concatenate([f[0] for f in fresh]), np.concatenate([f[1] for f in fresh])
            keys, inv = np.unique(both, return_inverse=True)
            sums = np.bincount(inv, weights=sums_in, minlength=len(keys)).astype(np.int64)
            if len(keys) > HELD:
                yield out(keys // k, keys % k, sums)
                keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(keys):
            yield out(keys // k, keys % k, sums)

    return run


def fit(frequency: np.ndarray, items: np.ndarray, sizes: np.ndarray, numbers: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """x per class of items and y per class of baskets, so that expected frequencies and sizes are as observed (to 1e-9, or after ``rounds``).

    ``items`` words are in ``frequency`` baskets each, ``numbers`` baskets hold ``sizes`` words each; equal ones have equal parameters.
    """
    n, total = numbers.sum(), max((sizes * numbers).sum(), 1)
    x, y = frequency / math.sqrt(total), sizes / math.sqrt(total)
    for _ in range(rounds):
        z = 1 / (1 + np.outer(x, y))
        x_new = np.where(frequency >= n, 1e12, frequency / np.maximum((z * (y * numbers)).sum(1), 1e-300))
        z = 1 / (1 + np.outer(x_new, y))
        y_new = np.where(sizes >= items.sum(), 1e12, sizes / np.maximum((z * (x_new * items)[:, None]).sum(0), 1e-300))
        done = np.allclose(x, x_new, rtol=1e-9) and np.allclose(y, y_new, rtol=1e-9)
        x, y = x_new, y_new
        if done:
            return x, y
    p = 1 - 1 / (1 + np.outer(x, y))
    off = np.abs(p @ numbers / np.maximum(frequency, 1e-300) - 1).max(initial=0)
    if off > 1e-3:
        warnings.warn(f"the null model isn't fitted after {rounds} rounds: a word's expected frequency is off by {off:.1e}", stacklevel=2)
    return x, y


def upper_tail(seen: np.ndarray, p: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean, and chance of ``seen`` or more, of sums of binomials: row i has numbers[j] trials of chance p[i, j].

    Lugannani-Rice with continuity correction; 1 where no more than the mean was seen.
    """
    mean = p @ numbers
    k = seen - 0.5
    tail = np.ones(len(seen))
    top = numbers.sum()
    up = (k > mean) & (mean > 0)
    if not up.any():
        return mean, tail
    q, k = p[up], np.minimum(k[up], top - 0.25)
    t = np.log(k / mean[up])
    for _ in range(60):  # Newton on a convex function, held to small steps
        e = q * np.exp(t)[:, None]
        r = e / (1 - q + e)
        slope, value = (r * (1 - r)) @ numbers, r @ numbers
        step = np.clip((value - k) / np.maximum(slope, 1e-300), -1, 1)
        t = t - step
        if np.abs(step).max() < 1e-12:
            break
    e = q * np.exp(t)[:, None]
    r = e / (1 - q + e)
    growth = np.log1p(q * np.expm1(t)[:, None]) @ numbers
    w = np.sqrt(np.maximum(2 * (t * k - growth), 1e-12))
    v = 2 * np.sinh(t / 2) * np.sqrt((r * (1 - r)) @ numbers)
    density = np.exp(-w * w / 2) / math.sqrt(2 * math.pi)
    gauss = np.array([0.5 * math.erfc(x / math.sqrt(2)) for x in w])
    tail[up] = np.clip(gauss + density * (1 / np.maximum(v, 1e-12) - 1 / w), 0, 1)
    return mean, tail


def pair_surprise(df: DataFrame, q1: str = "question1", q2: str = "question2", least: int = 6, share: float = 1 / 1000) -> DataFrame:
    """(term_a, term_b, n_ab, n_a, n_b, n, lift, expected, p_value, q_value), term_a < term_b.

    All pairs of words that occur together in at least ``least`` records and a ``share`` of the n records
    without a null question. A word of such a pair is itself in so many records, which bounds the words
    by (mean words of a record) / share; only their pairs are counted. ``least`` 1 and ``share`` 0 prune nothing.
    The q-value counts every pair of those words as a test. Records with an empty question
    count in n and hold no pair. Repeated records count each time. An empty table gives no rows.
    """
    spark = df.sparkSession
    b = baskets(df, q1, q2)
    n = b.count()
    floor = max(least, math.ceil(n * share - 1e-9))
    items = cut(item_rows(b))
    vocabulary = items.filter(F.col("n") >= floor)
    size = vocabulary.count()
    slices = max(1, -(-size // SLICE))
    null = _null(items, b) if size else None
    of_slice = F.pmod(F.xxhash64("term"), F.lit(slices))
    done = []
    for i in range(slices):
        for j in range(i, slices):
            held = sorted((r.term, r.n, r.m, r.s) for r in vocabulary.withColumn("s", of_slice).filter(F.col("s").isin(i, j)).collect())
            if held:
                done.append(_slice(spark, b, held, floor, null, i == j))
    if not n or not size:
        return spark.createDataFrame([], "term_a string, term_b string, n_ab long, n_a long, n_b long, n long, lift double, expected double, p_value double, q_value double")
    out = done[0]
    for x in done[1:]:
        out = out.union(x)
    pairs = cut(out)
    bins = pairs.groupBy(_bin(F.col("p_value")).alias("k")).count().collect()  # at most 4,097 rows
    q, rank, tests = {}, 0, size * (size - 1) // 2
    for r in sorted(bins, key=lambda r: r.k):
        rank += r["count"]
        q[r.k] = tests / rank
    least_q = 1.0
    for k in sorted(q, reverse=True):
        least_q = q[k] = min(least_q, 10 ** (k / 8) * q[k])
    table = spark.createDataFrame(list(q.items()), "k int, q_value double")
    lift = F.col("n_ab") * F.lit(float(n)) / (F.col("n_a") * F.col("n_b"))
    return pairs.withColumn("k", _bin(F.col("p_value"))).join(F.broadcast(table), "k").select("term_a", "term_b", "n_ab", "n_a", "n_b", F.lit(n).cast("long").alias("n"), lift.alias("lift"), "expected", "p_value", "q_value")


def _bin(p):
    """Eighths of a decade, rounded up, down to 1e-320: q-values are those of the bin's end, so binning makes none smaller."""
    return F.ceil(F.greatest(F.log10(F.greatest(p, F.lit(1e-320))), F.lit(-320.0)) * 8).cast("int")


def _null(items: DataFrame, b: DataFrame) -> tuple:
    """The fitted null over all words: classes of word frequencies with their x, pairs of basket sizes with their y and numbers of records.

    Frequencies above 1,000 are classed by three digits and sizes above 50 by two, so what is collected is bounded.
    """
    words_ = items.groupBy(coarse(F.col("m"), 1000, 3).alias("m")).agg(F.count("*").alias("k")).orderBy("m").collect()
    frequency, number = np.array([r.m for r in words_]), np.array([float(r.k) for r in words_])
    both = b.groupBy(*(coarse(F.size(c), 50, 2).alias(s) for c, s in (("w1", "s1"), ("w2", "s2")))).agg(F.count("*").alias("k")).orderBy("s1", "s2").collect()
    s1, s2, k = (np.array([float(r[i]) for r in both]) for i in range(3))
    sizes, inv = np.unique(np.concatenate([s1, s2]), return_inverse=True)
    x, y = fit(frequency, number, sizes, np.bincount(inv, weights=np.concatenate([k, k]), minlength=len(sizes)))
    return frequency, x, y, np.searchsorted(sizes, s1), np.searchsorted(sizes, s2), k


def _slice(spark: SparkSession, b: DataFrame, held: list[tuple[str, int, int, int]], floor: int, null: tuple, own: bool) -> DataFrame:
    names, of, baskets_of, part = ([h[i] for h in held] for i in range(4))
    of = np.array(of, np.int64)
    shared = spark.sparkContext.broadcast((names, np.array(part)))
    frequency, of_class, y, at1, at2, number = null
    near = np.searchsorted((frequency[1:] + frequency[:-1]) / 2, baskets_of)
    counted = b.mapInArrow(_count(shared, own), "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).filter(F.col("n") >= floor)
    schema = "term_a string, term_b string, n_ab long, n_a long, n_b long, expected double, p_value double"

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, _ = shared.value
        known: dict[tuple[int, int, int], tuple[float, float]] = {}  # words of equal frequency have equal chances
        for batch in batches:
            a, c, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            kinds, inv = np.unique(np.stack([np.minimum(near[a], near[c]), np.maximum(near[a], near[c]), n]), axis=1, return_inverse=True)
            kinds, inv = list(zip(*kinds.tolist())), inv.reshape(-1)
            fresh = [k for k in kinds if k not in known]
            for k in range(0, len(fresh), 500):
                u, v, m = (np.array(z) for z in zip(*fresh[k : k + 500]))
                pu, pv = (1 - 1 / (1 + np.outer(of_class[z], y)) for z in (u, v))
                p = 1 - (1 - pu[:, at1] * pv[:, at2]) * (1 - pv[:, at1] * pu[:, at2])
                known.update(zip(fresh[k : k + 500], zip(*(z.tolist() for z in upper_tail(m.astype(float), p, number)))))
            mean, tail = np.array([known[k] for k in kinds]).reshape(-1, 2)[inv].T
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in a], pa.string()), pa.array([names[i] for i in c], pa.string()), pa.array(n), pa.array(of[a]), pa.array(of[c]), pa.array(mean), pa.array(tail)], names=["term_a", "term_b", "n_ab", "n_a", "n_b", "expected", "p_value"])
            if len(known) > HELD:
                known.clear()

    return counted.mapInArrow(judge, schema)


def _duplicates(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/train.parquet").filter("is_duplicate = 1")


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of words that occur together at least once."""
    return pair_surprise(_duplicates(spark, d), least=1, share=0)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that occur together five times as often as by chance, and in a thousandth of the rows."""
    return pair_surprise(_duplicates(spark, d)).filter("n_ab >= 6 and 1000 * n_ab >= n and n_ab * n >= 5 * n_a * n_b").select("term_a", "term_b")


def p4_counts_all(spark: SparkSession, d: str) -> DataFrame:
    """The counts of all pairs."""
    return p4_pairs(spark, d).select("term_a", "term_b", "n_ab", "n_a", "n_b", "n")


_C = r"""r AS (SELECT row_number() OVER () AS k, list_distinct(regexp_extract_all(lower(question1), '[\p{L}\p{N}]+')) AS w1, list_distinct(regexp_extract_all(lower(question2), '[\p{L}\p{N}]+')) AS w2 FROM train WHERE is_duplicate = 1 AND question1 IS NOT NULL AND question2 IS NOT NULL),
n AS (SELECT count(*) AS n FROM r), x AS (SELECT k, unnest(w1) AS a FROM r), y AS (SELECT k, unnest(w2) AS b FROM r),
i AS (SELECT t, count(*) AS c FROM (SELECT k, a AS t FROM x UNION SELECT k, b FROM y) GROUP BY t),
p AS (SELECT term_a, term_b, count(*) AS n_ab FROM (SELECT DISTINCT k, least(a, b) AS term_a, greatest(a, b) AS term_b FROM x JOIN y USING (k) WHERE a <> b) GROUP BY 1, 2),
j AS (SELECT term_a, term_b, n_ab, ia.c AS n_a, ib.c AS n_b, n FROM p JOIN i AS ia ON term_a = ia.t JOIN i AS ib ON term_b = ib.t, n WHERE n_ab >= 6 AND 1000 * n_ab >= n)"""
SQL = {
    "p4_found": f"WITH {_C} SELECT term_a, term_b FROM j WHERE n_ab * n >= 5 * n_a * n_b",
    "p4_counts_all": f"WITH {_C.replace(' WHERE n_ab >= 6 AND 1000 * n_ab >= n', '')} SELECT term_a, term_b, n_ab, n_a, n_b, n FROM j",
}
QUERIES = {"p4_found": p4_found, "p4_pairs": p4_pairs, "p4_counts_all": p4_counts_all}
