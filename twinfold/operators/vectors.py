"""Vector distances and centroids, TF-IDF rows, and fuzzy text similarities that have no built-in."""

from __future__ import annotations

import difflib
import lzma
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.operators.blocks import compared
from twinfold.operators.corpus import heavy_words
from twinfold.operators.pairs import PAIR_SQL, pair_rows
from twinfold.operators.skew import salted_join

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _sum(e: str) -> str:
    """Sum over z of zip_with(x, y, (s, t) -> e)."""
    return f"aggregate(zip_with(x, y, (s, t) -> CAST({e} AS DOUBLE)), 0D, (m, z) -> m + z)"


def _list_sum(e: str) -> str:
    return f"list_sum(list_transform(range(1, len(x) + 1), lambda i: CAST({re.sub(r'\bt\b', 'y[i]', re.sub(r'\bs\b', 'x[i]', e))} AS DOUBLE)))"


DISTANCES = {
    "cosine": lambda f: f"1 - {f('s * t')} / sqrt({f('s * s')} * {f('t * t')})",
    "cityblock": lambda f: f("abs(s - t)"),
    "euclidean": lambda f: f"sqrt({f('(s - t) * (s - t)')})",
    "minkowski3": lambda f: f"power({f('power(abs(s - t), 3)')}, 1e0 / 3)",
    "canberra": lambda f: f("CASE WHEN abs(s) + abs(t) > 0 THEN abs(s - t) / (abs(s) + abs(t)) ELSE 0 END"),
    "braycurtis": lambda f: f"{f('abs(s - t)')} / {f('abs(s + t)')}",
    "rmse": lambda f: f"sqrt({f('(s - t) * (s - t)')} / 64)",
}
_DOUBLES = "list_transform({}, lambda v: CAST(v AS DOUBLE))"


@query("WITH v AS (SELECT a.vec_id, " + _DOUBLES.format("a.embedding") + " AS x, " + _DOUBLES.format("b.embedding") + " AS y FROM embeddings AS a JOIN embeddings AS b ON b.vec_id = a.vec_id + 1) SELECT vec_id, " + ", ".join(f"round({e(_list_sum)}, 5) AS {n}" for n, e in DISTANCES.items()) + " FROM v")
def vector_distances(spark: SparkSession, d: str) -> DataFrame:
    """Seven distances between vectors of consecutive ids; an equi-join on the id."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    v = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")
    return v.select("vec_id", *(F.round(F.expr(f(_sum)), 5).alias(n) for n, f in DISTANCES.items()))


@query("WITH x AS (SELECT label, unnest(embedding) AS v, unnest(range(0, len(embedding))) AS pos FROM embeddings) SELECT label, CAST(pos AS INT) AS pos, round(avg(CAST(v AS DOUBLE)), 6) AS centre, count(*) AS n FROM x GROUP BY 1, 2")
def label_centroids(spark: SparkSession, d: str) -> DataFrame:
    """Mean vector of every label, one row per component."""
    x = spark.read.parquet(f"{d}/embeddings.parquet").select("label", F.posexplode("embedding").alias("pos", "v"))
    return x.groupBy("label", "pos").agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("centre"), F.count("*").alias("n"))


@query("WITH x AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), m AS (SELECT vec_id, avg(v) AS m FROM x GROUP BY 1), c AS (SELECT vec_id, avg(power(v - m, 2)) AS m2, avg(power(v - m, 3)) AS m3, avg(power(v - m, 4)) AS m4 FROM x JOIN m USING (vec_id) GROUP BY 1) SELECT vec_id, round(m3 / power(m2, 1.5), 5) AS skew, round(m4 / (m2 * m2) - 3, 5) AS kurtosis FROM c")
def vector_moments(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    e = e.withColumn("m", F.expr("aggregate(x, 0D, (s, z) -> s + z) / size(x)"))
    for k in (2, 3, 4):
        e = e.withColumn(f"m{k}", F.expr(f"aggregate(x, 0D, (s, z) -> s + power(z - m, {k})) / size(x)"))
    return e.select("vec_id", F.round(F.expr("m3 / power(m2, 1.5D)"), 5).alias("skew"), F.round(F.expr("m4 / (m2 * m2) - 3"), 5).alias("kurtosis"))


def tfidf_rows(df: DataFrame) -> DataFrame:
    """(id, w, tf1, tf2, idf): words of a pair with their counts in both questions and ln((1 + n) / (1 + df)) + 1 over all questions."""
    w = df.select("id", F.explode(F.array_distinct(F.concat("a", "b"))).alias("w"), "a", "b")
    t = w.select("id", "w", *((F.size(c) - F.size(F.array_remove(c, F.col("w")))).alias(k) for c, k in (("a", "tf1"), ("b", "tf2"))))
    n = df.count()
    freq = t.groupBy("w").agg(F.sum((F.col("tf1") > 0).cast("int") + (F.col("tf2") > 0).cast("int")).alias("freq"))
    return salted_join(t, freq, ["w"], heavy_words(freq, n), ["id"]).withColumn("idf", F.log((1.0 + 2 * n) / (1 + F.col("freq"))) + 1)


@query(f"""WITH {PAIR_SQL}, s AS (SELECT id, 1 AS side, unnest(a) AS w FROM p UNION ALL SELECT id, 2, unnest(b) FROM p), t AS (SELECT id, w, sum(CAST(side = 1 AS INT)) AS tf1, sum(CAST(side = 2 AS INT)) AS tf2 FROM s GROUP BY 1, 2),
f AS (SELECT w, ln((1.0 + 2 * (SELECT count(*) FROM p)) / (1 + sum(CAST(tf1 > 0 AS INT) + CAST(tf2 > 0 AS INT)))) + 1 AS idf FROM t GROUP BY w)
SELECT id, round(CASE WHEN sum(tf1 * tf1 * idf * idf) > 0 AND sum(tf2 * tf2 * idf * idf) > 0 THEN sum(tf1 * tf2 * idf * idf) / sqrt(sum(tf1 * tf1 * idf * idf) * sum(tf2 * tf2 * idf * idf)) ELSE CAST(0 AS DOUBLE) END, 7) AS cosine FROM t JOIN f USING (w) GROUP BY id""")
def tfidf_cosine(spark: SparkSession, d: str) -> DataFrame:
    t = tfidf_rows(pair_rows(spark, d))
    v = {k: F.sum(F.col(x) * F.col(y) * F.col("idf") * F.col("idf")).alias(k) for k, x, y in (("xy", "tf1", "tf2"), ("xx", "tf1", "tf1"), ("yy", "tf2", "tf2"))}
    g = t.groupBy("id").agg(*v.values())
    return g.select("id", F.round(F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))).otherwise(0.0), 7).alias("cosine"))


def _ratio(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() if a and b else 0.0


def _partial(a: str, b: str) -> float:
    """Best ratio of the shorter text with a part of the longer one of its length, tried at every matching block."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    if not a:
        return 0.0
    best, part = 0.0, difflib.SequenceMatcher(None, "", a, autojunk=False)
    for at in {max(0, m.b - m.a) for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()}:
        part.set_seq1(b[at : at + len(a)])
        if part.quick_ratio() > best:
            best = max(best, part.ratio())
    return best


def _common_substring(a: str, b: str) -> int:
    """Length of the longest common substring, by dynamic programming over numpy rows."""
    if not a or not b:
        return 0
    x, y = np.frombuffer(a.encode("utf-32-le"), np.uint32), np.frombuffer(b.encode("utf-32-le"), np.uint32)
    row, best = np.zeros(len(y) + 1, np.int32), 0
    for c in x:
        nxt = np.zeros_like(row)
        nxt[1:] = np.where(y == c, row[:-1] + 1, 0)
        row, best = nxt, max(best, int(nxt.max()))
    return best


def _bleu(a: list, b: list, n: int) -> float:
    """Modified n-gram precision of a against b, geometric mean up to n, times the brevity penalty."""
    from collections import Counter

    if not len(a) or not len(b):
        return 0.0
    total = 0.0
    for k in range(1, n + 1):
        x, y = (Counter(tuple(t[i : i + k]) for i in range(len(t) - k + 1)) for t in (list(a), list(b)))
        hit, every = sum(min(v, y[g]) for g, v in x.items()), sum(x.values())
        if not hit or not every:
            return 0.0
        total += math.log(hit / every)
    return math.exp(total / n) * min(1.0, math.exp(1 - len(b) / len(a)))


_ALNUM = re.compile(r"[^\W_]+")


def _plain(t: str) -> str:
    """Letters and digits in lower case, single blanks."""
    return " ".join(_ALNUM.findall(t.lower()))


def fuzzy_ratios(s: str, t: str) -> tuple[float, float, float, float]:
    """Quick ratio, partial ratios of sorted tokens and of token sets, and the weighted ratio of two texts, from 0 to 1.

    The weighted ratio is the best of the plain ratio and of the others, these taken down a little; where one text is much longer,
    partial ratios take their place, taken down more.
    """
    x, y = _plain(s), _plain(t)
    if not x or not y:
        return 0.0, 0.0, 0.0, 0.0
    quick = _ratio(x, y)
    a, b = x.split(), y.split()
    xs, ys = " ".join(sorted(a)), " ".join(sorted(b))
    both, only_a, only_b = sorted(set(a) & set(b)), sorted(set(a) - set(b)), sorted(set(b) - set(a))
    base, one, two = " ".join(both), " ".join(both + only_a), " ".join(both + only_b)
    part_sort, part_set = _partial(xs, ys), max(_partial(base, one), _partial(base, two), _partial(one, two))
    times = max(len(x), len(y)) / min(len(x), len(y))
    if times < 1.5:
        weighted = max(quick, 0.95 * _ratio(xs, ys), 0.95 * max(_ratio(base, one), _ratio(base, two), _ratio(one, two)))
    else:
        less = 0.9 if times <= 8 else 0.6
        weighted = max(quick, less * _partial(x, y), 0.95 * less * part_sort, 0.95 * less * part_set)
    return quick, part_sort, part_set, weighted


_LZMA = [{"id": lzma.FILTER_LZMA2, "preset": 0, "dict_size": 1 << 12}]


def _packed_distance(a: str, b: str) -> float:
    size = lambda t: len(lzma.compress(t.encode(), lzma.FORMAT_RAW, filters=_LZMA)) or 1
    x, y = size(a), size(b)
    return (size(a + b) - min(x, y)) / max(x, y)


def _threes(tokens: list) -> list[str]:
    """Three words at a time; shorter lists stay."""
    return [" ".join(tokens[i : i + 3]) for i in range(len(tokens) - 2)] or list(tokens)


FUZZY = "id long, ratio double, partial_ratio double, token_sort_ratio double, token_set_ratio double, common_substring int, bleu1 double, bleu2 double, packed_distance double, simhash_distance int, simhash3_distance int, q_ratio double, partial_token_sort_ratio double, partial_token_set_ratio double, w_ratio double, common_substring_ratio double"


def _sorted_sides(a: list, b: list) -> tuple[str, str, str]:
    """Words of both, and these with the other words of each, in their order."""
    x, y = set(a), set(b)
    both = sorted(x & y)
    return " ".join(both), " ".join(both + sorted(x - y)), " ".join(both + sorted(y - x))


def _bleus(a: list, b: list) -> tuple[float, float]:
    """``_bleu`` of single words, and of words and pairs of them."""
    if not len(a) or not len(b):
        return 0.0, 0.0
    less, total, out = min(1.0, math.exp(1 - len(b) / len(a))), 0.0, [0.0, 0.0]
    for k, (x, y) in enumerate(((a, b), (list(zip(a, a[1:])), list(zip(b, b[1:]))))):
        own = set(x)
        if len(own) == len(x):
            hit = len(own.intersection(y))
        else:
            n, m = Counter(x), Counter(y)
            hit = sum(min(v, m[g]) for g, v in n.items())
        if not hit:
            break
        total += math.log(hit / len(x))
        out[k] = math.exp(total / (k + 1)) * less
    return out[0], out[1]


def _simhashes(lists: list[list]) -> np.ndarray:
    """A row of 64 bits for every list of words: those set in more than half of its words' hashes."""
    import xxhash

    code: dict[str, int] = {}
    codes = np.array([code.setdefault(w, len(code)) for t in lists for w in t], np.int64)
    h = np.array([xxhash.xxh64_intdigest(w) for w in code], np.uint64)
    bits = ((h[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.int32)
    n = np.array([len(t) for t in lists], np.int64)
    sums = np.zeros((len(lists), 64), np.int32)
    if len(codes):
        sums[n > 0] = np.add.reduceat(bits[codes], (np.cumsum(n) - n)[n > 0])
    return sums * 2 > n[:, None]


def _packed_distances(pairs: list[tuple[str, str]]) -> list[float]:
    sizes: dict[str, int] = {}

    def size(t: str) -> int:
        if t not in sizes:
            sizes[t] = len(lzma.compress(t.encode(), lzma.FORMAT_RAW, filters=_LZMA)) or 1
        return sizes[t]

    return [(size(a + b) - min(x, y)) / max(x, y) for a, b in pairs for x, y in [(size(a), size(b))]]


class _Ratios:
    """Ratios of pairs of texts, noted first and then compared together; each pair once."""

    def __init__(self):
        self.number: dict[tuple[str, str], int] = {}
        self.partial: list[bool] = []

    def note(self, a: str, b: str, partial: bool = False) -> int:
        k = self.number.setdefault((a, b), len(self.number))
        if k == len(self.partial):
            self.partial.append(False)
        self.partial[k] |= partial
        return k

    def note_partial(self, a: str, b: str) -> int:
        return self.note(*((a, b) if len(a) <= len(b) else (b, a)), True)

    def compare(self) -> None:
        self.ratio, self.common, self.part = compared(list(self.number), self.partial)


def _of_set(base: str, one: str, two: str, noted: float) -> float:
    """Best ratio of any two; ``base`` begins both others, so it is a block as a whole."""
    return max(2.0 * len(base) / (len(base) + len(one)), 2.0 * len(base) / (len(base) + len(two)), noted) if base else noted


def fuzzy_rows(rows: list[tuple]) -> list[tuple]:
    """Rows of FUZZY for rows (id, s, t, a, b), compared together. Equal to ``_ratio``, ``_partial`` and the others pair by pair."""
    r, noted = _Ratios(), []
    for _, s, t, a, b in rows:
        base, one, two = _sorted_sides(a, b)
        x, y = _plain(s), _plain(t)
        k = [r.note(s, t), r.note_partial(s, t), r.note(" ".join(sorted(a)), " ".join(sorted(b))), r.note(one, two)]
        if x and y:
            c, d = x.split(), y.split()
            xs, ys = " ".join(sorted(c)), " ".join(sorted(d))
            sides = _sorted_sides(c, d)
            near = max(len(x), len(y)) / min(len(x), len(y)) < 1.5
            k += [r.note(x, y), r.note_partial(xs, ys), None if sides[0] else r.note_partial(*sides[1:]), near]
            k += [r.note(xs, ys), r.note(*sides[1:])] if near else [r.note_partial(x, y), None]
        else:
            sides = None
        noted.append(((base, one, two), sides, k))
    r.compare()
    hashes = [(_simhashes([f(q[3]) for q in rows]) != _simhashes([f(q[4]) for q in rows])).sum(1) for f in (list, _threes)]
    out = []
    for n, ((i, s, t, a, b), (own, sides, k), packed) in enumerate(zip(rows, noted, _packed_distances([q[1:3] for q in rows]))):
        quick = part_sort = part_set = weighted = 0.0
        if sides:
            quick, part_sort, part_set = r.ratio[k[4]], r.part[k[5]], 1.0 if sides[0] else r.part[k[6]]
            if k[7]:
                weighted = max(quick, 0.95 * r.ratio[k[8]], 0.95 * _of_set(*sides, r.ratio[k[9]]))
            else:
                x, y = _plain(s), _plain(t)
                less = 0.9 if max(len(x), len(y)) / min(len(x), len(y)) <= 8 else 0.6
                weighted = max(quick, less * r.part[k[8]], 0.95 * less * part_sort, 0.95 * less * part_set)
        common = int(r.common[k[0]])
        out.append((i, r.ratio[k[0]], r.part[k[1]], r.ratio[k[2]], _of_set(*own, r.ratio[k[3]]), common, *_bleus(a, b), packed, int(hashes[0][n]), int(hashes[1][n]), quick, part_sort, part_set, weighted, common / max(len(s), len(t), 1)))
    return out


def fuzzy(df: DataFrame) -> DataFrame:
    """Fuzzy similarities of (id, s, t, a, b): texts in lower case and their tokens, in Arrow batches."""
    schema = pa.schema([(n, {"long": pa.int64(), "int": pa.int32()}.get(k, pa.float64())) for n, k in (x.split() for x in FUZZY.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(*(b.column(n).to_pylist() for n in ("id", "s", "t", "a", "b"))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*fuzzy_rows(rows)), schema)], schema=schema)

    return df.mapInArrow(run, FUZZY)


@query()
def pair_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return fuzzy(pair_rows(spark, d).select("id", F.lower("q1").alias("s"), F.lower("q2").alias("t"), "a", "b"))


def nearest(df: DataFrame, id_col: str, vec: str, k: int = 10, every: int = 50, block: int = 20_000) -> DataFrame:
    """(query_id, id, cosine, rank): for rows whose id is divisible by ``every``, the k rows nearest by cosine; ties by id.

    Queries are taken in blocks of at most ``block`` vectors. For each block every task multiplies its rows with the
    block's matrix and keeps k rows a query; these are merged by query. Null and zero vectors are near to nothing.
    """
    from pyspark.sql import Window

    from twinfold.session import cut

    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v")).filter("v IS NOT NULL")
    queries = cut(rows.filter(F.col("id") % every == 0))
    blocks, got = max(1, -(-queries.count() // block)), None
    for n in range(blocks):
        held = queries.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == n).toPandas()
        shared = spark.sparkContext.broadcast((held["id"].to_numpy(), _unit(np.array(held["v"].tolist())) if len(held) else np.zeros((0, 1))))

        def run(batches, shared=shared):
            ids, q = shared.value
            best = None
            for pdf in batches:
                if not len(pdf) or not len(ids):
                    continue
                s = q @ _unit(np.array(pdf["v"].tolist())).T
                near = np.broadcast_to(pdf["id"].to_numpy(), s.shape)
                if best is not None:
                    s, near = np.concatenate([best[0], s], 1), np.concatenate([best[1], near], 1)
                order = np.lexsort((near, -np.round(s, 12)), axis=1)[:, : k + 1]
                best = np.take_along_axis(s, order, 1), np.take_along_axis(near, order, 1)
            if best is not None:
                yield pd.DataFrame({"query_id": np.repeat(ids, best[0].shape[1]), "id": best[1].ravel(), "cosine": best[0].ravel()})

        part = rows.mapInPandas(run, "query_id long, id long, cosine double").filter("query_id != id AND NOT isnan(cosine)")
        got = part if got is None else got.union(part)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("cosine", 12)), "id")
    return got.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.full_like(x, np.nan), where=n > 0)


@query("WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda z: CAST(z AS DOUBLE)) AS v FROM embeddings), c AS (SELECT q.id AS query_id, v.id, list_cosine_similarity(q.v, v.v) AS cosine FROM v AS q JOIN v ON q.id % 50 = 0 AND q.id <> v.id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 12) DESC, id) AS rank FROM c) SELECT query_id, id, round(cosine, 6) AS cosine, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10")
def nearest_vectors(spark: SparkSession, d: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{d}/embeddings.parquet"), "vec_id", "embedding").withColumn("cosine", F.round("cosine", 6))


def weighted_centroids(tokens: DataFrame, table: DataFrame, heavy: DataFrame) -> DataFrame:
    """(id, side, centre, coverage): mean of the word vectors of a question, weighted by ``weight``; coverage is the share of tokens with a vector.

    ``tokens``: (id, side, w, weight); ``table``: (w, vec). Components are summed by position in the JVM.
    """
    j = salted_join(tokens, table, ["w"], heavy, ["id"], how="left")
    n = j.groupBy("id", "side").agg(F.count("*").alias("n"), F.count("vec").alias("known"))
    parts = j.filter("vec IS NOT NULL").select("id", "side", "weight", F.posexplode("vec").alias("pos", "x"))
    sums = parts.groupBy("id", "side", "pos").agg(F.sum(F.col("x") * F.col("weight")).alias("s"))
    lists = sums.groupBy("id", "side").agg(F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("s"))  # as long as a vector
    got = n.join(lists, ["id", "side"], "left")
    return got.select("id", "side", F.transform("s", lambda x: x["s"] / F.col("n")).alias("centre"), (F.col("known") / F.col("n")).alias("coverage"))
