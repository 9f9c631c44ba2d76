"""Word vectors of the questions of a pair: centroids, word by word similarities, neighbours' centroids.

The vectors of a vocabulary of at most VOCABULARY words are broadcast as one matrix (its bound: 200,000 rows);
questions then need no shuffle. All comparisons of a batch are made in numpy at once: the words of a batch are
multiplied with each other, and what a pair needs is looked up in the product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinfold.operators.corpus import _SIDED, sided, token_freq
from twinfold.operators.encode import VOCABULARY
from twinfold.operators.graph import NEIGHBOURS, neighbour_texts
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


_VOCAB = f"{_SIDED}, c AS (SELECT w, count(*) AS freq FROM s GROUP BY w), t AS (SELECT w, freq, row_number() OVER (ORDER BY freq DESC, w) - 1 AS idx FROM (SELECT * FROM c ORDER BY freq DESC, w LIMIT {VOCABULARY})), e0 AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS idx, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS vec FROM embeddings)"
#: w, freq, vec of the words that have a vector
_WORDS = f"{_VOCAB}, v AS (SELECT w, freq, vec FROM t JOIN e0 USING (idx))"


def word_table(spark: SparkSession, d: str) -> DataFrame:
    """(w, freq, idx, vec): the most frequent words with their numbers, and the vector of that number; null where there are fewer vectors than words."""
    freq = token_freq(sided(pair_rows(spark, d))).orderBy(F.desc("freq"), "w").limit(VOCABULARY)
    t = freq.withColumn("idx", F.row_number().over(Window.orderBy(F.desc("freq"), "w")) - 1)  # over 200,000 rows
    e = spark.read.parquet(f"{d}/embeddings.parquet").orderBy("vec_id").limit(VOCABULARY)
    e = e.select((F.row_number().over(Window.orderBy("vec_id")) - 1).alias("idx"), F.col("embedding").cast("array<double>").alias("vec"))
    return t.join(e, "idx", "left")


class Words:
    """The matrix of a vocabulary, with each word's weight."""

    def __init__(self, names: list[str], matrix: np.ndarray, weight: np.ndarray):
        self.index = {w: i for i, w in enumerate(names)}
        self.matrix, self.weight = matrix, weight
        norm = np.linalg.norm(matrix, axis=1, keepdims=True)
        self.unit = np.divide(matrix, norm, out=np.zeros_like(matrix), where=norm > 0)


def words(spark: SparkSession, table: DataFrame, n_questions: float):
    """The vectors of a word table, at most VOCABULARY rows, broadcast with the words' inverse frequencies."""
    t = table.filter("vec IS NOT NULL").select("w", "freq", "vec").toArrow()
    matrix = t["vec"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1) if t.num_rows else np.zeros((0, 1))
    weight = np.log((1 + n_questions) / (1 + t["freq"].to_numpy())) if t.num_rows else np.zeros(0)
    return spark.sparkContext.broadcast(Words(t["w"].to_pylist(), matrix, weight))


def known(col: pa.ListArray, table: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word) of the tokens with a vector, in order, and the number of all tokens per row."""
    flat = col.flatten().dictionary_encode()
    of = np.array([table.index.get(w, -1) for w in flat.dictionary.to_pylist()] or [-1], np.int64)
    code = of[flat.indices.to_numpy()] if len(flat) else np.zeros(0, np.int64)
    n = np.diff(col.offsets.to_numpy())
    row = np.repeat(np.arange(len(col)), n)
    return row[code >= 0], code[code >= 0], n


def centroids(row: np.ndarray, code: np.ndarray, n: int, table: Words, weight: np.ndarray | None = None) -> np.ndarray:
    """Sums of word vectors per row, by their weights; rows without words are 0."""
    out = np.zeros((n, table.matrix.shape[1]))
    if len(code):
        v = table.matrix[code] if weight is None else table.matrix[code] * weight[code][:, None]
        start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        out[row[start]] = np.add.reduceat(v, start)
    return out


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(-1) * (y * y).sum(-1))
    return np.divide((x * y).sum(-1), n, out=np.zeros(n.shape), where=n > 0)


CENTROIDS = "id long, coverage1 double, coverage2 double, importance double, cosine double, cosine_importance double, rmse double, rmse_importance double, idf_cosine double, idf_distance double, normed_cityblock double, normed_distance double, distinct_cosine double"


def compared(df: DataFrame, table) -> DataFrame:
    """Centroid comparisons of (id, a, b): plain, weighted by inverse frequency over the number of tokens, of length 1, and of the words of one question only.

    Tokens without a vector count in the lengths and in nothing else. Comparisons with a question without vectors are 0, distances those to the zero vector.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        for whole in batches:
            for k in range(0, whole.num_rows, 2000):
                b = whole.slice(k, 2000)
                n = b.num_rows
                (r1, c1, n1), (r2, c2, n2) = known(b.column(1), t), known(b.column(2), t)
                k1, k2 = np.bincount(r1, minlength=n), np.bincount(r2, minlength=n)
                s1, s2 = centroids(r1, c1, n, t), centroids(r2, c2, n, t)
                m1, m2 = s1 / np.maximum(k1, 1)[:, None], s2 / np.maximum(k2, 1)[:, None]
                i1, i2 = (centroids(r, c, n, t, t.weight) / np.maximum(m, 1)[:, None] for r, c, m in ((r1, c1, n1), (r2, c2, n2)))
                size = len(t.index) + 1
                only1, only2 = ~np.isin(r1 * size + c1, r2 * size + c2), ~np.isin(r2 * size + c2, r1 * size + c1)
                d1, d2 = centroids(r1[only1], c1[only1], n, t), centroids(r2[only2], c2[only2], n, t)
                u1, u2 = (s / np.maximum(np.linalg.norm(s, axis=1, keepdims=True), 1e-300) for s in (s1, s2))
                imp = (k1 + k2) / np.maximum(n1 + n2, 1)
                cos, rmse = cosines(m1, m2), np.sqrt(((m1 - m2) ** 2).mean(1))
                cols = [k1 / np.maximum(n1, 1), k2 / np.maximum(n2, 1), imp, cos, cos * imp, rmse, rmse * imp, cosines(i1, i2), np.sqrt(((i1 - i2) ** 2).sum(1)), np.abs(u1 - u2).sum(1), np.sqrt(((u1 - u2) ** 2).sum(1)), cosines(d1, d2)]
                yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, cols)], names=[c.split()[0] for c in CENTROIDS.split(", ")])

    return df.select("id", "a", "b").mapInArrow(run, CENTROIDS)


def _centroid_sql(weight: str, over: str, name: str, where: str = "") -> str:
    """(id, side, vec) by components; ``over`` divides the sums."""
    return f"{name} AS (SELECT id, side, list(x ORDER BY pos) AS vec FROM (SELECT id, side, pos, sum(x * {weight}) / any_value({over}) AS x FROM (SELECT id, side, n, known, freq, unnest(vec) AS x, unnest(range(0, len(vec))) AS pos FROM k JOIN m USING (id, side) {where}) GROUP BY id, side, pos) GROUP BY id, side)"


_COS = "CASE WHEN list_sum(list_transform({x}, lambda z: z * z)) > 0 AND list_sum(list_transform({y}, lambda z: z * z)) > 0 THEN list_inner_product({x}, {y}) / sqrt(list_inner_product({x}, {x}) * list_inner_product({y}, {y})) ELSE 0 END"
_ZERO = "list_transform(range(0, 64), lambda z: CAST(0 AS DOUBLE))"


def _two(name: str) -> str:
    return f"{name}2 AS (SELECT p.id, coalesce(x.vec, {_ZERO}) AS x, coalesce(y.vec, {_ZERO}) AS y FROM p LEFT JOIN {name} AS x ON x.id = p.id AND x.side = 1 LEFT JOIN {name} AS y ON y.id = p.id AND y.side = 2)"


_UNIT = "CASE WHEN list_inner_product({x}, {x}) > 0 THEN list_transform({x}, lambda z: z / sqrt(list_inner_product({x}, {x}))) ELSE {x} END"


@query(f"""WITH {PAIR_SQL}, {_WORDS}, k AS (SELECT s.id, s.side, s.w, freq, vec FROM s JOIN v USING (w)), m AS (SELECT id, side, count(*) AS n, count(v.w) AS known FROM s LEFT JOIN v USING (w) GROUP BY 1, 2), nq AS (SELECT 2 * count(*) AS nq FROM p),
{_centroid_sql('1', 'known', 'g')}, {_centroid_sql('ln((1.0 + (SELECT nq FROM nq)) / (1 + freq))', 'n', 'i')}, {_centroid_sql('1', 'known', 'o', 'WHERE NOT EXISTS (SELECT 1 FROM s AS z WHERE z.id = k.id AND z.side <> k.side AND z.w = k.w)')},
{_two('g')}, {_two('i')}, {_two('o')}, n2 AS (SELECT p.id, coalesce(x.n, 0) AS n1, coalesce(y.n, 0) AS n2, coalesce(x.known, 0) AS k1, coalesce(y.known, 0) AS k2 FROM p LEFT JOIN m AS x ON x.id = p.id AND x.side = 1 LEFT JOIN m AS y ON y.id = p.id AND y.side = 2),
h AS (SELECT n2.id, CAST(k1 AS DOUBLE) / greatest(n1, 1) AS coverage1, CAST(k2 AS DOUBLE) / greatest(n2, 1) AS coverage2, CAST(k1 + k2 AS DOUBLE) / greatest(n1 + n2, 1) AS importance, {_COS.format(x='g2.x', y='g2.y')} AS cosine, list_distance(g2.x, g2.y) / 8 AS rmse, {_COS.format(x='i2.x', y='i2.y')} AS idf_cosine, list_distance(i2.x, i2.y) AS idf_distance, {_UNIT.format(x='g2.x')} AS ux, {_UNIT.format(x='g2.y')} AS uy, {_COS.format(x='o2.x', y='o2.y')} AS distinct_cosine FROM n2 JOIN g2 USING (id) JOIN i2 USING (id) JOIN o2 USING (id))
SELECT id, round(coverage1, 6) AS coverage1, round(coverage2, 6) AS coverage2, round(importance, 6) AS importance, round(cosine, 5) + 0 AS cosine, round(cosine * importance, 5) + 0 AS cosine_importance, round(rmse, 5) AS rmse, round(rmse * importance, 5) AS rmse_importance, round(idf_cosine, 5) + 0 AS idf_cosine, round(idf_distance, 5) AS idf_distance, round(list_sum(list_transform(list_zip(ux, uy), lambda z: abs(z[1] - z[2]))), 5) AS normed_cityblock, round(list_distance(ux, uy), 5) AS normed_distance, round(distinct_cosine, 5) + 0 AS distinct_cosine FROM h""")
def pair_centroids(spark: SparkSession, d: str) -> DataFrame:
    """Coverage and comparisons of the two questions' centroids: cosine, RMSE, both times the coverage, weighted by inverse frequency, of unit length, and of the words of one question only."""
    df = pair_rows(spark, d)
    got = compared(df, words(spark, word_table(spark, d), 2.0 * df.count()))
    return got.select("id", *(F.round(c, 6 if c.startswith(("cov", "imp")) else 5).alias(c) if "cosine" not in c else (F.round(c, 5) + 0.0).alias(c) for c in got.columns[1:]))


WORD_BY_WORD = "id long, sim_mean double, sim_max double, sim_min double, sim_std double, rowmax_mean double, rowmax_std double, rowmax_min double, rowmean_max double, rowmin_mean double, self1_mean double, self2_mean double, distinct_mean double, distinct_max double, relaxed_distance double"


def _pairs(ra: np.ndarray, rb: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all (a, b) of one row; both lists of rows ascend. Ordered by a."""
    cb = np.bincount(rb, minlength=n)
    sb = np.cumsum(cb) - cb
    each = cb[ra]
    ia = np.repeat(np.arange(len(ra)), each)
    return ia, np.arange(len(ia)) - np.repeat(np.cumsum(each) - each, each) + np.repeat(sb[ra], each)


def _by_row(v: np.ndarray, row: np.ndarray, n: int, how: str, none: float = -1.0) -> np.ndarray:
    """Mean, max, min or deviation of the values of every row, which come row by row; ``none`` for rows without."""
    out = np.full(n, none)
    if not len(v):
        return out
    start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    at, size = row[start], np.diff(np.r_[start, len(row)])
    if how in ("max", "min"):
        out[at] = (np.maximum if how == "max" else np.minimum).reduceat(v, start)
        return out
    mean = np.add.reduceat(v, start) / size
    out[at] = mean if how == "mean" else np.sqrt(np.maximum(np.add.reduceat(v * v, start) / size - mean * mean, 0))
    return out


def word_by_word_features(df: DataFrame, table) -> DataFrame:
    """Cosines of every word of a with every word of b, first by word of a, then over these; of a question's words with each other; and the relaxed mover's distance.

    The distance is the larger of the two mean distances to the nearest word, among unit vectors. -1 where there is nothing to compare.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                b = whole.slice(k, 500)
                n = b.num_rows
                (r1, c1, _), (r2, c2, _) = known(b.column(1), t), known(b.column(2), t)
                names, at = np.unique(np.concatenate([c1, c2]), return_inverse=True)
                w1, w2 = at[: len(c1)], at[len(c1) :]
                s = np.clip(t.unit[names] @ t.unit[names].T, -1, 1) if len(names) else np.zeros((0, 0))

                def crossed(x, rx, y, ry, s=s, n=n):
                    ia, ib = _pairs(rx, ry, n)
                    return s[x[ia], y[ib]], ia, ib

                v, ia, _ = crossed(w1, r1, w2, r2)
                row = r1[ia]
                top, mean, low = (_by_row(v, ia, len(w1), how, np.nan) for how in ("max", "mean", "min"))
                has = ~np.isnan(top)
                top, mean, low, first = top[has], mean[has], low[has], r1[has]
                back, ja, _ = crossed(w2, r2, w1, r1)
                other = _by_row(back, ja, len(w2), "max", np.nan)
                has2 = ~np.isnan(other)
                near = lambda z: np.sqrt(np.maximum(2 - 2 * z, 0))
                relaxed = np.maximum(_by_row(near(top), first, n, "mean"), _by_row(near(other[has2]), r2[has2], n, "mean"))
                own = []
                for x, rx in ((w1, r1), (w2, r2)):
                    z, ia2, ib2 = crossed(x, rx, x, rx)
                    differ = ia2 != ib2
                    own.append(_by_row(z[differ], rx[ia2[differ]], n, "mean"))
                size = len(t.index) + 1
                o1, o2 = ~np.isin(r1 * size + c1, r2 * size + c2), ~np.isin(r2 * size + c2, r1 * size + c1)
                dv, da, _ = crossed(w1[o1], r1[o1], w2[o2], r2[o2])
                drow = r1[o1][da]
                cols = [_by_row(v, row, n, "mean"), _by_row(v, row, n, "max"), _by_row(v, row, n, "min"), _by_row(v, row, n, "std"), _by_row(top, first, n, "mean"), _by_row(top, first, n, "std"), _by_row(top, first, n, "min"), _by_row(mean, first, n, "max"), _by_row(low, first, n, "mean"), *own, _by_row(dv, drow, n, "mean"), _by_row(dv, drow, n, "max"), relaxed]
                yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, cols)], names=[c.split()[0] for c in WORD_BY_WORD.split(", ")])

    return df.select("id", "a", "b").mapInArrow(run, WORD_BY_WORD)


_STD = "sqrt(greatest(avg({v} * {v}) - avg({v}) * avg({v}), 0))"


@query(f"""WITH {PAIR_SQL}, {_WORDS}, k AS (SELECT s.id, s.side, s.w, s.pos, vec FROM s JOIN v USING (w)),
x AS (SELECT a.id, a.pos AS i, b.pos AS j, greatest(least(list_cosine_similarity(a.vec, b.vec), 1), -1) AS v, NOT EXISTS (SELECT 1 FROM s AS l WHERE l.id = a.id AND l.side = 2 AND l.w = a.w) AND NOT EXISTS (SELECT 1 FROM s AS l WHERE l.id = a.id AND l.side = 1 AND l.w = b.w) AS apart FROM k AS a JOIN k AS b ON a.id = b.id AND a.side = 1 AND b.side = 2),
r AS (SELECT id, i, max(v) AS hi, avg(v) AS mean, min(v) AS lo FROM x GROUP BY 1, 2), z AS (SELECT id, j, max(v) AS hi FROM x GROUP BY 1, 2),
g AS (SELECT id, avg(v) AS sim_mean, max(v) AS sim_max, min(v) AS sim_min, {_STD.format(v='v')} AS sim_std, coalesce(avg(v) FILTER (WHERE apart), -1) AS distinct_mean, coalesce(max(v) FILTER (WHERE apart), -1) AS distinct_max FROM x GROUP BY id),
h AS (SELECT id, avg(hi) AS rowmax_mean, {_STD.format(v='hi')} AS rowmax_std, min(hi) AS rowmax_min, max(mean) AS rowmean_max, avg(lo) AS rowmin_mean, avg(sqrt(greatest(2 - 2 * hi, 0))) AS d1 FROM r GROUP BY id), f AS (SELECT id, avg(sqrt(greatest(2 - 2 * hi, 0))) AS d2 FROM z GROUP BY id),
o AS (SELECT a.id, a.side, avg(greatest(least(list_cosine_similarity(a.vec, b.vec), 1), -1)) AS v FROM k AS a JOIN k AS b ON a.id = b.id AND a.side = b.side AND a.pos <> b.pos GROUP BY 1, 2)
SELECT p.id, {', '.join(f'coalesce(round({c}, {n}), -1) AS {c}' for c, n in (('sim_mean', 5), ('sim_max', 5), ('sim_min', 5), ('sim_std', 4), ('rowmax_mean', 5), ('rowmax_std', 4), ('rowmax_min', 5), ('rowmean_max', 5), ('rowmin_mean', 5)))}, coalesce(round(o1.v, 5), -1) AS self1_mean, coalesce(round(o2.v, 5), -1) AS self2_mean, coalesce(round(distinct_mean, 5), -1) AS distinct_mean, coalesce(round(distinct_max, 5), -1) AS distinct_max, coalesce(round(greatest(d1, d2), 4), -1) AS relaxed_distance
FROM p LEFT JOIN g USING (id) LEFT JOIN h USING (id) LEFT JOIN f USING (id) LEFT JOIN o AS o1 ON o1.id = p.id AND o1.side = 1 LEFT JOIN o AS o2 ON o2.id = p.id AND o2.side = 2""")
def pair_word_similarities(spark: SparkSession, d: str) -> DataFrame:
    """Word by word similarities of a pair in two levels, of each question with itself, of the words of one question only, and the relaxed mover's distance."""
    df = pair_rows(spark, d)
    got = word_by_word_features(df, words(spark, word_table(spark, d), 2.0 * df.count()))
    return got.select("id", *(F.round(c, 4 if c.endswith("std") or c == "relaxed_distance" else 5).alias(c) for c in got.columns[1:]))


@query(f"WITH {PAIR_SQL}, {_VOCAB} SELECT t.idx, w, CAST(vec IS NOT NULL AS INT) AS known, round(coalesce(sqrt(list_inner_product(vec, vec)), 0), 4) AS norm FROM t LEFT JOIN e0 USING (idx)")
def embedding_matrix(spark: SparkSession, d: str) -> DataFrame:
    """The vocabulary's rows of the embedding matrix: a word without a vector has zeros."""
    t = word_table(spark, d)
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    return t.select(F.col("idx").cast("long").alias("idx"), "w", F.col("vec").isNotNull().cast("int").alias("known"), F.round(F.coalesce(norm, F.lit(0.0)), 4).alias("norm"))


def neighbour_vectors(spark: SparkSession, d: str) -> DataFrame:
    """(id, own, cross, between): cosines of question1's centroid with those of its neighbours and of question2's, and of the two questions' neighbours.

    Of a question's neighbours the first 20 by their ids are read: in these metrics the number is part of the definition.
    """
    pairs, near = neighbour_texts(spark, d)
    n = 2.0 * pair_rows(spark, d).count()
    table = words(spark, word_table(spark, d), n)

    def centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        for b in batches:
            r, c, _ = known(b.column(1), t)
            s = centroids(r, c, b.num_rows, t)
            s = s / np.maximum(np.linalg.norm(s, axis=1, keepdims=True), 1e-300)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(s), pa.list_(pa.float64()))], names=["key", "vec"])

    lists = near.select(F.struct("node", "nb").alias("key"), "t").mapInArrow(centre, "key struct<node:bigint,nb:bigint>, vec array<double>")
    lists = cut(lists.groupBy(F.col("key.node").alias("node")).agg(F.collect_list("vec").alias("vs")))  # at most 20
    j, rows = cut(pairs.select("id", "qid1", "qid2", "a")), pairs.count()
    for k in "12":
        q = f"qid{k}"
        heavy = pairs.groupBy(q).agg(F.count("*").alias("n")).filter(F.col("n") > F.lit(max(100.0, rows * HEAVY_SHARE))).select(q)
        j = salted_join(j, lists.select(F.col("node").alias(q), F.col("vs").alias(f"v{k}")), [q], heavy, ["id"])
    schema = "id long, " + ", ".join(f"{m}_{s} double" for m in ("own", "cross", "between") for s in ("mean", "max", "min"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = table.value
        for pdf in batches:
            out = []
            col = pa.array(list(pdf["a"]), pa.list_(pa.string()))
            r, c, _ = known(col, t)
            a = centroids(r, c, len(pdf), t)
            a = a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)
            for i, (v1, v2) in enumerate(zip(pdf["v1"], pdf["v2"])):
                x, y = np.stack(v1), np.stack(v2)
                parts = x @ a[i], y @ a[i], x @ y.T
                out.append((pdf["id"].iat[i], *(f(p) for p in parts for f in (np.mean, np.max, np.min))))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return j.select("id", "a", "v1", "v2").mapInPandas(run, schema)


_tok = lambda c: _TOK.replace("{c}", c)
_SUMS = "(SELECT k, list(x ORDER BY pos) AS vec FROM (SELECT k, pos, sum(x) AS x FROM (SELECT k, unnest(vec) AS x, unnest(range(0, len(vec))) AS pos FROM (SELECT k, unnest(t) AS w FROM {src}) JOIN v USING (w)) GROUP BY k, pos) GROUP BY k)"


@query(f"""WITH {PAIR_SQL}, {_WORDS}, t0 AS (SELECT * FROM train WHERE qid1 <> qid2 AND question1 IS NOT NULL AND question2 IS NOT NULL), e AS (SELECT qid1 AS node, qid2 AS nb, question2 AS text FROM t0 UNION ALL SELECT qid2, qid1, question1 FROM t0),
o AS (SELECT node, nb, min(text) AS text FROM e GROUP BY 1, 2), f AS (SELECT node, nb, node || ' ' || nb AS k, {_tok('text')} AS t FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY nb) AS r FROM o) WHERE r <= {NEIGHBOURS}),
q AS (SELECT id, id AS k, qid1, qid2, {_tok('question1')} AS t FROM t0), fv AS (SELECT node, nb, coalesce(z.vec, {_ZERO}) AS vec FROM f LEFT JOIN {_SUMS.format(src='f')} AS z USING (k)), qv AS (SELECT id, qid1, qid2, coalesce(z.vec, {_ZERO}) AS vec FROM q LEFT JOIN {_SUMS.format(src='q')} AS z USING (k)),
a AS (SELECT id, {_COS.format(x='qv.vec', y='fv.vec')} AS v FROM qv JOIN fv ON node = qid1), b AS (SELECT id, {_COS.format(x='qv.vec', y='fv.vec')} AS v FROM qv JOIN fv ON node = qid2), c2 AS (SELECT id, {_COS.format(x='x.vec', y='y.vec')} AS v FROM qv JOIN fv AS x ON x.node = qid1 JOIN fv AS y ON y.node = qid2),
{', '.join(f'{n}s AS (SELECT id, round(avg(v), 5) + 0 AS {m}_mean, round(max(v), 5) + 0 AS {m}_max, round(min(v), 5) + 0 AS {m}_min FROM {n} GROUP BY id)' for n, m in (('a', 'own'), ('b', 'cross'), ('c2', 'between')))} SELECT * FROM "as" JOIN bs USING (id) JOIN c2s USING (id)""".replace("as AS (SELECT id, round(avg(v), 5) + 0 AS own", '"as" AS (SELECT id, round(avg(v), 5) + 0 AS own'))
def neighbour_vector_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Cosines between centroids of questions and of their neighbours."""
    got = neighbour_vectors(spark, d)
    return got.select("id", *((F.round(c, 5) + 0.0).alias(c) for c in got.columns[1:]))
