"""Near-duplicate records with small edits (problem 7), by HyperMinHash.

A word's 64-bit hash names a bucket (16 bits) and a value of which the number of leading zeros and 10 bits of
mantissa are kept: a register. A bucket keeps the least of its values. Questions are short, so their sketches are
sparse; the few registers that a smaller one shadows are kept beside the sketch. Registers are banded, in order of
rarity (module matching), the shadowed ones too, so that no pair at 7/10 or above is missed. Candidates go on
only if the collision-corrected Jaccard estimate of their sketches, with the margin that shadowed registers and
collisions leave, reaches 7/10; the words then confirm them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.llm import matching as M
from twinfold.llm.matching_sql import matching_sql
from twinfold.session import cut

BUCKET_BITS, MANTISSA_BITS = 16, 10


def registers(h: np.ndarray) -> np.ndarray:
    """Word hashes as registers: bucket, leading zeros, mantissa in one long."""
    u = h.view(np.uint64)
    rest = u & np.uint64((1 << (64 - BUCKET_BITS)) - 1)
    top = np.frexp(rest.astype(np.float64))[1].astype(np.uint64)  # position of the highest bit; 0 for 0
    zeros = np.uint64(64 - BUCKET_BITS) - top
    shift = np.maximum(top.astype(np.int64) - 1 - MANTISSA_BITS, 0).astype(np.uint64)
    mantissa = (rest >> shift) & np.uint64((1 << MANTISSA_BITS) - 1)
    return ((u >> np.uint64(64 - BUCKET_BITS)) << np.uint64(6 + MANTISSA_BITS) | zeros << np.uint64(MANTISSA_BITS) | mantissa).astype(np.int64)


def collisions(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Expected equal registers of n and m different words: same bucket, same zeros (1/3), same mantissa."""
    return n * m / (2.0**BUCKET_BITS * 3 * 2.0**MANTISSA_BITS)


def minima(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Marks the registers of every set that are the least of their bucket: most leading zeros, then the smallest mantissa; equal ones once."""
    rows = np.repeat(np.arange(len(sizes)), sizes)
    u = codes.view(np.uint64)
    low = np.uint64(6 + MANTISSA_BITS)
    zeros = (u >> np.uint64(MANTISSA_BITS)) & np.uint64(63)
    mantissa = u & np.uint64((1 << MANTISSA_BITS) - 1)
    order = np.lexsort((mantissa, np.uint64(63) - zeros, u >> low, rows))
    bucket, row = (u >> low)[order], rows[order]
    first = np.r_[True, (bucket[1:] != bucket[:-1]) | (row[1:] != row[:-1])] if len(codes) else np.zeros(0, bool)
    out = np.zeros(len(codes), bool)
    out[order[first]] = True
    return out


def sketches(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(registers, number of them, number of shadowed words) of every set, from the hashes of its words."""
    codes = registers(flat)
    least = minima(codes, sizes)
    held = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[least], minlength=len(sizes))
    return codes[least], held, sizes - held


def shared_counts(xf: np.ndarray, xn: np.ndarray, yf: np.ndarray, yn: np.ndarray) -> np.ndarray:
    """Values that two lists have in common, row by row; each list holds distinct values."""
    n = len(xn)
    rows = np.concatenate([np.repeat(np.arange(n), xn), np.repeat(np.arange(n), yn)])
    vals = np.concatenate([xf, yf])
    order = np.lexsort((vals, rows))
    rows, vals = rows[order], vals[order]
    same = (rows[1:] == rows[:-1]) & (vals[1:] == vals[:-1])
    return np.bincount(rows[1:][same], minlength=n)


def jaccard_estimate(x: tuple, y: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates of two lists of sketches, row by row, and their margins.

    Equal registers less the expected collisions, over the buckets that either sketch fills. A shared word is lost only where
    one of the sketches shadows it, and a collision only adds: the true value is at most estimate plus margin.
    """
    (xf, xn, xs), (yf, yn, ys) = x, y
    bucket = np.uint64(6 + MANTISSA_BITS)
    equal = shared_counts(xf, xn, yf, yn)
    filled = xn + yn - shared_counts((xf.view(np.uint64) >> bucket).view(np.int64), xn, (yf.view(np.uint64) >> bucket).view(np.int64), yn)
    expected = collisions(xn - equal, yn - equal)
    filled = np.maximum(filled, 1)
    return np.maximum(equal - expected, 0) / filled, (xs + ys + expected) / filled


def estimated(texts: DataFrame, least: float = 0.7) -> DataFrame:
    """The candidates whose questions' estimates reach ``least`` within their margins, straight or crosswise."""
    cols = ["a1", "a2", "b1", "b2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = {}
            for i, c in enumerate(cols):
                col = b.column(b.num_columns - 4 + i)
                lists[c] = sketches(col.flatten().to_numpy(zero_copy_only=False).copy(), np.diff(col.offsets.to_numpy()))
            may = np.zeros(b.num_rows, bool)
            for orient in ((("a1", "b1"), ("a2", "b2")), (("a1", "b2"), ("a2", "b1"))):
                ok = np.ones(b.num_rows, bool)
                for x, y in orient:
                    estimate, margin = jaccard_estimate(lists[x], lists[y])
                    ok &= estimate + margin >= least - 1e-9
                may |= ok
            yield pa.RecordBatch.from_arrays(b.columns[:-4], names=b.schema.names[:-4]).filter(pa.array(may))

    given = texts.select("*", *(M.hashed(F.col(c)).alias(f"__{c}") for c in cols))
    return given.mapInArrow(run, texts.schema)


def class_pairs(reps: DataFrame, split_above: int = M.SPLIT_ABOVE) -> DataFrame:
    """(a, b), a < b: classes that match."""
    sets = M.with_hashes(reps)
    keys = M.band_keys(sets, M.rarity(sets, M.n_blocks(reps.count())), split_above, registers)
    texts = M.with_texts(cut(M.candidates(keys, keys, True)), reps, reps)
    return M.confirmed(estimated(texts)).union(M.same_root(reps, reps, True)).distinct()


def matching_pairs(df: DataFrame, id_col: str = "id", q1: str = "question1", q2: str = "question2", split_above: int = M.SPLIT_ABOVE) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every two records that match, copies included.

    Records with a null, empty or wordless question match nothing. Equal rows under two ids match;
    ids are taken as unique, a row repeated under its id gives its pairs again. Other columns are not read.
    Classes are expanded to their records at the end; an empty table gives no rows.
    """
    rows, reps = M.prepared(df, id_col, q1, q2)
    pairs = cut(class_pairs(reps, split_above))
    m = cut(M.members(rows, reps))
    between = M.spread(M.spread(pairs, "a", "x", m, pairs), "b", "y", m, pairs)
    return between.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).union(M.within(m))


def class_links(df: DataFrame, id_col: str = "id", q1: str = "question1", q2: str = "question2", split_above: int = M.SPLIT_ABOVE) -> DataFrame:
    """(id, class_id, n_copies, n_links): per record its class, the class's size and its number of matching classes.

    A class holds the records of the same words in the same order, in either order of the questions; its id is its smallest record's.
    """
    rows, reps = M.prepared(df, id_col, q1, q2)
    pairs = class_pairs(reps, split_above)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("cid")).groupBy("cid").agg(F.count("*").alias("n_links"))
    per = reps.select("cid", "n").join(ends, "cid", "left").withColumn("class_id", F.col("cid"))
    got = M.spread(per, "cid", "id", cut(M.members(rows, reps)))
    return got.select("id", "class_id", F.col("n").alias("n_copies"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return matching_pairs(spark.read.parquet(f"{d}/train.parquet"))


def p7_classes(spark: SparkSession, d: str) -> DataFrame:
    return class_links(spark.read.parquet(f"{d}/train.parquet"))


_FOUND = matching_sql(("train", "id"), None, ("id_a", "id_b"))
SQL = {
    "p7_found": _FOUND,
    "p7_classes": f"""WITH o AS ({_FOUND}), l AS (SELECT id, regexp_extract_all(lower(question1), '[\\p{{L}}\\p{{N}}]+') AS l1, regexp_extract_all(lower(question2), '[\\p{{L}}\\p{{N}}]+') AS l2 FROM train),
k AS (SELECT id, least(array_to_string(l1, ' '), array_to_string(l2, ' ')) AS lo, greatest(array_to_string(l1, ' '), array_to_string(l2, ' ')) AS hi FROM l WHERE len(l1) > 0 AND len(l2) > 0),
c AS (SELECT id, min(id) OVER w AS class_id, count(*) OVER w AS n_copies FROM k WINDOW w AS (PARTITION BY lo, hi)),
e AS (SELECT x.class_id AS s, y.class_id AS t FROM o JOIN c AS x ON x.id = id_a JOIN c AS y ON y.id = id_b WHERE x.class_id <> y.class_id), n AS (SELECT s, count(DISTINCT t) AS n_links FROM (SELECT s, t FROM e UNION ALL SELECT t, s FROM e) GROUP BY s)
SELECT id, class_id, n_copies, coalesce(n_links, 0) AS n_links FROM c LEFT JOIN n ON s = class_id""",
}
QUERIES = {"p7_found": p7_found, "p7_classes": p7_classes}
