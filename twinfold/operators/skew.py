"""Per-key results and joins that stay even when a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy if it holds more than this share of the rows; so at most 1/HEAVY_SHARE keys are.
HEAVY_SHARE = 1 / 1000
BLOCK = 4096


def salted_join(left: DataFrame, right: DataFrame, on: list[str], heavy: DataFrame, by: list[str], salts: int = 64, how: str = "inner") -> DataFrame:
    """Equi-join of a skewed ``left`` with ``right``; keys listed in ``heavy`` are spread over ``salts`` tasks.

    ``heavy`` holds distinct keys (columns ``on``), at most 1/HEAVY_SHARE of them by construction,
    which is what makes its broadcast safe. Null keys match nothing. ``by``: columns of
    ``left`` whose hash spreads the rows of one key. ``how``: inner or left.
    """
    mark = F.broadcast(heavy.select(*on).distinct().withColumn("__heavy", F.lit(1)))
    a = left.join(mark, on, "left").withColumn("__salt", F.when(F.col("__heavy").isNull(), 0).otherwise(F.pmod(F.hash(*by), F.lit(salts)))).drop("__heavy")
    b = right.join(mark, on, "left")
    b = b.withColumn("__salt", F.explode(F.when(F.col("__heavy").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(salts - 1))))).drop("__heavy")
    return a.join(b, [*on, "__salt"], how).drop("__salt")


def dense_counts(df: DataFrame, fields: list[str], value: str | None = None) -> DataFrame:
    """Rows per value of each long column in ``fields``, by dense accumulator arrays: (field_name, value_key, n_rows, total).

    Every task takes its input split as it is, encodes the keys it meets in a local dictionary and
    counts with bincount; what it sends on are sparse blocks of 4,096 neighbouring keys, at most one
    per block and task, so a key that holds most rows weighs as much as any other. The arrays of
    one place are then added up slot by slot, first within and then across the tasks. ``value``: a numeric column of which ``total`` is the sum (null counts
    as 0); else total is n_rows. Null keys are not counted; an empty table gives no rows.
    """
    from pyspark.sql import types as T

    weight = F.lit(1.0) if value is None else F.coalesce(F.col(value).cast("double"), F.lit(0.0))
    schema = "field int, block long, slots array<int>, counts array<long>, totals array<double>"

    def accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[int, list]] = [{} for _ in fields]
        for b in batches:
            w = b.column(len(fields)).to_numpy(zero_copy_only=False)
            for i in range(len(fields)):
                col = b.column(i)
                there = np.asarray(col.is_valid())
                keys, code = np.unique(col.drop_null().to_numpy(zero_copy_only=False), return_inverse=True)
                if not len(keys):
                    continue
                n, t = np.bincount(code, minlength=len(keys)), np.bincount(code, weights=w[there], minlength=len(keys))
                place = keys >> 12
                cuts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
                for lo, hi in zip(cuts, [*cuts[1:], len(keys)]):
                    got = held[i].get(int(place[lo]))
                    if got is None:
                        got = held[i][int(place[lo])] = [np.zeros(BLOCK, np.int64), np.zeros(BLOCK)]
                    at = keys[lo:hi] & (BLOCK - 1)
                    got[0][at] += n[lo:hi]
                    got[1][at] += t[lo:hi]
                if len(held[i]) > 512:
                    yield from flush(i, held[i])
        for i in range(len(fields)):
            yield from flush(i, held[i])

    def flush(i: int, blocks: dict[int, list]) -> Iterator[pa.RecordBatch]:
        if blocks:
            rows = [(k, np.flatnonzero(v[0]), v) for k, v in blocks.items()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([i] * len(rows), pa.int32()),
                    pa.array([k for k, _, _ in rows], pa.int64()),
                    pa.array([s.astype(np.int32) for _, s, _ in rows], pa.list_(pa.int32())),
                    pa.array([v[0][s] for _, s, v in rows], pa.list_(pa.int64())),
                    pa.array([v[1][s] for _, s, v in rows], pa.list_(pa.float64())),
                ],
                names=["field", "block", "slots", "counts", "totals"],
            )
        blocks.clear()

    keys = [F.col(f).cast("long") if not isinstance(df.schema[f].dataType, T.LongType) else F.col(f) for f in fields]
    blocks = df.select(*keys, weight.alias("__w")).mapInArrow(accumulate, schema)
    names = F.element_at(F.array(*map(F.lit, fields)), F.col("field") + 1)
    parts = blocks.select("field", "block", F.explode(F.arrays_zip("slots", "counts", "totals")).alias("p"))
    summed = parts.groupBy("field", (F.col("block") * BLOCK + F.col("p.slots")).alias("value_key")).agg(F.sum("p.counts").alias("n_rows"), F.sum("p.totals").alias("total"))
    return summed.select(names.alias("field_name"), "value_key", "n_rows", "total")
