"""Filling fixed-capacity containers (problem 9), by shortest-pack-first over the length histogram.

Only the histogram of sizes, as long as the capacity at most, reaches the driver. Sizes are placed longest
first, each into the shortest open pack that takes it; packs that look alike are one pattern with a count.
Documents are then ranked within their size, and patterns are joined back to them by rank.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinfold.llm.bpe import token_counts
from twinfold.session import cut

#: Items that one task ranks at most, on average.
RANKED = 100_000
#: Shares of packs above the least possible number that are tried as a start.
SPARE = (0, 0.0001, 0.0003, 0.001, 0.002, 0.004, 0.007, 0.012)


def placed(histogram: dict[int, int], capacity: int, opened: int) -> list[tuple[int, tuple[int, ...]]]:
    """(count, sizes): packs by their pattern, when ``opened`` empty packs stand ready and others are opened where none takes an item."""
    heap: list[tuple[int, int]] = []  # (-room, number of the group)
    groups: list[tuple[int, tuple | None]] = []  # count, chain of sizes
    full: list[int] = []

    def hold(count: int, chain: tuple | None, room: int) -> None:
        groups.append((count, chain))
        if room:
            heapq.heappush(heap, (-room, len(groups) - 1))
        else:
            full.append(len(groups) - 1)

    if opened:
        hold(opened, None, capacity)
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            if heap and -heap[0][0] >= size:
                room, g = heapq.heappop(heap)
                room, (count, chain) = -room, groups[g]
                used = min(count, left)
                if used < count:
                    hold(count - used, chain, room)
                hold(used, (size, chain), room - size)
                left -= used
            else:  # no pack takes it: as many new packs as there are items
                hold(left, (size, None), capacity - size)
                left = 0
    out = []
    for g in [*full, *sorted(g for _, g in heap)]:
        count, chain = groups[g]
        sizes = []
        while chain:
            sizes.append(chain[0])
            chain = chain[1]
        if sizes:
            out.append((count, tuple(reversed(sizes))))
    return out


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """The best packing by shortest-pack-first. Sizes are from 1 to ``capacity``.

    Packs that are opened only on demand come to be evenly filled too early, and then take no item of middle size. So the
    number of packs to start with is tried from the least possible one up, in SPARE steps, and the fewest packs win.
    """
    least = -(-sum(k * v for k, v in histogram.items()) // capacity)
    best = placed(histogram, capacity, 0)
    total = sum(c for c, _ in best)
    for spare in SPARE:
        opened = least + math.ceil(least * spare)
        if opened >= total:
            break
        got = placed(histogram, capacity, opened)
        if (n := sum(c for c, _ in got)) < total:
            best, total = got, n
    return best


def slots(packs: list[tuple[int, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """For every place of every pattern: which ranks of its size go there, the first container, and the place's offset."""
    seen: dict[int, int] = {}
    rows, base = [], 0
    for count, sizes in packs:
        at = 0
        for s in sizes:
            start = seen.get(s, 0)
            rows.append((s, start, base, at))
            seen[s] = start + count
            at += s
        base += count
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 4)
    return {"key": (a[:, 0] << 44) + a[:, 1], "start": a[:, 1], "base": a[:, 2], "at": a[:, 3]}


def pieces(sizes: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece, size): a document above the capacity gives full pieces and a rest, any other one piece; empty ones size 0."""
    n = F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long")
    last = F.greatest(F.ceil(n / capacity) - 1, F.lit(0))
    out = sizes.select("doc_id", n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    return out.select("doc_id", "piece", F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).cast("long").alias("size"))


def packed(sizes: DataFrame, capacity: int = 2048) -> DataFrame:
    """(doc_id, piece, size, container, position) from (doc_id, n_tokens).

    Pieces of size 0 (empty, blank or null documents) take no room and get a null container and position.
    Repeated document ids are documents of their own. A size that very many documents share is
    ranked in parts of about RANKED rows, whose offsets are summed from their counts.
    """
    spark = sizes.sparkSession
    items = cut(pieces(sizes, capacity).withColumn("spread", F.xxhash64("doc_id", "piece")))
    histogram = {r.size: r["count"] for r in items.filter("size > 0").groupBy("size").count().collect()}
    table = spark.sparkContext.broadcast(slots(patterns(histogram, capacity)))
    parts = spark.createDataFrame([(s, -(-n // RANKED)) for s, n in histogram.items()] or [(0, 1)], "size long, parts int")
    salted = items.filter("size > 0").join(F.broadcast(parts), "size").withColumn("salt", F.pmod("spread", F.col("parts")))
    counts = salted.groupBy("size", "salt").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.row_number().over(Window.partitionBy("size", "salt").orderBy("doc_id", "piece")) - 1
    ranked = salted.withColumn("within", rank).join(counts.select("size", "salt", before.alias("offset")), ["size", "salt"])
    ranked = ranked.select("doc_id", "piece", "size", (F.col("within") + F.col("offset")).cast("long").alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        for b in batches:
            size, rank = b.column(2).to_numpy(), b.column(3).to_numpy()
            at = np.searchsorted(t["key"], (size << 44) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(t["base"][at] + rank - t["start"][at]), pa.array(t["at"][at])], names=["doc_id", "piece", "size", "container", "position"])

    schema = f"doc_id {items.schema['doc_id'].dataType.simpleString()}, piece long, size long, container long, position long"
    none = F.lit(None).cast("long")
    return ranked.mapInArrow(place, schema).union(items.filter("size = 0").select("doc_id", "piece", "size", none, none))


def p9_packing(spark: SparkSession, d: str) -> DataFrame:
    return packed(cut(token_counts(spark.read.parquet(f"{d}/documents.parquet"))))


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    """One row: containers, tokens, the fewest containers that could hold them, and the share of unused room."""
    p = p9_packing(spark, d).filter("container is not null").agg((F.max("container") + 1).alias("containers"), F.sum("size").alias("tokens"))
    return p.select("containers", "tokens", F.ceil(F.col("tokens") / 2048).alias("least_containers"), (1 - F.col("tokens") / (F.col("containers") * 2048)).alias("unused"))


QUERIES = {"p9_packing": p9_packing, "p9_fill": p9_fill}
