"""Pairs of records whose two questions are nearly the same, straight or crosswise.

Shared by the overlap of splits (problem 1) and the near-duplicates (problem 7).

Records are first collapsed into classes of the same words in the same order. A class then gives band
keys: two questions with at least 7/10 of their words in common share one of each other's
``n - ceil(7n/10) + 1`` rarest words, whatever the order of rarity, so two matching classes share a band
key made of one rare word of either question. Where both words are frequent (more than ``split_above``
classes), the key takes two words of either question instead, from prefixes one word longer: of those
two words must be shared. Both are exact; no link is lost and no bucket is capped.

Words that are in one class only can't be shared. Those in two or more are counted exactly, by hash, in a
distributed table; from it a Bloom filter of these words and levels of their counts are broadcast, together
136 MB at most. The filter lets some words pass that can't be shared, which makes keys that meet nothing, and never
holds a word back; the levels only set the order of rarity.

Classes with very many records or very many links are split on both sides of the joins that expand them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinfold.functions.text import GAP
from twinfold.operators.skew import HEAVY_SHARE, salted_join
from twinfold.session import cut

#: Bits of a block of the filter, cells of its levels, and the most blocks; bits per class.
BLOCK_BITS, BLOCK_CELLS, MOST_BLOCKS, CLASS_BITS = 1 << 19, 1 << 12, 1 << 11, 64
#: Classes that share a word above which it takes two words of either question to make a key.
SPLIT_ABOVE = 4000
FULL = 63  # a signature's size field when the set is too large for it: it passes every bound
BITS = 58


def ordered_hashes(names: tuple[str, str], x: Column, y: Column) -> list[Column]:
    h = F.xxhash64(x), F.xxhash64(y)
    return [F.least(*h).alias(names[0]), F.greatest(*h).alias(names[1])]


def keyed(df: DataFrame, id_col: str, q1: str, q2: str) -> DataFrame:
    """(id, t1, t2, k1, k2): the words of both questions, joined by blanks, and their hashes, ordered. Blank records are left out."""
    plain = [F.trim(F.regexp_replace(F.lower(F.col(q)), GAP, " ")).alias(t) for q, t in ((q1, "t1"), (q2, "t2"))]
    out = df.select(F.col(id_col).cast("long").alias("id"), *plain).filter("t1 != '' and t2 != ''")
    return out.select("id", "t1", "t2", *ordered_hashes(("k1", "k2"), F.col("t1"), F.col("t2")))


def classes(rows: DataFrame) -> DataFrame:
    """(cid, n, t1, t2): one row per class, cid its smallest id. Combined before the shuffle, so copies weigh nothing."""
    c = rows.groupBy("k1", "k2").agg(F.min(F.struct("id", "t1", "t2")).alias("m"), F.count("*").alias("n"))
    return c.select(F.col("m.id").alias("cid"), "n", "m.t1", "m.t2")


def members(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """(cid, id, n) of the classes with more than one record; a class with many is spread over tasks."""
    several = reps.filter("n > 1").select("cid", "n", *ordered_hashes(("k1", "k2"), F.col("t1"), F.col("t2")))
    heavy = several.filter(F.col("n") > F.lit(max(1000.0, HEAVY_SHARE * reps.count()))).select("k1", "k2")
    return salted_join(rows.select("id", "k1", "k2"), several, ["k1", "k2"], heavy, ["id"]).select("cid", "id", "n")


def words(t: Column) -> Column:
    """Distinct words of a text as in ``keyed``."""
    return F.array_distinct(F.split(t, " "))


def hashed(t: Column) -> Column:
    return F.transform(words(t), lambda w: F.xxhash64(w))


def n_blocks(classes: int) -> int:
    """Blocks for so many classes, a power of two within the bound."""
    return min(MOST_BLOCKS, 1 << max(CLASS_BITS * classes // BLOCK_BITS, 1).bit_length() - 1)


class Rarity:
    """Levels of word counts, and a filter of the words that can be shared, in blocks of bytes: filter, then levels."""

    def __init__(self, blocks: np.ndarray, bits: int):
        self.blocks, self.bits = blocks, bits

    @staticmethod
    def places(h: np.ndarray, blocks: int, bits: int, cells: int) -> tuple[np.ndarray, ...]:
        """Block, two bits and the cell of every word hash."""
        u = h.view(np.uint64)
        parts = ((50, blocks), (0, bits), (19, bits), (38, cells))
        return tuple(((u >> np.uint64(at)) & np.uint64(size - 1)).astype(np.int64) for at, size in parts)

    def levels(self, h: np.ndarray) -> np.ndarray:
        """1 for words that can't be shared, else the level of the count, 2 or more."""
        at, first = self.blocks, self.bits // 8
        block, one, two, cell = self.places(h, len(at), self.bits, at.shape[1] - first)
        there = (at[block, one >> 3] >> (one & 7)) & (at[block, two >> 3] >> (two & 7)) & 1
        return np.where(there == 1, np.maximum(at[block, first + cell], 2), 1)


def _block(blocks: int, bits: int, cells: int):
    def build(t: pa.Table) -> pa.Table:
        h, n = t["h"].to_numpy(), t["n"].to_numpy()
        _, one, two, cell = Rarity.places(h, blocks, bits, cells)
        out = np.zeros(bits // 8 + cells, np.uint8)
        for bit in (one, two):
            np.bitwise_or.at(out, bit >> 3, (1 << (bit & 7)).astype(np.uint8))
        np.maximum.at(out, bits // 8 + cell, n.astype(np.uint8))
        return pa.table({"block": t["block"].combine_chunks()[:1], "bytes": pa.array([out.tobytes()], pa.binary())})

    return build


def rarity(sets: DataFrame, blocks: int, sided: bool = False) -> Rarity:
    """Counts the classes of every word and keeps those of the words that can be shared: words of two classes or more, or, ``sided`` (a column
    ``side`` tells apart two tables that are joined), of both tables.

    Words are combined before the shuffle. What reaches the driver are ``blocks`` blocks of 68 kB.
    """
    h = F.explode(F.array_distinct(F.concat("h1", "h2"))).alias("h")
    if sided:
        n = sets.select(h, "side").groupBy("h").agg(F.count("*").alias("n"), F.min("side").alias("s0"), F.max("side").alias("s1")).filter("s0 != s1")
    else:
        n = sets.select(h).groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    coarse = F.when(F.col("n") < 16, F.col("n")).otherwise(F.least(F.lit(255), F.floor(F.log2("n") * 8 - 16))).cast("short")
    block = F.shiftrightunsigned("h", 50).bitwiseAND(blocks - 1).cast("int")
    made = n.select(block.alias("block"), "h", coarse.alias("n")).groupBy("block").applyInArrow(_block(blocks, BLOCK_BITS, BLOCK_CELLS), "block int, bytes binary").toArrow()
    out = np.zeros((blocks, BLOCK_BITS // 8 + BLOCK_CELLS), np.uint8)
    for k, v in zip(made["block"].to_pylist(), made["bytes"]):
        out[k] = np.frombuffer(v.as_buffer(), np.uint8)
    return Rarity(out, BLOCK_BITS)


def level(count: int) -> int:
    return count if count < 16 else min(255, int(np.floor(np.log2(count) * 8 - 16)))


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hash of an unordered pair of 64-bit values."""
    a, b = a.view(np.uint64), b.view(np.uint64)
    z = np.minimum(a, b) * np.uint64(0x9E3779B97F4A7C15) ^ (np.maximum(a, b) + np.uint64(0x632BE59BD9B4E019))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))).view(np.int64)


def cross(ra: np.ndarray, rb: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all (a, b) of the same row; ra and rb are the rows of the items, ascending."""
    cb = np.bincount(rb, minlength=n)
    sb = np.concatenate([[0], np.cumsum(cb)[:-1]])
    each = cb[ra]
    ia = np.repeat(np.arange(len(ra)), each)
    first = np.repeat(np.cumsum(each) - each, each)
    return ia, np.arange(len(ia)) - first + np.repeat(sb[ra], each)


def signatures(codes: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """58 bits that hold the codes of a set, above 6 bits with its size."""
    bit = np.int64(1) << (codes.view(np.uint64) % np.uint64(BITS)).astype(np.int64)
    out = np.zeros(len(sizes), np.int64)
    if len(codes):
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        out[sizes > 0] = np.bitwise_or.reduceat(bit, starts[sizes > 0])
    return (out << 6) | np.minimum(sizes, FULL)


def prefixes(codes: np.ndarray, count: np.ndarray, sizes: np.ndarray, hot: int) -> tuple:
    """Rare words of every set, by their codes: (rows, codes, is frequent) of the prefix, and (rows, codes) of pairs of words for its frequent ones."""
    n = len(sizes)
    rows = np.repeat(np.arange(n), sizes)
    order = np.lexsort((codes, count, rows))
    codes, count = codes[order], count[order]
    rank = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    spare = (sizes + (-7 * sizes // 10))[rows]
    shared = count > 1
    one, two = shared & (rank <= spare), shared & (rank <= spare + 1)
    often = one & (count > hot)
    ia, ib = cross(rows[often], rows[two], n)
    at, other = np.flatnonzero(often)[ia], np.flatnonzero(two)[ib]
    keep = (at != other) | (sizes[rows[at]] == 1)
    code, r = mix(codes[at[keep]], codes[other[keep]]), rows[at[keep]]
    order = np.lexsort((code, r))
    code, r = code[order], r[order]
    new = np.r_[True, (code[1:] != code[:-1]) | (r[1:] != r[:-1])] if len(code) else np.zeros(0, bool)
    return (rows[one], codes[one], often[one]), (r[new], code[new])


def band_keys(sets: DataFrame, rare: Rarity, split_above: int, encode: Callable[[np.ndarray], np.ndarray], most: int = 1 << 20) -> DataFrame:
    """(key, cid, s1, s2): the band keys of every class with the signatures of its two questions.

    ``encode`` turns word hashes into the codes that are banded and kept in the signatures.
    """
    shared = sets.sparkSession.sparkContext.broadcast(rare)
    hot = level(split_above)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = shared.value
        for b in batches:
            cid, lists = b.column(0).to_numpy(zero_copy_only=False), []
            for c in (1, 2):
                col = b.column(c)
                flat = col.flatten().to_numpy(zero_copy_only=False).copy()
                lists.append((encode(flat), rare.levels(flat), np.diff(col.offsets.to_numpy())))
            sig = [signatures(f, np.repeat(np.arange(len(n)), n), n) for f, _, n in lists]
            (one1, two1), (one2, two2) = (prefixes(f, c, n, hot) for f, c, n in lists)
            for (r1, c1, f1), (r2, c2, f2), both in ((one1, one2, False), ((*two1, None), (*two2, None), True)):
                each = np.bincount(r2, minlength=len(cid))[r1]
                at, total = 0, np.cumsum(each)
                while at < len(r1):  # no more than about ``most`` keys at a time
                    end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
                    ia, ib = cross(r1[at:end], r2, len(cid))
                    x, y, r = c1[at:end][ia], c2[ib], r1[at:end][ia]
                    if not both:
                        keep = ~(f1[at:end][ia] & f2[ib])
                        x, y, r = x[keep], y[keep], r[keep]
                    at = end
                    if len(r):
                        yield pa.RecordBatch.from_arrays([pa.array(mix(x, y)), pa.array(cid[r]), pa.array(sig[0][r]), pa.array(sig[1][r])], names=["key", "cid", "s1", "s2"])

    return sets.select("cid", "h1", "h2").mapInArrow(run, "key long, cid long, s1 long, s2 long")


def may_be_close(a: Column, b: Column) -> Column:
    """From two signatures: the words in common may still be 7/10 of all."""
    size = lambda s: s.bitwiseAND(63)
    bits = lambda s: F.shiftrightunsigned(s, 6)
    most = F.least(size(a) - F.bit_count(bits(a).bitwiseAND(F.bitwise_not(bits(b)))), size(b) - F.bit_count(bits(b).bitwiseAND(F.bitwise_not(bits(a)))))
    return (size(a) == FULL) | (size(b) == FULL) | (most * 17 >= (size(a) + size(b)) * 7)


def candidates(a: DataFrame, b: DataFrame, within: bool) -> DataFrame:
    """Distinct (a, b) of classes that share a band key and pass the signatures' bound; ``within``: a and b are the same keys."""
    x = a.select("key", F.col("cid").alias("a"), F.col("s1").alias("a1"), F.col("s2").alias("a2"))
    y = b.select("key", F.col("cid").alias("b"), F.col("s1").alias("b1"), F.col("s2").alias("b2"))
    c = {n: F.col(n) for n in ("a1", "a2", "b1", "b2")}
    test = (may_be_close(c["a1"], c["b1"]) & may_be_close(c["a2"], c["b2"])) | (may_be_close(c["a1"], c["b2"]) & may_be_close(c["a2"], c["b1"]))
    both = x.join(y, (x["key"] == y["key"]) & test & (F.col("a") < F.col("b") if within else F.lit(True)))
    return both.select("a", "b").distinct()


def close(x: Column, y: Column) -> Column:
    """Exact test on two arrays of distinct words."""
    shared = F.size(F.array_intersect(x, y))
    return shared * 17 >= (F.size(x) + F.size(y)) * 7


def hubs(df: DataFrame, key: str) -> DataFrame:
    """(key, k): keys with more than a thousandth of the rows of a written table, and their rows."""
    return df.groupBy(key).agg(F.count("*").alias("k")).filter(F.col("k") > F.lit(max(1000.0, HEAVY_SHARE * df.count())))


def with_texts(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Adds the texts of both classes: a1, a2, b1, b2; classes in very many pairs are salted. ``pairs`` is a written table."""
    l = left.select(F.col("cid").alias("a"), F.col("t1").alias("a1"), F.col("t2").alias("a2"))  # noqa: E741
    r = right.select(F.col("cid").alias("b"), F.col("t1").alias("b1"), F.col("t2").alias("b2"))
    return salted_join(salted_join(pairs, l, ["a"], hubs(pairs, "a"), ["b"]), r, ["b"], hubs(pairs, "b"), ["a"])


def confirmed(texts: DataFrame) -> DataFrame:
    """The pairs that are close by their words, straight or crosswise."""
    t = texts.select("a", "b", *(words(F.col(c)).alias(c) for c in ("a1", "a2", "b1", "b2")))
    c = {n: F.col(n) for n in ("a1", "a2", "b1", "b2")}
    test = (close(c["a1"], c["b1"]) & close(c["a2"], c["b2"])) | (close(c["a1"], c["b2"]) & close(c["a2"], c["b1"]))
    return t.filter(test).select("a", "b")


def same_root(left: DataFrame, right: DataFrame, within: bool) -> DataFrame:
    """(a, b): classes with equal bare forms, straight or crosswise."""
    forms = [F.replace(F.col(t), F.lit(" "), F.lit("")) for t in ("t1", "t2")]
    x = left.select(*ordered_hashes(("r1", "r2"), *forms), F.col("cid").alias("a"))
    y = right.select(*ordered_hashes(("r1", "r2"), *forms), F.col("cid").alias("b"))
    both = x.join(y, ["r1", "r2"])
    return (both.filter("a < b") if within else both).select("a", "b")


def prepared(df: DataFrame, id_col: str, q1: str = "question1", q2: str = "question2") -> tuple[DataFrame, DataFrame]:
    """Keyed rows, and the written table of their classes."""
    rows = keyed(df, id_col, q1, q2)
    return rows, cut(classes(rows))


def with_hashes(reps: DataFrame) -> DataFrame:
    return reps.select("cid", hashed(F.col("t1")).alias("h1"), hashed(F.col("t2")).alias("h2"))


def spread(pairs: DataFrame, side: str, out: str, m: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Replaces the class in ``side`` by all its records, in column ``out``; ``m``: the members of larger classes, a written table.

    Classes with more than a thousandth of the members, or of the rows of ``links`` (a written table with the
    classes in ``side``), are split: members into parts that every row of ``pairs`` meets, rows of ``pairs`` by a hash.
    """
    least = max(1000.0, HEAVY_SHARE * m.count())
    parts = m.filter(F.col("n") > F.lit(least)).groupBy(F.col("cid").alias(side)).agg(F.ceil(F.first("n") / F.lit(least)).cast("int").alias("__parts"))
    if links is not None:
        some = hubs(links, side)
        parts = parts.join(some.select(side, F.ceil(F.col("k") / F.lit(max(1000.0, HEAVY_SHARE * links.count()))).cast("int").alias("__ways")), side, "full")
    else:
        parts = parts.withColumn("__ways", F.lit(1))
    heavy = F.broadcast(parts.select(side, F.coalesce("__parts", F.lit(1)).alias("__parts"), F.coalesce("__ways", F.lit(1)).alias("__ways")))  # 2,000 classes at most
    every = lambda c: F.explode(F.sequence(F.lit(0), F.coalesce(c, F.lit(1)) - 1))
    one = lambda by, c: F.pmod(F.xxhash64(*by), F.coalesce(c, F.lit(1)).cast("long")).cast("int")
    rest = [c for c in pairs.columns if c != side]
    x = pairs.join(heavy, side, "left").select(*pairs.columns, one(rest or [side], F.col("__ways")).alias("__way"), (F.coalesce("__parts", F.lit(1)) > 1).alias("__split"), every(F.col("__parts")).alias("__part"))
    y = m.select(F.col("cid").alias(side), F.col("id").alias("__id")).join(heavy, side, "left").select(side, "__id", one(["__id"], F.col("__parts")).alias("__part"), every(F.col("__ways")).alias("__way"))
    j = x.join(y, [side, "__way", "__part"], "left").filter("NOT __split OR __id IS NOT NULL")
    return j.select(*rest, F.coalesce("__id", side).alias(out))


def within(m: DataFrame, part: int = 2000) -> DataFrame:
    """(x, y), x < y: every two records of a class. A class is cut into parts of about ``part`` records, of which every two meet in a row group of their own."""
    k = F.ceil(F.col("n") / F.lit(part)).cast("int")
    own = F.pmod(F.xxhash64("id"), k.cast("long")).cast("int")
    t = m.select("cid", "id", own.alias("own"), (k - 1).alias("last"))
    x = t.select("cid", F.col("id").alias("x"), F.col("own").alias("i"), F.explode(F.sequence("own", "last")).alias("j"))
    y = t.select("cid", F.col("id").alias("y"), F.col("own").alias("j"), F.explode(F.sequence(F.lit(0), F.col("own"))).alias("i"))
    both = x.join(y, ["cid", "i", "j"]).filter("i != j OR x < y")
    return both.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
