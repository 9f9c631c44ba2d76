"""Duplicates hidden by formatting differences (problem 2).

Merkle-style hashing of nested records: the leaves (questions) are normalised to their bare form and
digested, the digests of the unordered node (the pair) are sorted and digested again; records are
grouped by this root digest and confirmed by comparing the normalised leaves themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinfold.functions.text import bare
from twinfold.operators.skew import HEAVY_SHARE, salted_join
from twinfold.session import cut


def root_digest(leaves: list[Column]) -> Column:
    """Digest of an unordered node: digests of its leaves, sorted, joined and digested."""
    return F.unhex(F.md5(F.array_join(F.array_sort(F.array(*(F.md5(x) for x in leaves))), "")))


def normal(value: Column, kind: T.DataType, digest: bool) -> Column:
    """A nested value's root, bottom-up: its digest, or its canonical text, which is the same for the same values only.

    Leaves are in bare form (null as ''). Structs and maps are unordered nodes: their children, each with its lower-cased field name or
    key, are sorted; arrays keep their order.
    """

    def node(mark: str, children: Column, ordered: bool) -> Column:
        text = F.concat(F.lit(mark + "("), F.array_join(children if ordered else F.array_sort(children), ","), F.lit(")"))
        return F.md5(text) if digest else text

    def leaf(text: Column) -> Column:
        return F.md5(text) if digest else F.concat(F.length(text).cast("string"), F.lit(":"), text)

    if isinstance(kind, T.StructType):
        return node("s", F.array(*(F.concat(leaf(F.lit(f.name.lower())), F.lit("="), normal(value[f.name], f.dataType, digest)) for f in kind.fields)) if kind.fields else F.array().cast("array<string>"), False)
    if isinstance(kind, T.ArrayType):
        return node("a", F.transform(F.coalesce(value, F.array().cast(kind)), lambda x: normal(x, kind.elementType, digest)), True)
    if isinstance(kind, T.MapType):
        entries = F.map_entries(F.coalesce(value, F.map_from_arrays(F.array().cast(T.ArrayType(kind.keyType)), F.array().cast(T.ArrayType(kind.valueType)))))
        return node("m", F.transform(entries, lambda e: F.concat(normal(e["key"], kind.keyType, digest), F.lit("="), normal(e["value"], kind.valueType, digest))), False)
    return leaf(bare(value.cast("string")))


def nested_collapsed(df: DataFrame, id_col: str = "id", fields: tuple[str, ...] | None = None) -> DataFrame:
    """One row per distinct nested record of any schema: (root, keep_id, n_copies); ``fields``: all but the id by default.

    Rows are grouped by root digest and canonical text together, which is the full structural comparison; combined before the
    shuffle. Fields are an unordered node: tables with fields in another order, or names in another case, have equal roots. Null
    and empty values are the same. An empty table gives no rows.
    """
    names = list(fields or [c for c in df.columns if c != id_col])
    kind = T.StructType([df.schema[c] for c in names])
    record = F.struct(*names)
    t = df.select(F.col(id_col).alias("id"), normal(record, kind, True).alias("root"), normal(record, kind, False).alias("text"))
    return t.groupBy("root", "text").agg(F.min("id").alias("keep_id"), F.count("*").alias("n_copies")).drop("text")


def rooted(df: DataFrame, id_col: str = "id", fields: tuple[str, ...] = ("question1", "question2")) -> DataFrame:
    """(id, root, leaves): records with a word in every field; null, empty and wordless ones are left out."""
    leaves = [f"__l{i}" for i in range(len(fields))]
    out = df.select(F.col(id_col).alias("id"), *(bare(F.col(f)).alias(n) for f, n in zip(fields, leaves)))
    for n in leaves:
        out = out.filter(F.col(n) != "")
    return out.select("id", root_digest([F.col(n) for n in leaves]).alias("root"), F.array_join(F.array_sort(F.array(*leaves)), "\x1f").alias("leaves"))


def collapsed(df: DataFrame, id_col: str = "id", fields: tuple[str, ...] = ("question1", "question2")) -> DataFrame:
    """One row per distinct record: (root, leaves, keep_id, n_copies); keep_id is the smallest id.

    Grouping by root and leaves is at once the grouping by digest and the full structural comparison:
    records with equal digests but different leaves stay apart. Rows are combined before the shuffle,
    so a record with very many copies costs one row per task. An empty table gives no rows.
    """
    return rooted(df, id_col, fields).groupBy("root", "leaves").agg(F.min("id").alias("keep_id"), F.count("*").alias("n_copies"))


def copies(df: DataFrame, id_col: str = "id", fields: tuple[str, ...] = ("question1", "question2")) -> DataFrame:
    """(keep_id, id, n_copies): every record that is a copy of one with a smaller id."""
    rows = rooted(df, id_col, fields)
    sets = cut(collapsed(df, id_col, fields).filter("n_copies > 1"))  # read twice
    heavy = sets.filter(F.col("n_copies") > F.lit(max(1000.0, HEAVY_SHARE * df.count()))).select("root")
    joined = salted_join(rows, sets.withColumnRenamed("leaves", "kept"), ["root"], heavy, ["id"])
    return joined.filter("leaves = kept and id != keep_id").select("keep_id", "id", "n_copies")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return copies(spark.read.parquet(f"{d}/train.parquet")).select("keep_id", "id")


def p2_records(spark: SparkSession, d: str) -> DataFrame:
    """One row per distinct record with its number of copies."""
    return collapsed(spark.read.parquet(f"{d}/train.parquet")).select("keep_id", "n_copies")


_BARE = r"regexp_replace(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}]+', '', 'g')"
_ROWS = f"r AS (SELECT id, {_BARE.format('question1')} AS a, {_BARE.format('question2')} AS b FROM train), g AS (SELECT id, least(a, b) AS lo, greatest(a, b) AS hi FROM r WHERE a <> '' AND b <> '')"
SQL = {
    "p2_found": f"WITH {_ROWS}, m AS (SELECT lo, hi, min(id) AS keep_id FROM g GROUP BY 1, 2) SELECT m.keep_id, g.id FROM g JOIN m USING (lo, hi) WHERE g.id <> m.keep_id",
    "p2_records": f"WITH {_ROWS} SELECT min(id) AS keep_id, count(*) AS n_copies FROM g GROUP BY lo, hi",
}
QUERIES = {"p2_found": p2_found, "p2_records": p2_records}
