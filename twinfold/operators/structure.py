"""Topics, spans, hierarchies, parse-tree strings and stems."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.operators.pairs import PAIR_SQL, pair_rows

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def spans_overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Half-open spans share a position."""
    return (s1 < e2) & (s2 < e1)


def span_degree(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Number of positions that two half-open spans share."""
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


#: Dependency types and the type above.
ABOVE = {
    above_type: above
    for above, types in {
        "": "dep",
        "dep": "aux arg cc conj expl mod parataxis punct ref sdep",
        "aux": "auxpass cop",
        "arg": "agent comp subj",
        "comp": "acomp attr ccomp xcomp compl obj mark rel",
        "obj": "dobj iobj pobj",
        "subj": "nsubj csubj",
        "nsubj": "nsubjpass",
        "mod": "abbrev amod appos advcl purpcl det predet preconj infmod partmod advmod rcmod quantmod tmod measure nn num number prep poss possessive prt",
        "advmod": "neg",
        "sdep": "xsubj",
    }.items()
    for above_type in types.split()
}


def isa(above: dict[str, str]) -> dict[str, set[str]]:
    """Every type with itself and all types above it."""
    out = {}
    for t in above:
        seen, at = [], t
        while at and at not in seen:
            seen.append(at)
            at = above.get(at, "")
        out[t] = set(seen)
    return out


@query("WITH RECURSIVE t(a, b) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in ABOVE.items() if b) + "), c(a, b) AS (SELECT a, b FROM t UNION SELECT c.a, t.b FROM c JOIN t ON t.a = c.b) SELECT a AS kind, b AS ancestor FROM c")
def type_ancestors(spark: SparkSession, d: str) -> DataFrame:
    """Closure of the type hierarchy (a fixed table)."""
    return spark.createDataFrame([(a, b) for a, bs in isa(ABOVE).items() for b in sorted(bs) if a != b], "kind string, ancestor string")


_TREE = "concat('(', replace(replace(replace(lower(q1), '(', ''), ')', ''), ',', ' ( ) '), ')')"


@query(f"""WITH {PAIR_SQL}, t AS (SELECT id, {_TREE} AS t FROM p), x AS (SELECT id, t, unnest(range(1, length(t) + 1)) AS i FROM t), c AS (SELECT id, i, CASE substr(t, i, 1) WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END AS s FROM x WHERE substr(t, i, 1) IN ('(', ')')), h AS (SELECT id, sum(s) OVER (PARTITION BY id ORDER BY i) AS depth, s FROM c) SELECT id, CAST(max(depth) AS INT) AS height, CAST(sum(CAST(s = 1 AS INT)) AS INT) AS nodes FROM h GROUP BY id""")
def tree_height(spark: SparkSession, d: str) -> DataFrame:
    """Height and number of nodes of a bracketed tree string; here a question whose commas become nodes."""
    t = pair_rows(spark, d).select("id", F.expr(_TREE).alias("t"))
    return t.select("id", height(F.col("t")).alias("height"), (F.length("t") - F.length(F.replace(F.col("t"), F.lit("("), F.lit("")))).cast("int").alias("nodes"))


def height(tree: Column) -> Column:
    """Deepest nesting of the brackets of a tree string, in one pass over the brackets."""
    brackets = F.filter(F.split(F.regexp_replace(tree, r"[^()]", ""), ""), lambda x: x != "")
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("top"))
    step = lambda s, x: F.struct((s["at"] + F.when(x == "(", 1).otherwise(-1)).alias("at"), F.greatest(s["top"], s["at"] + F.when(x == "(", 1).otherwise(-1)).alias("top"))
    return F.aggregate(brackets, zero, step, lambda s: s["top"])


def own_topics(spark: SparkSession, d: str) -> DataFrame:
    """(id, topic): the first of the 30 most frequent longer shared words that both questions have, or null."""
    df = pair_rows(spark, d).select("id", F.array_intersect("a", "b").alias("both"))
    top = df.select(F.explode("both").alias("w")).filter(F.length("w") > 4).groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(30)
    keys = F.broadcast(top.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("r"), "w"))).alias("keys")))  # one row of 30 words
    return df.crossJoin(keys).select("id", F.get(F.filter("keys", lambda k: F.array_contains("both", k["w"])), F.lit(0))["w"].alias("topic"))


class Porter:
    """The stemmer of Porter (1980), for words of lower-case letters; words of one or two letters stay."""

    #: Endings of the second, third and fourth step, and what replaces them.
    SECOND = dict(ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", abli="able", alli="al", entli="ent", eli="e", ousli="ous", ization="ize", ation="ate", ator="ate", alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble")
    THIRD = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
    FOURTH = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()

    @staticmethod
    def shape(word: str) -> str:
        """c and v for every letter; y is a vowel behind a consonant."""
        out = ""
        for i, c in enumerate(word):
            out += "v" if c in "aeiou" or (c == "y" and i and out[-1] == "c") else "c"
        return out

    @classmethod
    def measure(cls, stem: str) -> int:
        """Number of vowels with a consonant behind them, runs counted once."""
        return len(re.findall("v+c+", cls.shape(stem)))

    @classmethod
    def short(cls, stem: str) -> bool:
        """Ends with consonant, vowel and a consonant that isn't w, x or y."""
        return cls.shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"

    @classmethod
    def ended(cls, word: str, ends: list[str]) -> str | None:
        """The longest of the endings that the word has."""
        return max((e for e in ends if word.endswith(e)), key=len, default=None)

    @classmethod
    def stem(cls, word: str) -> str:
        if len(word) <= 2:
            return word
        if word.endswith(("sses", "ies")):
            word = word[:-2]
        elif word.endswith("s") and not word.endswith("ss"):
            word = word[:-1]
        if word.endswith("eed"):
            if cls.measure(word[:-3]) > 0:
                word = word[:-1]
        elif (e := cls.ended(word, ["ed", "ing"])) and "v" in cls.shape(word[: -len(e)]):
            word = word[: -len(e)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif len(word) > 1 and word[-1] == word[-2] and cls.shape(word)[-1] == "c" and word[-1] not in "lsz":
                word = word[:-1]
            elif cls.measure(word) == 1 and cls.short(word):
                word += "e"
        if word.endswith("y") and "v" in cls.shape(word[:-1]):
            word = word[:-1] + "i"
        for ends in (cls.SECOND, cls.THIRD):
            if (e := cls.ended(word, list(ends))) and cls.measure(word[: -len(e)]) > 0:
                word = word[: -len(e)] + ends[e]
        if (e := cls.ended(word, cls.FOURTH)) and cls.measure(word[: -len(e)]) > 1 and (e != "ion" or word[-4:-3] in ("s", "t")):
            word = word[: -len(e)]
        if word.endswith("e") and (cls.measure(word[:-1]) > 1 or (cls.measure(word[:-1]) == 1 and not cls.short(word[:-1]))):
            word = word[:-1]
        if word.endswith("ll") and cls.measure(word) > 1:
            word = word[:-1]
        return word


def stem(word: str) -> str:
    """Porter stem of a word in lower case; words with other letters than a to z stay."""
    return Porter.stem(word) if word.isascii() and word.isalpha() else word


@query()
def pair_stems(spark: SparkSession, d: str) -> DataFrame:
    """Porter stems of both questions' words (anything but letters and digits parts them); each distinct word of a batch is stemmed once."""

    def run(batches):
        for pdf in batches:
            known: dict[str, str] = {}

            def of(ws):
                return " ".join(known[w] if w in known else known.setdefault(w, stem(w)) for w in ws)

            yield pd.DataFrame({"id": pdf["id"], "stem1": [of(x) for x in pdf["a"]], "stem2": [of(x) for x in pdf["b"]]})

    words = lambda c: F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z0-9]", " "), " "), lambda w: w != "")
    return pair_rows(spark, d).select("id", words(F.col("q1")).alias("a"), words(F.col("q2")).alias("b")).mapInPandas(run, "id long, stem1 string, stem2 string")
