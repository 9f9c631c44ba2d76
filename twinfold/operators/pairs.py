"""Scalar features of question pairs: one projection per bundle, inside whole-stage code generation.

Every feature is given as an expression over ``pair_rows``: a and b are the cleaned tokens of the two
questions, q1 and q2 their texts (null as ''). Ratios with an empty denominator are 0.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.functions.text import clean_tokens

#: Stop words of the ratio features.
STOPS = (
    "the a an and but if or because as what which this that these those then just so than such both through about for is of "
    "while during to whats how why when where who whom whose can could will would should do does did are was were be been i you "
    "he she it we they me my your in on at by with from not no"
).split()
#: Question categories by first word.
CATEGORIES = "what how why when where which who is are can do does should if".split()


def pair_rows(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/train.parquet")
    q = [F.coalesce(F.col(c), F.lit("")) for c in ("question1", "question2")]
    return t.select("id", q[0].alias("q1"), q[1].alias("q2"), clean_tokens(q[0]).alias("a"), clean_tokens(q[1]).alias("b"), F.col("is_duplicate").alias("y"))


_PUNCT = string.punctuation.replace("'", "''")
_TOK = "list_filter(regexp_split_to_array(translate(lower(coalesce({c}, '')), '" + _PUNCT + "', ''), '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '')"
PAIR_SQL = (
    f"p AS (SELECT id, coalesce(question1, '') AS q1, coalesce(question2, '') AS q2, {_TOK.replace('{c}', 'question1')} AS a, "
    f"{_TOK.replace('{c}', 'question2')} AS b, is_duplicate AS y FROM train)"
)


def _ratio(x: str, y: str) -> str:
    return f"round(CASE WHEN ({y}) <> 0 THEN CAST(({x}) AS DOUBLE) / ({y}) ELSE 0.0 END, 6)"


def _both(text: str) -> tuple[str, str]:
    """An expression in the common notation: for Spark and for DuckDB.

    Common: SIZE UNIQ AND_ OR_ FILTER TRANSFORM HAS SUMD are functions, ``\\v: e`` is a function of v.
    """
    import re

    spark, duck = text, text
    for name, s, k in (
        ("SIZE", "size", "len"),
        ("UNIQ", "array_distinct", "list_distinct"),
        ("AND_", "array_intersect", "list_intersect"),
        ("FILTER", "filter", "list_filter"),
        ("TRANSFORM", "transform", "list_transform"),
        ("HAS", "array_contains", "list_contains"),
        ("JOIN", "array_join", "array_to_string"),
        ("SORT", "array_sort", "list_sort"),
        ("MAXL", "array_max", "list_max"),
        ("MINL", "array_min", "list_min"),
    ):
        spark = re.sub(rf"\b{name}\(", f"{s}(", spark)
        duck = re.sub(rf"\b{name}\(", f"{k}(", duck)
    spark = re.sub(r"\\(\w+): ", r"\1 -> ", spark)
    duck = re.sub(r"\\(\w+): ", r"lambda \1: ", duck)
    return spark, duck


QUERIES, SQL = {}, {}


def _bundle(name: str, features: dict[str, str | tuple[str, str]], pre: dict[str, str | tuple[str, str]] | None = None, keys: tuple[str, ...] = ("id",)) -> None:
    """Registers a query: columns ``features`` over pair_rows, with the helper columns ``pre`` before."""
    steps = [{k: v if isinstance(v, tuple) else _both(v) for k, v in part.items()} for part in (pre or {}, features)]

    def run(spark: SparkSession, d: str) -> DataFrame:
        df = pair_rows(spark, d)
        if steps[0]:
            df = df.select("*", *(F.expr(v[0]).alias(k) for k, v in steps[0].items()))
        return df.select(*keys, *(F.expr(v[0]).alias(k) for k, v in steps[1].items()))

    helper = ", ".join(f"{v[1]} AS {k}" for k, v in steps[0].items())
    source = f"{PAIR_SQL}, h AS (SELECT *, {helper} FROM p)" if helper else PAIR_SQL
    QUERIES[name] = run
    SQL[name] = f"WITH {source} SELECT {', '.join(keys)}, {', '.join(f'{v[1]} AS {k}' for k, v in steps[1].items())} FROM {'h' if helper else 'p'}"


def _set_features(x: str, y: str) -> dict[str, str]:
    both = f"SIZE(AND_({x}, {y}))"
    u, v = f"SIZE(UNIQ({x}))", f"SIZE(UNIQ({y}))"
    return {
        "n1": f"CAST(SIZE({x}) AS INT)",
        "n2": f"CAST(SIZE({y}) AS INT)",
        "u1": f"CAST({u} AS INT)",
        "u2": f"CAST({v} AS INT)",
        "unique_ratio1": _ratio(u, f"SIZE({x})"),
        "unique_ratio2": _ratio(v, f"SIZE({y})"),
        "overlap": f"CAST({both} AS INT)",
        "overlap_ratio": _ratio(both, u),
        "jaccard_distance": f"round(CASE WHEN {u} + {v} > 0 THEN 1 - CAST({both} AS DOUBLE) / ({u} + {v} - {both}) ELSE 0.0 END, 6)",
        "dice": _ratio(f"2 * {both}", f"{u} + {v}"),
        "sorensen_distance": f"round(CASE WHEN {u} + {v} > 0 THEN 1 - CAST(2 * {both} AS DOUBLE) / ({u} + {v}) ELSE 0.0 END, 6)",
    }


def _digit(c: str) -> tuple[str, str]:
    return (f"CAST(size(filter({c}, t -> t RLIKE '^[0-9]+$')) AS INT)", f"CAST(len(list_filter({c}, lambda t: regexp_full_match(t, '[0-9]+'))) AS INT)")


_bundle("pair_set_overlap", _set_features("a", "b") | {"digits1": _digit("a"), "digits2": _digit("b")})
_bundle(
    "pair_overlap_minmax",
    {
        "n_min": "CAST(least(SIZE(a), SIZE(b)) AS INT)",
        "n_max": "CAST(greatest(SIZE(a), SIZE(b)) AS INT)",
        "u_min": "CAST(least(SIZE(UNIQ(a)), SIZE(UNIQ(b))) AS INT)",
        "u_max": "CAST(greatest(SIZE(UNIQ(a)), SIZE(UNIQ(b))) AS INT)",
        "n_diff": "CAST(abs(SIZE(a) - SIZE(b)) AS INT)",
        "n_ratio": _ratio("least(SIZE(a), SIZE(b))", "greatest(SIZE(a), SIZE(b))"),
        "overlap_min": _ratio("SIZE(AND_(a, b))", "greatest(SIZE(UNIQ(a)), SIZE(UNIQ(b)))"),
        "overlap_max": _ratio("SIZE(AND_(a, b))", "least(SIZE(UNIQ(a)), SIZE(UNIQ(b)))"),
    },
)


def grams(c: str, n: int) -> tuple[str, str]:
    """n-grams joined by '_'; rows shorter than n fall back to the next shorter grams, down to the tokens themselves."""
    spark, duck = c, c
    for k in range(2, n + 1):
        spark = f"CASE WHEN size({c}) < {k} THEN {spark} ELSE transform(sequence(1, size({c}) - {k - 1}), i -> array_join(slice({c}, i, {k}), '_')) END"
        duck = f"CASE WHEN len({c}) < {k} THEN {duck} ELSE list_transform(range(1, len({c}) - {k - 2}), lambda i: array_to_string({c}[i:i + {k - 1}], '_')) END"
    return spark, duck


_bundle("pair_bigram_overlap", _set_features("ga", "gb"), {"ga": grams("a", 2), "gb": grams("b", 2)})


def _terms(c: str, skip: int | None) -> tuple[str, str]:
    """Ordered word pairs, at most ``skip`` words apart (any distance if None); one token gives itself."""
    far = f"size({c})" if skip is None else f"least(size({c}), i + {skip + 1})"
    far_d = f"len({c})" if skip is None else f"least(len({c}), i + {skip + 1})"
    spark = f"CASE WHEN size({c}) < 2 THEN {c} ELSE flatten(transform(sequence(1, size({c}) - 1), i -> transform(slice({c}, i + 1, {far} - i), w -> concat(element_at({c}, i), '_', w)))) END"
    duck = f"CASE WHEN len({c}) < 2 THEN {c} ELSE flatten(list_transform(range(1, len({c})), lambda i: list_transform({c}[i + 1:{far_d}], lambda w: concat({c}[i], '_', w)))) END"
    return spark, duck


_bundle(
    "pair_ngrams",
    {f"{n}{s}": (f"array_join({g[0]}, ' ')", f"array_to_string({g[1]}, ' ')") for s, c in (("1", "a"), ("2", "b")) for n, g in (("trigram", grams(c, 3)), ("fourgram", grams(c, 4)), ("skip_bigram", _terms(c, 1)))},
)
_bundle(
    "pair_biterms",
    {"shared_biterms": "CAST(SIZE(AND_(ta, tb)) AS INT)", "biterms1": "CAST(SIZE(ta) AS INT)", "biterms2": "CAST(SIZE(tb) AS INT)"},
    {"ta": _terms("a", None), "tb": _terms("b", None)},
)
_bundle(
    "pair_ngram_indicator",
    {"indicator1": "JOIN(TRANSFORM(a, \\w: CASE WHEN HAS(b, w) THEN '1' ELSE '0' END), '')", "indicator2": "JOIN(TRANSFORM(b, \\w: CASE WHEN HAS(a, w) THEN '1' ELSE '0' END), '')"},
)
_bundle(
    "pair_distinct_terms",
    {"distinct1": "JOIN(FILTER(a, \\w: NOT HAS(b, w)), ' ')", "distinct2": "JOIN(FILTER(b, \\w: NOT HAS(a, w)), ' ')", "common": "JOIN(SORT(AND_(a, b)), ' ')"},
)
_bundle(
    "pair_cooccurrence",
    {
        "crossed": ("array_join(flatten(transform(a, x -> transform(b, y -> concat(x, '__', y)))), ' ')", "array_to_string(flatten(list_transform(a, lambda x: list_transform(b, lambda y: concat(x, '__', y)))), ' ')"),
        "n_unordered": (
            "CAST(size(array_distinct(flatten(transform(a, x -> transform(b, y -> concat(least(x, y), '__', greatest(x, y))))))) AS INT)",
            "CAST(len(list_distinct(flatten(list_transform(a, lambda x: list_transform(b, lambda y: concat(least(x, y), '__', greatest(x, y))))))) AS INT)",
        ),
    },
)


def _chars(c: str) -> tuple[str, str]:
    spark = f"CAST(size(array_distinct(filter(split(regexp_replace({c}, '[ \\t\\n\\r\\f\\x0B]', ''), ''), x -> x <> ''))) AS INT)"
    duck = f"CAST(len(list_distinct(list_filter(string_split(regexp_replace({c}, '[ \\t\\n\\r\\f\\x0B]', '', 'g'), ''), lambda x: x <> ''))) AS INT)"
    return spark.replace("\\", "\\\\"), duck


def _capitals(c: str) -> tuple[str, str]:
    return f"CAST(length(regexp_replace({c}, '[^A-Z]', '')) AS INT)", f"CAST(length(regexp_replace({c}, '[^A-Z]', '', 'g')) AS INT)"


_word_chars = "length(JOIN({c}, ''))"
_bundle(
    "pair_lengths",
    {
        "chars1": "CAST(length(q1) AS INT)",
        "chars2": "CAST(length(q2) AS INT)",
        "chars_diff": "CAST(abs(length(q1) - length(q2)) AS INT)",
        "distinct_chars1": _chars("q1"),
        "distinct_chars2": _chars("q2"),
        "words_diff": "CAST(abs(SIZE(a) - SIZE(b)) AS INT)",
        "capitals1": _capitals("q1"),
        "capitals2": _capitals("q2"),
        "word_length1": _ratio(_word_chars.format(c="a"), "SIZE(a)"),
        "word_length2": _ratio(_word_chars.format(c="b"), "SIZE(b)"),
    },
)
_stops = (f"array({', '.join(repr(s) for s in STOPS)})", f"[{', '.join(repr(s) for s in STOPS)}]")


def _stop(text: str) -> tuple[str, str]:
    s, k = _both(text)
    return s.replace("STOPLIST", _stops[0]), k.replace("STOPLIST", _stops[1])


_bundle(
    "pair_stop_ratio",
    {"stops1": _stop("CAST(SIZE(FILTER(a, \\w: HAS(STOPLIST, w))) AS INT)"), "stops2": _stop("CAST(SIZE(FILTER(b, \\w: HAS(STOPLIST, w))) AS INT)")}
    | {"stop_ratio1": _stop(_ratio("SIZE(FILTER(a, \\w: HAS(STOPLIST, w)))", "SIZE(a)")), "stop_ratio2": _stop(_ratio("SIZE(FILTER(b, \\w: HAS(STOPLIST, w)))", "SIZE(b)"))},
)
_content = {"ca": _stop("FILTER(a, \\w: NOT HAS(STOPLIST, w))"), "cb": _stop("FILTER(b, \\w: NOT HAS(STOPLIST, w))")}
_bundle(
    "pair_word_match_share",
    {
        "word_match": _ratio("2 * SIZE(AND_(ca, cb))", "SIZE(UNIQ(ca)) + SIZE(UNIQ(cb))"),
        "matches": "CAST(SIZE(FILTER(ca, \\w: HAS(cb, w))) + SIZE(FILTER(cb, \\w: HAS(ca, w))) AS INT)",
        "share": _ratio("SIZE(FILTER(ca, \\w: HAS(cb, w))) + SIZE(FILTER(cb, \\w: HAS(ca, w)))", "SIZE(ca) + SIZE(cb)"),
    },
    _content,
)
_bundle(
    "pair_public_bundle",
    {
        "common_words": "CAST(SIZE(AND_(a, b)) AS INT)",
        "total_unique": "CAST(SIZE(UNIQ(concat(a, b))) AS INT)",
        "total_unique_content": "CAST(SIZE(UNIQ(concat(ca, cb))) AS INT)",
        "wc_diff": "CAST(abs(SIZE(a) - SIZE(b)) AS INT)",
        "wc_ratio": _ratio("SIZE(b)", "SIZE(a)"),
        "wc_diff_unique": "CAST(abs(SIZE(UNIQ(a)) - SIZE(UNIQ(b))) AS INT)",
        "wc_ratio_unique": _ratio("SIZE(UNIQ(b))", "SIZE(UNIQ(a))"),
        "wc_diff_content": "CAST(abs(SIZE(UNIQ(ca)) - SIZE(UNIQ(cb))) AS INT)",
        "same_start": ("CAST(size(a) > 0 AND size(b) > 0 AND get(a, 0) = get(b, 0) AS INT)", "CAST(len(a) > 0 AND len(b) > 0 AND a[1] = b[1] AS INT)"),
        "char_diff": "CAST(abs(length(JOIN(a, '')) - length(JOIN(b, ''))) AS INT)",
        "char_ratio": _ratio("length(JOIN(b, ''))", "length(JOIN(a, ''))"),
        "char_diff_unique": "CAST(abs(length(JOIN(UNIQ(ca), '')) - length(JOIN(UNIQ(cb), ''))) AS INT)",
    },
    _content,
)


def _same_places(x: str, y: str) -> tuple[str, str]:
    return (
        f"size(filter(zip_with({x}, {y}, (s, t) -> coalesce(s = t, false)), z -> z))",
        f"len(list_filter(range(1, least(len({x}), len({y})) + 1), lambda i: {x}[i] = {y}[i]))",
    )


def _pair_of(f, *xs: tuple[str, str]) -> tuple[str, str]:
    return f(*(x[0] for x in xs)), f(*(x[1] for x in xs))


_bundle(
    "pair_word_share",
    {
        "hamming": _pair_of(lambda h, n: _ratio(h, n), _same_places("a", "b"), _both("greatest(SIZE(a), SIZE(b))")),
        "count_share": _ratio("SIZE(AND_(ca, cb))", "SIZE(UNIQ(concat(ca, cb)))"),
        "stops1_ratio": _ratio("SIZE(a) - SIZE(ca)", "SIZE(ca)"),
        "stops2_ratio": _ratio("SIZE(b) - SIZE(cb)", "SIZE(cb)"),
        "bigram_share": _ratio("SIZE(AND_(ga, gb))", "SIZE(UNIQ(concat(ga, gb)))"),
    },
    _content | {"ga": grams("a", 2), "gb": grams("b", 2)},
)


def _marks(c: str, m: str) -> str:
    return f"CAST(length({c}) - length(replace({c}, '{m}', '')) AS INT)"


_bundle(
    "pair_marks",
    {f"{n}_{k}": f(_marks("q1", m), _marks("q2", m)) for n, m in (("question", "?"), ("comma", ","), ("dot", ".")) for k, f in (("max", lambda x, y: f"greatest({x}, {y})"), ("min", lambda x, y: f"least({x}, {y})"), ("diff", lambda x, y: f"CAST(abs({x} - {y}) AS INT)"), ("ratio", lambda x, y: _ratio(f"least({x}, {y})", f"greatest({x}, {y})")))},
)


def _numbers(c: str) -> tuple[str, str]:
    return f"regexp_extract_all({c}, '[0-9]+', 0)", f"regexp_extract_all({c}, '[0-9]+')"


_bundle(
    "pair_numbers",
    {"numbers1": "CAST(SIZE(na) AS INT)", "numbers2": "CAST(SIZE(nb) AS INT)", "numbers_equal": "CAST(na = nb AS INT)", "shared_numbers": "CAST(SIZE(AND_(na, nb)) AS INT)"},
    {"na": _numbers("q1"), "nb": _numbers("q2")},
)


def _places(x: str, y: str) -> tuple[str, str]:
    """1-based positions in x of tokens that y has."""
    return (f"filter(transform({x}, (w, i) -> CASE WHEN array_contains({y}, w) THEN i + 1 END), z -> z IS NOT NULL)", f"list_filter(list_transform({x}, lambda w, i: CASE WHEN list_contains({y}, w) THEN i END), lambda z: z IS NOT NULL)")


def list_stats(c: str, name: str) -> dict[str, tuple[str, str]]:
    """min, max, mean, population deviation, and the element in the middle as it stands (not a true median); 0 for an empty list."""
    total = (f"aggregate({c}, CAST(0 AS DOUBLE), (s, z) -> s + z)", f"coalesce(list_sum({c}), 0)")
    squares = (f"aggregate({c}, CAST(0 AS DOUBLE), (s, z) -> s + z * z)", f"coalesce(list_sum(list_transform({c}, lambda z: CAST(z AS DOUBLE) * z)), 0)")
    size = _both(f"SIZE({c})")
    return {
        f"{name}_min": _both(f"CAST(coalesce(MINL({c}), 0) AS DOUBLE)"),
        f"{name}_max": _both(f"CAST(coalesce(MAXL({c}), 0) AS DOUBLE)"),
        f"{name}_mean": _pair_of(_ratio, total, size),
        f"{name}_std": _pair_of(lambda t, q, n: f"round(CASE WHEN {n} > 0 THEN sqrt(greatest(CAST({q} AS DOUBLE) / {n} - power(CAST({t} AS DOUBLE) / {n}, 2), 0.0)) ELSE 0.0 END, 6)", total, squares, size),
        f"{name}_mid": (f"CAST(coalesce(get({c}, CAST(floor(size({c}) / 2) AS INT)), 0) AS DOUBLE)", f"CAST(coalesce({c}[len({c}) // 2 + 1], 0) AS DOUBLE)"),
    }


_bundle("pair_positions", list_stats("pa", "pos1") | list_stats("pb", "pos2"), {"pa": _places("a", "b"), "pb": _places("b", "a")})


def _shifts(x: str, y: str) -> tuple[str, str]:
    return (
        f"filter(transform({x}, (w, i) -> CASE WHEN array_contains({y}, w) THEN abs(i + 1 - CAST(array_position({y}, w) AS INT)) END), z -> z IS NOT NULL)",
        f"list_filter(list_transform({x}, lambda w, i: CASE WHEN list_contains({y}, w) THEN abs(i - list_position({y}, w)) END), lambda z: z IS NOT NULL)",
    )


_bundle("pair_displacement", list_stats("da", "shift12") | list_stats("db", "shift21"), {"da": _shifts("a", "b"), "db": _shifts("b", "a")})
_bundle(
    "pair_edit_distance",
    {"edit": "CAST(levenshtein(s, t) AS INT)", "edit_ratio": _ratio("levenshtein(s, t)", "greatest(length(s), length(t))")},
    {"s": ("regexp_replace(lower(q1), '[^a-z0-9 ]', '')", "regexp_replace(lower(q1), '[^a-z0-9 ]', '', 'g')"), "t": ("regexp_replace(lower(q2), '[^a-z0-9 ]', '')", "regexp_replace(lower(q2), '[^a-z0-9 ]', '', 'g')")},
)


def _category(c: str) -> str:
    return "CASE " + " ".join(f"WHEN lower({c}) LIKE '{w}%' THEN '{w}'" for w in CATEGORIES) + " ELSE 'other' END"


_bundle("pair_category", {"category1": _category("q1"), "category2": _category("q2"), "same_category": f"CAST({_category('q1')} = {_category('q2')} AS INT)"})


def _letters(c: str) -> tuple[str, str]:
    return f"regexp_replace(lower({c}), '[^a-z0-9]', '')", f"regexp_replace(lower({c}), '[^a-z0-9]', '', 'g')"


def _smoothed(c: str, x: str) -> str:
    return f"((length({c}) - length(replace({c}, '{x}', '')) + 1e0) / (length({c}) + 36e0))"


def _bins(f) -> str:
    return " + ".join(f(x) for x in string.ascii_lowercase + string.digits)


_bundle(
    "char_distribution",
    {
        "kl": "round(" + _bins(lambda x: f"{_smoothed('s', x)} * ln({_smoothed('s', x)} / {_smoothed('t', x)})") + ", 6)",
        "cosine": "round((" + _bins(lambda x: f"{_smoothed('s', x)} * {_smoothed('t', x)}") + ") / sqrt((" + _bins(lambda x: f"{_smoothed('s', x)} * {_smoothed('s', x)}") + ") * (" + _bins(lambda x: f"{_smoothed('t', x)} * {_smoothed('t', x)}") + ")), 6)",
        "letter_ratio1": _ratio("length(s)", "length(q1)"),
    },
    {"s": _letters("q1"), "t": _letters("q2")},
)
#: Contractions and short forms, replaced in this order.
REWRITES = [
    ("what's", "what is"), ("can't", "cannot"), ("won't", "will not"), ("n't", " not"), ("i'm", "i am"), ("'re", " are"), ("'ve", " have"), ("'d", " would"), ("'ll", " will"),
    ("'s", " "), ("e-mail", "email"), ("u.s.", "america"), ("&", " and "), ("%", " percent "), ("$", " dollar "), ("+", " plus "), ("=", " equal "),
]


def _cleaned(c: str) -> tuple[str, str]:
    x = f"lower({c})"
    for old, new in REWRITES:
        x = "replace({}, '{}', '{}')".format(x, old.replace("'", "''"), new.replace("'", "''"))
    spark, duck = x, x
    for pattern, new in ((r"([0-9]+)k\b", r"{1}000"), (r"[^a-z0-9 ]", " "), (r" +", " ")):
        spark = f"regexp_replace({spark}, '{pattern}', '{new.replace('{1}', '$1')}')".replace("\\b", "\\\\b")
        duck = f"regexp_replace({duck}, '{pattern}', '{new.replace('{1}', chr(92) + '1')}', 'g')"
    return f"trim({spark})", f"trim({duck})"


_bundle("text_clean_chain", {"clean1": _cleaned("q1"), "clean2": _cleaned("q2"), "bare_letters1": ("regexp_replace(lower(q1), '[^a-z]', '')", "regexp_replace(lower(q1), '[^a-z]', '', 'g')")})


def _char_grams(c: str, n: int) -> tuple[str, str]:
    s = f"CASE WHEN length({c}) < {n} THEN array({c}) ELSE transform(sequence(1, length({c}) - {n - 1}), i -> substring({c}, i, {n})) END"
    k = f"CASE WHEN length({c}) < {n} THEN [{c}] ELSE list_transform(range(1, length({c}) - {n - 2}), lambda i: substring({c}, i, {n})) END"
    return s, k


_bundle(
    "pair_char_grams",
    {"shared": "CAST(SIZE(AND_(cx, cy)) AS INT)", "grams1": "CAST(SIZE(cx) AS INT)", "jaccard": _ratio("SIZE(AND_(cx, cy))", "SIZE(UNIQ(concat(cx, cy)))")},
    {"cx": _char_grams("lower(q1)", 3), "cy": _char_grams("lower(q2)", 3)},
)
#: Accented letters and the plain ones that replace them.
ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY")
_bundle("accent_folding", {"plain1": f"translate(q1, '{ACCENTS[0]}', '{ACCENTS[1]}')", "plain2": f"translate(q2, '{ACCENTS[0]}', '{ACCENTS[1]}')"})
