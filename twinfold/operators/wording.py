"""Cleaning, tokenising and tagging of texts, higher grams and terms, and comparisons of sets of tags or names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.operators.pairs import PAIR_SQL, QUERIES, SQL, STOPS, _both, _bundle, _pair_of, _ratio, _terms, grams, pair_rows

_WS = r"[ \t\n\r\f\x0B]+"

#: Contractions, misspellings and joined letters, replaced in this order.
ABBREVIATIONS = [
    ("what's", "what is"), ("what're", "what are"), ("who's", "who is"), ("who're", "who are"), ("where's", "where is"), ("where're", "where are"), ("when's", "when is"), ("when're", "when are"),
    ("how's", "how is"), ("how're", "how are"), ("why's", "why is"), ("why're", "why are"),
    ("i'm", "i am"), ("we're", "we are"), ("you're", "you are"), ("they're", "they are"), ("it's", "it is"), ("he's", "he is"), ("she's", "she is"), ("that's", "that is"), ("there's", "there is"), ("there're", "there are"),
    ("i've", "i have"), ("we've", "we have"), ("you've", "you have"), ("they've", "they have"), ("who've", "who have"), ("would've", "would have"), ("not've", "not have"),
    ("i'll", "i will"), ("we'll", "we will"), ("you'll", "you will"), ("he'll", "he will"), ("she'll", "she will"), ("it'll", "it will"), ("they'll", "they will"),
    ("isn't", "is not"), ("wasn't", "was not"), ("aren't", "are not"), ("weren't", "were not"), ("can't", "can not"), ("couldn't", "could not"), ("don't", "do not"), ("didn't", "did not"), ("shouldn't", "should not"),
    ("wouldn't", "would not"), ("doesn't", "does not"), ("haven't", "have not"), ("hasn't", "has not"), ("hadn't", "had not"), ("won't", "will not"), ("mustn't", "must not"),
    ("e-mail", "email"), ("imrovement", "improvement"), ("intial", "initial"), ("motorolla", "motorola"), ("programing", "programming"), ("quikly", "quickly"), ("demonitization", "demonetization"),
    ("60k", "60000"), (" 9 11 ", "911"), (" u s ", "american"), ("b g", "bg"), ("e g", "eg"),
]
#: Patterns and what replaces them, in this order, after lower case and single blanks.
CLEANING = [
    (r"[^A-Za-z0-9^,!.\/'+-=]", " "), ("what's", "what is "), ("'s", " "), ("'ve", " have "), ("can't", "cannot "), ("n't", " not "), ("i'm", "i am "), ("'re", " are "), ("'d", " would "), ("'ll", " will "),
    (",", " "), (r"\.", " "), ("!", " ! "), (r"\/", " "), (r"\^", " ^ "), (r"\+", " + "), (r"\-", " - "), (r"\=", " = "), ("'", " "), ("60k", " 60000 "), (":", " : "),
    (" e g ", " eg "), (" b g ", " bg "), (" u s ", " american "), (r"\x00s", "0"), (" 9 11 ", "911"), ("e - mail", "email"), ("j k", "jk"), (r"[ \t\n\r\f\x0B]{2,}", " "),
]
#: Pronouns and forms of "be" that patterns don't tell apart, replaced in this order.
CANONICAL = [
    *((f" {w} ", " <U> ") for w in ("i", "you", "he", "she", "him", "me", "they", "them", "us", "our", "my", "your", "his", "her", "their")),
    *((f" {w} ", " <is> ") for w in ("s", "is", "am", "are")), (" don t ", " do not "),
]


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def replaced(c: Column, pairs: list[tuple[str, str]]) -> Column:
    """Literal replacements, one after the other."""
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def rewritten(c: Column, pairs: list[tuple[str, str]]) -> Column:
    """Replacements by pattern, one after the other."""
    for old, new in pairs:
        c = F.regexp_replace(c, old, new)
    return c


def _replaced_sql(c: str, pairs: list[tuple[str, str]]) -> str:
    for old, new in pairs:
        c = f"replace({c}, {_quote(old)}, {_quote(new)})"
    return c


def _rewritten_sql(c: str, pairs: list[tuple[str, str]]) -> str:
    for old, new in pairs:
        c = f"regexp_replace({c}, {_quote(old)}, {_quote(new)}, 'g')"
    return c


def single_blanks(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, _WS, " "))


def _single_sql(c: str) -> str:
    return f"trim(regexp_replace({c}, {_quote(_WS)}, ' ', 'g'), ' ')"


#: Marks that word_tokenise sets apart, and the endings of contractions.
APART = [(r"([.,!?;:()\[\]{}<>\"])", r" \1 "), (r"n't\b", " n't"), (r"'(s|re|ve|ll|d|m)\b", r" '\1"), (r"\b(can)(not)\b", r"\1 \2")]


def _named(name: str, f, g) -> None:
    """Registers a query of text1 and text2, by f for Spark and g for DuckDB, over pair_rows."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return pair_rows(spark, d).select("id", *(f(F.col(f"q{k}")).alias(f"text{k}") for k in (1, 2)))

    QUERIES[name] = run
    SQL[name] = f"WITH {PAIR_SQL} SELECT id, {g('q1')} AS text1, {g('q2')} AS text2 FROM p"


for _name, _f, _g in (
    ("abbreviations_expanded", lambda c: replaced(F.lower(c), ABBREVIATIONS), lambda c: _replaced_sql(f"lower({c})", ABBREVIATIONS)),
    ("text_to_words", lambda c: rewritten(single_blanks(F.lower(c)), CLEANING), lambda c: _rewritten_sql(_single_sql(f"lower({c})"), CLEANING)),
    ("canonical_pronouns", lambda c: replaced(F.concat(F.lit(" "), single_blanks(F.lower(c)), F.lit(" ")), CANONICAL), lambda c: _replaced_sql(f"concat(' ', {_single_sql(f'lower({c})')}, ' ')", CANONICAL)),
    ("word_tokenised", lambda c: single_blanks(rewritten(c, [(p, r.replace("\\1", "$1").replace("\\2", "$2")) for p, r in APART])), lambda c: _single_sql(_rewritten_sql(c, APART))),
    ("unicode_punctuation_removed", lambda c: F.regexp_replace(c, r"[\p{P}\p{S}]+", ""), lambda c: rf"regexp_replace({c}, '[\p{{P}}\p{{S}}]+', '', 'g')"),
    ("two_letter_tokens", lambda c: F.array_join(F.regexp_extract_all(c, F.lit("[A-Za-z0-9_]{2,}"), F.lit(0)), " "), lambda c: f"array_to_string(regexp_extract_all({c}, '[A-Za-z0-9_]{{2,}}'), ' ')"),
    ("urls_and_numbers_masked", lambda c: rewritten(c, [("www[.]|[.]com|[.]co[.]uk", ""), ("[0-9]+[.][0-9]+", "FLOAT")]), lambda c: _rewritten_sql(c, [("www[.]|[.]com|[.]co[.]uk", ""), ("[0-9]+[.][0-9]+", "FLOAT")])),
    ("letters_only", lambda c: F.regexp_replace(F.lower(c), "[^a-z]", ""), lambda c: f"regexp_replace(lower({c}), '[^a-z]', '', 'g')"),
):
    _named(_name, _f, _g)


def _nulls_named(spark: SparkSession, d: str) -> DataFrame:
    """All columns as strings, null as 'nan'."""
    t = spark.read.parquet(f"{d}/train.parquet")
    return t.select("id", *(F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias(c) for c in ("qid1", "question1", "question2", "is_duplicate", "source")))


QUERIES["nulls_named"] = _nulls_named
SQL["nulls_named"] = "SELECT id, " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), 'nan') AS {c}" for c in ("qid1", "question1", "question2", "is_duplicate", "source")) + " FROM train"


def triterms(c: str) -> tuple[str, str]:
    """All ordered triples of words; shorter rows fall back to pairs."""
    two = _terms(c, None)
    spark = f"CASE WHEN size({c}) < 3 THEN {two[0]} ELSE flatten(transform(sequence(1, size({c}) - 2), i -> flatten(transform(sequence(i + 1, size({c}) - 1), j -> transform(slice({c}, j + 1, size({c})), w -> concat(element_at({c}, i), '_', element_at({c}, j), '_', w)))))) END"
    duck = f"CASE WHEN len({c}) < 3 THEN {two[1]} ELSE flatten(list_transform(range(1, len({c}) - 1), lambda i: flatten(list_transform(range(i + 1, len({c})), lambda j: list_transform({c}[j + 1:], lambda w: concat({c}[i], '_', {c}[j], '_', w)))))) END"
    return spark, duck


def fourterms(c: str) -> tuple[str, str]:
    """All ordered quadruples of words; shorter rows fall back to triples."""
    three = triterms(c)
    spark = f"CASE WHEN size({c}) < 4 THEN {three[0]} ELSE flatten(transform(sequence(1, size({c}) - 3), h -> flatten(transform(sequence(h + 1, size({c}) - 2), i -> flatten(transform(sequence(i + 1, size({c}) - 1), j -> transform(slice({c}, j + 1, size({c})), w -> concat(element_at({c}, h), '_', element_at({c}, i), '_', element_at({c}, j), '_', w)))))))) END"
    duck = f"CASE WHEN len({c}) < 4 THEN {three[1]} ELSE flatten(list_transform(range(1, len({c}) - 2), lambda h: flatten(list_transform(range(h + 1, len({c}) - 1), lambda i: flatten(list_transform(range(i + 1, len({c})), lambda j: list_transform({c}[j + 1:], lambda w: concat({c}[h], '_', {c}[i], '_', {c}[j], '_', w)))))))) END"
    return spark, duck


def united(c: str, n: int) -> tuple[str, str]:
    """Words, and true bigrams (and trigrams, for n = 3), in one list."""
    spark = [c] + [f"CASE WHEN size({c}) < {k} THEN CAST(array() AS array<string>) ELSE {grams(c, k)[0]} END" for k in range(2, n + 1)]
    duck = [c] + [f"CASE WHEN len({c}) < {k} THEN CAST([] AS VARCHAR[]) ELSE {grams(c, k)[1]} END" for k in range(2, n + 1)]
    return f"concat({', '.join(spark)})", f"list_concat({duck[0]}, {duck[1]})" if n == 2 else f"list_concat(list_concat({duck[0]}, {duck[1]}), {duck[2]})"


_bundle(
    "pair_triterms",
    {"triterms1": "CAST(SIZE(ta) AS INT)", "triterms2": "CAST(SIZE(tb) AS INT)", "shared_triterms": "CAST(SIZE(AND_(ta, tb)) AS INT)", "first_triterm1": ("coalesce(get(ta, 0), '')", "coalesce(ta[1], '')")},
    {"ta": triterms("a"), "tb": triterms("b")},
)
_bundle(
    "pair_fourterms",
    {"fourterms1": "CAST(SIZE(ta) AS INT)", "fourterms2": "CAST(SIZE(tb) AS INT)", "shared_fourterms": "CAST(SIZE(AND_(ta, tb)) AS INT)"},
    {"ta": fourterms("a"), "tb": fourterms("b")},
)
_bundle(
    "pair_gram_unions",
    {f"{n}{s}": (f"array_join({u[0]}, ' ')", f"array_to_string({u[1]}, ' ')") for s, c in (("1", "a"), ("2", "b")) for n, u in (("ub", united(c, 2)), ("ubt", united(c, 3)))},
)
_digits = lambda c: (f"size(filter({c}, t -> t RLIKE '^[0-9]+$'))", f"len(list_filter({c}, lambda t: regexp_full_match(t, '[0-9]+')))")
_bundle(
    "pair_digit_ratio",
    {f"digit_ratio{k}": _pair_of(_ratio, _digits(c), _both(f"SIZE({c})")) for k, c in ((1, "a"), (2, "b"))},
)
_marked = lambda c: f"(length({c}) - length(translate({c}, '?,.', '')))"
_bundle(
    "pair_mark_totals",
    {
        "marks_max": f"CAST(greatest({_marked('q1')}, {_marked('q2')}) AS INT)",
        "marks_min": f"CAST(least({_marked('q1')}, {_marked('q2')}) AS INT)",
        "marks_diff": f"CAST(abs({_marked('q1')} - {_marked('q2')}) AS INT)",
        "marks_ratio": _ratio(f"least({_marked('q1')}, {_marked('q2')})", f"greatest({_marked('q1')}, {_marked('q2')})"),
    },
)
#: Words of closed classes and their tags; other words are tagged by their endings.
TAGGED = {
    "DT": "the a an this that these those each every some any no",
    "PRP": "i you he she it we they me him her us them my your his its our their myself yourself",
    "IN": "of in on at by with from to for about into over after before between without against during than as if",
    "WP": "who whom whose what which where when why how",
    "MD": "can could will would should may might must shall",
    "VB": "is are was were be been am do does did have has had get make go know use take find",
    "CC": "and or but nor so yet",
    "RB": "not very too also never always often just only still",
}
ENDINGS = [("ing", "VBG"), ("ed", "VBD"), ("ly", "RB"), ("ous", "JJ"), ("ful", "JJ"), ("able", "JJ"), ("ible", "JJ"), ("ive", "JJ"), ("est", "JJS"), ("s", "NNS")]


def tag(w: str) -> str:
    """A word's tag, by closed classes and endings: a rule tagger in plain SQL, the same in both dialects."""
    closed = " ".join(f"WHEN {w} IN ({', '.join(map(repr, words.split()))}) THEN '{t}'" for t, words in TAGGED.items())
    ends = " ".join(f"WHEN {w} LIKE '%{e}' THEN '{t}'" for e, t in ENDINGS)
    return f"CASE {closed} WHEN {w} LIKE '0%' OR {w} LIKE '1%' OR {w} LIKE '2%' OR {w} LIKE '3%' OR {w} LIKE '4%' OR {w} LIKE '5%' OR {w} LIKE '6%' OR {w} LIKE '7%' OR {w} LIKE '8%' OR {w} LIKE '9%' THEN 'CD' {ends} ELSE 'NN' END"


_stop_list = ", ".join(map(repr, STOPS))
_tags = {"xa": _both(f"TRANSFORM(a, \\w: {tag('w')})"), "xb": _both(f"TRANSFORM(b, \\w: {tag('w')})")}
_content = {f"c{c}": _both(f"FILTER({c}, \\w: w NOT IN ({_stop_list}))") for c in "ab"}
def _true_grams(c: str, k: int) -> tuple[str, str]:
    """k-grams, none for shorter rows."""
    if k == 1:
        return c, c
    return f"CASE WHEN size({c}) < {k} THEN CAST(array() AS array<string>) ELSE transform(sequence(1, size({c}) - {k - 1}), i -> array_join(slice({c}, i, {k}), ' ')) END", f"CASE WHEN len({c}) < {k} THEN CAST([] AS VARCHAR[]) ELSE list_transform(range(1, len({c}) - {k - 2}), lambda i: array_to_string({c}[i:i + {k - 1}], ' ')) END"


def _hits(x: str, y: str) -> tuple[str, str]:
    """Grams of x that y has, each as often as both have it."""
    return (
        f"aggregate(transform(array_distinct({x}), g -> least(size(filter({x}, u -> u = g)), size(filter({y}, u -> u = g)))), 0, (s, z) -> s + z)",
        f"CAST(coalesce(list_sum(list_transform(list_distinct({x}), lambda g: least(len(list_filter({x}, lambda u: u = g)), len(list_filter({y}, lambda u: u = g))))), 0) AS BIGINT)",
    )


def _bleu(n: int, x: str, y: str) -> str:
    """Geometric mean of the modified precisions of x against y up to n-grams, times the brevity penalty; 0 where one of them is 0."""
    some = " AND ".join(f"h{k} > 0" for k in range(1, n + 1))
    logs = " + ".join(f"ln(CAST(h{k} AS DOUBLE) / (n{x} - {k - 1}))" for k in range(1, n + 1))
    return f"CASE WHEN {some} THEN exp(({logs}) / {n}) * least(1e0, exp(1 - CAST(n{y} AS DOUBLE) / n{x})) ELSE 0e0 END"


_G4 = {f"{c}{k}": _true_grams(c, k) for c in "ab" for k in range(1, 5)}
_H4 = {f"h{k}": _hits(f"a{k}", f"b{k}") for k in range(1, 5)}  # the same in both directions
_B4 = {f"bleu{n}_{x}{y}": _bleu(n, x, y) for n in range(1, 5) for x, y in (("1", "2"), ("2", "1"))}
_ENDS = [f"round({k}, 6) AS {k}" for k in _B4] + [f"round({f}(bleu{n}_12, bleu{n}_21), 6) AS bleu{n}_{m}" for n in range(1, 5) for m, f in (("min", "least"), ("max", "greatest"))]


def pair_bleu(spark: SparkSession, d: str) -> DataFrame:
    """BLEU up to 1- to 4-grams in both directions, with the smaller and the larger of the two."""
    t = pair_rows(spark, d).selectExpr("id", "size(a) AS n1", "size(b) AS n2", *(f"{v[0]} AS {k}" for k, v in _G4.items()))
    t = t.selectExpr("id", "n1", "n2", *(f"{v[0]} AS {k}" for k, v in _H4.items()))
    return t.selectExpr("id", *(f"{v} AS {k}" for k, v in _B4.items())).selectExpr("id", *_ENDS)


QUERIES["pair_bleu"] = pair_bleu
SQL["pair_bleu"] = (
    f"WITH {PAIR_SQL}, g AS (SELECT id, len(a) AS n1, len(b) AS n2, {', '.join(f'{v[1]} AS {k}' for k, v in _G4.items())} FROM p), h AS (SELECT id, n1, n2, {', '.join(f'{v[1]} AS {k}' for k, v in _H4.items())} FROM g), "
    f"e AS (SELECT id, {', '.join(f'{v} AS {k}' for k, v in _B4.items())} FROM h) SELECT id, {', '.join(_ENDS)} FROM e"
)
_bundle("pair_tag_strings", {f"tags{k}": f"JOIN(TRANSFORM(c{c}, \\w: {tag('w')}), ' ')" for k, c in ((1, "a"), (2, "b"))}, _content)


def _often(x: str, best: str) -> str:
    """The most (or least) frequent element with its count, ties by name."""
    return f"coalesce({best}(TRANSFORM(UNIQ({x}), \\v: concat(lpad(CAST(SIZE(FILTER({x}, \\u: u = v)) AS STRING), 6, '0'), v))), '')"


def set_bundle(x: str, y: str) -> dict[str, tuple[str, str]]:
    """Comparisons of two lists as sets, and by their most and least frequent elements with their counts."""
    both, u, v = f"SIZE(AND_({x}, {y}))", f"SIZE(UNIQ({x}))", f"SIZE(UNIQ({y}))"
    out = {
        "match_ratio": _ratio(f"2 * {both}", f"SIZE({x}) + SIZE({y})"),
        "match_num": f"CAST({both} AS INT)",
        "subset": f"CAST({both} = {u} OR {both} = {v} AS INT)",
        "different": f"CAST({u} + {v} - 2 * {both} AS INT)",
        "same": f"CAST({both} = {u} AND {both} = {v} AS INT)",
        "most_frequent_same": f"CAST({_often(x, 'MAXL')} = {_often(y, 'MAXL')} AS INT)",
        "least_frequent_same": f"CAST({_often(x, 'MINL')} = {_often(y, 'MINL')} AS INT)",
        "size_diff": f"CAST(abs({u} - {v}) AS INT)",
        "emptiness": f"CASE WHEN SIZE({x}) = 0 AND SIZE({y}) = 0 THEN 1 WHEN SIZE({x}) = 0 THEN 2 WHEN SIZE({y}) = 0 THEN 3 ELSE 0 END",
    }
    done = {k: _both(e) for k, e in out.items()}
    return {k: (s, q.replace("AS STRING", "AS VARCHAR")) for k, (s, q) in done.items()}


_bundle("pair_tag_sets", set_bundle("xa", "xb"), _tags)
_names = lambda c: (f"regexp_extract_all({c}, '[A-Z][A-Za-z0-9]+(?: [A-Z][A-Za-z0-9]+)*', 0)", f"regexp_extract_all({c}, '[A-Z][A-Za-z0-9]+(?: [A-Z][A-Za-z0-9]+)*')")
_bundle(
    "pair_names",
    {
        "names_max": "CAST(greatest(SIZE(na), SIZE(nb)) AS INT)",
        "names_min": "CAST(least(SIZE(na), SIZE(nb)) AS INT)",
        "names_diff": "CAST(abs(SIZE(na) - SIZE(nb)) AS INT)",
        "names_jaccard": _ratio("SIZE(AND_(na, nb))", "SIZE(UNIQ(concat(na, nb)))"),
    }
    | {f"names_{k}": v for k, v in set_bundle("na", "nb").items() if k in ("subset", "same", "emptiness")},
    {"na": _names("q1"), "nb": _names("q2")},
)


def links(words: str, tags: str) -> tuple[str, str]:
    """Phrases from a determiner, question word, verb or preposition to the next noun or pronoun."""
    opens, closes = "('DT', 'WP', 'VB', 'IN')", "('NN', 'NNS', 'PRP')"
    spark = (
        f"filter(transform({words}, (w, i) -> CASE WHEN element_at({tags}, i + 1) IN {opens} THEN array_join(slice({words}, i + 1, coalesce(array_min(filter(transform({tags}, (t, j) -> CASE WHEN t IN {closes} AND j > i THEN j END), z -> z IS NOT NULL)), -2) - i + 1), '_') END), z -> z IS NOT NULL AND z <> '')"
    )
    spark = spark.replace(f"slice({words}, i + 1, coalesce(", f"slice({words}, i + 1, greatest(0, coalesce(").replace("-2) - i + 1)", "i - 1) - i + 1))")
    duck = (
        f"list_filter(list_transform({words}, lambda w, i: CASE WHEN {tags}[i] IN {opens} THEN array_to_string({words}[i:coalesce(list_min(list_filter(list_transform({tags}, lambda t, j: CASE WHEN t IN {closes} AND j > i THEN j END), lambda z: z IS NOT NULL)), i - 1)], '_') END), lambda z: z IS NOT NULL AND z <> '')"
    )
    return spark, duck


_bundle(
    "pair_tag_links",
    {"links1": "JOIN(la, ' ')", "links2": "JOIN(lb, ' ')", "links_match": _ratio("2 * SIZE(AND_(la, lb))", "SIZE(la) + SIZE(lb)")},
    {"la": (links("a", f"({_tags['xa'][0]})")[0], links("a", f"({_tags['xa'][1]})")[1]), "lb": (links("b", f"({_tags['xb'][0]})")[0], links("b", f"({_tags['xb'][1]})")[1])},
)
_bundle(
    "pair_char_tensors",
    {f"chars{k}": (f"array_join(transform({c}, w -> array_join(transform(filter(split(w, ''), x -> x <> ''), x -> CAST(ascii(x) AS STRING)), ' ')), '|')", f"array_to_string(list_transform({c}, lambda w: array_to_string(list_transform(list_filter(string_split(w, ''), lambda x: x <> ''), lambda x: CAST(ascii(x) AS VARCHAR)), ' ')), '|')") for k, c in ((1, "a"), (2, "b"))},
)
_bundle(
    "padding_masks",
    {
        "longest": "CAST(greatest(SIZE(a), SIZE(b)) AS INT)",
        **{f"mask{k}": ("concat(repeat('1', size({c})), repeat('0', greatest(size(a), size(b)) - size({c})))".replace("{c}", c), "concat(repeat('1', len({c})), repeat('0', greatest(len(a), len(b)) - len({c})))".replace("{c}", c)) for k, c in ((1, "a"), (2, "b"))},
        **{f"weight{k}": _ratio("1", f"SIZE({c})") for k, c in ((1, "a"), (2, "b"))},
    },
)
_offsets = lambda x, y: (f"array_join(transform({x}, (w, i) -> CAST(abs(instr(array_join({y}, ' '), w) - 1 - i) AS STRING)), ' ')", f"array_to_string(list_transform({x}, lambda w, i: CAST(abs(instr(array_to_string({y}, ' '), w) - i) AS VARCHAR)), ' ')")
_bundle("pair_position_offsets_both", {"offsets1": _offsets("a", "b"), "offsets2": _offsets("b", "a")})
_bundle(
    "row_stats",
    {
        "row_mean": ("round(aggregate(v, 0D, (s, z) -> s + z) / 5, 6)", "round(list_sum(v) / 5, 6)"),
        "row_max": "MAXL(v)",
        "row_min": "MINL(v)",
        "row_std": ("round(sqrt(greatest(aggregate(v, 0D, (s, z) -> s + z * z) / 5 - power(aggregate(v, 0D, (s, z) -> s + z) / 5, 2), 0D)), 5)", "round(sqrt(greatest(list_sum(list_transform(v, lambda z: z * z)) / 5 - power(list_sum(v) / 5, 2), 0)), 5)"),
        "weighted_sum": ("round(aggregate(zip_with(v, array(0.5D, 0.5D, 2.0D, 0.1D, 0.1D), (x, y) -> x * y), 0D, (s, z) -> s + z), 6)", "round(v[1] * 0.5 + v[2] * 0.5 + v[3] * 2.0 + v[4] * 0.1 + v[5] * 0.1, 6)"),
    },
    {"v": ("array(CAST(size(a) AS DOUBLE), CAST(size(b) AS DOUBLE), CAST(size(array_intersect(a, b)) AS DOUBLE), CAST(length(q1) AS DOUBLE), CAST(length(q2) AS DOUBLE))", "[CAST(len(a) AS DOUBLE), CAST(len(b) AS DOUBLE), CAST(len(list_intersect(a, b)) AS DOUBLE), CAST(length(q1) AS DOUBLE), CAST(length(q2) AS DOUBLE)]")},
)
