"""Missing or wrong document language labels (problem 10), by segmentation-marginalised unigrams.

Every language has probabilities of the pieces of a fixed public byte-level vocabulary. The chance of a
word is summed over all its segmentations into pieces by the forward algorithm; a sentence's is the
product over its words. Pieces are fitted by expectation-maximisation (forward-backward) on the
reference sentences, then again with a bounded sample of labelled documents whose label the fit confirms.
Neighbouring sentences of a document are judged together: changing the language costs SWITCH. Every language's pieces are mixed with a background over all languages, which also
stands for "no language": text that the background explains best, such as code, has none.
"""

from __future__ import annotations

import base64
import importlib.util
import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents, and characters of each, that the second fit may read.
SAMPLE_DOCS, SAMPLE_CHARS = 1500, 5000
MIX = 0.2
#: Bytes of the words that are scored together; positions after which sums are scaled.
TOGETHER, SCALED = 32_768, 24
#: Nats that a change of language between neighbouring sentences costs.
SWITCH = 4.0
REMEMBERED = 300_000
WORD = re.compile("[a-zß-öø-ɏḀ-ỿ]+|[぀-ヿ㐀-鿿ｦ-ﾟ]+|[^\\W\\d_a-zß-öø-ɏḀ-ỿ぀-ヿ㐀-鿿ｦ-ﾟ]+")
MARKUP = re.compile(r"<[^<>]{1,200}>|&#?\w{1,10};|https?://\S+|www\.\S+")
QUOTED = re.compile("\"[^\"\n]{1,80}\"|“[^”\n]{1,80}”|„[^“”\n]{1,80}[“”]|«[^»\n]{1,80}»|「[^」\n]{1,40}」")
ENDS = re.compile(r"[^.!?。！？…\n]+(?:[.!?…]+(?=\s|$|[\"'”»)\]])|[。！？]+|\n|$|[.!?…]+)")


def default_vocabulary() -> str:
    """Path of byte_bpe_multi_50k.tiktoken among the public tokenizers."""
    return str(Path(importlib.util.find_spec("public_tokenizers").origin).parent / "byte_bpe_multi_50k.tiktoken")


def sentences(text: str) -> list[str]:
    """Sentences with at least one letter, in order; markup, addresses and short quotations taken out."""
    t = QUOTED.sub(" ", MARKUP.sub(" ", text))
    out: list[str] = []
    for s in ENDS.findall(t):
        s = s.strip()
        if not s:
            continue
        if out and not out[-1][-1] in ".!?…。！？\n:" and s[0].islower() and out[-1].endswith("."):
            out[-1] += s
        else:
            out.append(s)
    return [s for s in out if any(c.isalpha() for c in s)]


Arcs = list[list[tuple[int, np.ndarray, np.ndarray]]]


class Model:
    """Probabilities of all pieces of the vocabulary per language; the last column is the background."""

    def __init__(self, langs: list[str], path: str):
        self.langs = langs
        self.rows: dict[bytes, int] = {}
        for line in Path(path).read_bytes().splitlines():
            self.rows[base64.b64decode(line.split()[0])] = len(self.rows)
        self.longest: dict[bytes, int] = {}  # last two bytes -> longest piece that ends so
        for piece in self.rows:
            self.longest[piece[-2:]] = max(self.longest.get(piece[-2:], 1), len(piece))
        plain = np.array([0.1 ** len(p) for p in self.rows])
        self.plain = plain / plain.sum()
        self.p = np.zeros((len(self.rows), len(langs) + 1))

    def arcs(self, words: list[bytes], backward: bool = False) -> Arcs:
        """Per end: (length, words, rows) of the pieces of that length that end there; ``backward``: of those that begin so far from the word's end."""
        ends: list[dict[int, tuple[list[int], list[int]]]] = [{} for _ in range(max(map(len, words)))]
        get, longest = self.rows.get, self.longest.get
        for i, w in enumerate(words):
            n = len(w)
            for e in range(1, n + 1):
                for k in range(1, min(e, longest(w[max(e - 2, 0) : e], 1)) + 1):
                    r = get(w[e - k : e])
                    if r is not None:
                        ws, rs = ends[n - e + k - 1 if backward else e - 1].setdefault(k, ([], []))
                        ws.append(i)
                        rs.append(r)
        return [[(k, np.array(ws), np.array(rs)) for k, (ws, rs) in sorted(at.items())] for at in ends]

    def sums(self, arcs: Arcs, n: int, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values and offsets of [position, word, language]: the log of the summed chances of all segmentations so far is log value + offset.

        The chance of a long word is less than a float can hold. So every SCALED positions the sums that later ones still
        need are scaled, per word and language; the state is carried on, no word is cut.
        """
        reach = max((k for at in arcs for k, _, _ in at), default=1)
        values, offsets = np.zeros((len(arcs) + 1, n, p.shape[1])), np.zeros((len(arcs) + 1, n, p.shape[1]))
        values[0] = 1
        held, offset = {0: values[0]}, offsets[0]
        for e, at in enumerate(arcs, 1):
            if e % SCALED == 0:
                top = np.max(list(held.values()), axis=0)
                top[top == 0] = 1  # of words that have ended
                held, offset = {j: v / top for j, v in held.items()}, offset + np.log(top)
            now = values[e]
            for k, ws, rs in at:
                now[ws] += held[e - k][ws] * p[rs]
            offsets[e] = offset
            held[e] = now
            held.pop(e - reach, None)
        return values, offsets

    @staticmethod
    def batches(raw: list[bytes]) -> Iterator[list[int]]:
        """Words of like length together, at most TOGETHER bytes or one word."""
        order, part = sorted(range(len(raw)), key=lambda i: len(raw[i])), []
        for i in order:
            if part and (len(part) + 1) * len(raw[i]) > TOGETHER:
                yield part
                part = []
            part.append(i)
        if part:
            yield part

    def scores(self, words: list[str]) -> np.ndarray:
        """[word, language]: log chances of words in lower case, of any length."""
        raw = [_raw(w) for w in words]
        got = np.empty((len(raw), self.p.shape[1]))
        for part in self.batches(raw):
            chunk = [raw[i] for i in part]
            values, offsets = self.sums(self.arcs(chunk), len(chunk), self.p)
            at = [len(w) for w in chunk], np.arange(len(chunk))
            got[part] = np.log(values[at]) + offsets[at]
        return got

    def fit(self, counts: list[Counter], rounds: int = 3) -> None:
        """Expectation-maximisation from word counts per language, by forward and backward sums."""
        words = list(dict.fromkeys(w for c in counts for w in c))
        raw = [_raw(w) for w in words]
        weight = np.array([[c[w] for c in counts] for w in words], float).reshape(len(words), len(counts))
        parts = [(weight[part], np.array([len(raw[i]) for i in part]), self.arcs(chunk), self.arcs(chunk, True)) for part in self.batches(raw) for chunk in [[raw[i] for i in part]]]
        for round_ in range(rounds + 1):
            expected, p = np.zeros((len(self.rows), len(counts))), self.p[:, :-1]
            for w, size, arcs, back in parts:
                n = len(size)
                if round_ == 0:  # at first, every piece that occurs
                    for at in arcs:
                        for _, ws, rs in at:
                            np.add.at(expected, rs, w[ws])
                    continue
                (a, a_off), (b, b_off) = self.sums(arcs, n, p), self.sums(back, n, p)
                whole = a[size, np.arange(n)]
                z = np.log(np.where(whole > 0, whole, 1)) + a_off[size, np.arange(n)]
                for e, at in enumerate(arcs, 1):
                    for k, ws, rs in at:
                        rest = size[ws] - e
                        share = a[e - k, ws] * b[rest, ws] * np.exp(a_off[e - k, ws] + b_off[rest, ws] - z[ws])
                        np.add.at(expected, rs, p[rs] * share * w[ws])
            own = expected / np.maximum(expected.sum(0), 1e-9)
            ground = 0.5 * own.mean(1) + 0.5 * self.plain
            self.p[:, :-1] = (1 - MIX) * own + MIX * ground[:, None]
            self.p[:, -1] = ground


def _raw(word: str) -> bytes:
    return (" " + word).encode("utf-8", "ignore")


class Reader:
    """Judges sentences; remembers the scores of REMEMBERED words."""

    def __init__(self, model: Model):
        self.model, self.index = model, {}
        self.table = np.zeros((1024, model.p.shape[1]))

    def judge(self, found: list[str]) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
        """Per sentence: best language (-1 for none, as for less than two words of two letters), log chances, words."""
        if len(self.index) > REMEMBERED:
            self.index.clear()
        words = [WORD.findall(s.lower()) for s in found]
        fresh = [w for w in dict.fromkeys(w for ws in words for w in ws) if w not in self.index]
        if fresh:
            at = len(self.index)
            while at + len(fresh) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[at : at + len(fresh)] = self.model.scores(fresh)
            self.index.update(zip(fresh, range(at, at + len(fresh))))
        sizes = np.array([len(w) for w in words], np.int64)
        total = np.zeros((len(found), self.table.shape[1]))
        get = self.index.__getitem__
        flat = np.array([get(w) for ws in words for w in ws], np.int64)
        if len(flat):
            total[sizes > 0] = np.add.reduceat(self.table[flat], (np.cumsum(sizes) - sizes)[sizes > 0])
        best = total[:, :-1].argmax(1) if len(found) else np.zeros(0, np.int64)
        real = np.array([sum(len(w) > 1 for w in ws) >= 2 or any(w > "\u3040" for w in ws) for ws in words], bool)
        best = np.where(real & (total.max(1, initial=-np.inf) > total[:, -1]), best, -1)
        return best, total, words


def confidence(total: np.ndarray, judged: np.ndarray) -> np.ndarray:
    """Chance of the judged language against the other ones and none; 0 for sentences of no language."""
    e = np.exp(total - total.max(1, keepdims=True, initial=-np.inf))
    return np.where(judged >= 0, e[np.arange(len(judged)), judged] / e.sum(1), 0.0)


def train(reference: list[tuple[str, str]], sample: list[tuple[str, str]], path: str | None = None) -> Model:
    """A model from (language, sentence) pairs, and from labelled (language, text) documents that it agrees with.

    Of those documents, sentences that are surely of another language are left out.
    """
    langs = sorted({x for x, _ in reference})
    model = Model(langs, path or default_vocabulary())
    base = [Counter() for _ in langs]
    for lang, text in reference:
        base[langs.index(lang)].update(WORD.findall(text.lower()))
    model.fit(base)
    split = [(langs.index(lang), sentences(t)) for lang, t in sample if lang in langs]
    for _ in range(2):
        reader, counts = Reader(model), [Counter(c) for c in base]
        for lang, found in split:
            best, total, words = reader.judge(found)
            total = total[:, :-1]
            if not (best >= 0).any() or total[best >= 0].sum(0).argmax() != lang:
                continue
            for ws, b, t in zip(words, best, total):
                if b >= 0 and t[b] - t[lang] < 15:
                    counts[lang].update(ws)
        model.fit(counts)
    return model


def fitted(reference: DataFrame, docs: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "lang", path: str | None = None) -> Model:
    """Trained on the reference table (fixed in size) and on SAMPLE_DOCS labelled documents, chosen by a hash of their ids."""
    pairs = [(r[0], r[1]) for r in reference.select("lang", "sample_text").dropna().collect()]
    named = label_language(F.col(label), notations(reference))
    short = docs.filter(F.length(text).between(1, SAMPLE_CHARS)).select(named.alias("l"), F.col(text).alias("t"), F.xxhash64(id_col).alias("h"))
    share = 4 * SAMPLE_DOCS / max(docs.count(), 1)  # about four samples are sorted, however many documents there are
    few = short.filter(F.pmod("h", F.lit(1 << 30)) < F.lit(int(min(share, 1) * (1 << 30)))).dropna(subset="l")
    return train(pairs, [(r.l, r.t) for r in few.orderBy("h", "t").limit(SAMPLE_DOCS).collect()], path)


def smoothed(best: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The likeliest languages of a document's sentences, where a change costs SWITCH; sentences of no language stay so."""
    real = np.flatnonzero(best >= 0)
    if len(real) < 2 or (best[real] == best[real[0]]).all():
        return best
    scores = total[real, :-1]
    at, back = scores[0], np.zeros(scores.shape, np.int64)
    for i in range(1, len(real)):
        top = at.argmax()
        change = at[top] - SWITCH > at
        back[i] = np.where(change, top, np.arange(len(at)))
        at = np.where(change, at[top] - SWITCH, at) + scores[i]
    out, k = best.copy(), int(at.argmax())
    for i in range(len(real) - 1, -1, -1):
        out[real[i]] = k
        k = int(back[i][k])
    return out


SEGMENTS = "array<struct<lang string, sentences int, chars long, confidence double>>"


def segmented(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, segments): runs of sentences of one language, in order; sentences of no language join the run before them.

    A segment's confidence is the mean, by characters, of its sentences' chances of the segment's language, against the
    others and none. Where neighbours outweigh a sentence's own best language, that may be little.

    One row per document; null, empty and wordless texts have no segments. Texts are read whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        kind = pa.list_(pa.struct([("lang", pa.string()), ("sentences", pa.int32()), ("chars", pa.int64()), ("confidence", pa.float64())]))
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                per = [sentences(t) if t else [] for t in part.column(1).to_pylist()]
                flat = [s for d in per for s in d]
                best, total, _ = reader.judge(flat)
                out, at = [], 0
                for d in per:
                    runs: list[dict] = []
                    judged = smoothed(best[at : at + len(d)], total[at : at + len(d)])
                    sure = confidence(total[at : at + len(d)], judged)
                    for s, b, c in zip(d, judged.tolist(), sure.tolist()):
                        if b >= 0:
                            lang = reader.model.langs[b]
                            if not runs or runs[-1]["lang"] != lang:
                                runs.append({"lang": lang, "sentences": 0, "chars": 0, "confidence": 0.0})
                            r = runs[-1]
                            r["sentences"] += 1
                            r["chars"] += len(s)
                            r["confidence"] += c * len(s)
                    at += len(d)
                    for r in runs:
                        r["confidence"] /= r["chars"]
                    out.append(runs)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, kind)], names=["doc_id", "segments"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, segments {SEGMENTS}")


def languages(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """(doc_id, label, main, langs): the main language, and all of [(lang, sentences, chars, confidence)] that count.

    Beside the main one those with two sentences and a tenth of the characters. Ties of the main language
    go to the first in the alphabet. main is null and langs empty for a document without sentences.
    """
    shared = segmented(docs.select(F.struct(F.col(id_col).alias("i"), F.col(label).alias("l")).alias("doc_id"), F.col(text).alias("text")), model)
    known = F.array(*(F.lit(x) for x in model.langs))

    def total(lang: Column) -> Column:
        own = F.filter("segments", lambda s: s["lang"] == lang)
        chars = F.aggregate(own, F.lit(0).cast("long"), lambda a, s: a + s["chars"])
        return F.struct(chars.alias("chars"), lang.alias("lang"), F.aggregate(own, F.lit(0), lambda a, s: a + s["sentences"]).alias("sentences"), (F.aggregate(own, F.lit(0.0), lambda a, s: a + s["confidence"] * s["chars"]) / F.greatest(chars, F.lit(1))).alias("confidence"))

    d = shared.select(F.col("doc_id.i").alias("doc_id"), F.col("doc_id.l").alias("label"), F.filter(F.transform(known, total), lambda s: s["sentences"] > 0).alias("all"))
    most = F.array_max(F.transform("all", lambda s: s["chars"]))
    whole = F.aggregate("all", F.lit(0).cast("long"), lambda a, s: a + s["chars"])
    d = d.withColumn("main", F.get(F.filter("all", lambda s: s["chars"] == most), F.lit(0))["lang"])
    return d.select("doc_id", "label", "main", F.filter("all", lambda s: (s["lang"] == F.col("main")) | ((s["sentences"] >= 2) & (s["chars"] * 10 >= whole))).alias("langs"))


def notations(reference: DataFrame) -> dict[str, str]:
    """Codes of two and three letters and English names, in lower case, to the two-letter code; the reference table is fixed in size."""
    out = {}
    for r in reference.select("lang", "lang_name", "iso3").distinct().collect():
        out |= {str(x).strip().lower(): r.lang for x in r if x}
    return out


def label_language(label: Column, known: dict[str, str]) -> Column:
    """The language that a label names, null if it names none: any case, blanks around, with or without region."""
    clean = F.lower(F.regexp_replace(label, r"^\s+|\s+$", ""))
    table = F.create_map(*(F.lit(x) for kv in known.items() for x in kv))
    return F.coalesce(table[clean], table[F.regexp_extract(clean, r"^(\p{L}+)[-_ ].*$", 1)])


def _judged(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, str]]:
    docs, reference = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "lang_reference"))
    return languages(docs, fitted(reference, docs)), notations(reference)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a language whose label isn't right, or with several languages: a row per language."""
    judged, known = _judged(spark, d)
    named = label_language(F.col("label"), known)
    wrong = named.isNull() | (named != F.col("main")) | (F.size("langs") > 1)
    return judged.filter(F.col("main").isNotNull() & wrong).select("doc_id", F.explode("langs.lang").alias("lang"))


def p10_labels(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, lang, confidence) of every document; null for those without a language."""
    judged, _ = _judged(spark, d)
    return judged.select("doc_id", F.col("main").alias("lang"), F.get(F.filter("langs", lambda s: s["lang"] == F.col("main")), F.lit(0))["confidence"].alias("confidence"))


def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, segment, lang, sentences, chars, confidence) in the order of the text."""
    docs, reference = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "lang_reference"))
    s = segmented(docs, fitted(reference, docs))
    return s.select("doc_id", F.posexplode("segments").alias("segment", "s")).select("doc_id", "segment", "s.*")


QUERIES = {"p10_found": p10_found, "p10_labels": p10_labels, "p10_segments": p10_segments}
