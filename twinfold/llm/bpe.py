"""Encoding a corpus with a public byte-level BPE vocabulary (problem 8), by a tokenization automaton.

The merges are compiled, in their order, into a deterministic automaton over tokens whose paths are the
correct tokenizations. It starts as one state with a loop for every byte. The gadget of merge (u, v) -> w
adds the arc w wherever u and then v can be taken, and lets u, taken alone, no longer be followed by v:
the state in which u ends is split from that of the other tokens that end there, and loses arc v.
A state is kept as its parent at the time of the split and the arcs that it lost since, with the merge at
which it lost them; whether a state has an arc follows from the arc's left children, and is looked up in a
table once worked out.

As every prefix of a word has one correct tokenization, encoding holds one state per position of the word
and takes the table's transitions from left to right; decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import importlib.util
import json
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Distinct words whose ids a worker remembers.
REMEMBERED = 300_000
#: Fixed value: the pre-split pattern of this family of vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_vocabulary() -> str:
    """Path of byte_bpe_50k.json among the public tokenizers."""
    return str(Path(importlib.util.find_spec("public_tokenizers").origin).parent / "byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """The tokenization automaton of a vocabulary file's content."""

    def __init__(self, data: bytes):
        model = json.loads(data)["model"]
        letters = byte_letters()
        ids: dict[str, int] = model["vocab"]
        raw = {t: bytes(map(letters.__getitem__, t)) for t in ids if all(c in letters for c in t)}
        self.label = {ids[t]: b for t, b in raw.items()}
        self.left: dict[int, int] = {}  # token -> left child
        self.born: dict[int, int] = {}  # token -> its merge
        self.ends: dict[int, int] = {}  # token -> state in which its arcs end
        self.parent, self.split_at = [-1], [0]
        self.lost: list[dict[int, int]] = [{}]
        sharers: list[set[int]] = [set()]
        for t, b in raw.items():
            if len(b) == 1:
                self.ends[ids[t]] = 0
                sharers[0].add(ids[t])
        for k, m in enumerate(model["merges"], 1):
            x, y = m.split(" ") if isinstance(m, str) else m
            u, v, w = ids[x], ids[y], ids[x + y]
            if u not in self.ends or v not in self.ends or not self._has(self.ends[u], v, k):
                continue  # u and v never meet: the merge adds no arc
            before = self.ends[u]
            if len(sharers[before]) > 1:  # a state of u's own, which keeps the arcs but can lose some
                sharers[before].discard(u)
                self.parent.append(before)
                self.split_at.append(k)
                self.lost.append({})
                sharers.append({u})
                self.ends[u] = len(self.parent) - 1
            elif u == v:  # w ends where u's arcs are still whole
                self.parent.append(before)
                self.split_at.append(k)
                self.lost.append({})
                sharers.append(set())
                before = len(self.parent) - 1
            self.left[w], self.born[w] = u, k
            self.ends[w] = before if u == v else self.ends[v]
            sharers[self.ends[w]].add(w)
            self.lost[self.ends[u]].setdefault(v, k)
            if u == v:  # runs are paired from the left: a single u ends them
                self.lost[self.ends[u]].setdefault(w, k)
        self.by_bytes: dict[bytes, int] = {}
        for i, b in self.label.items():
            if b not in self.by_bytes and i in self.ends:
                self.by_bytes[b] = i
        self.longest = max(map(len, self.by_bytes))
        self.starts: dict[bytes, int] = {}  # first two bytes -> longest token that begins so
        for b in self.by_bytes:
            self.starts[b[:2]] = max(self.starts.get(b[:2], 0), len(b))
        self.table: dict[int, int] = {}  # state * 2^20 + token -> state reached, -1 for none

    def _lost(self, state: int, token: int) -> int:
        """The merge at which the state, or its parent before the split, lost the arc; 0 if never."""
        until = 1 << 30
        while state >= 0:
            at = self.lost[state].get(token, 0)
            if at and at < until:
                return at
            until = min(until, self.split_at[state])
            state = self.parent[state]
        return 0

    def _has(self, state: int, token: int, now: int) -> bool:
        """Whether the state has the arc at merge ``now``: not lost before, nor its left children before the merges that used them."""
        while True:
            at = self._lost(state, token)
            if at and at < now:
                return False
            if token not in self.left:
                return True
            now, token = self.born[token], self.left[token]

    def step(self, state: int, token: int) -> int:
        """The state reached from ``state`` by ``token``, -1 if there is no such arc."""
        key = state << 20 | token
        got = self.table.get(key)
        if got is None:
            if len(self.table) > 4_000_000:
                self.table.clear()
            got = self.table[key] = self.ends[token] if self._has(state, token, 1 << 30) else -1
        return got

    def encode_word(self, word: bytes) -> list[int]:
        n = len(word)
        whole = self.by_bytes.get(word)
        if whole is not None and self.step(0, whole) >= 0:
            return [whole]
        states, came, by = [-1] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        states[0] = 0
        tokens, starts, table = self.by_bytes, self.starts, self.table
        for i in range(n):
            s = states[i]
            if s < 0:
                continue
            for j in range(i + 1, min(n, i + starts.get(word[i : i + 2], 1)) + 1):
                t = tokens.get(word[i:j])
                if t is None or states[j] >= 0:
                    continue
                to = table.get(s << 20 | t)
                if to is None:
                    to = self.step(s, t)
                if to >= 0:
                    states[j], came[j], by[j] = to, i, t
        out, i = [], n
        while i:
            out.append(by[i])
            i = came[i]
        return out[::-1]

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, joined."""
        return b"".join(self.label[i] for i in ids).decode("utf-8", "replace")


_MACHINES: dict[str, Automaton] = {}


def automaton(digest: str, data: bytes) -> Automaton:
    """The automaton of a content, once per process; the latest few are kept."""
    if digest not in _MACHINES:
        while len(_MACHINES) >= 4:
            _MACHINES.pop(next(iter(_MACHINES)))
        _MACHINES[digest] = Automaton(data)
    return _MACHINES[digest]


def shipped(spark: SparkSession, path: str | None):
    """The vocabulary file's content, read by the driver and broadcast with its digest: workers open no path. A few MB, whatever the data."""
    data = Path(path or default_vocabulary()).read_bytes()
    return spark.sparkContext.broadcast((hashlib.sha256(data).hexdigest(), data))


class Encoder:
    """Encodes texts and remembers the ids of words; its memory is bounded by REMEMBERED words of 64 letters or fewer."""

    def __init__(self, machine: Automaton):
        self.machine, self.words = machine, {}
        self.split = regex.compile(PATTERN).findall

    def __call__(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        known = self.words
        for w in self.split(text):
            got = known.get(w)
            if got is None:
                got = self.machine.encode_word(w.encode("utf-8", "replace"))
                if len(known) > REMEMBERED:
                    known.clear()
                if len(w) <= 64:
                    known[w] = got
            out += got
        return out


def encoded(df: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids): the token ids of every text, without special tokens, whose strings are ordinary text.

    One row per row of ``df``; a null and an empty text give an empty list. Nothing is shuffled: texts
    are encoded whole, where they are read.
    """
    shared = shipped(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(automaton(*shared.value))
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                ids = [encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def token_counts(df: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens)."""
    return encoded(df, id_col, text, path).select("doc_id", F.size("ids").alias("n_tokens"))


def decoded(df: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give a null text."""
    shared = shipped(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = automaton(*shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else m.decode(x) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoded(spark.read.parquet(f"{d}/documents.parquet"))


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, text) as decoded from the ids."""
    return decoded(p8_ids(spark, d))


SQL = {"p8_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents"}
QUERIES = {"p8_ids": p8_ids, "p8_round_trip": p8_round_trip}
