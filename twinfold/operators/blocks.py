"""Matching blocks (Ratcliff and Obershelp's) of many pairs of texts at once: rows of bits, a step of numpy for a character of all pairs.

The blocks are those of ``difflib.SequenceMatcher(None, a, b, autojunk=False)``: the longest one, the earliest in a and then in b among equal ones, and so
on left and right of it.
"""

from __future__ import annotations

import difflib

import numpy as np

#: Rectangles that are searched together, and numbers of the table of bits.
TOGETHER, TABLE = 2048, 8_000_000
#: Characters above which a text is compared by difflib.
LONG = 1024
_ONE, _ALL = np.uint64(1), ~np.uint64(0)


class Texts:
    """Texts of at most LONG characters, encoded for comparisons: lengths, codes, and the places of every character as bits."""

    def __init__(self, texts: list[str]):
        self.n = np.array([len(t) for t in texts], np.int64)
        self.width = int(self.n.max(initial=0)) + 1
        chars, code = np.unique(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
        self.none = len(chars)
        self.kinds, self.words = len(chars) + 1, (self.width + 63) // 64 + 1
        self.code = np.full((len(texts), self.width), self.none, np.int32)
        there = np.arange(self.width) < self.n[:, None]
        self.code[there] = code
        text, place = np.nonzero(there)
        self.bits = np.zeros(len(texts) * self.kinds * self.words, np.uint64)
        np.bitwise_or.at(self.bits, (text * self.kinds + code) * self.words + (place >> 6), _ONE << (place & 63).astype(np.uint64))
        self.code = self.code.ravel()


def pieces(texts: list[str]) -> int:
    """Parts to cut a list into, so that the table of each is bounded."""
    kinds, words = len(set().union(*texts)) + 1 if texts else 1, max(map(len, texts), default=0) // 64 + 2
    return -(-len(texts) * kinds * words // TABLE) or 1


def _longest(t: Texts, a, b, r0, r1, c0, c1, height: int, words: int):
    """Longest common block of every rectangle (rows of text a, columns of text b): its size, row and column."""
    n = len(a)
    rows = r0 + np.arange(height)[:, None]
    code = np.where(rows < r1, t.code[a * t.width + np.minimum(rows, t.width - 1)], t.none)
    at = (b * t.kinds + code) * t.words + (c0 >> 6)
    s = (c0 & 63).astype(np.uint64)
    up = np.uint64(63) - s
    x = np.empty((words, height, n), np.uint64)
    low = t.bits[at]
    for w in range(words):
        high = t.bits[np.minimum(at + w + 1, len(t.bits) - 1)]  # beyond its text only for columns that the mask takes away
        left = np.clip(c1 - c0 - 64 * w, 0, 64)
        mask = np.where(left == 64, _ALL, (_ONE << np.minimum(left, 63).astype(np.uint64)) - _ONE)
        np.bitwise_and((low >> s) | ((high << up) << _ONE), mask, out=x[w])
        low = high
    size, row, col, who = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n)
    y, old, k, held = x, None, 0, np.ones(n, bool)  # y: where blocks of k + 1 characters begin
    while True:
        alive = _any(y) if y.shape[1] else np.zeros(len(who), bool)
        if k and not np.array_equal(alive, held):
            gone = np.flatnonzero(held & ~alive)
            z = old.take(gone, 2)
            r = (_any(z, 0) != 0).argmax(0)
            line = z[:, r, np.arange(len(gone))]
            w = (line != 0).argmax(0)
            v = line[w, np.arange(len(gone))]
            size[who[gone]], row[who[gone]], col[who[gone]] = k, r, 64 * w + np.bitwise_count((v & (~v + _ONE)) - _ONE)
        left = np.count_nonzero(alive)
        if not left:
            return size, r0 + row, c0 + col
        if left < 0.75 * len(who):
            keep = np.flatnonzero(alive)
            x, y, who, alive = x[:, : y.shape[1]].take(keep, 2), y.take(keep, 2), who[keep], alive[keep]
        k, held, old = k + 1, alive, y
        y = old[:, 1:] >> _ONE
        for w in range(words - 1):
            y[w] |= old[w + 1, 1:] << np.uint64(63)
        y &= x[:, : y.shape[1]]


def _any(bits, axis: int | None = None):
    """Bits joined over the first axis; without one, for every place of the last axis whether a bit is set."""
    if axis is not None:
        return bits[0] if bits.shape[axis] == 1 else np.bitwise_or.reduce(bits, axis)
    return np.bitwise_or.reduce(bits.reshape(-1, bits.shape[-1]), 0) != 0 if bits.ndim > 2 else bits


def matches(t: Texts, a, b, r0, r1, c0, c1, above=None):
    """Matching characters of every rectangle, and its blocks (number of the rectangle, row, column, size), the longest of each first.

    ``above``: a rectangle that can't have more than so many is left as soon as that is known; its number is then of no use but not larger.
    """
    count, blocks = np.zeros(len(a), np.int64), []
    at = np.arange(len(a))
    while True:
        keep = (r1 > r0) & (c1 > c0)
        if above is not None:
            most = count + np.bincount(at, weights=np.where(keep, np.minimum(r1 - r0, c1 - c0), 0), minlength=len(count))
            keep &= (most > above)[at]
        at, r0, r1, c0, c1 = (v[keep] for v in (at, r0, r1, c0, c1))
        if not len(at):
            break
        height = np.left_shift(1, np.ceil(np.log2(r1 - r0)).astype(np.int64))
        height = np.where(r1 - r0 > 32, -(-(r1 - r0) // 16) * 16, height)
        words = (c1 - c0 + 63) >> 6
        kind = height * 64 + words
        order = np.argsort(kind, kind="stable")
        edges = np.flatnonzero(np.r_[True, np.diff(kind[order]) != 0, True])
        size, i, j = (np.zeros(len(at), np.int64) for _ in range(3))
        for lo, hi in zip(edges[:-1], edges[1:]):
            step = max(64, TOGETHER * 16 // int(height[order[lo]]))
            for p in range(lo, hi, step):
                o = order[p : min(p + step, hi)]
                size[o], i[o], j[o] = _longest(t, a[at[o]], b[at[o]], r0[o], r1[o], c0[o], c1[o], int(height[o[0]]), int(words[o[0]]))
        hit = size > 0
        at, r0, r1, c0, c1, size, i, j = (v[hit] for v in (at, r0, r1, c0, c1, size, i, j))
        count += np.bincount(at, weights=size, minlength=len(count)).astype(np.int64)
        blocks.append(np.stack([at, i, j, size]))
        at, r0, r1, c0, c1 = np.r_[at, at], np.r_[r0, i + size], np.r_[i, r1], np.r_[c0, j + size], np.r_[j, c1]
    return count, np.concatenate(blocks, 1) if blocks else np.zeros((4, 0), np.int64)


def compared(pairs: list[tuple[str, str]], partial: list[bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ratio, length of the longest common substring and, where wanted, partial ratio of pairs of texts.

    The partial ratio is the best ratio of the shorter text with a part of the longer one of its length, tried at every matching block; the longer one's is the
    first sequence. The second text must not be the shorter one where it is wanted.
    """
    ratio, common, part = np.zeros(len(pairs)), np.zeros(len(pairs), np.int64), np.zeros(len(pairs))
    todo = []
    for k, (a, b) in enumerate(pairs):
        if a == b:
            ratio[k] = part[k] = float(a != "")
            common[k] = len(a)
        elif len(a) > LONG or len(b) > LONG:
            m = difflib.SequenceMatcher(None, a, b, autojunk=False)
            blocks = m.get_matching_blocks()
            ratio[k], common[k] = m.ratio() if a and b else 0.0, max(x.size for x in blocks)
            if partial[k] and a:
                own = difflib.SequenceMatcher(None, "", a, autojunk=False)
                for lo in {max(0, x.b - x.a) for x in blocks}:
                    own.set_seq1(b[lo : lo + len(a)])
                    if own.quick_ratio() > part[k]:
                        part[k] = max(part[k], own.ratio())
        elif a and b:
            todo.append(k)
    todo = np.array(todo, np.int64)[np.argsort([max(map(len, pairs[k])) for k in todo], kind="stable")] if todo else np.zeros(0, np.int64)
    for own in np.array_split(todo, pieces([x for k in todo for x in pairs[k]])):
        number: dict[str, int] = {}
        a, b = (np.array([number.setdefault(pairs[k][side], len(number)) for k in own], np.int64) for side in (0, 1))
        if not len(own):
            continue
        t = Texts(list(number))
        zero = np.zeros(len(own), np.int64)
        count, (at, i, j, size) = matches(t, a, b, zero, t.n[a], zero, t.n[b])
        ratio[own] = 2.0 * count / (t.n[a] + t.n[b])
        np.maximum.at(common, own[at], size)
        wanted = np.array([partial[k] for k in own], bool)
        if not wanted.any():
            continue
        every = np.flatnonzero(wanted)
        first = np.zeros(len(own), bool)
        first[at[: len(np.unique(at))]] = True  # the first level has the longest block of each pair that has one
        longest = np.unique(at[: first.sum()], return_index=True)
        lead = np.full(len(own), -1, np.int64)
        lead[longest[0]] = np.maximum(0, j - i)[longest[1]]
        use = wanted[at]
        wide = t.width
        keys = np.unique(np.r_[at[use] * wide + np.maximum(0, j - i)[use], every * wide + (t.n[b] - t.n[a])[every]])
        who, lo = keys // wide, keys % wide
        best = np.zeros(len(own))
        for turn in (lo == lead[who], lo != lead[who]):
            p, start = who[turn], lo[turn]
            end = np.minimum(start + t.n[a][p], t.n[b][p])
            both = end - start + t.n[a][p]
            got, _ = matches(t, b[p], a[p], start, end, np.zeros(len(p), np.int64), t.n[a][p], np.floor(best[p] * both / 2 - 1e-6))
            np.maximum.at(best, p, 2.0 * got / both)
        part[own[every]] = best[every]
    return ratio, common, part
