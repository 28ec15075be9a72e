"""Periodic runs of words: tandem repeats by the method of Gusfield and Stoye, merged into maximal runs.

Texts are sequences of word numbers. Stretches of 1, 2, 4, ... words get ranks by doubling (``Index``), which give the
suffix array, and common extensions of two places in either direction in as many steps as there are ranks.
The suffix tree is read off the suffix array: a node is the interval of suffixes that share so many words.

1. Lempel-Ziv blocks: each is the longest stretch that also begins earlier. A square's leftmost occurrence has its
   centre in a block and reaches over one of its ends, so extensions from the blocks' ends give a leftmost covering set.
2. From these squares the walk by suffix links (drop the first word, append it at the end) goes on, inside a run by
   moving one place, at a run's end by descending from the node of the shortened square, until a square doesn't occur
   or its node is marked: then the nodes are the complete vocabulary of squares of primitive roots.
3. The leaves below the nodes are the squares' occurrences; those of one period in consecutive places are a run.

Everything is numpy over a few texts at once, inside the tasks of one map over the table: no shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run's least length in words, and its least length in periods.
LEAST, TIMES = 24, 3
#: Words that are indexed together (a longer text is indexed alone), and bytes of text that are split at once.
TOGETHER, BYTES = 200_000, 16 << 20
#: Entries of the memo of words before it is emptied.
MEMO = 1_000_000
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _mins(values: np.ndarray) -> list[np.ndarray]:
    """Table k holds the least of each 2**k neighbours."""
    out = [values]
    while 2 << (len(out) - 1) <= len(values):
        half = 1 << (len(out) - 1)
        out.append(np.minimum(out[-1][:-half], out[-1][half:]))
    return out


def _leftwards(mins: list[np.ndarray], at: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The smallest y with all values of [y, at) at ``least`` or over."""
    at = at.copy()
    for k in reversed(range(len(mins))):
        to = at - (1 << k)
        ok = to >= 0
        ok[ok] = mins[k][to[ok]] >= least[ok]
        at[ok] = to[ok]
    return at


def _rightwards(mins: list[np.ndarray], at: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The largest y with all values of [at, y) at ``least`` or over."""
    at = at.copy()
    for k in reversed(range(len(mins))):
        ok = at < len(mins[k])
        ok[ok] = mins[k][at[ok]] >= least[ok]
        at[ok] += 1 << k
    return at


def _counted(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i the numbers first[i], first[i] + 1, ... (count[i] of them), and the i's that they belong to."""
    of = np.repeat(np.arange(len(first)), count)
    return first[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count), of


class Index:
    """Ranks of all stretches of 2**k words, suffix array and common prefixes of a sequence.

    The last word of the sequence must occur once in it; words that occur once end what is equal.
    """

    def __init__(self, words: np.ndarray):
        n = len(words)
        _, place, times = np.unique(words, return_inverse=True, return_counts=True)
        self.words, self.ranks = place.astype(np.int64), [(np.cumsum(times) - times)[place]]
        rank, active, size = self.ranks[0], np.flatnonzero(times[place] > 1), 1
        while len(active):
            # the last word occurs once, so a stretch that isn't alone ends before it, and active + size < n
            old, second = rank[active], rank[np.minimum(active + size, n - 1)]
            order = np.lexsort((second, old))
            active, old, second = active[order], old[order], second[order]
            at = np.arange(len(active))
            group = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], at, 0))
            new = np.r_[True, (old[1:] != old[:-1]) | (second[1:] != second[:-1])]
            first = np.maximum.accumulate(np.where(new, at, 0))
            rank = rank.copy()
            rank[active] = old + first - group
            self.ranks.append(rank)
            alone = new & np.r_[new[1:], True]
            active, size = active[~alone], size * 2
        self.rank, self.suffixes = rank, np.empty(n, np.int64)
        self.suffixes[rank] = np.arange(n)
        self.common = _mins(self.ahead(self.suffixes[:-1], self.suffixes[1:])) if n > 1 else []

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from a on equal those from b on (a and b differ)."""
        out = np.zeros(len(a), np.int64)
        for k in reversed(range(len(self.ranks))):
            out[self.ranks[k][a + out] == self.ranks[k][b + out]] += 1 << k
        return out

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before a equal those before b."""
        out = np.zeros(len(a), np.int64)
        for k in reversed(range(len(self.ranks))):
            x, y = a - out - (1 << k), b - out - (1 << k)
            ok = (x >= 0) & (y >= 0)
            ok[ok] = self.ranks[k][x[ok]] == self.ranks[k][y[ok]]
            out[ok] += 1 << k
        return out

    def node(self, at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last place in the suffix array of the suffixes that share ``depth`` words with that at ``at``."""
        rank = self.rank[at]
        return _leftwards(self.common, rank, depth), _rightwards(self.common, rank, depth)

    def child(self, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray, word: np.ndarray) -> np.ndarray:
        """A place below the node (lo, hi, depth) that goes on with ``word``, or -1."""
        word_at = lambda x: self.words[self.suffixes[x] + depth]
        end, last = lo.copy(), hi.copy()
        while (end < last).any():
            mid = (end + last) // 2
            low = word_at(mid) < word
            end, last = np.where(low & (end < last), mid + 1, end), np.where(low, last, np.minimum(mid, last))
        return np.where(word_at(end) == word, self.suffixes[end], -1)

    def blocks(self) -> np.ndarray:
        """Starts of the Lempel-Ziv blocks, and the length at the end."""
        mins, place = _mins(self.suffixes), np.arange(len(self.suffixes))
        longest = np.zeros(len(place), np.int64)
        before, after = _leftwards(mins, place, self.suffixes + 1) - 1, _rightwards(mins, place + 1, self.suffixes + 1)
        for other, ok in ((before, before >= 0), (after, after < len(place))):
            at = self.suffixes[ok]
            longest[at] = np.maximum(longest[at], self.ahead(at, self.suffixes[other[ok]]))
        to, out = (np.arange(len(place)) + np.maximum(longest, 1)).tolist(), [0]
        while out[-1] < len(to):
            out.append(to[out[-1]])
        return np.array(out)


def _covering(index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of squares that cover the leftmost occurrences of all squares."""
    ends = index.blocks()
    h, h1, h2 = ends[:-1], ends[1:], np.r_[ends[2:], ends[-1:]]
    inside = h1 < len(index.words)
    # the right half reaches over the block's end
    k, of = _counted(np.ones(inside.sum(), np.int64), (h1 - h)[inside])
    end = h1[inside][of]
    fore, back = index.ahead(end, end - k), index.behind(end, end - k)
    ok = (fore > 0) & (fore + back >= k)
    out = [(np.maximum(end - k - back, end - 2 * k + 1)[ok], k[ok])]
    # the left half begins before the block
    k, of = _counted(np.ones(len(h), np.int64), np.minimum(h2 - h, len(index.words) - 1 - h))
    end = h[of]
    fore, back = index.ahead(end, end + k), index.behind(end, end + k)
    start = np.maximum(end - back, end - k + 1)
    ok = (fore > 0) & (back > 0) & (fore + back >= k) & (start + k <= h1[of])
    out.append((start[ok], k[ok]))
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def _primitive(index: Index, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether the squares' roots aren't powers themselves."""
    least = np.arange(period.max(initial=1) + 1)  # least prime factor
    for p in range(2, int(len(least) ** 0.5) + 1):
        multiples = least[p * p :: p]
        if least[p] == p:
            multiples[multiples == np.arange(p * p, len(least), p)] = p
    out, rest = np.ones(len(start), bool), period.copy()
    while (todo := np.flatnonzero(out & (rest > 1))).size:
        prime = least[rest[todo]]
        part = period[todo] // prime
        out[todo] = index.ahead(start[todo], start[todo] + part) < 2 * period[todo] - part
        rest[todo] //= prime
    return out


def runs(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and least period of every maximal run of two periods or more of a sequence whose last word occurs once, by period and start."""
    index, n = Index(words), len(words)
    none = np.zeros(0, np.int64)
    if len(index.ranks) == 1:
        return none, none, none
    start, period = _covering(index)
    ok = _primitive(index, start, period)
    start, period = start[ok], period[ok]
    lo, hi, size, keys = [none], [none], [none], none
    while len(start):
        first, _ = index.node(start, 2 * period)
        _, one = np.unique(first * (n + 1) + period, return_index=True)
        one = one[~np.isin((first * (n + 1) + period)[one], keys)]
        start, period = start[one], period[one]
        # the square and those that follow it in its run, one place each
        steps = np.minimum(index.ahead(start, start + period) - period, period - 1)
        at, of = _counted(start, steps + 1)
        first, last = index.node(at, 2 * period[of])
        key, one = np.unique(first * (n + 1) + period[of], return_index=True)
        one = one[fresh := ~np.isin(key, keys)]
        keys = np.union1d(keys, key[fresh])
        lo.append(first[one])
        hi.append(last[one])
        size.append(period[of][one])
        # at the run's end: from the node of the square without its first word, on by that word
        going = steps < period - 1
        at, period = (start + steps)[going], period[going]
        depth = 2 * period - 1
        start = index.child(*index.node(at + 1, depth), depth, index.words[at]) if len(at) else none
        period, start = period[start >= 0], start[start >= 0]
    lo, hi, size = map(np.concatenate, (lo, hi, size))
    leaf, of = _counted(lo, hi - lo + 1)
    key = np.sort(size[of] * (n + 1) + index.suffixes[leaf])
    if not len(key):
        return none, none, none
    begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1] + 1])
    period, start = np.divmod(key[begins], n + 1)
    last = key[np.r_[begins[1:], len(key)] - 1] % (n + 1)
    return start, last - start + 2 * period, period


def texts_with_repeats(texts: list[np.ndarray], stretch: int) -> np.ndarray:
    """Which texts (word numbers) hold two equal stretches of so many words (a power of 2), with a few more by chance of hashing.

    A run of 3 periods and 24 words repeats its first 16 words, so no other text has one.
    """
    sizes = np.array([len(x) for x in texts], np.int64)
    of = np.repeat(np.arange(len(texts)), sizes)
    value = np.concatenate([np.zeros(0, np.uint64), *texts]).astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        factor, size = np.uint64(0x9E3779B97F4A7C15), 1
        value = value * factor
        value ^= value >> np.uint64(29)
        while size < stretch and len(value) > size:
            value = value[:-size] * factor + value[size:]
            factor, size = factor * factor, size * 2
        if size < stretch:
            return np.zeros(len(texts), bool)
        whole = of[: len(value)] == of[stretch - 1 :]
        value, of = value[whole], of[: len(value)][whole]
        value = (value ^ (value >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + of.astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    ordered = np.sort(value)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    out = np.zeros(len(texts), bool)
    if len(twice):
        out[of[np.isin(value, twice)]] = True
    return out


def runs_of_texts(texts: list[np.ndarray], least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """For each text (word numbers) its runs (start, length, period) by start, then period, of ``least`` words and ``times`` periods or more."""
    out: list[list] = [[] for _ in texts]
    stretch = max(1, 1 << (max(least - least // times, 1).bit_length() - 1)) if times > 1 else 1
    todo = np.flatnonzero(texts_with_repeats(texts, stretch)).tolist()
    while todo:
        group = [todo.pop()]
        words = len(texts[group[0]])
        while todo and words + len(texts[todo[-1]]) <= TOGETHER:
            words += len(texts[todo[-1]])
            group.append(todo.pop())
        # a word number for each text and word, texts in order, and one that occurs once after each text
        wide = max(int(texts[i].max(initial=0)) for i in group) + 2
        sequence = np.concatenate([np.r_[texts[i].astype(np.int64), wide - 1] + j * wide for j, i in enumerate(group)])
        begins = np.cumsum([0, *[len(texts[i]) + 1 for i in group]])
        start, length, period = runs(sequence)
        ok = length >= np.maximum(least, times * period)
        start, length, period = start[ok], length[ok], period[ok]
        place = np.searchsorted(begins, start, side="right") - 1
        for j, s, m, p in sorted(zip(place.tolist(), (start - begins[place]).tolist(), length.tolist(), period.tolist(), strict=True), key=lambda x: (x[0], x[1], x[3])):
            out[group[j]].append((s, m, p))
    return out


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that stand in a run after its first period."""
    if not found:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in found:
        keep[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def tailed(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of op13's contract: a tenth of the ids, by their crc32, repeat a stretch to the end."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def _rows(ids: list, texts: list, edit: bool, numbers: _Numbers) -> Iterator[tuple]:
    split = [(text or b"").split() for text in texts]  # bytes split at the contract's white space: 0x20, 0x09 to 0x0D
    if edit:
        split = [tailed(words, doc_id) for words, doc_id in zip(split, ids, strict=True)]
    numbered = [np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)) for words in split]
    for doc_id, words, found in zip(ids, split, runs_of_texts(numbered), strict=True):
        best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        digest = sha256("".join(f"{s},{m},{p}\n" for s, m, p in found).encode()).hexdigest()
        start, length, period = best or (None, None, None)
        yield doc_id, len(found), start, length, period, best and 1000 * length // period, digest, sha256(b" ".join(collapsed(words, found))).hexdigest()


def periodic_runs(docs: DataFrame, edit: bool = False) -> DataFrame:
    """The runs of every whole text of ``docs`` (doc_id, text) and the text's digest without their repeats.

    Words are stretches without white space (0x20, 0x09 to 0x0D). A run is a maximal stretch of words of a
    smallest period q, of 24 words and 3 periods at least; overlapping and nested runs all count. Returns
    doc_id, n_runs, the run of greatest length/period (start, length, period, exponent_milli; ties: least
    start, then period), digests of all runs and of the text without words that repeat in a run. With
    ``edit`` texts are first changed as op13's contract says (a null doc_id: unchanged).

    Null and empty texts have no words: no run, nulls, digests of the empty text. Repeated rows and ids
    each give a row; an empty table gives none; other columns are ignored. A text that repeats
    16 words is indexed whole in its task, with about 400 bytes a word; other texts can't hold a run.
    """
    names = [field.split(" ")[0] for field in SCHEMA.split(", ")]
    schema = pa.schema([(f.split(" ")[0], pa.int64() if f.endswith("long") else pa.string()) for f in SCHEMA.split(", ")])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _Numbers()
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            sizes = np.cumsum([0 if x is None else x for x in pc.binary_length(texts).to_pylist()]) // BYTES
            cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(ids)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a < b:
                    rows = list(_rows(ids[a:b], texts.slice(a, b - a).to_pylist(), edit, numbers))
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], names=names)
                    if len(numbers) > MEMO:
                        numbers.clear()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(find, SCHEMA)


def op13_periodic(spark, sf_dir: str) -> DataFrame:
    return periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), edit=True)
