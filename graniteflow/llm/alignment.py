"""Alignment of two tokenizers over the same bytes, with counts of linked ids over all documents.

A byte-level vocabulary (A) encodes the text after a space, a piece vocabulary (B) the text, before which it puts a
space itself. Bitsets over the bytes mark where tokens of A and of B end; their AND gives the shared cuts, popcounts
over the words of the bitsets tell how many tokens end up to a cut (rank) and where the set bits are (select). Tokens
between two shared cuts are a group; every A token of a group is linked with every B token of it.

Neither vocabulary joins a letter with a space after it, so a text's tokens are those of its stretches (a word with
the spaces before it) one after the other, and a stretch's end is a shared cut. The stretches of a batch that a worker
hasn't met lately are encoded and aligned at once, in one pair of bitsets; a bounded memo keeps the rest.

Counting pairs of ids over all documents and giving the counts back to the documents takes no row for each document
and pair: documents stay in packs, a pack's distinct pairs are asked for once, and the answers meet the pack again.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graniteflow.llm.common import written
from graniteflow.llm.tokens import byte_of_letter, default_path, reachable

#: Stretches that a worker's memo holds before it is emptied. Documents and bytes of text in a pack, at most (or one document).
MEMO, PACK_ROWS, PACK_BYTES = 300_000, 512, 2 << 20
#: The piece vocabulary's mark of a space; the byte vocabulary's split pattern; where a stretch begins; texts in which
#: not just every space begins one; and stretches that tiktoken's merge loop, with the same vocabulary, is given instead of the library.
SPACE = "▁"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
STRETCH, UNEVEN = re.compile(r"(?<=\S)(?= )"), re.compile(r"\s |^ | $")
PLAIN = re.compile("[\n!-~à-öø-ÿœ¿¡«»–—’“”…ÄÖÜßÀÂÇÈÉÊËÎÏÔÙÛÑÓÍÁÚ]+")

PACKED = "pack long, place int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def popcount_ranks(bits: np.ndarray) -> np.ndarray:
    """How many bits are set before each word of a bitset."""
    return np.r_[0, np.cumsum(np.bitwise_count(bits), dtype=np.int64)]


def rank(bits: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many bits of positions up to and with ``at`` are set."""
    word, bit = at >> 6, (at & 63).astype(np.uint64)
    mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(63) - bit)
    return before[word] + np.bitwise_count(bits[word] & mask)


def select(bits: np.ndarray) -> np.ndarray:
    """The positions of the set bits."""
    full = np.flatnonzero(bits)
    low = np.unpackbits(bits[full].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    word, bit = np.nonzero(low)
    return full[word] * 64 + bit


def bitset(ends: np.ndarray, size: int) -> np.ndarray:
    """Packed bits of the positions ``ends`` (each once) of ``size``."""
    marks = np.zeros(-(-size // 64) * 64, bool)
    marks[ends] = True
    return np.packbits(marks, bitorder="little").view("<u8")


def shared_groups(ends_a: np.ndarray, ends_b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each group the number of the A tokens and of the B tokens up to its end, from the places of the tokens' last bytes."""
    a, b = bitset(ends_a, size), bitset(ends_b, size)
    cuts = select(a & b)
    return rank(a, popcount_ranks(a), cuts), rank(b, popcount_ranks(b), cuts)


def ranges(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i the numbers first[i], first[i] + 1, ... (count[i] of them), and the i's that they belong to."""
    of = np.repeat(np.arange(len(first)), count)
    return first[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count), of


class Aligner:
    """Tokens, groups and linked pairs of texts, with a memo of stretches. A pair is one number: the A id times ``wide`` plus the B id."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        with open(path_a, encoding="utf-8") as f:
            ranks = reachable(json.load(f)["model"])
        self.quick = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        byte, vocabulary = byte_of_letter(), self.a.get_vocab(with_added_tokens=True)
        self.bytes_a: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.wide = len(self.bytes_b)
        self.sizes_a, self.sizes_b = np.array(list(map(len, self.bytes_a)), np.int64), np.array(list(map(len, self.bytes_b)), np.int64)
        # ids as they are written: within a group, at the end of a side, at the end of a stretch
        self.written = [f"{i}{mark}" for mark in (",", "|") for i in range(len(self.bytes_a))] + [f"{i}{mark}" for mark in (",", ";", "\n") for i in range(self.wide)]
        # what cuts texts into stretches: no token goes on with a space after a letter
        self.cuts = not any(re.search(r"\S ", t.decode(errors="replace")) for t in [*self.bytes_a, *self.bytes_b])
        self.clear()

    def clear(self) -> None:
        #: From a stretch without its first space to its number.
        self.memo: dict[str, int] = {}
        self.groups: list[str] = []
        #: By stretch: n_a, n_b, n_groups, n_links, bad (its bytes aren't those of both sides' tokens), first and number of its pairs.
        self.counts = np.zeros((0, 7), np.int64)
        self.pairs, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def split(self, text: str) -> list[str]:
        """The stretches of a space and the text, each without its first space."""
        if not self.cuts:
            return [text]
        if not UNEVEN.search(text):
            return text.split(" ")
        out = [x[1:] for x in STRETCH.split(f" {text}")]
        if not out[-1] and len(out) > 1:  # B has no tokens for no text
            out[-2:] = [out[-2] + " "]
        return out

    def learn(self, new: list[str]) -> None:
        """Encodes and aligns stretches that the memo doesn't hold."""
        quick = self.quick
        ids_a = [quick(f" {x}") if PLAIN.fullmatch(x) else self.a.encode(f" {x}", add_special_tokens=False).ids for x in new]
        ids_b = self.b.encode(new, num_threads=1)
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64) for ids in (ids_a, ids_b))
        n_a, n_b = (np.fromiter(map(len, ids), np.int64, len(new)) for ids in (ids_a, ids_b))
        raw = [f" {x}".encode() for x in new]
        sizes = np.fromiter(map(len, raw), np.int64, len(new))
        counts, groups = np.zeros((len(new), 7), np.int64), [""] * len(new)
        of_a, of_b = np.repeat(np.arange(len(new)), n_a), np.repeat(np.arange(len(new)), n_b)
        same = [np.array_equal(np.bincount(of, weights=size[ids], minlength=len(new)), sizes) for of, size, ids in ((of_a, self.sizes_a, a), (of_b, self.sizes_b, b))]
        if not all(same) or not b"".join(map(self.bytes_a.__getitem__, a.tolist())) == b"".join(map(self.bytes_b.__getitem__, b.tolist())) == b"".join(raw):
            joined = lambda ids, table: b"".join(map(table.__getitem__, ids))
            bad = np.array([not joined(x, self.bytes_a) == joined(y, self.bytes_b) == r for x, y, r in zip(ids_a, ids_b, raw, strict=True)])
            counts[bad, 4], n_a[bad], n_b[bad] = 1, 0, 0
            a, b, of_a, of_b = a[~bad[of_a]], b[~bad[of_b]], of_a[~bad[of_a]], of_b[~bad[of_b]]
        if len(a):
            ends_a, ends_b = np.cumsum(self.sizes_a[a]) - 1, np.cumsum(self.sizes_b[b]) - 1
            up_a, up_b = shared_groups(ends_a, ends_b, int(ends_a[-1]) + 1)
            in_a, in_b = np.diff(up_a, prepend=0), np.diff(up_b, prepend=0)
            stretch = of_a[up_a - 1]  # a stretch's end is the end of a group
            counts[:, 0], counts[:, 1], counts[:, 2] = n_a, n_b, np.bincount(stretch, minlength=len(new))
            counts[:, 3] = np.bincount(stretch, weights=in_a * in_b, minlength=len(new)).astype(np.int64)
            good = np.flatnonzero(counts[:, 4] == 0).tolist()
            for i, text in zip(good, self._groups(a, b, up_a, up_b, np.r_[stretch[1:] != stretch[:-1], True]), strict=True):
                groups[i] = text
            # links: each A token of a group with each B token of it
            token, group = ranges(up_a - in_a, in_a)
            at, of = ranges((up_b - in_b)[group], in_b[group])
            key = np.sort(stretch[group][of] * (len(self.bytes_a) * self.wide) + a[token][of] * self.wide + b[at])
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            owner, link = np.divmod(key[starts], len(self.bytes_a) * self.wide)
            counts[:, 6] = np.bincount(owner, minlength=len(new))
            counts[:, 5] = len(self.pairs) + np.cumsum(counts[:, 6]) - counts[:, 6]
            self.pairs = np.r_[self.pairs, link]
            self.times = np.r_[self.times, np.diff(np.r_[starts, len(key)])]
        self.memo.update(zip(new, range(len(self.groups), len(self.groups) + len(new)), strict=True))
        self.groups += groups
        self.counts = np.concatenate([self.counts, counts])

    def _groups(self, a: np.ndarray, b: np.ndarray, up_a: np.ndarray, up_b: np.ndarray, last: np.ndarray) -> list[str]:
        """``a1,a2|b1;a3|b2`` of each stretch; last: whether a group is its stretch's last."""
        place_a = np.arange(len(a)) + np.repeat(up_b - np.diff(up_b, prepend=0), np.diff(up_a, prepend=0))
        place_b = np.arange(len(b)) + np.repeat(up_a, np.diff(up_b, prepend=0))
        kind_a, kind_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        kind_a[up_a - 1], kind_b[up_b - 1] = 1, 1 + last
        out = np.empty(len(a) + len(b), np.int64)
        out[place_a] = kind_a * len(self.bytes_a) + a
        out[place_b] = 2 * len(self.bytes_a) + kind_b * self.wide + b
        return "".join(map(self.written.__getitem__, out.tolist())).split("\n")[:-1]

    def align(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """n_a, n_b, n_groups, n_links by text; groups by text ('' without tokens); the distinct pairs of each text one after the other,
        how many links each has, and where those of each text begin (and the last end)."""
        if len(self.memo) > MEMO:
            self.clear()
        split = [self.split(text) if text else [] for text in texts]
        if new := list(set(chain.from_iterable(split)).difference(self.memo)):
            self.learn(new)
        n, sizes = len(texts), np.fromiter(map(len, split), np.int64, len(texts))
        at = np.fromiter(map(self.memo.__getitem__, chain.from_iterable(split)), np.int64)
        of = np.repeat(np.arange(n), sizes)
        bad = np.bincount(of, weights=self.counts[at, 4], minlength=n) > 0
        at, of = at[~bad[of]], of[~bad[of]]
        key, times = np.unique(of * len(self.groups) + at, return_counts=True)
        text, stretch = np.divmod(key, max(1, len(self.groups)))
        held = self.counts[stretch]
        sums = np.stack([np.bincount(text, weights=held[:, i] * times, minlength=n) for i in range(4)], axis=1).astype(np.int64)
        strings, ends = self.groups, np.cumsum(np.where(bad, 0, sizes))
        numbers = at.tolist()
        groups = [";".join(map(strings.__getitem__, numbers[x:y])) for x, y in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        place, row = ranges(held[:, 5], held[:, 6])
        key, weight = text[row] * (len(self.bytes_a) * self.wide) + self.pairs[place], self.times[place] * times[row]
        order = np.argsort(key)
        key, weight = key[order], weight[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        owner, pairs = np.divmod(key[starts], len(self.bytes_a) * self.wide)
        links = np.add.reduceat(weight, starts) if len(key) else weight
        return sums, groups, pairs, links, np.searchsorted(owner, np.arange(n + 1))


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One aligner for each pair of files and worker process."""
    return Aligner(path_a, path_b)


def piece_count(path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()


def _packs(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    sizes = np.array([x or 0 for x in pc.binary_length(batch.column("text")).to_pylist()], np.int64)
    begin, size = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > begin and (i - begin >= rows or size + n > PACK_BYTES):
            yield batch.slice(begin, i - begin)
            begin, size = i, 0
        size += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


def _schema(text: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split(" ") for f in text.split(", "))])


def aligned(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, rows: int = PACK_ROWS) -> DataFrame:
    """Counts, digest of the groups and linked pairs of every whole text of ``docs`` (doc_id, text), in packs.

    A pack is a number with up to ``rows`` documents or 2 MiB of text (or one longer document). Besides a row for
    each document (place from 0) it has a row without a place, of all its distinct pairs and in how many of
    its documents each is linked. pairs and times are little-endian 64-bit and 32-bit numbers.
    """
    path_a, path_b = path_a or default_path("byte_bpe_50k.json"), path_b or default_path("piece_bpe_32k.model")
    schema = _schema(PACKED)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        both, pack = aligner(path_a, path_b), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in _packs(batch, rows):
                sums, groups, pairs, links, begins = both.align(part.column("text").to_pylist())
                every, docs = np.unique(pairs, return_counts=True)
                links = links.astype("<u4")
                table = [
                    (pack, i, doc_id, *sums[i].tolist(), sha256(groups[i].encode()).hexdigest() if groups[i] else "", pairs[x:y].tobytes(), links[x:y].tobytes())
                    for i, (doc_id, x, y) in enumerate(zip(part.column("doc_id").to_pylist(), begins[:-1], begins[1:], strict=True))
                ]
                table.append((pack, None, None, 0, 0, 0, 0, "", every.tobytes(), docs.astype("<u4").tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*table, strict=True), schema, strict=True)], schema=schema)
                pack += 1

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(align, PACKED)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each pack and distinct pair of it, with its number of documents."""
    for batch in batches:
        for pack, pairs, times in zip(batch.column("pack").to_pylist(), batch.column("pairs").to_pylist(), batch.column("times").to_pylist(), strict=True):
            pair = np.frombuffer(pairs, "<i8")
            yield pa.RecordBatch.from_pydict({"pack": np.full(len(pair), pack), "pair": pair, "docs": np.frombuffer(times, "<u4").astype(np.int64)})


def _summed(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
    """The documents of a pack with the sums over their links of what is known of their pairs."""
    order = np.argsort(pair := answers.column("pair").to_numpy())
    pair, total, best = pair[order], answers.column("total").to_numpy()[order], answers.column("best").to_numpy(zero_copy_only=False)[order]
    n_best, count_sum = [], []
    for pairs, times in zip(docs.column("pairs").to_pylist(), docs.column("times").to_pylist(), strict=True):
        at, links = np.searchsorted(pair, np.frombuffer(pairs, "<i8")), np.frombuffer(times, "<u4").astype(np.int64)
        n_best.append(int(links[best[at]].sum()))
        count_sum.append(int((links * total[at]).sum()))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    columns = [docs.column(name) for name in names]
    return pa.table([*columns, pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), docs.column("groups_sha256")], names=[*names, "n_best", "count_sum", "groups_sha256"])


def pair_counts(packs: DataFrame) -> DataFrame:
    """pair and total, the number of documents that hold it linked, of all packs."""
    asked = packs.where("place is null").select("pack", "pairs", "times").mapInArrow(_unpacked, "pack long, pair long, docs long")
    return asked.groupBy("pair").agg(F.sum("docs").alias("total"))


def align_tokens(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, rows: int = PACK_ROWS) -> DataFrame:
    """Cross-tokenizer alignment of ``docs`` (doc_id, text) as op11 asks, one row for each row.

    Null and empty texts, and texts whose bytes aren't those of both sides' tokens after a space (such as
    texts that hold U+2581 themselves), have no tokens: zeros and an empty digest. Every row counts as a
    document of its own, so repeated rows count their pairs again; null ids are kept; an empty table gives
    no rows; other columns are ignored. n_best counts the links whose pair has its A id's highest count.
    """
    path_a, path_b = path_a or default_path("byte_bpe_50k.json"), path_b or default_path("piece_bpe_32k.model")
    packs = written(aligned(docs, path_a, path_b, rows), "aligned")  # pack numbers stay what they are
    wide = piece_count(path_b)
    id_a = F.floor(F.col("pair") / wide)
    counts = written(pair_counts(packs), "pair-counts")
    highest = counts.groupBy(id_a.alias("id_a")).agg(F.max("total").alias("highest"))  # one row for each id of A at most: the vocabulary bounds it
    known = counts.withColumn("id_a", id_a).join(F.broadcast(highest), "id_a").select("pair", "total", (F.col("total") == F.col("highest")).alias("best"))
    asked = packs.where("place is null").select("pack", "pairs", "times").mapInArrow(_unpacked, "pack long, pair long, docs long").select("pack", "pair")
    answers = asked.join(known, "pair").select("pack", "pair", "total", "best")
    out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return packs.where("place is not null").groupBy("pack").cogroup(answers.groupBy("pack")).applyInArrow(_summed, out)


def op11_align(spark, sf_dir: str) -> DataFrame:
    return align_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
