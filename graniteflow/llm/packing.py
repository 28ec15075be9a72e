"""Packing by vector bin packing with the dot-product heuristic.

Sequences are bins with three limits at once: tokens, segments (pieces of examples) and loss-bearing
tokens. Of the waiting pieces that fit, the one goes in whose demand vector has the largest dot product
with the bin's remaining room, both in shares of the limits. When none fits, the piece with the largest
product is cut to the room that is left, so that only the limits themselves can leave padding.

Every task packs what it reads, in passes over a bounded pool; nothing is shuffled, and a task that is
run again gives the same pieces. What a task has left at its end, less than one sequence, is cut at
powers of two, where no padding is due.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graniteflow.llm.tokens import default_path, encoder


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 4096  # as many as tokens: no limit of its own unless it is set lower
    loss: int = 4096

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.segments, self.loss], float)


class Packer:
    """Pieces of examples waiting for a sequence. A piece is (example, start, end); an example has its prompt's length, after which tokens bear loss."""

    def __init__(self, limits: Limits = Limits()):
        self.limits, self.cap = limits, limits.vector()
        self.prompt: dict[int, int] = {}
        self.waiting: dict[tuple[int, int], list[tuple[int, int, int]]] = {}  # by (tokens, loss tokens)
        self.held = 0

    def loss(self, example: int, start: int, end: int) -> int:
        return max(0, end - max(start, self.prompt[example]))

    def put(self, example: int, start: int, end: int) -> None:
        self.waiting.setdefault((end - start, self.loss(example, start, end)), []).append((example, start, end))
        self.held += end - start

    def add(self, example: int, tokens: int, prompt: int = 0) -> Iterator[list[tuple[int, int, int]]]:
        """Takes an example in; what fills sequences alone comes out at once."""
        self.prompt[example], start, cap = prompt, 0, self.limits
        while tokens - start > cap.tokens and cap.loss >= cap.tokens and cap.segments:
            yield [(example, start, start + cap.tokens)]
            start += cap.tokens
        if tokens > start:
            self.put(example, start, tokens)

    def room_in(self, piece: tuple[int, int, int], room: np.ndarray) -> int:
        """How many of the piece's first tokens fit."""
        example, start, end = piece
        free = max(0, min(end, self.prompt[example]) - start)  # before any loss
        return int(min(end - start, room[0], free + room[2])) if room[1] >= 1 else 0

    def sequences(self, keep: int) -> Iterator[list[tuple[int, int, int]]]:
        """Full sequences, as long as more than ``keep`` tokens wait."""
        while self.held > max(keep, self.limits.tokens):
            kinds = list(self.waiting)
            demand = np.array([(t, 1, z) for t, z in kinds], float)
            count = np.array([len(self.waiting[k]) for k in kinds])
            share = demand / np.maximum(self.cap, 1)
            for _ in range(256):  # then the table of kinds is drawn up anew
                room, out, again = self.cap.copy(), [], []
                while room[0] > 0 and room[1] > 0 and count.any():
                    gain = np.where(count > 0, share @ (room / np.maximum(self.cap, 1)), -1.0)
                    fits = (demand <= room).all(1) & (count > 0)
                    k = int(np.argmax(np.where(fits, gain, -1.0))) if fits.any() else int(np.argmax(gain))
                    piece = self.waiting[kinds[k]][-1]
                    n = self.room_in(piece, room)
                    if not n:
                        break
                    self.waiting[kinds[k]].pop()
                    count[k] -= 1
                    example, start, end = piece
                    self.held -= end - start
                    out.append((example, start, start + n))
                    room -= (n, 1, self.loss(example, start, start + n))
                    if start + n < end:
                        again.append((example, start + n, end))
                for piece in again:
                    self.put(*piece)
                if not out:  # no token fits into an empty sequence
                    raise ValueError(f"limits {self.limits} admit no token")
                yield out
                if again or self.held <= max(keep, self.limits.tokens):
                    break
            self.waiting = {k: v for k, v in self.waiting.items() if v}

    def rest(self) -> Iterator[list[tuple[int, int, int]]]:
        """What waits at the end, cut at powers of two."""
        yield from self.sequences(0)
        pieces = sorted(p for group in self.waiting.values() for p in group)
        self.waiting, total, self.held = {}, self.held, 0
        while total:
            room = np.minimum(self.cap, (1 << (total.bit_length() - 1), self.limits.segments, self.limits.loss))
            out = []
            while pieces and (n := self.room_in(pieces[0], room)):
                example, start, end = pieces.pop(0)
                out.append((example, start, start + n))
                total -= n
                room -= (n, 1, self.loss(example, start, start + n))
                if start + n < end:
                    pieces.insert(0, (example, start + n, end))
            if not out:
                raise ValueError(f"limits {self.limits} admit no token")
            yield out


#: Tokens that wait before a pass packs them, and that stay for the next pass; they bound a task's memory.
POOL, KEEP = 2_000_000, 400_000

SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
     ("sequence_id", pa.int64()), ("offset", pa.int64()), ("loss_tokens", pa.int64())]
)


def packed(rows: Iterable[tuple], limits: Limits, first: int) -> Iterator[pa.RecordBatch]:
    """rows: (doc_id, ids as bytes, prompt length). Sequences are numbered from ``first``."""
    packer, ids, left, sequence, out = Packer(limits), {}, {}, first, []

    def placed(found: Iterator[list[tuple[int, int, int]]]) -> None:
        nonlocal sequence
        for pieces in found:
            offset = 0
            for n, start, end in pieces:
                doc, data = ids[n]
                out.append((doc, start, end - start, zlib.crc32(data[4 * start : 4 * end]), len(data) // 4, sequence, offset, packer.loss(n, start, end)))
                offset += end - start
                left[n] -= end - start
                if not left[n]:
                    del ids[n], left[n]
            sequence += 1

    def batch() -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), SCHEMA.types, strict=True)] if out else [pa.array([], t) for t in SCHEMA.types]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, schema=SCHEMA)

    for n, (doc, data, prompt) in enumerate(rows):
        ids[n], left[n] = (doc, data), len(data) // 4
        placed(packer.add(n, len(data) // 4, prompt))
        if packer.held > POOL:
            placed(packer.sequences(KEEP))
            packer.prompt = {k: v for k, v in packer.prompt.items() if k in left}
        if len(out) > 20_000:
            yield batch()
    placed(packer.rest())
    yield batch()


def pack(docs: DataFrame, limits: Limits = Limits(), end_id: int = 2, path: str | None = None, prompt: str | None = None) -> DataFrame:
    """A row for each piece of each row of ``docs`` (doc_id, text): where it starts in its document's ids, its length, sequence and offset there.

    prompt: a column of docs. Of a whole number, so many of a document's first tokens bear no loss (at most
    all, at least none); of strings, the prompt's own tokens come before the text's and bear none. A null is
    no prompt; without the column all tokens bear loss. path: the vocabulary file, on every machine. Null and empty text
    give the end id alone; repeated rows are documents of their own; a null doc_id is kept; an empty table
    gives no rows; other columns are ignored. Very long texts are cut into full sequences.
    """
    path = path or default_path()
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, first = encoder(path), TaskContext.get().partitionId() << 32

        def rows() -> Iterator[tuple]:
            for b in batches:
                for doc, text, before in zip(b["doc_id"].to_pylist(), b["text"], b["prompt"], strict=True):
                    before = before.as_py()
                    head = encode(before) if isinstance(before, str) and before else b""
                    ids = head + encode(text.as_py() or "") + end
                    yield doc, ids, len(head) // 4 if isinstance(before, str) else min(max(before or 0, 0), len(ids) // 4)

        yield from packed(rows(), limits, first)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
    of = F.lit(None).cast("long") if prompt is None else docs[prompt]
    if prompt is not None and not isinstance(docs.schema[prompt].dataType, (T.StringType, T.IntegralType)):
        raise ValueError(f"{prompt} holds neither whole numbers nor strings")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", of.alias("prompt")).mapInArrow(run, schema)


def op3_pack(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
