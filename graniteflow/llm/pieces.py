"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search goes over a text once. A state is a boundary with the piece that ends there; from each boundary
the vocabulary's trie gives the pieces that begin there, so only states within the longest piece's length
are open. Backpointers are kept from the last committed boundary on: when all surviving paths meet in one
boundary, the ids up to it are committed and dropped.

For a unigram model a path's score is the sum of its pieces' scores. A BPE model's encoding is the one path
whose neighbouring pieces would not have been merged otherwise: piece t may follow piece u if merging the
characters of u + t gives u and t again. That is a first-order condition, so the same search finds it,
with scores of zero and minus infinity.

Where two characters never stand side by side in any piece, all paths meet between them. The main such
place is before a word; so words are memoised, words not seen before are cut at the other such places, and
the search runs for parts not seen before.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The mark of a space, entries of a worker's memos, the longest word that enters one.
SPACE, MEMO, LONGEST = "▁", 400_000, 40


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def model_kind(data: bytes) -> str:
    """unigram or bpe, as the model file's trainer settings (field 2) say in their field 3; unigram if they don't."""

    def fields(buffer: bytes) -> Iterator[tuple[int, int | bytes]]:
        at = 0

        def varint() -> int:
            nonlocal at
            value = shift = 0
            while True:
                byte = buffer[at]
                at += 1
                value |= (byte & 127) << shift
                shift += 7
                if byte < 128:
                    return value

        while at < len(buffer):
            key = varint()
            if key & 7 == 0:
                yield key >> 3, varint()
            else:
                size = {1: 8, 5: 4}.get(key & 7) or varint()
                yield key >> 3, buffer[at : at + size]
                at += size

    for number, value in fields(data):
        if number == 2:
            return {1: "unigram", 2: "bpe"}[next((v for n, v in fields(value) if n == 3), 1)]
    return "unigram"


class PieceModel:
    """A vocabulary file's pieces, and the search over them."""

    def __init__(self, path: str | None = None, data: bytes | None = None):
        from sentencepiece import SentencePieceProcessor

        if data is None:
            with open(path or default_path(), "rb") as f:
                data = f.read()
        self.kind = model_kind(data)
        own = SentencePieceProcessor(model_proto=data)
        self.own = own
        self.texts = [own.id_to_piece(i) for i in range(own.get_piece_size())]
        plain = [i for i in range(len(self.texts)) if not (own.is_control(i) or own.is_unknown(i) or own.is_byte(i) or own.is_unused(i))]
        self.ids = {self.texts[i]: i for i in plain}
        self.score = {i: own.get_score(i) for i in plain}
        self.unknown, self.penalty = own.unk_id(), min(self.score.values(), default=0.0) - 10.0
        found = [own.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bytes = found if all(own.is_byte(i) for i in found) else None
        self.byte_of = {i: b for b, i in enumerate(found)} if self.bytes else {}
        self.longest = max(map(len, self.ids), default=1)
        self.trie: dict = {}  # letter to (the piece that ends here or None, the letters that go on or None)
        for piece in sorted(self.ids):
            node = self.trie
            for c in piece[:-1]:
                own_piece, onward = node.get(c, (None, None))
                if onward is None:
                    onward = {}
                    node[c] = (own_piece, onward)
                node = onward
            node[piece[-1:]] = (piece, node.get(piece[-1:], (None, None))[1])
        self.beside = {piece[k : k + 2] for piece in self.ids for k in range(len(piece) - 1)}
        self.by_word = not any(b[1] == SPACE and b[0] != SPACE for b in self.beside)
        self.follows: dict[str, dict[str, bool]] = {}
        self.known = 0
        self.memo: dict[str, bytes] = {"": b""}

    def merged(self, text: str) -> list[str]:
        """The pieces that a BPE model's merges make of text: best score first, leftmost first."""
        parts, ids, score = list(text), self.ids, self.score
        while len(parts) > 1:
            best, at = None, 0
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or score[i] > best):
                    best, at = score[i], k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, before: str, piece: str) -> bool:
        """Whether a BPE model keeps the two apart; remembered up to MEMO pairs."""
        if self.known > MEMO:
            for row in self.follows.values():
                row.clear()
            self.known = 0
        self.known += 1
        found = self.merged(before + piece) == ([before, piece] if before else [piece])
        self.follows.setdefault(before, {})[piece] = found
        return found

    def search(self, text: str) -> Iterator[list[str]]:
        """Lists of pieces, each as soon as its end is certain.

        state: of each boundary from the last committed one on, its score, where its piece begins, the piece.
        """
        bpe, trie, size, follows, scores, ids = self.kind == "bpe", self.trie, len(text), self.follows, self.score, self.ids
        state: dict[int, tuple[float, int, str]] = {0: (0.0, 0, "")}
        far = done = 0
        for at in range(size):
            reached = state.get(at)
            if reached is None:
                continue
            if at > done:
                if at == far:  # no other boundary is open: all paths meet here
                    pieces, end = [], at
                    while end > done:
                        _, end, piece = state[end]
                        pieces.append(piece)
                    yield pieces[::-1]
                    state, done = {at: reached}, at
                elif at - done > 2 * self.longest:
                    done = yield from self._commit(state, [k for k in state if k >= at], done)
            score, _, before = reached
            allowed = follows.get(before)
            if allowed is None:
                allowed = follows[before] = {}
            node, end = trie, at
            while node is not None and end < size:
                piece, node = node.get(text[end], (None, None))
                end += 1
                if piece is None:
                    continue
                if bpe:
                    if end not in state:
                        keeps = allowed.get(piece)
                        if keeps is None:
                            keeps = self.may_follow(before, piece)
                        if keeps:
                            state[end] = (0.0, at, piece)
                            if end > far:
                                far = end
                else:
                    total = score + scores[ids[piece]]
                    if end not in state or total > state[end][0]:
                        state[end] = (total, at, piece)
                        far = max(far, end)
            if text[at] not in ids:
                total = score + self.penalty
                if at + 1 not in state or (not bpe and total > state[at + 1][0]):
                    state[at + 1] = (total, at, text[at])
                    far = max(far, at + 1)
        if size > done:
            yield from self._commit(state, [size], done)

    def _commit(self, state: dict, ends: list[int], done: int):
        """Commits up to the boundary where the paths to all ends meet; returns it."""
        open_ends = set(ends)
        while len(open_ends) > 1:
            last = max(open_ends)
            open_ends.discard(last)
            open_ends.add(state[last][1])
        (meet,) = open_ends
        if meet > done:
            pieces, at = [], meet
            while at > done:
                pieces.append(state[at][2])
                at = state[at][1]
            yield pieces[::-1]
            for k in [k for k in state if k < meet]:
                del state[k]
        return max(meet, done)

    def ids_of(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in p.encode("utf-8", "surrogatepass")]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def _new(self, word: str) -> bytes:
        return array("i", [i for pieces in self.search(word) for i in self.ids_of(pieces)]).tobytes()

    def _parts(self, word: str) -> bytes:
        """A word not in the memo: it is cut where no piece joins two letters, and its parts are looked up.

        The whole word enters the memo when its parts had been seen before, so it is likely to come again.
        """
        beside, memo, out, begin, seen = self.beside, self.memo, [], 0, True
        for k in [*[k for k in range(1, len(word)) if word[k - 1 : k + 1] not in beside], len(word)]:
            part = word[begin:k]
            ids = memo.get(part)
            if ids is None:
                seen = False
                ids = self._new(part)
                if len(part) <= LONGEST:
                    memo[part] = ids
            out.append(ids)
            begin = k
        found = b"".join(out)
        if seen and len(word) <= LONGEST:
            memo[word] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids as signed 32-bit integers of this machine."""
        if not text:
            return b""
        full = SPACE + text.replace(" ", SPACE)
        if not self.by_word or (self.bytes is None):
            return self._new(full)
        words = [SPACE + w for w in full.split(SPACE)[1:]]
        if SPACE + SPACE in full:
            words = re.findall(f"{SPACE}+[^{SPACE}]*", full)
        memo = self.memo
        try:
            return b"".join(map(memo.__getitem__, words))
        except KeyError:
            pass
        if len(memo) > MEMO:
            memo.clear()
        out = []
        for w in words:
            ids = memo.get(w)
            if ids is None:
                ids = self._parts(w)
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: runs of bytes as UTF-8, marks as spaces, without the first."""
        texts, byte_of = self.texts, self.byte_of
        if byte_of and not byte_of.keys().isdisjoint(ids):
            out, run = [], bytearray()
            for i in ids:
                if i in byte_of:
                    run.append(byte_of[i])
                    continue
                if run:
                    out.append(run.decode("utf-8", "replace"))
                    run.clear()
                out.append(texts[i])
            out.append(run.decode("utf-8", "replace"))
            text = "".join(out)
        else:
            text = "".join(map(texts.__getitem__, ids))
        text = text.replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    """One model for each file and worker process."""
    return PieceModel(path)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, n_ids and round_trip of each row of ``docs`` (doc_id, text).

    round_trip tells whether decoding gives the text again (not for texts that hold the space mark itself).
    path: the vocabulary file, on every machine. Null and empty text have no ids; a null doc_id is kept;
    repeated rows come out repeatedly; an empty table gives no rows; other columns are ignored; texts of
    any length are read whole, in a window bounded by the longest piece.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for whole in batches:
            for at in range(0, max(1, whole.num_rows), 512):
                b = whole.slice(at, 512)
                texts = [t or "" for t in b["text"].to_pylist()]
                found = [pieces.encode(t) for t in texts]
                sizes = np.array([len(f) // 4 for f in found], np.int32)
                flat = np.frombuffer(b"".join(found), np.int32)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
                same = [pieces.decode(np.frombuffer(f, np.int32).tolist()) == t for f, t in zip(found, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([b["doc_id"], lists, pa.array(sizes.astype(np.int64)), pa.array(same, pa.bool_())], names=["doc_id", "ids", "n_ids", "round_trip"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>, n_ids long, round_trip boolean")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of each row of ``encoded`` (doc_id, ids); null ids give the empty text."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([pieces.decode(i or []) for i in b["ids"].to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def op5_pieces(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
