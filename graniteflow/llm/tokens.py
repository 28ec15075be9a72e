"""Fast exact encoding with a word-level BPE vocabulary file of the ``tokenizers`` library.

The library's pre-tokenizer drops white space and splits at fixed places, so a text's ids are those of its
space-separated chunks one after the other, and a chunk's those of its words. Chunks repeat, so each
worker keeps a bounded memo of chunk to ids. A chunk not in it, of Latin letters, is split here and its
words go to tiktoken's merge loop with the same vocabulary; any other goes to the library itself.

tiktoken merges any two neighbours whose union is a token; the library only the pairs of its merge list.
The two agree on tokens that come out of their own two halves, so only those are given to tiktoken
(``reachable``); the others never come out of the library either.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

#: Entries that a worker's memo holds before it is emptied, and the longest chunk that enters it.
MEMO, LONGEST = 400_000, 40
#: The marks of a word's end in the file and here (a byte that UTF-8 never holds), the
#: file's split pattern for Latin letters, and characters that the fast way takes.
SUFFIX, END = "</w>", b"\xff"
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\s\w]|_)+")
LATIN = re.compile("[!-;=-~à-öø-ÿœ¿¡«»–—’“”…€ÄÖÜßÀÂÇÈÉÊËÎÏÔÙÛÑÓÍÁÚ]+")


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes for themselves, the rest from 256 upwards in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


def merged(word: list[bytes], ranks: dict[bytes, int], below: int) -> list[bytes]:
    """word with all merges of rank under ``below``, lowest rank first, leftmost first."""
    word = list(word)
    while len(word) > 1:
        best = min(((ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(word, word[1:], strict=False))), default=(below, 0))
        if best[0] >= below:
            return word
        i = best[1]
        word[i : i + 2] = [word[i] + word[i + 1]]
    return word


def atoms(token: bytes) -> list[bytes]:
    ends = token.endswith(END)
    body = token[:-1] if ends else token
    out = [body[i : i + 1] for i in range(len(body))]
    return [*out[:-1], out[-1] + END] if ends and out else out


def reachable(model: dict) -> dict[bytes, int]:
    """Token bytes to ids, without the tokens that their merge list never makes."""
    byte = byte_of_letter()
    raw = lambda token: bytes(byte[c] for c in token.removesuffix(SUFFIX)) + (END if token.endswith(SUFFIX) else b"")
    ids, ranks = model["vocab"], {}
    halves = {a + b: (raw(a), raw(b)) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])}
    for token, rank in sorted(ids.items(), key=lambda x: x[1]):
        if token not in halves or merged(atoms(raw(token)), ranks, rank) == list(halves[token]):
            ranks[raw(token)] = rank
    return ranks


class ChunkEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            ranks = reachable(json.load(f)["model"])
        # the library needs a token for each single byte; the end mark's never remains alone
        self.core = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks | {END: 1 << 30}, special_tokens={})._core_bpe
        self.memo: dict[str, bytes] = {"": b""}

    def _new(self, chunk: str) -> bytes:
        if LATIN.fullmatch(chunk) and len(chunk) < 1000:
            encode = self.core.encode_single_piece
            ids = [i for word in WORDS.findall(chunk.lower()) for i in encode(word.encode() + END)]
        else:
            ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def __call__(self, text: str) -> bytes:
        memo = self.memo
        chunks = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        try:
            return b"".join(map(memo.__getitem__, chunks))
        except KeyError:
            pass
        new = {c: self._new(c) for c in set(chunks) if c not in memo}
        out = b"".join([new[c] if c in new else memo[c] for c in chunks])
        if len(memo) + len(new) > MEMO:
            memo.clear()
            memo[""] = b""
        memo.update(new if max(map(len, new)) <= LONGEST else ((c, ids) for c, ids in new.items() if len(c) <= LONGEST))
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> ChunkEncoder:
    """One encoder for each vocabulary file and worker process."""
    return ChunkEncoder(path)
