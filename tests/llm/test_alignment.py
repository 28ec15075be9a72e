"""Cross-tokenizer alignment against plain loops over whole texts."""

from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from graniteflow.llm import alignment
from graniteflow.llm.alignment import align_tokens, bitset, default_path, op11_align, popcount_ranks, rank, select


def plain(rows):
    """op11's rows without bitsets, stretches, memo or packs: tokens of whole texts, sets and double loops."""
    import sentencepiece
    from graniteflow.llm.tokens import byte_of_letter
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=default_path("piece_bpe_32k.model"))
    byte, docs = byte_of_letter(), []
    for doc_id, text in rows:
        groups = []
        if text:
            ids_a, ids_b = a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)
            bytes_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
            bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
            if b"".join(bytes_a) == b"".join(bytes_b) == f" {text}".encode():
                ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
                x = y = 0
                for cut in sorted(set(ends_a) & set(ends_b)):
                    x1, y1 = ends_a.index(cut, x) + 1, ends_b.index(cut, y) + 1
                    groups.append((ids_a[x:x1], ids_b[y:y1]))
                    x, y = x1, y1
        docs.append((doc_id, groups, Counter((p, q) for left, right in groups for p in left for q in right)))
    counts = Counter(pair for _, _, links in docs for pair in links)
    highest = {}
    for (p, _), n in counts.items():
        highest[p] = max(n, highest.get(p, 0))
    written = lambda groups: ";".join(f"{','.join(map(str, left))}|{','.join(map(str, right))}" for left, right in groups)
    return [
        (
            doc_id, sum(len(left) for left, _ in groups), sum(len(right) for _, right in groups), len(groups), links.total(),
            sum(n for pair, n in links.items() if counts[pair] == highest[pair[0]]), sum(n * counts[pair] for pair, n in links.items()),
            sha256(written(groups).encode()).hexdigest() if groups else "",
        )
        for doc_id, groups, links in docs
    ]


HARD = [
    (1, None), (2, ""), (3, " "), (None, "a  b   c "), (5, "<|endoftext|> and <s></s><unk> <0x41>"), (6, "tab\t\tand \n\n lines\n x"), (7, "a▁b"), (8, "日本語 の テスト 🎉🎉 naïve"),
    (9, "\x00 \x1c x  y  z\u0085 w"), (10, "word " * 40), (10, "word " * 40), (11, "it's we'll 12345 ... !!!   "), (12, "x" * 5000 + " " * 300 + "é" * 300), (13, "The the The"),
]


def test_given_documents_and_hard_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()] + HARD
    both = docs.union(spark.createDataFrame(HARD, "doc_id long, text string"))
    found = [tuple(r) for r in align_tokens(both, rows=37).collect()]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(found, key=key) == sorted(plain(rows), key=key)


def test_stretches_have_the_tokens_of_whole_texts():
    both = alignment.Aligner(default_path("byte_bpe_50k.json"), default_path("piece_bpe_32k.model"))
    for _, text in HARD:
        if text:
            parts = both.split(text)
            assert " ".join(["", *parts]) == f" {text}"
            assert [i for x in parts for i in both.a.encode(f" {x}", add_special_tokens=False).ids] == both.a.encode(f" {text}", add_special_tokens=False).ids
            assert [i for x in parts for i in both.b.encode(x)] == both.b.encode(text)


@pytest.mark.parametrize("size", [1, 63, 64, 65, 1000])
def test_rank_and_select(size):
    ends = np.flatnonzero(np.random.default_rng(size).random(size) < 0.4)
    bits = bitset(ends, size)
    assert select(bits).tolist() == ends.tolist()
    at = np.arange(size)
    assert rank(bits, popcount_ranks(bits), at).tolist() == [int((ends <= i).sum()) for i in range(size)]


def test_empty_table_and_clashing_columns(spark):
    assert align_tokens(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = spark.createDataFrame([(1, "one two", 5, 6)], "doc_id long, text string, pack int, pairs int")
    assert align_tokens(rows).first()["n_groups"] == 2


def test_query_has_a_row_for_each_document(spark):
    assert op11_align(spark, "/root/testdata/sf0.001").count() == 200
