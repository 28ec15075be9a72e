import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from graniteflow.llm.packing import Limits, Packer, pack
from graniteflow.llm.tokens import default_path, encoder

SCHEMA = "doc_id long, text string, start int, sequence_id string"


def check(rows, docs, limits=Limits()):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(default_path())
    want = {i: tok.encode(t or "", add_special_tokens=False).ids + [2] for i, t in docs}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert pieces.keys() == want.keys()
    for i, ids in want.items():
        at = 0
        for p in sorted(pieces[i], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    padding = 0
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= limits.tokens and len(s) <= limits.segments
        padding += 0 if at & (at - 1) == 0 else limits.tokens - at
    return padding


def test_every_id_lies_in_one_piece(spark):
    rng = random.Random(3)
    words = ["idiot's", "Straße", "naïve", "x", "<|endoftext|>", "é", "漢字", "a b", "12345", "don't", "\x1c", "|", "AB c", "İI"]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([1, 5, 300, 9000])))) for i in range(40)]
    docs += [(100, None), (101, ""), (102, " \n\t "), (103, "z" * 30_000)]
    rows = [r.asDict() for r in pack(spark.createDataFrame([(*d, 1, "s") for d in docs], SCHEMA)).collect()]
    assert check(rows, docs) == 0


def test_empty_table_and_repeats(spark):
    assert pack(spark.createDataFrame([], SCHEMA)).collect() == []
    out = pack(spark.createDataFrame([(1, "a b", 0, ""), (1, "a b", 0, ""), (None, "c", 0, "")], SCHEMA)).collect()
    assert sum(r["length"] for r in out) == 8


def test_three_limits_hold_at_once():
    rng, limits = random.Random(5), Limits(64, 4, 20)
    packer, got, size = Packer(limits), [], {}
    for n in range(300):
        size[n] = rng.randint(1, 90)
        got += packer.add(n, size[n], rng.randint(0, size[n]))
    got += packer.rest()
    seen = defaultdict(int)
    for s in got:
        assert sum(e - b for _, b, e in s) <= 64 and len(s) <= 4
        assert sum(packer.loss(n, b, e) for n, b, e in s) <= 20
        for n, b, e in s:
            seen[n] += e - b
    assert seen == size
    with pytest.raises(ValueError):
        list((p := Packer(Limits(4, 0, 4))).add(0, 9)) + list(p.rest())


def test_dot_product_takes_the_largest_that_fits():
    packer = Packer(Limits(10, 10, 10))
    for n, t in enumerate([6, 5, 4, 3, 2]):
        list(packer.add(n, t))
    first = next(packer.sequences(0))
    assert [e - b for _, b, e in first] == [6, 4]


def test_encoder_matches_the_library():
    from tokenizers import Tokenizer

    tok, enc = Tokenizer.from_file(default_path()), encoder(default_path())
    for text in ("", "Hello  world's\tend", "a\x85b c　d", "<|startoftext|>x <|endoftext|>", "ΑΣ Σας", "́a é ́", "x" * 500):
        assert np.frombuffer(enc(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids


def test_fast_way_agrees_with_the_library():
    rng = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyzABCÉéèüßñ'’0123456789.,!?-_|&%$#*@()<>/\"“”…€—«»¿¡~^`+=;:[]{}\\²½漢"
    texts = [" ".join("".join(rng.choices(letters, k=rng.randint(1, 12))) for _ in range(400)) for _ in range(40)]
    texts += [" ".join("".join(rng.choices("etaoinshrdlué", k=rng.randint(1, 14))) for _ in range(400)) for _ in range(40)]
    enc = encoder(default_path())
    for text in texts:
        assert np.frombuffer(enc(text), "<u4").tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("kind", ["int", "string"])
def test_loss_limit_through_the_dataframe(spark, kind):
    rng, limits, enc = random.Random(7), Limits(64, 8, 20), encoder(default_path())
    say = lambda most: " ".join(rng.choices(["ab", "don't", "naïve", "x"], k=rng.randint(1, most)))
    rows = [(i, say(60), rng.choice([None, 0, 3, 40, 9999]) if kind == "int" else rng.choice([None, "", say(50)])) for i in range(80)]
    out = pack(spark.createDataFrame(rows, f"doc_id long, text string, before {kind}"), limits, prompt="before").collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in out:
        sequences[r["sequence_id"]].append(r)
        pieces[r["doc_id"]].append(r)
    for s in sequences.values():
        assert sum(r["length"] for r in s) <= 64 and len(s) <= 8 and sum(r["loss_tokens"] for r in s) <= 20
    for i, text, before in rows:
        head = np.frombuffer(enc(before), "<u4").tolist() if kind == "string" and before else []
        ids = [*head, *np.frombuffer(enc(text), "<u4").tolist(), 2]
        bare, at = (min(before or 0, len(ids)) if kind == "int" else len(head)), 0
        for p in sorted(pieces[i], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
            assert p["loss_tokens"] == max(0, at - max(p["start"], bare))
        assert at == len(ids)
    assert sum(r["loss_tokens"] for r in out) < sum(r["length"] for r in out)


@pytest.mark.parametrize("words", [1, 3, 5])
def test_short_documents_leave_little_padding(spark, words):
    rows = spark.createDataFrame([(i, "a " * words) for i in range(6000)], "doc_id long, text string").coalesce(1)
    out = pack(rows).collect()
    filled = {}
    for r in out:
        filled[r["sequence_id"]] = filled.get(r["sequence_id"], 0) + r["length"]
    room = sum(n if n & (n - 1) == 0 else 4096 for n in filled.values())
    assert room <= 1.01 * sum(filled.values())
