import zlib
from collections import Counter, defaultdict

from graniteflow.llm.sharding import deal, shard_by_bytes, splitters

SCHEMA = "doc_id long, text string, range string, slot int"


def rows_of(spark, rows, **kw):
    return [r.asDict() for r in shard_by_bytes(spark.createDataFrame(rows, SCHEMA), **kw).collect()]


def test_sizes_slots_and_groups(spark):
    rows = [(i, "word " * (1 + i * 7919 % 97), "x", 1) for i in range(900)] + [(i, "copy of a page", None, None) for i in range(900, 1000)]
    rows += [(None, "no id", None, None), (7, None, None, None), (8, "", None, None), (9, "é" * 50, None, None), (9, "é" * 50, None, None)]
    out = rows_of(spark, rows, ranges=64, sample=4096)
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append(r)
    assert sorted(by) == list(range(8))
    for r in by.values():
        assert sorted(x["slot"] for x in r) == list(range(len(r)))
    sizes = [sum(x["size"] for x in r) for r in by.values()]
    assert max(sizes) < 1.05 * min(sizes)
    assert max(len({x["shard"] for x in out if x["text_crc32"] == c}) for c in {x["text_crc32"] for x in out}) == 1


def test_hot_group_is_spread_when_larger_than_a_shard(spark):
    out = rows_of(spark, [(i, "same" * 20, None, None) for i in range(3000)] + [(i, f"t{i}" * 20, None, None) for i in range(3000, 4000)], ranges=64)
    sizes = Counter()
    for r in out:
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) < 1.1 * min(sizes.values())


def test_empty_and_single(spark):
    assert rows_of(spark, []) == []
    (only,) = rows_of(spark, [(1, None, None, None)])
    assert (only["size"], only["text_crc32"], only["slot"]) == (1, 0, 0)


def test_helpers():
    import numpy as np

    assert len(splitters(np.zeros(0, np.int64), np.zeros(0), 4)) == 0
    assert 5 in splitters(np.array([5] * 10 + [9]), np.ones(11), 4) and 6 in splitters(np.array([5] * 10 + [9]), np.ones(11), 4)
    assert deal([3, 3, 2, 2, 2], 2) in ([0, 1, 0, 1, 0], [0, 1, 0, 1, 1])


def test_repeated_rows_are_spread(spark):
    out = rows_of(spark, [(1, "same row " * 2, None, None)] * 800 + [(i, f"t{i} " * 5, None, None) for i in range(2, 202)], ranges=64)
    sizes, slots = Counter(), defaultdict(list)
    for r in out:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(out) == 1000 and max(sizes.values()) < 1.1 * min(sizes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_same_shards_when_read_again(spark):
    df = shard_by_bytes(spark.createDataFrame([(i % 50, f"t{i % 70}", None, None) for i in range(500)], SCHEMA), ranges=16)
    assert sorted(map(tuple, df.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
