"""MinHash near-duplicate detection with DartMinHash signatures.

A text is the set of its five-word shingles, each of weight 1 however often it repeats: candidates and
links go by one measure, the Jaccard similarity of distinct shingles. Darts are thrown at each element's
region of weight times rank: they arrive along the rank axis as a Poisson process drawn from the element's
hash, so equal elements get equal darts. A dart below the element's weight counts; it falls to one of
``COORDINATES`` and the earliest at each coordinate makes up the signature. Two sets agree at a coordinate
with the probability of their weighted Jaccard similarity.

Coordinates are banded; texts that share a band are candidates, and a candidate pair is a link when the
exact Jaccard similarity of their shingles is 0.8 or more. Classes are the connected components of links.

Shape of the job: equal texts are one node, known by a hash of the text. In each bucket every member is
paired with one of its members, that which shares most buckets with others (pairs grow with members, not
their square; the source of a group of copies shares most), and the links' components are drawn up. Where
a bucket's members then still lie in several components, pairs without the head are untested: its members
meet in blocks of bounded size, where a task compares signatures of nodes of different components, verifies
those that may reach the threshold by their shingles at once, and gives out only links that join two
components. So no link that joins classes is lost but by the bands (a pair at 0.8 shares no band with a
probability of 3 in a million). The comparisons, not the rows, grow with the square of such a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graniteflow.llm.common import written

COORDINATES, ROWS, WORDS, LEAST = 96, 4, 5, 0.8
BANDS = COORDINATES // ROWS
#: Darts expected for each text: enough that few texts have a coordinate without any.
DARTS = COORDINATES * (np.log(COORDINATES) + 4)
#: Below this share of equal coordinates a pair isn't verified: 4.5 standard deviations under LEAST.
HOPE = LEAST - 4.5 * np.sqrt(LEAST * (1 - LEAST) / COORDINATES)
#: Entries of a worker's memo of word hashes; members of a bucket in a block, and bytes of their shingles.
MEMO, TOGETHER, BLOCK_BYTES = 300_000, 1024, 16 << 20
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective hash of 64-bit numbers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Shingler:
    """Hashes of the five-word shingles of lower-case texts; a shorter text is one shingle, a wordless one has none."""

    def __init__(self):
        self.memo: dict[str, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        words, memo = text.lower().split(), self.memo
        if not words:
            return np.zeros(0, U)
        try:
            h = np.array(list(map(memo.__getitem__, words)), U)
        except KeyError:
            if len(memo) > MEMO:
                memo.clear()
            for w in words:
                if w not in memo:
                    memo[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
            h = np.array(list(map(memo.__getitem__, words)), U)
        size = min(WORDS, len(h))
        out = np.full(len(h) - size + 1, size, U)
        for i in range(size):
            out = out * U(0x9E3779B97F4A7C15) + h[i : len(h) - size + 1 + i]
        return mix(out)


def signatures(sets: list[np.ndarray], weights: list[np.ndarray]) -> np.ndarray:
    """(sets, COORDINATES) ids of the earliest darts, 32 bits each. No set may be empty."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    x, w, doc = np.concatenate(sets), np.concatenate(weights), np.repeat(np.arange(n), sizes)
    reach = DARTS / np.bincount(doc, w, minlength=n)
    best = np.full(n * COORDINATES, np.iinfo(np.uint64).max, U)
    while True:
        strip = 0
        ex, ew, ed = x, w, doc
        while len(ex):
            seed = mix(ex ^ U(strip * 0x9E3779B97F4A7C15 % 2**64))
            top, at, arrival = ew - strip, ed, np.zeros(len(ex))
            number = 0
            while len(seed):
                h = mix(seed + U((number + 1) * 0xD1B54A32D192ED03 % 2**64))
                arrival = arrival - np.log((h >> U(11)).astype(np.float64) * 2.0**-53 + 2.0**-54)
                live = arrival < reach[at]
                seed, top, at, arrival, h = seed[live], top[live], at[live], arrival[live], h[live]
                g = mix(h ^ U(0xA0761D6478BD642F))
                inside = (top >= 1) | ((g >> U(40)).astype(np.float64) * 2.0**-24 < top)
                coordinate = ((g & U(0xFFFFFF)) % U(COORDINATES)).astype(np.int64)
                rank = arrival.astype(np.float32).view(np.uint32).astype(U)  # positive floats keep their order as integers
                packed = (rank << U(32)) | (h & U(0xFFFFFFFF))
                np.minimum.at(best, (at * COORDINATES + coordinate)[inside], packed[inside])
                number += 1
            strip += 1
            more = ew > strip
            ex, ew, ed = ex[more], ew[more], ed[more]
        empty = (best.reshape(n, COORDINATES) == np.iinfo(np.uint64).max).any(1)
        if not empty.any():
            return (best.reshape(n, COORDINATES) & U(0xFFFFFFFF)).astype(np.uint32)
        reach = reach * 2  # farther, for the texts that still lack a coordinate
        rest = empty[doc]
        x, w, doc = x[rest], w[rest], doc[rest]


def weighted(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles and their weights: 1 each, as ``likeness`` counts them."""
    values = np.unique(shingles)
    return values, np.ones(len(values))


def band_keys(signature: np.ndarray) -> np.ndarray:
    """(texts, BANDS) 64-bit keys; different bands never share one but by chance."""
    s = signature.astype(U).reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U), s.shape[:2])
    for i in range(ROWS):
        key = mix(key * U(0x9E3779B97F4A7C15) + s[:, :, i])
    return key.view(np.int64)


def with_node(docs: DataFrame, name: str = "node") -> DataFrame:
    """docs with the number of each row's text, a 64-bit hash; null counts as empty."""
    return docs.withColumn(name, F.xxhash64(F.coalesce("text", F.lit(""))))


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, node, signature (binary) and bands (array) of each row; a wordless text has neither."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        for whole in batches:
            for at in range(0, max(1, whole.num_rows), 256):
                b = whole.slice(at, 256)
                texts = [t or "" for t in b["text"].to_pylist()]
                pairs = [weighted(shingle(t)) for t in texts]
                full = [i for i, (v, _) in enumerate(pairs) if len(v)]
                sig, keys = [None] * len(texts), [None] * len(texts)
                if full:
                    s = signatures([pairs[i][0] for i in full], [pairs[i][1] for i in full])
                    for i, row, key in zip(full, s, band_keys(s), strict=True):
                        sig[i], keys[i] = row.astype("<u4").tobytes(), key
                columns = [b["doc_id"], b["node"], pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "node", "signature", "bands"])

    return docs.select("doc_id", "node", "text").mapInArrow(run, "doc_id long, node long, signature binary, bands array<long>")


def shingle_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and its sorted shingle hashes (32 bits each, as binary) for the given nodes (node, doc_id: one row that holds its text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        for b in batches:
            sets = [np.unique((shingle(t or "") >> U(32)).astype(np.uint32)).tobytes() for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["node"], pa.array(sets, pa.binary())], names=["node", "shingles"])

    wanted = nodes.select(F.col("node").alias("_node"), F.col("doc_id").alias("_doc"))
    texts = docs.join(wanted, (docs["node"] == wanted["_node"]) & docs["doc_id"].eqNullSafe(wanted["_doc"])).select("node", "text")
    # rows that repeat with id and text give the same set: one of each stays, combined before the shuffle
    return texts.mapInArrow(run, "node long, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles"))


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; 0 where their sizes alone keep it under LEAST."""
    if min(len(x), len(y)) < LEAST * max(len(x), len(y)):
        return 0.0
    both = np.concatenate([x, y])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared)


@F.pandas_udf(T.DoubleType())
def jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([likeness(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)) for x, y in zip(a, b, strict=True)], dtype=float)


def verified(pairs: DataFrame, docs: DataFrame, holders: DataFrame) -> DataFrame:
    """Of the pairs (a, b) of nodes, those that are links; holders has a doc_id for each node."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = written(shingle_sets(docs, holders.join(ends, "node")), "neardup-sets")
    left = pairs.join(sets.withColumnsRenamed({"node": "a", "shingles": "_a"}), "a")
    both = left.join(sets.withColumnsRenamed({"node": "b", "shingles": "_b"}), "b")
    return written(both.where(jaccard("_a", "_b") >= LEAST).select("a", "b"), "neardup-links")


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """node and component (its least node) of every node that a link (a, b) touches.

    Each round a node takes the least label of itself and its neighbours, then its label's label; rounds
    are written to the shared folder and end when no label changes, after about the logarithm of the
    longest path.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct(), name)
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")), name)
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "b"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.least("component", "near").alias("label"), F.col("component").alias("was"))
        step = written(step, name)
        jump = labels.select(F.col("node").alias("label"), F.col("component").alias("next"))
        new = written(step.join(jump, "label", "left").select("node", F.coalesce(F.least("label", "next"), "label").alias("component"), "was"), name)
        if new.where("component != was").isEmpty():
            return new.select("node", "component")
        labels = new.select("node", "component")


def several(rows: DataFrame) -> DataFrame:
    """The rows (bucket, node, component) of buckets that hold several components."""
    split = rows.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("bucket")
    # a table of its own: both sides of the join are then plain exchanges, whose hot keys Spark can split
    return rows.join(written(split, "neardup-split"), "bucket", "left_semi").select("bucket", "node", "component")


def joined(buckets: DataFrame) -> DataFrame:
    """Links (a, b) that join different components within a bucket: enough of them to join all that links join.

    buckets: bucket, node, component, signature, shingles. A bucket of more than TOGETHER members or
    BLOCK_BYTES of shingles is cut in blocks, and every two of its blocks meet in a task of their own, so a
    task holds two blocks at most. A group gives fewer links than it has members.
    """
    sizes = buckets.groupBy("bucket").agg(F.ceil(F.greatest(F.count("*") / TOGETHER, F.sum(F.length("shingles")) / BLOCK_BYTES)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = buckets.join(written(sizes, "neardup-blocks"), "bucket").withColumn("block", own)
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        sig = np.frombuffer(b"".join(frame["signature"]), np.uint32).reshape(len(frame), COORDINATES)
        sets = [np.frombuffer(x, np.uint32) for x in frame["shingles"]]
        node, part, block = frame["node"].to_numpy(), frame["component"].to_numpy().copy(), frame["block"].to_numpy()
        same_block = frame["low"].iat[0] == frame["high"].iat[0]
        found = []
        for i in range(len(frame)):
            j = slice(i + 1, None)
            open_pairs = np.flatnonzero((part[j] != part[i]) & (same_block | (block[j] != block[i]))) + i + 1
            for k in open_pairs[(sig[open_pairs] == sig[i]).mean(1) >= HOPE]:
                if part[k] != part[i] and likeness(sets[i], sets[k]) >= LEAST:
                    found.append((min(node[i], node[k]), max(node[i], node[k])))
                    part[part == part[k]] = part[i]
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    return rows.groupBy("bucket", "low", "high").applyInPandas(meet, "a long, b long").distinct()


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, node, class_id and is_kept of each row of ``docs`` (doc_id, text).

    class_id is the least doc_id of the class; is_kept marks the rows with that doc_id and one text of the
    class (several only where rows repeat with id and text). One doc_id may stand on several texts, each of
    which is in its own class. Null text counts as empty. Wordless texts are alike only if they are equal.
    Null doc_ids belong to their text's class; a class of null doc_ids alone has a null class_id. An empty
    table gives no rows; other columns are ignored; texts are read whole.
    """
    docs = with_node(docs.select(F.col("doc_id").cast("long"), "text"))
    signed = written(sign(docs), "neardup-signed")
    nodes = written(signed.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("signature").alias("signature")), "neardup-nodes")
    holders = nodes.select("node", "doc_id")
    banded = nodes.select("node", F.explode("bands").alias("bucket"))
    sizes = written(banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "neardup-sizes")
    shared = written(banded.join(sizes, "bucket"), "neardup-shared")
    ranked = shared.join(shared.groupBy("node").agg(F.sum("n").alias("rank")), "node")
    heads = written(ranked.groupBy("bucket").agg(F.max_by("node", F.struct("rank", "node")).alias("head")), "neardup-heads")
    members = written(shared.join(heads, "bucket"), "neardup-members")
    pairs = members.where("node != head").select(F.least("head", "node").alias("a"), F.greatest("head", "node").alias("b")).distinct()
    links = verified(written(pairs, "neardup-pairs"), docs, holders)
    parts = components(links)
    # buckets of three and more that are still in several parts: pairs of their members without the head are untested
    open_rows = members.where("n > 2").join(parts, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    rest = written(several(written(open_rows, "neardup-rows")), "neardup-open")
    if not rest.isEmpty():
        known = nodes.select("node", "doc_id", "signature").join(rest.select("node").distinct(), "node")
        sets = shingle_sets(docs, known.select("node", "doc_id")).join(known.select("node", "signature"), "node")
        found = written(joined(rest.join(written(sets, "neardup-sets"), "node")), "neardup-links")
        if not found.isEmpty():
            parts = components(links.union(found))
    labelled = nodes.select("node", "doc_id").join(parts, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node"))
    least = labelled.groupBy("component").agg(first.alias("_first")).select("component", F.col("_first.doc_id").alias("class_id"), F.col("_first.node").alias("kept_node"))
    # one row for each text: the class of its node; then back to the documents
    of_node = written(labelled.join(least, "component").select("node", "class_id", "kept_node"), "neardup-classes")
    kept = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("kept_node"))
    return signed.select("doc_id", "node").join(of_node, "node").select("doc_id", "node", "class_id", kept.alias("is_kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of docs for each class, with its columns unchanged: that of the least doc_id.

    Rows without a doc_id stay, but for equal texts among themselves.
    """
    kept = classes(docs).where("is_kept OR doc_id IS NULL").select(F.col("doc_id").alias("_kept_doc"), F.col("node").alias("_kept_node")).distinct()
    rows = with_node(docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_doc"), "text"), "_node")
    stays = rows.join(kept, (rows["_node"] == kept["_kept_node"]) & rows["_doc"].eqNullSafe(kept["_kept_doc"]), "left_semi")
    return stays.dropDuplicates(["_doc", "_node"]).select("_row.*")


def op7_neardup(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", F.col("is_kept").alias("is_representative"))
