"""Toxicity with a linear-chain conditional random field.

Words are tagged 0 (plain) or 1 (toxic). A word's potential is the sum of the weights of its features
(the word, its beginnings and its end), neighbours are tied by a 2x2 transition
table. Forward-backward gives each word's marginal; a document's score is a logistic function of what
its marginals add up to, and words whose marginal passes a threshold give offending spans by offset.

Labels mark documents, not words. So words are labelled by distant supervision: features that mark toxic
documents are chosen greedily, each by what it explains of the toxic documents that those before it leave
unexplained, and with them all whose excess in toxic documents can't be chance; words of toxic documents
that have such a feature are tagged 1, all others 0. The field is trained by gradient ascent of its exact
likelihood on stretches of those labelled words: around tagged words, drawn at random, and, in a second
round, around plain words that the first took for toxic.

Application: the tasks look up each distinct word's potential in a bounded memo, and run the recursions
over blocks of words of all documents of a batch at once, a bounded number of blocks at a time; batches are
cut by their texts' length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graniteflow.llm.common import held_out

#: Size of a worker's memo, words in a block of the recursions, blocks at a time, code points of a batch's texts.
MEMO, BLOCK, STRETCH, BATCH = 300_000, 64, 2048, 2_000_000
WORD = re.compile(r"[^\W_]+")
THRESHOLD = 0.3


def features(word: str) -> list[str]:
    """Features of a lower-case word: itself, beginnings of 3 to 8 letters that go on, its last 3 letters."""
    n = len(word)
    return ["=" + word, *[word[:k] for k in range(3, min(n, 9))], "-" + word[-3:]]


def lowered(text: str) -> str:
    """text in lower case at the same offsets; a letter that would become two stays as it is."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def words_of(text: str) -> list[str]:
    return WORD.findall(lowered(text))


class Field:
    """Weights of a two-tag linear chain; a word's potential is log-odds of tag 1 against tag 0."""

    def __init__(self):
        self.weight: dict[str, float] = {}
        self.bias = -4.0
        self.step = np.array([[0.5, -0.5], [-0.5, 0.5]])  # transition potentials
        self.calibration = np.array([0.0, 1.0, 1.0])

    def emission(self, word: str) -> float:
        get = self.weight.get
        return sum([get(f, 0.0) for f in features(word)]) + self.bias

    def marginals(self, emission: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Each word's probability of tag 1. emission: all documents' words one after the other; starts: where each begins, ascending, none empty."""
        return chain(emission, starts, self.step, pairs=False)[0]


def chain(emission: np.ndarray, starts: np.ndarray, step: np.ndarray, pairs: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of tag 1 and, if asked, of each pair (previous tag, tag), by forward-backward over all documents at once.

    A document is cut into blocks of BLOCK words. The vector of messages is carried through a block as a
    2x2 matrix, so that the blocks of all documents run side by side; then block to block; then inside.
    STRETCH blocks are worked on at a time: beyond them a word takes some tens of bytes.
    """
    n = len(emission)
    if not n:
        return np.zeros(0), np.zeros((0, 2, 2))
    ends = np.append(starts[1:], n)
    counts = -(-(ends - starts) // BLOCK)
    first_block = np.concatenate([[0], np.cumsum(counts)[:-1]])
    blocks = int(counts.sum())
    within = np.arange(blocks) - np.repeat(first_block, counts)
    at = np.repeat(starts, counts) + within * BLOCK
    length = np.minimum(BLOCK, np.repeat(ends, counts) - at)
    move = np.exp(step)
    head = within == 0  # a document's first block: its first word has no word before it
    stretches = [slice(k, min(k + STRETCH, blocks)) for k in range(0, blocks, STRETCH)]

    def words(part: slice) -> tuple[np.ndarray, np.ndarray]:
        """Potentials (block, word, tag) of some blocks, and which of their places hold words."""
        slot = at[part, None] + np.arange(BLOCK)
        real = np.arange(BLOCK) < length[part, None]
        e = np.where(real, emission[np.minimum(slot, n - 1)], 0.0)
        return np.stack([np.ones_like(e), np.exp(np.clip(e, -30, 30))], -1), real

    whole = np.empty((blocks, 2, 2))  # the matrix that each block applies to the messages
    for part in stretches:
        psi, real = words(part)
        m = np.broadcast_to(np.eye(2), (len(psi), 2, 2)).copy()
        for t in range(BLOCK):
            a = move * psi[:, t, None, :]
            if t == 0:
                a = np.where(head[part, None, None], np.eye(2) * psi[:, 0, None, :], a)
            after = m @ a
            after /= after.sum((1, 2), keepdims=True)
            m = np.where(real[:, t, None, None], after, m)
        whole[part] = m
    enter, leave = np.ones((blocks, 2)), np.ones((blocks, 2))
    most = int(counts.max())
    alive = np.arange(len(starts))
    for k in range(1, most):  # block k of every document that has one
        alive = alive[counts[alive] > k]
        b = first_block[alive] + k
        v = (enter[b - 1][:, None, :] @ whole[b - 1])[:, 0]
        enter[b] = v / v.sum(1, keepdims=True)
    for k in range(most - 2, -1, -1):
        own = np.flatnonzero(counts > k + 1)
        b = first_block[own] + k
        v = (whole[b + 1] @ leave[b + 1][:, :, None])[:, :, 0]
        leave[b] = v / v.sum(1, keepdims=True)

    marginal, both = np.empty(n), []
    for part in stretches:
        psi, real = words(part)
        size = len(psi)
        alpha, beta = np.empty((size, BLOCK, 2)), np.empty((size, BLOCK, 2))
        v = enter[part]
        for t in range(BLOCK):
            moved = v @ move
            if t == 0:
                moved = np.where(head[part, None], 1.0, moved)
            v = np.where(real[:, t, None], moved * psi[:, t], v)
            v = v / v.sum(1, keepdims=True)
            alpha[:, t] = v
        v = leave[part]
        pair = np.empty((size, BLOCK, 2, 2)) if pairs else None
        for t in range(BLOCK - 1, -1, -1):
            beta[:, t] = v
            onward = psi[:, t] * v
            if pairs:
                before = alpha[:, t - 1] if t else enter[part]
                pair[:, t] = before[:, :, None] * move * onward[:, None, :]
            u = onward @ move.T
            v = np.where(real[:, t, None], u / u.sum(1, keepdims=True), v)
        # leave carries a block's first transition too, as ``whole`` does
        gamma = alpha * beta
        gamma /= gamma.sum(2, keepdims=True)
        low = int(at[part.start])
        marginal[low : low + int(length[part].sum())] = gamma[real][:, 1]
        if pairs:
            pair /= pair.sum((2, 3), keepdims=True)
            both.append(pair[real])
    return marginal, np.concatenate(both) if pairs else np.zeros((0, 2, 2))


def summaries(marginal: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of each document: 1, the log-odds of its most toxic word, the log of one plus the expected toxic words."""
    top = np.clip(np.maximum.reduceat(marginal, starts), 1e-6, 1 - 1e-6)
    return np.column_stack([np.ones(len(starts)), np.log(top / (1 - top)), np.log1p(np.add.reduceat(marginal, starts))])


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-2, counts: np.ndarray | None = None) -> np.ndarray:
    """Weights by Newton's method. counts: how many rows each row stands for, 1 unless given."""
    counts = np.ones(len(y)) if counts is None else counts
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (counts * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        d = np.linalg.solve(h, x.T @ (counts * (y - p)) - ridge * w)
        w += d
        if np.abs(d).max() < 1e-6:
            break
    return w


class Corpus:
    """Training documents as arrays: each distinct word's features, each document's words."""

    def __init__(self, texts: list[str], toxic: np.ndarray, counts: np.ndarray):
        number: dict[str, int] = {}
        docs = [np.array([number.setdefault(w, len(number)) for w in words_of(t)], np.int64) for t in texts]
        keep = [i for i, d in enumerate(docs) if len(d)]
        self.docs, self.toxic, self.counts = [docs[i] for i in keep], toxic[keep].astype(int), counts[keep]
        self.words = np.concatenate(self.docs) if keep else np.zeros(0, np.int64)
        sizes = np.array([len(d) for d in self.docs], np.int64)
        self.starts = np.cumsum(sizes) - sizes
        self.of_doc = np.repeat(np.arange(len(self.docs)), sizes)
        names: dict[str, int] = {}
        found = [[names.setdefault(f, len(names)) for f in features(w)] for w in number]
        self.names = list(names)
        self.flat = np.array([f for fs in found for f in fs], np.int64)
        self.count = np.array([len(fs) for fs in found], np.int64)
        self.owner = np.repeat(np.arange(len(found)), self.count)

    def potentials(self, weight: np.ndarray) -> np.ndarray:
        """Of each distinct word, without the bias."""
        return np.bincount(self.owner, weight[self.flat], minlength=len(self.count))

    def seeds(self, sure: float = 25.0, least: float = 6.0) -> np.ndarray:
        """Which features mark toxic documents.

        A feature's gain is the log-likelihood ratio of its documents being toxic, against the share of
        toxic documents; both are of the drawn documents, whose number is the evidence there is. Greedy choice goes on down to a gain of ``least`` over unexplained documents;
        features with a gain of ``sure`` over all documents are chosen in any case.
        """
        words = len(self.count)
        kinds = np.unique(self.of_doc * words + self.words)
        doc, word = kinds // words, kinds % words
        first = np.cumsum(self.count) - self.count
        reps = self.count[word]
        inner = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        seen = np.unique(np.repeat(doc, reps) * len(self.names) + self.flat[np.repeat(first[word], reps) + inner])
        doc, feature = seen // len(self.names), seen % len(self.names)
        bad = self.toxic[doc] == 1
        good_n = np.bincount(feature[~bad], minlength=len(self.names))
        doc, feature = doc[bad], feature[bad]
        order = np.argsort(feature, kind="stable")
        by_feature, edges = doc[order], np.searchsorted(feature[order], np.arange(len(self.names) + 1))
        rate = np.clip(self.toxic.mean(), 1e-3, 1 - 1e-3)

        def gain(bad_n: np.ndarray) -> np.ndarray:
            n = bad_n + good_n
            q = np.clip((bad_n + 0.01) / (n + 0.02), 1e-6, 1 - 1e-6)
            return np.where(q > rate, bad_n * np.log(q / rate) + good_n * np.log((1 - q) / (1 - rate)), 0.0)

        open_docs = self.toxic == 1
        bad_n = np.bincount(feature, minlength=len(self.names))
        bad_share, good_share = (bad_n + 0.01) / max(1, (self.toxic == 1).sum()), (good_n + 0.01) / max(1, (self.toxic == 0).sum())
        pure = bad_share / (bad_share + good_share) > 0.75  # within each class, so the drawn mix doesn't matter
        chosen = (gain(bad_n) >= sure) & pure
        open_docs[np.unique(by_feature[np.repeat(chosen, np.diff(edges))])] = False
        while open_docs.any():
            score = np.where(pure & ~chosen, gain(np.bincount(feature[open_docs[doc]], minlength=len(self.names))), 0.0)
            best = int(score.argmax())
            if score[best] < least:
                break
            chosen[best] = True
            open_docs[by_feature[edges[best] : edges[best + 1]]] = False
        return chosen

    def tags(self, chosen: np.ndarray) -> np.ndarray:
        return (self.potentials(chosen.astype(float)) > 0)[self.words] & (self.toxic[self.of_doc] == 1)

    def stretches(self, centres: np.ndarray, reach: int) -> np.ndarray:
        """Numbers of the words within ``reach`` of the centres, without leaving their documents."""
        near = np.clip(centres[:, None] + np.arange(-reach, reach + 1), 0, len(self.words) - 1)
        return np.unique(near[self.of_doc[near] == self.of_doc[centres][:, None]])


def fit(texts: list[str], toxic: np.ndarray, counts: np.ndarray | None = None, most_words: int = 40_000, steps: int = 40, ridge: float = 0.3, reach: int = 8) -> Field:
    """The field and its calibration from whole training texts and their document labels.

    counts: how many labelled rows each text stands for (the inverse of its drawing chance), 1 unless given.
    most_words: how many words each of the three kinds of stretches may have.
    """
    counts = np.ones(len(texts)) if counts is None or not len(counts) else counts / counts.mean()
    field, data = Field(), Corpus(texts, np.asarray(toxic), counts)
    if not len(data.words) or data.toxic.min() == data.toxic.max():
        rate = float(np.mean(toxic)) if len(toxic) else 0.0
        field.calibration = np.array([np.log((rate + 1e-3) / (1 - rate + 1e-3)), 0.0, 0.0])
        return field
    rng = np.random.default_rng(5)
    tag = data.tags(data.seeds())
    draw = lambda numbers: rng.permutation(numbers)[: most_words // (2 * reach + 1)]
    centres = np.concatenate([draw(np.flatnonzero(tag)), draw(np.arange(len(tag)))])
    weight = np.zeros(len(data.names))
    for _ in range(2):
        pick = data.stretches(np.unique(centres), reach)
        starts = np.flatnonzero(np.concatenate([[True], (np.diff(pick) > 1) | (np.diff(data.of_doc[pick]) > 0)]))
        word, y = data.words[pick], tag[pick].astype(float)
        inner = np.ones(len(pick), bool)
        inner[starts] = False
        observed = np.zeros((2, 2))
        np.add.at(observed, (np.concatenate([[0], y[:-1]]).astype(int)[inner], y[inner].astype(int)), 1)
        square, bias_square, step_square = np.full(len(weight), 1e-8), 1e-8, np.full((2, 2), 1e-8)
        for _ in range(steps):  # Adagrad on the likelihood's gradient: observed minus expected
            marginal, pairs = chain(data.potentials(weight)[word] + field.bias, starts, field.step)
            gap = y - marginal
            by_word = np.bincount(word, gap, minlength=len(data.count))
            g = np.bincount(data.flat, by_word[data.owner], minlength=len(weight)) - ridge * weight
            square += g * g
            weight += 0.5 * g / np.sqrt(square)
            b = gap.sum()
            bias_square += b * b
            field.bias += 0.5 * b / np.sqrt(bias_square)
            s = observed - pairs[inner].sum(0) - ridge * field.step
            step_square += s * s
            field.step = field.step + 0.2 * s / np.sqrt(step_square)
        emission = data.potentials(weight)[data.words] + field.bias
        wrong = np.flatnonzero((emission > -1.5) & ~tag & (data.toxic[data.of_doc] == 0))
        centres = np.concatenate([centres, draw(wrong)])
    field.weight = {f: float(w) for f, w in zip(data.names, weight, strict=True) if abs(w) > 0.02}
    marginal = field.marginals(emission, data.starts)
    field.calibration = fit_logistic(summaries(marginal, data.starts), data.toxic, counts=data.counts)
    return field


def training_texts(docs: DataFrame, labels: DataFrame, most: int = 700, longest: int = 200_000) -> tuple[list[str], np.ndarray, np.ndarray]:
    """``most`` toxic and ``most`` other labelled texts at most, drawn by hash over all labelled rows.

    Of each text its label and how many labelled rows it stands for: the inverse of its class's drawing
    chance. A doc_id on several rows counts with one of its texts; texts of over ``longest`` code points
    train nothing. So ``most`` and ``longest`` bound what reaches the driver.
    """
    labels = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("_toxic")).groupBy("doc_id").agg(F.max("_toxic").alias("_toxic"))
    counts = {r["_toxic"]: r["count"] for r in labels.groupBy("_toxic").count().collect()}  # two rows
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("toxicity")), F.lit(1_000_000)) / 1_000_000
    chance = F.when(F.col("_toxic") == 1, most / max(1, counts.get(1, 0))).otherwise(most / max(1, counts.get(0, 0)))
    drawn = labels.where(draw < chance).select("doc_id", "_toxic").collect()  # about twice ``most`` rows at most
    if not drawn:
        return [], np.zeros(0), np.zeros(0)
    sample = docs.sparkSession.createDataFrame(drawn, "doc_id long, _toxic int")
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").where((F.col("text").isNotNull()) & (F.char_length("text") <= longest))
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("_toxic").alias("_toxic")).toPandas().sort_values("doc_id")
    stands = {c: max(1.0, n / most) for c, n in counts.items()}
    return rows["text"].tolist(), rows["_toxic"].to_numpy(float), rows["_toxic"].map(stands).to_numpy(float)


class Scorer:
    """Scores of texts in a task; potentials of words are kept in a bounded memo."""

    def __init__(self, field: Field):
        self.field, self.memo = field, {}

    def potentials(self, words: list[str]) -> list[float]:
        memo = self.memo
        try:
            return list(map(memo.__getitem__, words))
        except KeyError:
            pass
        if len(memo) > MEMO:
            memo.clear()
        for w in words:
            if w not in memo:
                memo[w] = self.field.emission(w)
        return list(map(memo.__getitem__, words))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Scores, and each text's marginals."""
        emissions = [self.potentials(words_of(t)) for t in texts]
        sizes = np.array([len(e) for e in emissions])
        full = np.flatnonzero(sizes)
        score = np.full(len(texts), 1 / (1 + np.exp(-np.clip(self.field.calibration[:2] @ [1, np.log(1e-6)], -30, 30))))
        marginals = [np.zeros(0)] * len(texts)
        if len(full):
            starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
            marginal = self.field.marginals(np.concatenate([np.array(emissions[i]) for i in full]), starts)
            score[full] = 1 / (1 + np.exp(-np.clip(summaries(marginal, starts) @ self.field.calibration, -30, 30)))
            for i, m in zip(full, np.split(marginal, starts[1:]), strict=True):
                marginals[i] = m
        return score, marginals


def spans_of(text: str, marginal: np.ndarray, threshold: float = 0.5) -> list[dict]:
    """Runs of words whose marginals pass the threshold: start and end in code points, and the largest marginal."""
    if not len(marginal) or marginal.max() < threshold:
        return []
    out: list[dict] = []
    last = -2
    for n, (found, p) in enumerate(zip(WORD.finditer(lowered(text)), marginal, strict=True)):
        if p >= threshold:
            if last == n - 1:
                out[-1] |= {"end": found.end(), "marginal": max(out[-1]["marginal"], float(p))}
            else:
                out.append({"start": found.start(), "end": found.end(), "marginal": float(p)})
            last = n
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("marginal", T.DoubleType())]))
SPANS_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))


def score(docs: DataFrame, field: Field) -> DataFrame:
    """Adds ``score``, ``predicted`` and ``spans`` to docs, from the column text alone; columns of these names are replaced.

    Null, empty and wordless text has no spans and the score of a document without toxic words. Repeated
    rows get the same, an empty table stays empty, long texts are read to their end.
    """
    docs = docs.drop("score", "predicted", "spans")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(field)
        for whole in batches:
            sizes = pc.fill_null(pc.utf8_length(whole["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            group = np.cumsum(sizes) // BATCH  # rows whose texts begin in the same stretch of code points
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), whole.num_rows] if whole.num_rows else [0, 0]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                b = whole.slice(low, high - low)
                texts = [t or "" for t in b["text"].to_pylist()]
                p, marginals = scorer(texts)
                spans = [spans_of(t, m) for t, m in zip(texts, marginals, strict=True)]
                extra = [pa.array(p, pa.float64()), pa.array((p >= THRESHOLD).astype(np.int32)), pa.array(spans, SPANS_ARROW)]
                yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=[*names, "score", "predicted", "spans"])

    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("spans", SPANS)]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *fields]))


def train_on_fold(docs: DataFrame, labels: DataFrame) -> Field:
    """A field from the labelled rows outside the held-out fold."""
    return fit(*training_texts(docs.where(~held_out("doc_id")), labels.where(~held_out("doc_id"))))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = score(docs.select("doc_id", "text"), train_on_fold(docs, labels))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted", "spans")
