"""Language ID with a byte convolutional network trained in numpy.

Bytes are embedded, filters of several widths slide over a fixed-length window, each filter's maximum
over the window goes through a rectifier and a softmax layer. A text is cut into windows from end to end;
its class probabilities are the mean of its windows', weighted by their bytes.

Training takes ``per_language`` documents of each language at most, ``per_document`` windows of each at
most, drawn by hash from all labelled rows, and runs on the driver. Application runs in batches of
windows in the tasks, with the model in the closure (some tens of kilobytes).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graniteflow.llm.common import held_out

WINDOW, WIDTHS, FILTERS, SIZE = 256, (3, 5), 12, 6
SPAN = max(WIDTHS)
UNKNOWN = "und"


class Network:
    """The network's arrays and its forward pass."""

    def __init__(self, labels: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels = labels
        total = FILTERS * len(WIDTHS)
        self.embed = rng.normal(0, 0.5, (256, SIZE)).astype(np.float32)
        self.embed[0] = 0  # the padding byte
        self.mask = np.zeros((SPAN, SIZE, total), np.float32)  # a filter sees its width's bytes alone
        for n, width in enumerate(WIDTHS):
            self.mask[:width, :, n * FILTERS : (n + 1) * FILTERS] = 1
        self.mask = self.mask.reshape(SPAN * SIZE, total)
        self.conv = (rng.normal(0, 1, self.mask.shape) / np.sqrt(SPAN * SIZE)).astype(np.float32) * self.mask
        self.bias = np.zeros(total, np.float32)
        self.out = rng.normal(0, 0.3, (total, len(labels))).astype(np.float32)
        self.base = np.zeros(len(labels), np.float32)

    def patches(self, windows: np.ndarray) -> np.ndarray:
        """(windows, WINDOW, SPAN * SIZE): each position's embedded bytes and those after it."""
        wide = np.zeros((len(windows), WINDOW + SPAN - 1), np.uint8)
        wide[:, :WINDOW] = windows
        flat = self.embed[wide]
        view = np.lib.stride_tricks.sliding_window_view(flat.reshape(len(windows), -1), SPAN * SIZE, axis=1)[:, ::SIZE]
        return np.ascontiguousarray(view)

    def forward(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class probabilities, pooled values and the patches."""
        patches = self.patches(windows)
        pooled = (patches.reshape(-1, SPAN * SIZE) @ self.conv).reshape(len(windows), WINDOW, -1).max(1) + self.bias
        logits = np.maximum(pooled, 0) @ self.out + self.base
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        return p / p.sum(1, keepdims=True), pooled, patches

    def __call__(self, windows: np.ndarray, batch: int = 128) -> np.ndarray:
        return np.concatenate([self.forward(windows[i : i + batch])[0] for i in range(0, len(windows), batch)]) if len(windows) else np.zeros((0, len(self.labels)), np.float32)

    def fit(self, windows: np.ndarray, target: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 3) -> Network:
        """Adam on the cross-entropy; in each pass every other window is cut to a random length, as short texts are."""
        rng = np.random.default_rng(seed)
        names = ("embed", "conv", "bias", "out", "base")
        moment = {k: [np.zeros_like(getattr(self, k)), np.zeros_like(getattr(self, k))] for k in names}
        share = np.bincount(target, minlength=len(self.labels))
        weight = (len(target) / np.maximum(share, 1) / len(self.labels))[target].astype(np.float32)
        step, steps = 0, max(1, epochs * -(-len(windows) // batch))
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                w, y = windows[pick].copy(), target[pick]
                ends = rng.integers(12, WINDOW, len(pick))
                w[(np.arange(WINDOW) >= ends[:, None]) & (np.arange(len(pick)) % 2 == 0)[:, None]] = 0
                p, pooled, patches = self.forward(w)
                d = p.copy()
                d[np.arange(len(y)), y] -= 1
                d *= weight[pick, None] / len(y)
                hidden = np.maximum(pooled, 0)
                back = (d @ self.out.T) * (pooled > 0)
                scores = (patches.reshape(-1, SPAN * SIZE) @ self.conv).reshape(len(w), WINDOW, -1)
                where = scores.argmax(1)  # (windows, filters)
                seen = patches[np.arange(len(w))[:, None], where]  # (windows, filters, patch)
                g_conv = np.einsum("bf,bfp->pf", back, seen) * self.mask
                wide = np.zeros((len(w), WINDOW + SPAN - 1), np.uint8)
                wide[:, :WINDOW] = w
                touched = wide[np.arange(len(w))[:, None, None], where[:, :, None] + np.arange(SPAN)]
                g_patch = np.einsum("bf,pf->bfp", back, self.conv).reshape(*touched.shape, SIZE)
                g_embed = np.zeros_like(self.embed)
                np.add.at(g_embed, touched.ravel(), g_patch.reshape(-1, SIZE))
                g_embed[0] = 0
                step += 1
                fall = rate * (1 - 0.9 * step / steps)
                for name, g in zip(names, (g_embed, g_conv, back.sum(0), hidden.T @ d, d.sum(0)), strict=True):
                    m, v = moment[name]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    getattr(self, name)[...] -= fall * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self


def windows_of(data: bytes) -> np.ndarray:
    """data from end to end in rows of WINDOW bytes, the last filled with zeros."""
    rows = -(-len(data) // WINDOW)
    out = np.zeros(rows * WINDOW, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(rows, WINDOW)


def training_windows(labelled: DataFrame, per_language: int = 400, per_document: int = 6) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows drawn from a bounded sample of ``labelled`` (doc_id, text, lang) with their labels' numbers, and the labels."""
    labelled = labelled.where("lang IS NOT NULL AND text IS NOT NULL AND text != ''")
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # one row for each language
    if not counts:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, int), []
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("langid")), F.lit(1_000_000)) / 1_000_000
    chance = F.lit(0.0)
    for lang, n in counts.items():
        chance = F.when(F.col("lang") == lang, min(1.0, 1.2 * per_language / n)).otherwise(chance)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc, text, lang in zip(frame["doc_id"], frame["text"], frame["lang"], strict=True):
                data = text.encode()
                rng = np.random.default_rng(zlib.crc32(str(doc).encode()))
                last = max(0, len(data) - WINDOW)
                for at in sorted(set(rng.integers(0, last + 1, per_document).tolist())):
                    rows.append((lang, doc, data[at : at + WINDOW].ljust(WINDOW, b"\0")))
            yield pd.DataFrame(rows, columns=["lang", "doc_id", "data"])

    drawn = labelled.where(draw < chance).select("doc_id", "text", "lang").mapInPandas(cut, "lang string, doc_id long, data binary").toPandas()
    drawn = drawn.sort_values(["lang", "doc_id", "data"]).reset_index(drop=True)  # the order of arrival doesn't count
    labels = sorted(counts)
    number = {lang: n for n, lang in enumerate(labels)}
    data = np.frombuffer(b"".join(drawn["data"]), np.uint8).reshape(-1, WINDOW)
    return data, drawn["lang"].map(number).to_numpy(int), labels


def train(labelled: DataFrame, per_language: int = 400, per_document: int = 6) -> Network:
    data, target, labels = training_windows(labelled, per_language, per_document)
    return Network(labels).fit(data, target) if labels else Network([UNKNOWN])


def identify_texts(model: Network, texts: list[str | None], most: int = 4096) -> Iterator[tuple[str, float]]:
    """(language, score) of each text; windows are gathered over texts, ``most`` at a time."""
    out = [(UNKNOWN, 0.0)] * len(texts)
    held, sizes = [], []

    def flush() -> None:
        if not held:
            return
        p = model(np.concatenate([w for _, w in held]))
        lengths = np.concatenate(sizes)
        starts = np.cumsum([0] + [len(w) for _, w in held])[:-1]
        mean = np.add.reduceat(p * lengths[:, None], starts) / np.add.reduceat(lengths, starts)[:, None]
        for (i, _), row in zip(held, mean, strict=True):
            out[i] = (model.labels[int(row.argmax())], float(min(1.0, row.max())))
        held.clear()
        sizes.clear()

    count = 0
    for i, text in enumerate(texts):
        if text and any(map(str.isalpha, text)):
            data = text.encode()
            w = windows_of(data)
            n = np.full(len(w), WINDOW, float)
            n[-1] = len(data) - WINDOW * (len(w) - 1)
            held.append((i, w))
            sizes.append(n)
            count += len(w)
            if count >= most:
                flush()
                count = 0
    flush()
    return iter(out)


def identify(docs: DataFrame, model: Network) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` to docs, from the column text alone; columns of these names are replaced.

    Null text and text without a letter are ``und`` with score 0. Repeated rows get the same, an empty
    table stays empty, long texts are read to their end.
    """
    docs = docs.drop("lang_pred", "score")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(identify_texts(model, b["text"].to_pylist()))
            extra = [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=[*names, "lang_pred", "score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(run, schema)


def train_on_fold(docs: DataFrame) -> Network:
    """A network from the rows outside the held-out fold."""
    return train(docs.where(~held_out("doc_id")).select("doc_id", "text", "lang"))


def op8_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs.select("doc_id", "text"), train_on_fold(docs))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
