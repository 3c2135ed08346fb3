"""Operator 3: language identification by a convolutional network over bytes.

A text is read whole, in windows of WINDOW bytes of its UTF-8 form (the last one padded with zeros). A window's bytes are
embedded, filters of several widths run over them, each filter's largest output (max pooling) feeds a softmax over the
languages. A text's score for a language is the mean of its windows' probabilities, weighted by their bytes.

The network is trained in numpy on the driver, on windows of about SAMPLE_DOCS labelled texts (twice as many at most), an equal share per language;
the texts are chosen by a hash of doc_id, so that the sample is the same on every run; of a language where it chooses none, the text of the smallest hash is. Everything else covers all rows.

Null texts and texts without letters (Unicode's categories L; numerals are none) are `und` with a score of 0, as is everything where
no labelled text was given, as in an empty table. Of languages with equal scores the first by name is returned. Repeated rows get
equal results. Very long texts are read whole, a slice at a time. Other columns than those named are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .shingles import byte_slices

WINDOW = 256
EMBED, WIDTHS, FILTERS = 8, (2, 3, 4), 16
SAMPLE_DOCS, SAMPLE_WINDOWS = 3000, 4
EPOCHS, BATCH, RATE = 6, 64, 0.01
#: Windows in one go: their intermediate arrays fit a core's cache.
TOGETHER = 32
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of texts: bytes, index of the text, how many bytes are the text's."""
    size = np.array([len(t) for t in texts], dtype=np.int64)
    n = -(-size // WINDOW)
    out = np.zeros((int(n.sum()), WINDOW), dtype=np.uint8)
    flat, at = out.reshape(-1), 0
    for t, k in zip(texts, n.tolist(), strict=True):
        flat[at : at + len(t)] = np.frombuffer(t, dtype=np.uint8)
        at += k * WINDOW
    of = np.repeat(np.arange(len(texts)), n)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    return out, of, np.minimum(WINDOW, size[of] - nth * WINDOW)


class Network:
    """Weights, forward pass and training."""

    def __init__(self, classes: int, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.embed[0] = 0
        self.filters = [rng.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(FILTERS * len(WIDTHS), dtype=np.float32)
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), classes)).astype(np.float32)
        self.shift = np.zeros(classes, dtype=np.float32)

    def _columns(self, x: np.ndarray, width: int) -> np.ndarray:
        e, n = self.embed[x], x.shape[1] - width + 1
        return np.concatenate([e[:, j : j + n] for j in range(width)], axis=2)

    def pooled(self, x: np.ndarray) -> np.ndarray:
        e, parts = self.embed[x], []
        for width, f in zip(WIDTHS, self.filters, strict=True):
            n = x.shape[1] - width + 1
            columns = np.concatenate([e[:, j : j + n] for j in range(width)], axis=2)
            parts.append((columns.reshape(-1, width * EMBED) @ f).reshape(len(x), n, FILTERS).max(axis=1))
        return np.maximum(np.concatenate(parts, axis=1) + self.bias, 0)

    def _softmax(self, pooled: np.ndarray) -> np.ndarray:
        z = pooled @ self.out + self.shift
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._softmax(self.pooled(x[i : i + TOGETHER])) for i in range(0, len(x), TOGETHER)]) if len(x) else np.zeros((0, len(self.shift)), np.float32)

    def weights(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, self.bias, self.out, self.shift]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross-entropy of a batch, in the order of `weights`. That of max pooling flows to the position that won; zeros, which pad
        windows, are not embedded."""
        rows = np.arange(len(x))
        best, kept = [], []
        for width, f in zip(WIDTHS, self.filters, strict=True):
            columns = self._columns(x, width)
            z = (columns.reshape(-1, width * EMBED) @ f).reshape(len(x), -1, FILTERS)
            at = z.argmax(axis=1)
            best.append(np.take_along_axis(z, at[:, None], axis=1)[:, 0])
            kept.append((at, columns[rows[:, None], at]))
        hidden = np.concatenate(best, axis=1) + self.bias
        active = np.maximum(hidden, 0)
        p = self._softmax(active)
        p[rows, y] -= 1
        p /= len(x)
        back = (p @ self.out.T) * (hidden > 0)
        grad_embed, grad_filters = np.zeros_like(self.embed), []
        for k, (width, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            g = back[:, k * FILTERS : (k + 1) * FILTERS]
            at, columns = kept[k]
            grad_filters.append(np.einsum("nfc,nf->cf", columns, g))
            to = g[:, :, None] * f.T[None]
            for j in range(width):
                np.add.at(grad_embed, x[rows[:, None], at + j], to[:, :, j * EMBED : (j + 1) * EMBED])
        grad_embed[0] = 0
        return [grad_embed, *grad_filters, back.sum(0), active.T @ p, p.sum(0)]

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> None:
        """Adam on the cross-entropy."""
        rng = np.random.default_rng(seed)
        weights = self.weights()
        m, v, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), BATCH):
                b = order[i : i + BATCH]
                step += 1
                for w, g, mi, vi in zip(weights, self.gradients(x[b], y[b]), m, v, strict=True):
                    mi += 0.1 * (g - mi)
                    vi += 0.001 * (g * g - vi)
                    w -= RATE * (mi / (1 - 0.9**step)) / (np.sqrt(vi / (1 - 0.999**step)) + 1e-8)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), [t.encode() for t in batch.column(1).to_pylist()]
        x, of, n = windows(texts)
        rng = np.random.default_rng(7)
        pick = [rng.permutation(np.flatnonzero((of == i) & (n >= min(WINDOW, len(t)))))[:SAMPLE_WINDOWS] for i, t in enumerate(texts)]
        at = np.concatenate(pick) if pick else np.zeros(0, int)
        yield pa.RecordBatch.from_arrays([pa.array([langs[i] for i in of[at]], pa.string()), pa.array([r.tobytes() for r in x[at]], pa.binary())], ["lang", "window"])


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> tuple[list[str], Network | None]:
    """The languages and the trained network, from documents (doc_id, text, lang) of which null and empty texts and null langs are left out."""
    bounded_batches(docs)
    known = docs.where("text <> '' and lang is not null and doc_id is not null")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return [], None
    share = F.lit(0.0)
    for lang in langs:
        share = F.when(F.col("lang") == lang, min(1.0, sample_docs / len(langs) / counts[lang])).otherwise(share)
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) < share * 1_000_000)
    windows_of = lambda df: df.select("lang", "text").mapInArrow(_sampled, "lang string, window binary").toPandas().sort_values(["lang", "window"])
    rows = windows_of(drawn.select("doc_id", "lang", "text").limit(2 * sample_docs))
    # the hash may draw nothing of a language whose rows share a few ids: then one of its texts stands for it
    if absent := sorted(set(langs) - set(rows["lang"])):
        one = known.where(F.col("lang").isin(absent)).groupBy("lang").agg(F.min_by("text", F.xxhash64("doc_id", "text")).alias("text"))
        rows = pd.concat([rows, windows_of(one)]).sort_values(["lang", "window"])
    net = Network(len(langs))
    net.train(np.frombuffer(b"".join(rows["window"]), dtype=np.uint8).reshape(-1, WINDOW), np.searchsorted(langs, rows["lang"].to_numpy(dtype=str)))
    return langs, net


def predict(texts: pa.Array, langs: list[str], net: Network | None) -> tuple[list[str], np.ndarray]:
    """lang_pred and score of each text."""
    names, scores = ["und"] * len(texts), np.zeros(len(texts))
    for a, b, raw in byte_slices(texts) if net else ():
        raw = [t if has_letter(t.decode()) else b"" for t in raw]
        x, of, n = windows(raw)
        p = net.probabilities(x).astype(np.float64) * n[:, None]
        at = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, int)
        if not len(at):
            continue
        mean = np.add.reduceat(p, at) / np.add.reduceat(n, at)[:, None]
        for i, k, s in zip(of[at].tolist(), mean.argmax(axis=1).tolist(), mean.max(axis=1).tolist(), strict=True):
            names[a + i], scores[a + i] = langs[k], min(1.0, s)
    return names, scores


def _task(langs: list[str], net: Network | None) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = predict(batch.column("text"), langs, net)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    return work


def held_out(doc_id: str = "doc_id") -> F.Column:
    """True for the fifth of the documents from which nothing is learned; false for rows without doc_id, which aren't learned from either."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, learned from the rows that aren't held out."""
    marked = docs.select("doc_id", "text", "lang", held_out().alias("held_out"))
    langs, net = learn(marked.where("not held_out"))
    return marked.select("doc_id", "held_out", "text").mapInArrow(_task(langs, net), "doc_id long, held_out boolean, lang_pred string, score double")


def recognised(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """docs without those that are `und` or whose best language scores less than `least`."""
    langs, net = learn(docs.where(~held_out()))
    if net is None:
        return docs.where("false")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = predict(batch.column(batch.schema.get_field_index("text")), langs, net)
            yield batch.filter(pa.array((np.array(names, dtype=str) != "und") & (scores >= least)))

    # whole rows pass through the task: beside a function of one column, Spark would hold the other columns in a queue
    return docs.mapInArrow(kept, docs.schema)
