"""Operator 8: language identification by a byte convolutional network.

Filters of several widths slide over a text's bytes; each one's largest answer
in a fixed-length window feeds a softmax over the languages, and a text's
language is the likeliest over all its windows. Training is numpy on a bounded
sample of windows; a filter's answer to a byte at a place is a number in a
table, so that scoring whole corpora is table lookups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import gathered, small_batches, written

#: Bytes of a window; filters of each width.
WINDOW, WIDTHS, FILTERS, EMBEDDING = 128, (2, 3, 4), 8, 8
#: Rows of each language that train the network at most, and windows of each, from places that its id chooses.
TRAINING_DOCS, TRAINING_WINDOWS = 800, 4
EPOCHS, BATCH, RATE = 12, 64, 0.01
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All windows (rows of WINDOW bytes, zeros at a text's end) and how many each text has; the last one may reach back."""
    n = np.array([max(1, -(-len(x) // WINDOW)) for x in texts], np.int64)
    data = b"".join(x.ljust(int(k) * WINDOW, b"\0") for x, k in zip(texts, n))
    return np.frombuffer(data, np.uint8).reshape(-1, WINDOW), n


class ByteNetwork:
    """Byte embedding, filters of WIDTHS, rectified maximum over the window, softmax."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.embedding = rng.normal(0, 0.5, (256, EMBEDDING))
        self.filters = {w: rng.normal(0, 1 / np.sqrt(w * EMBEDDING), (w * EMBEDDING, FILTERS)) for w in WIDTHS}
        self.offsets = {w: np.zeros(FILTERS) for w in WIDTHS}
        self.out, self.bias = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))), np.zeros(len(languages))

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters.values(), *self.offsets.values(), self.out, self.bias]

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 7) -> None:
        """Adam on the cross entropy, languages weighted alike."""
        rng = np.random.default_rng(seed)
        weight = 1 / np.maximum(1, np.bincount(y, minlength=len(self.languages)))[y]
        weight = weight / weight.mean()
        first, second = [np.zeros_like(p) for p in self.parameters()], [np.zeros_like(p) for p in self.parameters()]
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for k in range(0, len(x), BATCH):
                at = order[k : k + BATCH]
                step += 1
                for p, g, m, v in zip(self.parameters(), self._slopes(x[at], y[at], weight[at]), first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def _slopes(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        rows, e = np.arange(len(x)), self.embedding[x]
        pooled, best, views = [], {}, {}
        for w in WIDTHS:
            n = WINDOW - w + 1
            views[w] = np.concatenate([e[:, i : i + n] for i in range(w)], 2)
            answer = views[w] @ self.filters[w] + self.offsets[w]
            best[w] = answer.argmax(1)
            pooled.append(np.take_along_axis(answer, best[w][:, None], 1)[:, 0])
        raw = np.concatenate(pooled, 1)
        hidden = np.maximum(raw, 0)
        logits = hidden @ self.out + self.bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[rows, y] -= 1
        p *= (weight / len(x))[:, None]
        back = (p @ self.out.T) * (raw > 0)
        g_e, g_f, g_o = np.zeros_like(self.embedding), [], []
        for j, w in enumerate(WIDTHS):
            b = back[:, j * FILTERS : (j + 1) * FILTERS]
            seen = views[w][rows[:, None], best[w]]  # (text, filter, w * EMBEDDING)
            g_f.append(np.einsum("nfd,nf->df", seen, b))
            g_o.append(b.sum(0))
            down = b[:, :, None] * self.filters[w].T[None]
            for i in range(w):
                np.add.at(g_e, x[rows[:, None], best[w] + i], down[:, :, i * EMBEDDING : (i + 1) * EMBEDDING])
        return [g_e, *g_f, *g_o, hidden.T @ p, p.sum(0)]

    def tables(self) -> dict[int, list[np.ndarray]]:
        """For each width, what each pair of bytes (and a last single byte) adds to the filters' answers."""
        out = {}
        for w in WIDTHS:
            single = [(self.embedding @ self.filters[w][i * EMBEDDING : (i + 1) * EMBEDDING]).astype(np.float32) for i in range(w)]
            single[0] = single[0] + self.offsets[w].astype(np.float32)
            out[w] = [(single[i][:, None] + single[i + 1][None]).reshape(-1, FILTERS) for i in range(0, w - 1, 2)] + ([single[-1]] if w % 2 else [])
        return out


def score_windows(x: np.ndarray, tables: dict[int, list[np.ndarray]], out: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Log-probabilities of the languages for each window."""
    pairs = x[:, :-1].astype(np.int32) << 8 | x[:, 1:]
    pooled = []
    for w, parts in tables.items():
        n = WINDOW - w + 1
        answer = parts[0].take(pairs[:, :n], 0)
        for i, table in enumerate(parts[1:], 1):
            answer += table.take(pairs[:, 2 * i : 2 * i + n] if len(table) > 256 else x[:, 2 * i : 2 * i + n], 0)
        pooled.append(answer.max(1))
    logits = np.maximum(np.concatenate(pooled, 1), 0) @ out.astype(np.float32) + bias.astype(np.float32)
    logits -= logits.max(1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(1, keepdims=True))


def train(df: DataFrame) -> ByteNetwork | None:
    """A network from at most TRAINING_DOCS rows of each language of ``df`` (doc_id, text, lang); None without any label.

    Rows are chosen by a hash of id and text, so that repeated rows count like others. Languages are as many as
    ``lang`` has values: all are learned, and the network has an output for each.
    """
    rows = df.where("text is not null and lang is not null").select("text", "lang", F.xxhash64("doc_id", "text").alias("h"))
    order = Window.partitionBy("lang").orderBy("h")
    least = rows.select("lang", "h").withColumn("place", F.row_number().over(order)).where(F.col("place") <= TRAINING_DOCS)
    limits = written(least.groupBy("lang").agg(F.max("h").alias("most")), "languages")  # before any text is cut
    picked = rows.join(limits, "lang").where("h <= most").select("text", "lang", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cut = []
            for text, h in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                w, _ = windows([text.encode()])
                at = np.unique(np.random.default_rng(h & 0xFFFFFFFF).integers(0, len(w), TRAINING_WINDOWS))
                cut.append(w[at].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(cut, pa.binary())], ["lang", "h", "bytes"])

    order = Window.partitionBy("lang").orderBy("h", "bytes")  # rows that repeat share a hash
    chosen = picked.mapInArrow(run, "lang string, h long, bytes binary").withColumn("place", F.row_number().over(order)).where(F.col("place") <= TRAINING_DOCS)
    found = sorted((r["lang"], r["place"], bytes(r["bytes"])) for r in chosen.select("lang", "place", "bytes").collect())
    sample = [(lang, b[k : k + WINDOW]) for lang, _, b in found for k in range(0, len(b), WINDOW)]
    sample = [r for r in sample if any(c > 64 for c in r[1])]
    if not sample:
        return None
    languages = sorted({r[0] for r in sample})
    number = {x: i for i, x in enumerate(languages)}
    network = ByteNetwork(languages)
    network.fit(np.frombuffer(b"".join(r[1] for r in sample), np.uint8).reshape(-1, WINDOW), np.array([number[r[0]] for r in sample]))
    return network


def identify_language(df: DataFrame, network: ByteNetwork | None) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` of every whole text.

    ``score`` is the mean probability of the language over the text's windows.
    A text that is null or has no letter, or any text without a network, is
    ``und`` with score 0. Columns besides doc_id and text are left out.
    """
    small_batches(df.sparkSession)
    model = network and (network.languages, network.tables(), network.out, network.bias)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for table in gathered(batches, "text"):
            texts = [x or "" for x in table.column("text").to_pylist()]
            known = np.array([model is not None and bool(_LETTER.search(x)) for x in texts])
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            at = np.flatnonzero(known)
            if len(at):
                languages, tables, out, bias = model
                x, n = windows([texts[i].encode() for i in at])
                logs = np.concatenate([score_windows(x[k : k + 512], tables, out, bias) for k in range(0, len(x), 512)])
                firsts = np.cumsum(n) - n
                best = np.add.reduceat(logs, firsts, 0).argmax(1)
                mean = np.add.reduceat(np.exp(logs.astype(np.float64)), firsts, 0) / n[:, None]
                for j, i in enumerate(at):
                    names[i] = languages[best[j]]
                scores[at] = np.clip(mean[np.arange(len(at)), best], 0, 1)
            yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), pa.array(names), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    out = T.StructType([df.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return df.select("doc_id", "text").mapInArrow(run, out)
