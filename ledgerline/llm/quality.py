"""Operator 10: quality rules with line sequence labelling.

A linear-chain conditional random field marks each line of a text as content or
boilerplate; Viterbi decoding finds the likeliest marks, and the share of
content among the characters decides whether the text is kept. The field is
trained on a bounded sample of labelled documents; everything else is counted
over every line of every whole text.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import gathered, row_key, small_batches

#: Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 10, 20
WINDOW = 5
#: Labelled documents of each class that train the field, and lines of each, from a place that its id chooses.
TRAINING_DOCS, TRAINING_LINES = 1500, 32
#: Share of content characters that a kept text has at least.
CONTENT_SHARE = 0.5
ROUNDS, RATE, PENALTY = 150, 0.1, 1e-3

_CLASSES = np.zeros((256, 6), np.float32)
_CLASSES[list(SYMBOLS), 0] = 1
_CLASSES[[c for c in range(0x41, 0x5B)], 1] = 1  # capitals
_CLASSES[list(b"0123456789"), 2] = 1
_CLASSES[list(b".,;:!?"), 3] = 1
_CLASSES[list(b" \t\r\x0b\x0c"), 4] = 1
_CLASSES[list(b"!"), 5] = 1
#: Upper ends of the steps that shares and sizes are put in, so that the field learns a weight for each step.
_SHARE_STEPS, _WORD_STEPS = np.array([0.0, 0.02, 0.05, 0.1, 0.2, 0.4]), np.array([0, 1, 2, 4, 8, 16, 32, 64])
_LETTER_STEPS = np.array([2.0, 3.5, 4.5, 5.5, 7.0, 10.0])
N_FEATURES = 1 + 6 * (len(_SHARE_STEPS) + 1) + len(_WORD_STEPS) + 1 + len(_LETTER_STEPS) + 1 + 2


def line_features(lines: list[bytes], again: np.ndarray) -> np.ndarray:
    """The active feature numbers of each line; ``again``: whether an earlier line of its text is equal."""
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    data = np.frombuffer(b"\n".join([*lines, b""]), np.uint8)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    out = [np.zeros(len(lines), np.int64)]
    base = 1
    sums = {}
    for k in range(6):
        table = _CLASSES[:, k].astype(bool)
        marks = np.r_[0, np.cumsum(table[data], dtype=np.int64)]
        sums[k] = marks[starts + sizes] - marks[starts]
        out.append(base + np.searchsorted(_SHARE_STEPS, sums[k] / np.maximum(sizes, 1)))
        base += len(_SHARE_STEPS) + 1
    words = np.where(sizes > 0, sums[4] + 1, 0)
    out.append(base + np.searchsorted(_WORD_STEPS, words))
    base += len(_WORD_STEPS) + 1
    out.append(base + np.searchsorted(_LETTER_STEPS, (sizes - sums[4]) / np.maximum(words, 1)))
    base += len(_LETTER_STEPS) + 1
    out.append(base + again.astype(np.int64))
    return np.stack(out, 1)


def repeated_lines(lines: list[bytes]) -> np.ndarray:
    """Whether each line with a word equals an earlier one."""
    seen: set[bytes] = set()
    out = np.zeros(len(lines), bool)
    for i, line in enumerate(lines):
        if line in seen:
            out[i] = True
        elif line and line.split():
            seen.add(line)
    return out


def train(sequences: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights (feature, mark) and transitions (mark, mark) by gradient ascent on the likelihood of the marks.

    Every line of a sequence has its document's mark (0 boilerplate, 1 content).
    """
    steps = max(len(s) for s in sequences)
    x = np.zeros((len(sequences), steps, sequences[0].shape[1]), np.int64)
    there = np.zeros((len(sequences), steps), bool)
    for i, s in enumerate(sequences):
        x[i, : len(s)], there[i, : len(s)] = s, True
    weights, moves = np.zeros((N_FEATURES, 2)), np.zeros((2, 2))
    share = np.array([1 / max(1, (labels == c).sum()) for c in (0, 1)])[labels]
    share = share / share.sum()
    grown = [np.zeros_like(weights), np.zeros_like(moves)]
    for _ in range(ROUNDS):
        scores = weights[x].sum(2)
        ahead, back = np.zeros((len(x), steps, 2)), np.zeros((len(x), steps, 2))
        ahead[:, 0] = scores[:, 0]
        for t in range(1, steps):
            step = np.logaddexp(ahead[:, t - 1, :1] + moves[0], ahead[:, t - 1, 1:] + moves[1]) + scores[:, t]
            ahead[:, t] = np.where(there[:, t, None], step, ahead[:, t - 1])
        for t in range(steps - 2, -1, -1):
            near = scores[:, t + 1] + back[:, t + 1]
            step = np.stack([np.logaddexp(moves[a, 0] + near[:, 0], moves[a, 1] + near[:, 1]) for a in (0, 1)], 1)
            back[:, t] = np.where(there[:, t + 1, None], step, 0)
        total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        marginal = np.exp(ahead + back - total[:, None, None]) * there[:, :, None]
        wrong = -marginal
        wrong[np.arange(len(x))[:, None], np.arange(steps)[None], labels[:, None]] += there
        wrong *= share[:, None, None]
        slope = np.zeros_like(weights)
        for k in range(x.shape[2]):
            for c in (0, 1):
                slope[:, c] += np.bincount(x[:, :, k].ravel(), wrong[:, :, c].ravel(), N_FEATURES)
        turn = np.zeros_like(moves)
        pairs = there[:, 1:]
        for a in (0, 1):
            for b in (0, 1):
                both = np.exp(ahead[:, :-1, a] + moves[a, b] + scores[:, 1:, b] + back[:, 1:, b] - total[:, None]) * pairs
                turn[a, b] = (((labels == a) & (a == b))[:, None] * pairs * share[:, None]).sum() - (both * share[:, None]).sum()
        for value, g, old in ((weights, slope, grown[0]), (moves, turn, grown[1])):
            g -= PENALTY * value
            old += g * g
            value += RATE * g / np.sqrt(old + 1e-12)
    return weights, moves


def viterbi(scores: np.ndarray, moves: np.ndarray) -> list[int]:
    """The likeliest marks of one text's lines."""
    (m00, m01), (m10, m11) = moves.tolist()
    rows = scores.tolist()
    a, b = rows[0]
    from_a, from_b = [], []
    for x, y in rows[1:]:
        p, q = a + m00, b + m10
        r, s = a + m01, b + m11
        from_a.append(0 if p >= q else 1)
        from_b.append(0 if r > s else 1)
        a, b = (p if p >= q else q) + x, (r if r > s else s) + y
    mark = 0 if a > b else 1
    out = [mark]
    for f, g in zip(reversed(from_a), reversed(from_b)):
        mark = g if mark else f
        out.append(mark)
    return out[::-1]


def repeated_words(words: list[list[bytes]]) -> list[int]:
    """How many words of each text stand in a window of 5 words that it holds more than once."""
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ids = np.fromiter((number[w] for own in words for w in own), np.int64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(words)), sizes)
    n = len(ids) - WINDOW + 1
    if n <= 0:
        return [0] * len(words)
    starts = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :])
    mixed = doc[starts].astype(np.uint64)
    for k in range(WINDOW):
        mixed = (mixed * np.uint64(0x9E3779B97F4A7C15)) ^ (mixed >> np.uint64(29)) ^ ids[starts + k].astype(np.uint64)
    order = np.argsort(mixed, kind="stable")
    at = starts[order]
    same = np.flatnonzero(mixed[order][1:] == mixed[order][:-1])
    a, b = at[same], at[same + 1]
    equal = doc[a] == doc[b]
    for k in range(WINDOW):
        equal &= ids[a + k] == ids[b + k]
    change = np.zeros(len(ids) + 1, np.int64)
    for side in (a[equal], b[equal]):
        side = np.unique(side)
        np.add.at(change, side, 1)
        np.add.at(change, side + WINDOW, -1)
    covered = np.cumsum(change[:-1]) > 0
    return np.bincount(doc[covered], minlength=len(words)).tolist()


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """Line features and marks of at most TRAINING_DOCS rows of labelled documents of each class, chosen by a hash of their id."""
    marked = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").alias("mark")).distinct()
    chosen = [marked.where(F.col("mark") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAINING_DOCS) for c in (0, 1)]
    ids = F.broadcast(chosen[0].union(chosen[1]))  # 2 * TRAINING_DOCS rows
    picked = docs.select("doc_id", "text").where("text is not null").join(ids, "doc_id").select(F.xxhash64("doc_id").alias("h"), "text", "mark")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, text, mark in zip(*(b.column(k).to_pylist() for k in range(3))):
                lines = text.encode().split(b"\n")
                features = line_features(lines, repeated_lines(lines))
                first = h % max(1, len(lines) - TRAINING_LINES + 1)
                part = features[first : first + TRAINING_LINES].astype(np.int16)
                yield pa.RecordBatch.from_arrays([pa.array([h], pa.int64()), pa.array([mark], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["h", "mark", "lines"])

    order = Window.partitionBy("mark").orderBy("h", "lines")  # rows may repeat an id
    rows = picked.mapInArrow(run, "h long, mark int, lines binary").withColumn("place", F.row_number().over(order)).where(F.col("place") <= TRAINING_DOCS).collect()
    rows.sort(key=lambda r: (r["h"], r["mark"], bytes(r["lines"])))
    width = line_features([b""], np.zeros(1, bool)).shape[1]
    return [np.frombuffer(r["lines"], np.int16).reshape(-1, width).astype(np.int64) for r in rows], np.array([r["mark"] for r in rows], np.int64)


def quality_rules(df: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``key`` (as ``row_key`` gives), the base counts, ``content_share``, ``base_failed`` and ``kept`` of every row.

    A null text has no words and fails the base rules. Where ``labels``
    (doc_id, quality) don't hold both classes among the documents, no field can
    be trained and the base rules alone decide. Repeated rows are judged each by
    itself; columns besides doc_id and text are left out.
    """
    small_batches(df.sparkSession)
    sequences, marks = sample(df, labels)
    field = train(sequences, marks) if len(set(marks.tolist())) == 2 else None
    shared = df.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for table in gathered(batches, "text"):
            texts = [(x or "").encode() for x in table.column("text").to_pylist()]
            words = [x.split() for x in texts]
            lines = [x.split(b"\n") for x in texts]
            again = [repeated_lines(x) for x in lines]
            share = np.ones(len(texts))
            if field is not None:
                weights, moves = field
                flat = [y for x in lines for y in x]
                scores = weights[line_features(flat, np.concatenate(again))].sum(1)
                at = 0
                for i, own in enumerate(lines):
                    sizes = np.fromiter(map(len, own), np.int64, len(own))
                    if sizes.any():
                        share[i] = sizes[np.array(viterbi(scores[at : at + len(own)], moves)) == 1].sum() / sizes.sum()
                    at += len(own)
            n_words = np.array([len(x) for x in words], np.int64)
            repeat = np.array(repeated_words(words), np.int64)
            failed = (n_words < LEAST_WORDS) | (100 * repeat > MOST_REPEATED * n_words)
            blob = [b"".join(x) for x in words]
            yield pa.RecordBatch.from_arrays(
                [
                    table.column("doc_id").combine_chunks(),
                    table.column("key").combine_chunks(),
                    pa.array(n_words),
                    pa.array([len(x.decode()) for x in blob], pa.int64()),
                    pa.array([len(x) - len(x.translate(None, SYMBOLS)) for x in blob], pa.int64()),
                    pa.array([int(x.sum()) for x in again], pa.int64()),
                    pa.array(repeat),
                    pa.array(share),
                    pa.array(failed),
                    pa.array(~failed & (share >= CONTENT_SHARE)),
                ],
                ["doc_id", "key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content_share", "base_failed", "kept"],
            )

    more = T.StructType.fromDDL("key string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content_share double, base_failed boolean, kept boolean")
    return df.select("doc_id", row_key().alias("key"), "text").mapInArrow(run, T.StructType([df.schema["doc_id"], *more.fields]))
