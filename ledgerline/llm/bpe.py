"""Operator 2: byte-level BPE encoding and decoding with a pair occurrence index.

All distinct pieces of a batch lie in one array of symbols, linked to their
neighbours. An index maps each mergeable pair, named by its rank, to all its
positions in that array. A heap holds the active ranks; the lowest is applied
to all its positions at once, and the pairs that this makes join the lists of
their own ranks. A piece's merges thus happen in the order of their ranks, as
in any BPE encoder, while each step is one numpy operation over the partition.
"""

from __future__ import annotations

import heapq
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import gathered, list_array, small_batches
from .tokenizing import PieceEncoder, encoded_batches, ranges, worker_encoder

#: How this family of byte-level tokenizers splits a text into pieces.
PIECES = r" ?\p{L}+| ?\p{N}+|'(?:[stmd]|re|ve|ll)| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters and numbers up to U+00FF; the standard library's faster expressions do for texts without others.
LETTERS, NUMBERS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", "0-9\u00b2\u00b3\u00b9\u00bc\u00bd\u00be"
DOC_ID, TEXT = "doc_id", "text"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in set(shown) else chr(next(spare)) for b in range(256)]


class PairIndexBpe:
    """A byte-level BPE vocabulary from a tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.byte_id = np.array([vocab[c] for c in letters], np.int64)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.size = max(max(vocab.values()), *self.special.values(), 0) + 1
        left, right = (np.array([vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
        self.left, self.right = left, right
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = left * self.size + right
        self.rank_order = np.argsort(keys, kind="stable")
        self.keys = keys[self.rank_order]
        spelled = [b""] * self.size
        for token, i in vocab.items():
            spelled[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            spelled[i] = token.encode()
        self.token_lengths = np.array([len(x) for x in spelled], np.int64)
        self.token_starts = np.cumsum(self.token_lengths) - self.token_lengths
        self.token_bytes = np.frombuffer(b"".join(spelled), np.uint8)
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.pieces = regex.compile(PIECES)
        self.narrow = re.compile(rf" ?(?:[{LETTERS}]+|[{NUMBERS}]+)|'(?:[stmd]|re|ve|ll)| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+")

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1."""
        key = a * self.size + b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.rank_order[at], -1)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and their number for each piece."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        symbol = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        n = len(symbol)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = np.cumsum(sizes)
        filled = sizes > 0
        after[ends[filled] - 1] = n  # n: no neighbour
        before[(ends - sizes)[filled]] = -1
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enlist(at: np.ndarray, ranks: np.ndarray) -> None:
            at, ranks = at[ranks >= 0], ranks[ranks >= 0]
            if not len(at):
                return
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for rank, where in zip(ranks[np.r_[0, cuts]].tolist(), np.split(at, cuts), strict=True):
                if rank not in index:
                    index[rank] = []
                    heapq.heappush(active, rank)
                index[rank].append(where)

        first = np.flatnonzero(after < n)
        enlist(first, self._ranks(symbol[first], symbol[after[first]]))
        while active:
            rank = heapq.heappop(active)
            lists = index.pop(rank)
            a, b, c = self.left[rank], self.right[rank], self.merged[rank]
            p = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
            p = p[symbol[p] == a]
            q = after[p]
            p, q = p[q < n], q[q < n]
            if a == b and len(p) > 1:  # of overlapping pairs in a run, every other one from the left
                chained = np.r_[False, p[1:] == q[:-1]]
                start = np.maximum.accumulate(np.where(chained, 0, np.arange(len(p))))
                p = p[(np.arange(len(p)) - start) % 2 == 0]
                q = after[p]
            good = symbol[q] == b
            p, q = p[good], q[good]
            if not len(p):
                continue
            symbol[p], symbol[q] = c, -1
            far = after[q]
            after[p] = far
            inner = far < n
            before[far[inner]] = p[inner]
            left = before[p]
            has = left >= 0
            enlist(
                np.concatenate([left[has], p[inner]]),
                self._ranks(np.concatenate([symbol[left[has]], symbol[p[inner]]]), np.concatenate([symbol[p[has]], symbol[far[inner]]])),
            )
        kept = np.concatenate([[0], np.cumsum(symbol >= 0)])
        return symbol[symbol >= 0], kept[ends] - kept[ends - sizes]

    def split(self, text: str) -> list[str]:
        """Pieces of a text in order; a special token in it is a piece of its own."""
        if any(x in text for x in self.special):
            parts = self.split_special.split(text)
            return [x for k, part in enumerate(parts) for x in ([part] if k % 2 else self._plain(part))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        try:
            narrow = (text.isascii() or text.encode("latin-1")) and not any(x in text for x in "\x1c\x1d\x1e\x1f")
        except UnicodeEncodeError:
            narrow = False
        return (self.narrow if narrow else self.pieces).findall(text)

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and their number for each piece."""
        flat, lengths = self.merge([b"" if x in self.special else x.encode() for x in pieces])
        for i, x in enumerate(pieces):
            if x in self.special:
                flat, lengths[i] = np.insert(flat, int(lengths[:i].sum()), self.special[x]), 1
        return flat, lengths

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of the id lists between the offsets; bytes that aren't UTF-8 become U+FFFD."""
        lengths = self.token_lengths[ids]
        data = self.token_bytes[ranges(self.token_starts[ids], lengths)].tobytes()
        ends = np.concatenate([[0], np.cumsum(lengths)])[offsets].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]


class PairIndexEncoder(PieceEncoder):
    """A vocabulary and the pieces remembered with it."""

    def __init__(self, path: str):
        self.bpe = PairIndexBpe(path)
        super().__init__(self.bpe.split, self.bpe.encode_pieces)


def pair_index_encoder(path: str) -> PairIndexEncoder:
    return PairIndexEncoder(path)


def bpe_encode(df: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and ``ids`` (array of int) of every whole text of ``df``.

    A null or empty text has an empty list. Repeated rows and null ids of
    documents stay as they are; columns besides doc_id and text are left out.
    """
    small_batches(df.sparkSession)

    def run(batches):
        enc = worker_encoder(pair_index_encoder, path)
        for table, ids, offsets in encoded_batches(batches, TEXT, enc):
            yield pa.RecordBatch.from_arrays([table.column(DOC_ID).combine_chunks(), list_array(ids.astype(np.int32), offsets, pa.int32())], [DOC_ID, "ids"])

    out = T.StructType([T.StructField(DOC_ID, df.schema[DOC_ID].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.select(F.col(DOC_ID), F.col(TEXT)).mapInArrow(run, out)


def bpe_decode(df: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``ids`` and ``text`` from rows of ids. A null list gives a null text, an empty one an empty text."""
    small_batches(df.sparkSession)

    def run(batches):
        bpe = worker_encoder(pair_index_encoder, path).bpe  # a worker may encode in one task and decode in the next
        for table in gathered(batches, "ids"):
            ids = table.column("ids").combine_chunks()
            offsets = ids.offsets.to_numpy().astype(np.int64)
            texts = bpe.decode(ids.values.to_numpy(zero_copy_only=False).astype(np.int64)[offsets[0] :], offsets - offsets[0])
            missing = ids.is_null().to_pylist()
            texts = pa.array([None if m else x for m, x in zip(missing, texts)], pa.string())
            yield pa.RecordBatch.from_arrays([table.column(DOC_ID).combine_chunks(), ids, texts], [DOC_ID, "ids", TEXT])

    out = T.StructType([df.schema[DOC_ID], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField(TEXT, T.StringType())])
    return df.select(DOC_ID, "ids").mapInArrow(run, out)
