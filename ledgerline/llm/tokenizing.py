"""Encoding whole texts with a tokenizer file, each distinct piece of text once per worker.

Texts repeat their words. A text is cut into pieces that the tokenizer encodes
alike wherever they stand; each distinct piece is encoded once, remembered
within bounds, and the ids of a text are gathered with numpy.
"""

from __future__ import annotations

import os
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa

from .common import BATCH_BYTES, gathered, worker_memory

#: Most pieces and characters that a worker remembers.
MAX_PIECES, MAX_CHARS = 400_000, 10_000_000
#: Pieces that the library encodes at once, as it keeps much for each, and those of them that go as one string.
LIBRARY_BATCH, LIBRARY_JOINED = 4096, 32


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [start, start + length), one range after another."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)


class PieceEncoder:
    """``split`` cuts a text into pieces, ``encode_pieces`` maps pieces to flat ids and a number for each."""

    def __init__(self, split: Callable[[str], list[str]], encode_pieces: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: tuple[int, int] | None = None):
        self.split, self.encode_pieces, self.most = split, encode_pieces, most
        self.forget()

    def forget(self) -> None:
        self.index: defaultdict[str, int] = defaultdict(count().__next__)
        self.flat, self.starts, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.hits, self.chars = np.zeros(0, np.int64), 0

    def trim(self) -> None:
        """Forgets the pieces met least often, until half of what may be remembered is left at most."""
        keys, least = list(self.index), 2
        pieces, chars = self.most or (MAX_PIECES, MAX_CHARS)
        while (kept := np.flatnonzero(self.hits >= least)).size > pieces // 2:
            least *= 2
        keys = [keys[i] for i in kept.tolist()]
        starts, lengths = self.starts[kept], self.lengths[kept]
        self.index = defaultdict(count(len(keys)).__next__, zip(keys, range(len(keys))))
        self.flat, self.starts, self.lengths = self.flat[ranges(starts, lengths)], np.cumsum(lengths) - lengths, lengths
        self.hits, self.chars = self.hits[kept] // least, sum(map(len, keys))
        if self.chars > chars // 2:
            self.forget()

    def learn(self) -> None:
        fresh = list(islice(self.index, len(self.starts), None))
        if not fresh:
            return
        self.chars += sum(map(len, fresh))
        flat, lengths = self.encode_pieces(fresh)
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, flat.astype(np.uint32)])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the offset at which each text's ids begin (and the end); a null text has none."""
        pieces, chars = self.most or (MAX_PIECES, MAX_CHARS)
        if len(self.index) > pieces or self.chars > chars:
            self.trim()
        at = self.index.__getitem__
        found, sizes = array("q"), np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            was = len(found)
            if text:
                found.extend(map(at, self.split(text)))
            sizes[i] = len(found) - was
        self.learn()
        x = np.frombuffer(found, np.int64) if found else np.zeros(0, np.int64)
        self.hits = np.bincount(x, minlength=len(self.starts)) + np.pad(self.hits, (0, len(self.starts) - len(self.hits)))
        sums = np.r_[0, np.cumsum(self.lengths[x])]
        return self.flat[ranges(self.starts[x], self.lengths[x])], sums[np.r_[0, np.cumsum(sizes)]]


def folded_words(text: str) -> list[str]:
    """Chunks between spaces, for tokenizers that fold case and drop white space.

    No token of theirs crosses a space. Up to U+00FF case and white space can
    be dealt with here without another result.
    """
    try:
        plain = text.isascii() or text.encode("latin-1")
    except UnicodeEncodeError:
        plain = False
    if not plain or "<|" in text or any(x in text for x in "\x1c\x1d\x1e\x1f"):
        return [x for x in text.split(" ") if x]
    return text.lower().split()


def separator(tokenizer) -> tuple[str, int] | None:
    """An added token that parts pieces within one string as if each were encoded alone, and its id; None if there is none.

    The library cuts a text at added tokens before all else. No other added token
    may begin inside it, overlap it or look at what stands beside it.
    """
    added = tokenizer.get_added_tokens_decoder()
    if any(x.single_word or x.lstrip or x.rstrip for x in added.values()):
        return None
    for i, x in sorted(added.items()):
        others = [y.content for y in added.values() if y.content != x.content]
        if not x.normalized and not any(x.content[0] in y[1:] for y in [x.content, *others]) and not any(y.startswith(x.content) or x.content.startswith(y) for y in others):
            return x.content, i
    return None


def library_encoder(path: str) -> PieceEncoder:
    """An encoder by the tokenizers library, for a tokenizer file that folds case and drops white space."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    parted = separator(tokenizer)

    def ids_of(texts: list[str], at_once: int) -> list[array]:
        return [array("I", x.ids) for k in range(0, len(texts), at_once) for x in tokenizer.encode_batch_fast(texts[k : k + at_once], add_special_tokens=False)]

    def encode(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if parted is None:
            ids = ids_of(pieces, LIBRARY_BATCH)
            return np.frombuffer(b"".join(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))
        # a string of some pieces costs the library half of what they cost it one by one
        token, token_id = parted
        texts = [token.join([*pieces[k : k + LIBRARY_JOINED], ""]) for k in range(0, len(pieces), LIBRARY_JOINED)]
        flat = np.frombuffer(b"".join(ids_of(texts, LIBRARY_BATCH // LIBRARY_JOINED)), np.uint32)
        met = np.cumsum(np.fromiter((1 + x.count(token) for x in pieces), np.int64, len(pieces)))  # a piece may hold the token itself
        ends = np.flatnonzero(flat == token_id)[met - 1]
        return np.delete(flat, ends), np.diff(ends, prepend=-1) - 1

    return PieceEncoder(folded_words, encode)


def worker_encoder(make: Callable[[str], PieceEncoder], path: str) -> PieceEncoder:
    """This worker's encoder; it outlives a task."""
    return worker_memory((make.__module__, make.__name__, path), lambda: make(path))


def encoded_batches(batches: Iterator[pa.RecordBatch], text: str, enc: PieceEncoder, limit: int = BATCH_BYTES) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    for table in gathered(batches, text, limit):
        ids, offsets = enc.encode(table.column(text).to_pylist())
        yield table, ids, offsets
