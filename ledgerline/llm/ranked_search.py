"""Operator 11: the best documents for each query text, by bit-sliced Bloom signatures and exact rescoring.

A document's signature holds a few bits for each term and, at term frequency
2, 4, 8, ..., for the term at that level. Documents of like size make a block,
kept by slices: one bitmap over the block's documents for each bit of the
signature. The slices of a term, and-ed, are the documents that may hold it,
never fewer; with its levels they bound its frequency, and with the lengths,
kept exactly, what it may add to a score. Weighted sums of these bitmaps bound
every document's score from above. The documents with the highest bounds are
scored exactly, which gives each item a score that its last result has at
least; then all documents whose bound isn't below it are scored exactly.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.ordering import range_number

from .common import gathered, row_key, small_batches, written

#: Bits of a signature for each entry at least, bits that an entry sets, bits of a block of signatures.
BITS, PROBES, BLOCK_BITS = 12, 3, 1 << 23
#: Items searched at once: their terms are held by each task. Slots of the filter that tells which terms to count.
ITEMS, SLOTS = 256, 1 << 20
#: Terms that a task counts before it hands them on, hashes that it remembers, candidates that are broadcast.
COUNTED, REMEMBERED, BROADCAST_ROWS = 200_000, 500_000, 1 << 17

#: A-Z in lower case, other ASCII but digits and letters as spaces; bytes beyond ASCII belong to terms.
FOLDED = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).translate(bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)))
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(32)


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLDED).split() if text else []


class _Hashes(dict):
    """64-bit hashes of terms, remembered."""

    def __missing__(self, term: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[term] = h = xxhash.xxh64_intdigest(term)
        return h


def _at_level(hashes: np.ndarray, level: int) -> np.ndarray:
    mixed = (hashes + np.uint64(level)) * _MIX
    return mixed ^ (mixed >> _STEP)


def _positions(hashes: np.ndarray, width: int) -> np.ndarray:
    """Bits that each hash sets in signatures of ``width`` bits, a power of two."""
    step = (hashes >> _STEP) | np.uint64(1)
    return ((hashes[None, :] + np.arange(PROBES, dtype=np.uint64)[:, None] * step) & np.uint64(width - 1)).astype(np.int64)


def signature(counts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Hashes of a document's entries: its terms, and those met 2, 4, 8, ... times at their levels."""
    found = [_at_level(hashes, 0)]
    level = 1
    while (often := counts >= 1 << level).any():
        found.append(_at_level(hashes[often], level))
        level += 1
    return np.concatenate(found)


def width_for(entries: int) -> int:
    return max(256, 1 << (BITS * entries - 1).bit_length())


def sliced(documents: list[np.ndarray], width: int) -> bytes:
    """The block's bitmaps: row b has a bit for each document whose signature has bit b."""
    bits = np.zeros((width, -(-len(documents) // 8) * 8), bool)
    for k, entries in enumerate(documents):
        bits[_positions(entries, width).ravel(), k] = True
    return np.packbits(bits, axis=1).tobytes()


def gain(tf, m):
    """What a term met ``tf`` times adds to a score, for each unit of its weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def length_factor(n, documents: int, words: int):
    return 25 + (75 * n * documents) // words


def bounds(width: int, slices: bytes, lengths: np.ndarray, terms: dict[bytes, list[tuple[int, int]]], items: int, documents: int, words: int) -> np.ndarray:
    """Upper bounds of every item's score for each document of a block. ``terms``: (item, weight) pairs of each term."""
    rows = np.frombuffer(slices, np.uint8).reshape(width, -1)
    n = len(lengths)
    m = length_factor(lengths, documents, words)
    gains = [gain(np.minimum((2 << k) - 1, lengths), m) for k in range(int(lengths.max()).bit_length())]
    total = np.zeros((items, n), np.int64)
    hashes = np.array([xxhash.xxh64_intdigest(t) for t in terms], np.uint64)
    at = [_positions(_at_level(hashes, k), width) for k in range(len(gains))]
    for t, uses in enumerate(terms.values()):
        held, most = None, None
        for k, g in enumerate(gains):
            bits = np.bitwise_and.reduce(rows[at[k][:, t]], axis=0)
            held = bits if held is None else held & bits
            if not held.any():
                break
            here = np.unpackbits(held, count=n).view(bool)
            most = np.where(here, g, 0 if most is None else most)
        if most is not None:
            for item, weight in uses:
                total[item] += weight * most
    return total


def signature_blocks(docs: DataFrame, wanted: bytes) -> DataFrame:
    """Blocks of all documents' signatures, and counts: documents with terms, their terms, documents of each term in the filter ``wanted``.

    A block belongs to one partition and to one width. Documents without terms are in none.
    """
    small_batches(docs.sparkSession)
    schema = "width int, keys array<string>, lengths binary, slices binary, n_docs long, n_terms long, terms array<binary>, dfs array<long>"
    arrow = pa.schema(
        [("width", pa.int32()), ("keys", pa.list_(pa.string())), ("lengths", pa.binary()), ("slices", pa.binary()), ("n_docs", pa.int64()), ("n_terms", pa.int64()), ("terms", pa.list_(pa.binary())), ("dfs", pa.list_(pa.int64()))]
    )

    def run(batches):
        filtered, hashes = np.unpackbits(np.frombuffer(wanted, np.uint8)).view(bool), _Hashes()
        open_blocks, df, n_docs, n_terms = defaultdict(list), Counter(), 0, 0

        def block(width):
            held = open_blocks.pop(width)
            lengths = np.array([x[1] for x in held], np.int64)
            return pa.RecordBatch.from_pylist([{"width": width, "keys": [x[0] for x in held], "lengths": lengths.tobytes(), "slices": sliced([x[2] for x in held], width)}], arrow)

        def counts():
            row = {"n_docs": n_docs, "n_terms": n_terms, "terms": list(df), "dfs": list(df.values())}
            df.clear()
            return pa.RecordBatch.from_pylist([row], arrow)

        for table in gathered(batches, "text"):
            for key, text in zip(table.column("key").to_pylist(), table.column("text").cast(pa.binary()).to_pylist()):
                terms = terms_of(text)
                if not terms:
                    continue
                found = Counter(terms)
                own = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
                df.update(compress(found, filtered[own & np.uint64(SLOTS - 1)]))
                n_docs, n_terms = n_docs + 1, n_terms + len(terms)
                entries = signature(np.fromiter(found.values(), np.int64, len(found)), own)
                width = width_for(len(entries))
                open_blocks[width].append((key, len(terms), entries))
                if len(open_blocks[width]) * width >= BLOCK_BITS:
                    yield block(width)
                if len(df) >= COUNTED:
                    yield counts()
                    n_docs = n_terms = 0
        for width in list(open_blocks):
            yield block(width)
        yield counts()

    return docs.select(row_key().alias("key"), "text").mapInArrow(run, schema)


def _scored(docs: DataFrame, candidates: DataFrame, weights: dict[int, list[tuple[bytes, int]]], documents: int, words: int) -> DataFrame:
    """(item, doc_id, score) of all candidates (item, key), from the whole texts."""
    asked = written(candidates.groupBy("key").agg(F.collect_set("item").alias("items")), "search-candidates")
    few = asked.count() <= BROADCAST_ROWS
    rows = docs.select("doc_id", row_key().alias("key"), "text").join(F.broadcast(asked) if few else asked.hint("shuffle_hash"), "key").select("doc_id", "text", "items")
    out = pa.schema([("item", pa.int64()), ("doc_id", rows.schema["doc_id"].dataType.simpleString() == "bigint" and pa.int64() or pa.int32()), ("score", pa.int64())])

    def run(batches):
        for table in gathered(batches, "text"):
            found = []
            for doc, text, items in zip(table.column("doc_id").to_pylist(), table.column("text").cast(pa.binary()).to_pylist(), table.column("items").to_pylist()):
                terms = terms_of(text)
                tf, m = Counter(terms), length_factor(len(terms), documents, words)
                for item in items:
                    score = sum(w * gain(tf[t], m) for t, w in weights[item] if t in tf)
                    if score > 0:
                        found.append((item, doc, score))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], f.type) for k, f in enumerate(out)], schema=out)

    return rows.mapInArrow(run, f"item long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, score long")


def _bounded(index: DataFrame, terms: dict[bytes, list[tuple[int, int]]], floors: list[int] | None, items: int, documents: int, words: int, k: int) -> DataFrame:
    """(item, key, bound): every document whose bound reaches the item's floor or, without floors, a task's ``k`` highest of each item."""

    def run(batches):
        best: list[list[tuple[int, str]]] = [[] for _ in range(items)]
        for batch in batches:
            for row in batch.to_pylist():
                upper = bounds(row["width"], row["slices"], np.frombuffer(row["lengths"], np.int64), terms, items, documents, words)
                keys = row["keys"]
                if floors is not None:
                    item, doc = np.nonzero(upper >= np.array(floors)[:, None])
                    yield pa.RecordBatch.from_pydict({"item": item, "key": [keys[d] for d in doc], "bound": upper[item, doc]}, schema)
                    continue
                for i in range(items):
                    top = np.argpartition(-upper[i], k - 1)[:k] if len(keys) > k else np.arange(len(keys))
                    best[i] = sorted(best[i] + [(-int(upper[i, d]), keys[d]) for d in top if upper[i, d] > 0])[:k]
        if floors is None:
            rows = [(i, key, -b) for i, held in enumerate(best) for b, key in held]
            yield pa.RecordBatch.from_arrays([pa.array([r[x] for r in rows], f.type) for x, f in enumerate(schema)], schema=schema)

    schema = pa.schema([("item", pa.int64()), ("key", pa.string()), ("bound", pa.int64())])
    return index.select("width", "keys", "lengths", "slices").mapInArrow(run, "item long, key string, bound long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents with the highest score above 0 for each row of ``items``, ties by smaller doc_id.

    ``docs`` needs doc_id and text, ``items`` item_id and text; other columns aren't read. A null or empty text has no terms: such an item
    finds nothing, such a document is never found nor counted. Rows that repeat are documents, and items, of their own; a null doc_id comes
    after others of its score. Of empty tables nothing comes. Nothing depends on chance: bounds never lie below a score.

    Tasks hold the terms of ``ITEMS`` items at once; more items are searched in turns over the same index.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    numbered = items.select(F.lit("").alias("all"), "item_id", F.col("text").alias("words"), F.monotonically_increasing_id().alias("row"))
    numbered = written(range_number(written(numbered, "search-items"), "all", ["item_id", "row"], "item", "n_items").drop("all", "row"), "search-items")

    def split(batches):
        for table in gathered(batches, "words"):
            found = [(i, t, q) for i, text in zip(table.column("item").to_pylist(), table.column("words").cast(pa.binary()).to_pylist()) for t, q in Counter(terms_of(text)).items()]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], kind) for c, kind in enumerate((pa.int64(), pa.binary(), pa.int64()))], ["item", "term", "uses"])

    asked = written(numbered.select("item", "words").mapInArrow(split, "item long, term binary, uses long"), "search-terms")
    slots = np.zeros(SLOTS, bool)
    for batch in asked.select("term").distinct().mapInArrow(_slots, "slot int").distinct().toLocalIterator():  # SLOTS numbers at most
        slots[batch.slot] = True
    index = written(signature_blocks(docs, np.packbits(slots).tobytes()), "search-index")
    documents, words = (x or 0 for x in index.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    blocks = index.where("width is not null")
    counted = index.where("terms is not null").select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.dfs").alias("df"))
    weighed = written(asked.join(counted, "term"), "search-weights")  # a term of no document adds to no score
    found = spark.createDataFrame([], f"item long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long, rank int")
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    for first in range(0, numbered.count(), ITEMS):
        terms, weights = defaultdict(list), defaultdict(list)
        for r in weighed.where(F.col("item").between(first, first + ITEMS - 1)).toLocalIterator():
            w = r.uses * math.floor(1000 * math.log((2 * documents + 2) / (2 * r.df + 1)))
            terms[bytes(r.term)].append((r.item - first, w))
            weights[r.item - first].append((bytes(r.term), w))
        if not terms:
            continue
        search = (documents, words, k)
        likely = _bounded(blocks, dict(terms), None, ITEMS, *search)
        likely = likely.withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "key"))).where(F.col("place") <= k)
        sure = _scored(docs, likely, dict(weights), documents, words).withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k)
        floors = [1] * ITEMS
        for r in sure.collect():  # one row for each of the items
            floors[r.item] = r.score
        open_ = _bounded(blocks, dict(terms), floors, ITEMS, *search)
        ranked = _scored(docs, open_, dict(weights), documents, words).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        found = found.unionByName(written(ranked.withColumn("item", F.col("item") + first), "search-found"))
    return found.join(numbered.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def _slots(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh64_intdigest(t) & (SLOTS - 1) for t in batch.column(0).to_pylist()], pa.int32())], ["slot"])


def search_sql(k: int = 10) -> str:
    """The same in DuckDB's SQL, over all pairs that share a term."""
    terms = f"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}')"
    return rf"""
        WITH docs AS (SELECT *, row_number() OVER () AS row FROM (SELECT doc_id, {terms} AS terms FROM documents) WHERE len(terms) > 0),
             total AS (SELECT count(*) AS docs, sum(len(terms))::BIGINT AS words FROM docs),
             tf AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM docs) GROUP BY row, term),
             df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
             items AS (SELECT row_number() OVER () AS item, item_id, {terms} AS terms FROM benchmark),
             asked AS (SELECT item, term, count(*) AS uses FROM (SELECT item, unnest(terms) AS term FROM items) GROUP BY item, term),
             weighed AS (SELECT item, term, uses * floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w FROM asked JOIN df USING (term), total),
             factor AS (SELECT row, doc_id, 25 + (75 * len(terms) * docs.docs) // words AS m FROM (SELECT d.*, t.docs, t.words FROM docs d, total t) docs),
             scored AS (SELECT item, doc_id, row, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM weighed JOIN tf USING (term) JOIN factor USING (row) GROUP BY item, doc_id, row),
             ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM scored WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM ranked JOIN items USING (item) WHERE rank <= {k}"""
