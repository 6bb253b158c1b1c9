"""Operator 3: token ids as fixed-width bit-packed blocks.

Each id takes the fewest bits that hold every id of the vocabulary. A file is a
Parquet part of blocks; a block has whole documents, about ``BLOCK_IDS`` ids,
its shard, its number and first id in it, its documents' ids and lengths, and the packed ids,
least significant bit first. As every id has the same width, the i-th id of a
block lies at bit i * width: a reader can unpack any slice of it with numpy.
Spark's committer writes the parts, so a lost task leaves nothing behind.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.taskcontext import TaskContext

from .common import binary_array, small_batches, written
from .tokenizing import encoded_batches, library_encoder, ranges, worker_encoder

BLOCK_IDS = 1 << 16
#: Bytes of text that are encoded at once; what is worked out of them takes some fifty times as much.
TEXT_BYTES = 1 << 20
BLOCKS = T.StructType(
    [
        T.StructField("shard", T.IntegerType()),
        T.StructField("block", T.LongType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("first", T.LongType()),
        T.StructField("n_ids", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("lengths", T.ArrayType(T.LongType())),
        T.StructField("packed", T.BinaryType()),
    ]
)


def width_of(vocabulary: int) -> int:
    """Bits for ids from 0 to vocabulary - 1."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids below 2 ** width, each in ``width`` bits."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(packed: bytes, width: int, start: int, stop: int) -> np.ndarray:
    """Ids number ``start`` to ``stop`` of a block, reading only the bytes that hold them."""
    n = max(0, stop - start)
    if width in (8, 16, 32):
        return np.frombuffer(packed, f"<u{width // 8}", n, start * width // 8).astype(np.uint32)
    first, last = start * width // 8, (stop * width + 7) // 8
    bits = np.unpackbits(np.frombuffer(packed, np.uint8, last - first, first), bitorder="little")
    bits = bits[start * width - 8 * first :][: n * width].reshape(n, width)
    return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(1, dtype=np.uint32)


def vocabulary_of(tokenizer: str) -> int:
    """One more than the largest id that a tokenizer file gives."""
    with open(tokenizer, encoding="utf-8") as f:
        spec = json.load(f)
    return 1 + max([*spec["model"]["vocab"].values(), *(x["id"] for x in spec.get("added_tokens", []))])


def write_token_blocks(df: DataFrame, tokenizer: str, end_id: int, path: str) -> None:
    """Encodes every whole text of ``df`` and writes the blocks to ``path``, ascending by doc_id over the shards.

    Ids are as wide as the tokenizer file's vocabulary and ``end_id`` need.
    A null text counts as empty: it has the end id alone. Null doc_ids come
    first; rows that repeat a doc_id follow each other by text. Only doc_id and
    text are read. Ranges of doc_id deal the rows out, so that no order of all
    rows is made in one place.
    """
    small_batches(df.sparkSession)
    width = width_of(max(vocabulary_of(tokenizer), end_id + 1))

    def run(batches):
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        enc = worker_encoder(library_encoder, tokenizer)
        for table, ids, offsets in encoded_batches(batches, "text", enc, TEXT_BYTES):
            lengths = np.diff(offsets) + 1
            ends = np.cumsum(lengths)
            flat = np.full(int(ends[-1]), end_id, np.uint32)
            flat[ranges(ends - lengths, lengths - 1)] = ids
            docs = table.column("doc_id").combine_chunks()
            at = 0
            while at < len(docs):  # whole documents up to BLOCK_IDS ids, one at least
                base = int(ends[at] - lengths[at])
                to = max(at + 1, int(np.searchsorted(ends, base + BLOCK_IDS, "right")))
                n = int(ends[to - 1]) - base
                one = pa.array([0, to - at], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array([x], kind) for x, kind in ((shard, pa.int32()), (block, pa.int64()), (width, pa.int32()), (first, pa.int64()), (n, pa.int64()))),
                        pa.ListArray.from_arrays(one, docs[at:to]),
                        pa.ListArray.from_arrays(one, pa.array(lengths[at:to])),
                        pa.array([pack(flat[base : base + n], width)], pa.binary()),
                    ],
                    BLOCKS.names,
                )
                at, block, first = to, block + 1, first + n

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()).mapInArrow(run, BLOCKS).write.parquet(path)


def read_token_blocks(spark: SparkSession, path: str) -> DataFrame:
    """A row per block, with ``base``: how many ids all shards and blocks before it hold.

    Only the table of shards is joined, a row for each, which Spark broadcasts
    if it is small as written; the blocks themselves stay where they are.
    """
    blocks = spark.read.schema(BLOCKS).parquet(path)
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = written(sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "shards")
    return blocks.join(shards, "shard").withColumn("base", F.col("before") + F.col("first")).drop("before")


def read_token_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start``, ``ids`` (little-endian unsigned 32-bit integers, the end id last) of every document in the files."""
    small_batches(spark)

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                width, n, base, packed = (b.column(c)[k].as_py() for c in ("width", "n_ids", "base", "packed"))
                docs, lengths = b.column("doc_ids")[k].values, b.column("lengths")[k].values.to_numpy()
                ends = np.cumsum(lengths)
                yield pa.RecordBatch.from_arrays([docs, pa.array(base + ends - lengths), binary_array(unpack(packed, width, 0, n).astype("<u4"), np.r_[0, ends])], ["doc_id", "start", "ids"])

    return read_token_blocks(spark, path).select("width", "n_ids", "doc_ids", "lengths", "packed", "base").mapInArrow(run, "doc_id long, start long, ids binary")


def _slices(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and ``ids``, ids number ``at`` to ``to`` of each row's block, from the bytes that hold them alone."""

    def run(batches):
        for b in batches:
            cut = [unpack(p.as_py(), w, x, y).astype("<u4").tobytes() for p, w, x, y in zip(b.column("packed"), *(b.column(c).to_pylist() for c in ("width", "at", "to")))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(cut, pa.binary())], [*keep, "ids"])

    out = T.StructType([*(rows.schema[c] for c in keep), T.StructField("ids", T.BinaryType())])
    return rows.select(*keep, "width", "at", "to", "packed").mapInArrow(run, out)


def documents_by_id(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """``doc_id`` and ``ids`` of the documents in ``wanted`` (``doc_id``), found by the blocks' offsets.

    The offsets alone are searched; packed ids are read of the blocks that hold a
    document, and unpacked where it lies. Documents that share an id are all found; unknown and null ids give none.
    """
    small_batches(spark)
    blocks = spark.read.schema(BLOCKS).parquet(path)

    def placed(batches):
        for b in batches:
            for k in range(b.num_rows):
                docs, lengths = b.column("doc_ids")[k].values, b.column("lengths")[k].values.to_numpy()
                ends = np.cumsum(lengths)
                same = [pa.array([b.column(c)[k].as_py()] * len(docs), kind) for c, kind in (("shard", pa.int32()), ("block", pa.int64()))]
                yield pa.RecordBatch.from_arrays([*same, docs, pa.array(ends - lengths), pa.array(ends)], ["shard", "block", "doc_id", "at", "to"])

    listed = blocks.select("shard", "block", "doc_ids", "lengths").mapInArrow(placed, "shard int, block long, doc_id long, at long, to long")
    places = listed.join(wanted.select(F.col("doc_id").cast("long")).distinct(), "doc_id")
    return _slices(places.join(blocks.select("shard", "block", "width", "packed"), ["shard", "block"]), ["doc_id"])


def ids_between(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """``start`` and ``ids``: the files' ids number ``start`` to ``stop``, counted over all documents, a row for each block that holds some."""
    small_batches(spark)
    blocks = read_token_blocks(spark, path).where((F.col("base") < stop) & (F.col("base") + F.col("n_ids") > start))
    at, to = F.greatest(F.lit(start) - F.col("base"), F.lit(0)), F.least(F.lit(stop) - F.col("base"), F.col("n_ids"))
    return _slices(blocks.withColumn("at", at).withColumn("to", to).withColumn("start", F.col("base") + F.col("at")), ["start"])
