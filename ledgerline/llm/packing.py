"""Operator 5: best-fit packing with large-item matching.

A packing of lengths from 1 to the capacity depends only on how many items of
each length there are, so the plan is made from that histogram, which never has
more rows than the capacity, whatever the input. Items above a third of the
capacity are large: at most two share a sequence, paired greedily, the longest
with the longest that fits. Smaller items then go, longest first, into the
fullest sequence that has room. The plan is a short table of runs: items
``rank`` to ``rank + n`` of a length lie at ``offset`` in the sequences from
``sequence`` on. Spark numbers the items of each length and joins the runs.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import pair_index_encoder
from .common import binary_array, clear_of, small_batches
from .tokenizing import encoded_batches, ranges, worker_encoder

CAPACITY = 2048
#: The items of each length are numbered in shares, so that a frequent length isn't one task's work: so many at least, and more for more items than SHARE_ROWS in each.
SHARES, SHARE_ROWS = 64, 1 << 20


def plan_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, rank, n, sequence, offset) for ``counts`` items of each length."""
    runs: list[tuple[int, int, int, int, int]] = []
    left = {k: n for k, n in counts.items() if n}
    used: dict[int, int] = defaultdict(int)
    open_at: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> ranges (first sequence, number)
    rooms: list[int] = []  # sorted, those in open_at
    top = 0

    def free(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in open_at:
                bisect.insort(rooms, room)
            open_at[room].append((first, n))

    def put(length: int, n: int, first: int, offset: int) -> None:
        runs.append((length, used[length], n, first, offset))
        used[length] += n
        left[length] -= n

    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        a = large[-1]
        if not left[a]:
            large.pop()
            continue
        k = bisect.bisect_right(large, capacity - a) - 1
        while k >= 0 and not left[large[k]]:
            large.pop(k)
            k -= 1
        if k < 0:
            n = left[a]
            put(a, n, top, 0)
            free(capacity - a, top, n)
        else:
            b = large[k]
            n = left[a] // 2 if a == b else min(left[a], left[b])
            if not n:  # the last one of a length that would pair with itself
                k -= 1
                while k >= 0 and not left[large[k]]:
                    k -= 1
                n, b = 1, large[k] if k >= 0 else 0
            put(a, n, top, 0)
            if b:
                put(b, n, top, a)
            free(capacity - a - b, top, n)
        top += n
    for length in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[length]:
            k = bisect.bisect_left(rooms, length)
            if k == len(rooms):
                n = -(-left[length] // (capacity // length))
                free(capacity, top, n)
                top += n
                continue
            room = rooms[k]
            first, n = open_at[room].pop()
            if not open_at[room]:
                del open_at[room]
                rooms.pop(k)
            each = room // length
            whole = min(n, left[length] // each)
            for i in range(each if whole else 0):
                put(length, whole, first, capacity - room + i * length)
            free(room - each * length, first, whole)
            rest, first, n = left[length], first + whole, n - whole
            if n and rest:  # fewer than one more sequence takes
                for i in range(rest):
                    put(length, 1, first, capacity - room + i * length)
                free(room - rest * length, first, 1)
                first, n = first + 1, n - 1
            free(room, first, n)
    return runs


def encode_pieces(df: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length`` and ``ids`` (little-endian unsigned 32-bit integers) of every document's pieces.

    A document is the ids of its whole text (a null text has none) and the end
    id. Only longer ones than ``capacity`` are cut; the first piece may be
    shorter, the others are full.
    """
    small_batches(df.sparkSession)

    def run(batches):
        enc = worker_encoder(pair_index_encoder, tokenizer)
        for table, ids, offsets in encoded_batches(batches, "text", enc):
            sizes = np.diff(offsets) + 1
            ends = np.cumsum(sizes)
            flat = np.full(int(ends[-1]), end_id, "<u4")
            flat[ranges(ends - sizes, sizes - 1)] = ids
            first = (sizes - 1) % capacity + 1
            n = (sizes - first) // capacity + 1
            doc = np.repeat(np.arange(len(sizes)), n)
            piece = ranges(np.zeros(len(n), np.int64), n)
            start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
            length = np.where(piece == 0, first[doc], capacity)
            yield pa.RecordBatch.from_arrays(
                [
                    table.column("doc_id").combine_chunks().take(pa.array(doc)),
                    pa.array(piece, pa.int32()),
                    pa.array(start),
                    pa.array(length),
                    binary_array(flat, np.r_[0, np.cumsum(length)]),
                ],
                ["doc_id", "piece", "start", "length", "ids"],
            )

    out = T.StructType(
        [df.schema["doc_id"], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())]
    )
    return df.select("doc_id", "text").mapInArrow(run, out)


def best_fit_pack(pieces: DataFrame, keys: list[str], capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``, in place of any columns so called; ``keys`` tell the rows apart (rows that agree in them may swap places).

    ``length`` must be from 1 to ``capacity``. Sequences are filled from offset
    0 without gaps. ``pieces`` is read twice and must not change in between: a
    written table. An empty table stays empty.
    """
    spark: SparkSession = pieces.sparkSession
    kept = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    share, number, base_of, at = (clear_of(c, kept) for c in ("share", "row", "base", "at"))
    run = {c: clear_of(f"run_{c}", kept) for c in ("length", "rank", "n", "sequence", "offset")}
    pieces = pieces.select(*kept)
    shares = max(SHARES, pieces.count() // SHARE_ROWS)
    dealt = pieces.withColumn(share, F.pmod(F.xxhash64(*keys), F.lit(shares)))
    sizes = dealt.groupBy("length", share).agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy(share).rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("length", share, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(base_of))
    counts = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most as many rows as the capacity
    runs = spark.createDataFrame(plan_runs({r["length"]: r["n"] for r in counts}, capacity), ", ".join(f"{c} long" for c in run.values()))
    numbered = dealt.withColumn(number, F.row_number().over(Window.partitionBy("length", share).orderBy(*keys)) - 1)
    ranked = numbered.join(base, ["length", share]).withColumn(at, F.col(number) + F.col(base_of))
    in_run = (F.col("length") == F.col(run["length"])) & (F.col(at) >= F.col(run["rank"])) & (F.col(at) < F.col(run["rank"]) + F.col(run["n"]))
    placed = ranked.join(F.broadcast(runs), in_run)
    return placed.select(*kept, (F.col(run["sequence"]) + F.col(at) - F.col(run["rank"])).alias("sequence_id"), F.col(run["offset"]).alias("offset"))
