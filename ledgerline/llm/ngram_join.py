"""Operator 1: n-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its word shingles, as 64-bit hashes. All documents
order their shingles alike: those that are frequent over all documents come
last, others go by hash. Two sets that are similar enough share a shingle among
the first few of each (the prefix), and share ``l`` of them if each prefix is
longer by ``l - 1``. A document whose prefix holds frequent shingles would meet
many candidates, so its prefix is lengthened with that estimated cost, and a
pair needs as many shared prefix shingles as the shorter lengthening asks for.

Documents with equal sets are one node. Nodes that share a prefix shingle are
first compared with one leader of each shingle only; nodes known to be
connected are not compared again. What is left meets in shingles of few nodes, a
bounded number of pairs for each posting. Of nodes that meet in crowded ones, shingles are counted over the
whole sets. Once more each of them is compared with leaders, now those that have the least of
their own. Then pairs that share a rare shingle meet in it; other pairs have only common shingles to share, and meet if their
sizes allow it with so many. So members of a large group that differ from it by words of
their own are never paired with each other, and no similar pair is left out.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, gathered, list_array, small_batches, worker_memory, written
from .components import components

#: A shingle is frequent above so many documents; of frequent ones, so many at most are known to every task (16 bytes each).
FREQUENT, MOST_FREQUENT = 16, 1 << 21
#: Expected candidates for which a prefix is lengthened by one (an unknown shingle counts as one), and the share of
#: a prefix that the lengthening is at most.
COST_UNIT, MOST_LENGTHENED = 8, 3
#: In rounds with leaders, so many of the shorter prefix's shingles must name the leader; the last round has no such rule.
LEADER_SHARE = 4
#: Rounds with leaders before shingles are counted over the whole sets of what is left.
LEADER_ROUNDS = 2
#: A shingle that no more nodes hold is rare: all pairs of these are met. A shingle of more is crowded.
RARE = 16
#: Sizes of sets that differ by less than about this share meet in the same key of the last join.
BAND = 0.02
#: Longs of a parity map: a bit tells whether an odd number of a set's shingles fall on it, so two sets differ in as
#: many shingles at least as their maps do in bits.
PARITY = 8
#: Bits of the map that tells which documents are to be compared.
MAP_BITS = 27
#: Ids of 8 bytes up to which they are broadcast.
BROADCAST_ROWS = 1 << 20
MAX_WORDS = 400_000
_PARITIES = [f"parity{i}" for i in range(PARITY)]
_K = np.uint64(0x9E3779B97F4A7C15)


class _Words:
    """Hashes of words, remembered by a worker."""

    def __init__(self):
        self.index: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.hashes = np.zeros(0, np.uint64)

    def hash(self, words: list[bytes]) -> np.ndarray:
        if len(self.index) > MAX_WORDS:
            self.__init__()
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if known := len(self.index) - len(self.hashes):
            fresh = list(self.index)[-known:]
            self.hashes = np.concatenate([self.hashes, np.fromiter(map(xxhash.xxh3_64_intdigest, fresh), np.uint64, known)])
        return self.hashes[at]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Each text's distinct ``n``-word shingles, ascending; of fewer words, the sequence as one; of none, nothing."""
    words, sizes = [], []
    for text in texts:
        own = text.encode().lower().split() if text else []
        words += own
        sizes.append(len(own))
    h = worker_memory((__name__, "words"), _Words).hash(words)
    rolled = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n):
        rolled = rolled * _K + h[k : k + len(rolled)]
    rolled = _mixed(rolled)
    out, at = [], 0
    for size in sizes:
        if size >= n:
            out.append(np.unique(rolled[at : at + size - n + 1]))
        elif size:
            x = np.array([size], np.uint64)
            for k in range(at, at + size):
                x = x * _K + h[k : k + 1]
            out.append(_mixed(x))
        else:
            out.append(np.zeros(0, np.uint64))
        at += size
    return out


def prefix_length(size: int, percent: int) -> int:
    """How many shingles of a set of ``size`` may be missing from a similar one, and one more."""
    return size - -(-percent * size // 100) + 1


def _node(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).view(np.int64))


def _frequent(docs: DataFrame, n: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles, ascending, and how many documents have each among the first of its own by hash.

    All documents are counted. Only shingles that could stand in a prefix are:
    twice a prefix of each document, by hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, "text"):
            sets = shingle_sets(table.column("text").to_pylist(), n)
            reach = [s[: 2 * prefix_length(len(s), percent)] for s in sets if len(s)]
            found, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *reach]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(times)], ["shingle", "n"])

    counts = docs.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") > FREQUENT)
    counts = written(counts, "frequent-shingles")
    if counts.count() > MOST_FREQUENT:
        counts = counts.orderBy(F.desc("n"), "shingle").limit(MOST_FREQUENT)
    rows = counts.toPandas()  # MOST_FREQUENT rows at most
    order = np.argsort(rows["shingle"].to_numpy(np.int64).view(np.uint64))
    return rows["shingle"].to_numpy(np.int64).view(np.uint64)[order], rows["n"].to_numpy(np.int64)[order]


def _prefixes(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``node``, ``matches`` and ``prefix`` of every document; node is null for an empty set."""
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(docs, n, percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, times = frequent.value
        for table in gathered(batches, "text"):
            sets = shingle_sets(table.column("text").to_pylist(), n)
            nodes, matches, prefixes, parity = [], [], [], np.zeros((len(sets), 64 * PARITY), np.uint8)
            for i, s in enumerate(sets):
                parity[i] = np.bincount((s % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
                if not len(s):
                    nodes.append(None)
                    matches.append(1)
                    prefixes.append(s)
                    continue
                nodes.append(_node(s))
                at = np.searchsorted(known, s)
                at[at == len(known)] = 0
                hot = known[at] == s if len(known) else np.zeros(len(s), bool)
                cost = np.where(hot, times[at], 1) if len(known) else np.ones(len(s), np.int64)
                order = np.argsort(hot, kind="stable")  # by hash within each
                short = prefix_length(len(s), percent)
                spent = int(cost[order[:short]].sum())
                m = min(1 + spent // COST_UNIT, 1 + short // MOST_LENGTHENED, -(-percent * len(s) // 100))
                matches.append(m)
                prefixes.append(s[order[: short + m - 1]])
            offsets = np.r_[0, np.cumsum([len(p) for p in prefixes])]
            flat = np.concatenate([np.zeros(0, np.uint64), *prefixes]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [table.column("doc_id").combine_chunks(), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()), pa.array(matches, pa.int32()), list_array(flat, offsets, pa.int64()), *(pa.array(c) for c in np.packbits(parity, axis=1).view(np.int64).T)],
                ["doc_id", "n_shingles", "node", "matches", "prefix", *_PARITIES],
            )

    out = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("n_shingles long, node long, matches int, prefix array<long>").fields, *(T.StructField(c, T.LongType()) for c in _PARITIES)])
    return docs.select("doc_id", "text").mapInArrow(run, out)


def _id_map(ids: DataFrame) -> np.ndarray:
    """A map of 2 ** MAP_BITS bits in which the hash of every id in ``ids`` is set; its size is fixed."""

    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << MAP_BITS))
    words = ids.select(h.alias("h")).select(F.expr("h div 32").alias("word"), F.expr("shiftleft(1L, cast(h % 32 as int))").alias("bit"))
    pages = words.groupBy("word").agg(F.bit_or("bit").alias("bits"))
    rows = pages.toPandas()  # a row for each word that isn't zero, of a map of fixed size
    bits = np.zeros((1 << MAP_BITS) // 32, np.uint32)
    bits[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).astype(np.uint32)
    return bits


def _sets_of(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """``node`` and ``shingles`` (bytes of sorted 64-bit hashes) of the documents in ``ids`` (``doc_id``, one for each node).

    Few ids, as counted, are broadcast. Of more, a bit map of fixed size picks
    the documents before their texts are split in Python; what it lets through
    by chance goes in the join with the nodes.
    """
    ids = written(ids, "compared")
    if ids.count() <= BROADCAST_ROWS:
        docs = docs.join(F.broadcast(ids), "doc_id", "left_semi")
    bits = docs.sparkSession.sparkContext.broadcast(_id_map(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bits.value
        for b in batches:
            h = b.column(0).to_numpy()
            keep = pa.array((held[h >> 5] >> (h & 31).astype(np.uint32)) & 1 == 1)
            texts = b.column(1).filter(keep).to_pylist()
            if texts:
                sets = [s for s in shingle_sets(texts, n) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "shingles"])

    return docs.where(F.col("doc_id").isNotNull()).select(F.pmod(F.xxhash64("doc_id"), F.lit(1 << MAP_BITS)).alias("h"), "text").mapInArrow(run, "node long, shingles binary")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (``a``, ``b``) that are similar enough, by their whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(both) - shared))
            yield pa.RecordBatch.from_arrays([b.column(k).filter(pa.array(keep)) for k in (0, 1)], ["a", "b"])

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _alike(percent: int):
    """Whether a pair that meets in a shingle can be similar enough, by what stands before and after it in each set.

    Both prefixes hold all that their sets have before the shingle, so of that
    only shingles that other prefixes hold too (``met``) can be in both sets. What
    comes after may be in both, whether or not it is in a prefix.
    """
    most = F.least("met_a", "met_b") + F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    return 100 * most >= percent * (F.col("n_a") + F.col("n_b") - most)


def _sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    names = [c for c in rows.columns if c != "shingle"]
    return tuple(rows.select("shingle", *(F.col(c).alias(f"{c}_{s}") for c in names)) for s in "ab")


def _led(postings: DataFrame, first: Column, shift: float, percent: int) -> DataFrame:
    """Pairs (``a``, ``b``) of each node with the leaders of its shingles, if several shingles name the same.

    Sets of one shingle and about one size have a leader, the one with the least ``first``; ``shift`` moves the steps of size.
    """
    step = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent) + shift) if percent < 100 else F.col("n")
    names = ("node", "n", "label", "reach", "at", "met")
    sized = postings.withColumn("step", step)
    leader = F.min_by(F.struct(*names), F.struct(first, "node")).alias("f")
    led = sized.groupBy("shingle", "step").agg(leader, F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    left = sized.select("shingle", "step", *(F.col(c).alias(f"{c}_a") for c in names))
    met = left.join(led.select("shingle", "step", *(F.col(f"f.{c}").alias(f"{c}_b") for c in names)), ["shingle", "step"])
    met = met.where((F.col("label_a") != F.col("label_b")) & _alike(percent))
    least = (F.least("reach_a", "reach_b") / LEADER_SHARE).alias("least")
    return met.groupBy(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"), least).agg(F.count("*").alias("shared")).where("shared >= least").select("a", "b").distinct()


def _open_postings(postings: DataFrame) -> DataFrame:
    """Postings of the shingles whose nodes aren't all known to be connected, with ``held``, how many nodes have the shingle."""
    mixed = postings.groupBy("shingle").agg(F.count("*").alias("held"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("shingle", "held")
    return postings.join(mixed, "shingle")


def _near(percent: int) -> Column:
    """Whether parity maps differ in no more bits than similar sets in shingles."""
    apart = sum(F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in _PARITIES)
    return (100 + percent) * apart <= (100 - percent) * (F.col("n_a") + F.col("n_b"))


def _met_in_few(rows: DataFrame, crowded: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (``a``, ``b``) that meet in prefix shingles of RARE nodes at most, which is a bounded number for each posting.

    They need as many shared prefix shingles as the shorter lengthening asks for,
    with all that both might share of the ``crowded`` ones (``node``, ``crowd``).
    """
    rows = rows.join(crowded, "node", "left").withColumn("crowd", F.coalesce("crowd", F.lit(0))).join(nodes.select("node", *_PARITIES), "node")
    left, right = _sides(rows)
    met = left.join(right, "shingle").where((F.col("node_a") < F.col("node_b")) & (F.col("label_a") != F.col("label_b")) & _alike(percent) & _near(percent))
    needs = F.first(F.least("matches_a", "matches_b") - F.least("crowd_a", "crowd_b")).alias("needs")
    return met.groupBy(F.col("node_a").alias("a"), F.col("node_b").alias("b")).agg(F.count("*").alias("shared"), needs).where("shared >= needs").select("a", "b")


def _exploded(sets: DataFrame) -> DataFrame:
    """``node`` and ``shingle``, a row for each shingle of whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = b.column(1).to_pylist()
            flat = np.frombuffer(b"".join(held), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), [len(x) // 8 for x in held])), pa.array(flat)], ["node", "shingle"])

    return sets.select("node", "shingles").mapInArrow(run, "node long, shingle long")


def _rare_pairs(shared: DataFrame, percent: int) -> DataFrame:
    """Pairs (``a``, ``b``) that share rare shingles and can be similar enough with these and all their common ones.

    ``shared`` has a row for each node of each rare shingle, of which none has more than RARE.
    """
    left, right = _sides(shared)
    sized = percent * F.greatest("n_a", "n_b") <= 100 * F.least("n_a", "n_b")
    met = left.join(right, "shingle").where((F.col("node_a") < F.col("node_b")) & (F.col("label_a") != F.col("label_b")) & sized)
    most = (F.count("*") + F.first(F.least("core_a", "core_b"))).alias("most")
    pairs = met.groupBy(F.col("node_a").alias("a"), F.col("node_b").alias("b")).agg(most, F.first(F.col("n_a") + F.col("n_b")).alias("n"))
    return pairs.where(100 * F.col("most") >= percent * (F.col("n") - F.col("most"))).select("a", "b")


def _band(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / math.log(1 + BAND)).cast("int")


def _core_pairs(rows: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (``a``, ``b``) without a rare shingle in common: what they share lies in the smaller of their cores.

    So a node's core bounds the sizes of the sets that it can be similar to. A pair
    meets in a shingle and a band of each side's size, if either size is within the other's bounds,
    and not at all where a shingle and bands hold connected nodes alone. It needs as many shared prefix shingles as
    the shorter lengthening asks for; parity maps may differ in no more bits than similar sets in shingles.
    """
    rows = rows.withColumn("most", F.expr(f"(({100 + percent} * core) div {percent}) - n")).join(nodes.select("node", *_PARITIES), "node")
    least = -F.floor(-percent * F.col("n") / 100)
    left, right = _sides(rows.withColumn("band", _band(F.col("n"))).withColumn("least", least))
    left = left.where("most_a >= n_a").withColumn("band_b", F.explode(F.sequence("band_a", _band(F.col("most_a")))))
    right = right.where("least(most_b, n_b) >= least_b").withColumn("band_a", F.explode(F.sequence(_band(F.col("least_b")), _band(F.least("most_b", "n_b")))))
    keys = ["shingle", "band_a", "band_b"]
    mixed = left.select(*keys, F.col("label_a").alias("label")).union(right.select(*keys, F.col("label_b").alias("label")))
    mixed = mixed.groupBy(*keys).agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select(*keys)
    order = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("node_a") < F.col("node_b")))
    within = (F.col("n_b") <= F.col("most_a")) & (F.col("n_a") <= F.col("most_b"))
    met = left.join(mixed, keys).join(right, keys).where(order & (F.col("label_a") != F.col("label_b")) & within & _alike(percent) & _near(percent))
    needs = F.least("matches_a", "matches_b").alias("needs")
    return met.groupBy(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"), needs).agg(F.count("*").alias("shared")).where("shared >= needs").select("a", "b")


def _open_shingles(nodes: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Shingles that several of ``nodes`` hold in their whole sets, by node, with the number ``df`` of these; and the nodes with ``core``, how many of theirs aren't rare."""
    whole = written(_exploded(sets.join(nodes.select("node"), "node", "left_semi").dropDuplicates(["node"])), "open-shingles")
    held = whole.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    shared = written(whole.join(written(held, "open-counts"), "shingle"), "shared-open-shingles")
    discard(whole)
    cores = shared.where(F.col("df") > RARE).groupBy("node").agg(F.count("*").alias("core"))
    return shared, written(nodes.join(cores, "node", "left").withColumn("core", F.coalesce("core", F.lit(0))), "open-nodes")


def _rest(rows: DataFrame, shared: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """All pairs not known to be connected that can be similar enough and meet in crowded shingles alone.

    Both sides of such a pair are among ``rows``, the open postings of crowded shingles. A pair
    either shares a shingle that is rare among their whole sets, and then meets in
    it, or has only the rest in common, its core, and then must meet in a prefix
    shingle that isn't rare.
    """
    ends = rows.groupBy("node").agg(*(F.first(c).alias(c) for c in ("n", "label", "core")))
    by_rare = written(_rare_pairs(shared.where(F.col("df") <= RARE).select("node", "shingle").join(ends, "node"), percent), "rare-pairs")
    common = shared.where(F.col("df") > RARE).select("shingle").distinct()
    alive = rows.where(100 * F.col("core") >= percent * F.col("n"))
    by_core = written(_core_pairs(alive.join(common, "shingle", "left_semi"), nodes, percent), "core-pairs")
    return by_rare.union(by_core).distinct()


def ngram_join(df: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` (the smallest doc_id that links reach) of every row.

    Documents link when 100 * intersection >= ``percent`` * union of their
    shingle sets. Null and empty texts have no shingles and link with nothing;
    equal sets of one shingle or more link. Rows that share a doc_id are one
    document that links by any of its texts, and a row of it without shingles
    still links with nothing; a null doc_id takes no part and has no component. Columns besides doc_id and text are left out.
    """
    spark: SparkSession = df.sparkSession
    small_batches(spark)
    docs = df.select("doc_id", "text")
    all_docs = written(_prefixes(docs, n, percent), "prefixes")
    members = all_docs.where(F.col("doc_id").isNotNull() & F.col("node").isNotNull())
    nodes = written(members.groupBy("node").agg(F.min("doc_id").alias("first"), *(F.first(c).alias(c) for c in _PARITIES)), "nodes")
    firsts = members.join(nodes.select("node", F.col("first").alias("doc_id")), ["node", "doc_id"]).dropDuplicates(["node"])  # of equal sets, one row
    rows = firsts.select("node", F.col("n_shingles").alias("n"), "matches", F.size("prefix").alias("reach"), F.posexplode("prefix").alias("at", "shingle"))
    df_of = Window.partitionBy("shingle")
    shared = written(rows.withColumn("df", F.count("*").over(df_of)).where("df > 1"), "shared-shingles")
    of_node = Window.partitionBy("node")
    fame = F.sum("df").over(of_node) / F.col("reach")  # nodes in whose middle others lie have the most frequent shingles
    postings = written(shared.withColumn("fame", fame).withColumn("met", F.dense_rank().over(of_node.orderBy("at")) - 1).drop("df"), "postings")
    discard(shared)

    own = members.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("doc_id", "a")
    several = written(members.select("doc_id", "node").distinct().join(own, "doc_id").where("a < node").select("a", F.col("node").alias("b")), "nodes-of-one-id")
    links = labels = sets = None
    if not several.isEmpty():  # texts under one doc_id are one document
        links, labels = several, components(several)

    def labelled(rows: DataFrame) -> DataFrame:
        if labels is None:
            return rows.withColumn("label", F.col("node"))
        return rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))

    def fetch(ends: DataFrame) -> None:
        """Adds the sets of the nodes ``ends`` to those at hand."""
        nonlocal sets
        if sets is not None:
            ends = ends.join(sets.select("node"), "node", "left_anti")
        fresh = written(_sets_of(docs, nodes.join(ends, "node").select(F.col("first").alias("doc_id")), n), "shingle-sets")
        sets = fresh if sets is None else sets.union(fresh)

    def compare(pairs: DataFrame, rounds: int | None) -> None:
        """Adds the similar ones of ``pairs`` to the links and labels anew."""
        nonlocal links, labels
        pairs = written(pairs, "pairs")
        fetch(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct())
        found = written(_verified(pairs, sets, percent), "similar")
        discard(pairs)
        links = found if links is None else links.union(found)
        labels = components(links, rounds)

    for k in range(LEADER_ROUNDS):
        first = -F.col("fame") if k == 0 else F.xxhash64("node", F.lit(k)).cast("double")
        compare(_led(labelled(postings), first, k / 2, percent), 3)
    left = written(_open_postings(labelled(postings)).drop("label", "fame"), "open-postings")
    discard(postings)
    dense = left.where(F.col("held") > RARE).drop("held")
    crowded = written(dense.groupBy("node").agg(F.count("*").alias("crowd")), "crowded")
    fetch(crowded.select("node"))
    shared_by, ends = _open_shingles(crowded.select("node"), sets)
    dense = written(dense.join(ends, "node"), "crowded-postings")
    compare(_led(labelled(dense), -F.col("core") / F.col("n"), 0.0, percent), 3)  # leaders with the least of their own
    few = written(_met_in_few(labelled(left.where(F.col("held") <= RARE).drop("held")), crowded, nodes, percent), "met-in-few")
    still_open = written(_open_postings(labelled(dense)).drop("held"), "crowded-open")
    discard(left, dense)
    compare(few.union(_rest(still_open, shared_by, nodes, percent)).distinct(), None)
    discard(still_open, shared_by, sets)
    named = nodes.select("node", "first").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = named.groupBy("label").agg(F.min("first").alias("component_id"))
    classes = named.join(smallest, "label").select("node", "component_id")
    joined = all_docs.select("doc_id", "n_shingles", "node").join(classes, "node", "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
