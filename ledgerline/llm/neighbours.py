"""Operator 9: approximate nearest neighbours by NN-descent and greedy graph search.

Equal vectors are one node. NN-descent starts from neighbours within random
hyperplane buckets and lets every node introduce its neighbours to each other,
in rounds of joins; the graph keeps each node's best. A query starts from its
own node's neighbours and, in rounds of joins, visits the neighbours of the
best nodes met so far, until none is left to visit: the only bound is ``BEAM``, how many of the best nodes a search keeps. Vectors stay in
blocks of bounded size: what travels is the node numbers to be scored there, to the blocks that hold some. The few vectors that every
search starts from besides travel to the queries. ``exact_neighbours`` scores everything, for measuring what the search finds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary_array, small_batches, written

#: Neighbours of a node, reverse neighbours that also take part in a round, and introductions that each gets from one list.
NEIGHBOURS, REVERSE, INTRODUCED = 32, 16, 8
#: Random hyperplane partitions to start from, nodes of a bucket about. NN-descent ends when a round changes less than this share of all
#: neighbours, in per cent.
TREES, BUCKET, CHANGED = 6, 200, 10
#: Best nodes that a search keeps, nodes that it visits in a round.
BEAM, VISITS = 256, 128
#: Longest vectors, from which every search starts besides: they are near to many.
ENTRIES = 64
#: Vectors of a block about.
BLOCK = 2048


def _fixed(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a binary column whose values all have ``width`` bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _codes(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors as a float scale and a signed byte for each dimension."""
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-30)
    scale = np.maximum(np.abs(unit).max(1, keepdims=True), 1e-30) / 127
    return np.concatenate([scale.astype("<f4").view(np.uint8), np.round(unit / scale).astype(np.int8).view(np.uint8)], 1)


def _decoded(codes: np.ndarray) -> np.ndarray:
    return codes[:, 4:].view(np.int8).astype(np.float32) * np.ascontiguousarray(codes[:, :4]).view("<f4")


def _best(nodes: np.ndarray, ids: np.ndarray, scores: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of ``nodes`` its ``most`` best different ids, best first and ties to the smaller id."""
    order = np.lexsort((-scores, ids, nodes))
    nodes, ids, scores = nodes[order], ids[order], scores[order]
    first = np.r_[True, (nodes[1:] != nodes[:-1]) | (ids[1:] != ids[:-1])] if len(nodes) else np.zeros(0, bool)
    nodes, ids, scores = nodes[first], ids[first], scores[first]
    order = np.lexsort((ids, -scores, nodes))
    nodes, ids, scores = nodes[order], ids[order], scores[order]
    starts = np.flatnonzero(np.r_[True, nodes[1:] != nodes[:-1]]) if len(nodes) else np.zeros(0, np.int64)
    rank = np.arange(len(nodes)) - np.repeat(starts, np.diff(np.r_[starts, len(nodes)]))
    keep = rank < most
    return nodes[keep], ids[keep], scores[keep]


def _lists(nodes: np.ndarray, ids: np.ndarray, scores: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """A row for each of the sorted ``nodes`` with its ids and scores."""
    starts = np.flatnonzero(np.r_[True, nodes[1:] != nodes[:-1]]) if len(nodes) else np.zeros(0, np.int64)
    offsets = pa.array(np.r_[starts, len(nodes)], pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(nodes[starts], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(scores, pa.float32()))], names)


def _pairwise(codes: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each list, the positions of its members and their products with each other."""
    vectors, ends = _decoded(codes), np.cumsum(sizes)
    for a, b in zip((ends - sizes).tolist(), ends.tolist()):
        products = vectors[a:b] @ vectors[a:b].T
        np.fill_diagonal(products, -np.inf)
        yield np.arange(a, b), products


def _start(nodes: DataFrame, n: int, width: int) -> DataFrame:
    """Lists (node, ids, scores) from the buckets of TREES random hyperplane partitions."""
    bits = max(0, math.ceil(math.log2(max(1, n / BUCKET))))
    planes = np.random.default_rng(11).normal(size=(TREES, bits, width - 4)).astype(np.float32)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = _fixed(b.column(1), width)
            vectors = _decoded(codes)
            for t in range(TREES):
                side = ((vectors @ planes[t].T > 0).astype(np.int64) << np.arange(bits)).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(side), t), pa.int32()), pa.array(side), b.column(0), b.column(1)], ["tree", "bucket", "node", "code"])

    dealt = nodes.select("node", "code").mapInArrow(deal, "tree int, bucket long, node long, code binary")
    sizes = dealt.groupBy("tree", "bucket").agg(F.ceil(F.count("*") / (2 * BUCKET)).alias("parts"))  # large buckets are dealt out once more
    split = dealt.join(sizes, ["tree", "bucket"]).withColumn("part", F.pmod(F.xxhash64("node", "tree"), "parts"))
    split = split.repartition("tree", "bucket", "part")  # else the parts of a large bucket stay in the task of their bucket
    lists = split.groupBy("tree", "bucket", "part").agg(F.collect_list(F.struct("node", "code")).alias("members")).select("members")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(0)
            members = column.flatten()
            ids, codes = members.field(0).to_numpy(), _fixed(members.field(1), width)
            sizes = np.diff(column.offsets.to_numpy())
            for at, products in _pairwise(codes, sizes):
                k = min(NEIGHBOURS, len(at) - 1)
                if k < 1:
                    continue
                top = np.argpartition(-products, k - 1, 1)[:, :k]
                yield _lists(np.repeat(ids[at], k), ids[at][top].ravel(), np.take_along_axis(products, top, 1).ravel(), ["node", "ids", "scores"])

    return lists.mapInArrow(meet, "node long, ids array<long>, scores array<float>")


def _merged(lists: DataFrame) -> DataFrame:
    """The NEIGHBOURS best of all lists of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, scores = b.column(1).flatten(), b.column(2).flatten()
            sizes = np.diff(ids.offsets.to_numpy())
            per = np.repeat(b.column(0).to_numpy(), np.diff(b.column(1).offsets.to_numpy()))
            yield _lists(*_best(np.repeat(per, sizes), ids.flatten().to_numpy(), scores.flatten().to_numpy(), NEIGHBOURS), ["node", "ids", "scores"])

    grouped = lists.groupBy("node").agg(F.collect_list("ids").alias("i"), F.collect_list("scores").alias("s"))
    return grouped.mapInArrow(run, "node long, ids array<long>, scores array<float>")


def _introduced(graph: DataFrame, nodes: DataFrame, turn: int, width: int) -> DataFrame:
    """Lists of better neighbours, from every node's neighbours met through it."""
    ahead = graph.select(F.col("node").alias("host"), F.explode("ids").alias("node"))
    order = Window.partitionBy("host").orderBy(F.xxhash64("node", F.lit(turn)), "node")
    behind = ahead.select(F.col("node").alias("host"), F.col("host").alias("node")).withColumn("k", F.row_number().over(order)).where(F.col("k") <= REVERSE).drop("k")
    guests = ahead.union(behind).distinct()
    known = nodes.join(graph, "node").select("node", "code", F.when(F.size("ids") < NEIGHBOURS, F.lit(-2.0)).otherwise(F.array_min("scores")).cast("float").alias("worst"))
    lists = guests.join(known, "node").groupBy("host").agg(F.collect_list(F.struct("node", "worst", "code")).alias("members")).select("members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(0)
            members = column.flatten()
            ids, worst, codes = members.field(0).to_numpy(), members.field(1).to_numpy(), _fixed(members.field(2), width)
            found = []
            for at, products in _pairwise(codes, np.diff(column.offsets.to_numpy())):
                k = min(INTRODUCED, len(at) - 1)
                if k < 1:
                    continue
                top = np.argpartition(-products, k - 1, 1)[:, :k]
                scores = np.take_along_axis(products, top, 1)
                r, c = np.nonzero(scores > worst[at][:, None])
                found.append((ids[at][r], ids[at][top[r, c]], scores[r, c]))
            if found:
                yield _lists(*_best(*(np.concatenate(x) for x in zip(*found)), NEIGHBOURS), ["node", "ids", "scores"])

    return lists.mapInArrow(run, "node long, ids array<long>, scores array<float>")


def neighbour_graph(nodes: DataFrame, n: int, width: int) -> DataFrame:
    """``node``, ``ids`` and ``scores`` of the NEIGHBOURS nearest nodes found; ``nodes`` has ``node`` and ``code``."""
    graph, turn = written(_merged(_start(nodes, n, width)), "graph"), 0
    while True:
        better = written(_merged(graph.union(_introduced(graph, nodes, turn, width))), "graph")
        changed = better.join(graph.select("node", F.col("ids").alias("old")), "node").agg(F.sum(F.size(F.array_except("ids", "old")))).first()[0] or 0
        graph, turn = better, turn + 1
        if changed * 100 <= CHANGED * n * NEIGHBOURS:
            return graph


def _scored(asked: DataFrame, blocks: DataFrame, row: np.dtype) -> DataFrame:
    """``query``, ``ids``, ``scores``: the products of each query with the nodes asked for, worked out where the nodes lie.

    ``row`` is the type of a whole vector.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            ids = right.column("node").to_numpy()
            order = np.argsort(ids)
            vectors = _fixed(right.column("vector").combine_chunks(), row.itemsize).view(row.base)[order].astype(np.float64)
            ids = ids[order]
            queries = _fixed(left.column("vector").combine_chunks(), row.itemsize).view(row.base).astype(np.float64)
            for q, vector, want in zip(left.column("query").to_pylist(), queries, left.column("ids")):
                want = want.values.to_numpy()
                at = np.searchsorted(ids, want)
                scores = vectors[at] @ vector
                if len(scores) > BEAM:
                    top = np.lexsort((want, -scores))[:BEAM]  # ties at the cut to the smaller id
                    want, scores = want[top], scores[top]
                found.append({"query": q, "ids": want.tolist(), "scores": scores.tolist()})
        return pa.Table.from_pylist(found, pa.schema([("query", pa.int64()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))]))

    return asked.groupBy("block").cogroup(blocks.groupBy("block")).applyInArrow(run, "query long, ids array<long>, scores array<double>")


def _entered(queries: DataFrame, row: np.dtype, entries: list[int], vectors: np.ndarray) -> DataFrame:
    """Pools that hold the ``entries``, scored where the queries are; ``vectors`` are theirs, ENTRIES at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mine = _fixed(b.column(1), row.itemsize).view(row.base).astype(np.float64)
            scores = [[float(entry @ q) for entry in vectors] for q in mine]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([entries] * b.num_rows, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.float64()))], ["query", "ids", "scores"])

    return queries.select("query", "vector").mapInArrow(run, "query long, ids array<long>, scores array<double>").withColumn("visited", F.array().cast("array<long>"))


def graph_search(queries: DataFrame, graph: DataFrame, blocks: DataFrame, row: np.dtype, entries: list[int], vectors: np.ndarray, parts: int) -> DataFrame:
    """``query``, ``ids`` and ``scores`` of the BEAM best nodes that a greedy search meets.

    ``queries`` has ``query``, ``node`` (where it starts) and ``vector``; ``blocks`` has ``node``, ``block`` (one of ``parts``) and
    ``vector``. Every search also starts from the few ``entries``. A query's own node is among the results. A search ends when all nodes
    that it keeps are visited; each round visits some, and only queries that still have some take part in the next.
    """
    start = queries.join(graph, "node", "left").select("query", F.coalesce(F.array_append("ids", F.col("node")), F.array("node")).alias("new"))
    pools = written(_entered(queries, row, entries, vectors), "pools")
    homes = queries.select("query", "vector")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for query, vector, new, known in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                ids = np.setdiff1d(new.values.to_numpy(), known.values.to_numpy())
                where = ids_block(ids, parts)
                order = np.argsort(where, kind="stable")
                ids, where = ids[order], where[order]
                starts = np.flatnonzero(np.r_[True, where[1:] != where[:-1]]) if len(ids) else np.zeros(0, np.int64)
                if len(starts):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(where[starts]), pa.array([query] * len(starts), pa.int64()), pa.array([vector] * len(starts), pa.binary()), pa.ListArray.from_arrays(pa.array(np.r_[starts, len(ids)], pa.int32()), pa.array(ids))],
                        ["block", "query", "vector", "ids"],
                    )

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for query, old, was, visited, ids, scores in zip(*(b.column(k).to_pylist() for k in range(6))):
                i = np.array(old + [x for part in ids or [] for x in part], np.int64)
                s = np.array(was + [x for part in scores or [] for x in part], np.float64)
                _, i, s = _best(np.zeros(len(i), np.int64), i, s, BEAM)
                rest = i[~np.isin(i, np.array(visited, np.int64))][:VISITS].tolist()
                rows.append({"query": query, "ids": i.tolist(), "scores": s.tolist(), "visited": visited + rest, "visit": rest})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("query", pa.int64()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64())), ("visited", pa.list_(pa.int64())), ("visit", pa.list_(pa.int64()))]))

    while True:
        asked = start.join(homes, "query").join(pools, "query").select("query", "vector", "new", F.concat("ids", "visited").alias("known"))
        asked = written(asked.mapInArrow(deal, "block long, query long, vector binary, ids array<long>"), "asked")
        answers = _scored(asked, blocks.join(asked.select("block").distinct(), "block", "left_semi"), row)
        answers = answers.groupBy("query").agg(F.collect_list("ids").alias("i"), F.collect_list("scores").alias("s"))
        pools = pools.join(answers, "query", "left").select("query", "ids", "scores", "visited", "i", "s").mapInArrow(take, "query long, ids array<long>, scores array<double>, visited array<long>, visit array<long>")
        pools = written(pools, "pools")
        visits = pools.where(F.size("visit") > 0)
        if visits.isEmpty():
            return pools.select("query", "ids", "scores")
        steps = visits.select("query", F.explode("visit").alias("node")).join(graph.select("node", "ids"), "node")
        start = steps.groupBy("query").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("new"))


def ids_block(ids: np.ndarray, parts: int) -> np.ndarray:
    """The block of each node; the same rule places the vectors."""
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % max(1, parts)


def nearest_neighbours(df: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the ``k`` nearest rows found for each query, by inner product.

    Queries are the rows whose vec_id is divisible by ``every``; candidates all
    rows but the query's own. Components count as they are, single or double. Null, empty or zero vectors, those with null or
    non-finite components, those of another length than the most frequent one
    and null vec_ids take no part. Rows with equal vectors are all candidates;
    of rows that share a vec_id, those with the smallest vector take part. Other
    columns are left out.
    """
    spark: SparkSession = df.sparkSession
    small_batches(spark)
    given = df.schema["embedding"].dataType
    single = isinstance(given, T.ArrayType) and isinstance(given.elementType, T.FloatType)
    v = F.col("embedding").cast("array<float>" if single else "array<double>")
    finite = ~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select("vec_id", v.alias("e")).where(F.col("vec_id").isNotNull() & F.col("e").isNotNull()).where(finite & F.exists("e", lambda x: x != 0))
    rows = rows.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min("e").alias("e"))
    rows = written(rows.withColumn("h", F.xxhash64("e")).withColumn("g", F.xxhash64(F.lit(1), F.col("e"))), "vector-rows")  # equal vectors have equal pairs of hashes
    usual = rows.groupBy(F.size("e").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    if not usual:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = usual[0]["n"]
    rows = rows.where(F.size("e") == dims)
    first = written(rows.groupBy("h", "g").agg(F.min(F.struct("vec_id", "e")).alias("f")).select("h", "g", "f.*"), "vector-classes")
    norm = F.aggregate("e", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    n, longest = first.agg(F.count("*"), F.max(norm)).first()
    parts = max(1, -(-n // BLOCK))
    row = np.dtype(("<f4" if single else "<f8", (dims,)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            vectors = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            lift = np.sqrt(np.maximum(0, longest - (vectors.astype(np.float64) ** 2).sum(1)))  # so that the nearest have the largest product
            codes = _codes(np.concatenate([vectors, lift[:, None]], 1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(ids_block(ids, parts)), binary_array(np.ascontiguousarray(vectors, row.base).ravel(), np.arange(len(vectors) + 1) * dims), pa.array([x.tobytes() for x in codes], pa.binary())],
                ["node", "block", "vector", "code"],
            )

    nodes = written(first.select("vec_id", "e").mapInArrow(encode, "node long, block long, vector binary, code binary"), "vectors")
    graph = neighbour_graph(nodes, n, dims + 5)
    named = first.select("h", "g", F.col("vec_id").alias("node"))

    def as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(row.base)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), binary_array(vectors, np.arange(b.num_rows + 1) * dims)], ["query", "node", "vector"])

    own = rows.where(F.col("vec_id") % every == 0).join(named, ["h", "g"]).select("vec_id", "node", "e")
    queries = written(own.mapInArrow(as_bytes, "query long, node long, vector binary"), "queries")
    longest_rows = first.orderBy(F.desc(norm), "vec_id").limit(ENTRIES).select("vec_id", "e").collect()
    entries, vectors = [r.vec_id for r in longest_rows], np.array([r.e for r in longest_rows], row.base).astype(np.float64)
    found = graph_search(queries, graph, nodes.select("node", "block", "vector"), row, entries, vectors, parts)
    near = found.select(F.col("query").alias("query_id"), F.posexplode(F.slice(F.arrays_zip("ids", "scores"), 1, k + 1)).alias("at", "hit")).select("query_id", F.col("hit.ids").alias("node"), F.col("hit.scores").alias("score"))
    copies = rows.select("h", "g", "vec_id").withColumn("place", F.row_number().over(Window.partitionBy("h", "g").orderBy("vec_id")))
    members = copies.where(F.col("place") <= k + 1).join(named, ["h", "g"]).select("node", "vec_id")  # enough copies of each vector for any result
    hits = near.join(members, "node").where(F.col("vec_id") != F.col("query_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.select("query_id", F.row_number().over(order).cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def exact_neighbours(df: DataFrame, every: int = 20, k: int = 20, block: int = 256) -> DataFrame:
    """As ``nearest_neighbours``, by scoring every row for every query: ``block`` queries at a time go to all rows, and each task keeps their
    ``k`` best. For measuring; its work grows with the square of the table. All vectors must be of one length, finite and not zero, with different ids.
    """
    spark = df.sparkSession
    rows = written(df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")), "exact-rows")
    found = None
    queries = rows.where(F.col("vec_id") % every == 0)
    for turn in range(-(-queries.count() // block)):
        some = queries.orderBy("vec_id").offset(turn * block).limit(block).collect()
        ids, vectors = np.array([r.vec_id for r in some]), np.array([r.e for r in some])

        def best(batches: Iterator[pa.RecordBatch], ids=ids, vectors=vectors) -> Iterator[pa.RecordBatch]:
            held = [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
            for b in batches:
                near = b.column(0).to_numpy()
                scores = np.einsum("qd,nd->qn", vectors, b.column(1).flatten().to_numpy().reshape(len(near), -1))
                q, n = np.nonzero(ids[:, None] != near[None, :])
                held = list(_best(*(np.concatenate([a, x]) for a, x in zip(held, (ids[q], near[n], scores[q, n]))), k))
            yield pa.RecordBatch.from_arrays(list(map(pa.array, held)), ["query_id", "vec_id", "score"])

        part = rows.mapInArrow(best, "query_id long, vec_id long, score double")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        part = written(part.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k), "exact-found")
        found = part if found is None else found.unionByName(part)
    return (spark.createDataFrame([], "query_id long, vec_id long, score double, rank int") if found is None else found).select("query_id", "rank", "vec_id", "score")
