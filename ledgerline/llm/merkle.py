"""Operator 12: a manifest of hash trees over a table, one tree for each group of rows and one over their roots.

A node is 64 hex digits. Sixteen neighbours, concatenated, hash to their
parent; the last run of a level may be shorter. An aligned block of 256
neighbours is one row of the frame: it keeps its two levels as two strings of
hex digits, so that a parent is the hash of a substring of fixed width and the
siblings of a node are the substrings on both sides of it. The tops of the
blocks are the nodes of the next round, until one is left. Then the siblings
go back down, from round to round: a row for each block, not for each leaf.

A group of any size is many blocks: rows are numbered by ranges of (group,
order), never in one task, and at most 256 of them ever meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.ordering import range_number

from .common import written

#: Children of a node, hex digits of one, nodes of a block (two levels of children).
FAN, HEX = 16, 64
BLOCK = FAN * FAN


def leaf_hash(*columns: Column | str) -> Column:
    """Hash of the columns' values: each its length in bytes, ``:`` and the value as text, ``-`` where null."""
    spelled = []
    for c in columns:
        text = (F.col(c) if isinstance(c, str) else c).cast("string")
        spelled.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*spelled), 256)


def _parents(level: Column) -> Column:
    runs = F.sequence(F.lit(0), F.floor((F.octet_length(level) - 1) / (FAN * HEX)).cast("int"))
    return F.array_join(F.transform(runs, lambda i: F.sha2(F.substr(level, i * (FAN * HEX) + 1, F.lit(FAN * HEX)), 256)), "")


def _beside(level: Column, at: Column) -> Column:
    """What stands left and right of node ``at`` in its run."""
    start, own = F.floor(at / FAN).cast("int") * (FAN * HEX), at * HEX
    return F.struct(F.substr(level, start + 1, own - start).alias("left"), F.substr(level, own + HEX + 1, start + (FAN * HEX) - own - HEX).alias("right"))


def _steps(at: Column) -> Column:
    """Siblings of node ``at`` of a block, up to the block's top."""
    first, second = _beside(F.col("level0"), at), _beside(F.col("level1"), F.floor(at / FAN).cast("int"))
    return F.when(F.col("n") <= 1, F.slice(F.array(first), 1, 0)).when(F.col("n") <= FAN, F.array(first)).otherwise(F.array(first, second))


def _blocks(nodes: DataFrame, keep: list[str]) -> DataFrame:
    """Blocks of nodes (tree, at, n, node): their nodes in order with what is kept, both levels and the top."""
    rows = nodes.groupBy("tree", F.expr(f"at div {BLOCK}").alias("block"), "n").agg(F.array_sort(F.collect_list(F.struct("at", "node", *keep))).alias("nodes"))
    rows = rows.withColumn("level0", F.array_join("nodes.node", "")).withColumn("level1", F.when(F.col("n") > 1, _parents(F.col("level0"))))
    top = F.when(F.col("n") <= 1, F.col("level0")).when(F.col("n") <= FAN, F.col("level1")).otherwise(_parents(F.col("level1")))
    return written(rows.withColumn("top", top), "merkle-blocks")


def _grown(nodes: DataFrame, keep: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of every round, and (tree, top) of each tree."""
    rounds, tops, most = [], None, None
    while most is None or most > 1:
        blocks = _blocks(nodes, [] if rounds else keep)
        most = most or blocks.agg(F.max("n")).first()[0] or 1
        rounds.append(blocks)
        ended = blocks.where(F.col("n") <= BLOCK).select("tree", "top")
        tops = ended if tops is None else tops.unionByName(ended)
        nodes = blocks.where(F.col("n") > BLOCK).select("tree", F.col("block").alias("at"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("top").alias("node"))
        most = -(-most // BLOCK)
    return rounds, tops


def _paths(rounds: list[DataFrame], above: DataFrame, keep: list[str]) -> DataFrame:
    """(tree, at, node, kept columns, path) of the first round's nodes. ``above``: (tree, above), the siblings beyond a tree's top."""
    down = None
    for k, blocks in reversed(list(enumerate(rounds))):
        rows = blocks.where(F.col("n") <= BLOCK).join(above, "tree")
        if down is not None:
            rows = rows.unionByName(blocks.where(F.col("n") > BLOCK).join(down.select("tree", F.col("at").alias("block"), F.col("path").alias("above")), ["tree", "block"]))
        mine = [] if k else keep
        with_path = F.transform("nodes", lambda x, i: F.struct(*(x[c].alias(c) for c in ("at", "node", *mine)), F.concat(_steps(i), F.col("above")).alias("path")))
        down = rows.select("tree", F.inline(with_path))
        if k:
            down = written(down, "merkle-paths")
    return down


def merkle_manifest(df: DataFrame, leaf: str, group: str, order: str, keep: list[str] | None = None) -> DataFrame:
    """A row for each row of ``df``: ``group``, ``order``, the columns of ``keep``, leaf, subroot, root and proof.

    Column ``leaf`` of ``df`` holds the rows' hashes. Leaves of a ``group`` (text) ascend by ``order``; null comes first as group and as
    order; rows that tie follow each other by leaf, so repeated rows are leaves of their own in a defined tree. ``subroot`` is the top of
    the group's tree, ``root`` that of the tree over all subroots, which ascend by the groups' bytes. ``proof`` lists, from the leaf's level
    to the root's, what stands ``left`` and ``right`` of the node in its run; a level with one node adds none. Of an empty table nothing
    comes. Columns of ``df`` that aren't named are not read.
    """
    keep = list(keep or [])
    names = {c: f"kept{k}" for k, c in enumerate(dict.fromkeys([group, order, *keep]))}
    rows = df.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("tree"), F.col(leaf).alias("node"), *(F.col(c).alias(n) for c, n in names.items()), F.monotonically_increasing_id().alias("row")
    )
    kept = list(names.values())
    leaves = range_number(written(rows, "merkle-leaves"), "tree", [names[order], "node", "row"], "at", "n").drop("row")
    rounds, tops = _grown(leaves, kept)
    tops = written(tops, "merkle-subroots")
    over = range_number(tops.select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("top").alias("node")), "tree", ["of"], "at", "n")
    upper, top = _grown(over, ["of"])
    root = top.first()
    nothing = F.from_json(F.lit("[]"), "array<struct<left:string,right:string>>")
    beyond = _paths(upper, top.select("tree", nothing.alias("above")), ["of"]).select(F.col("of").alias("tree"), F.col("path").alias("above"), F.col("node").alias("subroot"))
    beyond = written(beyond, "merkle-groups")
    found = _paths(rounds, beyond.drop("subroot"), kept).join(beyond.select("tree", "subroot"), "tree")
    return found.select(*(F.col(n).alias(c) for c, n in names.items()), F.col("node").alias("leaf"), "subroot", F.lit(root["top"] if root else None).cast("string").alias("root"), F.col("path").alias("proof"))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(proof, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def proof_hash(proof: Column) -> Column:
    """Hash of all siblings of a proof, concatenated in its order."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest_sql(group_levels: int = 8, root_levels: int = 6) -> str:
    """The query's rows in DuckDB's SQL, level by level: up to 16 ** levels leaves and groups."""
    spelled = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(spelled, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = """xor(4294967295, list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT] || [-1::BIGINT, -1, -1, -1, -1, -1, -1, -1])),
        lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) ELSE xor(acc >> 1, CASE WHEN acc % 2 = 1 THEN 3988292384 ELSE 0 END) END))"""
    steps = [
        f"""docs AS (SELECT doc_id, coalesce('=' || source, '') AS tree, {leaf("text")} AS leaf, CASE WHEN ({crc}) % 5 = 0 THEN {leaf(lower)} END AS other FROM documents)""",
        "g0 AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM docs)",
        "s0 AS (SELECT tree, pos, n, leaf AS node FROM g0)",
    ]

    def levels(name: str, count: int) -> None:
        for k in range(count):
            steps.append(f"{name}r{k} AS (SELECT tree, pos // 16 AS run, any_value(n) AS n, string_agg(node, '' ORDER BY pos) AS nodes FROM {name}{k} WHERE n > 1 GROUP BY tree, pos // 16)")
            steps.append(f"{name}{k + 1} AS (SELECT tree, run AS pos, (n + 15) // 16 AS n, sha256(nodes) AS node FROM {name}r{k})")
        steps.append(f"{name}top AS (" + " UNION ALL ".join(f"SELECT tree, node FROM {name}{k} WHERE n = 1" for k in range(count + 1)) + ")")

    levels("s", group_levels)
    steps.append("t0 AS (SELECT '' AS tree, tree AS sub, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n, node FROM stop)")
    levels("t", root_levels)
    steps.append("p0 AS (SELECT g.*, t.pos AS sub_pos, t.node AS subroot, (SELECT node FROM ttop) AS root, '' AS proof, coalesce(g.other, g.leaf) AS fold FROM g0 g JOIN t0 t ON t.sub = g.tree)")
    for name, count, pos, key, first in (("s", group_levels, "p.pos", "p.tree", 0), ("t", root_levels, "p.sub_pos", "''", group_levels)):
        for k in range(count):
            place = f"({pos} // {16**k} % 16)"
            left, right = f"substr(r.nodes, 1, 64 * {place})", f"substr(r.nodes, 64 * {place} + 65)"
            steps.append(
                f"p{first + k + 1} AS (SELECT p.* REPLACE (CASE WHEN r.nodes IS NULL THEN p.proof ELSE p.proof || {left} || {right} END AS proof, CASE WHEN r.nodes IS NULL THEN p.fold ELSE sha256({left} || p.fold || {right}) END AS fold)"
                f" FROM p{first + k} p LEFT JOIN {name}r{k} r ON r.tree = {key} AND r.run = {pos} // {16 ** (k + 1)})"
            )
    last = group_levels + root_levels
    return f"WITH {', '.join(x.split(' AS (', 1)[0] + ' AS MATERIALIZED (' + x.split(' AS (', 1)[1] for x in steps)} SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified FROM p{last}"
