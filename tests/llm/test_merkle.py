"""Operator 12 against trees folded by hand."""

import hashlib

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import queries
from ledgerline.llm.merkle import folded, leaf_hash, merkle_manifest, proof_hash

from . import fixtures

H = lambda s: hashlib.sha256(s.encode()).hexdigest()


def tree(leaves):
    """Root of the leaves and the siblings of each, level by level."""
    level, paths, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for k, p in enumerate(paths):
            run = at[k] // 16 * 16
            p.append(("".join(level[run : at[k]]), "".join(level[at[k] + 1 : run + 16])))
        level, at = [H("".join(level[i : i + 16])) for i in range(0, len(level), 16)], [i // 16 for i in at]
    return level[0], paths


def expected(rows, fields):
    """{(doc_id, leaf): [(subroot, root, proof), ...]} of rows as dicts."""
    spelled = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, H("".join(spelled(r[f]) for f in fields))))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(groups[s])]) for s in order}
    root, above = tree([trees[s][0] for s in order])
    out = {}
    for s, up in zip(order, above):
        for (known, doc, leaf), path in zip(sorted(groups[s]), trees[s][1]):
            out.setdefault((doc if known else None, leaf), []).append((trees[s][0], root, path + up))
    return out


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


@pytest.mark.parametrize("sizes", [{"a": 1}, {None: 1, "": 2, "a": 16, "b": 17, "é": 33}, {"big": 700, "z": 256, "y": 257, None: 15}, {"x": 4200, "w": 3} | {f"s{i}": 1 for i in range(300)}])
def test_trees_by_hand(spark, sizes):
    rows = [{"doc_id": None if i == 5 else i * 7 % 5003, "source": s, "lang": None if i % 3 else "en", "n_chars": i, "text": f"Tèxt {i}"} for s, n in sizes.items() for i in range(n)]
    rows += rows[:2]  # repeated rows are leaves of their own
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    out = merkle_manifest(df.withColumn("leaf", leaf_hash(*FIELDS)).withColumn("clash", F.lit(1)), "leaf", "source", "doc_id", ["text"])
    want, found = expected(rows, FIELDS), {}
    for r in out.withColumn("again", folded(F.col("leaf"), F.col("proof"))).withColumn("digest", proof_hash(F.col("proof"))).collect():
        proof = [(s.left, s.right) for s in r.proof]
        assert r.again == r.root and r.digest == H("".join(a + b for a, b in proof))
        found.setdefault((r.doc_id, r.leaf), []).append((r.subroot, r.root, proof))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}


def test_query_finds_what_was_tampered_with(spark, tmp_path):
    fixtures.documents(spark, clash=True).write.parquet(str(tmp_path / "documents.parquet"))
    import zlib

    for r in queries.op12_merkle_manifest(spark, str(tmp_path)).collect():
        text = dict(enumerate(fixtures.texts())).get(r.doc_id) if r.doc_id is not None else None
        changed = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and text is not None and any("A" <= c <= "Z" for c in text)
        assert r.verified is (not changed)


def test_empty_table(spark, tmp_path):
    fixtures.empty(spark).write.parquet(str(tmp_path / "documents.parquet"))
    assert queries.op12_merkle_manifest(spark, str(tmp_path)).collect() == []
