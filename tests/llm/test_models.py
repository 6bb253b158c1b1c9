"""Operators 1, 8, 9 and 10 against brute force or on rows held out, and the pipeline."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import ngram_join as nj
from ledgerline.llm.components import components
from ledgerline.llm.language import WIDTHS, WINDOW, ByteNetwork, identify_language, score_windows, train
from ledgerline.llm.neighbours import exact_neighbours, nearest_neighbours
from ledgerline.llm.quality import quality_rules, repeated_words, viterbi

from . import fixtures


def sets_of(text, n):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute_components(rows, n, percent):
    sets, parent = {i: sets_of(t, n) for i, t in rows}, {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize(("frequent", "rounds"), [(16, 2), (1, 0)])
def test_join_equals_brute_force(spark, monkeypatch, frequent, rounds):
    monkeypatch.setattr(nj, "FREQUENT", frequent)
    monkeypatch.setattr(nj, "LEADER_ROUNDS", rounds)
    rng = random.Random(8)
    base = fixtures.words(rng, 60)
    group = []
    for _ in range(25):  # a group of near copies, some only linked through others
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = rng.choice(["new", "other", "third"])
        group.append(" ".join(w))
    rows = fixtures.texts() + group
    out = nj.ngram_join(fixtures.documents(spark, rows, clash=True), 4, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in out.where("doc_id is not null").collect()}
    assert got == brute_components(list(enumerate(rows)), 4, 85)
    assert out.where("doc_id is null").select("component_id").first()[0] is None and out.count() == len(rows) + 2


@pytest.mark.parametrize(("size", "more", "percent"), [(40, 6, 85), (86, 21, 80)])
def test_appended_words_just_above_the_threshold_still_link(spark, size, more, percent):
    rng = random.Random(size + percent)
    rows = []
    for k in range(30):  # a pair holds size of size + more shingles in common and shares none with other pairs
        own = [f"w{k}x{rng.randrange(10**9)}" for _ in range(size + more + 3)]
        rows += [" ".join(own[: size + 3]), " ".join(own)]
    want = brute_components(list(enumerate(rows)), 4, percent)
    assert [want[i][1] for i in range(60)] == [i - i % 2 for i in range(60)]
    out = nj.ngram_join(fixtures.documents(spark, rows), 4, percent).where("doc_id is not null").collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want


def test_rows_of_one_id_are_one_document(spark):
    """It links by any of its texts, also through rounds and repeated rows."""
    rng = random.Random(4)
    base = [" ".join(fixtures.words(rng, 60)) for _ in range(12)]
    near = [b + " more" for b in base]
    rows = [(i, b) for i, b in enumerate(base)] + [(i + 20, x) for i, x in enumerate(near)] + [(0, base[5]), (0, near[7]), (3, base[9])] + [(0, base[0])] * 4 + [(23, near[3])] * 3 + [(40, None), (40, base[11])]
    df = spark.createDataFrame([(d, t) for d, t in rows], "doc_id long, text string").repartition(3)
    out = [(r.doc_id, r.component_id) for r in nj.ngram_join(df, 4, 85).collect()]
    want = {i: i for i in range(12)} | {5: 0, 7: 0, 9: 3}
    assert sorted(out) == sorted((d, d if t is None else want[d if d < 20 else 11 if d == 40 else d - 20]) for d, t in rows)


def test_join_of_nothing(spark):
    assert nj.ngram_join(fixtures.empty(spark)).count() == 0
    assert {r.component_id for r in nj.ngram_join(fixtures.documents(spark, [None, "", " "])).where("doc_id is not null").collect()} == {0, 1, 2}


def test_components_of_a_long_chain(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 100), (200, 205), (205, 201)]
    random.Random(1).shuffle(chain)
    out = {r.node: r.label for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(out[i] == 0 for i in range(61)) and out[100] == 100 and {out[200], out[201], out[205]} == {200}


def test_languages_of_held_out_rows(spark):
    rng = random.Random(2)
    kinds = {"aa": "wabo teku mina loro".split(), "bb": "sträng kömp über zuß".split(), "cc": "ça naïve être où".split()}
    rows = [(i, " ".join(rng.choice(v) for _ in range(rng.randint(3, 80))), k) for i, (k, v) in enumerate(list(kinds.items()) * 60)]
    df = spark.createDataFrame([*rows, (900, None, "aa"), (901, "", None), (902, "12 .. 3", "bb"), (None, "wabo", "aa")], "doc_id long, text string, lang string")
    network = train(df.where("doc_id % 4 <> 2"))
    out = {r.doc_id: r for r in identify_language(df, network).collect()}
    held = [(k, i) for i, _, k in rows if i % 4 == 2]
    assert sum(out[i].lang_pred == k for k, i in held) >= 0.95 * len(held)
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (900, 901, 902)) and all(0 <= r.score <= 1 for r in out.values())
    assert train(df.limit(0)) is None and identify_language(df, None).where("lang_pred <> 'und'").count() == 0


def brute_neighbours(rows, every, k):
    good = {i: np.array(v, np.float32).astype(np.float64) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    return {(q, r + 1): i for q in good if q % every == 0 for r, i in enumerate(sorted((i for i in good if i != q), key=lambda i: (-(good[q] @ good[i]), i))[:k])}


def test_neighbours_find_nearly_all(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(700, 16)).astype(np.float32)
    vectors[100:160] = vectors[100]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(1000, None), (1020, []), (1040, [0.0] * 16), (1060, [1.0, None] * 8), (1080, [float("nan")] * 16), (1100, [float("inf")] * 16), (None, [1.0] * 16)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, node int")
    out = {(r.query_id, r["rank"]): r for r in nearest_neighbours(df, 20, 20).collect()}
    want = brute_neighbours(rows, 20, 20)
    assert set(out) == set(want)
    hits = defaultdict(set)
    for (q, _), i in want.items():
        hits[q].add(i)
    assert sum(r.vec_id in hits[q] for (q, _), r in out.items()) >= 0.95 * len(want)
    assert all(abs(r.score - vectors[q].astype(float) @ vectors[r.vec_id].astype(float)) < 1e-12 for (q, _), r in out.items())
    assert [out[100, n].vec_id for n in range(1, 21)] == [want[100, n] for n in range(1, 21)]


def test_words_of_tables_equal_the_plain_convolution():
    rng = np.random.default_rng(5)
    network = ByteNetwork(["a", "b", "c"], seed=3)
    x = rng.integers(0, 256, (40, WINDOW)).astype(np.uint8)
    e = network.embedding[x]
    pooled = [np.maximum(np.concatenate([e[:, i : i + WINDOW - w + 1] for i in range(w)], 2) @ network.filters[w] + network.offsets[w], 0).max(1) for w in WIDTHS]
    logits = np.concatenate(pooled, 1) @ network.out + network.bias
    want = logits - np.log(np.exp(logits).sum(1, keepdims=True))
    assert np.abs(score_windows(x, network.tables(), network.out, network.bias) - want).max() < 1e-3


def test_language_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr("ledgerline.llm.language.TRAINING_DOCS", 5)
    words = {"aa": "wabo teku mina", "bb": "sträng kömp zuß"}
    rows = [(7, v, k, "x") for k, v in words.items() for _ in range(40)] + [(8, "² ½ Ⅷ ① 12", None, "x"), (9, "wabo " * 40_000, "aa", "x"), (9, "wabo " * 40_000, "aa", "x"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    out = identify_language(df, train(df))
    assert out.columns == ["doc_id", "lang_pred", "score"] and out.count() == len(rows)
    found = {(r.doc_id, r.lang_pred) for r in out.collect()}
    assert (8, "und") in found and (9, "aa") in found and (None, "und") in found and {(7, "aa"), (7, "bb")} <= found


def test_neighbours_of_double_vectors_keep_their_precision(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(60, 6))
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(3, v[4].tolist()), (70, [1.0] * 5), *((i, v[20].tolist()) for i in range(100, 130))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1)).withColumn("block", F.lit("x"))
    best = {i: min([x.tolist() for k, x in [*enumerate(v), (3, v[4])] if k == i]) for i in range(60)} | {i: v[20].tolist() for i in range(100, 130)}
    out = nearest_neighbours(df, 20, 20).collect()
    for q in (0, 20, 40, 100, 120):
        want = sorted((i for i in best if i != q), key=lambda i: (-float(np.array(best[q]) @ np.array(best[i])), i))[:20]
        got = sorted((r["rank"], r.vec_id, r.score) for r in out if r.query_id == q)
        assert {round(s, 12) for _, _, s in got} == {round(float(np.array(best[q]) @ np.array(best[i])), 12) for i in want} and len(got) == 20
        if q in (20, 100, 120):  # more equal vectors than places: the smallest ids
            assert [i for _, i, _ in got] == want
    assert {r.query_id for r in out} == {0, 20, 40, 100, 120}


def test_neighbours_of_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.score) for r in nearest_neighbours(df).orderBy("rank").collect()] == [(1, 0.5), (2, 0.5)]
    assert nearest_neighbours(df.limit(0)).count() == 0


def brute_counts(text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    repeat = len({j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)})
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, repeat, len(w) < 10 or 100 * repeat > 20 * len(w)


def test_quality_counts_and_verdicts(spark):
    rng = random.Random(6)
    good = [". ".join(" ".join(fixtures.words(rng, 9)).capitalize() for _ in range(6)) + "." for _ in range(60)]
    junk = ["\n".join(" | ".join(fixtures.words(rng, 4)) for _ in range(6)) for _ in range(60)]
    rows = good + junk + fixtures.texts() + ["a b\na b\n\n \n \nc", "x y z u v " * 4]
    docs = fixtures.documents(spark, rows, clash=True)
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(0, 120, 2)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality_rules(docs, labels).where("doc_id is not null").collect()}
    for i, t in enumerate(rows):
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_counts(t), t
        assert not (r.kept and r.base_failed)
    assert sum(out[i].kept for i in range(60)) >= 58 and sum(out[i].kept for i in range(60, 120)) <= 2
    bare = quality_rules(docs, labels.limit(0))
    assert bare.where("kept = base_failed").count() == 0 and quality_rules(fixtures.empty(spark), labels).count() == 0


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(50):
        s, m = rng.normal(size=(6, 2)), rng.normal(size=(2, 2))
        paths = [[k >> i & 1 for i in range(6)] for k in range(64)]
        best = max(paths, key=lambda p: sum(s[i, x] for i, x in enumerate(p)) + sum(m[a, b] for a, b in zip(p, p[1:])))
        assert viterbi(s, m) == best
    assert repeated_words([[]]) == [0]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(12)
    clean = [". ".join(" ".join(fixtures.words(rng, 12)).capitalize() for _ in range(5)) + "." for _ in range(40)]
    near = [t.replace(t.split(" ")[30], "other", 1) for t in clean[:6]]
    rows = clean + near + ["write to someone@mail.example.org " + t for t in clean[6:8]] + ["| x " * 40, None, "", "short"]
    fixtures.documents(spark, rows).where("doc_id is not null").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 48), 0) for i in range(0, 52)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if k < 4:
            assert docs.columns == fixtures.DOCS.names
        if name == "PII":
            assert docs.where(F.col("text").contains("@")).count() == 0
    assert not kept["quality rules"] & {48, 49, 50, 51} and set(range(40)) <= kept["line dedup"]
    assert kept["n-gram Jaccard join"] >= set(range(40)) and not kept["n-gram Jaccard join"] & set(range(40, 46))
    assert kept["best-fit packing"] == kept["PII"] == kept["n-gram Jaccard join"]
    assert cp.run(spark, str(tmp_path)).count() == docs.count()


def test_pipeline_of_odd_tables(spark, tmp_path):
    import corpus_pipeline as cp

    docs = fixtures.documents(spark, [None, "", "one two", "a b " * 30, "x" * 3000], clash=True).withColumn("row", F.lit(1)).withColumn("pii", F.lit("p")).withColumn("lost", F.lit(2))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for rows in (docs, docs.limit(0)):
        for _, stage in cp.STAGES[:-1]:
            out = stage(spark, rows, str(tmp_path))
            assert out.columns == docs.columns and out.count() <= rows.count()
        pieces = cp.STAGES[-1][1](spark, rows, str(tmp_path))
        assert {(r.doc_id, r.piece) for r in pieces.collect()} >= {(r.doc_id, 0) for r in rows.collect()}
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_exact_neighbours_and_the_search_agree_on_a_graph_that_matters(spark):
    """3,000 vectors in 24 dimensions: fifteen buckets a tree, so that NN-descent and the search find what buckets part."""
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(3000, 24)).round(3))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    vectors = np.array([r[1] for r in rows])
    exact = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in exact_neighbours(df, 200, 10, block=4).collect()}
    for q in range(0, 3000, 200):
        scores = vectors @ vectors[q]
        want = sorted((-s, i) for i, s in enumerate(scores) if i != q)[:10]
        assert [exact[q, k + 1][0] for k in range(10)] == [i for _, i in want]
    found = {(r.query_id, r.vec_id) for r in nearest_neighbours(df, 200, 10).collect()}
    assert len(found & {(q, v) for (q, _), (v, _) in exact.items()}) >= 0.9 * len(exact)


def test_ties_over_the_searchs_cut(spark):
    """More vectors tie than a search keeps: the smallest ids of those that are kept come out, each with its exact score."""
    rows = [(i, [1.0, float(i % 2), 1.0 + (i % 400) * 2.0**-30]) for i in range(800)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    out = nearest_neighbours(df, 400, 5).collect()
    assert {(r.query_id, r["rank"]) for r in out} == {(q, k) for q in (0, 400) for k in range(1, 6)}
    e = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    assert all(r.score == float(e[r.query_id] @ e[r.vec_id]) for r in out)
    for q in (0, 400):
        mine = sorted((r["rank"], -r.score, r.vec_id) for r in out if r.query_id == q)
        assert [(s, v) for _, s, v in mine] == sorted((s, v) for _, s, v in mine)
