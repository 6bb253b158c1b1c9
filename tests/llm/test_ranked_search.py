"""Operator 11 against scores worked out for every pair."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import types as T

from ledgerline.llm import ranked_search as rs
from ledgerline.llm.ranked_search import bounds, gain, length_factor, ranked_search, signature, sliced, terms_of, width_for

from . import fixtures

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])


def split(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    """Best k of (doc_id, text) rows for each item, as sorted (item_id, rank, doc_id, score)."""
    tfs = [(d, Counter(split(t))) for d, t in docs if split(t)]
    n, words = len(tfs), sum(sum(c.values()) for _, c in tfs)
    df = Counter(t for _, c in tfs for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in tfs:
            m = 100 - 75 + (75 * sum(c.values()) * n) // words
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in split(text) if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def test_terms_are_those_of_the_pattern():
    rng = random.Random(1)
    odd = [*"aZ09 .-_`{~\n\t\x00\x7f\x80é漢🙂İß\xa0 "]
    for _ in range(2000):
        text = "".join(rng.choice(odd) for _ in range(rng.randint(0, 30)))
        assert [t.decode() for t in terms_of(text.encode())] == split(text)


@pytest.mark.parametrize("seed", range(4))
def test_bounds_never_lie_below_scores(seed):
    rng = random.Random(seed)
    vocabulary = [b"w%d" % i for i in range(400)]
    docs = [Counter(rng.choices(vocabulary[: rng.choice((5, 50, 400))], k=rng.randint(1, 700))) for _ in range(37)]
    hashes = [np.array([xxhash.xxh64_intdigest(t) for t in c], np.uint64) for c in docs]
    entries = [signature(np.array(list(c.values())), h) for c, h in zip(docs, hashes)]
    width = width_for(max(map(len, entries)))
    lengths = np.array([sum(c.values()) for c in docs])
    words, n = int(lengths.sum()) * 3, 111
    items = [[(rng.choice(vocabulary + [b"absent"]), rng.randint(0, 9000)) for _ in range(12)] for _ in range(5)]
    terms = {}
    for i, uses in enumerate(items):
        for t, w in uses:
            terms.setdefault(t, []).append((i, w))
    upper = bounds(width, sliced(entries, width), lengths, terms, 5, n, words)
    loose = 0
    for i, uses in enumerate(items):
        for d, c in enumerate(docs):
            score = sum(w * gain(c[t], length_factor(int(lengths[d]), n, words)) for t, w in uses if t in c)
            assert upper[i, d] >= score
            loose += int(upper[i, d]) > 2 * score + 10_000_000
    assert loose < 0.2 * 5 * len(docs)  # and mostly lie near them


@pytest.mark.parametrize(("turns", "few"), [(256, 1 << 17), (3, 0)])
def test_search_equals_brute_force(spark, monkeypatch, turns, few):
    monkeypatch.setattr(rs, "ITEMS", turns)
    monkeypatch.setattr(rs, "BROADCAST_ROWS", few)
    texts = fixtures.texts() + ["same words here"] * 15 + [" ".join(["often"] * k + ["rare"]) for k in (1, 2, 3, 4, 7, 8, 100)]
    df = fixtures.documents(spark, texts, clash=True).repartition(3)
    docs = [(r.doc_id, r.text) for r in df.collect()]
    asked = [(i, t) for i, t in enumerate(["same words", "often rare", "ONE é 漢字 🙂", "nowhere", "", None, "word", texts[3], texts[8], "same same same words often"])] + [(None, "one"), (3, "tab and tab")]
    items = spark.createDataFrame(asked, ITEMS)
    for k in (10, 2):
        got = sorted((tuple(r) for r in ranked_search(df, items, k).select("item_id", "rank", "doc_id", "score").collect()), key=repr)
        assert got == brute(docs, asked, k)


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "one")], ITEMS)
    assert ranked_search(fixtures.empty(spark), items).count() == 0
    assert ranked_search(fixtures.documents(spark, ["", None, " - "]).where("doc_id is not null"), items).count() == 0
    assert ranked_search(fixtures.documents(spark, ["one"]), items.limit(0)).count() == 0
