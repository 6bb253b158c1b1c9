"""Where values come from, and when disputes are waived, on small inputs."""

import random

from ledgerline.operators.review import covers, explain, open_intervals, roots


def test_chains_of_any_length_end_at_their_roots(spark):
    rng = random.Random(3)
    links, depth = {}, {}
    for i in range(400):
        up = i - 1 if 50 < i < 300 else (rng.randrange(i) if i and rng.random() < 0.8 else None)
        links[i], depth[i] = up, 0 if up is None else depth[up] + 1

    def root(i):
        return i if links[i] is None else root(links[i])

    out = {r.id: (r.root, r.depth) for r in roots(spark.createDataFrame(list(links.items()), "id long, up long")).collect()}
    assert out == {i: (root(i), depth[i]) for i in links} and max(depth.values()) > 200
    assert roots(spark.createDataFrame([], "id long, up long")).count() == 0


def test_a_withdrawn_value_starts_anew(spark):
    facts = [(1, "a", 1, 1), (1, "b", 2, 2), (1, "b", 3, 3), (1, None, 4, 4), (1, "c", 5, 5), (1, "d", 6, 6), (2, "x", 1, 7), (2, None, 2, 8), (3, None, 1, 9)]
    out = [tuple(r) for r in explain(spark.createDataFrame(facts, "key long, value string, at long, tie long")).collect()]
    assert out == [(1, "d", 1, 5, "c", 5, 6, 6)]


def test_waivers_before_over_and_after_disputes(spark):
    disputes = spark.createDataFrame([(1, 1, "v", 10, 20), (2, 1, "w", 20, 30), (3, 1, "v", 40, None), (4, 2, "z", 10, 20), (5, 3, "z", 10, None), (6, 4, "q", 5, 9)], "id long, key long, value string, start long, end long")
    waivers = [
        (1, "code_defect", 5, 50), (1, "code_defect", 12, 15), (1, "intentional_simplification", 14, 17), (1, "code_defect", 22, 99), (1, "docs_wrong", 11, 99), (1, "code_defect", 42, 44),
        (1, "code_defect", 35, 60), (2, "extraction_error", 19, 0), (3, "code_defect", 10, 12), (3, "code_defect", 11, 11), (9, "code_defect", 1, 2),
    ]
    covered = covers(spark.createDataFrame(waivers, "key long, disposition string, granted long, expires long"), disputes)
    out = sorted(((r.id, r.start, r.end) for r in open_intervals(disputes, covered).collect()), key=str)
    assert out == sorted([(1, 10, 12), (1, 17, 20), (2, 20, 22), (3, 40, 42), (3, 44, None), (5, 12, None), (6, 5, 9)], key=str)
