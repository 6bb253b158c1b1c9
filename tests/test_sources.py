"""The git source and the stream."""

import subprocess

import pytest

from ledgerline.jobs.engine import events
from ledgerline.operators.history import windows
from ledgerline.operators.slots import fold_slots
from ledgerline.sources.git_source import GitHistory, repo_slug
from ledgerline.streaming.live import closed_windows


def committed(folder, steps):
    """A repository in ``folder`` with a commit for each step: contents of paths, None where deleted."""

    def git(*args):
        subprocess.run(["git", "-C", str(folder), "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True)

    git("init", "-b", "main")
    for i, step in enumerate(steps):
        for path, content in step.items():
            f = folder / path
            f.parent.mkdir(exist_ok=True, parents=True)
            f.unlink() if content is None else f.write_text(content)
        git("add", "-A")
        git("commit", "-m", str(i))


def test_git_history(spark, tmp_path):
    committed(tmp_path, [{"src/a.py": "x = 1\n", "data.bin": "no", "tests/t.py": "y"}, {"src/a.py": "x = 2\n", "docs/b.md": "b"}, {"src/a.py": None, "vendor/c.py": "c"}])
    spark.dataSource.register(GitHistory)
    rows = spark.read.format("git_history").option("repo", str(tmp_path)).option("exclude", "vendor/*").load().collect()
    assert sorted((r.seq, r.path, bytes(r.content)) for r in rows if r.content) == [(1, "src/a.py", b"x = 1\n"), (2, "docs/b.md", b"b"), (2, "src/a.py", b"x = 2\n")]
    assert [(r.seq, r.path) for r in rows if r.content is None] == [(3, "src/a.py")]
    assert [r.committed_at for r in rows] == sorted(r.committed_at for r in rows) and len({r.committed_at for r in rows}) == 3
    first = next(r.sha for r in rows if r.seq == 1)
    read = spark.read.format("git_history").option("repo", str(tmp_path))
    assert {r.seq for r in read.option("after", first).load().collect()} == {2, 3}
    with pytest.raises(Exception, match="any more"):
        spark.read.format("git_history").option("repo", str(tmp_path)).option("after", "0" * 40).load().collect()
    later = max(r.committed_at for r in rows).isoformat() + "+00:00"
    tree = spark.read.format("git_history").option("repo", str(tmp_path)).option("since", later).load().collect()
    assert {(r.seq, r.path) for r in tree} == {(3, "docs/b.md"), (3, "vendor/c.py")}


def test_repository_to_slots(spark, tmp_path):
    good = 'def f(a: int = {}):\n    """F.\n\n    :param a: A, default {}.\n    :type a: int\n    """\n'
    committed(tmp_path, [{"src/m/a.py": good.format(1, 1), "src/m/b.py": good.format(1, 1), "src/m/c.py": good.format(1, 1)}, {"src/m/a.py": good.format(2, 1), "src/m/b.py": None, "src/m/c.py": "def f(:"}])
    spark.dataSource.register(GitHistory)
    files = spark.read.format("git_history").option("repo", str(tmp_path)).load()
    out = {(r.symbol_key, r.aspect): (r.outcome, r.code_value, r.doc_value) for r in fold_slots(events(files)).collect()}
    assert out["py:m.a.f", "param.a.default"] == ("contradict", "2", "1") and out["py:m.c.f", "param.a.default"] == ("corroborate", "1", "1")
    assert {k for k, _ in out} == {"py:m.a.f", "py:m.c.f"}


@pytest.mark.parametrize(("url", "slug"), [("git@host:o/n.git", "o/n"), ("https://host/o/n", "o/n"), ("", "local/x")])
def test_repo_slug(url, slug):
    assert repo_slug(url, "x") == slug


def test_stream_refuses_older_facts(spark, tmp_path):
    schema = "key long, value string, at timestamp, tie long"
    late = [(1, "a", "2024-01-02 00:00:00", 1), (1, "b", "2024-01-03 00:00:00", 2)]
    for i, rows in enumerate(([late[1]], [late[0]])):
        spark.createDataFrame(rows, "key long, value string, at string, tie long").selectExpr("key", "value", "timestamp(at) as at", "tie").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in/*"))
    with pytest.raises(Exception, match="came after"):
        closed_windows(stream, "late").collect()


def test_stream_in_batches_equals_one_pass(spark, tmp_path):
    facts = [(1, "a", 1, 1), (1, "a", 2, 2), (2, "x", 2, 3), (1, "b", 3, 4), (1, None, 4, 5), (1, None, 5, 6), (2, "x", 6, 7), (1, "b", 7, 8), (1, "c", 8, 9), (2, None, 9, 10), (2, "x", 9, 11), (3, None, 9, 12), (3, "z", 10, 13), (3, "y", 11, 14)]
    rows = [(k, v, f"2024-01-{d:02d} 00:00:00", t) for k, v, d, t in facts]
    for i in range(0, len(rows), 3):
        spark.createDataFrame(rows[i : i + 3], "key long, value string, at string, tie long").selectExpr("key", "value", "timestamp(at) as at", "tie").coalesce(1).write.parquet(str(tmp_path / f"in/{i:02d}"))
    schema = "key long, value string, at timestamp, tie long"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    whole = windows(spark.read.schema(schema).parquet(str(tmp_path / "in/*"))).where("valid_to is not null").select("key", "value", "valid_from", "valid_to")
    assert sorted(map(tuple, closed_windows(stream, "batches").collect())) == sorted(map(tuple, whole.collect()))
