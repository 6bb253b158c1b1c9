"""Seeded edits of real files, from a git history to verdicts."""

import ast
import os
from pathlib import Path

import pandas
import pytest
from pyspark.sql import functions as F

from ledgerline.operators.seeding import BY_DESIGN, CONTROLS, INJECTED, seeded_edits
from ledgerline.sources.edits import Source, edit, other_literal, other_type
from ledgerline.sources.git_source import GitHistory

from .test_sources import committed

GOOGLE = '''def f(size: int = 3, *, größe: "str" = "ä", kind: int = 1) -> bool:
    """Ärger über alles.

    Args:
        size (int): Größe. Defaults to 3.
        größe (str): Text.

    Returns:
        bool: Whether.

    Raises:
        ValueError: If so.
    """
    if size: raise ValueError("ü")
    return True
'''


@pytest.mark.parametrize(
    ("category", "aspect", "value", "has", "code", "docs"),
    [
        ("code_default", "param.size.default", "3", "size: int = 10, *", "10", "3"), ("code_param_type", "param.größe.type", "str", 'größe: int = "ä"', "int", "str"), ("code_return_type", "returns.type", "bool", "-> str:", "str", "bool"),
        ("code_param_renamed", "param.größe.exists", "true", '*, ghost: "str"', "false", "true"), ("docs_default", "param.size.default", "3", "Defaults to 10.", "3", "10"), ("docs_param_type", "param.size.type", "int", "size (str): Größe", "int", "str"),
        ("docs_return_type", "returns.type", "bool", "        str: Whether", "bool", "str"), ("docs_param_invented", "param.size.exists", "true", "        ghost (int): Seeded.\n        size", "false", "true"), ("docs_deprecated", "param.size.exists", "true", ".. deprecated:: 1.0", "false", "true"),
        ("comment_added", "param.size.exists", "true", '"""\n    # seeded\n', None, None), ("statement_added", "param.size.exists", "true", '"""\n    _seeded = 0\n', None, None), ("function_added", "param.size.exists", "true", "\n\n\ndef ghost():", None, None),
        ("summary_reworded", "param.size.exists", "true", "alles. Indeed.", None, None), ("undocumented_default_changed", "param.size.exists", "true", "kind: int = 8", None, None), ("undocumented_type_changed", "param.size.exists", "true", "kind: str = 1", None, None), ("raise_removed", "raises.ValueError", "true", "if size: pass", None, None),
    ],
)
def test_each_edit_changes_its_span_alone(category, aspect, value, has, code, docs):
    claimed = {"param.size.exists", "param.size.type", "param.size.default", "param.größe.exists", "param.größe.type", "param.größe.default", "returns.type", "raises.ValueError"}
    done = edit(GOOGLE, "f", category, aspect, value, claimed, "ghost")
    assert has in done["content"] and (done["code"], done["docs"]) == (code, docs)
    ast.parse(done["content"])
    same = len(os.path.commonprefix([GOOGLE, done["content"]]))
    tail = len(os.path.commonprefix([GOOGLE[same:][::-1], done["content"][same:][::-1]]))
    assert len(GOOGLE) - same - tail <= 24  # what was taken out


def test_edits_that_do_not_apply():
    twice = "def f(a=1): pass\ndef f(a=1): pass\n"
    assert edit(twice, "f", "code_default", "param.a.default", "1", set(), "g") is None and edit("def f(:\n", "f", "function_added", "x", "", set(), "g") is None
    stars = GOOGLE.replace("kind: int = 1", "**kw")
    assert edit(stars, "f", "code_param_renamed", "param.size.exists", "true", set(), "g") is None and edit(stars, "f", "docs_param_invented", "param.size.exists", "true", set(), "g") is None
    raw = GOOGLE.replace('"""', "'''")
    assert edit(raw, "f", "docs_default", "param.size.default", "3", set(), "g") is None
    assert [other_literal(v) for v in ("True", "3", "2.5", "'a'", "None", "f()", "(1,)")] == ["False", "10", "4.0", "'a_x'", "0", None, None] and other_type("None | int | str") == "bytes"
    s = Source("é = 'ü'; x = f(1)\n")
    assert s.text[slice(*s.span(s.tree.body[1].value))] == "f(1)"


def test_edits_of_a_package_are_judged(spark, tmp_path):
    """Modules of an installed package, with NumPy docstrings, and small ones of other styles; every fifth function of the small ones can't be read."""
    root = Path(pandas.__file__).parent
    real = {f"src/pandas/{p}": (root / p).read_text() for p in ("core/algorithms.py", "core/reshape/melt.py", "core/reshape/tile.py", "core/tools/timedeltas.py", "io/clipboards.py")}
    small = {f"src/m/a{i}.py": ("@odd\n" if i % 5 == 0 else "") + GOOGLE.replace("def f", f"def f{i}") for i in range(60)}
    committed(tmp_path, [real | small])
    spark.dataSource.register(GitHistory)
    files = spark.read.format("git_history").option("repo", str(tmp_path)).load().select("path", "content")
    out = seeded_edits(files, 4, seed=7).collect()
    assert len({r.unit for r in out}) == len(out)  # no function twice
    n = {c: sum(r.category == c for r in out) for c in (*INJECTED, *CONTROLS, *BY_DESIGN)}
    assert all(x == 4 for x in n.values()), n
    verdicts = {(r.kind, r.verdict) for r in out}
    assert verdicts <= {("inject", "found"), ("inject", "abstained"), ("control", "clean"), ("by_design", "silent")} and ("inject", "found") in verdicts
    assert not any(r.extra for r in out if r.kind != "inject")
    assert sum(r.verdict == "found" for r in out) >= 30
