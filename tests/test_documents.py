"""Documents beside the code: what pages claim, which symbols they mean, and how missing symbols are judged."""

import pytest

from ledgerline.jobs.engine import reconcile
from ledgerline.operators.ownership import State, decide
from ledgerline.operators.resolution import canonical, followed, resolve
from ledgerline.sources.markup import blocks, changelog_references, page_references

PAGE = """# Title

Use `acme.Client.connect(timeout=5)` to connect, see `foo`.

## `acme.Client`

| Parameter | Type | Default |
| :--- | --- | ---: |
| `timeout` | `int` | `30` |
| host | str \\| None | None |
| not a name | int | 1 |

The `retries` option defaults to 3. Nothing else.

```python
from acme import Client as C
c = C(host="x")
C.close(now=True)
c.other()
```

```pycon
>>> import acme.util as u
>>> u.go(1)
2
```

~~~
`not.code`
"""


def test_a_page_is_read_by_its_blocks():
    assert [b.kind for b in blocks(PAGE)] == ["heading", "paragraph", "heading", "table", "paragraph", "fence", "fence", "fence"]
    got = {(r.ref, r.aspect, r.value, r.line) for r in page_references(PAGE)}
    assert got == {
        ("acme.Client.connect", "exists", "true", 3), ("acme.Client.connect", "param.timeout.exists", "true", 3), ("acme.Client", "exists", "true", 5),
        ("acme.Client", "param.timeout.exists", "true", 9), ("acme.Client", "param.timeout.default", "30", 9), ("acme.Client", "param.timeout.type", "int", 9),
        ("acme.Client", "param.host.exists", "true", 10), ("acme.Client", "param.host.default", "None", 10), ("acme.Client", "param.host.type", "None | str", 10),
        ("acme.Client", "param.retries.exists", "true", 13), ("acme.Client", "param.retries.default", "3", 13),
        ("acme.Client", "exists", "true", 16), ("acme.Client", "exists", "true", 17), ("acme.Client", "param.host.exists", "true", 17), ("acme.Client.close", "exists", "true", 18), ("acme.Client.close", "param.now.exists", "true", 18),
        ("acme.util", "exists", "true", 23), ("acme.util.go", "exists", "true", 24),
    }
    assert page_references("") == [] and page_references("```python\nnot ( code\n```\n") == []


def test_a_changelog_dates_what_its_items_name():
    text = "# Changelog\n\n## [1.2.0] - 2024-01-01\n\n### Added\n- `acme.new` does it\n- nothing of `acme.x`\n\n### Deprecated\n- `Client.old()`: use\n  more\n### Removed\n* `gone.f`\n\n## [Unreleased]\n### Removed\n- `later.f`\n"
    assert {(r.ref, r.aspect, r.value) for r in changelog_references(text)} == {("acme.new", "added_in", "1.2.0"), ("Client.old", "deprecated", "true"), ("gone.f", "removed_in", "1.2.0")}


def test_aliases_are_followed_and_cycles_end(spark):
    chain = [(f"py:a.n{i}", f"py:a.n{i + 1}") for i in range(40)] + [("py:p.m", "py:q.m"), ("py:q.m.f", "py:r.g")]
    circle = [("py:c.a", "py:c.b"), ("py:c.b", "py:c.d"), ("py:c.d", "py:c.a"), ("py:g.a", "py:g.b.x"), ("py:g.b", "py:g.a.y")]
    edges = followed(spark.createDataFrame(chain + circle, "alias string, target string"))
    ends = {r.alias: r.target for r in edges.collect()}
    assert all(ends[f"py:a.n{i}"] == "py:a.n40" for i in range(40)) and not any(k.startswith(("py:c.", "py:g.")) for k in ends)
    names = spark.createDataFrame([("py:a.n3.f",), ("py:p.m.f.x",), ("py:z",)], "name string")
    assert {r.name: r.key for r in canonical(names, edges).collect()} == {"py:a.n3.f": "py:a.n40.f", "py:p.m.f.x": "py:r.g.x", "py:z": "py:z"}


def test_references_mean_one_symbol_or_none(spark):
    symbols = spark.createDataFrame([(f"py:{n}",) for n in ("acme", "acme.client", "acme.client.Client", "acme.client.Client.connect", "acme.a.go", "acme.b.go", "acme.a", "acme.b")], "symbol_key string")
    edges = spark.createDataFrame([("py:acme.Client", "py:acme.client.Client"), ("py:acme.api.C", "py:acme.Client")], "alias string, target string")
    refs = ["acme.client.Client", "acme.Client", "acme.api.C.connect", "connect", "Client.connect", "go", "a.go", "Client.gone", "acme.nowhere.f", "os.path", "word", "acme._x", "acme.Client.no"]
    got = {r.ref: (r.symbol_key, r.how) for r in resolve(spark.createDataFrame([(r,) for r in refs], "ref string"), symbols, edges).collect()}
    client = "py:acme.client.Client"
    assert got == {
        "acme.client.Client": (client, "exact"), "acme.Client": (client, "exact"), "acme.api.C.connect": (f"{client}.connect", "missing"), "connect": (f"{client}.connect", "ending"), "Client.connect": (f"{client}.connect", "ending"),
        "go": (None, "ambiguous"), "a.go": ("py:acme.a.go", "ending"), "Client.gone": (f"{client}.gone", "member"), "acme.nowhere.f": ("py:acme.nowhere.f", "missing"), "os.path": (None, "unknown"), "word": (None, "unknown"), "acme._x": (None, "hidden"),
        "acme.Client.no": (f"{client}.no", "missing"),
    }


def slots(spark, *rows):
    files = spark.createDataFrame(rows, "seq long, path string, content string")
    return {(r.symbol_key, r.aspect): (r.outcome, r.code_value, r.opened_seq) for r in reconcile(files).collect()}


#: A module's content, a name that a page mentions, and what comes of it.
CLOSURE = [
    ("def f(): pass\n", "f", ("corroborate", "true", None)),
    ("def f(): pass\n", "gone", ("contradict", "false", 1)),
    ("import os as osp\n", "osp", ("corroborate", "true", None)),
    ("from os import *\n", "gone", ("abstain", None, None)),
    ("globals()['x'] = 1\n", "gone", ("abstain", None, None)),
    ("class C(Base): pass\n", "C.gone", ("abstain", None, None)),
    ("class C:\n    def __init__(self): self.a = 1\n", "C.a", ("corroborate", "true", None)),
    ("class C:\n    def __init__(self): self.a = 1\n", "C.gone", ("contradict", "false", 1)),
    ("class C:\n    def __getattr__(self, n): return n\n", "C.gone", ("abstain", None, None)),
    ("def f(): pass\ndef f(): pass\n", "f", ("corroborate", "true", None)),
    ("def f(): pass\n", "f.inner", ("abstain", None, None)),
]


def test_missing_symbols_are_judged_by_what_is_above_them(spark):
    files = [(1, f"src/m{i}.py", module) for i, (module, _, _) in enumerate(CLOSURE)] + [(1, "README.md", " ".join(f"See `m{i}.{name}`." for i, (_, name, _) in enumerate(CLOSURE)))]
    got = slots(spark, *files)
    assert {i: got[f"py:m{i}.{name}", "exists"] for i, (_, name, _) in enumerate(CLOSURE)} == {i: outcome for i, (_, _, outcome) in enumerate(CLOSURE)}


def test_ancestors_count_as_of_each_commit(spark):
    closed, open_ = "x = 1\n", "from os import *\n"
    later = {
        "closes": ([(2, closed)], ("contradict", "false", 2)), "opens": ([(2, open_)], ("abstain", None, None)), "opens_then_closes": ([(2, open_), (3, closed)], ("contradict", "false", 3)),
        "goes": ([(2, None)], ("abstain", None, None)),  # a module that is gone closes nothing
        "comes_back": ([(2, open_), (4, "def f(): pass\n")], ("corroborate", "true", None)),
    }
    files = [(1, f"src/{m}.py", "def f(): pass\n") for m in later] + [(1, f"docs/{m}.md", f"See `{m}.f`.") for m in later] + [(seq, f"src/{m}.py", text) for m, (steps, _) in later.items() for seq, text in steps]
    silent = [(1, "src/q.py", "def f(): pass\n"), (1, "wiki/q.md", "`q.f`"), (2, "src/q.py", open_), (3, "wiki/q.md", "Nothing."), (4, "src/q.py", closed), (1, "src/late.py", closed), (5, "README.md", "See `late.f`.")]
    got = slots(spark, *files, *silent)
    assert {m: got[f"py:{m}.f", "exists"] for m in later} == {m: outcome for m, (_, outcome) in later.items()}
    assert ("py:q.f", "exists") not in got and got["py:late.f", "exists"] == ("contradict", "false", 5)


def test_pages_meet_code_through_two_hops(spark):
    code = [(1, "src/pkg/core.py", "def make(size: int = 3): pass\n"), (1, "src/pkg/api.py", "from .core import make as build\n"), (1, "src/pkg/__init__.py", "from .api import build\n")]
    page = "## `pkg.build`\n\n| Name | Type | Default |\n|---|---|---|\n| size | int | 4 |\n| ghost | int | |\n"
    got = slots(spark, *code, (2, "docs/use.md", page), (2, "docs/adr/0001.md", "We dropped `pkg.core.other`."), (2, "CHANGELOG.md", "## 1.0\n### Deprecated\n- `pkg.build`\n"))
    make = "py:pkg.core.make"
    assert {k: v for k, v in got.items() if k[0] == make} == {
        (make, "exists"): ("corroborate", "true", None), (make, "param.size.exists"): ("corroborate", "true", None), (make, "param.size.type"): ("corroborate", "int", None), (make, "param.size.default"): ("contradict", "3", 2),
        (make, "param.ghost.exists"): ("contradict", "false", 2), (make, "param.ghost.type"): ("abstain", None, None), (make, "deprecated"): ("contradict", "false", 2),
    }
    assert not any(k[0] == "py:pkg.core.other" for k in got)


EMIT = {"path": "b", "rank": 2, "kind": "function", "fields": "x"}


@pytest.mark.parametrize(
    ("state", "gone", "way", "owner"),
    [
        (State(), {}, "free", "b"), (State("function", True, "b", "x"), {}, "owner", "b"), (State("class", False, "a", "x"), {}, "removed", "b"), (State("class", True, "a", "x"), {"a": {"gone": "deleted", "hidden": False}}, "deleted", "b"),
        (State("class", True, "a", "x"), {"a": {"gone": "silent", "hidden": False}}, "silent", "b"), (State("attribute", True, "a", "x"), {}, "rank", "b"), (State("class", True, "a", "x"), {}, None, "a"), (State("class", True, "a", "x"), {"c": {"gone": "deleted", "hidden": False}}, None, "a"),
    ],
)
def test_ways_to_take_a_key_over(state, gone, way, owner):
    after, how, refused = decide(state, [EMIT], gone)
    assert (how, after.path, refused) == (way, owner, [] if way else ["b"]) and after.present
    assert decide(State("class", True, "a", "x"), [], {"a": {"gone": "deleted", "hidden": False}})[0] == State("class", False, "a", "x")
    assert decide(State("class", True, "a", "x"), [], {"a": {"gone": "silent", "hidden": True}})[0].present
    assert decide(State(), [EMIT, EMIT | {"path": "a", "rank": 1}], {})[2] == ["a"]
