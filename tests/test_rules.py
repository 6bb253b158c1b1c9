"""Rules on small inputs: types, extraction, histories, the order of what a commit does."""

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import types as Ty
from ledgerline.operators import history as H
from ledgerline.functions.scalars import canonical_version
from ledgerline.operators.extraction import code_facts, doc_claims, symbol_events
from ledgerline.operators.ownership import State
from ledgerline.operators.ordering import dense_number, queue_number, ranged, running_max
from ledgerline.operators.slots import DOCS, PROJECTOR, _Symbol, fold_slots, projected, withheld
from ledgerline.sources.docstrings import stated
from ledgerline.sources.python_source import definitions, read_definitions


@pytest.mark.parametrize(
    ("code", "doc", "differs"),
    [
        ("int", "int", False), ("int", "str", True), ("int | None", "int", True), ("None | int", "int | str", True), ("int", "float", False), ("float", "int", False),
        ("list[int]", "Iterable[int]", False), ("list[int]", "list[str]", True), ("Path", "str", False), ("pd.Frame", "int", False), ("Literal['a']", "str", False), ("Literal[1]", "str", True),
        ("Literal['a'] | bytes", "str", True), ("str", "Literal['a']", False), ("Literal[1.5]", "float", True), ("Literal['a']", "str | bytes", False), ("list[Literal['a']]", "list[int]", True),
        ("None", "int", True), ("int", "None | int", False), ("None | int", "None | float", False), ("None | int", "float", True), ("None | dict[str, int]", "Mapping", True), ("Mapping[Any, Any]", "dict", False),
        ("Callable", "Callable[[int], str]", False), ("list[mod.X]", "list[int]", False), ("bool | int", "bool", False), ("tuple[int, ...]", "Sequence[int]", False), ("dict", "dict[str, int]", False), ("None | str", "Any", False), ("not a type", "int", False), ("object", "str", False),
    ],
)
def test_provable_difference(code, doc, differs):
    assert Ty.differs_provably(code, doc) is differs


def test_sentinel_hides_a_missing_none():
    assert Ty.differs_provably("None | int", "int", False)
    assert not Ty.differs_provably("None | int", "int", True)


@pytest.mark.parametrize("text", ["Optional[Union[str, int]]", "typing.Dict[str, 'List[int]']", "Literal['b', 'a'] | None", "Callable[[int], str]", "x y  z"])
def test_canonical_type_is_a_fixed_point(text):
    once = Ty.annotation(text)
    assert Ty.annotation(once) == once


@pytest.mark.parametrize(("text", "canonical"), [("1.0", "1"), ("1e20", "1e+20"), ("True", "True"), ('"a"', "'a'"), ("(1, 2.0)", "(1, 2.0)"), ("f(1)", None), ("", None), (None, None)])
def test_canonical_literal(text, canonical):
    assert Ty.literal(text) == canonical


SOURCE = '''
import warnings
from typing import overload

class Open(Base):
    def m(self, a, b=1.0, *args, k: "Optional[int]" = None, **kw) -> "List[str]":
        """Do it.

        Args:
            a: First. Defaults to 3.
            b (float, optional): Second, default 1.
            k (int): Third.
            *args: More.

        Raises:
            ValueError: Never.
        """
        if a:
            raise ValueError(a)

class Shut:
    x = 1
    @property
    def p(self): return 1
    @staticmethod
    def s(a): raise err

def twice(): pass
def twice(): pass

def _private(): pass

def old(n):
    """:param n: A number, default 5.
    :rtype: int
    """
    warnings.warn("deprecated", DeprecationWarning)
'''


def _facts(spark, source, path="src/pkg/mod.py"):
    found = read_definitions(spark.createDataFrame([(1, path, source)], "seq long, path string, content string"))
    code = {(r.symbol_key, r.aspect): r.value for r in code_facts(found).collect()}
    docs = {(r.symbol_key, r.aspect): r.value for r in doc_claims(found).collect()}
    return code, docs


def test_extraction(spark):
    code, docs = _facts(spark, SOURCE)
    m, old = "py:pkg.mod.Open.m", "py:pkg.mod.old"
    assert code[m, "param_names"] == '["a","b","*args","k","**kw"]'
    assert code[m, "param.b.default"] == "1" and code[m, "param.k.type"] == "None | int" and code[m, "returns.type"] == "list[str]"
    assert code[m, "raises.ValueError"] == "true" and (m, "param.a.default") not in code
    assert code["py:pkg.mod.twice", "kind"] == "ambiguous" and ("py:pkg.mod._private", "exists") not in code
    assert code["py:pkg.mod.Open", "namespace_closed"] == "false" and code["py:pkg.mod.Shut", "namespace_closed"] == "true"
    assert ("py:pkg.mod.Shut.p", "param_names") not in code and code["py:pkg.mod.Shut.s", "param_names"] == '["a"]'
    assert code[old, "deprecated"] == "true" and code[m, "deprecated"] == "false"
    assert docs[m, "param.a.default"] == "3" and docs[m, "param.b.type"] == "None | float" and docs[m, "param.k.type"] == "int" and docs[m, "raises.ValueError"] == "true"
    assert docs[old, "param.n.default"] == "5" and docs[old, "returns.type"] == "int"
    assert not any(a.startswith("param.*") for _, a in docs)


def test_unparsable_sources_state_nothing(spark):
    assert _facts(spark, "def f(:\n") == ({}, {})
    assert _facts(spark, "x = 1", "docs/readme.md") == ({}, {})
    assert definitions("from a import *\n")[0]["closed"] is False


def test_projection_abstains_where_it_cannot_know():
    fields = {"param_names": '["a","**kw"]', "param.a.default": "1"}
    assert projected("param.a.exists", fields) == "true" and projected("param.kw.exists", fields) == "true"
    assert projected("param.b.exists", fields) is None and projected("param.b.exists", {"param_names": '["a"]'}) == "false"
    assert projected("param.a.default", None) is None


def _commit(symbol, seq, default, documented):
    symbol.commit(seq, {DOCS: {("param.a.default", documented)}}, State("function", True, "src/m.py", {"param_names": '["a"]', "param.a.default": default}))


def test_code_and_docs_fixed_together_agree():
    s = _Symbol()
    _commit(s, 1, "1", "1")
    _commit(s, 2, "2", "2")
    assert not s.open and {c[2] for c in s.claims} == {"2"}


def test_a_party_cannot_retract_from_an_open_dispute():
    s = _Symbol()
    _commit(s, 1, "1", "2")
    assert s.open == {"param.a.default": 1}
    _commit(s, 2, "1", "1")
    assert s.open == {"param.a.default": 1} and s.deferred == {"param.a.default": 1}
    assert (DOCS, "param.a.default", "2") in s.claims and (f"{PROJECTOR}:src/m.py", "param.a.default", "1") in s.claims


def test_a_type_is_withheld_only_for_a_sentinel_of_the_code():
    stated = {"param.a.default": {"5"}, "param.a.type": {"int"}}
    fields = {"param_names": '["a"]', "param.a.type": "None | int", "param.a.default": "5"}
    assert not withheld("param.a.type", "None | int", stated, fields)
    assert withheld("param.a.type", "None | int", stated, fields | {"param.a.default": "None"})
    assert not withheld("param.a.type", "None | int", {"param.a.type": {"int"}}, fields | {"param.a.default": "None"})


def _events(spark, *rows):
    files = spark.createDataFrame(rows, "seq long, path string, content string")
    return symbol_events(read_definitions(files.where("content is not null")), files.select("seq", "path"))


DOCUMENTED = 'def f(a: int = {}):\n    """F.\n\n    Args:\n        a (int): A. Defaults to {}.\n    """\n'


def test_removed_files_and_definitions_retract_and_unreadable_ones_keep(spark):
    good = DOCUMENTED.format(1, 1)
    rows = [(1, p, good) for p in ("src/m/a.py", "src/m/b.py", "src/m/c.py", "src/m/d.py")]
    rows += [(2, "src/m/a.py", None), (2, "src/m/b.py", "x = 1\n"), (2, "src/m/c.py", "def f(:\n"), (3, "src/m/c.py", "def f(:\n"), (2, "src/m/d.py", "def f(:\n"), (3, "src/m/d.py", None)]
    out = {(r.symbol_key, r.aspect): r.outcome for r in fold_slots(_events(spark, *rows)).collect()}
    assert {k for k, _ in out} == {"py:m.c.f"} and out["py:m.c.f", "param.a.default"] == "corroborate"


def test_a_symbol_that_moves_in_one_commit_stays(spark):
    good = DOCUMENTED.format(1, 1)
    out = _events(spark, (1, "src/m.py", good), (2, "src/m.py", None), (2, "lib/src/m.py", good)).where("symbol_key = 'py:m.f'").orderBy("seq").collect()
    assert [(r.path, r.fields is None) for r in out] == [("src/m.py", False), ("lib/src/m.py", False)]


def test_a_dispute_outlives_the_symbol(spark):
    out = fold_slots(_events(spark, (1, "src/m.py", DOCUMENTED.format(1, 2)), (2, "src/m.py", None))).collect()
    assert [(r.aspect, r.outcome, r.deferred) for r in out] == [("param.a.default", "contradict", 2)]


def test_many_commits_of_one_symbol_are_folded_in_order(spark):
    rows = [(k, "src/m.py", DOCUMENTED.format(k, k)) for k in range(1, 300)]
    assert {(r.aspect, r.outcome, r.code_value) for r in fold_slots(_events(spark, *rows)).collect()} == {("param.a.default", "corroborate", "299"), ("param.a.exists", "corroborate", "true"), ("param.a.type", "corroborate", "int")}


CLASSES = """
import functools
import os.path as osp
from typing import *

def forward(fn):
    @functools.wraps(fn)
    def inner(*args): return fn(*args)
    return inner

@forward
def kept(a): pass

@other
def opaque(a): pass

class Old:
    def __init__(self):
        warn("Old is deprecated")

class Late:
    def __init__(self):
        self.a = 1
        warn("deprecated")

class Fine: pass

class Sets:
    def __init__(self): setattr(self, "c", 1)

class Dicts:
    def m(me): me.__dict__["a"] = 1

@decorated
class Dressed: pass

@final
class Final: pass

class Filled:
    locals()["x"] = 1

class Members:
    a = 1
    def m(self):
        self.b, other = 1, 2
    def a(self): pass

class Twice: pass
class Twice:
    def lost(self): pass

def again(): pass
again = 1
"""


def test_closure_deprecation_and_bound_names(spark):
    code, _ = _facts(spark, CLASSES)
    at = lambda name, aspect: code.get((f"py:pkg.mod.{name}", aspect))
    assert at("kept", "param_names") == '["a"]' and at("opaque", "param_names") is None
    assert at("Old", "deprecated") == "true" and at("Late", "deprecated") is None and at("Fine", "deprecated") == "false"
    assert [at(c, "namespace_closed") for c in ("Fine", "Final", "Sets", "Dicts", "Dressed", "Filled")] == ["true", "true", "false", "false", "false", "false"]
    assert at("Members.a", "kind") == "attribute" and at("Members.a", "param_names") is None and at("Members.b", "kind") == "attribute" and at("Members.other", "kind") is None
    assert at("Twice", "kind") == "ambiguous" and at("Twice.lost", "exists") is None
    assert at("again", "kind") == "attribute" and at("osp", "kind") == "attribute" and at("functools", "kind") == "attribute" and ("py:pkg.mod", "namespace_closed") in code
    assert code["py:pkg.mod", "namespace_closed"] == "false"


NUMPY = """Do.

Parameters
----------
a, b : int, optional
    Both. Default is 4.
c : {'x', 'y'} or None, default 'x'
    One of them.
d
    No type.
bare
kinds : array-like
    Not a type.
*args : int
    Never claimed.

Returns
-------
bool
    Whether.

Raises
------
KeyError
    Often.
"""
GOOGLE = """Do.

Args:
    a (int, optional): First,
        which defaults to `7`.
    self: The receiver.

Returns:
    dict[str, int]: Counts.

Raises:
    os.Error: If so.
"""
SPHINX = """Do.

.. deprecated:: 1.2
   Use other.

:param str a: Text.
:param b: Number; the default
    is 3.
:type b: int, optional
:param c: Other.
:rtype: list[int]
:raises ValueError: Never.
"""


@pytest.mark.parametrize(
    ("text", "claims"),
    [
        (NUMPY, {"param.a.exists": "true", "param.a.type": "None | int", "param.a.default": "4", "param.b.exists": "true", "param.b.type": "None | int", "param.b.default": "4", "param.c.exists": "true", "param.c.default": "'x'",
                 "param.d.exists": "true", "param.kinds.exists": "true", "returns.type": "bool", "raises.KeyError": "true"}),
        (GOOGLE, {"param.a.exists": "true", "param.a.type": "None | int", "param.a.default": "7", "returns.type": "dict[str, int]", "raises.os.Error": "true"}),
        (SPHINX, {"deprecated": "true", "param.a.exists": "true", "param.a.type": "str", "param.b.exists": "true", "param.b.type": "None | int", "param.b.default": "3", "param.c.exists": "true", "returns.type": "list[int]", "raises.ValueError": "true"}),
        ("Do.\n\nReturns:\n    value: The value.\n", {}), ("Do.\n\n.. deprecated:: 1\n   Passing x is old.\n", {}), ("Do.\n\nArgs:\n    a (int): One.\n    a (str): Two.\n", {"param.a.exists": "true"}),
        ("Do.\n\nReturns\n-------\na : int\nb : str\n", {}), ("", {}), (None, {}),
    ],
)
def test_docstring_styles(text, claims):
    assert {c.aspect: c.value for c in stated(text, {"self"})} == claims


def test_classes_claim_deprecation_alone():
    assert [c.aspect for c in stated(SPHINX, None)] == ["deprecated"]


@pytest.mark.parametrize(("text", "version"), [("1.0-rc1+local", None), ("v1.2", "1.2"), ("\t2.0\n", "2.0"), ("1.2+local.7", "1.2+local.7"), ("latest", None), ("1..2", "1..2"), ("1-", None)])
def test_versions(spark, text, version):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(canonical_version(F.col("t"))).first()[0] == version


def test_windows_and_as_of(spark):
    rows = [(1, "a", 1, 1), (1, "a", 2, 2), (1, None, 3, 3), (1, "a", 4, 4), (2, None, 1, 5), (2, "b", 1, 6)]
    facts = spark.createDataFrame(rows, "key long, value string, at long, tie long")
    out = H.windows(facts)
    assert {tuple(r) for r in out.select("key", "value", "valid_from", "valid_to").collect()} == {(1, "a", 1, 3), (1, "a", 4, None), (2, "b", 1, None)}
    assert [r.key for r in H.as_of(out, F.lit(3)).collect()] == [2]
    assert H.windows(facts.limit(0)).count() == 0


@pytest.mark.parametrize("spread", [1, 3, 1 << 40])
def test_global_numbers_over_dense_and_sparse_keys(spark, spread):
    df = spark.range(0, 200).select((F.col("id") * spread).alias("id")).withColumn("v", F.pmod(F.xxhash64("id"), F.lit(1000))).repartition(5)
    rows = sorted((r.id, r.n, r.top, r.v, r.past) for r in running_max(running_max(dense_number(df, "id", "n"), "id", "v", "top"), "id", "v", "past", inclusive=False).collect())
    assert [r[1] for r in rows] == list(range(1, len(rows) + 1))
    assert all(r[2] == max(x[3] for x in rows[: i + 1]) and r[4] == (max(x[3] for x in rows[:i]) if i else None) for i, r in enumerate(rows))


def test_a_queue_of_keys_that_share_a_beginning_is_dealt_out(spark):
    df = spark.range(0, 5000).select(F.concat(F.lit("py:one.very.long.common.beginning.f"), "id").alias("key"), (F.col("id") % 3).alias("score")).repartition(5)
    rows = sorted((r.n, -r.score, r.key) for r in queue_number(df, "score", "key", "n").collect())
    assert [r[0] for r in rows] == list(range(1, 5001)) and [r[1:] for r in rows] == sorted(r[1:] for r in rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows share a task
    try:
        assert ranged(df, F.desc("score"), "key").groupBy("_range").count().agg(F.max("count")).first()[0] < 2500
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert ranged(df.limit(0), "key").count() == 0 and queue_number(df.limit(0), "score", "key", "n").count() == 0


def test_what_was_known_when(spark):
    facts = spark.createDataFrame([(1, "a", 1, 1, 1), (1, "b", 5, 2, 9), (1, None, 6, 3, 7), (1, "c", 20, 4, 20), (2, None, 1, 5, 1)], "key long, value string, at long, tie long, known long")
    out = {tuple(r) for r in H.bitemporal_windows(facts).select("value", "valid_from", "valid_to", "known_from", "known_to").collect()}
    assert out == {("a", 1, None, 1, 9), ("a", 1, 5, 9, None), ("b", 5, 6, 9, None), ("c", 20, None, 20, None)}
    asks = spark.createDataFrame([(i, 1, k, a) for i, (k, a) in enumerate([(0, 9), (8, 9), (9, 5), (9, 9), (30, 3), (30, 0), (19, 25), (20, 25)])] + [(99, 3, 1, 1)], "ask_id long, key long, known long, at long")
    assert {r.ask_id: r.value for r in H.known_about(facts, asks).collect()} == {0: None, 1: "a", 2: "b", 3: None, 4: "a", 5: None, 6: None, 7: "c", 99: None}
