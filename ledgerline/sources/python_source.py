"""Definitions of Python files as rows; the code is parsed, never run.

A small helper lists what the syntax tree says of each name that a file
defines, once for each name. All rules on top of that (trust in signatures,
deprecation, facts, claims) are column expressions in ``operators.extraction``.
"""

from __future__ import annotations

import ast
import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ledgerline.functions.types import annotation, literal
from ledgerline.sources.docstrings import stated

#: Calls by which a namespace may gain names that no one sees, and methods and calls that do so for a class.
NAMESPACE_CALLS = ("globals", "vars", "locals", "exec", "eval")
OPEN_METHODS = {"__getattr__", "__getattribute__"}
RECEIVER_CALLS = {"setattr", "delattr", "vars"}
#: Class decorators that add no member.
CLOSED_DECORATORS = {"final", "runtime_checkable", "deprecated", "type_check_only"}
#: Contents whose definitions a worker remembers.
REMEMBERED = 2048
#: Stands for a decorator of the same file that wraps with ``wraps``, and so keeps the signature.
FORWARDING = "wraps"
DEFINITION = (
    "path string, analyzed boolean, name string, parent string, kind string, line_start int, line_end int, decorators array<string>, names array<string>, defaults array<string>, "
    "types array<string>, returns string, raises array<string>, notices int, leading_notice boolean, closed boolean, claims array<struct<aspect:string,value:string,confidence:double>>, "
    "imports array<struct<name:string,level:int,module:string,attr:string>>"
)
_FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)
_HIDING = (*_FUNCTION, ast.Lambda, ast.ClassDef)
_COMPREHENSION = (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)


def _dotted(node: ast.expr) -> str:
    node = node.func if isinstance(node, ast.Call) else node
    return ast.unparse(node) if isinstance(node, (ast.Name, ast.Attribute)) else ""


def _last(node: ast.expr) -> str:
    return _dotted(node).split(".")[-1]


def _inner(node: ast.AST, hiding: tuple = _HIDING) -> Iterator[ast.AST]:
    """Nodes below ``node`` that run with it, without the bodies of ``hiding`` nodes."""
    for child in ast.iter_child_nodes(node):
        yield child
        if not isinstance(child, hiding):
            yield from _inner(child, hiding)


def _scope(body: list[ast.stmt]) -> Iterator[ast.AST]:
    """What runs in a namespace: of a definition its decorators, bases and defaults, not its body."""
    for node in body:
        yield node
        if isinstance(node, _HIDING):
            heads = [*getattr(node, "decorator_list", []), *getattr(node, "bases", []), *(k.value for k in getattr(node, "keywords", []))]
            heads += [*node.args.defaults, *(d for d in node.args.kw_defaults if d)] if hasattr(node, "args") else []
            yield from _scope(heads)
        elif not isinstance(node, _COMPREHENSION):
            yield from _scope(list(ast.iter_child_nodes(node)))


def bound_names(body: list[ast.stmt]) -> dict[str, int]:
    """Names that a namespace binds without defining them, with the line where each is first bound."""
    found: dict[str, int] = {}
    for node in _scope(body):
        match node:
            case ast.Name(id=name, ctx=ast.Store()) | ast.ExceptHandler(name=str(name)) | ast.MatchAs(name=str(name)) | ast.MatchStar(name=str(name)) | ast.MatchMapping(rest=str(name)):
                names = [name]
            case ast.Import(names=aliases):
                names = [a.asname or a.name.split(".")[0] for a in aliases]
            case ast.ImportFrom(names=aliases):
                names = [a.asname or a.name for a in aliases if a.name != "*"]
            case _:
                continue
        for n in names:
            found.setdefault(n, node.lineno)
    return found


def imported_names(body: list[ast.stmt]) -> list[dict]:
    """Names that a module binds by importing them: the name, and where from (``level`` dots, a module, a name in it)."""
    found = []
    for node in _scope(body):
        if isinstance(node, ast.ImportFrom):
            found += [{"name": a.asname or a.name, "level": node.level, "module": node.module, "attr": a.name} for a in node.names if a.name != "*"]
        elif isinstance(node, ast.Import):
            found += [{"name": a.asname, "level": 0, "module": a.name, "attr": None} for a in node.names if a.asname]
    return found


def _warns(call: ast.AST) -> bool:
    """Whether a call is a deprecation notice: by the callee's name, by what it says, or by the warning's category."""
    if not isinstance(call, ast.Call):
        return False
    said = [x.value.lower() for a in call.args[:1] for x in ast.walk(a) if isinstance(x, ast.Constant) and isinstance(x.value, str)]
    category = [*call.args[1:2], *(k.value for k in call.keywords if k.arg == "category")][:1]
    warning = _last(call) == "warn" and any(_last(c) in ("DeprecationWarning", "PendingDeprecationWarning") for c in category)
    return warning or "deprecat" in _last(call).lower() or "deprecat" in "".join(said)


def _notices(function: ast.AST | None) -> dict:
    """How many notices a function holds, and whether it starts with one."""
    if function is None:
        return {"notices": 0, "leading_notice": False}
    first = next((s for s in function.body if not isinstance(s, (ast.Import, ast.ImportFrom)) and not (isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant))), None)
    return {"notices": sum(map(_warns, ast.walk(function))), "leading_notice": isinstance(first, ast.Expr) and _warns(first.value)}


def _fills(body: list[ast.stmt]) -> bool:
    """Whether a namespace may be filled by a call while it is made; class bodies inside run with it."""
    return any(isinstance(x, ast.Call) and _last(x) in NAMESPACE_CALLS or isinstance(x, ast.ClassDef) and _fills(x.body) for x in _scope(body))


def _function(node: ast.FunctionDef | ast.AsyncFunctionDef, in_class: bool) -> dict:
    a = node.args
    plain = [*a.posonlyargs, *a.args]
    values = [None] * (len(plain) - len(a.defaults)) + list(a.defaults)
    rows = [(x.arg, x, d) for x, d in zip(plain, values)]
    receivers = {"self", "cls"} if in_class else set()
    if in_class and rows and "staticmethod" not in map(_last, node.decorator_list):
        receivers.add(rows.pop(0)[0])
    rows += [("*" + a.vararg.arg, None, None)] if a.vararg else []
    rows += [(x.arg, x, d) for x, d in zip(a.kwonlyargs, a.kw_defaults)]
    rows += [("**" + a.kwarg.arg, None, None)] if a.kwarg else []
    raised = {_dotted(x.exc) for s in node.body if not isinstance(s, _HIDING) for x in [s, *_inner(s)] if isinstance(x, ast.Raise) and x.exc is not None}
    return _notices(node) | {
        "names": [n for n, _, _ in rows],
        "defaults": [literal(ast.unparse(d)) if d is not None else None for _, _, d in rows],
        "types": [annotation(ast.unparse(x.annotation)) if x is not None and x.annotation else None for _, x, _ in rows],
        "returns": annotation(ast.unparse(node.returns)) if node.returns else None,
        "raises": sorted(x for x in raised if x.split(".")[-1][:1].isupper()),
        "claims": stated(ast.get_docstring(node), receivers),
    }


def _receiver_use(method: ast.AST) -> tuple[dict[str, int], bool]:
    """Attributes that a method stores on its receiver, and whether it may add some by name."""
    params = [*method.args.posonlyargs, *method.args.args]
    if not params or "staticmethod" in map(_last, method.decorator_list):
        return {}, False
    me, stored, opens = params[0].arg, {}, False
    for node in ast.walk(method):
        match node:
            case ast.Attribute(value=ast.Name(id=name), attr=attr, ctx=ast.Store()) if name == me:
                stored.setdefault(attr, node.lineno)
            case ast.Attribute(value=ast.Name(id=name), attr="__dict__") if name == me:
                opens = True
            case ast.Call(func=ast.Name(id=called), args=[ast.Name(id=name), *_]) if name == me and called in RECEIVER_CALLS:
                opens = True
    return stored, opens


def _class(node: ast.ClassDef) -> tuple[dict, dict[str, int]]:
    """A class's row, and the names that it binds without defining them."""
    methods = [x for x in _scope(node.body) if isinstance(x, _FUNCTION)]
    bound, uses = bound_names(node.body), [_receiver_use(m) for m in methods]
    for stored, _ in uses:
        bound = stored | bound
    header = not node.keywords and all(isinstance(b, ast.Name) and b.id == "object" for b in node.bases) and {*map(_last, node.decorator_list)} <= CLOSED_DECORATORS
    closed = header and not _fills(node.body) and not OPEN_METHODS & {m.name for m in methods} and not any(opens for _, opens in uses)
    init = next((m for m in node.body if isinstance(m, _FUNCTION) and m.name == "__init__"), None)
    return _notices(init) | {"closed": closed, "claims": stated(ast.get_docstring(node), None)}, bound


def definitions(content: str | bytes) -> list[dict] | None:
    """The module and the names that it defines or binds, a row for each; None for content that doesn't parse."""
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    star = any(isinstance(x, ast.ImportFrom) and any(n.name == "*" for n in x.names) for x in _inner(tree))
    functions = [x.name for x in tree.body if isinstance(x, _FUNCTION)]
    modules = any(isinstance(x, ast.Subscript) and ast.unparse(x.value) == "sys.modules" for x in _inner(tree))
    shut = not (star or modules or "__getattr__" in functions or _fills(tree.body) or any(isinstance(x, ast.Global) for x in ast.walk(tree)))
    lines = content.count(b"\n" if isinstance(content, bytes) else "\n")
    forwarding = {f.name for f in ast.walk(tree) if isinstance(f, _FUNCTION) for g in ast.walk(f) if g is not f and isinstance(g, _FUNCTION) and "wraps" in map(_last, g.decorator_list)}
    found: list[dict] = []
    scopes = {"": bound_names(tree.body)}

    def visit(body: list[ast.stmt], parent: str, in_class: bool) -> None:
        for node in body:
            if isinstance(node, (*_FUNCTION, ast.ClassDef)):
                decorators = [FORWARDING if d in forwarding else d for d in map(_last, node.decorator_list)]
                row = {"name": f"{parent}.{node.name}".lstrip("."), "parent": parent, "line_start": node.lineno, "line_end": node.end_lineno, "decorators": decorators}
                if isinstance(node, ast.ClassDef):
                    more, scopes[row["name"]] = _class(node)
                    found.append(row | {"kind": "class"} | more)
                    visit(node.body, row["name"], True)
                elif "overload" not in decorators:
                    found.append(row | {"kind": "method" if in_class else "function"} | _function(node, in_class))
            elif isinstance(node, (ast.If, ast.With, ast.AsyncWith, ast.For, ast.AsyncFor, ast.While, ast.Try)):
                for part in ("body", "orelse", "finalbody"):
                    visit(getattr(node, part, []), parent, in_class)
                for handler in getattr(node, "handlers", []):
                    visit(handler.body, parent, in_class)

    visit(tree.body, "", False)
    times = Counter(d["name"] for d in found)
    bare = lambda d, kind: {k: d[k] for k in ("name", "parent", "line_start", "line_end")} | {"kind": kind}
    out = {"": {"name": "", "parent": "", "kind": "module", "line_start": 1, "line_end": max(1, lines), "decorators": [], "closed": shut, "imports": imported_names(tree.body) or None}}
    classes = {""} | {d["name"] for d in found if d["kind"] == "class" and times[d["name"]] == 1 and d["name"].split(".")[-1] not in scopes.get(d["parent"], {})}
    classes = {c for c in classes if all(".".join(c.split(".")[:k]) in classes for k in range(1, c.count(".") + 1))}
    for d in found:  # members of a class that is defined twice or bound anew aren't told apart
        if d["parent"] in classes and d["name"] not in out:
            rebound = d["name"].split(".")[-1] in scopes[d["parent"]]
            out[d["name"]] = bare(d, "ambiguous") if times[d["name"]] > 1 else bare(d, "attribute") if rebound else d
    for parent in classes:
        for name, line in scopes[parent].items():
            key = f"{parent}.{name}".lstrip(".")
            out.setdefault(key, {"name": key, "parent": parent, "kind": "attribute", "line_start": line, "line_end": line})
    return list(out.values())


def read_definitions(sources: DataFrame, key: str = "seq") -> DataFrame:
    """A row per module and name of ``sources`` (``key``, ``path``, ``content``), partition by partition, without a shuffle.

    ``key`` is a commit's number or what tells contents apart. Content that a worker has just parsed isn't parsed again. Content that
    doesn't parse gives one row that isn't ``analyzed``; null content gives none.
    """
    schema = StructType([sources.schema[key], *StructType.fromDDL(DEFINITION)])
    kinds = to_arrow_schema(schema)

    def parsed(content: str | bytes) -> list[dict]:
        found = definitions(content)
        return [{"analyzed": False}] if found is None else [d | {"analyzed": True, "claims": [c._asdict() for c in d["claims"]] if d.get("claims") else None} for d in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, list[dict]] = {}
        for batch in batches:
            rows = []
            for seq, path, content in zip(*(c.to_pylist() for c in batch.columns)):
                if content is None:
                    continue
                digest = hashlib.blake2b(content if isinstance(content, bytes) else content.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                if digest not in known:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[digest] = parsed(content)
                rows += [d | {key: seq, "path": path} for d in known[digest]]
            columns = [pa.array([r.get(f.name) for r in rows], f.type) for f in kinds]
            yield pa.RecordBatch.from_arrays(columns, kinds.names)

    return sources.select(key, "path", "content").mapInArrow(run, schema)
