"""Edits of Python sources, by spans of the text: what surrounds a span stays as it is, byte for byte.

Each edit names a function and what to change. Its result is parsed again, and for docstrings read again: an edit that doesn't lead to just
what was wanted (the claims of the docstring, changed in one aspect, or the same) is none, and gives None.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

from ledgerline.functions.scalars import DEFAULT_PHRASE
from ledgerline.functions.types import alternatives, annotation, literal
from ledgerline.sources.docstrings import stated

_FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)


class Source:
    """A text with its tree, and the places of nodes as offsets of characters; columns of the parser count bytes."""

    def __init__(self, text: str):
        self.text, self.tree = text, ast.parse(text)
        self.lines = text.splitlines(keepends=True)
        self.starts = [0]
        for line in self.lines:
            self.starts.append(self.starts[-1] + len(line))

    def offset(self, line: int, column: int) -> int:
        return self.starts[line - 1] + len(self.lines[line - 1].encode()[:column].decode())

    def span(self, node: ast.AST) -> tuple[int, int]:
        return self.offset(node.lineno, node.col_offset), self.offset(node.end_lineno, node.end_col_offset)

    def replaced(self, start: int, end: int, text: str) -> str:
        return self.text[:start] + text + self.text[end:]

    def function(self, name: str) -> ast.AST | None:
        """The function of a dotted name; None if there isn't just one."""
        found: list[tuple[str, ast.AST]] = []

        def walk(body: list[ast.stmt], within: str) -> None:
            for node in body:
                if isinstance(node, (*_FUNCTION, ast.ClassDef)):
                    found.append((f"{within}{node.name}", node))
                    if isinstance(node, ast.ClassDef):
                        walk(node.body, f"{within}{node.name}.")

        walk(self.tree.body, "")
        same = [node for full, node in found if full == name]
        return same[0] if len(same) == 1 and isinstance(same[0], _FUNCTION) else None


def other_literal(value: str) -> str | None:
    """Another value of the same kind as a canonical literal."""
    try:
        known = ast.literal_eval(value)
    except (ValueError, SyntaxError):
        return None
    match known:
        case bool():
            return repr(not known)
        case int():
            return repr(known + 7)
        case float():
            return repr(known + 1.5)
        case str():
            return repr(known + "_x")
        case None:
            return "0"
    return None


def other_type(kind: str) -> str:
    """A plain type that a canonical one doesn't have among its members."""
    there = {ast.unparse(x) for x in alternatives(ast.parse(kind, mode="eval").body)}
    return next(t for t in ("str", "int", "bytes") if t not in there)


def _arguments(node: ast.AST) -> dict[str, tuple[ast.arg, ast.expr | None]]:
    a = node.args
    plain = [*a.posonlyargs, *a.args]
    pairs = [*zip(plain, [None] * (len(plain) - len(a.defaults)) + list(a.defaults)), *zip(a.kwonlyargs, a.kw_defaults)]
    return {x.arg: (x, d) for x, d in pairs}


def has_stars(node: ast.AST) -> bool:
    return node.args.vararg is not None or node.args.kwarg is not None


class _Docstring:
    """A function's docstring as it is written, between plain triple quotes."""

    def __init__(self, source: Source, node: ast.AST, name: str):
        self.source, self.node, self.name = source, node, name
        first = node.body[0]
        self.start = self.end = None
        if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
            start, end = source.span(first.value)
            if source.text[start : start + 3] == source.text[end - 3 : end] == '"""':
                self.start, self.end = start + 3, end - 3

    @property
    def raw(self) -> str:
        return self.source.text[self.start : self.end]

    def claims(self, text: str | None = None) -> dict[str, str]:
        tree = self.node if text is None else Source(text).function(self.name)
        return {c.aspect: c.value for c in stated(ast.get_docstring(tree), set())} if tree is not None else {}


def _first_fit(doc: _Docstring, tries: Iterator[tuple[int, int, str]], fits: Callable[[dict[str, str], dict[str, str]], bool]) -> str | None:
    """The first of replacements (start, end, text) in a docstring after which its claims are those wanted."""
    before = doc.claims()
    for start, end, text in tries:
        edited = doc.source.replaced(doc.start + start, doc.start + end, text)
        try:
            after = doc.claims(edited)
        except (SyntaxError, ValueError):
            continue
        if fits(before, after):
            return edited
    return None


def _changed(aspect: str, values: set[str]) -> Callable[[dict, dict], bool]:
    return lambda before, after: after.get(aspect) in values and {k: v for k, v in after.items() if k != aspect} == {k: v for k, v in before.items() if k != aspect}


def _added(aspects: set[str]) -> Callable[[dict, dict], bool]:
    return lambda before, after: before.items() <= after.items() and aspects <= after.keys() - before.keys()


def _types_of(raw: str, param: str | None) -> Iterator[tuple[int, int]]:
    """Where a docstring may write the type of a parameter, or of the result."""
    if param is None:
        forms = (r":rtype:[ ]*([^\n]+)", r"(?m)^[ ]*returns?:[ ]*\n[ ]+([^\n:]+):", r"(?m)^[ ]*returns[ ]*\n[ ]*-{3,}[ ]*\n[ ]*(?:\w+[ ]*:[ ]*)?([^\n]+)$")
    else:
        p = re.escape(param)
        forms = (rf"(?m)^[ ]*{p}[ ]*\(([^)\n]*)\)[ ]*:", rf"(?m)^[ ]*{p}[ ]*:[ ]*([^\n]+)$", rf":type[ ]+{p}:[ ]*([^\n]+)", rf":(?:param|parameter|arg|argument)[ ]+([^\n:]+?)[ ]+{p}:")
    for form in forms:
        for m in re.finditer(form, raw, re.I):
            yield m.span(1)


def _entries_of(raw: str) -> Iterator[tuple[int, str]]:
    """Where parameters of a docstring begin, with what a new one before them looks like."""
    for m in re.finditer(r"(?m)^([ ]*)[A-Za-z_]\w*[ ]*(?:\([^)\n]*\))?:[ ]", raw):
        yield m.start(), f"{m[1]}{{name}} (int): Seeded.\n"
    for m in re.finditer(r"(?m)^([ ]*)[A-Za-z_]\w*(?:[ ]*:[ ]*[^\n]+)?$", raw):
        yield m.start(), f"{m[1]}{{name}} : int\n{m[1]}    Seeded.\n"
    for m in re.finditer(r"(?m)^([ ]*):param\b", raw):
        yield m.start(), f"{m[1]}:param int {{name}}: Seeded.\n"


def edit(text: str, name: str, category: str, aspect: str, value: str, claimed: set[str], ghost: str) -> dict | None:
    """``content`` after an edit of function ``name``, and what it makes of which ``aspect``: ``code`` and ``docs`` (None where nothing).

    ``aspect`` and ``value`` are what code and docstring agree on; ``claimed`` are all aspects that the docstring states; ``ghost`` is a
    name that nothing has. None where the edit doesn't apply.
    """
    try:
        source = Source(text)
        node = source.function(name)
        if node is None:
            return None
        found = _edited(source, node, name, category, aspect, value, claimed, ghost)
        if found is None or found["content"] == text:
            return None
        ast.parse(found["content"])
        return found
    except (SyntaxError, ValueError, RecursionError, MemoryError, UnicodeDecodeError):
        return None


def _edited(source: Source, node: ast.AST, name: str, category: str, aspect: str, value: str, claimed: set[str], ghost: str) -> dict | None:
    facet = aspect.split(".")[-1]
    param = aspect.split(".")[1] if aspect.startswith("param.") else None
    arguments = _arguments(node)
    argument, default = arguments.get(param, (None, None))
    doc = _Docstring(source, node, name)
    made = lambda content, code=None, docs=None, at=aspect: None if content is None else {"content": content, "aspect": at, "code": code, "docs": docs}
    put = lambda target, text: source.replaced(*source.span(target), text)

    match category:
        case "code_default" if facet == "default" and default is not None and (new := other_literal(value)):
            return made(put(default, new), literal(new), value)
        case "code_param_type" if facet == "type" and argument is not None and argument.annotation is not None:
            new = other_type(value)
            return made(put(argument.annotation, new), new, value)
        case "code_return_type" if aspect == "returns.type" and node.returns is not None:
            new = other_type(value)
            return made(put(node.returns, new), new, value)
        case "code_param_renamed" if facet == "exists" and argument is not None and not has_stars(node):
            start, _ = source.span(argument)
            return made(source.replaced(start, start + len(param), ghost), "false", "true")
        case "raise_removed" if aspect.startswith("raises."):
            for x in ast.walk(node):
                if isinstance(x, ast.Raise) and x.exc is not None and ast.unparse(x.exc.func if isinstance(x.exc, ast.Call) else x.exc) == aspect[7:]:
                    return made(put(x, "pass"))
        case "function_added":
            return made(source.text.rstrip("\n") + f"\n\n\ndef {ghost}():\n    return None\n")
        case "undocumented_default_changed":
            for other, (_, d) in arguments.items():
                if d is not None and f"param.{other}.default" not in claimed and (known := literal(ast.unparse(d))) and (new := other_literal(known)):
                    return made(put(d, new))
        case "undocumented_type_changed":
            for other, (a, _) in arguments.items():
                if a.annotation is not None and f"param.{other}.type" not in claimed and (known := annotation(ast.unparse(a.annotation))):
                    return made(put(a.annotation, other_type(known)))
    if doc.start is None:
        return None
    line = source.text.rfind("\n", 0, doc.start) + 1
    indent = re.match(r"[ \t]*", source.text[line:])[0]
    after = source.text.find("\n", doc.end)
    match category:
        case "comment_added" | "statement_added" if after >= 0 and not source.text[doc.end + 3 : after].strip():
            return made(source.replaced(after + 1, after + 1, f"{indent}{'# seeded' if category == 'comment_added' else '_seeded = 0'}\n"))
        case "summary_reworded":
            m = re.search(r"\S[^\n]*", doc.raw)
            return made(m and _first_fit(doc, iter([(m.end(), m.end(), " Indeed.")]), lambda before, now: before == now))
        case "docs_default" if facet == "default" and (new := other_literal(value)):
            tries = ((m.start(1), m.start(1) + len(m[1].rstrip(".,;)")), new) for m in re.finditer(DEFAULT_PHRASE, doc.raw, re.I))
            return made(_first_fit(doc, tries, _changed(aspect, {literal(new)})), value, literal(new))
        case "docs_param_type" | "docs_return_type" if facet == "type" and (param is None) == (category == "docs_return_type"):
            new = other_type(value)
            wanted = {new, annotation(f"{new} | None")}
            content = _first_fit(doc, ((a, b, new) for a, b in _types_of(doc.raw, param)), _changed(aspect, wanted))
            return made(content, value, content and doc.claims(content)[aspect])
        case "docs_param_invented" if facet == "exists" and not has_stars(node):
            new = f"param.{ghost}.exists"
            return made(_first_fit(doc, ((at, at, form.format(name=ghost)) for at, form in _entries_of(doc.raw)), _added({new})), "false", "true", new)
        case "docs_deprecated" if facet == "exists" and "deprecated" not in claimed:
            return made(_first_fit(doc, iter([(len(doc.raw.rstrip()), len(doc.raw.rstrip()), f"\n\n{indent}.. deprecated:: 1.0\n{indent}   Use another.\n{indent}")]), _added({"deprecated"})), "false", "true", "deprecated")
    return None
