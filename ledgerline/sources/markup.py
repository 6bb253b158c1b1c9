"""What Markdown pages and changelogs claim of the code: references as written, each with an aspect and a value.

A page is cut into blocks (headings, fences, tables, list items, paragraphs); each kind of block has one way to make claims. Names stay as
the page writes them; ``operators.resolution`` finds the symbols that they mean. Records of decisions (``adr`` folders) claim nothing.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ledgerline.functions.types import annotation, literal
from ledgerline.sources.docstrings import stated_default, written_type

#: Confidence of a table or a header, of a name in a running text, and of what a code sample uses.
TABLED, MENTIONED, SAMPLED = 0.9, 0.7, 0.8
# Titles of a table's columns, headings of a changelog's sections, and languages of fences that are read.
NAME_TITLES = {"parameter", "name", "argument", "option", "arg", "param"}
TYPE_TITLES, DEFAULT_TITLES = {"type"}, {"default", "default value"}
SECTIONS = {"added": "added_in", "deprecated": "deprecated", "removed": "removed_in"}
LANGUAGES = {"python", "py", "pycon", "python3"}

REFERENCE = "seq long, path string, ref string, aspect string, value string, line int, confidence double, rationale string"
_NAME = r"[A-Za-z_]\w*"
_CODE = re.compile(r"(`+)(.+?)\1")
_DOTTED = re.compile(rf"({_NAME}(?:\.{_NAME})*)(\(.*\))?", re.S)
_FENCE = re.compile(r"\s{0,3}(`{3,}|~{3,})\s*(\{?[\w+.-]*\}?)(.*)")
_VERSION = re.compile(r"\[?v?(\d+(?:\.\w+)*)\]?")


class Block(NamedTuple):
    kind: str
    line: int
    text: str
    info: str = ""


class Reference(NamedTuple):
    ref: str
    aspect: str
    value: str
    line: int
    confidence: float
    rationale: str


def blocks(text: str) -> Iterator[Block]:
    """The blocks of a page, in order; a fence that isn't closed reaches to the end."""
    lines, i = text.splitlines(), 0
    while i < len(lines):
        line = lines[i]
        if m := _FENCE.fullmatch(line):
            end = next((k for k in range(i + 1, len(lines)) if lines[k].strip().startswith(m[1]) and not lines[k].strip().strip(m[1][0])), len(lines))
            yield Block("fence", i + 1, "\n".join(lines[i + 1 : end]), (m[2] + m[3]).strip())
            i = end + 1
        elif m := re.fullmatch(r"\s{0,3}(#{1,6})\s+(.*?)\s*#*\s*", line):
            yield Block("heading", i + 1, m[2], str(len(m[1])))
            i += 1
        elif line.strip().startswith("|") and i + 1 < len(lines) and re.fullmatch(r"\s*\|?(?:\s*:?-+:?\s*\|?)+\s*", lines[i + 1]):
            end = next((k for k in range(i + 2, len(lines)) if not lines[k].strip().startswith("|")), len(lines))
            yield Block("table", i + 1, "\n".join([line, *lines[i + 2 : end]]))
            i = end
        elif re.match(r"\s*(?:[-*+]|\d+[.)])\s+", line):
            end = next((k for k in range(i + 1, len(lines)) if not lines[k].strip() or not lines[k][0].isspace()), len(lines))
            yield Block("item", i + 1, " ".join([re.sub(r"^\s*(?:[-*+]|\d+[.)])\s+", "", line), *(x.strip() for x in lines[i + 1 : end])]))
            i = end
        elif line.strip():
            end = next((k for k in range(i + 1, len(lines)) if not lines[k].strip() or re.match(r"\s{0,3}(?:#{1,6}\s|`{3}|~{3})", lines[k])), len(lines))
            yield Block("paragraph", i + 1, "\n".join(lines[i:end]))
            i = end
        else:
            i += 1


def names(text: str) -> list[tuple[str, str | None]]:
    """Dotted names in code spans, with what stands between their brackets."""
    found = []
    for m in _CODE.finditer(text):
        if d := _DOTTED.fullmatch(m[2].strip()):
            found.append((d[1], d[2]))
    return found


def _cells(row: str) -> list[str]:
    return [c.replace("\\|", "|").strip() for c in re.split(r"(?<!\\)\|", row.strip().strip("|"))]


def _of_table(block: Block, subject: str | None) -> Iterator[Reference]:
    """Parameters of the symbol that the nearest heading or paragraph above names."""
    head, *rows = block.text.split("\n")
    titles = [c.lower() for c in _cells(head)]
    at = lambda wanted: next((i for i, t in enumerate(titles) if t in wanted), None)
    name, kind, default = at(NAME_TITLES), at(TYPE_TITLES), at(DEFAULT_TITLES)
    if subject is None or name is None or kind is default is None:
        return
    for k, row in enumerate(rows):
        cells = _cells(row)
        cell = lambda i: cells[i].strip("`").strip() if i is not None and i < len(cells) else ""
        if re.fullmatch(_NAME, param := cell(name)):
            line = block.line + 2 + k
            yield Reference(subject, f"param.{param}.exists", "true", line, TABLED, "table row")
            value = literal(cell(default)) if cell(default) else None
            if value is not None:
                yield Reference(subject, f"param.{param}.default", value, line, TABLED, "table default")
            if (written := written_type(cell(kind))) if cell(kind) else None:
                yield Reference(subject, f"param.{param}.type", annotation(f"{written} | None") if value == "None" else written, line, TABLED, "table type")


def _sample(text: str) -> str:
    """The code of a sample; of a session, what was typed."""
    if not re.search(r"^>>>", text, re.M):
        return text
    return "\n".join(x[4:] for x in text.splitlines() if x.startswith((">>> ", "... ")))


def _of_sample(block: Block) -> Iterator[Reference]:
    """Names that a sample imports or calls by what it imported, and the parameters that it names."""
    try:
        tree = ast.parse(_sample(block.text))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return
    known: dict[str, str] = {}
    for node in ast.walk(tree):
        match node:
            case ast.Import(names=aliases):
                known |= {a.asname or a.name.split(".")[0]: a.name if a.asname else a.name.split(".")[0] for a in aliases}
                for a in aliases:
                    yield Reference(a.name, "exists", "true", block.line + node.lineno, SAMPLED, "import in a sample")
            case ast.ImportFrom(module=str(module), names=aliases, level=0):
                known |= {a.asname or a.name: f"{module}.{a.name}" for a in aliases if a.name != "*"}
                for a in aliases:
                    if a.name != "*":
                        yield Reference(f"{module}.{a.name}", "exists", "true", block.line + node.lineno, SAMPLED, "import in a sample")
    stored = {n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)}
    for node in ast.walk(tree):
        if isinstance(node, ast.Call) and (m := _DOTTED.fullmatch(ast.unparse(node.func))):
            first, _, rest = m[1].partition(".")
            if first in known and first not in stored:
                ref = known[first] + (f".{rest}" if rest else "")
                yield Reference(ref, "exists", "true", block.line + node.lineno, SAMPLED, "call in a sample")
                for k in node.keywords:
                    if k.arg:
                        yield Reference(ref, f"param.{k.arg}.exists", "true", block.line + node.lineno, SAMPLED, "keyword in a sample")


def _of_span(block: Block) -> Iterator[Reference]:
    """Names in code spans; a span with brackets also names parameters (the values given are examples, not defaults)."""
    for name, call in names(block.text):
        if "." not in name and call is None:
            continue  # a word in code style may be anything
        yield Reference(name, "exists", "true", block.line, MENTIONED, "name in code style")
        try:
            given = ast.parse(f"f{call}", mode="eval").body.keywords if call else []
        except (SyntaxError, ValueError, AttributeError):
            given = []
        for k in given:
            if k.arg:
                yield Reference(name, f"param.{k.arg}.exists", "true", block.line, MENTIONED, "keyword in code style")


def _prose(block: Block, subject: str | None) -> Iterator[Reference]:
    """"`timeout` ... defaults to 3": of a parameter of the page's current subject."""
    if subject is None:
        return
    for sentence in re.split(r"(?<=[.!?])\s+(?=[A-Z`])", " ".join(block.text.split())):
        plain = [n for n, call in names(sentence) if call is None and "." not in n]
        if plain and (spoken := stated_default(sentence[sentence.index(plain[0]) :])) and (value := literal(spoken)) is not None and spoken != plain[0]:
            yield Reference(subject, f"param.{plain[0]}.exists", "true", block.line, MENTIONED, "default in prose")
            yield Reference(subject, f"param.{plain[0]}.default", value, block.line, MENTIONED, "default in prose")


def page_references(text: str) -> list[Reference]:
    """What a page claims. A heading, or a paragraph that begins with a name in code style, makes that name the subject of what follows."""
    found: list[Reference] = []
    subject, level = None, 9
    for b in blocks(text):
        named = names(b.text) if b.kind in ("heading", "paragraph") else []
        if b.kind == "heading" and (named or int(b.info) <= level):
            subject, level = (named[0][0], int(b.info)) if named else (None, 9)
        elif b.kind == "paragraph" and named and b.text.lstrip().startswith("`") and ("." in named[0][0] or named[0][1]):
            subject, level = named[0][0], 7
        if b.kind == "table":
            found += _of_table(b, subject)
        elif b.kind == "fence" and b.info.lower() in LANGUAGES:
            found += _of_sample(b)
        elif b.kind == "fence" and b.info.startswith(("{deprecated}", "{versionadded}")) and subject:
            version = _VERSION.fullmatch(b.info.partition("}")[2].strip())
            if b.info.startswith("{deprecated}"):
                found.append(Reference(subject, "deprecated", "true", b.line, TABLED, "directive"))
            elif version:
                found.append(Reference(subject, "added_in", version[1], b.line, TABLED, "directive"))
        elif b.kind != "fence":
            found += _of_span(b)
            found += _prose(b, subject) if b.kind != "heading" else ()
    return found


def changelog_references(text: str) -> list[Reference]:
    """What a changelog's items say of the names that they begin with: added, deprecated or removed in the release above them."""
    found: list[Reference] = []
    version, aspect = None, None
    for b in blocks(text):
        if b.kind == "heading" and b.info == "2":
            m = _VERSION.match(b.text)
            version, aspect = m[1] if m else None, None
        elif b.kind == "heading":
            aspect = SECTIONS.get(b.text.strip().lower())
        elif b.kind == "item" and aspect and b.text.startswith("`") and (named := names(b.text)):
            value = "true" if aspect == "deprecated" else version
            if value:
                found.append(Reference(named[0][0], aspect, value, b.line, TABLED, "changelog item"))
    return found


def document_author(path: Column) -> Column:
    """Who speaks in a document: readme, changelog, wiki or docs; null for other files and for records of decisions."""
    name = F.lower(F.substring_index(path, "/", -1))
    page = name.rlike(r"\.(md|markdown)$") | name.isin("readme", "changelog")
    folder = F.concat(F.lit("/"), F.lower(path))
    author = F.when(name.rlike(r"^readme(\.|$)"), "readme").when(name.rlike(r"^change(s|log)(\.|$)"), "changelog").when(folder.rlike(r"/[^/]*wiki/"), "wiki").when(folder.rlike("/docs?/"), "docs")
    return F.when(page & ~folder.rlike("/adrs?/"), author)


def read_references(pages: DataFrame) -> DataFrame:
    """A row for each claim of ``pages`` (``seq``, ``path``, ``author``, ``content``), partition by partition, without a shuffle."""
    schema = StructType([*StructType.fromDDL(REFERENCE), *StructType.fromDDL("author string")])
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for seq, path, author, content in zip(*(c.to_pylist() for c in batch.columns)):
                text = content.decode("utf-8", "replace") if isinstance(content, bytes) else content or ""
                read = changelog_references if author == "changelog" else page_references
                rows += [r._asdict() | {"seq": seq, "path": path, "author": author} for r in read(text)]
            yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in kinds], kinds.names)

    return pages.select("seq", "path", "author", "content").where("author is not null and content is not null").mapInArrow(run, schema)
