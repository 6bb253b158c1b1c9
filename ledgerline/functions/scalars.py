"""Scalar rules as column expressions: keys, versions, anchors, paths, aspects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Principals and what a claim of each weighs in the review queue; others weigh 0.5.
PROJECTOR, DOCSTRING = "projector", "docstring"
AUTHORITY = {PROJECTOR: 1.0, "docstring": 0.9, "docs": 0.8, "readme": 0.8, "changelog": 0.7, "wiki": 0.5}
OTHER_AUTHORITY = 0.5
#: Fixed value: how prose names a default, outside quotes; in any case of letters.
DEFAULT_PHRASE = r"(?<![\"'`])\bdefaults?\b(?![\"'`])\s*(?:to|is|=|:)?\s*(`[^`]+`|'[^']*'|\"[^\"]*\"|[^\s,;)]+)"
#: The aspects' templates in catalogue order, each with the pattern of its concrete aspects.
ASPECTS = (
    ("exists", r"^exists$"),
    ("param_names", r"^param_names$"),
    ("param.<p>.exists", r"^param\.[A-Za-z_][A-Za-z0-9_]*\.exists$"),
    ("param.<p>.default", r"^param\.[A-Za-z_][A-Za-z0-9_]*\.default$"),
    ("param.<p>.type", r"^param\.[A-Za-z_][A-Za-z0-9_]*\.type$"),
    ("returns.type", r"^returns\.type$"),
    ("raises.<Exc>", r"^raises\.[A-Za-z_][A-Za-z0-9_.]*$"),
    ("deprecated", r"^deprecated$"),
    ("added_in", r"^added_in$"),
    ("removed_in", r"^removed_in$"),
)
#: Suffixes of relevant files, and how an anchor is written.
RELEVANT = r"\.(py|md|rst|toml)$"
ANCHOR = r"^(repo|wiki)://([^/]+)/([^@]+)@([0-9a-f]{7,40})/([^#]+)#(?:L([0-9]+)-L([0-9]+)|sym=(.+))$"
VERSION = r"^\s*v?([0-9]+(?:\.[0-9]+)*(?:[.+-][0-9A-Za-z.]+)?)\s*$"
#: The ranks by which one of several definitions of a key wins.
KIND_RANK = {"module": 3, "class": 2, "function": 2, "method": 2, "ambiguous": 2, "attribute": 1}


def authority(author: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in AUTHORITY.items() for x in kv))
    return F.coalesce(F.try_element_at(known, author), F.lit(OTHER_AUTHORITY))


def canonical_version(text: Column) -> Column:
    """A version without ``v``, or null where the text is none."""
    return F.when(text.rlike(VERSION), F.regexp_extract(text, VERSION, 1))


def anchor_part(uri: Column, part: int) -> Column:
    """Group ``part`` of an anchor, null if the anchor is malformed or has none."""
    value = F.regexp_extract(uri, ANCHOR, part)
    return F.when(uri.rlike(ANCHOR) & (value != ""), value)


def render_anchor(scheme: Column, owner: Column, repo: Column, sha: Column, path: Column, first: Column, last: Column, symbol: Column) -> Column:
    """An anchor; a symbol wins over lines."""
    place = F.when(symbol.isNotNull(), F.concat(F.lit("sym="), symbol)).otherwise(F.concat(F.lit("L"), first, F.lit("-L"), last))
    return F.concat(scheme, F.lit("://"), owner, F.lit("/"), repo, F.lit("@"), sha, F.lit("/"), path, F.lit("#"), place)


def module_name(path: Column) -> Column:
    """The dotted module of a Python file: what follows the first ``src`` folder, without ``__init__``; null if none."""
    stem = F.regexp_replace(path, r"\.py$", "")
    inner = F.regexp_replace(F.regexp_replace(stem, r"^(?:.*?/)??src/", ""), r"(^|/)__init__$", "")
    return F.when(path.rlike(r"\.py$") & inner.rlike(r"^[A-Za-z_][A-Za-z0-9_]*(/[A-Za-z_][A-Za-z0-9_]*)*$"), F.translate(inner, "/", "."))


def is_relevant(path: Column, excluded: list[str]) -> Column:
    """Whether a path has a relevant suffix and matches no shell pattern, in which ``*`` also crosses folders."""
    keep = path.rlike(RELEVANT)
    for pattern in excluded:
        quoted = "".join({"*": ".*", "?": "."}.get(c, c if c.isalnum() or c in "_/" else "\\" + c) for c in pattern)
        keep = keep & ~path.rlike(f"^{quoted}$")
    return keep


def aspect_template(aspect: Column) -> Column:
    found = F.lit(None).cast("string")
    for template, pattern in reversed(ASPECTS):
        found = F.when(aspect.rlike(pattern), template).otherwise(found)
    return found


def kind_rank(kind: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in KIND_RANK.items() for x in kv)), kind)


def ancestors(symbol: Column) -> Column:
    """Dotted prefixes of a symbol key, nearest first."""
    parts = F.split(symbol, r"\.")
    return F.when(F.size(parts) > 1, F.transform(F.reverse(F.sequence(F.lit(1), F.size(parts) - 1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))).otherwise(F.array().cast("array<string>"))


def default_phrase(sentence: Column) -> Column:
    """The value that the first default phrase names outside quotes, null if none."""
    value = F.regexp_replace(F.regexp_replace(F.regexp_extract(sentence, "(?i)" + DEFAULT_PHRASE, 1), r"^`+|`+$", ""), r"[.,;)]+$", "")
    return F.when(value != "", value)
