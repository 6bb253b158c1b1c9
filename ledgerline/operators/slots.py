"""The documented slots of symbols, commit by commit.

What a commit does to a slot depends on the disputes that earlier commits left
open, so a symbol's commits are folded in order; symbols don't depend on each
other and are dealt out by key. Commits that repeat what the last one said are
left out before, and the rest streams through a task in order: only the state of one
symbol is held, however many commits it has.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerline.functions.scalars import DOCSTRING as DOCS
from ledgerline.functions.scalars import PROJECTOR
from ledgerline.functions.types import differs_provably
from ledgerline.operators.ownership import PAIR, State, by_key, chains
from ledgerline.scratch import written

SLOTS = "symbol_key string, aspect string, outcome string, code_value string, doc_value string, opened_seq long, deferred long"
_NAMES = ["symbol_key", "aspect", "outcome", "code_value", "doc_value", "opened_seq", "deferred"]
_SCHEMA = pa.schema([(n, pa.int64() if n in _NAMES[5:] else pa.string()) for n in _NAMES])
#: What a row of the fold may say besides its symbol and commit.
_ROWS = f"kind string, present boolean, path string, fields array<{PAIR}>, docs array<struct<author:string,path:string,claims:array<{PAIR}>>>, level int, above struct<kind:string,present:boolean,closed:boolean,path:string>, resolved array<{PAIR}>"
#: Slots of an output batch.
_BATCH = 4096


def projected(aspect: str, fields: dict[str, str] | None) -> str | None:
    """The value of an aspect in the fields of a symbol that is there, or None where it can't be proven."""
    if not fields:
        return None
    if aspect.startswith("param.") and aspect.endswith(".exists"):
        if "param_names" not in fields:
            return None
        names, param = json.loads(fields["param_names"]), aspect[6:-7]
        if any(n.lstrip("*") == param for n in names):
            return "true"
        return None if any(n.startswith("*") for n in names) else "false"
    return fields.get(aspect)


def exists(state: State, chain: list[Above | None]) -> str | None:
    """Whether a symbol exists: it is there, or nothing above it could still supply it.

    ``chain`` has its ancestors, nearest first, up to the first module or the first that nothing is known of (None).
    """
    if state.present:
        return "true"
    if state.present is None and state.kind is not None:
        return None
    proven = bool(chain) and all(a is not None and a.present and a.closed for a in chain) and chain[-1].kind == "module"
    return "false" if proven else None


def withheld(aspect: str, value: str, stated: dict[str, set[str]], fields: dict[str, str] | None = None) -> bool:
    """Whether the documents may mean the same in other words.

    A default of None in the code may stand for any documented one, and then a
    type that leaves None out says the same as one that has it.
    """
    said = stated.get(aspect, set())
    if aspect.endswith(".default"):
        return value == "None" and any(x != "None" for x in said)
    if aspect.endswith(".type"):
        default = aspect[:-5] + ".default"
        sentinel = (fields or {}).get(default) == "None" and any(x != "None" for x in stated.get(default, ()))
        other = [x for x in said if x != value]
        return bool(other) and not any(differs_provably(value, x, sentinel) for x in other)
    return False


class Above(NamedTuple):
    """What a chain shows of an ancestor."""

    kind: str | None
    present: bool | None
    closed: bool
    path: str | None


def author_of(speaker: str) -> str:
    """A speaker is an author, with the path that it speaks in."""
    return speaker.partition(":")[0]


class _Symbol:
    """Claims (speaker, aspect, value), open disputes and what had to wait, of a symbol whose state and ancestors are followed."""

    def __init__(self) -> None:
        self.claims: set[tuple[str, str, str]] = set()
        self.open: dict[str, int] = {}
        self.members: dict[str, set[str]] = {}
        self.deferred: dict[str, int] = {}
        self.state = State()
        self.above: dict[int, Above] = {}

    def chain(self) -> list[Above | None]:
        """Ancestors up to the first module or unknown one."""
        out: list[Above | None] = []
        for level in range(1, max(self.above, default=0) + 2):
            out.append(self.above.get(level))
            if out[-1] is None or out[-1].kind == "module":
                break
        return out

    def project(self, aspect: str) -> tuple[str, str] | None:
        """The speaker and value of the code's claim on an aspect; none without a proven value and a path to read it from."""
        chain = self.chain()
        value = exists(self.state, chain) if aspect == "exists" else projected(aspect, self.state.fields if self.state.present else None)
        path = self.state.path or next((a.path for a in chain if a and a.path), None)
        return (f"{PROJECTOR}:{path}", value) if value is not None and path is not None else None

    def retract(self, gone: set[tuple[str, str, str]]) -> set[tuple[str, str]]:
        """Retracts what its author may; a party to an open dispute may not, and its slot is held."""
        held = set()
        for speaker, aspect, value in sorted(gone):
            if aspect in self.open and author_of(speaker) in self.members[aspect]:
                held.add((speaker, aspect))
                self.deferred[aspect] = self.deferred.get(aspect, 0) + 1
            else:
                self.claims.discard((speaker, aspect, value))
        return held

    def assert_(self, new: set[tuple[str, str, str]], held: set[tuple[str, str]], seq: int) -> None:
        for speaker, aspect, value in sorted(new - self.claims):
            if (speaker, aspect) in held:
                continue
            others = {c for c in self.claims if c[1] == aspect}
            self.claims.add((speaker, aspect, value))
            if aspect in self.open:
                self.members[aspect].add(author_of(speaker))
            elif any(c[2] != value for c in others):
                self.open[aspect] = seq
                self.members[aspect] = {author_of(c[0]) for c in others} | {author_of(speaker)}

    def commit(self, seq: int, docs: dict[str, set[tuple[str, str]]], state: State | None = None, above: dict[int, Above] | None = None) -> None:
        """What a commit says: claims by speaker (all that it states now), the symbol's new state, and those of ancestors by level.

        The code's own claims follow: one for each documented aspect that is proven and not withheld. They are withdrawn first, then those
        of the documents; then what is new is asserted, the code's first.
        """
        old = {c for c in self.claims if c[0] in docs}
        new = {(speaker, a, v) for speaker, pairs in docs.items() for a, v in pairs}
        touched = {c[1] for c in old ^ new}
        if state is not None or above:
            touched |= {c[1] for c in self.claims | new}
        self.state = state or self.state
        self.above |= above or {}
        stated: dict[str, set[str]] = {}
        for speaker, aspect, value in (self.claims - (old - new)) | new:
            if author_of(speaker) != PROJECTOR:
                stated.setdefault(aspect, set()).add(value)
        want = {(p[0], a, p[1]) for a in touched & stated.keys() if (p := self.project(a)) and not withheld(a, p[1], stated, self.state.fields)}
        have = {c for c in self.claims if author_of(c[0]) == PROJECTOR and c[1] in touched}
        held = self.retract(have - want)
        held |= self.retract(old - new)
        self.assert_(want, held, seq)
        self.assert_(new, held, seq)

    def resolve(self, aspect: str, winner: str) -> None:
        """Closes an open dispute: of its members only those that state the winner stay."""
        if self.open.pop(aspect, None) is not None:
            del self.members[aspect]
            self.claims = {c for c in self.claims if c[1] != aspect or c[2] == winner}

    def slots(self, key: str) -> Iterator[tuple]:
        for aspect in sorted({c[1] for c in self.claims}):
            code = sorted({c[2] for c in self.claims if c[1] == aspect and author_of(c[0]) == PROJECTOR})
            docs = sorted({c[2] for c in self.claims if c[1] == aspect and author_of(c[0]) != PROJECTOR})
            outcome = "contradict" if aspect in self.open else "abstain" if not code else "corroborate" if docs else "undocumented"
            yield key, aspect, outcome, code[0] if code else None, ",".join(docs) or None, self.open.get(aspect), self.deferred.get(aspect, 0)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slots of the symbols of rows that come in order of symbol and commit; a commit may have several rows."""
    at, symbol, done = None, None, []
    docs, state, above, resolved = {}, None, {}, set()
    pairs = lambda found: {(p["aspect"], p["value"]) for p in json.loads(found)} if found else set()

    def close() -> None:
        if at is not None:
            symbol.commit(at[1], docs, state, above)
            for aspect, winner in sorted(resolved):
                symbol.resolve(aspect, winner)

    for batch in batches:
        for row in batch.to_pylist():
            where = row["symbol_key"], row["seq"]
            if where != at:
                close()
                if at is None or at[0] != where[0]:
                    done += symbol.slots(at[0]) if at else ()
                    symbol = _Symbol()
                at, docs, state, above, resolved = where, {}, None, {}, set()
            for d in row["docs"] or ():
                docs.setdefault(f"{d['author']}:{d['path']}", set()).update(pairs(d["claims"]))
            if row["present"] is not None:
                state = State(row["kind"], row["present"], row["path"], dict(pairs(row["fields"])))
            if row["level"] is not None:
                above[row["level"]] = Above(row["above"]["kind"], row["above"]["present"], row["above"]["closed"], row["above"]["path"])
            resolved |= pairs(row["resolved"])
            if len(done) >= _BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), _SCHEMA)], schema=_SCHEMA)
                done = []
    close()
    done += symbol.slots(at[0]) if at else ()
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), _SCHEMA)], schema=_SCHEMA)


def fold_slots(events: DataFrame, resolved: DataFrame | None = None, claims: DataFrame | None = None) -> DataFrame:
    """Each slot after the last commit, from what commits change of symbols (``extraction.symbol_events``).

    ``resolved`` has ``symbol_key``, ``seq``, ``aspect`` and the ``value`` that wins: a dispute is closed after that commit.

    ``claims`` has what other documents say: ``symbol_key``, ``seq``, ``author``, ``path`` and ``claims``, all that the author states
    there as of that commit. Whether a symbol exists that the code doesn't have is judged by its ancestors as of each commit, which meet
    the symbols so claimed in an equi-join (``ownership.chains``).
    """
    state, above = ("kind", "present", "path", "fields"), ("kind", "present", "closed", "path")
    if claims is not None:
        events = written(events, "symbol-events")

    def rows(df: DataFrame, **given: Column) -> DataFrame:
        none = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(_ROWS)}
        return df.select("symbol_key", "seq", *(given[n].alias(n) if n in given else c for n, c in none.items()))

    found = rows(events, docs=F.col("docs"), **{c: F.col(c) for c in state})
    if resolved is not None:
        found = found.unionByName(rows(resolved, resolved=F.array(F.struct("aspect", "value"))))
    if claims is not None:
        asked = claims.where(F.exists("claims", lambda c: c["aspect"] == "exists")).select("symbol_key")
        up = chains(events, asked)
        found = found.unionByName(rows(claims, docs=F.array(F.struct("author", "path", "claims")))).unionByName(rows(up, level=F.col("level"), above=F.struct(*above)))
    docs = F.transform("docs", lambda d: F.struct(d["author"], d["path"], F.to_json(d["claims"]).alias("claims")))
    return by_key(found.withColumns({"fields": F.to_json("fields"), "resolved": F.to_json("resolved"), "docs": docs})).mapInArrow(_fold, SLOTS)
