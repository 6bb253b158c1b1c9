"""Which path owns a symbol's key, and the symbol's state as of each commit.

A key has one owner, the path that its state was read from. Another path takes it over only if it is free (never owned, or removed), if the
commit deletes the owner or reads it without the key, or if it outranks what the owner defines; else it is refused, and reported. A symbol
goes when its owner no longer has it and no other path of the commit does: its fields stay, ``present`` becomes false. Below a name that
a commit defines twice nothing goes, as no one can tell what such a name has.

What is decided depends on who owned the key before, so a key's commits are folded in order; keys are dealt out by name, and a task holds
one key's owner and fields, however many commits it has.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.scalars import KIND_RANK, ancestors, kind_rank
from ledgerline.scratch import shuffled

#: Ways in which a path may come to own a key, or keep it.
WAYS = ("free", "owner", "removed", "deleted", "silent", "rank")
PAIR = "struct<aspect:string,value:string>"
EVENTS = f"symbol_key string, seq long, path string, kind string, present boolean, fields array<{PAIR}>, way string, refused array<string>, docs array<struct<author:string,path:string,claims:array<{PAIR}>>>"
#: As above, with pairs as JSON, which Python needn't take apart to hand on.
_DOCS = pa.struct([("author", pa.string()), ("path", pa.string()), ("claims", pa.string())])
_EVENTS = pa.schema(
    [
        ("symbol_key", pa.string()), ("seq", pa.int64()), ("path", pa.string()), ("kind", pa.string()), ("present", pa.bool_()), ("fields", pa.string()), ("way", pa.string()), ("refused", pa.list_(pa.string())), ("docs", pa.list_(_DOCS)),
    ]
)
#: Rows of an output batch.
_BATCH = 2048


def path_events(there: DataFrame, versions: DataFrame) -> DataFrame:
    """What each path says of each key in each commit: it defines it, or it no longer does (``gone``: deleted or silent).

    ``there`` has ``symbol_key``, ``seq``, ``path``, ``kind`` and what else a definition says; ``versions`` has ``seq``, ``path`` and ``status``
    (analyzed, deleted or unreadable) of every path that a commit changes. A version that can't be read says nothing: what was there before
    it stays. A key is ``gone`` in the next readable version after one that had it.
    """
    readable = versions.where("status <> 'unreadable'")
    per = Window.partitionBy("path").orderBy("seq")
    following = readable.select("seq", "path", F.lead("seq").over(per).alias("next"), F.lead("status").over(per).alias("then")).where("next is not null")
    keys = there.select("symbol_key", "seq", "path")
    gone = keys.join(shuffled(following), ["seq", "path"]).select("symbol_key", F.col("next").alias("seq"), "path", "then").join(shuffled(keys), ["symbol_key", "seq", "path"], "left_anti")
    twice = there.where("kind = 'ambiguous'").select(F.col("symbol_key").alias("above"), "seq").distinct()
    hidden = gone.select("symbol_key", "seq", F.explode(ancestors(F.col("symbol_key"))).alias("above")).join(shuffled(twice), ["above", "seq"], "left_semi").select("symbol_key", "seq").distinct().withColumn("hidden", F.lit(True))
    lost = gone.join(shuffled(hidden), ["symbol_key", "seq"], "left").select("symbol_key", "seq", "path", F.when(F.col("then") == "deleted", "deleted").otherwise("silent").alias("gone"), F.coalesce("hidden", F.lit(False)).alias("hidden"))
    said = there.withColumns({"rank": F.coalesce(kind_rank(F.col("kind")), F.lit(0)).cast("int"), "gone": F.lit(None).cast("string"), "hidden": F.lit(False)})
    return said.unionByName(lost, allowMissingColumns=True)


class State(NamedTuple):
    """What is known of a symbol; nothing of it is known before its first commit."""

    kind: str | None = None
    present: bool | None = None
    path: str | None = None
    fields: object = None


def decide(state: State, emits: list[dict], gone: dict[str, dict]) -> tuple[State, str | None, list[str]]:
    """The state after a commit, the way in which its owner has it, and the paths that were refused."""
    if not emits:
        left = gone.get(state.path)
        return (state._replace(present=False), None, []) if left and not left["hidden"] and state.present else (state, None, [])
    best = min(emits, key=lambda e: (-e["rank"], e["path"]))
    others = sorted(e["path"] for e in emits if e is not best)
    if state.path is None:
        way = "free"
    elif state.path == best["path"]:
        way = "owner"
    elif not state.present:
        way = "removed"
    elif state.path in gone:
        way = gone[state.path]["gone"]
    elif best["rank"] > KIND_RANK.get(state.kind, 0):
        way = "rank"
    else:
        return state, None, [best["path"], *others]
    return State(best["kind"], True, best["path"], best["fields"]), way, others


class _Key:
    """A key's state, and the claims that each path's documentation made of it last; pairs stay JSON."""

    def __init__(self, author: str) -> None:
        self.author, self.state, self.said = author, State(), {}

    def commit(self, key: str, seq: int, rows: list[dict]) -> dict | None:
        """The event of a commit; None if it brings nothing new."""
        state, way, refused = decide(self.state, [r for r in rows if r["gone"] is None], {r["path"]: r for r in rows if r["gone"] is not None})
        docs = []
        for r in sorted(rows, key=lambda r: r["path"]):
            claims = None if r["gone"] or r["claims"] == "[]" else r["claims"]
            if claims != self.said.get(r["path"]):
                docs.append({"author": self.author, "path": r["path"], "claims": claims or "[]"})
                self.said[r["path"]] = claims
        news = state != self.state
        self.state = state
        if not (news or refused or docs):
            return None
        event = {"symbol_key": key, "seq": seq, "path": state.path, "way": way if news or way != "owner" else None, "refused": refused, "docs": docs}
        if news:
            event |= {"kind": state.kind, "present": state.present, "fields": state.fields}
        return event


def own_keys(events: DataFrame, author: str, fields: Column, claims: Column) -> DataFrame:
    """One row for each key and commit with news: the new state (``present`` null: unchanged), the way it came about, the paths refused, and
    what documentation of ``author`` that changed says, by path. ``events`` as of ``path_events``; of repeated rows one counts. ``fields`` and
    ``claims``, sorted pairs, are worked out of a definition's columns where its key is dealt to."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, done, key = None, {}, [], None
        for batch in batches:
            for row in batch.to_pylist():
                where = row["symbol_key"], row["seq"]
                if where != at:
                    if held and (event := key.commit(*at, list(held.values()))):
                        done.append(event)
                    if at is None or at[0] != where[0]:
                        key = _Key(author)
                    at, held = where, {}
                    if len(done) >= _BATCH:
                        yield pa.RecordBatch.from_pylist(done, _EVENTS)
                        done = []
                held.setdefault(row["path"], row)
        if held and (event := key.commit(*at, list(held.values()))):
            done.append(event)
        if done:
            yield pa.RecordBatch.from_pylist(done, _EVENTS)

    there = F.col("gone").isNull()
    flat = by_key(events).select("symbol_key", "seq", "path", "kind", "rank", "gone", "hidden", F.to_json(F.when(there, fields)).alias("fields"), F.to_json(F.when(there, claims)).alias("claims"))
    schema = EVENTS.replace(f"array<{PAIR}>", "string")
    pairs = lambda c: F.from_json(c, f"array<{PAIR}>")
    docs = F.transform("docs", lambda d: F.struct(d["author"], d["path"], pairs(d["claims"]).alias("claims")))
    return flat.mapInArrow(fold, schema).withColumns({"fields": pairs("fields"), "docs": docs})


def by_key(df: DataFrame) -> DataFrame:
    """Rows dealt out by ``symbol_key`` and in order of ``seq``: to as many tasks as the session shuffles to, as folding them is Python's work."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, "symbol_key").sortWithinPartitions("symbol_key", "seq")


def chains(events: DataFrame, symbols: DataFrame) -> DataFrame:
    """``symbol_key``, ``seq`` and ``level`` (1: the nearest) with the state that a commit gives an ancestor, for each of ``symbols``.

    ``events`` as of ``own_keys``. Symbols meet their ancestors in an equi-join on exploded prefixes; only commits that change what a
    chain shows of an ancestor (kind, present, closed, path) count, so a row is a change that may matter beneath it.
    """
    closed = F.get(F.filter("fields", lambda f: f["aspect"] == "namespace_closed"), F.lit(0))["value"] == "true"
    shown = F.struct("kind", "present", F.coalesce(closed, F.lit(False)).alias("closed"), "path")
    states = events.where("present is not null").select(F.col("symbol_key").alias("above"), "seq", shown.alias("shown"))
    before = F.lag("shown").over(Window.partitionBy("above").orderBy("seq"))
    changes = states.withColumn("before", before).where(~F.col("shown").eqNullSafe(F.col("before"))).drop("before")
    wanted = symbols.select("symbol_key").distinct().select("symbol_key", F.posexplode(ancestors(F.col("symbol_key"))).alias("level", "above"))
    return wanted.join(shuffled(changes), "above").select("symbol_key", "seq", (F.col("level") + 1).alias("level"), "shown.*")
