"""Operator 7: secret scans over a trigram inverted index, with DataFrame functions alone.

Each rule's regular expression gives a Boolean query: alternatives of sets of
trigrams that any match must hold. The index lists, for every trigram that some
query names, the documents with it. Intersecting the lists gives a rule's
candidates; only those are verified with the expression. A rule without
mandatory trigrams scans every document.

Candidates go back to the texts as bitmaps of a fixed size, which every task gets: a text that no rule asks for isn't searched, one whose
bit another has set is searched for nothing, and no text is shuffled, however many documents are candidates.
"""

from __future__ import annotations

import re
from re import _constants as sre
from re import _parser as sre_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_key, written
from .spans import located, marks, spelled

#: The base rules, as (kind, pattern for Java, its groups that a match must fill with so many characters).
BASE_RULES = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", (1, 6)),
    ("access", r"AKIA[A-Z0-9]+", (0, 20)),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{24,}+", (0, 24)),  # of runs, only those long enough: most texts hold very many short ones
)
#: Rules that the method adds.
MORE_RULES = (
    ("private", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", (0, 1)),
    ("github", r"ghp_[A-Za-z0-9]{36}(?![A-Za-z0-9])", (0, 1)),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", (0, 1)),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", (0, 1)),
)
#: Most alternatives of a query; with more, the rule scans every document.
MOST_CLAUSES = 32
#: Bitmaps of candidates, and bits of each: 16 MB at most. The fuller they are, the more texts are searched that needn't be.
BITMAPS, BITS = 1 << 12, 1 << 15


def trigram_query(pattern: str) -> list[set[str]] | None:
    """Alternatives of lower-case trigrams, one set of which every match holds; None if a match may hold none."""

    def cross(a: list[list[str]], b: list[list[str]]) -> list[list[str]]:
        out = [[*x[:-1], x[-1] + y[0], *y[1:]] for x in a for y in b]
        return out if len(out) <= MOST_CLAUSES else [[""]]

    def runs(tokens) -> list[list[str]]:
        """Alternatives of literal runs; the first and last of each touch what stands beside."""
        found = [[""]]
        for op, arg in tokens:
            if op is sre.LITERAL and arg < 128:
                found = [[*x[:-1], x[-1] + chr(arg).lower()] for x in found]
            elif op is sre.SUBPATTERN:
                found = cross(found, runs(arg[3]))
            elif op is sre.BRANCH:
                found = cross(found, [x for branch in arg[1] for x in runs(branch)])
            elif op is sre.MAX_REPEAT and arg[0] > 0:
                found = [[*x, ""] for x in cross(found, runs(arg[2]))]
            elif op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
                continue
            else:
                found = [[*x, ""] for x in found]
        return found

    clauses = [{r[i : i + 3] for r in x for i in range(len(r) - 2)} for x in runs(sre_parser.parse(pattern))]
    return clauses if all(clauses) else None


def build_index(docs: DataFrame, trigrams: list[str], key: str = "key") -> DataFrame:
    """Postings (``trigram``, ``key``) of the trigrams that the texts of ``docs`` hold in either case."""
    text = F.lower("text")
    held = F.array_compact(F.array(*(F.when(F.contains(F.col("_low"), F.lit(t)), F.lit(t)) for t in trigrams)))
    return docs.select(key, text.alias("_low")).select(key, F.explode(held).alias("trigram")).select("trigram", key)


def candidates(index: DataFrame, queries: dict[str, list[set[str]]], key: str = "key") -> DataFrame:
    """``key`` and ``rules``, the rules whose query the postings meet."""
    rows = [(rule, i, t, len(c)) for rule, clauses in queries.items() for i, c in enumerate(clauses) for t in sorted(c)]
    asked = index.sparkSession.createDataFrame(rows, "rule string, clause int, trigram string, needs int")  # as many rows as the rules have trigrams
    met = index.join(F.broadcast(asked), "trigram").groupBy(key, "rule", "clause", "needs").agg(F.count("*").alias("n")).where("n = needs")
    return met.groupBy(key).agg(F.collect_set("rule").alias("rules"))


def _place(rule: str | Column, key: str = "key") -> Column:
    """The bit of a rule's candidate in the bitmap of its key."""
    return F.pmod(F.xxhash64(key, F.lit(rule) if isinstance(rule, str) else rule), F.lit(BITS))


def _bitmap(key: str = "key") -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BITMAPS))


def candidate_bitmaps(asked: DataFrame) -> DataFrame:
    """``bitmap`` and ``bits``: a row for each of BITMAPS at most, from candidates (``key``, ``rules``)."""
    placed = asked.select(_bitmap().alias("bitmap"), "key", F.explode("rules").alias("rule")).select("bitmap", _place(F.col("rule")).alias("place"))
    return placed.groupBy("bitmap").agg(F.bitmap_construct_agg("place").alias("bits"))


def may_match(rule: str) -> Column:
    """Whether the bit of a rule is set in ``bits``; false without a bitmap."""
    at = _place(rule)
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))


def _spans(text: Column, rule: tuple, likely: Column) -> Column:
    kind, pattern, (group, least) = rule
    value = (lambda s: s["value"]) if not group else (lambda s: F.regexp_extract(s["value"], pattern, group))
    return F.filter(located(text, pattern, likely), lambda s: F.length(value(s)) >= least)


def find_secrets(df: DataFrame, rules: tuple = BASE_RULES + MORE_RULES) -> DataFrame:
    """``doc_id``, ``text`` and ``secrets``, the marks (start, order, end, kind) that the rules find in each whole text.

    A null text is empty. Rows may repeat, and doc_id may be null: rows are told
    apart by doc_id and text, and rows alike in both have the same result.
    Columns besides doc_id and text are left out.
    """
    docs = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", row_key())
    queries = {r[0]: q for r in rules if (q := trigram_query(re.sub(r"(?<=[+*?}])\+", "", r[1])))}
    trigrams = sorted({t for q in queries.values() for c in q for t in c})
    if trigrams:
        postings = written(build_index(docs, trigrams).distinct(), "trigram-index")
        bitmaps = written(candidate_bitmaps(candidates(postings, queries)), "secret-candidates")
        docs = docs.withColumn("bitmap", _bitmap()).join(F.broadcast(bitmaps), "bitmap", "left")
    found = []
    for order, rule in enumerate(rules):
        likely = may_match(rule[0]) if rule[0] in queries else F.col("text").rlike(rule[1])
        found.append(marks(_spans(F.col("text"), rule, likely), rule[0], order))
    return docs.select("doc_id", "text", F.concat(*found).alias("secrets"))
