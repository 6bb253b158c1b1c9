"""Operator 6: personal data by bootstrapped contextual extraction, with DataFrame functions alone.

Base matches of four kinds are the seeds. Every token with a digit or an at sign is an instance that stands in lexical patterns: the last
word before it, the first word after it (words that are no such tokens), and both. Patterns and instances make a bipartite graph over all
documents, which Spark scores in rounds. A pattern scores the share of its different instances that are believed, and is confident if that
is high and they are enough; an instance is believed if it is a seed or stands in a confident pattern, and then counts for other patterns.
The rounds end when none makes another pattern confident. Instances of confident patterns that no base match covers are new identifiers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_key, written
from .spans import SPACE, blocks_of, let, located, marks, spelled

#: The base kinds in order. Quantifiers that nothing follows are possessive, and a match starts at the
#: start of its run or where the last match ended: the same matches, in time that grows with the text alone.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
CONTEXT = "context"
INSTANCES = "array<struct<start:int,end:int,pattern:string,after:string,instance:string,seed:boolean,likely:boolean>>"
#: A token with a digit or an at sign, and in it the part without punctuation around.
TOKEN = rf"(?<![^{SPACE}])[^{SPACE}0-9@]*+[0-9@][^{SPACE}]*+"
CORE = r"[A-Za-z0-9](?:.*[A-Za-z0-9])?"
#: The last word of what stands before a token and the first of what stands after it, and what stands for them at a text's ends.
WORD, NEXT = rf"(?<![^{SPACE}])[^{SPACE}]++(?=[{SPACE}]*$)", rf"^[{SPACE}]*([^{SPACE}]++)"
START, END = "<start>", "<end>"
#: An identifier that is added has so many characters and digits at least; all are instances.
LEAST_CHARS, LEAST_DIGITS = 6, 4
#: A confident pattern's share of believed instances, in per cent, and their number.
CONFIDENT, SUPPORT = 80, 5
#: Patterns that are broadcast at most; more are shuffled.
BROADCAST_ROWS = 1 << 20


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def total(r: Column) -> Column:
        def add(n: Column, i: Column) -> Column:
            d = F.substring(r, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
            return n + F.when(d > 9, d - 9).otherwise(d)

        return F.aggregate(F.sequence(F.lit(1), F.length(r)), F.lit(0), add)

    return let(F.reverse(x), total) % 10 == 0


def _valid_card(s: Column) -> Column:
    return let(digits(s["value"]), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(F.lit(False)))


def _valid_ip(s: Column) -> Column:
    parts = F.transform(F.split(s["value"], r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.when(F.length(p) <= 3, p).otherwise("999").cast("int") <= 255))


def base_spans(text: Column) -> dict[str, Column]:
    """The base kinds' spans of a text that isn't null."""
    digit = text.rlike("[0-9]")
    return {
        "email": located(text, EMAIL, F.contains(text, F.lit("@"))),
        "ip": F.filter(located(text, IP, digit), _valid_ip),
        "card": F.filter(located(text, CARD, digit), _valid_card),
        "phone": F.filter(located(text, PHONE, F.contains(text, F.lit("+"))), lambda s: F.length(digits(s["value"])).between(10, 15)),
    }


def _running_max(values: Column) -> Column:
    """The largest of an array's integers (from -1) up to each place, block by block."""
    none = F.struct(F.lit(-1).alias("m"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        return let(F.greatest(acc["m"], x), lambda m: F.struct(m.alias("m"), F.array_append(acc["out"], m).alias("out")))

    def over(blocks: Column) -> Column:
        ends = F.aggregate(blocks, F.array(F.lit(-1)), lambda found, b: F.array_append(found, F.greatest(F.element_at(found, -1), F.element_at(b, -1))))
        return F.flatten(F.zip_with(blocks, let(ends, lambda e: F.slice(e, 1, F.size(e) - 1)), lambda b, m: F.transform(b, lambda x: F.greatest(x, m))))

    return let(F.transform(blocks_of(values), lambda b: F.aggregate(b, none, step, lambda acc: acc["out"])), over)


def _instances(text: Column, tokens: Column, base: Column) -> Column:
    """Tokens as structs of start, end, pattern and after (the words beside it), instance, seed (a base match covers part of it) and likely (long enough to be added)."""
    meets = lambda m, s: (m["start"] < s["end"]) & (s["start"] < m["end"])

    def one(s: Column, words: Column, near: Column) -> Column:
        core = F.regexp_extract(s["value"], CORE, 0)
        begin = s["start"] + F.instr(s["value"], core) - 1
        return F.struct(
            begin.alias("start"),
            (begin + F.length(core)).alias("end"),
            F.coalesce(words["before"], F.lit(START)).alias("pattern"),
            F.coalesce(words["after"], F.lit(END)).alias("after"),
            F.lower(core).alias("instance"),
            F.exists(near, lambda m: meets(m, s)).alias("seed"),
            ((F.length(core) >= LEAST_CHARS) & (F.length(digits(s["value"])) >= LEAST_DIGITS)).alias("likely"),
        )

    def of_block(block: Column, words: Column) -> Column:
        whole = F.struct(F.get(block, F.lit(0))["start"].alias("start"), F.element_at(block, -1)["end"].alias("end"))
        near = let(whole, lambda w: F.filter(base, lambda m: meets(m, w)))  # so that each token is held against few spans
        return let(near, lambda n: F.zip_with(block, words, lambda s, p: one(s, p, n)))

    def named(words: Column) -> Column:
        """The word of each token, or that of the last token before it that has one."""
        last = _running_max(F.transform(words, lambda w, i: F.when(w != "", i).otherwise(-1)))
        return F.transform(last, lambda k: F.when(k >= 0, F.get(words, k)))

    ends = F.substr(text, F.element_at(tokens, -1)["end"] + 1)
    gaps = F.concat(F.transform(F.slice(tokens, 2, F.size(tokens)), lambda s: s["before"]), F.array(ends))
    before = let(F.transform(tokens, lambda s: F.lower(F.regexp_extract(s["before"], WORD, 0))), named)
    after = F.reverse(let(F.reverse(F.transform(gaps, lambda g: F.lower(F.regexp_extract(g, NEXT, 1)))), named))
    words = F.arrays_zip(before.alias("before"), after.alias("after"))
    found = let(words, lambda w: F.flatten(F.zip_with(blocks_of(tokens), blocks_of(w), of_block)))
    return F.when(F.size(tokens) > 0, found).otherwise(F.array().cast(INSTANCES))


def _patterns(t: Column) -> Column:
    """The patterns that a token stands in; white space is in no word, so that they can't be taken for each other."""
    return F.array(F.concat(t["pattern"], F.lit(" _")), F.concat(F.lit("_ "), t["after"]), F.concat(t["pattern"], F.lit(" _ "), t["after"]))


def _few(df: DataFrame) -> DataFrame:
    """A written table as the side of a join: broadcast if its rows were counted and are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _confident_patterns(edges: DataFrame) -> DataFrame:
    """Confident patterns (``pattern``) of distinct ``pattern``, ``instance``, ``seed`` edges, once no round finds another.

    What is believed only grows: seeds stay, and a pattern's share can't fall. So every round but the last adds a pattern, and the set is
    that of any order of rounds. An instance is a seed if one of its edges says so. Counts are added up by pattern before and after the
    shuffle, so that a common word is no group of its edges.
    """
    seeds = written(edges.where("seed").select("instance").distinct(), "pii-believed")
    believed, known, patterns = seeds, 0, None
    while True:
        marked = edges.select("pattern", "instance").join(believed.withColumn("believed", F.lit(1)), "instance", "left")
        scored = marked.groupBy("pattern").agg(F.count("*").alias("n"), F.count("believed").alias("sure"))
        patterns = written(scored.where((F.col("sure") >= SUPPORT) & (F.col("sure") * 100 >= F.col("n") * CONFIDENT)).select("pattern"), "pii-patterns")
        count = patterns.count()
        if count == known:
            return patterns
        known = count
        stands = edges.join(_few(patterns), "pattern", "left_semi").select("instance")
        believed = written(seeds.union(stands).distinct(), "pii-believed")


def find_pii(df: DataFrame) -> DataFrame:
    """``doc_id``, ``key`` and ``pii``, the marks (start, order, end, kind) of each whole text.

    A null text is empty. ``key`` tells rows apart by doc_id and text; rows
    alike in both have the same result. Columns besides doc_id and text are
    left out. Marks of the base kinds are as their patterns say; those of kind
    ``context`` come from the patterns learned over all rows and overlap none
    of them.
    """
    docs = df.select("doc_id", row_key().alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    spans = base_spans(F.col("text"))
    based = docs.select("doc_id", "key", "text", F.concat(*(marks(spans[k], k, i) for i, k in enumerate(KINDS))).alias("base"))
    tokens = located(F.col("text"), TOKEN, F.col("text").rlike("[0-9@]"))
    found = written(based.select("doc_id", "key", "base", let(tokens, lambda t: _instances(F.col("text"), t, F.col("base"))).alias("tokens")), "pii-base")
    seen = found.where(F.size("tokens") > 0).select("key", F.explode("tokens").alias("t")).select("key", "t.*").where("instance <> ''")
    stands = lambda df: df.withColumn("pattern", F.explode(_patterns(F.struct("pattern", "after"))))
    edges = written(stands(seen.select("pattern", "after", "instance", "seed")).groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "pii-graph")
    patterns = _confident_patterns(edges)
    new = stands(seen.where(~F.col("seed") & F.col("likely"))).join(_few(patterns), "pattern", "left_semi").select("key", F.struct("start", F.lit(len(KINDS)).alias("order"), "end", F.lit(CONTEXT).alias("kind")).alias("m"))
    added = new.groupBy("key").agg(F.collect_set("m").alias("added"))
    return found.join(added, "key", "left").select("doc_id", "key", F.concat("base", F.coalesce("added", F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>"))).alias("pii"))


def pii_digest(found: DataFrame) -> DataFrame:
    """Counts and spans of the marks, as text."""
    base = F.filter("pii", lambda m: m["order"] < len(KINDS))
    number = lambda kind: F.size(F.filter("base", lambda m: m["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.withColumn("base", base).select("doc_id", *(number(k) for k in KINDS), F.sha2(spelled(F.col("base")), 256).alias("base_sha256"), spelled(F.col("pii")).alias("spans"))
