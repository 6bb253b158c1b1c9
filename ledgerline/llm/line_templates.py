"""Operator 4: line dedup by a log-template tree, with DataFrame functions alone.

The tree has a fixed depth: lines go by their number of tokens and then by
their leading tokens, numbers taken as variable. In a leaf that many documents
reach, a token stays part of the template if it is frequent at its place, and
is a variable field otherwise. Lines of a template that recurs across documents
are dropped, but in the document with the smallest id that has one. A line that
stands in two documents byte for byte recurs, and so does a template that fixes
many tokens; other templates need more documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import clear_of, row_key, written

#: Leading tokens that are levels of the tree; the sign of a variable field.
DEPTH, FIELD = 3, "<*>"
#: A line of these alone is blank.
BLANK = " \t\n\x0b\f\r"
#: Documents that a template needs to be recurring; different lines, counted for each document, that a token needs to be frequent at its place.
MIN_DOCS = 5
#: Fixed tokens from which a template recurs in two documents.
MANY_FIXED = 10
#: Share of a template's tokens, but for those with digits, that it must fix.
FIXED_SHARE = 0.7
#: Rows of 8-byte hashes up to which a table is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 1 << 20
_LAST = (1 << 63) - 1


def masked(line: Column) -> Column:
    """A line whose tokens, as single spaces part them, are variable fields where they hold a digit."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, "[^ ]*[0-9][^ ]*", FIELD)).otherwise(line)


def n_met(text: Column, sign: str) -> Column:
    """How often an ASCII character stands in a text, counted in bytes."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(sign), F.lit("")))


def n_tokens(line: Column) -> Column:
    return n_met(line, " ") + 1


def leaf_of(line: Column) -> Column:
    """The leaf of a masked line: its number of tokens and the leading ones."""
    return F.xxhash64(n_tokens(line), F.substring_index(line, " ", DEPTH))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _small(df: DataFrame) -> DataFrame:
    """A written table of hashes, broadcast if its rows have been counted and are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def recurring_lines(df: DataFrame) -> DataFrame:
    """``line_hash`` of every different line whose template recurs, and ``keeper``, the smallest doc_id that has the template."""
    lines = df.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.explode(F.array_distinct(lines_of(F.col("text")))).alias("line"))
    lines = lines.where(F.ltrim(F.col("line"), F.lit(BLANK)) != "")
    two = F.min("doc") < F.max("doc")
    parsed = lines.withColumn("shape", masked(F.col("line"))).withColumn("leaf", leaf_of(F.col("shape"))).withColumn("line_hash", F.xxhash64("line"))
    # hashes are written once; only lines of leaves that have more to say are parsed again, for their shapes
    hashed = written(parsed.select("doc", "leaf", "line_hash", (n_tokens(F.col("shape")) >= MANY_FIXED).alias("many")), "hashed-lines")
    same = hashed.groupBy("line_hash").agg(F.min("doc").alias("keeper"), two.alias("two")).where("two").select("line_hash", "keeper")
    several = F.min("line_hash") < F.max("line_hash")  # a leaf of one line has no more to say than the line itself
    leaves = hashed.groupBy("leaf").agg(F.count("*").alias("n"), F.max("many").alias("many"), several.alias("several"), two.alias("two"))
    leaves = written(leaves.where(F.col("several") & ((F.col("n") >= MIN_DOCS) | (F.col("many") & F.col("two")))).select("leaf"), "leaves")
    reached = parsed.join(_small(leaves), "leaf").select("leaf", "line_hash", "shape", "doc")
    different = written(reached.groupBy("leaf", "line_hash").agg(F.first("shape").alias("shape"), F.count("*").alias("n"), F.min("doc").alias("doc"), F.max("doc").alias("last")), "lines")
    placed = different.select("leaf", "line_hash", "n", F.posexplode(F.split("shape", " ")).alias("at", "token")).withColumn("token", F.xxhash64("token"))
    field = F.xxhash64(F.lit(FIELD))
    frequent = placed.groupBy("leaf", "at", "token").agg(F.sum("n").alias("met"), F.count("*").alias("lines")).where(((F.col("met") >= MIN_DOCS) | (F.col("lines") >= 2)) & (F.col("token") != field))
    marked = placed.join(frequent, ["leaf", "at", "token"], "left").withColumn("met", F.coalesce("met", F.lit(0))).withColumn("lines", F.coalesce("lines", F.lit(0)))

    def shape(fixed: Column) -> tuple[Column, Column, Column]:
        """The template that fixes such tokens, the words of a line that it fixes, and its words. Tokens with digits are no words."""
        token = F.when(fixed, F.col("token")).otherwise(field)
        return F.xxhash64(F.array_sort(F.collect_list(F.struct("at", token.alias("token"))))).alias("template"), F.sum(fixed.cast("int")).alias("n_fixed"), F.sum((F.col("token") != field).cast("int")).alias("n_words")

    shapes = marked.groupBy("leaf", "line_hash").agg(F.struct(*shape(F.col("met") >= MIN_DOCS)).alias("usual"), F.struct(*shape(F.col("lines") >= 2)).alias("long"))
    typed = written(different.select("leaf", "line_hash", "n", "doc", "last").join(shapes, ["leaf", "line_hash"]), "templates")

    def in_many(rows: DataFrame) -> DataFrame:
        """Templates (``leaf``, ``template``) of lines that stand in MIN_DOCS documents, each document counted once."""
        likely = rows.groupBy("leaf", "template").agg(F.sum("n").alias("n"), F.count("*").alias("lines")).where(F.col("n") >= MIN_DOCS)
        several = written(rows.select("leaf", "line_hash", "template").join(likely.where("lines > 1").select("leaf", "template"), ["leaf", "template"]), "likely-templates")
        held = hashed.select("leaf", "line_hash", "doc").join(_small(several.select("line_hash", "template")), "line_hash")
        counted = held.groupBy("leaf", "template", "doc").agg(F.lit(1).alias("one")).groupBy("leaf", "template").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_DOCS)
        return likely.where("lines = 1").select("leaf", "template").union(counted.select("leaf", "template"))

    def recurring(rows: DataFrame, kind: str, enough: Column | None) -> DataFrame:
        """Lines of the templates of a kind that recur, with their keeper; by default those in many documents do."""
        rows = rows.select("leaf", "line_hash", "n", "doc", "last", f"{kind}.*").where("n_fixed > 0")
        share = F.sum(F.col("n") * F.col("n_fixed")) / F.sum(F.col("n") * F.col("n_words"))  # of all its lines, as they differ in words
        enough = F.lit(True) if enough is None else enough
        found = rows.groupBy("leaf", "template").agg(F.min("doc").alias("keeper"), (enough & (share >= FIXED_SHARE)).alias("enough")).where("enough").select("leaf", "template", "keeper")
        if kind == "usual":
            found = found.join(in_many(rows), ["leaf", "template"])
        return rows.join(found, ["leaf", "template"]).select("line_hash", "keeper")

    # each line goes by one of the three, so that the keeper of a template keeps what it has of it
    usual = written(recurring(typed, "usual", None), "usual-templates")
    others = typed.join(usual.select("line_hash"), "line_hash", "left_anti")
    long = recurring(others, "long", (F.min("n_fixed") >= MANY_FIXED) & (F.min("doc") < F.max("last")))
    ranked = [rows.withColumn("rank", F.lit(i)) for i, rows in enumerate((usual, long, same))]
    by = F.struct("rank", "keeper")
    return written(ranked[0].unionByName(ranked[1]).unionByName(ranked[2]).groupBy("line_hash").agg(F.min(by)["keeper"].alias("keeper")), "recurring-lines")


def drop_templates(df: DataFrame) -> DataFrame:
    """The rows of ``df`` with ``text`` rewritten and ``n_lines``, ``n_dropped`` counted; other columns stay.

    A line goes if its template recurs and the row's doc_id isn't the smallest
    that has the template. A null text stays null with no lines; an empty one has
    one blank line, which stays. Repeated rows are treated alike; a null doc_id
    comes after all others. Columns named n_lines or n_dropped are replaced.
    """
    gone = recurring_lines(df.select("doc_id", "text"))
    rest = [c for c in df.columns if c.lower() not in ("n_lines", "n_dropped")]
    key, lost, left = (clear_of(c, rest) for c in ("row", "lost", "left"))
    hit = df.select(row_key().alias("key"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.explode(F.array_distinct(lines_of(F.col("text")))).alias("line"))
    hit = hit.select("key", "doc", F.xxhash64("line").alias("line_hash")).join(_small(gone), "line_hash").where("doc <> keeper").groupBy("key").agg(F.collect_set("line_hash").alias(lost))
    marked = df.select(*rest).withColumn(key, row_key()).join(written(hit, "dropped-lines").withColumnRenamed("key", key).hint("shuffle_hash"), key, "left")
    kept = F.filter(lines_of(F.col("text")), lambda x: ~F.array_contains(lost, F.xxhash64(x)))
    n = F.when(F.col("text").isNull(), 0).otherwise(n_met(F.col("text"), "\n") + 1).cast("long")
    cut = marked.withColumn("n_lines", n).withColumn(left, F.when(F.col(lost).isNotNull(), kept))
    text = F.when(F.col(lost).isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    dropped = F.when(F.col(lost).isNull(), F.lit(0)).otherwise(F.col("n_lines") - F.size(left)).cast("long")
    return cut.withColumn("n_dropped", dropped).withColumn("text", text).select(*rest, "n_lines", "n_dropped")
