"""Queries on histories and commits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.jobs import corpora
from ledgerline.jobs.corpora import COMMITS_SQL, HISTORY_SQL
from ledgerline.operators import history as H
from ledgerline.operators import review as R
from ledgerline.operators.ordering import dense_number
from ledgerline.streaming.live import closed_windows

AT = "2024-01-20 00:00:00"


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.windows(corpora.facts(spark, sf_dir))


def _text(*names):
    """Times as text, so that both engines print them alike."""
    return [F.date_format(n, "yyyy-MM-dd HH:mm:ss").alias(n) for n in names]


def l1_supersede(spark, sf_dir):
    return _history(spark, sf_dir).select("key", "value", *_text("valid_from", "valid_to"), "supersedes")


def l1_withdraw(spark, sf_dir):
    """Per key, how many windows a withdrawal closed."""
    closed = _history(spark, sf_dir).join(corpora.facts(spark, sf_dir).where("value is null").select("key", F.col("at").alias("valid_to")).distinct(), ["key", "valid_to"])
    return closed.groupBy("key").agg(F.count("*").alias("withdrawn"))


def _midpoint(spark, sf_dir):
    """The middle of the time that events span: one row."""
    return corpora.table(spark, sf_dir, "events").agg((F.min("ts") + (F.max("ts") - F.min("ts")) / 2).alias("t"))


def l1_as_of(spark, sf_dir):
    """What held in the middle of the history."""
    t = _midpoint(spark, sf_dir).select(F.date_trunc("day", "t").cast("timestamp_ntz").alias("t")).first()["t"]
    return H.as_of(_history(spark, sf_dir), F.lit(t).cast("timestamp_ntz")).select("key", "value")


def l1_as_of_many(spark, sf_dir):
    """For each event, what held of its user an hour later."""
    orders = corpora.table(spark, sf_dir, "events").select(F.col("event_id").alias("ask_id"), F.col("user_id").alias("key"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("at"))
    return H.as_of_many(corpora.facts(spark, sf_dir).where("value is not null").withColumnRenamed("at", "valid_from"), orders).select("ask_id", "key", "value")


def _asserted(spark, sf_dir):
    """Facts that became known up to six hours late."""
    return corpora.facts(spark, sf_dir).withColumn("known", F.col("at") + F.make_interval(hours=(F.col("tie") % 7).cast("int")))


def l1_bitemporal(spark, sf_dir):
    """Windows of validity, each as open as it was known to be, and when."""
    return H.bitemporal_windows(_asserted(spark, sf_dir)).select("key", "value", *_text("valid_from", "valid_to", "known_from", "known_to"))


def l1_known_about(spark, sf_dir):
    """For each event, what was known four hours later about the time an hour later."""
    later = lambda n: F.col("ts") + F.make_interval(hours=F.lit(n))
    asked = corpora.table(spark, sf_dir, "events").select(F.col("event_id").alias("ask_id"), F.col("user_id").alias("key"), later(4).alias("known"), later(1).alias("at"))
    return H.known_about(_asserted(spark, sf_dir), asked)


def l1_current(spark, sf_dir):
    return H.current(corpora.facts(spark, sf_dir)).where("value is not null").select("key", "value")


def l1_changed_fields(spark, sf_dir):
    """Per value, how many writes changed it and how many repeated it."""
    per = Window.partitionBy("key").orderBy("at", "tie")
    rows = corpora.facts(spark, sf_dir).withColumn("before", F.lag("value").over(per)).withColumn("differs", ~F.col("value").eqNullSafe(F.col("before")))
    return rows.groupBy(F.coalesce("value", F.lit("(none)")).alias("value")).agg(F.sum(F.col("differs").cast("long")).alias("changed"), F.sum((~F.col("differs")).cast("long")).alias("repeated"))


def out_of_order_rows(spark, sf_dir):
    """Orders of a customer that are older than one with a smaller number: writes that a live run refuses."""
    orders = corpora.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("tie"), F.col("o_orderdate").alias("at"))
    return H.out_of_order(orders).select("key", "tie")


def l1_stream(spark, sf_dir):
    """Windows that a stream of the events closes."""
    table = corpora.table(spark, sf_dir, "events")
    reader = spark.readStream.schema(table.schema)
    if all(f.endswith("/events.parquet") for f in table.inputFiles()):  # a stream reads folders: pick the one file by name
        events = reader.option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "true").parquet(sf_dir)
    else:
        events = reader.parquet(f"{sf_dir}/events.parquet")
    value = F.when(F.col("event_id") % 17 != 0, F.col("event_type"))
    facts = events.select(F.col("user_id").alias("key"), value.alias("value"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("tie"))
    return closed_windows(facts, "windows").select("key", "value", *_text("valid_from", "valid_to"))


def explain_open(spark, sf_dir):
    """Where each user's open value comes from: steps back to the first of its chain, and what that was."""
    return R.explain(corpora.facts(spark, sf_dir)).select("key", "value", "depth", "first_id", "first_value", "last_id", *_text("first_at", "last_at"))


def _waived(spark, sf_dir):
    """Disputes: windows of values other than a view, which is what documents say; waivers: every thirteenth event, of its user, for some days."""
    windows = _history(spark, sf_dir).where("value <> 'view'").select(F.col("tie").alias("id"), "key", "value", F.col("valid_from").alias("start"), F.col("valid_to").alias("end"))
    kinds = F.array(*map(F.lit, (*R.WAIVES, "docs_wrong", R.SUPPRESSES)))
    granted = corpora.table(spark, sf_dir, "events").where("event_id % 13 = 0").select(
        F.col("user_id").alias("key"), F.element_at(kinds, (F.when(F.col("event_id") % 91 == 0, 3).otherwise(F.col("event_id") % 3) + 1).cast("int")).alias("disposition"), F.col("ts").alias("granted"), (F.col("ts") + F.make_interval(days=(F.col("event_id") % 5 + 1).cast("int"))).alias("expires")
    )
    return windows, granted


def waived_disputes(spark, sf_dir):
    """The times for which disputes are open and no waiver covers them."""
    disputes, waivers = _waived(spark, sf_dir)
    return R.open_intervals(disputes, R.covers(waivers, disputes)).select("id", *_text("start", "end"))


def clock_clamp(spark, sf_dir):
    return H.clamp_clock(corpora.commits(spark, sf_dir), "seq", "micros").select("seq", "micros", "clamped")


def since_snapshot(spark, sf_dir):
    """The first commit at or after a time stands for the whole tree, later ones for their changes."""
    clamped = H.clamp_clock(corpora.commits(spark, sf_dir), "seq", "micros")
    start = clamped.agg(F.expr("min(clamped) + (max(clamped) - min(clamped)) div 2").alias("t"))
    kept = clamped.crossJoin(F.broadcast(start)).where("clamped >= t")  # one row
    first = kept.agg(F.min("seq").alias("first"))
    return kept.crossJoin(F.broadcast(first)).select("seq", F.when(F.col("seq") == F.col("first"), "snapshot").otherwise("changes").alias("mode"))


def resume_after(spark, sf_dir):
    """Commits after the one that a run stopped at, numbered from 1."""
    commits = corpora.commits(spark, sf_dir)
    stop = commits.agg((F.max("seq") / 2).alias("half")).join(commits, F.col("seq") <= F.col("half")).agg(F.max("seq")).first()[0]
    return dense_number(H.after(commits, "seq", stop), "seq", "n").select("seq", "n")


def changed_paths(spark, sf_dir):
    return corpora.changes(spark, sf_dir)


def commit_totals(spark, sf_dir):
    """Commits, changed paths and commits without a change, per month."""
    n = corpora.changes(spark, sf_dir).groupBy("seq").agg(F.count("*").alias("n"))
    rows = corpora.commits(spark, sf_dir).join(n, "seq", "left").withColumn("month", F.date_format("committed_at", "yyyy-MM"))
    return rows.groupBy("month").agg(F.count("*").alias("commits"), F.coalesce(F.sum("n"), F.lit(0)).alias("paths"), F.sum(F.col("n").isNull().cast("long")).alias("empty"))


def _snapshots(spark, sf_dir):
    """What each supplier has of each part, before and after the middle of all shipping dates."""
    lines = corpora.table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate")
    middle = lines.agg((F.min("l_shipdate") + (F.max("l_shipdate") - F.min("l_shipdate")) / 2).alias("middle"))
    path = F.concat(F.lit("src/s"), F.col("l_suppkey"), F.lit("/p"), F.col("l_partkey"), F.lit(".py"))
    rows = lines.crossJoin(F.broadcast(middle)).select(F.concat(F.lit("py:s"), F.col("l_suppkey"), F.lit(".p"), F.col("l_partkey"), F.lit(".f")).alias("symbol_key"), path.alias("path"), (F.col("l_shipdate") < F.col("middle")).alias("early"))  # one row
    return rows.where("early").drop("early").distinct(), rows.where("not early").drop("early").distinct()


def removed_symbols(spark, sf_dir):
    """Symbols of one snapshot that the next lacks."""
    before, after = _snapshots(spark, sf_dir)
    return before.join(after.select("symbol_key"), "symbol_key", "left_anti")


def lineage_added_removed(spark, sf_dir):
    """For each part, the first and last order that has it, and whether it is in the last tenth."""
    lines = corpora.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    top = lines.agg(F.max("l_orderkey").alias("top"))
    per = lines.groupBy("l_partkey").agg(F.min("l_orderkey").alias("added_in"), F.max("l_orderkey").alias("last_in"))
    return per.crossJoin(F.broadcast(top)).select(corpora.part_symbol("l_partkey").alias("symbol_key"), "added_in", F.when(F.col("last_in") * 10 < F.col("top") * 9, F.col("last_in")).alias("removed_in"))


QUERIES = {
    f.__name__: f
    for f in (l1_supersede, l1_withdraw, l1_as_of, l1_as_of_many, l1_bitemporal, l1_known_about, explain_open, waived_disputes, l1_current, l1_changed_fields, l1_stream, out_of_order_rows, clock_clamp, since_snapshot, resume_after, changed_paths, commit_totals, removed_symbols, lineage_added_removed)
}
_T = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {0}"
_CLAMP = COMMITS_SQL + """,
shifted AS (SELECT *, row_number() OVER (ORDER BY seq) AS rn FROM commits),
clock AS (SELECT seq, micros, max(micros - rn) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) + rn AS clamped FROM shifted)"""
_MIDDLE = "(SELECT date_trunc('day', min(ts) + (max(ts) - min(ts)) / 2) FROM events)"
ORACLE_SQL = {
    "l1_supersede": f"WITH {HISTORY_SQL} SELECT key, value, {_T.format('valid_from')}, {_T.format('valid_to')}, supersedes FROM history",
    "l1_withdraw": f"WITH {HISTORY_SQL} SELECT key, count(*) AS withdrawn FROM history JOIN (SELECT DISTINCT key, moment AS valid_to FROM facts WHERE value IS NULL) USING (key, valid_to) GROUP BY key",
    "l1_as_of": f"WITH {HISTORY_SQL} SELECT key, value FROM history WHERE valid_from <= {_MIDDLE} AND (valid_to IS NULL OR valid_to > {_MIDDLE})",
    "l1_as_of_many": f"""WITH {HISTORY_SQL}, asked AS (SELECT event_id AS ask_id, user_id AS key, ts + INTERVAL 1 HOUR AS moment FROM events)
      SELECT ask_id, asked.key, arg_max(value, (f.moment, f.tie)) AS value FROM asked LEFT JOIN (SELECT * FROM facts WHERE value IS NOT NULL) f ON f.key = asked.key AND f.moment <= asked.moment GROUP BY ask_id, asked.key""",
    "l1_bitemporal": f"""WITH {HISTORY_SQL}, heard AS (SELECT key, tie, max(moment + to_hours(CAST(tie % 7 AS INTEGER))) OVER (PARTITION BY key ORDER BY moment, tie ROWS UNBOUNDED PRECEDING) AS known FROM facts),
      both_times AS (SELECT key, value, moment AS valid_from, valid_to, known, lead(known) OVER (PARTITION BY key ORDER BY moment, tie) AS closed FROM edges JOIN heard USING (key, tie)),
      split AS (SELECT key, value, valid_from, CAST(NULL AS TIMESTAMP) AS valid_to, known AS known_from, closed AS known_to FROM both_times WHERE value IS NOT NULL AND (closed IS NULL OR known < closed)
        UNION ALL SELECT key, value, valid_from, valid_to, closed, NULL FROM both_times WHERE value IS NOT NULL AND closed IS NOT NULL)
      SELECT key, value, {", ".join(_T.format(c) for c in ("valid_from", "valid_to", "known_from", "known_to"))} FROM split""",
    "l1_known_about": f"""WITH {HISTORY_SQL}, heard AS (SELECT key, value, moment, tie, max(moment + to_hours(CAST(tie % 7 AS INTEGER))) OVER (PARTITION BY key ORDER BY moment, tie ROWS UNBOUNDED PRECEDING) AS known FROM facts)
      SELECT ask_id, key, CASE WHEN n > 0 THEN value[n] END AS value FROM (SELECT event_id AS ask_id, user_id AS key, list(h.value ORDER BY h.moment, h.tie) FILTER (h.tie IS NOT NULL) AS value, count(h.tie) AS n
        FROM events e LEFT JOIN heard h ON h.key = e.user_id AND h.moment <= e.ts + INTERVAL 1 HOUR AND h.known <= e.ts + INTERVAL 4 HOUR GROUP BY event_id, user_id)""",
    "explain_open": f"""WITH {HISTORY_SQL}, chains AS (SELECT *, count(*) FILTER (value IS NULL) OVER (PARTITION BY key ORDER BY moment, tie) AS chain, row_number() OVER (PARTITION BY key ORDER BY moment DESC, tie DESC) AS back FROM changed),
      kept AS (SELECT *, count(*) OVER w - 1 AS depth, first_value(tie) OVER w AS first_id, first_value(value) OVER w AS first_value, first_value(moment) OVER w AS first_at FROM chains WHERE value IS NOT NULL WINDOW w AS (PARTITION BY key, chain ORDER BY moment, tie))
      SELECT key, value, depth, first_id, first_value, tie AS last_id, {_T.format("first_at")}, strftime(moment, '%Y-%m-%d %H:%M:%S') AS last_at FROM kept WHERE back = 1""",
    "waived_disputes": f"""WITH {HISTORY_SQL}, disputes AS (SELECT tie AS id, key, value, valid_from AS a, coalesce(valid_to, TIMESTAMP '9999-01-01') AS b FROM history WHERE value <> 'view'),
      waivers AS (SELECT user_id AS key, CASE WHEN event_id % 91 = 0 THEN 3 ELSE event_id % 3 END AS kind, ts AS granted, ts + to_days(CAST(event_id % 5 + 1 AS INTEGER)) AS expires FROM events WHERE event_id % 13 = 0),
      met AS (SELECT * FROM disputes JOIN waivers USING (key) WHERE granted >= a AND granted < b AND kind <> 2),
      cover AS (SELECT id, granted AS a, least(expires, b) AS b FROM met WHERE kind < 2 UNION ALL SELECT d.id, d.a, d.b FROM disputes d WHERE (d.key, d.value) IN (SELECT (key, value) FROM met WHERE kind = 3)),
      points AS (SELECT id, a AS t FROM disputes UNION SELECT id, b FROM disputes UNION SELECT id, a FROM cover UNION SELECT id, b FROM cover),
      pieces AS (SELECT id, t AS a, lead(t) OVER (PARTITION BY id ORDER BY t) AS b FROM points),
      free AS (SELECT p.* FROM pieces p WHERE b IS NOT NULL AND NOT EXISTS (SELECT 1 FROM cover c WHERE c.id = p.id AND c.a <= p.a AND c.b >= p.b)),
      runs AS (SELECT *, sum(CASE WHEN a = last THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY a) AS run FROM (SELECT *, lag(b) OVER (PARTITION BY id ORDER BY a) AS last FROM free))
      SELECT id, strftime(min(a), '%Y-%m-%d %H:%M:%S') AS start, CASE WHEN max(b) < TIMESTAMP '9999-01-01' THEN strftime(max(b), '%Y-%m-%d %H:%M:%S') END AS "end" FROM runs GROUP BY id, run""",
    "l1_current": "SELECT key, value FROM (SELECT user_id AS key, CASE WHEN event_id % 17 = 0 THEN NULL ELSE event_type END AS value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1 AND value IS NOT NULL",
    "l1_changed_fields": f"WITH {HISTORY_SQL} SELECT coalesce(value, '(none)') AS value, CAST(count(*) FILTER (value IS DISTINCT FROM before) AS BIGINT) AS changed, CAST(count(*) FILTER (value IS NOT DISTINCT FROM before) AS BIGINT) AS repeated FROM stated GROUP BY ALL",
    "l1_stream": f"WITH {HISTORY_SQL} SELECT key, value, {_T.format('valid_from')}, {_T.format('valid_to')} FROM history WHERE valid_to IS NOT NULL",
    "out_of_order_rows": "SELECT key, tie FROM (SELECT o_custkey AS key, o_orderkey AS tie, o_orderdate, max(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM orders) WHERE o_orderdate < newest",
    "clock_clamp": f"WITH {_CLAMP} SELECT seq, micros, clamped FROM clock",
    "since_snapshot": f"WITH {_CLAMP}, kept AS (SELECT seq FROM clock WHERE clamped >= (SELECT min(clamped) + (max(clamped) - min(clamped)) // 2 FROM clock)) SELECT seq, CASE WHEN seq = (SELECT min(seq) FROM kept) THEN 'snapshot' ELSE 'changes' END AS mode FROM kept",
    "resume_after": f"WITH {COMMITS_SQL} SELECT seq, row_number() OVER (ORDER BY seq) AS n FROM commits WHERE seq > (SELECT max(seq) FROM commits WHERE seq <= (SELECT max(seq) / 2 FROM commits))",
    "changed_paths": f"WITH {COMMITS_SQL} SELECT seq, path FROM changes",
    "commit_totals": f"""WITH {COMMITS_SQL}, n AS (SELECT seq, count(*) AS n FROM changes GROUP BY seq) SELECT strftime(committed_at, '%Y-%m') AS month, count(*) AS commits,
      CAST(coalesce(sum(n), 0) AS BIGINT) AS paths, CAST(count(*) FILTER (n IS NULL) AS BIGINT) AS empty FROM commits LEFT JOIN n USING (seq) GROUP BY month""",
    "removed_symbols": """SELECT concat('py:s', l_suppkey, '.p', l_partkey, '.f') AS symbol_key, concat('src/s', l_suppkey, '/p', l_partkey, '.py') AS path FROM lineitem GROUP BY l_suppkey, l_partkey
      HAVING max(l_shipdate) < (SELECT min(l_shipdate) + (max(l_shipdate) - min(l_shipdate)) / 2 FROM lineitem)""",
    "lineage_added_removed": """SELECT concat('py:cat.p', l_partkey, '.f') AS symbol_key, min(l_orderkey) AS added_in,
      CASE WHEN max(l_orderkey) * 10 < (SELECT max(l_orderkey) FROM lineitem) * 9 THEN max(l_orderkey) END AS removed_in FROM lineitem GROUP BY l_partkey""",
}
