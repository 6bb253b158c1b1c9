"""What the engine's queries send through the driver."""

import re

import pytest
from pyspark.sql.readwriter import DataFrameWriter

import __spark_entry__

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["ingest_history", "symbol_fields", "document_drift", "seeded_verdicts"])
def test_no_table_that_grows_is_broadcast(spark, monkeypatch, name):
    """Spark's guesses of sizes are from compressed files, so on tables as small as these it would broadcast any side that it is free to."""
    plans, parquet = [], DataFrameWriter.parquet
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())

    def recorded(self, *args, **kwargs):
        plan(self._df)
        return parquet(self, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", recorded)
    plan(__spark_entry__.queries()[name](spark, DATA))
    joins = [line.strip(" :+-") for p in plans for line in p.split("\n") if re.search("Join", line)]
    assert joins
    assert [j for j in joins if "SortMergeJoin" not in j and "[first#" not in j] == []  # packages are counted before
