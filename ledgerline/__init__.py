"""Reconciliation of code facts with documented claims, as Spark jobs."""
