"""Validated ingest, reject ladders, warehouse loads and run-to-run reconciliation on Spark."""
