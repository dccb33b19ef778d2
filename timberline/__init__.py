"""Structured-log analytics on Spark: ingest, filter, page, count, report and retain."""
