"""Bookkeeping analytics on Spark: receivables, statement parsing, ledger assembly, enrichment, reports."""
