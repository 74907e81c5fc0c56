"""Ledgerline: financial-transaction analytics written as Spark DataFrame jobs."""
