"""Staleness validation of operation logs, and batch operators over a social graph, on PySpark."""
