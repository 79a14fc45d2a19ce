"""Feed triage on Spark: scan, filter, classify, dedup, store and report feed items."""

__version__ = "0.1.0"
