"""Analytics over detection data sets: ingest, curation and evaluation as Spark plans."""

__version__ = "0.1.0"
