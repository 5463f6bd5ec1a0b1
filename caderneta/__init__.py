"""Transaction cleaning, categorisation and reconciliation as Spark jobs."""

__version__ = "0.1.0"
