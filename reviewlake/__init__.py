"""Change-review analytics on Spark: many reviews in one job, every relation keyed by ``review_id``."""

__version__ = "0.1.0"
