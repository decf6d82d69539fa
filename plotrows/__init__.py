"""plotrows: labelled data-series corpora on PySpark.

Column functions (``plotrows.functions``) take and return ``Column``;
operators, sources and plans take and return ``DataFrame``.  Nothing is
collected to the driver except bounded summary tables (one row per
partition or per class), and every ordered result has an explicit key.
"""

__version__ = "0.1.0"
