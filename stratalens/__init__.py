"""stratalens: source-tree and text-corpus analytics as Spark DataFrames."""

__version__ = "0.1.0"
