"""Document catalogs, evidence extraction and fill planning as Spark DataFrames."""

__version__ = "0.1.0"
