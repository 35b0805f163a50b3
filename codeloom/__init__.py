"""codeloom: a source-code and document index as Spark DataFrames."""

__version__ = "0.1.0"
