"""tabweft: synthesis, evaluation and preparation of data on Spark DataFrames."""

__version__ = "0.1.0"
