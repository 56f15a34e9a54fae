"""tessel: a hybrid retrieval and corpus engine built on Spark DataFrames."""

__version__ = "0.1.0"
