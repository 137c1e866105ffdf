"""sparquill: ranked text retrieval and its evaluation on Spark DataFrames."""

__version__ = "0.1.0"
