"""sievelake: review bodies of source text as Spark DataFrames."""

__version__ = "0.1.0"
