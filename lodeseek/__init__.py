"""lodeseek: hybrid entity search and corpus operators on PySpark DataFrames."""

__version__ = "0.1.0"
