"""SQL-corpus analytics on Spark: statements, rules, findings and schemas as DataFrames."""

__version__ = "0.1.0"
