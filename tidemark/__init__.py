"""tidemark: network-telemetry analytics written for PySpark.

Operators take and return DataFrames, keep the work inside Catalyst wherever the
built-in expressions can say it, and project the columns they need first, so that
extra columns of the caller never clash with their own.
"""
