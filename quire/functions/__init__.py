"""Scalar functions over text, metadata and numbers, as Spark columns."""
