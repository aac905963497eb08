"""Scalar column expressions; all of them are built-in expressions, none is a UDF."""
