"""DataFrame operators that Spark does not have in one call."""
