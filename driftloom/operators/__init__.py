"""DataFrame operators that Spark does not have as one call."""
