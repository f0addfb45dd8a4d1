"""Open-text feedback analytics as plain ``DataFrame -> DataFrame`` Spark operators."""
