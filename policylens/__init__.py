"""Insurance retention analytics as Spark DataFrame operators."""
