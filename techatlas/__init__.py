"""Technology-intelligence analytics as Spark DataFrame operators."""
