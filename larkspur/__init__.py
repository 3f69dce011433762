"""A Spark-native analytics engine: relational operators, functions and streams on the public PySpark API."""
