"""A PySpark-native analytics engine: DataFrame operators, Column functions, sources, profiling and a SQL dialect."""
