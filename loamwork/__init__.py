"""A PySpark-native analytics engine: queries declared on DataFrames and Spark SQL."""
