"""A PySpark-native analytics engine: sources, functions, operators, plans and streams over DataFrames."""
