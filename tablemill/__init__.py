"""Table and stream operators for the life of a machine-learning data set, on PySpark."""
