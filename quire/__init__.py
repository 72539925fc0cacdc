"""quire: library analytics and corpus preparation as PySpark DataFrames."""
