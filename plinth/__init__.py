"""Market-intelligence operators and training-data operators for PySpark."""
