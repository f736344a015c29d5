"""Match-graph and price-regression analytics as PySpark DataFrame operators."""
