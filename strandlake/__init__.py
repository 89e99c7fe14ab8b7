"""strandlake: sequence analytics as lazy PySpark DataFrame operators."""
