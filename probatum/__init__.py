"""Record integrity and evidence analytics as PySpark DataFrame operators."""
