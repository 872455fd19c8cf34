"""Claims-document analytics as PySpark DataFrame operators."""
