"""Code-change evidence analytics as plain PySpark DataFrame operators."""
