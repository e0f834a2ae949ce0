"""Column expressions: everything here returns a ``pyspark.sql.Column``."""
