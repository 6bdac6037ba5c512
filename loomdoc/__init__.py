"""loomdoc: document analytics as Spark DataFrame transformations."""
