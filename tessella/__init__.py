"""tessella: text mining, linked notes, habit analytics, file inventories,
message logs and room events as PySpark DataFrame operators."""

__version__ = "0.1.0"
