"""Analytics over trips and their context, and data preparation, as PySpark plans."""
