"""cutline: point-in-time feature tables, projection ladders and corpus preparation on PySpark."""
