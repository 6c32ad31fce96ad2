"""lodestrata: corpus inventory, selection, deduplication, diffing, integrity and storage on PySpark."""
