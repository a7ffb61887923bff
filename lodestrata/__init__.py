"""lodestrata: an analytics engine on PySpark."""
