"""Dataset curation, audit and evaluation engine on PySpark."""
