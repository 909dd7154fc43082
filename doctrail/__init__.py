"""doctrail: document-version analytics on PySpark DataFrames."""
