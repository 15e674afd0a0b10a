"""GPU-fleet metrics on PySpark: ingest, clean, store, query, roll up, queue and stream."""
