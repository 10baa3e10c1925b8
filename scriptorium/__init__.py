"""Text-corpus analytics on Spark: search, linking, auditing and preparation of large text collections."""
