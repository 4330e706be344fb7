"""tidemark: append-only, time-indexed columnar tables on Spark."""
