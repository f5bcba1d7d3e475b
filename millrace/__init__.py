"""millrace: Spark-first analytics for evolving corpora of listings and documents."""
