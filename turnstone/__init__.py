"""turnstone: Spark jobs that turn chat history into a clean, searchable memory table."""
