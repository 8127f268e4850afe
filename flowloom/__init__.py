"""flowloom: event-time flow analytics written as ordinary PySpark jobs."""
