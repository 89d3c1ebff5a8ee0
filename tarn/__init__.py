"""Record collections, event logs, job queues and SQL over them, on PySpark."""
