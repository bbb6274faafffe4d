"""PySpark jobs that turn tables of documents into a linked graph, search it, and prepare training data."""
