"""corpusmill: retrieval-corpus analytics on PySpark."""
