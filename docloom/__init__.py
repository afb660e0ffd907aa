"""docloom: document retrieval analytics and corpus maintenance on PySpark."""

__version__ = "0.1.0"
