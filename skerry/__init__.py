"""skerry: a document-retrieval and analytics engine written as Spark plans."""

__version__ = "0.1.0"
