"""corpuskit plans."""
