"""corpuskit streaming."""
