"""corpuskit operators."""
